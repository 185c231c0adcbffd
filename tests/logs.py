"""Small literal logs."""

SCHEMA = (
    "event_uuid string, project_uuid string, node_uuid string, stream_seq bigint, hlc_us bigint, "
    "hlc_ns int, hlc_node string, hlc_seq bigint, kind string, entity_uuid string, field string, "
    "value string, member string, delta bigint, state_key string, entity_kind string, "
    "item_type string, schema_version bigint, fields map<string,string>"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def event(n, kind, at, node="N0", entity="E1", **more):
    """One event; ``n`` names it, ``at`` is its instant."""
    row = {
        "event_uuid": f"{n:026d}",
        "project_uuid": "P0",
        "node_uuid": node,
        "stream_seq": n,
        "hlc_us": at,
        "hlc_ns": 0,
        "hlc_node": node,
        "hlc_seq": 0,
        "kind": kind,
        "entity_uuid": entity,
        "schema_version": 1,
        **more,
    }
    return tuple(row.get(name) for name in NAMES)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def create(n, at, entity="E1", item_type="bug", **fields):
    return event(n, "item.create", at, entity=entity, entity_kind="issue", item_type=item_type, fields=fields)
