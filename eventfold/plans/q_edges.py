"""Queries: relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.operators import edges
from eventfold.plans.adapters import edge_log, order_items, table, tag, with_parts
from eventfold.plans.registry import query

STATE = {
    "last_create": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relation_uuid ORDER BY {desc}) AS rn
    FROM edges WHERE kind = 'relation.create') WHERE rn = 1""",
    "relation_state": """SELECT c.*, EXISTS (SELECT 1 FROM edges d WHERE d.relation_uuid = c.relation_uuid
    AND d.kind = 'relation.delete' AND (d.hlc_us, d.hlc_node, d.hlc_seq, d.node_uuid, d.stream_seq, d.event_uuid)
      > (c.hlc_us, c.hlc_node, c.hlc_seq, c.node_uuid, c.stream_seq, c.event_uuid)) AS deleted FROM last_create c""",
}
LIVE = {**STATE, "live": "SELECT * FROM relation_state WHERE NOT deleted"}
DIRECTED = {
    **LIVE,
    "directed": """SELECT from_uuid AS entity_uuid, to_uuid AS peer_uuid, 'outgoing' AS direction, relation_uuid,
    relation_kind FROM live UNION ALL SELECT to_uuid, from_uuid, 'incoming', relation_uuid, relation_kind FROM live""",
}


@query(
    "d5_relations",
    with_parts(
        ["edges"],
        "SELECT relation_uuid, project_uuid, relation_kind, from_uuid, to_uuid, hlc_us AS made_us FROM last_create",
        STATE,
    ),
)
def relations(spark, sf):
    """Last create of each relation id: kind and ends."""
    return edges.relations(edge_log(spark, sf)).select(
        "relation_uuid", "project_uuid", "relation_kind", "from_uuid", "to_uuid", F.col("made.hlc_us").alias("made_us")
    )


@query("d6_live_relations", with_parts(["edges"], "SELECT relation_uuid, deleted FROM relation_state", STATE))
def live_relations(spark, sf):
    """Tombstone flag: a delete later than the last create."""
    return edges.relations(edge_log(spark, sf)).select("relation_uuid", "deleted")


@query(
    "d7_relation_attributes",
    with_parts(
        ["edges"],
        """SELECT relation_uuid, key, value FROM (SELECT *, row_number() OVER
        (PARTITION BY relation_uuid, key ORDER BY {desc}) AS rn FROM since) WHERE rn = 1""",
        {
            **STATE,
            "since": """SELECT e.*, unnest(CASE WHEN e.kind = 'relation.create' THEN ['qty']
                ELSE ['qty', 's' || (e.supp % 3)] END) AS key,
              unnest(CASE WHEN e.kind = 'relation.create' THEN [e.qty] ELSE [e.qty, CAST(e.supp AS VARCHAR)] END) AS value
            FROM edges e JOIN last_create c ON c.relation_uuid = e.relation_uuid
            WHERE e.event_uuid = c.event_uuid OR (e.kind = 'relation.set-attr'
              AND (e.hlc_us, e.hlc_node, e.hlc_seq, e.node_uuid, e.stream_seq, e.event_uuid)
              > (c.hlc_us, c.hlc_node, c.hlc_seq, c.node_uuid, c.stream_seq, c.event_uuid))""",
        },
    ),
)
def relation_attributes(spark, sf):
    """Attributes merged key by key since the last create."""
    log = edge_log(spark, sf)
    return edges.attributes(log, edges.relations(log))


@query(
    "d7_orphan_changes",
    with_parts(
        ["edges"],
        """SELECT event_uuid, relation_uuid FROM edges WHERE kind = 'relation.set-attr' AND relation_uuid NOT IN
        (SELECT relation_uuid FROM last_create)""",
        STATE,
    ),
)
def orphan_changes(spark, sf):
    """Attribute changes of relations never created: error rows."""
    return edges.orphan_changes(edge_log(spark, sf)).select("event_uuid", "relation_uuid")


@query(
    "d8_touching",
    with_parts(
        ["edges"],
        """SELECT d.*, e.label FROM directed d JOIN entity e ON e.entity_uuid = d.entity_uuid""",
        {
            **DIRECTED,
            "entity": """SELECT 'O' || o_orderkey AS entity_uuid, o_orderstatus AS label FROM orders
            UNION ALL SELECT 'P' || p_partkey, p_brand FROM part""",
        },
    ),
)
def touching(spark, sf):
    """Every live edge seen from both of its ends."""
    entities = (
        table(spark, sf, "orders")
        .select(tag("O", F.col("o_orderkey")).alias("entity_uuid"), F.col("o_orderstatus").alias("label"))
        .unionByName(
            table(spark, sf, "part").select(
                tag("P", F.col("p_partkey")).alias("entity_uuid"), F.col("p_brand").alias("label")
            )
        )
    )
    return edges.touching(edges.relations(edge_log(spark, sf)), entities)


@query(
    "d9_project_relations",
    with_parts(
        ["edges", "items"],
        """SELECT 'own' AS scope, relation_uuid, relation_kind FROM live WHERE project_uuid = 'P1'
        UNION ALL SELECT 'endpoint', relation_uuid, relation_kind FROM live
        WHERE from_uuid IN (SELECT entity_uuid FROM items WHERE project_uuid = 'P1')
           OR to_uuid IN (SELECT entity_uuid FROM items WHERE project_uuid = 'P1')""",
        LIVE,
    ),
)
def project_relations(spark, sf):
    """Relations of a project under both definitions."""
    state = edges.relations(edge_log(spark, sf))
    own = edges.of_project(state, "P1")
    ends = edges.of_project(state, "P1", order_items(spark, sf).select("entity_uuid", "project_uuid"))
    pick = lambda df, scope: df.select(F.lit(scope).alias("scope"), "relation_uuid", "relation_kind")
    return pick(own, "own").unionByName(pick(ends, "endpoint"))
