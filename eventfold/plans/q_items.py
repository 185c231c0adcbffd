"""Queries: order and dedup, registers, sets, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.functions.stamps import order_key
from eventfold.operators import order, registers, sets
from eventfold.plans import catalog
from eventfold.plans.adapters import (
    item_changes,
    item_log,
    parted,
    table,
    with_parts,
)
from eventfold.plans.registry import query

# Parts shared by several checks.
FIELD_STATE = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_uuid, name
  ORDER BY {desc}) AS rn FROM writes) WHERE rn = 1"""
VTYPE = """CASE WHEN {c} IS NULL THEN 'cleared' WHEN {c} LIKE '"%' THEN 'string'
  WHEN {c} IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match({c}, '-?[0-9]+') THEN 'integer'
  WHEN regexp_full_match({c}, '-?[0-9]+[.][0-9]+') THEN 'decimal' ELSE 'json' END"""
HEADER = """SELECT entity_uuid, {head_last} FROM log"""
MEMBERS = """SELECT *, CASE WHEN kind LIKE '%label' THEN 'labels' ELSE 'assignees' END AS set_name,
  kind IN ('item.add-label', 'item.assign-user') AS is_add FROM log
  WHERE kind IN ('item.add-label', 'item.remove-label', 'item.assign-user', 'item.unassign-user')"""
SET_STATE = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_uuid, set_name, member
  ORDER BY {desc}) AS rn FROM members) WHERE rn = 1"""
TYPES = """SELECT entity_uuid, entity_kind, item_type FROM (SELECT *, row_number() OVER
  (PARTITION BY entity_uuid ORDER BY {desc}) AS rn FROM log WHERE kind = 'item.create') WHERE rn = 1"""
HEADERS = """SELECT t.entity_uuid, c.project_uuid, c.entity_kind, c.item_type, s.state_key, a.archived,
    f.hlc_us AS created_us, f.event_uuid AS created_by, u.hlc_us AS updated_us, u.event_uuid AS updated_by
  FROM (SELECT DISTINCT entity_uuid FROM log WHERE kind = 'item.create') t
  JOIN (SELECT *, row_number() OVER (PARTITION BY entity_uuid ORDER BY {desc}) AS rn FROM log
    WHERE kind = 'item.create') c ON c.entity_uuid = t.entity_uuid AND c.rn = 1
  JOIN (SELECT *, row_number() OVER (PARTITION BY entity_uuid ORDER BY {o}) AS rn FROM log
    WHERE kind = 'item.create') f ON f.entity_uuid = t.entity_uuid AND f.rn = 1
  JOIN (SELECT *, row_number() OVER (PARTITION BY entity_uuid ORDER BY {desc}) AS rn FROM log
    WHERE kind IN ('item.create', 'item.set-field', 'item.clear-field', 'item.adjust-field',
      'item.set-state', 'item.archive', 'item.restore')) u ON u.entity_uuid = t.entity_uuid AND u.rn = 1
  JOIN (SELECT *, row_number() OVER (PARTITION BY entity_uuid ORDER BY {desc}) AS rn FROM log
    WHERE kind IN ('item.create', 'item.set-state')) s ON s.entity_uuid = t.entity_uuid AND s.rn = 1
  JOIN (SELECT entity_uuid, kind = 'item.archive' AS archived, row_number() OVER
    (PARTITION BY entity_uuid ORDER BY {desc}) AS rn FROM log
    WHERE kind IN ('item.create', 'item.archive', 'item.restore')) a ON a.entity_uuid = t.entity_uuid AND a.rn = 1"""
STATE_PARTS = {"state": FIELD_STATE}
SET_PARTS = {"members": MEMBERS, "set_state": SET_STATE}


@query(
    "o1_canonical_order",
    with_parts(["changes"], "SELECT event_uuid, row_number() OVER (ORDER BY {o}) AS rank FROM changes"),
)
def canonical_order(spark, sf):
    """Replay position of every event over the whole log."""
    return order.canonical_order(item_changes(table(spark, sf, "events"))).select("event_uuid", "rank")


def copies(spark, sf):
    """The log with every 13th event delivered twice, the second time later."""
    log = item_changes(table(spark, sf, "events")).drop("fields")
    again = log.where(F.col("stream_seq") % 13 == 0).withColumn("arrival", F.col("stream_seq") + 1_000_000_000)
    again = again.withColumn("actor", F.lit("user:copy"))
    return log.withColumn("arrival", F.col("stream_seq")).unionByName(again)


@query("o2_first_copy", with_parts(["changes"], "SELECT event_uuid, actor, kind, hlc_us FROM changes"))
def first_copy(spark, sf):
    """Idempotent dedup: the first delivered copy of an event id wins."""
    return order.first_copy(copies(spark, sf), [F.col("arrival")]).select(
        "event_uuid", "actor", "kind", "hlc_us"
    )


@query(
    "o3_backlog",
    with_parts(
        ["changes"],
        "SELECT event_uuid, kind, hlc_us FROM changes WHERE project_uuid = 'P1' AND stream_seq % 3 <> 0",
    ),
)
def backlog(spark, sf):
    """Events of one project that the reduced ledger does not hold yet."""
    log = item_changes(table(spark, sf, "events"))
    ledger = log.where(F.col("stream_seq") % 3 == 0).select("event_uuid")
    return order.backlog(log, ledger, "P1").select("event_uuid", "kind", "hlc_us")


PROGRESS = """SELECT '{what}' AS ledger, {by} AS id, event_uuid AS last_event_uuid, hlc_us AS last_hlc_us,
  hlc_node AS last_hlc_node, stream_seq AS last_stream_seq, events FROM (SELECT *, row_number() OVER
  (PARTITION BY {by} ORDER BY {{desc}}) AS rn, count(*) OVER (PARTITION BY {by}) AS events FROM changes) WHERE rn = 1"""


@query(
    "o4_progress_ledgers",
    with_parts(
        ["changes"],
        PROGRESS.format(what="node", by="node_uuid").replace("{{", "{").replace("}}", "}")
        + " UNION ALL "
        + PROGRESS.format(what="project", by="project_uuid").replace("{{", "{").replace("}}", "}"),
    ),
)
def progress(spark, sf):
    """Last applied event per node and last reduced event per project."""
    log = item_changes(table(spark, sf, "events"))

    def one(what, by):
        rows = order.progress(log, by).withColumnRenamed(by, "id")
        return rows.select(F.lit(what).alias("ledger"), *rows.columns)

    return one("node", "node_uuid").unionByName(one("project", "project_uuid"))


@query(
    "o5_latest_event",
    with_parts(
        ["log"],
        """SELECT project_uuid, event_uuid, kind FROM (SELECT *, row_number() OVER
        (PARTITION BY project_uuid ORDER BY {desc}) AS rn FROM log) WHERE rn = 1""",
    ),
)
def latest_event(spark, sf):
    """Latest event of each project."""
    return order.latest_event(item_log(spark, sf))


@query(
    "o6_missing_dependencies",
    """WITH d AS (SELECT event_id, unnest([event_id - 1, event_id + 5]) AS dep FROM events)
    SELECT lpad(CAST(event_id AS VARCHAR), 26, '0') AS event_uuid, lpad(CAST(dep AS VARCHAR), 26, '0') AS dep
    FROM d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = d.dep AND e.event_type <> 'signup')""",
)
def missing_dependencies(spark, sf):
    """Named dependencies that are not in the log (signups taken out of it)."""
    i = F.col("event_id")
    pad = lambda c: F.lpad(c.cast("string"), 26, "0")
    rows = table(spark, sf, "events")
    log = rows.select(pad(i).alias("event_uuid"), F.array(pad(i - 1), pad(i + 5)).alias("deps"), "event_type")
    return order.missing_dependencies(log, log.where(F.col("event_type") != "signup"))


@query(
    "r1_lww_register",
    with_parts(
        ["writes"],
        "SELECT entity_uuid, name AS field, written AS value, event_uuid, hlc_us FROM state",
        STATE_PARTS,
    ),
)
def lww_register(spark, sf):
    """Last-writer-wins merge of every (item, field) over all writes."""
    state = registers.lww(
        registers.field_writes(item_log(spark, sf)), ["entity_uuid", "field"], ["value"]
    )
    return state.select("entity_uuid", "field", "value", "event_uuid", "hlc_us")


@query(
    "r2_set_field",
    with_parts(
        ["writes"],
        f"""SELECT entity_uuid, name AS field, {VTYPE.format(c='written')} AS value_type,
        trim(written, '"') AS value FROM state WHERE written IS NOT NULL
        AND entity_uuid IN (SELECT entity_uuid FROM creates)""",
        STATE_PARTS,
    ),
)
def set_field(spark, sf):
    """Typed current values of existing items."""
    log = item_log(spark, sf)
    live = registers.with_items(registers.live_fields(registers.field_state(log)), log)
    text = F.coalesce(registers.json_text(F.col("value")), F.col("value"))
    return live.select("entity_uuid", "field", "value_type", text.alias("value"))


@query(
    "r3_cleared_fields",
    with_parts(
        ["writes"],
        "SELECT entity_uuid, name AS field, event_uuid AS cleared_by, hlc_us FROM state WHERE written IS NULL",
        STATE_PARTS,
    ),
)
def cleared_fields(spark, sf):
    """Tombstones of cleared fields with the clear that won."""
    state = registers.field_state(item_log(spark, sf)).where(F.col("value_type") == "cleared")
    return state.select("entity_uuid", "field", F.col("event_uuid").alias("cleared_by"), "hlc_us")


@query(
    "r4_create_fields",
    with_parts(
        ["creates"],
        """SELECT event_uuid, entity_uuid, 'title' AS field, title AS value FROM creates WHERE title IS NOT NULL
        UNION ALL SELECT event_uuid, entity_uuid, 'f0', f0 FROM creates""",
    ),
)
def create_fields(spark, sf):
    """One write per name in the fields of a create."""
    return registers.create_writes(item_log(spark, sf)).select("event_uuid", "entity_uuid", "field", "value")


def last_of(kinds: str, value: str) -> str:
    return f"""SELECT entity_uuid, {value}, event_uuid FROM (SELECT *, row_number() OVER
    (PARTITION BY entity_uuid ORDER BY {{desc}}) AS rn FROM log WHERE kind IN ({kinds})) WHERE rn = 1"""


@query("r5_state_register", with_parts(["log"], last_of("'item.create', 'item.set-state'", "state_key")))
def state_register(spark, sf):
    """Current state key per item; NULL where only a create is known."""
    return registers.state_register(item_log(spark, sf)).select("entity_uuid", "state_key", "event_uuid")


@query(
    "r6_archive_register",
    with_parts(
        ["log"], last_of("'item.create', 'item.archive', 'item.restore'", "kind = 'item.archive' AS archived")
    ),
)
def archive_register(spark, sf):
    """Archived flag per item."""
    return registers.archive_register(item_log(spark, sf)).select("entity_uuid", "archived", "event_uuid")


def entity_types(log):
    return (
        log.where(F.col("kind") == "item.create")
        .groupBy("entity_uuid")
        .agg(F.max_by(F.struct("entity_kind", "item_type"), order_key()).alias("t"))
        .select("entity_uuid", "t.entity_kind", "t.item_type")
    )


@query(
    "r7_typed_writes",
    with_parts(
        ["writes"],
        """, w AS (SELECT event_uuid, w.entity_uuid, w.name AS field, f.field_kind, written,
          CASE WHEN written LIKE '"%' THEN trim(written, '"') END AS txt,
          regexp_full_match(written, '-?[0-9]+([.][0-9]+)?') AS num, vtype
          FROM (SELECT *, """
        + VTYPE.format(c="written")
        + """ AS vtype FROM writes WHERE written IS NOT NULL) w
          LEFT JOIN types t ON t.entity_uuid = w.entity_uuid
          LEFT JOIN schema_fields f ON f.project_uuid = w.project_uuid AND f.entity_kind = t.entity_kind
            AND f.item_type = t.item_type AND f.field = w.name),
        e AS (SELECT *, CASE WHEN field_kind IS NULL THEN NULL
          WHEN field_kind IN ('text', 'url', 'email', 'enum') AND txt IS NULL THEN 'expected_string'
          WHEN field_kind = 'number' AND NOT num THEN 'expected_integer'
          WHEN field_kind = 'decimal' AND NOT num THEN 'expected_decimal'
          WHEN field_kind = 'boolean' AND vtype <> 'boolean' THEN 'expected_boolean'
          WHEN field_kind = 'date' AND txt IS NULL THEN 'expected_date'
          WHEN field_kind = 'date_time' AND (txt IS NULL OR txt NOT LIKE '2026-__-__T10:00:00Z') THEN 'expected_datetime'
          WHEN field_kind = 'member' AND (txt IS NULL OR NOT regexp_full_match(txt, '(user|agent):.+')) THEN 'expected_member'
          WHEN field_kind = 'entity_ref' THEN 'expected_entity_ref'
          WHEN field_kind = 'counter' THEN 'counter_scalar_set' END AS error FROM w)
        SELECT event_uuid, entity_uuid, field, field_kind, error,
          CASE WHEN error IS NULL THEN CASE coalesce(field_kind, 'none') WHEN 'none' THEN vtype
            WHEN 'number' THEN 'integer' WHEN 'decimal' THEN 'decimal' WHEN 'boolean' THEN 'boolean'
            WHEN 'date' THEN 'date' WHEN 'date_time' THEN 'datetime' WHEN 'member' THEN 'member'
            ELSE 'string' END END AS value_type,
          CASE WHEN error IS NULL THEN CASE WHEN field_kind = 'number'
            THEN CAST(CAST(trunc(CAST(written AS DOUBLE)) AS BIGINT) AS VARCHAR)
            ELSE coalesce(txt, written) END END AS stored FROM e""",
        {"types": TYPES, "schema_fields": catalog.SQL["schema_fields"]},
    ),
)
def typed_writes(spark, sf):
    """Every write of the log coerced to its declared kind, misfits with a reason."""
    log = item_log(spark, sf)
    return registers.typed_writes(log, entity_types(log), catalog.schema_fields(spark))


@query(
    "r8_field_provenance",
    with_parts(
        ["writes"],
        """SELECT entity_uuid, name AS field, event_uuid, hlc_us, hlc_node, hlc_seq, node_uuid, stream_seq
        FROM state""",
        STATE_PARTS,
    ),
)
def field_provenance(spark, sf):
    """Which event, clock and node wrote the current value; no join with the log."""
    return registers.field_state(item_log(spark, sf)).select(
        "entity_uuid", "field", "event_uuid", "hlc_us", "hlc_node", "hlc_seq", "node_uuid", "stream_seq"
    )


@query("r9_item_headers", with_parts(["log"], HEADERS))
def item_headers(spark, sf):
    """Type, state, created and updated stamps of every item."""
    return registers.headers(item_log(spark, sf))


ITEM_FIELDS = ["title", "f0", "f1", "f2", "f3"]


@query(
    "r10_item_view",
    with_parts(
        ["log", "writes"],
        """SELECT h.entity_uuid, project_uuid, item_type, state_key, archived, created_us, updated_us,
          title, f0, f1, f2, f3, coalesce(field_count, 0) AS field_count,
          coalesce(part, 0) AS part, member_list FROM headers h
        LEFT JOIN (SELECT entity_uuid, count(*) AS field_count, """
        + ", ".join(f"max(CASE WHEN name = '{f}' THEN trim(written, '\"') END) AS {f}" for f in ITEM_FIELDS)
        + """ FROM state WHERE written IS NOT NULL GROUP BY entity_uuid) w ON w.entity_uuid = h.entity_uuid
        LEFT JOIN (SELECT entity_uuid, part, string_agg(set_name || '=' || member, ',' ORDER BY set_name || '=' || member)
          AS member_list FROM """
        + parted("set_state WHERE is_add", "entity_uuid", "set_name || '=' || member")
        + " GROUP BY entity_uuid, part) m ON m.entity_uuid = h.entity_uuid",
        {**STATE_PARTS, **SET_PARTS, "headers": HEADERS},
    ),
)
def item_view(spark, sf):
    """Header, fields, labels and assignees of every item."""
    log = item_log(spark, sf)
    members = sets.active_members(sets.or_set(sets.set_operations(log)))
    return registers.item_view(log, members, ITEM_FIELDS).select(
        "entity_uuid",
        "project_uuid",
        "item_type",
        "state_key",
        "archived",
        "created_us",
        "updated_us",
        *ITEM_FIELDS,
        F.coalesce("field_count", F.lit(0)).alias("field_count"),
        "part",
        F.array_join("members", ",").alias("member_list"),
    )


@query(
    "r11_field_history",
    with_parts(
        ["writes"],
        """SELECT entity_uuid, name AS field, row_number() OVER w AS version, event_uuid, written AS value,
        hlc_us AS valid_from_us, lead(hlc_us) OVER w AS valid_to_us, lead(event_uuid) OVER w AS replaced_by
        FROM writes WINDOW w AS (PARTITION BY entity_uuid, name ORDER BY {o})""",
    ),
)
def field_history(spark, sf):
    """Every write with its validity interval."""
    return registers.field_history(item_log(spark, sf))


AS_OF_US = 1705881600000000  # 2024-01-22


@query(
    "r12_as_of_state",
    with_parts(
        ["writes"],
        "SELECT entity_uuid, name AS field, written AS value, event_uuid FROM state",
        {
            "state": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_uuid, name
            ORDER BY {{desc}}) AS rn FROM writes WHERE hlc_us <= {AS_OF_US}) WHERE rn = 1"""
        },
    ),
)
def as_of_state(spark, sf):
    """Field state as of an instant."""
    log = registers.as_of(item_log(spark, sf), AS_OF_US)
    return registers.field_state(log).select("entity_uuid", "field", "value", "event_uuid")


@query(
    "c1_or_set",
    with_parts(
        ["log"],
        "SELECT entity_uuid, set_name, member, is_add AS active, event_uuid FROM set_state",
        SET_PARTS,
    ),
)
def or_set(spark, sf):
    """Observed-remove set state, tombstones kept, with the deciding event."""
    state = sets.or_set(sets.set_operations(item_log(spark, sf)))
    return state.select(
        "entity_uuid",
        "set_name",
        "member",
        "active",
        F.greatest("added", "removed")["event_uuid"].alias("event_uuid"),
    )


def set_query(where: str) -> str:
    return with_parts(["log"], f"SELECT entity_uuid, member FROM set_state WHERE is_add AND {where}", SET_PARTS)


@query("c2_labels", set_query("set_name = 'labels'"))
def labels(spark, sf):
    """Active labels."""
    log = item_log(spark, sf)
    ops = sets.set_operations(log.where(F.col("kind").isin("item.add-label", "item.remove-label")))
    return sets.active_members(sets.or_set(ops)).select("entity_uuid", "member")


@query(
    "c3_assignees",
    with_parts(
        ["log"],
        """SELECT entity_uuid, member, regexp_full_match(member, '(user|agent):.+') AS valid
        FROM set_state WHERE is_add AND set_name = 'assignees'""",
        SET_PARTS,
    ),
)
def assignees(spark, sf):
    """Active assignees, members that are no actor flagged."""
    return sets.assignees(sets.or_set(sets.set_operations(item_log(spark, sf))))


@query(
    "c4_member_lists",
    with_parts(
        ["log"],
        "SELECT entity_uuid, set_name, part, count(*) AS n, string_agg(member, ',' ORDER BY member) AS members FROM "
        + parted("set_state WHERE is_add", "entity_uuid, set_name", "member")
        + " GROUP BY entity_uuid, set_name, part",
        SET_PARTS,
    ),
)
def member_lists(spark, sf):
    """Sorted active members per set."""
    rows = sets.member_lists(sets.or_set(sets.set_operations(item_log(spark, sf))))
    return rows.select(
        "entity_uuid",
        "set_name",
        "part",
        F.size("members").cast("bigint").alias("n"),
        F.array_join("members", ",").alias("members"),
    )


@query(
    "c5_set_tombstones",
    with_parts(
        ["log"],
        "SELECT entity_uuid, set_name, member, event_uuid AS removed_by, hlc_us FROM set_state WHERE NOT is_add",
        SET_PARTS,
    ),
)
def set_tombstones(spark, sf):
    """Removed members with the remove stamp that later merges need."""
    rows = sets.tombstones(sets.or_set(sets.set_operations(item_log(spark, sf))))
    return rows.select(
        "entity_uuid", "set_name", "member", F.col("removed.event_uuid").alias("removed_by"), "removed.hlc_us"
    )


@query(
    "c6_counters",
    with_parts(
        ["changes"],
        """SELECT entity_uuid, field, CAST(sum(delta) AS BIGINT) AS total, count(*) AS adjustments FROM changes
        WHERE kind = 'item.adjust-field' GROUP BY entity_uuid, field""",
    ),
)
def counters(spark, sf):
    """Signed counters over a log in which some events were delivered twice."""
    return sets.counters(sets.adjustments(copies(spark, sf)))


@query(
    "c7_counter_guard",
    with_parts(
        ["log"],
        """SELECT c.event_uuid, c.entity_uuid, c.field, f.field_kind FROM changes c
        LEFT JOIN types t ON t.entity_uuid = c.entity_uuid
        LEFT JOIN schema_fields f ON f.project_uuid = c.project_uuid AND f.entity_kind = t.entity_kind
          AND f.item_type = t.item_type AND f.field = c.field
        WHERE c.kind = 'item.adjust-field' AND coalesce(f.field_kind <> 'counter', TRUE)""",
        {"types": TYPES, "schema_fields": catalog.SQL["schema_fields"]},
    ),
)
def counter_guard(spark, sf):
    """Adjustments of fields that are not declared as counters."""
    log = item_log(spark, sf)
    return sets.counter_guard(sets.adjustments(log), entity_types(log), catalog.schema_fields(spark))


@query(
    "c8_or_map",
    with_parts(
        ["changes"],
        """SELECT entity_uuid, field AS map_key, value, kind = 'item.clear-field' AS removed, event_uuid
        FROM (SELECT *, row_number() OVER (PARTITION BY entity_uuid, field ORDER BY {desc}) AS rn FROM changes
        WHERE kind IN ('item.set-field', 'item.clear-field')) WHERE rn = 1""",
    ),
)
def or_map(spark, sf):
    """Observed-remove map: last upsert or remove per key, tombstones kept."""
    ops = item_changes(table(spark, sf, "events")).where(
        F.col("kind").isin("item.set-field", "item.clear-field")
    )
    state = sets.or_map(
        ops.withColumnRenamed("field", "map_key"),
        ["entity_uuid", "map_key"],
        F.col("kind") == "item.clear-field",
    )
    return state.select("entity_uuid", "map_key", "value", "removed", "event_uuid")


@query(
    "c9_merge_states",
    with_parts(
        ["writes"],
        "SELECT entity_uuid, name AS field, written AS value, event_uuid FROM state",
        STATE_PARTS,
    ),
)
def merge_states(spark, sf):
    """State of one half of the log joined with the state of the other half."""
    writes = registers.field_writes(item_log(spark, sf))
    keys = ["entity_uuid", "field"]
    half = F.pmod(F.xxhash64("event_uuid"), F.lit(2)) == 0
    left = registers.lww(writes.where(half), keys, ["value"])
    right = registers.lww(writes.where(~half), keys, ["value"])
    return sets.merge_states(left, right, keys, ["value"]).select("entity_uuid", "field", "value", "event_uuid")
