"""Queries: lists, ready work, progress, references, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.operators import edges, index, leases, loops, registers, sets, threads
from eventfold.plans import catalog
from eventfold.plans.adapters import (
    claim_log,
    edge_log,
    item_changes,
    item_log,
    order_edges,
    order_items,
    parted,
    table,
    tag,
    talk_log,
    text,
    with_k,
    with_parts,
)
from eventfold.plans.q_edges import LIVE
from eventfold.plans.q_items import AS_OF_US, FIELD_STATE, HEADERS, MEMBERS, SET_STATE
from eventfold.plans.q_schema import MOVES, dated_changes
from eventfold.plans.q_talks import AT_US, TALK, TURNS
from eventfold.plans.registry import query

GROUPS = {"groups": catalog.SQL["groups"]}


@query(
    "q1_item_list",
    with_parts(
        ["log", "claims"],
        f"""SELECT entity_uuid, project_uuid, state_key FROM headers h WHERE NOT archived AND entity_uuid IN
          (SELECT entity_uuid FROM set_state WHERE is_add AND set_name = 'labels' AND member = 'l1')
        AND entity_uuid NOT IN (SELECT entity_uuid FROM episodes WHERE start_us <= {AT_US} AND {AT_US} < end_us)""",
        {**TURNS, "headers": HEADERS, "members": MEMBERS, "set_state": SET_STATE},
    ),
)
def item_list(spark, sf):
    """Items with a label that are not archived and that nobody holds."""
    log = item_log(spark, sf)
    members = sets.active_members(sets.or_set(sets.set_operations(log)))
    claims = leases.active_claims(leases.episodes(claim_log(spark, sf)), AT_US)
    rows = index.item_list(registers.headers(log), members, claims, label="l1", unclaimed=True)
    return rows.select("entity_uuid", "project_uuid", "state_key")


READY = {
    **GROUPS,
    "blockers": """SELECT l.to_uuid AS entity_uuid, l.from_uuid AS blocker FROM links l WHERE relation_kind = 'blocks' AND EXISTS (SELECT 1 FROM items i
      LEFT JOIN groups g ON g.state_key = i.state_key WHERE i.entity_uuid = l.from_uuid
        AND coalesce(g.state_group, 'none') <> 'completed')""",
    "todo": """SELECT i.* FROM items i JOIN groups g ON g.state_key = i.state_key WHERE g.state_group = 'unstarted'""",
}


@query(
    "q2_ready_work",
    with_parts(
        ["items", "links"],
        """SELECT entity_uuid, project_uuid, priority FROM todo WHERE entity_uuid NOT IN (SELECT entity_uuid FROM blockers)""",
        READY,
    ),
)
def ready_work(spark, sf):
    """Unstarted items that no unfinished item blocks."""
    rows = index.ready_work(order_items(spark, sf), order_edges(spark, sf), catalog.groups(spark))
    return rows.select("entity_uuid", "project_uuid", "priority")


@query(
    "q3_blocked_work",
    with_parts(
        ["items", "links"],
        "SELECT entity_uuid, part, count(*) AS n, string_agg(blocker, ',' ORDER BY blocker) AS blockers FROM "
        + parted("blockers WHERE entity_uuid IN (SELECT entity_uuid FROM todo)", "entity_uuid", "blocker")
        + " GROUP BY entity_uuid, part",
        READY,
    ),
)
def blocked_work(spark, sf):
    """Blocked unstarted items with their blockers."""
    rows = index.blocked_work(order_items(spark, sf), order_edges(spark, sf), catalog.groups(spark))
    return rows.select(
        "entity_uuid", "part", F.size("blockers").cast("bigint").alias("n"), F.array_join("blockers", ",").alias("blockers")
    )


@query(
    "q4_inverse_edges",
    with_parts(
        ["edges", "items"],
        """SELECT to_uuid AS entity_uuid, CASE relation_kind WHEN 'parent' THEN 'child' WHEN 'blocks' THEN 'blocked_by'
          WHEN 'requires' THEN 'required_by' WHEN 'extends' THEN 'extended_by' ELSE 'duplicated_by' END AS relation,
          from_uuid AS peer_uuid, i.state_key AS peer_state FROM live LEFT JOIN items i ON i.entity_uuid = from_uuid""",
        LIVE,
    ),
)
def inverse_edges(spark, sf):
    """Children and other edges seen from their target."""
    live = edges.live(edges.relations(edge_log(spark, sf)))
    return index.inverse_edges(live, order_items(spark, sf)).select("entity_uuid", "relation", "peer_uuid", "peer_state")


@query(
    "q5_duplicate_clusters",
    with_parts(
        ["edges", "items"],
        """SELECT lab AS cluster, count(*) AS members, count(i.entity_uuid) AS completed,
        count(i.entity_uuid) <= 1 AS allowed FROM cc LEFT JOIN items i ON i.entity_uuid = cc.id AND i.state_key = 'Done'
        GROUP BY lab""",
        {
            **LIVE,
            "pairs": """SELECT from_uuid AS a, to_uuid AS b FROM live WHERE relation_kind = 'duplicates'
              UNION SELECT to_uuid, from_uuid FROM live WHERE relation_kind = 'duplicates'""",
            "cc": """SELECT a AS id, min(least(a, b)) AS lab FROM pairs GROUP BY a UNION
              SELECT p.a, min(w.lab) FROM cc w JOIN pairs p ON p.b = w.id JOIN recurring.cc c ON c.id = p.a
              WHERE w.lab < c.lab GROUP BY p.a""",
        },
    )
    .replace("WITH ", "WITH RECURSIVE ", 1)
    .replace("cc AS (", "cc(id, lab) USING KEY (id) AS ("),
)
def duplicate_clusters(spark, sf):
    """Clusters of duplicates and whether at most one member is completed."""
    live = edges.live(edges.relations(edge_log(spark, sf)))
    return index.duplicate_clusters(live, order_items(spark, sf), catalog.groups(spark))


@query(
    "q6_effort_progress",
    with_parts(
        ["items"],
        "SELECT effort_uuid, count(*) AS items, "
        + ", ".join(f"count(*) FILTER (state_group = '{g}') AS {g}" for g in index.GROUPS)
        + """, round(count(*) FILTER (state_group = 'completed') / count(*), 6) AS done_share
        FROM items LEFT JOIN groups g ON g.state_key = items.state_key GROUP BY effort_uuid""",
        GROUPS,
    ),
)
def effort_progress(spark, sf):
    """State groups and completed share of each effort."""
    return index.effort_progress(order_items(spark, sf), catalog.groups(spark))


SPANS = {
    **MOVES,
    "spans": """SELECT m.*, g.state_group, lead(at_us) OVER w AS next_us, lag(g.state_group) OVER w AS prev_group,
      row_number() OVER (PARTITION BY entity_uuid ORDER BY at_us DESC, event_uuid DESC) AS back
      FROM moves m LEFT JOIN groups g ON g.state_key = m.state_key
      WINDOW w AS (PARTITION BY entity_uuid ORDER BY at_us, event_uuid)""",
}


@query(
    "q7_burndown",
    with_parts(
        ["changes"],
        """SELECT CAST(CAST(make_timestamp(day * 86400000000) AS DATE) AS VARCHAR) AS day, g.state_group,
          count(s.entity_uuid) AS items FROM (SELECT unnest(range((SELECT min(at_us) // 86400000000 FROM moves),
            (SELECT max(at_us) // 86400000000 + 1 FROM moves))) AS day) d CROSS JOIN (SELECT DISTINCT state_group FROM groups) g
        LEFT JOIN spans s ON s.state_group = g.state_group AND s.at_us < (day + 1) * 86400000000
          AND (s.next_us IS NULL OR s.next_us >= (day + 1) * 86400000000) GROUP BY day, g.state_group""",
        SPANS,
    ),
)
def burndown(spark, sf):
    """Items per state group at the end of each day."""
    return index.burndown(dated_changes(spark, sf), catalog.groups(spark))


@query(
    "q8_completed_at",
    with_parts(
        ["changes"],
        """SELECT l.entity_uuid, l.state_key, max(s.at_us) AS completed_us FROM spans l JOIN spans s
          ON s.entity_uuid = l.entity_uuid AND s.state_group IN ('completed', 'cancelled')
          AND coalesce(s.prev_group, 'none') NOT IN ('completed', 'cancelled')
        WHERE l.back = 1 AND l.state_group IN ('completed', 'cancelled') GROUP BY l.entity_uuid, l.state_key""",
        SPANS,
    ),
)
def completed_at(spark, sf):
    """When each closed item was closed."""
    return index.completed_at(dated_changes(spark, sf), catalog.groups(spark))


@query(
    "q9_cycle_times",
    with_parts(
        ["changes"],
        """SELECT state_key, count(*) AS stays, CAST(sum(next_us - at_us) AS BIGINT) AS total_us,
        max(next_us - at_us) AS longest_us, quantile_disc(next_us - at_us, 0.5) AS median_us FROM spans WHERE next_us IS NOT NULL GROUP BY state_key""",
        SPANS,
    ),
)
def cycle_times(spark, sf):
    """Time in each state over finished stays."""
    return index.cycle_times(dated_changes(spark, sf))


@query(
    "q10_attention_queue",
    with_parts(
        ["log", "talks"],
        """SELECT coalesce(w.entity_uuid, q.entity_uuid) AS entity_uuid, comment_uuid, directed_at, CASE WHEN w.entity_uuid
          IS NULL THEN 'question' WHEN comment_uuid IS NULL THEN 'state' ELSE 'both' END AS reason
        FROM (SELECT entity_uuid FROM headers WHERE state_key = 'Needs Input') w
        FULL JOIN (SELECT replace(entity_uuid, 'V', 'E') AS entity_uuid, comment_uuid, directed_at FROM visible
          WHERE comment_kind = 'needs_input') q ON q.entity_uuid = w.entity_uuid""",
        {**TALK, "headers": HEADERS},
    ),
)
def attention_queue(spark, sf):
    """Items that wait for a person, by state or by an open question."""
    asked = threads.open_questions(threads.comments(talk_log(spark, sf)))
    asked = asked.withColumn("entity_uuid", F.translate("entity_uuid", "V", "E"))
    return index.attention_queue(registers.headers(item_log(spark, sf)), asked)


def numbered_items(spark, sf):
    """Orders with ULID-shaped ids; every third one has a number already."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lpad(text(o), 10, "0"), F.lpad(text(c), 16, "0")).alias("entity_uuid"),
        tag("P", c % 5).alias("project_uuid"),
        tag("KEY", c % 5).alias("key"),
        F.when(o % 3 == 0, F.floor(o / 3) + 1).alias("number"),
    )


NUMBERED = {
    "unnumbered": """SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || lpad(CAST(o_custkey AS VARCHAR), 16, '0') AS entity_uuid,
      'P' || (o_custkey % 5) AS project_uuid, 'KEY' || (o_custkey % 5) AS key,
      CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 3 + 1 END AS number FROM orders""",
    "numbered": """SELECT entity_uuid, project_uuid, coalesce(number, (SELECT max(number) FROM unnumbered t
        WHERE t.project_uuid = u.project_uuid) + row_number() OVER (PARTITION BY project_uuid, number IS NULL
        ORDER BY entity_uuid)) AS number, key FROM unnumbered u""",
    "named": "SELECT *, key || '-' || number AS identifier FROM numbered",
}


@query(
    "q11_references",
    with_parts(
        [],
        """SELECT ref_id, ref, form, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN id END AS entity_uuid FROM refs
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY r ORDER BY rank) AS best FROM (
            SELECT r.ref AS r, 1 AS rank, 'id' AS form, 1 AS n, entity_uuid AS id FROM (SELECT DISTINCT ref FROM refs) r
              JOIN named ON entity_uuid = r.ref
            UNION ALL SELECT r.ref, 2, 'prefix', count(*), min(entity_uuid) FROM (SELECT DISTINCT ref FROM refs) r
              JOIN named ON entity_uuid[1:length(r.ref)] = r.ref AND length(r.ref) < 26 GROUP BY r.ref
            UNION ALL SELECT r.ref, 3, 'urn', 1, entity_uuid FROM (SELECT DISTINCT ref FROM refs) r
              JOIN named ON 'work:issue:' || entity_uuid = r.ref
            UNION ALL SELECT r.ref, 4, 'identifier', count(*), min(entity_uuid) FROM (SELECT DISTINCT ref FROM refs) r
              JOIN named ON identifier = r.ref GROUP BY r.ref)) f ON f.r = refs.ref AND f.best = 1""",
        {
            **NUMBERED,
            "refs": """SELECT c_custkey AS ref_id, CASE c_custkey % 5 WHEN 0 THEN o.entity_uuid
                WHEN 1 THEN o.entity_uuid[1:8 + c_custkey % 7] WHEN 2 THEN 'work:issue:' || o.entity_uuid
                WHEN 3 THEN 'KEY' || (c_custkey % 6) || '-' || (c_custkey % 977) ELSE 'nothing-' || c_custkey END AS ref
              FROM customer JOIN unnumbered o ON CAST(o.entity_uuid[1:10] AS BIGINT) = c_custkey""",
        },
    ),
)
def references(spark, sf):
    """References in four forms resolved to items; ambiguous ones stay open."""
    items = index.allocate_numbers(numbered_items(spark, sf))
    c, u = F.col("c_custkey"), F.col("entity_uuid")
    ids = numbered_items(spark, sf).withColumn("c_custkey", F.substring("entity_uuid", 1, 10).cast("bigint"))
    ref = (
        F.when(c % 5 == 0, u)
        .when(c % 5 == 1, F.substring(u, F.lit(1), (c % 7 + 8).cast("int")))
        .when(c % 5 == 2, F.concat(F.lit("work:issue:"), u))
        .when(c % 5 == 3, F.concat(F.lit("KEY"), text(c % 6), F.lit("-"), text(c % 977)))
        .otherwise(tag("nothing-", c))
    )
    refs = table(spark, sf, "customer").select("c_custkey").join(ids, "c_custkey").select(
        F.col("c_custkey").alias("ref_id"), ref.alias("ref")
    )
    return index.resolve_references(refs, items)


@query("q12_numbers", with_parts([], "SELECT entity_uuid, project_uuid, number, identifier FROM named", NUMBERED))
def numbers(spark, sf):
    """Dense numbers per project for items that had none, given ones kept."""
    return index.allocate_numbers(numbered_items(spark, sf)).select("entity_uuid", "project_uuid", "number", "identifier")


@query(
    "q14_dependency_layers",
    """WITH RECURSIVE needs AS (SELECT p_partkey AS node, p_partkey // 2 AS need FROM part WHERE p_partkey > 1
        UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2),
      walk(node, layer) AS (SELECT p_partkey, 1 FROM part WHERE p_partkey = 1
        UNION SELECT n.node, w.layer + 1 FROM walk w JOIN needs n ON n.need = w.node)
      SELECT 'P' || node AS node, CAST(max(layer) AS BIGINT) AS layer FROM walk GROUP BY node""",
)
def dependency_layers(spark, sf):
    """Layers of the dependency graph of components."""
    p = F.col("p_partkey")
    parts = table(spark, sf, "part")
    half = parts.where(p > 1).select(tag("P", p).alias("node"), tag("P", F.floor(p / 2)).alias("needs"))
    third = parts.where(p > 2).select(tag("P", p).alias("node"), tag("P", F.floor(p / 3)).alias("needs"))
    return loops.layers(half.unionByName(third))


@query(
    "q15_state_diff",
    with_parts(
        ["writes"],
        """SELECT coalesce(a.entity_uuid, b.entity_uuid) AS entity_uuid, coalesce(a.name, b.name) AS field,
          a.written AS left_value, b.written AS right_value, CASE WHEN a.entity_uuid IS NULL THEN 'right_only'
          WHEN b.entity_uuid IS NULL THEN 'left_only' ELSE 'differs' END AS difference
        FROM state a FULL JOIN old_state b ON b.entity_uuid = a.entity_uuid AND b.name = a.name
        WHERE a.entity_uuid IS NULL OR b.entity_uuid IS NULL OR a.written IS DISTINCT FROM b.written""",
        {
            "state": FIELD_STATE,
            "old_state": FIELD_STATE.replace("FROM writes", f"FROM writes WHERE hlc_us <= {AS_OF_US}"),
        },
    ),
)
def state_diff(spark, sf):
    """Fields that differ between two replicas, one of them behind."""
    log = item_log(spark, sf)
    now, then = registers.field_state(log), registers.field_state(registers.as_of(log, AS_OF_US))
    return index.state_diff(now, then, ["entity_uuid", "field"], "value")


@query(
    "q16_activity",
    with_parts(
        ["changes"],
        """SELECT actor, node_uuid, kind, day, count(*) AS events, CAST(grouping_id(actor, node_uuid, kind, day) AS BIGINT) AS level
        FROM (SELECT c.*, CAST(CAST(make_timestamp(e.us) AS DATE) AS VARCHAR) AS day FROM changes c
          JOIN ev e ON e.event_id = c.stream_seq) GROUP BY ROLLUP (actor, node_uuid, kind, day)""",
    ),
)
def activity(spark, sf):
    """Events per actor, node, kind and day with subtotals."""
    log = item_changes(table(spark, sf, "events"))
    day = F.to_date(F.timestamp_micros("us")).cast("string")
    days = with_k(table(spark, sf, "events")).select(F.col("event_id").alias("stream_seq"), day.alias("day"))
    return index.activity(log.join(days, "stream_seq"), ["actor", "node_uuid", "kind", "day"])


TODAY_US = 852076800000000  # 1997-01-01


@query(
    "q17_effort_status",
    with_parts(
        ["items"],
        f"""SELECT effort_uuid, start_us, end_us, CASE WHEN all_done THEN 'completed' WHEN start_us > {TODAY_US} THEN 'planned'
          WHEN end_us < {TODAY_US} THEN 'completed' ELSE 'active' END AS status FROM (SELECT effort_uuid,
          min(created_us) AS start_us, max(created_us) AS end_us, bool_and(state_key = 'Done') AS all_done
          FROM items GROUP BY effort_uuid)""",
    ),
)
def effort_status(spark, sf):
    """Planned, active or completed efforts by date; all work done overrides."""
    efforts = order_items(spark, sf).groupBy("effort_uuid").agg(
        F.min("created_us").alias("start_us"),
        F.max("created_us").alias("end_us"),
        F.when(F.bool_and(F.col("state_key") == "Done"), F.lit("completed")).alias("given_status"),
    )
    return index.effort_status(efforts, TODAY_US).drop("given_status")
