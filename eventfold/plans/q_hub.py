"""Queries: hub log, cursors, snapshots, compaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from eventfold.operators import hub, sets, snapshots
from eventfold.operators.loops import cut
from eventfold.plans.adapters import item_changes, padded, table, tag, with_k, with_parts
from eventfold.plans.q_items import MEMBERS, SET_STATE
from eventfold.plans.registry import query
from eventfold.session import fresh_path


def stored_log(spark, sf):
    return item_changes(table(spark, sf, "events")).drop("fields")


def pushes(spark, sf):
    """Event rows as push requests with all the faults a hub meets."""
    i, k = F.col("event_id"), F.col("k")
    batch = F.floor(i / 40)
    rows = with_k(table(spark, sf, "events"))
    first = rows.withColumn("batch", batch).withColumn("line", i % 40)
    again = rows.where(k % 25 == 3).withColumn("batch", batch + 3).withColumn("line", i % 40 + 1000)
    b = F.col("batch")
    return first.unionByName(again).select(
        padded(i).alias("event_uuid"),
        "batch",
        "line",
        F.lit("W0").alias("workspace"),
        F.when(b % 50 == 49, F.lit("N7")).otherwise(tag("N", b % 3)).alias("author"),
        F.when(i % 97 == 0, F.lit("N9"))
        .when(batch % 50 == 49, F.lit("N7"))
        .otherwise(tag("N", batch % 3))
        .alias("node_uuid"),
        F.when(i % 89 == 0, F.lit("W9")).otherwise(F.lit("W0")).alias("workspace_uuid"),
        F.when(i % 401 == 0, F.lit("user:intruder")).otherwise(tag("user:u", F.col("user_id") % 7)).alias("actor"),
        tag("item:E", F.col("user_id")).alias("stream_id"),
        (i - F.when(k % 10 == 0, F.lit(700)).otherwise(F.lit(0))).alias("stream_seq"),
    )


def registry_tables(spark, sf):
    """Registered nodes and allowed actors, as the log itself names them."""
    log = stored_log(spark, sf)
    nodes = log.select(F.col("workspace_uuid").alias("workspace"), "node_uuid").distinct()
    return cut(nodes), cut(log.select("actor").distinct())


PUSHES = {
    "sent": """SELECT *, event_id // 40 AS batch, event_id % 40 AS line FROM ev
      UNION ALL SELECT *, event_id // 40 + 3, event_id % 40 + 1000 FROM ev WHERE k % 25 = 3""",
    "pushes": """SELECT lpad(CAST(event_id AS VARCHAR), 26, '0') AS event_uuid, batch, line, 'W0' AS workspace,
      CASE WHEN batch % 50 = 49 THEN 'N7' ELSE 'N' || (batch % 3) END AS author,
      CASE WHEN event_id % 97 = 0 THEN 'N9' WHEN event_id // 40 % 50 = 49 THEN 'N7'
        ELSE 'N' || (event_id // 40 % 3) END AS node_uuid,
      CASE WHEN event_id % 89 = 0 THEN 'W9' ELSE 'W0' END AS workspace_uuid,
      CASE WHEN event_id % 401 = 0 THEN 'user:intruder' ELSE 'user:u' || (user_id % 7) END AS actor,
      'item:E' || user_id AS stream_id, event_id - CASE WHEN k % 10 = 0 THEN 700 ELSE 0 END AS stream_seq FROM sent""",
    "line_checks": """SELECT *, CASE WHEN actor = 'user:intruder' THEN 'actor_not_allowed'
      WHEN author NOT IN ('N0', 'N1', 'N2') THEN 'node_not_registered'
      WHEN workspace_uuid <> workspace THEN 'workspace_mismatch' WHEN node_uuid <> author THEN 'node_mismatch'
      ELSE 'pass' END AS verdict FROM pushes""",
    "copies": """SELECT *, row_number() OVER (PARTITION BY event_uuid ORDER BY batch, line) AS copy_no
      FROM line_checks WHERE verdict = 'pass'""",
    "firsts": """SELECT *, CASE WHEN stream_seq <= max(stream_seq) OVER (PARTITION BY node_uuid, stream_id
      ORDER BY batch, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'regression' ELSE 'durable' END AS outcome
      FROM copies WHERE copy_no = 1""",
    "results": """SELECT event_uuid, batch, line, outcome FROM firsts UNION ALL SELECT c.event_uuid, c.batch, c.line,
      CASE f.outcome WHEN 'durable' THEN 'duplicate' ELSE 'regression' END FROM copies c
      JOIN firsts f ON f.event_uuid = c.event_uuid WHERE c.copy_no > 1""",
}


def push_results(spark, sf):
    checked = hub.admission(pushes(spark, sf), *registry_tables(spark, sf), per_line=True)
    return hub.sequence_checks(checked.where("verdict = 'pass'"))


@query(
    "h1_append_offsets",
    with_parts(
        ["ev"],
        """SELECT p.event_uuid, p.batch, p.line, coalesce(s.hub_offset, n.hub_offset) AS hub_offset,
          s.hub_offset IS NOT NULL OR p.copy_no > 1 AS duplicate FROM all_copies p
        LEFT JOIN old_log s ON s.event_uuid = p.event_uuid
        LEFT JOIN (SELECT event_uuid, (SELECT max(hub_offset) FROM old_log) + row_number() OVER (ORDER BY batch, line)
          AS hub_offset FROM all_copies WHERE copy_no = 1 AND event_uuid NOT IN (SELECT event_uuid FROM old_log)) n
          ON n.event_uuid = p.event_uuid""",
        {
            **PUSHES,
            "old_log": """SELECT lpad(CAST(event_id AS VARCHAR), 26, '0') AS event_uuid, event_id + 1 AS hub_offset
              FROM events WHERE event_type <> 'view'""",
            "all_copies": "SELECT *, row_number() OVER (PARTITION BY event_uuid ORDER BY batch, line) AS copy_no FROM pushes",
        },
    ),
)
def append_offsets(spark, sf):
    """Dense offsets for new events in arrival order, old offsets for copies."""
    stored = stored_log(spark, sf).where(F.col("kind") != "item.set-field")
    return hub.append(stored.select("event_uuid", "hub_offset"), pushes(spark, sf)).select(
        "event_uuid", "batch", "line", "hub_offset", "duplicate"
    )


@query(
    "h2_admission",
    with_parts(
        ["ev"],
        """SELECT event_uuid, batch, line, CASE WHEN refused THEN 'actor_not_allowed' WHEN author NOT IN ('N0', 'N1', 'N2')
          THEN 'node_not_registered' WHEN line > stop THEN 'not_processed' WHEN line = stop THEN own ELSE 'pass' END AS verdict
        FROM (SELECT *, bool_or(actor = 'user:intruder') OVER (PARTITION BY batch) AS refused,
            min(CASE WHEN own IS NOT NULL THEN line END) OVER (PARTITION BY batch) AS stop FROM (SELECT *,
            CASE WHEN workspace_uuid <> workspace THEN 'workspace_mismatch' WHEN node_uuid <> author THEN 'node_mismatch' END
            AS own FROM pushes))""",
        PUSHES,
    ),
)
def admission(spark, sf):
    """Whole-request checks, then the first bad row stops its batch."""
    return hub.admission(pushes(spark, sf), *registry_tables(spark, sf)).select("event_uuid", "batch", "line", "verdict")


@query("h3_sequence_checks", with_parts(["ev"], "SELECT * FROM results", PUSHES))
def sequence_checks(spark, sf):
    """Sequence per node and stream: durable, duplicate or regression per line."""
    return push_results(spark, sf).select("event_uuid", "batch", "line", "outcome")


# One batch of a node after the other: what is recorded so far decides where the next one stops.
CUTS = {
    "admitted": """SELECT *, lag(1) OVER (PARTITION BY batch, event_uuid ORDER BY line) IS NOT NULL AS again, max(stream_seq) OVER
        (PARTITION BY batch, node_uuid, stream_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM (SELECT *, bool_or(actor = 'user:intruder') OVER (PARTITION BY batch) AS refused, min(CASE WHEN workspace_uuid <> workspace
        OR node_uuid <> author THEN line END) OVER (PARTITION BY batch) AS halt FROM pushes)
      WHERE NOT refused AND author IN ('N0', 'N1', 'N2') AND (halt IS NULL OR line < halt)""",
    "requests": """SELECT author, batch, row_number() OVER (PARTITION BY author ORDER BY batch) AS n, list({'id': event_uuid, 'line': line,
        'stream': stream_id, 'seq': stream_seq, 'before': before, 'again': again} ORDER BY line) AS rs
      FROM admitted GROUP BY author, batch""",
    "taken": """WITH RECURSIVE f AS (
        SELECT DISTINCT author, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS batch,
          CAST([] AS STRUCT(id VARCHAR, stream VARCHAR, seq BIGINT)[]) AS known,
          CAST([] AS STRUCT(id VARCHAR, line BIGINT, outcome VARCHAR)[]) AS results FROM requests
        UNION ALL SELECT author, n, batch, list_concat(known, list_transform(list_filter(rs, lambda r: NOT r.again AND NOT r.had
            AND (stop IS NULL OR r.line < stop)), lambda r: {'id': r.id, 'stream': r.stream, 'seq': r.seq})),
          list_transform(rs, lambda r: {'id': r.id, 'line': r.line, 'outcome': CASE WHEN r.line > stop THEN 'not_processed'
            WHEN r.line = stop THEN 'regression' WHEN r.again OR r.had THEN 'duplicate' ELSE 'durable' END})
        FROM (SELECT *, list_min(list_transform(list_filter(rs, lambda r: NOT r.again AND NOT r.had
              AND r.seq <= greatest(coalesce(r.before, -1000000000000), coalesce(r.top, -1000000000000))), lambda r: r.line)) AS stop
          FROM (SELECT q.author, q.n, q.batch, f.known, list_transform(q.rs, lambda r: {'id': r.id, 'line': r.line, 'stream': r.stream,
              'seq': r.seq, 'before': r.before, 'again': r.again,
              'had': len(list_filter(f.known, lambda k: k.id = r.id)) > 0,
              'top': list_max(list_transform(list_filter(f.known, lambda k: k.stream = r.stream), lambda k: k.seq))}) AS rs
            FROM f JOIN requests q ON q.author = f.author AND q.n = f.n + 1))
      ) SELECT batch, unnest(results) AS r FROM f WHERE n > 0""",
}


@query(
    "h3_sequence_cuts",
    with_parts(["ev"], "SELECT r.id AS event_uuid, batch, r.line AS line, r.outcome AS outcome FROM taken", {**PUSHES, **CUTS}),
)
def sequence_cuts(spark, sf):
    """The same for whole-batch requests, where a regression drops the rest of its batch."""
    checked = hub.admission(pushes(spark, sf), *registry_tables(spark, sf))
    return hub.sequence_cuts(checked.where("verdict = 'pass'")).select("event_uuid", "batch", "line", "outcome")


@query(
    "h4_push_report",
    with_parts(
        ["ev"],
        """SELECT batch, count(*) AS sent, count(*) FILTER (outcome = 'durable') AS durable,
        count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (outcome = 'regression') AS refused
        FROM results GROUP BY batch""",
        PUSHES,
    ),
)
def push_report(spark, sf):
    """Acknowledgement counts per batch."""
    return hub.push_report(push_results(spark, sf))


@query(
    "h4_queue_rest",
    with_parts(
        ["ev"],
        """SELECT DISTINCT event_uuid FROM pushes WHERE event_uuid NOT IN
        (SELECT event_uuid FROM results WHERE outcome <> 'regression')""",
        PUSHES,
    ),
)
def queue_rest(spark, sf):
    """What stays in the outbound queue: events neither durable nor duplicate."""
    queue = pushes(spark, sf).select("event_uuid").distinct()
    return hub.queue_rest(queue, push_results(spark, sf))


SHARES = {"R0": 60, "R1": 70, "R2": 80, "R3": 90}


def full_reports(spark, sf):
    """Four reporters, each caught up to a share of the log, for every author."""
    stored = stored_log(spark, sf)
    top = stored.agg(F.max("hub_offset")).scalar()
    below = [
        F.struct(
            F.lit(r).alias("reporter"),
            F.max(F.when(F.col("hub_offset") * 100 <= top * share, F.col("hub_offset"))).alias("last_hub_offset"),
        )
        for r, share in SHARES.items()
    ]
    return (
        stored.groupBy(F.col("node_uuid").alias("author"))
        .agg(F.array(*below).alias("r"))
        .select("author", F.explode("r").alias("r"))
        .select("author", "r.reporter", "r.last_hub_offset")
    )


FULL = {
    "top": "SELECT max(hub_offset) AS top FROM changes",
    "full_reports": """SELECT node_uuid AS author, reporter, max(hub_offset) AS last_hub_offset
      FROM changes, top, (VALUES ('R0', 60), ('R1', 70), ('R2', 80), ('R3', 90)) r(reporter, share)
      WHERE hub_offset * 100 <= top * share GROUP BY node_uuid, reporter""",
    "reports": """SELECT 'W0' AS workspace_uuid, 'R' || user_id AS reporter, event_id AS report_id, us AS reported_us,
      'N' || j AS author, greatest(event_id - 10 * (j + 1) - k, 0) AS last_hub_offset
      FROM ev, (VALUES (0), (1), (2)) a(j) WHERE event_type = 'signup' AND k % 7 <> j""",
    "current_reports": """SELECT r.* FROM reports r JOIN (SELECT reporter, max((reported_us, report_id)) AS m FROM reports
      GROUP BY reporter) l ON l.reporter = r.reporter AND l.m = (r.reported_us, r.report_id)""",
}


def reports(spark, sf):
    """Cursor reports: one per signup row, with up to three author cursors."""
    i, k = F.col("event_id"), F.col("k")
    sets_ = F.array(
        *[
            F.struct(
                F.lit(j).alias("j"),
                F.lit(f"N{j}").alias("author"),
                F.greatest(i - 10 * (j + 1) - k, F.lit(0)).alias("last_hub_offset"),
            )
            for j in range(3)
        ]
    )
    return (
        with_k(table(spark, sf, "events"))
        .where("event_type = 'signup'")
        .select(
            F.lit("W0").alias("workspace_uuid"),
            tag("R", F.col("user_id")).alias("reporter"),
            i.alias("report_id"),
            F.col("us").alias("reported_us"),
            "k",
            F.explode(sets_).alias("c"),
        )
        .where("k % 7 <> c.j")
        .select(
            "workspace_uuid",
            "reporter",
            "report_id",
            "reported_us",
            "c.author",
            padded(F.col("c.last_hub_offset")).alias("last_event_uuid"),
            "c.last_hub_offset",
        )
    )


PAGE = {
    **FULL,
    "page": """SELECT c.* FROM changes c LEFT JOIN full_reports r ON r.author = c.node_uuid AND r.reporter = 'R1'
      WHERE c.workspace_uuid = 'W0' AND c.project_uuid IN ('P0', 'P1', 'P2') AND c.hub_offset > coalesce(r.last_hub_offset, 0)
      ORDER BY hub_offset LIMIT 500""",
}


def page_of(spark, sf):
    cursors = full_reports(spark, sf).where("reporter = 'R1'")
    return hub.pull_page(stored_log(spark, sf), cursors, "W0", 500, ["P0", "P1", "P2"])


@query(
    "h7_pull_page",
    with_parts(
        ["changes"],
        "SELECT event_uuid, node_uuid, hub_offset, (SELECT count(*) = 500 FROM page) AS has_more FROM page",
        PAGE,
    ),
)
def pull_page(spark, sf):
    """A page of 500 events of three projects above the cursors."""
    return page_of(spark, sf).select("event_uuid", "node_uuid", "hub_offset", "has_more")


@query(
    "h8_next_cursors",
    with_parts(
        ["changes"],
        """SELECT author, max(last_hub_offset) AS last_hub_offset, lpad(CAST(max(last_hub_offset) - 1 AS VARCHAR), 26, '0')
        AS last_event_uuid FROM (SELECT author, last_hub_offset FROM full_reports WHERE reporter = 'R1'
        UNION ALL SELECT node_uuid, hub_offset FROM page) GROUP BY author""",
        PAGE,
    ),
)
def next_cursors(spark, sf):
    """Cursors after the page."""
    known = full_reports(spark, sf).where("reporter = 'R1'").select(
        "author", padded(F.col("last_hub_offset") - 1).alias("last_event_uuid"), "last_hub_offset"
    )
    return hub.merge_cursors(known, hub.page_cursors(page_of(spark, sf)))


@query(
    "h10_merged_cursors",
    with_parts(
        ["ev"],
        """SELECT reporter, author, max(last_hub_offset) AS last_hub_offset,
        lpad(CAST(max(last_hub_offset) AS VARCHAR), 26, '0') AS last_event_uuid FROM reports GROUP BY reporter, author""",
        FULL,
    ).replace("top AS (SELECT max(hub_offset) AS top FROM changes),", "changes AS (SELECT 'N0' AS node_uuid, 1 AS hub_offset), top AS (SELECT max(hub_offset) AS top FROM changes),"),
)
def merged_cursors(spark, sf):
    """Cursor sets of all reports of a replica merged: newest offset per author."""
    rows = reports(spark, sf).select("reporter", "author", "last_event_uuid", "last_hub_offset")
    even = F.pmod(F.col("last_hub_offset"), F.lit(2)) == 0
    return hub.merge_cursors(rows.where(even), rows.where(~even), ["reporter", "author"])


@query(
    "h11_current_reports",
    with_parts(["changes"], "SELECT reporter, report_id, author, last_hub_offset FROM current_reports", FULL),
)
def current_reports(spark, sf):
    """Cursor set of the last report of each replica."""
    return hub.current_reports(reports(spark, sf)).select("reporter", "report_id", "author", "last_hub_offset")


@query(
    "h12_replica_lag",
    with_parts(
        ["changes"],
        """SELECT 'W0' AS workspace_uuid, p.reporter, h.author, high, coalesce(c.last_hub_offset, 0) AS cursor,
          high - coalesce(c.last_hub_offset, 0) AS lag FROM (SELECT DISTINCT reporter FROM reports) p,
          (SELECT node_uuid AS author, max(hub_offset) AS high FROM changes GROUP BY node_uuid) h
        LEFT JOIN current_reports c ON c.reporter = p.reporter AND c.author = h.author""",
        FULL,
    ),
)
def replica_lag(spark, sf):
    """How far each replica is behind each author."""
    return hub.pair_lag(stored_log(spark, sf), hub.current_reports(reports(spark, sf)))


@query(
    "h14_local_states",
    with_parts(
        ["changes"],
        """SELECT event_uuid, CASE WHEN kind = 'item.set-state' THEN 'conflicted' WHEN schema_version > 1 THEN 'quarantined'
        WHEN kind <> 'item.archive' THEN 'reduced' WHEN hlc_seq = 0 THEN 'persisted' ELSE 'fetched' END AS status FROM changes""",
    ),
)
def local_states(spark, sf):
    """Furthest local state of every event over five ledgers."""
    log = stored_log(spark, sf)
    return hub.local_states(
        {
            "fetched": log,
            "persisted": log.where("hlc_seq = 0"),
            "reduced": log.where("kind <> 'item.archive'"),
            "quarantined": log.where("schema_version > 1"),
            "conflicted": log.where("kind = 'item.set-state'"),
        }
    )


def boundary(log):
    """Six tenths of the log's highest offset."""
    return F.floor(log.agg(F.max("hub_offset")).scalar() * 6 / 10)


@query(
    "k1_boundary_cursors",
    with_parts(
        ["changes"],
        """SELECT project_uuid, author, last_hub_offset, lpad(CAST(last_hub_offset - 1 AS VARCHAR), 26, '0')
        AS last_event_uuid FROM (SELECT 'all' AS project_uuid, node_uuid AS author, max(hub_offset) AS last_hub_offset
          FROM changes WHERE hub_offset <= (SELECT max(hub_offset) FROM changes) * 6 // 10 GROUP BY node_uuid
        UNION ALL SELECT 'P2', node_uuid, max(hub_offset) FROM changes WHERE project_uuid = 'P2'
          AND hub_offset <= (SELECT max(hub_offset) FROM changes) * 6 // 10 GROUP BY node_uuid)""",
    ),
)
def boundary_cursors(spark, sf):
    """Per author the last event below a snapshot boundary, for all and for one project."""
    log = stored_log(spark, sf)
    at = boundary(log)
    everything = snapshots.boundary_cursors(log, at).withColumn("project_uuid", F.lit("all"))
    return everything.unionByName(
        snapshots.boundary_cursors(log, at, "P2").withColumn("project_uuid", F.lit("P2"))
    )


def split_log(spark, sf):
    log = item_changes(table(spark, sf, "events"))
    at = boundary(log)
    return log.where(F.col("hub_offset") <= at), log.where(F.col("hub_offset") > at)


STATE_ROWS = """SELECT 'fields' AS section, entity_uuid, field AS name, value FROM (SELECT *, row_number() OVER
      (PARTITION BY entity_uuid, field ORDER BY {desc}) AS rn FROM {log} WHERE kind IN ('item.set-field', 'item.clear-field')) WHERE rn = 1
  UNION ALL SELECT 'sets', entity_uuid, set_name || '/' || member, CASE WHEN is_add THEN 'in' ELSE 'out' END FROM set_state
  UNION ALL SELECT 'counters', entity_uuid, field, CAST(sum(delta) AS VARCHAR) FROM {log}
    WHERE kind = 'item.adjust-field' GROUP BY entity_uuid, field
  UNION ALL SELECT 'states', entity_uuid, 'state', state_key FROM (SELECT *, row_number() OVER
      (PARTITION BY entity_uuid ORDER BY {desc}) AS rn FROM {log} WHERE kind = 'item.set-state') WHERE rn = 1
  UNION ALL SELECT 'archived', entity_uuid, 'archived', CAST(kind = 'item.archive' AS VARCHAR) FROM (SELECT *,
      row_number() OVER (PARTITION BY entity_uuid ORDER BY {desc}) AS rn FROM {log}
      WHERE kind IN ('item.archive', 'item.restore')) WHERE rn = 1"""


def state_rows(state):
    """The tables of a state as one tall table of text values."""

    def part(section, name, value):
        return state[section].select(
            F.lit(section).alias("section"), "entity_uuid", name.alias("name"), value.cast("string").alias("value")
        )

    parts = [
        part("fields", F.col("field"), F.col("value")),
        part("sets", F.concat_ws("/", "set_name", "member"), F.when(F.col("active"), F.lit("in")).otherwise(F.lit("out"))),
        part("counters", F.col("field"), F.col("total")),
        part("states", F.lit("state"), F.col("state_key")),
        part("archived", F.lit("archived"), F.col("archived")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


BELOW = {
    "below": "SELECT * FROM changes WHERE hub_offset <= (SELECT max(hub_offset) FROM changes) * 6 // 10",
    "members": MEMBERS.replace("FROM log", "FROM below"),
    "set_state": SET_STATE,
}


@query(
    "k2_snapshot",
    with_parts(
        ["changes"],
        "SELECT section, count(*) AS rows FROM (" + STATE_ROWS.replace("{log}", "below") + ") GROUP BY section",
        BELOW,
    ),
)
def snapshot(spark, sf):
    """State at the boundary written as a snapshot and counted from the files."""
    head, _ = split_log(spark, sf)
    state = snapshots.take(head)
    path = fresh_path(spark, "snapshot")
    snapshots.write(state, path)
    rows = state_rows(snapshots.read(spark, path, list(state)))
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "k3_bootstrap",
    with_parts(
        ["changes"],
        STATE_ROWS.replace("{log}", "changes"),
        {"members": MEMBERS.replace("FROM log", "FROM changes"), "set_state": SET_STATE},
    ),
)
def bootstrap(spark, sf):
    """Snapshot read back plus the tail after it: equal to a full reduction."""
    head, tail = split_log(spark, sf)
    state = snapshots.take(head)
    path = fresh_path(spark, "snapshot")
    snapshots.write(state, path)
    return state_rows(snapshots.resume(snapshots.read(spark, path, list(state)), tail))


def snapshot_catalog(spark, sf):
    """Published snapshots: one per archive event."""
    rows = stored_log(spark, sf).where("kind = 'item.archive'")
    return rows.select(
        "project_uuid",
        (F.col("hub_offset") - F.col("schema_version") * 50).alias("through_offset"),
        F.concat(F.lit("snap-"), "event_uuid").alias("snapshot_id"),
    )


PUBLISHED = {
    "published": """SELECT project_uuid, hub_offset - schema_version * 50 AS through_offset, 'snap-' || event_uuid
      AS snapshot_id FROM changes WHERE kind = 'item.archive'"""
}


@query(
    "k4_latest_snapshot",
    with_parts(
        ["changes"],
        """SELECT project_uuid, through_offset, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY project_uuid
        ORDER BY through_offset DESC, snapshot_id DESC) AS rn FROM published) WHERE rn = 1""",
        PUBLISHED,
    ),
)
def latest_snapshot(spark, sf):
    """Snapshot with the highest boundary of each project."""
    return snapshots.latest(snapshot_catalog(spark, sf))


def mark_sql(reports: str) -> str:
    return f"""(SELECT coalesce(max(hub_offset), 0) FROM changes WHERE hub_offset < coalesce((SELECT min(c.hub_offset)
      FROM changes c JOIN (SELECT a.author, min(coalesce(r.last_hub_offset, 0)) AS m FROM
        (SELECT DISTINCT node_uuid AS author FROM changes) a CROSS JOIN (SELECT DISTINCT reporter FROM {reports}) p
        LEFT JOIN {reports} r ON r.author = a.author AND r.reporter = p.reporter GROUP BY a.author) m
      ON m.author = c.node_uuid WHERE c.hub_offset > m.m), 9223372036854775807))"""


@query(
    "k5_watermark",
    with_parts(
        ["changes"],
        f"""SELECT 'complete' AS variant, {mark_sql('full_reports')} AS watermark
        UNION ALL SELECT 'gaps', {mark_sql('current_reports')}""",
        FULL,
    ),
)
def watermark(spark, sf):
    """Compaction watermark for complete cursor sets and for ones with gaps."""
    stored = stored_log(spark, sf)
    # Reports are small stored tables on a hub; here they are derived, so written once.
    one = lambda name, r: snapshots.watermark(stored, r).select(F.lit(name).alias("variant"), "watermark")
    return one("complete", cut(full_reports(spark, sf))).unionByName(
        one("gaps", cut(hub.current_reports(reports(spark, sf))))
    )


@query(
    "k6_compaction",
    with_parts(
        ["changes"],
        f"""SELECT request, through, decision, CASE decision WHEN 'compact' THEN (SELECT count(*) FROM changes
          WHERE hub_offset <= through) ELSE 0 END AS dropped FROM (SELECT request, through, CASE WHEN through
          > {mark_sql('full_reports')} THEN 'above_watermark' WHEN EXISTS (SELECT 1 FROM oldest
          WHERE first <= through AND kept < through) THEN 'no_snapshot' ELSE 'compact' END AS decision FROM (SELECT 'tenth' AS request, top // 10 AS through FROM top
          UNION ALL SELECT 'half', top * 5 // 10 FROM top UNION ALL SELECT 'most', top * 9 // 10 FROM top))""",
        {
            **FULL,
            **PUBLISHED,
            "oldest": """SELECT first, coalesce(kept, 0) AS kept FROM (SELECT project_uuid, min(hub_offset) AS first
              FROM changes GROUP BY project_uuid) c LEFT JOIN (SELECT project_uuid, max(through_offset) AS kept
              FROM published GROUP BY project_uuid) p ON p.project_uuid = c.project_uuid""",
        },
    ),
)
def compaction(spark, sf):
    """Guarded prefix compaction: decision and dropped rows for three bounds."""
    stored = stored_log(spark, sf)
    top = stored.agg(F.max("hub_offset")).scalar()
    return snapshots.compaction_decisions(
        stored,
        {"tenth": F.floor(top / 10), "half": F.floor(top * 5 / 10), "most": F.floor(top * 9 / 10)},
        snapshots.watermark(stored, cut(full_reports(spark, sf))),
        cut(snapshots.latest(snapshot_catalog(spark, sf))),
    )


NOW_US = 1708041600000000  # 2024-02-16


@query(
    "k8_active_replicas",
    with_parts(
        ["changes"],
        f"""SELECT DISTINCT reporter, reported_us FROM current_reports
        WHERE reported_us >= {NOW_US} - 18 * 86400000000""",
        FULL,
    ),
)
def active_replicas(spark, sf):
    """Replicas that reported in the last 18 days and so still hold the watermark."""
    rows = snapshots.active_reports(hub.current_reports(reports(spark, sf)), NOW_US, 18)
    return rows.select("reporter", "reported_us").distinct()


@query(
    "k9_tombstones_kept",
    with_parts(
        ["changes"],
        "SELECT count(*) AS tombstones, CAST(0 AS BIGINT) AS lost FROM set_state WHERE NOT is_add",
        {"members": MEMBERS.replace("FROM log", "FROM changes"), "set_state": SET_STATE},
    ),
)
def tombstones_kept(spark, sf):
    """Every removed member is in the snapshot or in the tail: none is lost."""
    head, tail = split_log(spark, sf)
    log = item_changes(table(spark, sf, "events"))
    full = sets.or_set(sets.set_operations(log))
    lost = snapshots.lost_tombstones(full, sets.or_set(sets.set_operations(head)), tail)
    return sets.tombstones(full).agg(F.count(F.lit(1)).alias("tombstones")).withColumn(
        "lost", lost.agg(F.count(F.lit(1))).scalar()
    )
