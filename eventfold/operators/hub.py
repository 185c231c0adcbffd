"""The hub log: admission, append with offsets, pages, cursors.

Incoming rows carry ``batch`` and ``line`` (arrival order), the ``author`` node and
``workspace`` of the request, and the event columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.operators.loops import cut
from eventfold.operators.skew import max_before, ordered, position


def arrival() -> list[Column]:
    return [F.col("batch"), F.col("line")]


def before_first_bad(rows: DataFrame, bad: Column) -> DataFrame:
    """Rows of each batch with ``first_bad``: the line of its first bad row or NULL.

    One value per batch is found with partial aggregation and joined back; adaptive
    execution splits a very large batch in the join.
    """
    first = rows.groupBy("batch").agg(F.min(F.when(bad, F.col("line"))).alias("first_bad"))
    return rows.join(first, ["batch"], "left")


def admission(
    rows: DataFrame, registry: DataFrame, allowed: DataFrame, per_line: bool = False
) -> DataFrame:
    """Checks of a push before the log is touched; adds ``verdict``.

    A batch with an actor outside the allow-list, or of an unregistered author, is
    refused whole. Then the first row of a foreign workspace or author stops its
    batch: earlier rows pass, later ones are not processed. With ``per_line`` every
    row is a request by itself.
    """
    known = registry.select("workspace", F.col("node_uuid").alias("author")).distinct()
    listed = allowed.select("actor").distinct()
    rows = rows.join(known.withColumn("__node", F.lit(True)), ["workspace", "author"], "left")
    rows = rows.join(listed.withColumn("__actor", F.lit(True)), "actor", "left")
    own = (
        F.when(F.col("workspace_uuid") != F.col("workspace"), F.lit("workspace_mismatch"))
        .when(F.col("node_uuid") != F.col("author"), F.lit("node_mismatch"))
    )
    rows = rows.withColumn("__own", own)
    no_actor, no_node = F.col("__actor").isNull(), F.col("__node").isNull()
    if per_line:
        verdict = (
            F.when(no_actor, F.lit("actor_not_allowed"))
            .when(no_node, F.lit("node_not_registered"))
            .otherwise(F.coalesce("__own", F.lit("pass")))
        )
        return rows.withColumn("verdict", verdict).drop("__own", "__actor", "__node")
    whole = rows.groupBy("batch").agg(
        F.max(no_actor).alias("__refused"),
        F.max(no_node).alias("__unknown"),
        F.min(F.when(F.col("__own").isNotNull(), F.col("line"))).alias("__stop"),
    )
    verdict = (
        F.when(F.col("__refused"), F.lit("actor_not_allowed"))
        .when(F.col("__unknown"), F.lit("node_not_registered"))
        .when(F.col("line") > F.col("__stop"), F.lit("not_processed"))
        .otherwise(F.coalesce("__own", F.lit("pass")))
    )
    return (
        rows.join(whole, ["batch"], "left")
        .withColumn("verdict", verdict)
        .drop("__own", "__actor", "__node", "__refused", "__unknown", "__stop")
    )


def sequence_checks(rows: DataFrame, rows_per_split: int | None = None) -> DataFrame:
    """Per-line requests: ``duplicate``, ``regression`` or ``durable`` per passed row.

    Per ``(node, stream)`` a sequence must exceed all recorded ones. A refused row and
    a copy are never above the maximum, so the running maximum over all earlier rows
    is the maximum over the recorded ones. Of the rest, copies of a durable event are
    duplicates.
    """
    seen = ordered(
        rows,
        ["node_uuid", "stream_id"],
        arrival(),
        {"last_seq": max_before(F.col("stream_seq"))},
        rows_per_split,
    )
    above = F.col("last_seq").isNull() | (F.col("stream_seq") > F.col("last_seq"))
    ids = seen.where(above).select("event_uuid").withColumn("__durable", F.lit(True))
    outcome = (
        F.when(above, F.lit("durable"))
        .when(F.col("__durable"), F.lit("duplicate"))
        .otherwise(F.lit("regression"))
    )
    return (
        seen.join(ids, "event_uuid", "left").withColumn("outcome", outcome).drop("__durable")
    )


def sequence_cuts(rows: DataFrame, rows_per_split: int | None = None) -> DataFrame:
    """Whole-batch requests: a regression also drops the later rows of its batch.

    What a batch records depends on the cuts of earlier batches, so the cuts are
    found by repeating the running maximum over the rows that stand until no cut
    moves. Each round settles at least one more batch per node, mostly far more;
    the end point is the one-by-one result. Adds ``outcome``.
    """
    rows = cut(rows)
    cuts = cut(rows.select("batch").distinct().withColumn("stop", F.lit(None).cast("bigint")))
    stands = F.col("stop").isNull() | (F.col("line") < F.col("stop"))
    while True:
        placed = rows.join(cuts, ["batch"], "left").withColumn("__stands", stands)
        first = (
            placed.where("__stands")
            .groupBy("event_uuid")
            .agg(F.min(F.struct("batch", "line")).alias("__first"))
        )
        marked = placed.join(first, ["event_uuid"], "left").withColumn(
            "again", F.coalesce(F.struct("batch", "line") > F.col("__first"), F.lit(False))
        )
        counted = F.when(F.col("__stands") & ~F.col("again"), F.col("stream_seq"))
        seen = ordered(
            marked,
            ["node_uuid", "stream_id"],
            arrival(),
            {"last_seq": max_before(counted)},
            rows_per_split,
        )
        back = ~F.col("again") & F.coalesce(F.col("stream_seq") <= F.col("last_seq"), F.lit(False))
        judged = seen.withColumn("__back", back)
        found = cut(
            judged.groupBy("batch").agg(F.min(F.when(F.col("__back"), F.col("line"))).alias("stop"))
        )
        moved = found.join(cuts.withColumnRenamed("stop", "was"), "batch").where(
            ~F.col("stop").eqNullSafe(F.col("was"))
        )
        if moved.isEmpty():
            break
        cuts = found
    outcome = (
        F.when(F.col("line") > F.col("stop"), F.lit("not_processed"))
        .when(F.col("line") == F.col("stop"), F.lit("regression"))
        .when(F.col("again"), F.lit("duplicate"))
        .otherwise(F.lit("durable"))
    )
    return judged.withColumn("outcome", outcome).select(*rows.columns, "outcome")


def append(
    stored: DataFrame, incoming: DataFrame, rows_per_split: int | None = None, ledger: DataFrame | None = None
) -> DataFrame:
    """Offsets for incoming rows: dense after the stored ones, old ones for copies.

    New ids are numbered in arrival order with per-slice counts, not in one task.
    ``ledger`` holds ids and offsets of compacted rows (see ``snapshots.compact``): their
    copies are duplicates too, and their offsets are never given again.
    Returns the incoming rows with ``hub_offset`` and ``duplicate``.
    """
    first = incoming.groupBy("event_uuid").agg(F.min(F.struct("batch", "line")).alias("came"))
    known = stored.select("event_uuid", "hub_offset")
    if ledger is not None:
        known = known.unionByName(ledger.select("event_uuid", "hub_offset"))
    fresh = first.join(known.select("event_uuid"), "event_uuid", "left_anti").select(
        "event_uuid", "came", "came.batch", "came.line"
    )
    top = known.agg(F.coalesce(F.max("hub_offset"), F.lit(0))).scalar()
    numbered = ordered(fresh, [], arrival(), {"place": position()}, rows_per_split)
    offsets = known.withColumn("came", F.lit(None).cast(fresh.schema["came"].dataType)).unionByName(
        numbered.select("event_uuid", (F.col("place") + top).alias("hub_offset"), "came")
    )
    copy = F.col("came").isNull() | (F.struct("batch", "line") > F.col("came"))
    return incoming.join(offsets, "event_uuid").select(
        *incoming.columns, "hub_offset", copy.alias("duplicate")
    )


def push_report(results: DataFrame) -> DataFrame:
    """Counts per batch and outcome."""
    return results.groupBy("batch").agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(F.col("outcome") == "durable").alias("durable"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(~F.col("outcome").isin("durable", "duplicate")).alias("refused"),
    )


def queue_rest(queue: DataFrame, results: DataFrame) -> DataFrame:
    """Queued events without an acknowledgement, durable or duplicate."""
    done = results.where(F.col("outcome").isin("durable", "duplicate")).select("event_uuid")
    return queue.join(done, "event_uuid", "left_anti")


def pull_page(
    stored: DataFrame,
    cursors: DataFrame,
    workspace: str,
    limit: int,
    projects: list[str] | None = None,
) -> DataFrame:
    """One page: events above the author's cursor, by offset.

    ``has_more`` is true when the page is full.
    """
    rows = stored.where(F.col("workspace_uuid") == workspace)
    if projects:
        rows = rows.where(F.col("project_uuid").isin(*projects))
    known = cursors.select(F.col("author").alias("node_uuid"), "last_hub_offset")
    page = (
        rows.join(known, "node_uuid", "left")
        .where(F.col("hub_offset") > F.coalesce("last_hub_offset", F.lit(0)))
        .drop("last_hub_offset")
        .orderBy("hub_offset")
        .limit(limit)
    )
    full = page.agg(F.count(F.lit(1)) == limit).scalar()
    return page.withColumn("has_more", full)


def page_cursors(page: DataFrame) -> DataFrame:
    """Per author the last event of a page."""
    return (
        page.groupBy(F.col("node_uuid").alias("author"))
        .agg(F.max(F.struct("hub_offset", "event_uuid")).alias("c"))
        .select("author", F.col("c.event_uuid").alias("last_event_uuid"), F.col("c.hub_offset").alias("last_hub_offset"))
    )


def merge_cursors(known: DataFrame, more: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Newer offset per author; the known one wins a tie."""
    keys = keys or ["author"]
    both = known.withColumn("__rank", F.lit(1)).unionByName(more.withColumn("__rank", F.lit(0)))
    best = F.max_by(F.struct("last_event_uuid", "last_hub_offset"), F.struct("last_hub_offset", "__rank"))
    return both.groupBy(*keys).agg(best.alias("c")).select(*keys, "c.*")


def current_reports(reports: DataFrame) -> DataFrame:
    """The cursor rows of the last report of each (workspace, reporter)."""
    last = reports.groupBy("workspace_uuid", "reporter").agg(
        F.max(F.struct("reported_us", "report_id")).alias("__last")
    )
    rows = reports.join(last, ["workspace_uuid", "reporter"], "inner")
    return rows.where(F.struct("reported_us", "report_id") == F.col("__last")).drop("__last")


def replica_lag(stored: DataFrame, reports: DataFrame) -> DataFrame:
    """High-water mark of each author minus each reporter's cursor for it.

    Only authors that a reporter names have a row of their own. All others are one row a
    reporter with no ``author``, ``authors`` being how many, found as what the workspace has
    less what the reporter has; so the result grows with the reports, not with pairs.
    """
    high = stored.groupBy("workspace_uuid", F.col("node_uuid").alias("author")).agg(F.max("hub_offset").alias("high"))
    sums = high.groupBy("workspace_uuid").agg(F.count(F.lit(1)).alias("all"), F.sum("high").alias("top"))
    known = reports.join(high, ["workspace_uuid", "author"])
    seen = known.select(
        "workspace_uuid", "reporter", "author", F.lit(1).cast("bigint").alias("authors"), "high",
        F.col("last_hub_offset").alias("cursor"), (F.col("high") - F.col("last_hub_offset")).alias("lag"),
    )
    of = ["workspace_uuid", "reporter"]
    named = known.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.sum("high").alias("sum"))
    rest = reports.select(*of).distinct().join(sums, "workspace_uuid").join(named, of, "left")
    authors, top = F.col("all") - F.coalesce("n", F.lit(0)), F.col("top") - F.coalesce("sum", F.lit(0))
    unseen = rest.where(authors > 0).select(
        *of, F.lit(None).cast("string").alias("author"), authors.alias("authors"), top.alias("high"),
        F.lit(0).cast("bigint").alias("cursor"), top.alias("lag"),
    )
    return seen.unionByName(unseen)


def pair_lag(stored: DataFrame, reports: DataFrame) -> DataFrame:
    """``replica_lag`` in full: one row for every reporter and every author of its workspace.

    An author that a reporter doesn't name counts from 0.
    """
    high = stored.groupBy("workspace_uuid", F.col("node_uuid").alias("author")).agg(F.max("hub_offset").alias("high"))
    due = reports.select("workspace_uuid", "reporter").distinct().join(high, "workspace_uuid")
    have = reports.select("workspace_uuid", "reporter", "author", "last_hub_offset")
    at = F.coalesce("last_hub_offset", F.lit(0))
    rows = due.join(have, ["workspace_uuid", "reporter", "author"], "left")
    return rows.select("workspace_uuid", "reporter", "author", "high", at.alias("cursor"), (F.col("high") - at).alias("lag"))


# Local states of an event, the later one wins.
LOCAL_STATES = ("fetched", "persisted", "reduced", "quarantined", "conflicted")


def local_states(ledgers: dict[str, DataFrame]) -> DataFrame:
    """The furthest local state of each event over its ledgers, in one aggregate."""
    parts = [
        df.select("event_uuid", F.lit(LOCAL_STATES.index(name)).alias("rank"))
        for name, df in ledgers.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    names = F.array(*[F.lit(x) for x in LOCAL_STATES])
    return (
        rows.groupBy("event_uuid")
        .agg(F.max("rank").alias("rank"))
        .select("event_uuid", F.get(names, F.col("rank")).alias("status"))
    )
