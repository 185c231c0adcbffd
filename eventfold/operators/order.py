"""Order, dedup and selection of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.functions.stamps import order_by, order_key
from eventfold.operators.skew import ordered, position


def canonical_order(log: DataFrame, keys: list[str] | None = None, rows_per_split: int | None = None) -> DataFrame:
    """Add ``rank``: the position in replay order, per ``keys`` or over the whole log."""
    return ordered(
        log, keys or [], order_by(), {"rank": position()}, rows_per_split
    )


def first_copy(log: DataFrame, arrival: list[Column] | None = None) -> DataFrame:
    """One row per event id.

    Without ``arrival`` copies are taken as equal. With it, the copy that arrived
    first is kept; both forms combine before the shuffle.
    """
    if not arrival:
        return log.dropDuplicates(["event_uuid"])
    rest = [c for c in log.columns if c != "event_uuid"]
    return (
        log.groupBy("event_uuid")
        .agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("kept"))
        .select("event_uuid", *[F.col(f"kept.{c}").alias(c) for c in rest])
    )


def backlog(log: DataFrame, reduced: DataFrame, project: str | None = None) -> DataFrame:
    """Events not yet in the reduced ledger, in replay order."""
    rows = log if project is None else log.where(F.col("project_uuid") == project)
    return rows.join(reduced.select("event_uuid"), "event_uuid", "left_anti").orderBy(*order_by())


def progress(log: DataFrame, by: str) -> DataFrame:
    """Last event per node (``node_uuid``) or per project (``project_uuid``)."""
    last = F.max_by(
        F.struct("event_uuid", "hlc_us", "hlc_node", "hlc_seq", "stream_seq"), order_key()
    )
    return (
        log.groupBy(by)
        .agg(last.alias("last"), F.count(F.lit(1)).alias("events"))
        .select(
            by,
            F.col("last.event_uuid").alias("last_event_uuid"),
            F.col("last.hlc_us").alias("last_hlc_us"),
            F.col("last.hlc_node").alias("last_hlc_node"),
            F.col("last.stream_seq").alias("last_stream_seq"),
            "events",
        )
    )


def latest_event(log: DataFrame) -> DataFrame:
    """The latest event of each project by instant, not by stamp text."""
    return (
        log.groupBy("project_uuid")
        .agg(F.max_by(F.struct("event_uuid", "kind"), order_key()).alias("last"))
        .select("project_uuid", "last.event_uuid", "last.kind")
    )


def missing_dependencies(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(event_uuid, dep)`` for each named dependency that is not known.

    ``known`` has the ids (``event_uuid``) of the events at hand: the log itself unless given.
    """
    known = log if known is None else known
    wanted = log.select("event_uuid", F.explode("deps").alias("dep"))
    return wanted.join(known.select(F.col("event_uuid").alias("dep")), "dep", "left_anti").select(
        "event_uuid", "dep"
    )
