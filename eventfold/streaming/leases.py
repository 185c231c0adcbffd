"""Lease expiry over a stream, with corrections for what comes late.

No row is dropped for its age. Claims and releases are stored; a micro-batch works out the
episodes of the items it touches anew, and the leases that ran out go into a log of changes:
``+1`` when an expiry is found, ``-1`` when a later batch brings a release or another claim
from before it. Open leases wait in a table of their own, one row an item at most, until the
clock, the latest stamp seen, passes their end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventfold.operators.leases import CLAIM, RELEASE, episodes
from eventfold.streaming.reduction import bucket, by_folder, run_batches, unseen
from eventfold.streaming.tables import close, read_part, write_part

LEASE = ["entity_uuid", "event_uuid", "executor", "start_us", "end_us"]


def start_leases(events: DataFrame, path: str, checkpoint: str, until_done: bool = False) -> StreamingQuery:
    """Follow a stream of claim events; tables under ``path`` close with each batch."""

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        turns = batch.where(F.col("kind").isin(CLAIM, RELEASE))
        fresh = unseen(spark, turns, path, batch_id).withColumn("bucket", bucket()).persist()
        write_part(by_folder(fresh.select("event_uuid", "day"), "day"), path, "ledger", batch_id, "day")
        write_part(by_folder(fresh.drop("day"), "bucket"), path, "turns", batch_id, "bucket")
        clock = _latest(spark, path, "clock", batch_id)
        seen = fresh.select(F.max("hlc_us").alias("now"))
        now = seen if clock is None else seen.unionByName(clock).agg(F.max("now").alias("now"))
        write_part(now, path, "clock", batch_id)
        now_us = now.scalar()

        touched = fresh.select("entity_uuid", "bucket").distinct()
        known, stored = fresh.drop("day", "bucket"), read_part(spark, path, "turns", batch_id)
        if stored is not None:
            of_items = stored.join(touched, ["bucket", "entity_uuid"], "left_semi").select(*known.columns)
            known = known.unionByName(of_items)
        spans = episodes(known).where("ended_by = 'expiry'").select(*LEASE).persist()
        due, waiting = spans.where(F.col("end_us") <= now_us), spans.where(F.col("end_us") > now_us)
        pending = _latest(spark, path, "pending", batch_id)
        if pending is not None:
            rest = pending.join(touched, "entity_uuid", "left_anti").select(*LEASE)
            due = due.unionByName(rest.where(F.col("end_us") <= now_us))
            waiting = waiting.unionByName(rest.where(F.col("end_us") > now_us))
        write_part(waiting, path, "pending", batch_id)

        changes = due.withColumn("change", F.lit(1))
        before = expired(spark, path, batch_id)
        if before is not None:
            again = before.join(touched, "entity_uuid", "left_semi").withColumn("change", F.lit(-1))
            changes = changes.unionByName(again).groupBy(*LEASE).agg(F.sum("change").cast("int").alias("change")).where("change <> 0")
        write_part(changes, path, "changes", batch_id)
        close(spark, path, batch_id)
        spans.unpersist()
        fresh.unpersist()

    return run_batches(events, take, checkpoint, until_done)


def _latest(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame | None:
    """A table that each batch writes whole: its newest closed generation."""
    rows = read_part(spark, path, name, before)
    if rows is None:
        return None
    return rows.join(rows.agg(F.max("gen").alias("gen")), "gen", "left_semi").drop("gen")


def changes(spark: SparkSession, path: str) -> DataFrame | None:
    """The log of changes, ``gen`` being the batch that found them."""
    return read_part(spark, path, "changes")


def expired(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Leases that ran out, all corrections counted."""
    rows = read_part(spark, path, "changes", before)
    if rows is None:
        return None
    return rows.groupBy(*LEASE).agg(F.sum("change").alias("change")).where("change > 0").drop("change")
