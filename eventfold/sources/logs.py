"""The stored log: scan with pushed filters, idempotent append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.operators.order import first_copy


def scan(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """Stored envelopes; a project reads its own folder only."""
    log = spark.read.parquet(path)
    return log if project is None else log.where(F.col("project_uuid") == project)


def day() -> Column:
    """The folder of an event: the day of its own stamp."""
    return F.to_date(F.timestamp_micros("hlc_us"))


def days_met(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The part of a log written by ``write`` that can hold copies of incoming events.

    Copies have equal stamps, so only folders of incoming days are listed and read. Days
    are few, some thousand at most, whatever the number of events.
    """
    days = [r["day"] for r in incoming.select(day().alias("day")).distinct().collect()]
    return stored.where(F.col("day").isin(days)) if days else stored.limit(0)


def new_events(incoming: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Incoming events that the log does not hold, each id once.

    Of a log partitioned by day only the days of the incoming events are read.
    """
    rows = first_copy(incoming)
    if stored is None:
        return rows
    if "day" in stored.columns:
        stored = days_met(stored, incoming)
    return rows.join(stored.select("event_uuid"), "event_uuid", "left_anti")


def write(log: DataFrame, path: str) -> None:
    """Append to a log partitioned by project and day.

    Rows are spread by event id within a day, so a project with most of the events
    is written by many tasks.
    """
    (
        log.withColumn("day", day())
        .repartition("project_uuid", "day", F.pmod(F.xxhash64("event_uuid"), F.lit(32)))
        .write.mode("append")
        .partitionBy("project_uuid", "day")
        .parquet(path)
    )
