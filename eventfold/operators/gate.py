"""Quarantine gate and drain; the outcome of each event is in ``replay``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.kinds import event_class
from eventfold.functions.stamps import order_by
from eventfold.operators.skew import last_known, max_after, ordered


def gate(log: DataFrame, projects: DataFrame) -> DataFrame:
    """Work events against the current version of their project.

    Adds ``version`` (NULL without a schema) and ``quarantined``.
    """
    joined = log.join(projects.select("project_uuid", "version"), "project_uuid", "left")
    ahead = F.col("version").isNull() | (F.col("schema_version") > F.col("version"))
    return joined.withColumn("quarantined", (event_class(F.col("kind")) == "work") & ahead)


def drain(work: DataFrame, reached: DataFrame, rows_per_split: int | None = None) -> DataFrame:
    """Work events against the schema versions over time.

    ``applied`` when the version at the event suffices, ``drained`` when a later
    one does, else ``quarantined``. ``reached`` has one row per schema event with
    its version; both sides are in event order.
    """
    stamp = ["hlc_us", "hlc_ns", "hlc_node", "hlc_seq", "node_uuid", "stream_seq", "event_uuid"]
    none = F.lit(None).cast("bigint")
    rows = work.select("project_uuid", *stamp, "schema_version", none.alias("version")).unionByName(
        reached.where(F.col("version").isNotNull()).select(
            "project_uuid", *stamp, none.alias("schema_version"), "version"
        )
    )
    seen = ordered(
        rows,
        ["project_uuid"],
        order_by(),
        {
            "then": last_known(F.col("version"), order_by()),
            "later": max_after(F.col("version")),
        },
        rows_per_split,
    ).where(F.col("schema_version").isNotNull())
    need = F.col("schema_version")
    return seen.select(
        "event_uuid",
        "project_uuid",
        "schema_version",
        F.col("then").alias("version_then"),
        F.when(need <= F.col("then"), F.lit("applied"))
        .when(need <= F.col("later"), F.lit("drained"))
        .otherwise(F.lit("quarantined"))
        .alias("outcome"),
    )
