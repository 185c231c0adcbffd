"""Snapshots, bootstrap, compaction watermark and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.operators import registers, sets
from eventfold.operators.loops import cut

DAY_US = 24 * 3600 * 1_000_000


def boundary_cursors(stored: DataFrame, boundary: int, project: str | None = None) -> DataFrame:
    """Per author the last event at or below an offset."""
    rows = stored.where(F.col("hub_offset") <= boundary)
    if project:
        rows = rows.where(F.col("project_uuid") == project)
    return (
        rows.groupBy(F.col("node_uuid").alias("author"))
        .agg(F.max(F.struct("hub_offset", "event_uuid")).alias("c"))
        .select("author", F.col("c.event_uuid").alias("last_event_uuid"), F.col("c.hub_offset").alias("last_hub_offset"))
    )


def take(log: DataFrame) -> dict[str, DataFrame]:
    """State tables that later merges can continue from: winners keep their stamps,
    sets their removals, counters their sum."""
    return {
        "fields": registers.lww(
            registers.field_writes(log), ["project_uuid", "entity_uuid", "field"], ["value"]
        ),
        "sets": sets.or_set(sets.set_operations(log)),
        "counters": sets.counters(sets.adjustments(log)),
        "states": registers.state_register(log),
        "archived": registers.archive_register(log),
    }


def resume(base: dict[str, DataFrame], tail: DataFrame) -> dict[str, DataFrame]:
    """State of a snapshot plus the events after it; equals a full reduction.

    The tail holds each event once and only events above the snapshot boundary.
    """
    more = take(tail)
    merged = {
        "fields": sets.merge_states(
            base["fields"], more["fields"], ["project_uuid", "entity_uuid", "field"], ["value"]
        ),
        "sets": sets.merge_set_states(base["sets"], more["sets"]),
        "states": sets.merge_states(base["states"], more["states"], ["entity_uuid"], ["state_key"]),
        "archived": sets.merge_states(
            base["archived"], more["archived"], ["entity_uuid"], ["archived"]
        ),
    }
    merged["counters"] = (
        base["counters"]
        .unionByName(more["counters"])
        .groupBy("entity_uuid", "field")
        .agg(F.sum("total").alias("total"), F.sum("adjustments").alias("adjustments"))
    )
    return merged


def write(state: dict[str, DataFrame], path: str) -> None:
    """One Parquet table per part of the state."""
    for name, df in state.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def read(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def latest(catalog: DataFrame) -> DataFrame:
    """Snapshot with the highest boundary per project."""
    return (
        catalog.groupBy("project_uuid")
        .agg(F.max(F.struct("through_offset", "snapshot_id")).alias("s"))
        .select("project_uuid", "s.through_offset", "s.snapshot_id")
    )


def node_minima(stored: DataFrame, reports: DataFrame) -> DataFrame:
    """Per author the least cursor over all reporters; a missing one counts 0.

    Cursors are counted instead of crossed with reporters: fewer cursors for an
    author than there are reporters means that one is missing.
    """
    authors = stored.select(F.col("node_uuid").alias("author")).distinct()
    reporters = reports.agg(F.count_distinct("reporter")).scalar()
    had = reports.groupBy("author").agg(
        F.min("last_hub_offset").alias("least"), F.count_distinct("reporter").alias("seen")
    )
    full = F.coalesce(F.col("seen") == reporters, F.lit(False))
    return authors.join(had, "author", "left").select(
        "author", F.when(full, F.col("least")).otherwise(F.lit(0)).cast("bigint").alias("covered")
    )


def watermark(stored: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: the highest offset up to which every event is covered, else 0.

    The first uncovered offset is a minimum, the watermark the maximum below it: two
    aggregates, no ordered scan.
    """
    minima = node_minima(stored, reports).withColumnRenamed("author", "node_uuid")
    log = stored.select("node_uuid", "hub_offset")
    first = log.join(minima, "node_uuid").where("hub_offset > covered").agg(F.min("hub_offset")).scalar()
    return log.agg(
        F.coalesce(
            F.max(F.when(first.isNull() | (F.col("hub_offset") < first), F.col("hub_offset"))),
            F.lit(0),
        ).alias("watermark")
    )


def active_reports(reports: DataFrame, now_us: int, days: int = 30) -> DataFrame:
    """Reports of replicas that reported within the given days."""
    return reports.where(F.col("reported_us") >= now_us - days * DAY_US)


def compaction_decisions(
    stored: DataFrame, requests: dict[str, Column], mark: DataFrame, snapshots: DataFrame
) -> DataFrame:
    """For each requested bound: the decision, and the rows it would drop.

    Refused above the watermark, or while a project with rows at or below the bound has
    no snapshot that reaches it; ``snapshots`` is one row for each project. All bounds are
    counted in one pass over the log, by project first.
    """
    mark = cut(mark)  # one row; the optimizer cannot merge it with the scan below
    asked = [
        F.struct(
            F.lit(name).alias("request"),
            through.cast("bigint").alias("through"),
            F.count_if(F.col("hub_offset") <= through).alias("below"),
        )
        for name, through in requests.items()
    ]
    projects = (
        stored.groupBy("project_uuid").agg(F.array(*asked).alias("r"))
        .select("project_uuid", F.explode("r").alias("r")).select("project_uuid", "r.*")
        .join(snapshots.select("project_uuid", "through_offset"), "project_uuid", "left")
    )
    short = (F.col("below") > 0) & (F.coalesce("through_offset", F.lit(0)) < F.col("through"))
    rows = projects.groupBy("request", "through").agg(F.sum("below").alias("below"), F.count_if(short).alias("short"))
    decision = (
        F.when(F.col("through") > mark.scalar(), F.lit("above_watermark"))
        .when(F.col("short") > 0, F.lit("no_snapshot"))
        .otherwise(F.lit("compact"))
    )
    return rows.select(
        "request",
        "through",
        decision.alias("decision"),
        F.when(decision == "compact", F.col("below")).otherwise(F.lit(0)).alias("dropped"),
    )


def compact(stored: DataFrame, through: int) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the id ledger of the dropped ones (stops a re-push)."""
    gone = stored.where(F.col("hub_offset") <= through).select("event_uuid", "hub_offset")
    return stored.where(F.col("hub_offset") > through), gone


def lost_tombstones(state: DataFrame, snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """Removed members found neither in the snapshot nor in the tail; must be empty."""
    key = ["entity_uuid", "set_name", "member"]
    wanted = sets.tombstones(state).select(*key)
    kept = (
        snapshot.where(F.col("removed").isNotNull())
        .select(*key)
        .unionByName(sets.set_operations(tail).where(~F.col("is_add")).select(*key))
        .distinct()
    )
    return wanted.join(kept, key, "left_anti")
