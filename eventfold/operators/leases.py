"""Claims, releases and progress notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.functions.stamps import order_by, order_key
from eventfold.operators.skew import following_row, last_known, ordered, running_sum

CLAIM, PROGRESS, RELEASE = "execution.claim", "execution.progress", "execution.release"


def last_claims(log: DataFrame) -> DataFrame:
    """Last claim per entity in event order."""
    return (
        log.where(F.col("kind") == CLAIM)
        .groupBy("entity_uuid")
        .agg(F.max_by(F.struct("executor", "expires_us", "event_uuid"), order_key()).alias("c"))
        .select("entity_uuid", "c.*")
    )


def progress_log(log: DataFrame, rows_per_split: int | None = None) -> DataFrame:
    """Progress notes with the holder at their time; accepted ones are numbered."""
    turn = F.when(
        F.col("kind").isin(CLAIM, RELEASE), F.struct("executor", "expires_us")
    )
    is_note = F.col("kind") == PROGRESS
    ok = (
        is_note
        & (F.col("holder.executor") == F.col("actor"))
        & (F.col("hlc_us") < F.col("holder.expires_us"))
    )
    accepted = F.coalesce(ok, F.lit(False))
    numbered = ordered(
        log,
        ["entity_uuid"],
        order_by(),
        {"holder": last_known(turn, order_by())},
        rows_per_split,
        then={"place": running_sum(accepted.cast("bigint"))},
    ).where(is_note).withColumn("accepted", accepted)
    return numbered.select(
        "event_uuid",
        "entity_uuid",
        "actor",
        F.col("holder.executor").alias("holder"),
        "accepted",
        F.when(F.col("accepted"), F.col("place")).alias("sequence"),
    )


def episodes(log: DataFrame, rows_per_split: int | None = None) -> DataFrame:
    """Claim spans: from a claim to its release, expiry or the next claim."""
    nxt = following_row(F.struct("hlc_us", "kind", "executor"), order_by())
    turns = ordered(
        log.where(F.col("kind").isin(CLAIM, RELEASE)),
        ["entity_uuid"],
        order_by(),
        {"nxt": nxt},
        rows_per_split,
    ).where(F.col("kind") == CLAIM)
    expired = F.col("nxt").isNull() | (F.col("expires_us") <= F.col("nxt.hlc_us"))
    end = F.when(expired, F.col("expires_us")).otherwise(F.col("nxt.hlc_us"))
    return turns.select(
        "entity_uuid",
        "event_uuid",
        "executor",
        F.col("hlc_us").alias("start_us"),
        end.alias("end_us"),
        F.when(expired, F.lit("expiry"))
        .when(F.col("nxt.kind") == RELEASE, F.lit("release"))
        .when(F.col("nxt.executor") == F.col("executor"), F.lit("renewal"))
        .otherwise(F.lit("steal"))
        .alias("ended_by"),
        (end - F.col("hlc_us")).alias("held_us"),
    )


def active_claims(spans: DataFrame, at_us: int | Column) -> DataFrame:
    """Claims held at an instant."""
    at = F.lit(at_us) if isinstance(at_us, int) else at_us
    return spans.where((F.col("start_us") <= at) & (at < F.col("end_us")))
