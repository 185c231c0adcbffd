"""Relations: reduce, attributes, edges by entity and by project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.stamps import order_key
from eventfold.operators.registers import STAMP, lww


def relations(log: DataFrame) -> DataFrame:
    """One row per relation id: last create wins, a later delete is a tombstone."""
    kind, key = F.col("kind"), order_key()
    is_create = kind == "relation.create"
    ends = F.struct("project_uuid", "relation_kind", "from_uuid", "to_uuid")
    return (
        log.where(kind.isin("relation.create", "relation.delete"))
        .groupBy("relation_uuid")
        .agg(
            F.max_by(ends, F.when(is_create, key)).alias("ends"),
            F.max(F.when(is_create, key)).alias("made"),
            F.max(F.when(~is_create, key)).alias("removed"),
        )
        .where(F.col("made").isNotNull())
        .select(
            "relation_uuid",
            "ends.*",
            "made",
            F.coalesce(F.col("removed") > F.col("made"), F.lit(False)).alias("deleted"),
        )
    )


def live(state: DataFrame) -> DataFrame:
    return state.where(~F.col("deleted"))


def attributes(log: DataFrame, state: DataFrame) -> DataFrame:
    """Attributes ``(relation_uuid, key, value)`` since the last create of each.

    The winner per key is taken first, over creates and changes alike. It counts
    when it is not older than the last create, so only one row per key is joined.
    """
    writes = log.where(F.col("kind").isin("relation.create", "relation.set-attr")).select(
        "relation_uuid", *STAMP, F.explode("attrs").alias("key", "value")
    )
    best = lww(writes, ["relation_uuid", "key"], ["value"])
    made = state.select("relation_uuid", "made")
    return (
        best.join(made, "relation_uuid")
        .where(order_key() >= F.col("made"))
        .select("relation_uuid", "key", "value")
    )


def orphan_changes(log: DataFrame) -> DataFrame:
    """Attribute changes of relations that were never created."""
    made = log.where(F.col("kind") == "relation.create").select("relation_uuid").distinct()
    return log.where(F.col("kind") == "relation.set-attr").join(made, "relation_uuid", "left_anti")


def directed(state: DataFrame) -> DataFrame:
    """Two rows per live edge, one for each end: an equi-join key instead of an OR."""
    ends = F.array(
        F.struct(
            F.col("from_uuid").alias("entity_uuid"),
            F.col("to_uuid").alias("peer_uuid"),
            F.lit("outgoing").alias("direction"),
        ),
        F.struct(
            F.col("to_uuid").alias("entity_uuid"),
            F.col("from_uuid").alias("peer_uuid"),
            F.lit("incoming").alias("direction"),
        ),
    )
    rows = live(state).select("relation_uuid", "relation_kind", F.explode(ends).alias("e"))
    return rows.select("e.*", "relation_uuid", "relation_kind")


def touching(state: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of each entity. Rows are emitted twice and never grouped."""
    return directed(state).join(entities, ["entity_uuid"], "inner")


def of_project(state: DataFrame, project: str, items: DataFrame | None = None) -> DataFrame:
    """Live relations of a project: by their own project, or by an end's project
    when ``items`` (``entity_uuid, project_uuid``) is given."""
    if items is None:
        return live(state).where(F.col("project_uuid") == project)
    members = items.where(F.col("project_uuid") == project).select("entity_uuid")
    hits = directed(state).join(members, "entity_uuid", "left_semi")
    return live(state).join(hits.select("relation_uuid").distinct(), "relation_uuid", "left_semi")
