"""Comments: reduce, visible thread, supersession chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.stamps import order_key
from eventfold.operators.loops import cut


def comments(log: DataFrame) -> DataFrame:
    """One row per comment from one aggregate.

    The last add sets author and target, the last add or edit the body, and a
    delete counts when it is later than the last add.
    """
    kind, key = F.col("kind"), order_key()
    is_add, is_edit = kind == "comment.add", kind == "comment.edit"
    base = F.struct("entity_uuid", "author", "comment_kind", "directed_at", "replaces")
    return (
        log.groupBy("comment_uuid")
        .agg(
            F.max_by(base, F.when(is_add, key)).alias("base"),
            F.max_by(F.struct("body"), F.when(is_add | is_edit, key)).alias("text"),
            F.max(F.when(is_add, key)).alias("added"),
            F.max(F.when(is_edit, key)).alias("edited"),
            F.max(F.when(kind == "comment.delete", key)).alias("removed"),
        )
        .where(F.col("added").isNotNull())
        .select(
            "comment_uuid",
            "base.*",
            "text.body",
            F.col("added.hlc_us").alias("created_us"),
            F.coalesce(F.col("edited") > F.col("added"), F.lit(False)).alias("edited"),
            F.coalesce(F.col("removed") > F.col("added"), F.lit(False)).alias("deleted"),
        )
    )


def orphan_edits(log: DataFrame) -> DataFrame:
    """Edits of comments that were never added: errors, kept apart."""
    added = log.where(F.col("kind") == "comment.add").select("comment_uuid").distinct()
    return log.where(F.col("kind") == "comment.edit").join(added, "comment_uuid", "left_anti")


def visible(state: DataFrame) -> DataFrame:
    """Comments that are not deleted and not named as replaced by another one."""
    hidden = (
        state.where(F.col("replaces").isNotNull())
        .select(F.col("replaces").alias("comment_uuid"))
        .distinct()
    )
    return state.where(~F.col("deleted")).join(hidden, "comment_uuid", "left_anti")


def chain_heads(state: DataFrame) -> DataFrame:
    """For every comment the last one of its replacement chain, and the hops there.

    Pointer doubling: rounds grow with the logarithm of the longest chain. Only a
    later comment can replace an earlier one, so chains have no cycles.
    """
    ids = state.select("comment_uuid", "created_us")
    newer = state.where(F.col("replaces").isNotNull()).select(
        F.col("replaces").alias("comment_uuid"),
        F.struct("created_us", F.col("comment_uuid").alias("id")).alias("by"),
    )
    link = newer.groupBy("comment_uuid").agg(F.max("by").alias("by"))
    hop = F.col("by").isNotNull() & (F.struct("created_us", "comment_uuid") < F.col("by"))
    heads = cut(
        ids.join(link, "comment_uuid", "left").select(
            "comment_uuid",
            F.when(hop, F.col("by.id")).otherwise(F.col("comment_uuid")).alias("head"),
            F.when(hop, 1).otherwise(0).cast("bigint").alias("hops"),
        )
    )
    while True:
        step = heads.select(
            F.col("comment_uuid").alias("head"),
            F.col("head").alias("next"),
            F.col("hops").alias("more"),
        ).where(F.col("more") > 0)
        joined = cut(
            heads.join(step, "head", "left").select(
                "comment_uuid",
                F.coalesce("next", "head").alias("head"),
                (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
                F.col("next").isNotNull().alias("moved"),
            )
        )
        heads = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return heads


def open_questions(state: DataFrame) -> DataFrame:
    """Visible comments that ask a human for input."""
    return visible(state).where(F.col("comment_kind") == "needs_input")
