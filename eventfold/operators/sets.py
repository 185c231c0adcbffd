"""Observed-remove sets and maps, signed counters, merge of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.functions.stamps import order_key
from eventfold.functions.values import is_actor
from eventfold.operators.order import first_copy
from eventfold.operators.registers import STAMP, lww
from eventfold.operators.skew import LIST_ITEMS, list_parts

# Kinds that add to or remove from a named set.
SET_OPS = {
    "item.add-label": ("labels", "add"),
    "item.remove-label": ("labels", "remove"),
    "item.assign-user": ("assignees", "add"),
    "item.unassign-user": ("assignees", "remove"),
}


def set_operations(log: DataFrame) -> DataFrame:
    kind = F.col("kind")
    names = [F.lit(x) for k, (s, _) in SET_OPS.items() for x in (k, s)]
    return log.where(kind.isin(*SET_OPS)).select(
        "entity_uuid",
        F.element_at(F.create_map(*names), kind).alias("set_name"),
        "member",
        kind.isin("item.add-label", "item.assign-user").alias("is_add"),
        *STAMP,
    )


def or_set(ops: DataFrame) -> DataFrame:
    """Set state per ``(entity, set, member)``; removed members stay as tombstones."""
    key = order_key()
    return (
        ops.groupBy("entity_uuid", "set_name", "member")
        .agg(
            F.max_by("is_add", key).alias("active"),
            F.max(F.when(F.col("is_add"), key)).alias("added"),
            F.max(F.when(~F.col("is_add"), key)).alias("removed"),
        )
    )


def active_members(state: DataFrame) -> DataFrame:
    return state.where("active").select("entity_uuid", "set_name", "member")


def tombstones(state: DataFrame) -> DataFrame:
    return state.where(~F.col("active"))


def member_lists(state: DataFrame, part_items: int = LIST_ITEMS) -> DataFrame:
    """Sorted active members per set, in parts of bounded length."""
    return list_parts(
        active_members(state), ["entity_uuid", "set_name"], F.col("member"), "members", part_items
    )


def assignees(state: DataFrame) -> DataFrame:
    """Active assignees with ``valid`` false where the member is no actor."""
    rows = active_members(state).where(F.col("set_name") == "assignees")
    return rows.select("entity_uuid", "member", is_actor(F.col("member")).alias("valid"))


def adjustments(log: DataFrame) -> DataFrame:
    return log.where(F.col("kind") == "item.adjust-field").select(
        "project_uuid", "entity_uuid", "field", "delta", "event_uuid"
    )


def counters(adjusts: DataFrame) -> DataFrame:
    """Sum of deltas over distinct events per ``(entity, field)``."""
    return (
        first_copy(adjusts)
        .groupBy("entity_uuid", "field")
        .agg(F.sum("delta").alias("total"), F.count(F.lit(1)).alias("adjustments"))
    )


def counter_guard(adjusts: DataFrame, types: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """Adjustments whose field is not declared as a counter."""
    declared = schema_fields.select(
        "project_uuid", "entity_kind", "item_type", "field", "field_kind"
    )
    return (
        adjusts.join(types, "entity_uuid", "left")
        .join(declared, ["project_uuid", "entity_kind", "item_type", "field"], "left")
        .where(F.coalesce(F.col("field_kind") != "counter", F.lit(True)))
        .select("event_uuid", "entity_uuid", "field", "field_kind")
    )


def or_map(ops: DataFrame, keys: list[str], removed: Column) -> DataFrame:
    """Per map key the last upsert or remove; removed keys stay as tombstones."""
    return lww(ops.withColumn("removed", removed), keys, ["value", "removed"])


def merge_states(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Join of two register states: the same rule as the merge of writes."""
    return lww(left.unionByName(right), keys, values)


def merge_set_states(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join of two set states by their add and remove stamps."""
    return (
        left.unionByName(right)
        .groupBy("entity_uuid", "set_name", "member")
        .agg(F.max("added").alias("added"), F.max("removed").alias("removed"))
        .withColumn(
            "active",
            F.col("added").isNotNull()
            & (F.col("removed").isNull() | (F.col("added") > F.col("removed"))),
        )
    )
