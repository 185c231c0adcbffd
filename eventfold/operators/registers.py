"""Last-writer-wins registers: fields, state, archive flag, header, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.functions.stamps import ORDER_COLUMNS, order_by, order_key
from eventfold.functions.values import coerce, json_text, json_type
from eventfold.operators.skew import (
    LIST_ITEMS,
    following_row,
    list_parts,
    ordered,
    position,
)

STAMP = list(ORDER_COLUMNS)
# Kinds that move an item's updated stamp.
TOUCHING = (
    "item.create",
    "item.set-field",
    "item.clear-field",
    "item.adjust-field",
    "item.set-state",
    "item.archive",
    "item.restore",
)


def lww(writes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The register merge: per key, the values of the last write in event order.

    NULL winners are kept. Combines before the shuffle, so a hot key costs one row
    per task; the winner's stamp comes along as provenance.
    """
    winner = F.max_by(F.struct(*values, *STAMP), order_key())
    return (
        writes.groupBy(*keys)
        .agg(winner.alias("win"))
        .select(*keys, *[F.col(f"win.{c}").alias(c) for c in values + STAMP])
    )


def create_writes(log: DataFrame) -> DataFrame:
    """The ``fields`` of creates, one write per name."""
    return log.where(F.col("kind") == "item.create").select(
        "project_uuid", "entity_uuid", *STAMP, F.explode("fields").alias("field", "value")
    )


def field_writes(log: DataFrame) -> DataFrame:
    """Every field write: creates, sets, and clears as NULL values."""
    sets = log.where(F.col("kind").isin("item.set-field", "item.clear-field")).select(
        "project_uuid", "entity_uuid", *STAMP, "field", "value"
    )
    return sets.unionByName(create_writes(log))


def field_state(log: DataFrame) -> DataFrame:
    """Field registers with tombstones: ``value_type`` is ``cleared`` for those."""
    state = lww(field_writes(log), ["project_uuid", "entity_uuid", "field"], ["value"])
    return state.withColumn("value_type", json_type(F.col("value")))


def live_fields(state: DataFrame) -> DataFrame:
    return state.where(F.col("value_type") != "cleared")


def with_items(state: DataFrame, log: DataFrame) -> DataFrame:
    """Only state of entities that have a create at any stamp."""
    return state.join(created(log), "entity_uuid", "left_semi")


def without_items(log: DataFrame) -> DataFrame:
    """Item events of entities that were never created."""
    return log.where(F.col("kind").startswith("item.")).join(
        created(log), "entity_uuid", "left_anti"
    )


def created(log: DataFrame) -> DataFrame:
    return log.where(F.col("kind") == "item.create").select("entity_uuid").distinct()


def state_register(log: DataFrame) -> DataFrame:
    rows = log.where(F.col("kind").isin("item.create", "item.set-state"))
    return lww(rows, ["entity_uuid"], ["state_key"])


def archive_register(log: DataFrame) -> DataFrame:
    rows = log.where(F.col("kind").isin("item.create", "item.archive", "item.restore"))
    return lww(
        rows.withColumn("archived", F.col("kind") == "item.archive"), ["entity_uuid"], ["archived"]
    )


def typed_writes(log: DataFrame, types: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """All writes checked against the declared kind of their field.

    ``types`` is one row per entity (``entity_uuid, entity_kind, item_type``);
    ``schema_fields`` one per ``(project_uuid, entity_kind, item_type, field)``.
    """
    writes = field_writes(log).where(F.col("value").isNotNull())
    declared = writes.join(types, "entity_uuid", "left").join(
        schema_fields.select("project_uuid", "entity_kind", "item_type", "field", "field_kind"),
        ["project_uuid", "entity_kind", "item_type", "field"],
        "left",
    )
    typed = declared.withColumn("typed", coerce(F.col("value"), F.col("field_kind")))
    return typed.select(
        "event_uuid",
        "entity_uuid",
        "field",
        "field_kind",
        "typed.value_type",
        "typed.stored",
        "typed.error",
    )


def headers(log: DataFrame) -> DataFrame:
    """One header per created entity, from one aggregate over its item events."""
    kind, key = F.col("kind"), order_key()
    is_create = kind == "item.create"
    touched = F.when(kind.isin(*TOUCHING), key)

    def last(value: Column, where: Column) -> Column:
        return F.max_by(value, F.when(where, key))

    shape = F.struct("project_uuid", "entity_kind", "item_type", "schema_version")
    return (
        log.where(kind.isin(*TOUCHING))
        .groupBy("entity_uuid")
        .agg(
            last(shape, is_create).alias("shape"),
            F.min(F.when(is_create, key)).alias("first"),
            F.max(touched).alias("last"),
            last(F.struct("state_key"), is_create | (kind == "item.set-state")).alias("state"),
            last(
                kind == "item.archive", is_create | kind.isin("item.archive", "item.restore")
            ).alias("archived"),
        )
        .where(F.col("first").isNotNull())
        .select(
            "entity_uuid",
            "shape.project_uuid",
            "shape.entity_kind",
            "shape.item_type",
            "state.state_key",
            "archived",
            F.col("first.hlc_us").alias("created_us"),
            F.col("first.event_uuid").alias("created_by"),
            F.col("last.hlc_us").alias("updated_us"),
            F.col("last.event_uuid").alias("updated_by"),
        )
    )


def item_fields(log: DataFrame, fields: list[str]) -> DataFrame:
    """Header of every item with one text column per named field."""
    text = F.coalesce(json_text(F.col("value")), F.col("value"))
    wide = (
        live_fields(field_state(log))
        .groupBy("entity_uuid")
        .agg(
            *[F.max(F.when(F.col("field") == f, text)).alias(f) for f in fields],
            F.count(F.lit(1)).alias("field_count"),
        )
    )
    return headers(log).join(wide, "entity_uuid", "left")


def item_view(log: DataFrame, members: DataFrame, fields: list[str], part_items: int = LIST_ITEMS) -> DataFrame:
    """The item read model: header, one column per named field, member lists.

    Lists come in parts (see ``list_parts``): an item with more members than
    ``part_items`` continues in further parts, the header repeated.
    """
    named = F.concat_ws("=", "set_name", "member")
    lists = list_parts(members, ["entity_uuid"], named, "members", part_items)
    return (
        item_fields(log, fields)
        .join(lists, "entity_uuid", "left")
        .withColumn("part", F.coalesce("part", F.lit(0)))
    )


def field_history(log: DataFrame, rows_per_split: int | None = None) -> DataFrame:
    """Every write with the time it was current: ``valid_from_us`` to ``valid_to_us``."""
    nxt = following_row(F.struct("hlc_us", F.col("event_uuid").alias("by")), order_by())
    rows = ordered(
        field_writes(log),
        ["entity_uuid", "field"],
        order_by(),
        {"version": position(), "nxt": nxt},
        rows_per_split,
    )
    return rows.select(
        "entity_uuid",
        "field",
        "version",
        "event_uuid",
        "value",
        F.col("hlc_us").alias("valid_from_us"),
        F.col("nxt.hlc_us").alias("valid_to_us"),
        F.col("nxt.by").alias("replaced_by"),
    )


def as_of(log: DataFrame, until_us: int) -> DataFrame:
    """The prefix of the log up to an instant; any reducer on it gives state then."""
    return log.where(F.col("hlc_us") <= until_us)
