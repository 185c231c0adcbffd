"""Schema versions, fields and other migrations, all from log events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.stamps import order_by, order_key
from eventfold.operators.registers import STAMP, lww
from eventfold.operators.skew import last_known, ordered, running_sum

INIT, SNAPSHOT, ADD_FIELD = "schema.init", "schema.snapshot", "schema.add-field"
# The type that is made when a kind has none yet.
FIRST_TYPE = {"issue": "bug", "effort": "sprint", "component": "module"}
FIELD = "struct<kind:string,required:boolean,enum_name:string>"
BODY = f"struct<types:map<string,struct<entity_kind:string,fields:map<string,{FIELD}>>>>"


def versions(
    log: DataFrame, bump_kinds: tuple[str, ...] = (ADD_FIELD,), rows_per_split: int | None = None
) -> DataFrame:
    """The version each schema event reaches; NULL where no schema exists yet.

    An init starts at 1, a snapshot at its given version, every other bumping event
    adds one to what came before it.
    """
    kind = F.col("kind")
    rows = log.where(kind.isin(INIT, SNAPSHOT, *bump_kinds))
    base = F.when(kind == INIT, F.lit(1)).when(kind == SNAPSHOT, F.col("given_version"))
    start = F.when(kind.isin(INIT, SNAPSHOT), F.struct(base.alias("base"), "bumps"))
    placed = ordered(
        rows,
        ["project_uuid"],
        order_by(),
        {"bumps": running_sum(kind.isin(*bump_kinds).cast("bigint"))},
        rows_per_split,
        then={"start": last_known(start, order_by())},
    )
    return placed.withColumn(
        "version", F.col("start.base") + F.col("bumps") - F.col("start.bumps")
    ).drop("start", "bumps")


def ledger(reached: DataFrame) -> DataFrame:
    """One row per ``(project, version)``; a later event replaces the same version."""
    known = reached.where(F.col("version").isNotNull())
    return lww(known, ["project_uuid", "version"], ["kind"])


def latest(ledger_rows: DataFrame) -> DataFrame:
    """The highest version of each project."""
    return (
        ledger_rows.groupBy("project_uuid")
        .agg(F.max_by(F.struct("version", "event_uuid", "kind"), "version").alias("v"))
        .select("project_uuid", "v.*")
    )


def at_least(ledger_rows: DataFrame, version: int) -> DataFrame:
    return ledger_rows.where(F.col("version") >= version)


def body_fields(log: DataFrame) -> DataFrame:
    """Fields in the bodies of init and snapshot events, one row each."""
    body = F.from_json("body", BODY)
    types = log.where(F.col("kind").isin(INIT, SNAPSHOT)).select(
        "project_uuid", *STAMP, F.explode(body["types"]).alias("item_type", "def")
    )
    return types.select(
        "project_uuid",
        *STAMP,
        "item_type",
        F.col("def.entity_kind").alias("entity_kind"),
        F.explode("def.fields").alias("field", "fdef"),
    ).select(
        "project_uuid",
        *STAMP,
        "item_type",
        "entity_kind",
        "field",
        F.col("fdef.kind").alias("field_kind"),
        F.coalesce("fdef.required", F.lit(False)).alias("required"),
    )


def field_table(log: DataFrame) -> DataFrame:
    """Declared fields per type under the latest schema of each project.

    A field event applies to every type of its kind, or makes the first type of it.
    Definitions are reduced per field before they meet the types.
    """
    reset = (
        log.where(F.col("kind").isin(INIT, SNAPSHOT))
        .groupBy("project_uuid")
        .agg(F.max(order_key()).alias("since"))
    )
    in_body = (
        body_fields(log)
        .join(reset, "project_uuid")
        .where(F.col("event_uuid") == F.col("since.event_uuid"))
    )
    added = (
        lww(
            log.where(F.col("kind") == ADD_FIELD),
            ["project_uuid", "entity_kind", "field"],
            ["field_kind", "required"],
        )
        .join(reset, "project_uuid")
        .where(order_key() > F.col("since"))
    )
    types = in_body.select("project_uuid", "entity_kind", "item_type").distinct()
    first = F.element_at(F.create_map(*[F.lit(x) for p in FIRST_TYPE.items() for x in p]), F.col("entity_kind"))
    wide = added.join(types, ["project_uuid", "entity_kind"], "left").withColumn(
        "item_type", F.coalesce("item_type", first)
    )
    columns = ["project_uuid", "entity_kind", "item_type", "field", "field_kind", "required", *STAMP]
    return lww(
        in_body.select(columns).unionByName(wide.select(columns)),
        ["project_uuid", "entity_kind", "item_type", "field"],
        ["field_kind", "required"],
    )


def migrations(log: DataFrame) -> DataFrame:
    """All other migrations as registers: ``(project, register, name, value, live)``.

    A rename writes twice: its old name as gone, its new name as live.
    """
    kind = F.col("kind")

    def write(register: str, name, value, live: bool):
        return F.struct(
            F.lit(register).alias("register"),
            name.alias("name"),
            value.cast("string").alias("value"),
            F.lit(live).alias("live"),
        )

    of_type = lambda c: F.concat_ws(".", "type_name", c)
    of_enum = lambda c: F.concat_ws(".", "enum_name", c)
    none = F.lit(None)
    writes = (
        F.when(kind == "schema.add-item-type", F.array(write("item_type", F.col("type_name"), F.col("entity_kind"), True)))
        .when(kind == "schema.remove-field", F.array(write("field", of_type("field"), none, False)))
        .when(
            kind == "schema.rename-field",
            F.array(
                write("field", of_type("field"), none, False),
                write("field", of_type("new_field"), F.col("field"), True),
            ),
        )
        .when(kind == "schema.change-field-type", F.array(write("field", of_type("field"), F.col("field_kind"), True)))
        .when(kind == "schema.add-enum-value", F.array(write("enum", of_enum("enum_value"), none, True)))
        .when(
            kind == "schema.rename-enum-value",
            F.array(
                write("enum", of_enum("enum_value"), none, False),
                write("enum", of_enum("new_value"), F.col("enum_value"), True),
            ),
        )
        .when(kind == "schema.add-relation-kind", F.array(write("relation_kind", F.col("relation_kind"), none, True)))
        .when(kind == "schema.set-compatibility", F.array(write("compatibility", F.lit("policy"), F.col("policy"), True)))
    )
    rows = log.select("project_uuid", *STAMP, F.explode(writes).alias("w")).select(
        "project_uuid", *STAMP, "w.*"
    )
    return lww(rows, ["project_uuid", "register", "name"], ["value", "live"])
