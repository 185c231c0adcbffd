"""JSON scalars, declared field kinds and id shapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventfold.functions.stamps import ULID, instant_us

# Which stored value type each declared field kind accepts.
ACCEPTED = {
    "text": "string",
    "url": "string",
    "email": "string",
    "enum": "string",
    "number": "integer",
    "counter": "integer",
    "decimal": "decimal",
    "boolean": "boolean",
    "date": "date",
    "date_time": "datetime",
    "member": "member",
    "entity_ref": "entity_ref",
}
LONG_MAX, LONG_MIN = 9223372036854775807, -9223372036854775808
# Shapes of actors and JSON numbers, scheme of entity references.
URN_SCHEME = "work"
ACTOR = r"(?s)^(user|agent):.+$"
NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def json_text(value: Column) -> Column:
    """The text of a JSON string scalar, escapes resolved."""
    return F.when(
        value.startswith('"'),
        F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"),
    )


def is_actor(text: Column) -> Column:
    return text.rlike(ACTOR)


def is_entity_ref(text: Column) -> Column:
    part = F.split(text, ":")
    return (
        (F.size(part) == 3)
        & (F.get(part, F.lit(0)) == URN_SCHEME)
        & (F.length(F.get(part, F.lit(1))) > 0)
        & F.upper(F.get(part, F.lit(2))).rlike(ULID)
    )


def json_type(value: Column) -> Column:
    """Type of a value without a declaration, by its JSON form."""
    return (
        F.when(value.isNull(), F.lit("cleared"))
        .when(value.startswith('"'), F.lit("string"))
        .when(value.isin("true", "false"), F.lit("boolean"))
        .when(value.rlike(r"^-?\d+$") & value.try_cast("bigint").isNotNull(), F.lit("integer"))
        .when(value.rlike(NUMBER), F.lit("decimal"))
        .otherwise(F.lit("json"))
    )


def truncated_long(value: Column) -> Column:
    """A JSON number as a long: exact when it is one, else truncated and clamped."""
    number = value.try_cast("double")
    return F.coalesce(
        F.when(value.rlike(r"^-?\d+$"), value.try_cast("bigint")),
        F.when(number >= float(LONG_MAX), F.lit(LONG_MAX))
        .when(number <= float(LONG_MIN), F.lit(LONG_MIN))
        .otherwise(number.try_cast("bigint")),
    )


def coerce(value: Column, kind: Column) -> Column:
    """A write checked against its declared kind: ``struct(value_type, stored, error)``.

    ``stored`` is the text form of the typed value. A NULL kind means an undeclared
    field, typed by its JSON form. ``error`` names why a value does not fit.
    """
    text, shape = json_text(value), json_type(value)
    is_number = shape.isin("integer", "decimal")

    def out(kind_type: str, stored: Column) -> Column:
        return F.struct(
            F.lit(kind_type).alias("value_type"),
            stored.alias("stored"),
            F.lit(None).cast("string").alias("error"),
        )

    def bad(reason: str) -> Column:
        return F.struct(
            F.lit(None).cast("string").alias("value_type"),
            F.lit(None).cast("string").alias("stored"),
            F.lit(reason).alias("error"),
        )

    return (
        F.when(
            kind.isNull(),
            F.struct(
                shape.alias("value_type"),
                F.coalesce(text, value).alias("stored"),
                F.lit(None).cast("string").alias("error"),
            ),
        )
        .when(kind == "counter", bad("counter_scalar_set"))
        .when(
            kind.isin("text", "url", "email", "enum"),
            F.when(text.isNotNull(), out("string", text)).otherwise(bad("expected_string")),
        )
        .when(
            kind == "number",
            F.when(is_number, out("integer", truncated_long(value).cast("string"))).otherwise(
                bad("expected_integer")
            ),
        )
        .when(
            kind == "decimal",
            F.when(is_number, out("decimal", value)).otherwise(bad("expected_decimal")),
        )
        .when(
            kind == "boolean",
            F.when(shape == "boolean", out("boolean", value)).otherwise(bad("expected_boolean")),
        )
        .when(
            kind == "date",
            F.when(text.isNotNull(), out("date", text)).otherwise(bad("expected_date")),
        )
        .when(
            kind == "date_time",
            F.when(instant_us(text).isNotNull(), out("datetime", text)).otherwise(
                bad("expected_datetime")
            ),
        )
        .when(
            kind == "member",
            F.when(is_actor(text), out("member", text)).otherwise(bad("expected_member")),
        )
        .when(
            kind == "entity_ref",
            F.when(is_entity_ref(text), out("entity_ref", text)).otherwise(
                bad("expected_entity_ref")
            ),
        )
        .otherwise(bad("unknown_kind"))
    )


def kind_accepts(kind: Column, value_type: Column) -> Column:
    """Whether a stored value type fits a declared kind."""
    table = F.create_map(*[F.lit(x) for pair in ACCEPTED.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind) == value_type, F.lit(False))
