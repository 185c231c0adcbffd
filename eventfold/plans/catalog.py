"""The declared item schema the checks run against: small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Projects and their schema version and policy. P3 has no schema.
PROJECTS = [
    ("P0", 2, "strict"),
    ("P1", 2, "strict"),
    ("P2", 2, "strict"),
    ("P4", 1, "additive"),
]
# Fixed values: (entity_kind, item_type, field, field_kind, enum_name, required).
FIELDS = [
    ("issue", "bug", "title", "text", None, True),
    ("issue", "bug", "f0", "text", None, False),
    ("issue", "bug", "f1", "number", None, True),
    ("issue", "bug", "f2", "enum", "priority", False),
    ("issue", "bug", "f3", "boolean", None, False),
    ("issue", "bug", "spend", "counter", None, False),
    ("issue", "task", "title", "text", None, True),
    ("issue", "task", "f0", "date_time", None, False),
    ("issue", "task", "f1", "decimal", None, False),
    ("issue", "task", "f2", "enum", "ghost", False),
    ("issue", "task", "spend", "counter", None, False),
    ("effort", "sprint", "title", "text", None, True),
    ("effort", "sprint", "f0", "member", None, False),
    ("effort", "sprint", "f1", "date", None, False),
    ("effort", "sprint", "f2", "enum", None, False),
    ("component", "module", "title", "text", None, True),
    ("component", "module", "f0", "url", None, False),
    ("component", "module", "f1", "entity_ref", None, False),
    ("component", "module", "f3", "email", None, False),
    ("component", "module", "spend", "number", None, False),
]
# Members of the declared enums.
ENUMS = [("priority", "low"), ("priority", "medium"), ("priority", "high")]
# States, their groups.
GROUPS = [
    ("Backlog", "backlog"),
    ("Todo", "unstarted"),
    ("In Progress", "started"),
    ("Needs Input", "started"),
    ("Done", "completed"),
    ("Cancelled", "cancelled"),
]
# Allowed state changes.
TRANSITIONS = [
    ("Backlog", "Todo"),
    ("Todo", "In Progress"),
    ("In Progress", "Needs Input"),
    ("Needs Input", "In Progress"),
    ("In Progress", "Done"),
    ("Todo", "Cancelled"),
]
# Entity kinds a relation kind may join.
RELATION_KINDS = [
    ("blocks", "issue", "issue"),
    ("requires", "issue", "issue"),
    ("extends", "issue", "component"),
    ("duplicates", "issue", "issue"),
    ("parent", "issue", "effort"),
]


def projects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROJECTS, "project_uuid string, version bigint, policy string")


def schema_fields(spark: SparkSession) -> DataFrame:
    rows = [(p, *f) for p, _, _ in PROJECTS for f in FIELDS]
    return spark.createDataFrame(
        rows,
        "project_uuid string, entity_kind string, item_type string, field string, "
        "field_kind string, enum_name string, required boolean",
    )


def enums(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENUMS, "enum_name string, enum_value string")


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUPS, "state_key string, state_group string")


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "from_state string, to_state string")


def relation_kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RELATION_KINDS, "relation_kind string, from_kind string, to_kind string"
    )


def _values(rows: list[tuple], columns: str) -> str:
    def lit(x) -> str:
        if x is None:
            return "CAST(NULL AS VARCHAR)"
        if isinstance(x, bool):
            return str(x).upper()
        return f"CAST({x} AS BIGINT)" if isinstance(x, int) else f"'{x}'"

    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


SQL = {
    "projects": _values(PROJECTS, "project_uuid, version, policy"),
    "schema_fields": "SELECT project_uuid, f.* FROM ("
    + _values(PROJECTS, "project_uuid, version, policy")
    + ") p, ("
    + _values(FIELDS, "entity_kind, item_type, field, field_kind, enum_name, required")
    + ") f",
    "enums": _values(ENUMS, "enum_name, enum_value"),
    "groups": _values(GROUPS, "state_key, state_group"),
    "transitions": _values(TRANSITIONS, "from_state, to_state"),
    "relation_kinds": _values(RELATION_KINDS, "relation_kind, from_kind, to_kind"),
}
