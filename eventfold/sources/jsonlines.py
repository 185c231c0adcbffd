"""Event logs as JSON lines: decode, bad-record table, cut-off per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.functions.kinds import ALL_KINDS
from eventfold.functions.stamps import instant_us, is_ulid, parse_hlc
from eventfold.functions.values import is_actor
from eventfold.operators.hub import before_first_bad

# The wire envelope. The payload stays text and is decoded by kind.
ENVELOPE = (
    "event_uuid string, workspace_uuid string, project_uuid string, node_uuid string, "
    "actor string, stream_id string, stream_seq bigint, hlc string, deps array<string>, "
    "schema_version string, kind string, payload string"
)
REQUIRED = (
    "event_uuid",
    "workspace_uuid",
    "project_uuid",
    "node_uuid",
    "actor",
    "stream_id",
    "stream_seq",
    "hlc",
    "schema_version",
    "kind",
    "payload",
)
# One union of all payload shapes.
PAYLOAD = (
    "entity_uuid string, entity_kind string, item_type string, "
    "field string, value string, delta bigint, label string, user string, state_key string, "
    "comment_uuid string, author string, body_markdown string, kind string, directed_at string, "
    "replaces string, relation_uuid string, relation_kind string, from_entity_uuid string, "
    "to_entity_uuid string, attrs map<string,string>, executor string, claim_expires_at string, "
    "node_uuid string, entity_type string, definition string, schema_version string, snapshot string, "
    "compatibility string, schema string"
)
DEFINITION = "type string, enum_name string, required boolean"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line_text")


def decode_lines(lines: DataFrame, column: str = "line_text") -> DataFrame:
    """Adds ``e`` (the envelope) and ``status``: ``good``, ``blank``, or what is bad, that is
    ``malformed``, ``unknown_kind`` or a problem of ``check_stamps``.

    A line must be one JSON value and nothing else. JSON readers stop after the first
    value, so the line is read inside an array (two values, or text after the first,
    break it or make it longer) and inside an object (a closing bracket breaks it).
    """
    line = F.trim(F.col(column))
    inside = F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"array<struct<{_typed(ENVELOPE)}>>")
    whole = F.try_parse_json(F.concat(F.lit('{"r":'), line, F.lit("}"))).isNotNull()
    # A generator keeps filters on the status above the parse: one parse per line.
    parsed = lines.select(
        *lines.columns,
        (F.length(line) == 0).alias("__blank"),
        F.inline(F.array(F.struct(inside.alias("__list"), whole.alias("__whole")))),
    )
    event = F.get(F.col("__list"), F.lit(0))
    complete = F.lit(True)
    for name in REQUIRED:
        complete = complete & event[name].isNotNull()
    version = event["schema_version"].rlike(r"^\d+$")
    status = (
        F.when(F.col("__blank"), F.lit("blank"))
        .when(F.coalesce(~F.col("__whole") | (F.size("__list") != 1) | ~complete | ~version, F.lit(True)), F.lit("malformed"))
        .when(~event["kind"].isin(*ALL_KINDS), F.lit("unknown_kind"))
        .otherwise(F.coalesce(stamp_problem(parse_hlc(event["hlc"]), event), F.lit("good")))
    )
    return parsed.select(*lines.columns, event.alias("e"), status.alias("status"))


def _typed(ddl: str) -> str:
    return ", ".join(":".join(part.split(" ", 1)) for part in ddl.split(", "))


def is_bad() -> Column:
    return ~F.col("status").isin("good", "blank")


def split_good_bad(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelopes, and the bad-record table. Blank lines are in neither."""
    good = decoded.where(F.col("status") == "good").select("e.*")
    bad = decoded.where(is_bad()).drop("e")
    return good, bad


def cut_batches(decoded: DataFrame) -> DataFrame:
    """Good rows of each batch before its first bad line; later ones do not commit."""
    rows = before_first_bad(decoded, is_bad())
    stands = F.col("first_bad").isNull() | (F.col("line") < F.col("first_bad"))
    return rows.where(stands & (F.col("status") == "good")).drop("first_bad")


def check_stamps(log: DataFrame) -> DataFrame:
    """Adds the parsed clock as ``stamp`` and ``problem``, NULL when all ids parse."""
    problem = stamp_problem(F.col("stamp"), {c: F.col(c) for c in ("event_uuid", "actor", "stream_id")})
    return log.withColumn("stamp", parse_hlc(F.col("hlc"))).withColumn("problem", problem)


def stamp_problem(stamp: Column, event) -> Column:
    return (
        F.when(stamp.isNull(), F.lit("bad_hlc"))
        .when(~is_ulid(event["event_uuid"]), F.lit("bad_event_id"))
        .when(~is_actor(event["actor"]), F.lit("bad_actor"))
        .when(~stream_ok(event["stream_id"]), F.lit("bad_stream"))
    )


def stream_ok(text: Column) -> Column:
    """``schema``, ``project`` or ``node|item|relation:<id>``."""
    return text.isin("schema", "project") | (
        text.rlike("^(node|item|relation):") & is_ulid(F.substring_index(text, ":", -1))
    )


def decode_payloads(log: DataFrame) -> DataFrame:
    """Payload text decoded by one union schema into the columns of the operators."""
    p = F.from_json("payload", PAYLOAD)
    return log.withColumn("p", p).select(
        *[c for c in log.columns if c != "payload"],
        F.col("p.entity_uuid").alias("entity_uuid"),
        F.coalesce("p.entity_kind", "p.entity_type").alias("entity_kind"),
        F.col("p.item_type").alias("item_type"),
        raw_fields(F.col("payload")).alias("fields"),
        F.col("p.field").alias("field"),
        raw_value(F.col("payload")).alias("value"),
        F.col("p.delta").alias("delta"),
        F.coalesce("p.label", "p.user").alias("member"),
        F.col("p.state_key").alias("state_key"),
        F.col("p.comment_uuid").alias("comment_uuid"),
        F.col("p.author").alias("author"),
        F.col("p.body_markdown").alias("body"),
        F.col("p.kind").alias("comment_kind"),
        F.col("p.directed_at").alias("directed_at"),
        F.col("p.replaces").alias("replaces"),
        F.col("p.relation_uuid").alias("relation_uuid"),
        F.col("p.relation_kind").alias("relation_kind"),
        F.col("p.from_entity_uuid").alias("from_uuid"),
        F.col("p.to_entity_uuid").alias("to_uuid"),
        F.col("p.attrs").alias("attrs"),
        F.col("p.executor").alias("executor"),
        instant_us(F.col("p.claim_expires_at")).alias("expires_us"),
        *schema_payload(F.col("p")),
    )


def schema_payload(p: Column) -> list[Column]:
    """The columns of schema and node events (see ``operators.schema_time``)."""
    definition = F.from_json(p["definition"], DEFINITION)
    return [
        F.coalesce(p["schema"], p["snapshot"]).alias("schema_body"),
        p["compatibility"].alias("policy"),
        p["schema_version"].try_cast("bigint").alias("given_version"),
        definition["type"].alias("field_kind"),
        definition["required"].alias("required"),
        definition["enum_name"].alias("enum_name"),
        p["node_uuid"].alias("registered_node"),
    ]


def raw_value(payload: Column) -> Column:
    """The JSON form of ``value``: strings keep their quotes, so types stay visible."""
    return F.to_json(F.variant_get(F.try_parse_json(payload), "$.value", "variant"))


def raw_fields(payload: Column) -> Column:
    """``fields`` with the JSON form of each value, as ``raw_value``."""
    parsed = F.variant_get(F.try_parse_json(payload), "$.fields", "map<string,variant>")
    return F.transform_values(parsed, lambda _, v: F.to_json(v))


def flat_log(envelopes: DataFrame) -> DataFrame:
    """Good envelopes as the log the operators take: clock fields and payload, row by row."""
    flat = envelopes.withColumn("stamp", parse_hlc(F.col("hlc"))).select(
        "event_uuid",
        "workspace_uuid",
        "project_uuid",
        "node_uuid",
        "actor",
        "stream_id",
        "stream_seq",
        F.col("stamp.us").alias("hlc_us"),
        F.col("stamp.ns").alias("hlc_ns"),
        F.col("stamp.node").alias("hlc_node"),
        F.col("stamp.seq").alias("hlc_seq"),
        "deps",
        F.col("schema_version").cast("bigint").alias("schema_version"),
        "kind",
        "payload",
    )
    return decode_payloads(flat)
