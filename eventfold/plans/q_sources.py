"""Queries: reading, decoding, writing, exporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.operators import edges, registers, sets, threads
from eventfold.operators.skew import list_parts
from eventfold.plans.adapters import (
    edge_log,
    item_changes,
    item_log,
    padded,
    parted,
    table,
    tag,
    talk_log,
    text,
    with_k,
    with_parts,
)
from eventfold.plans.q_edges import DIRECTED
from eventfold.plans.q_items import AS_OF_US, FIELD_STATE, HEADERS, ITEM_FIELDS, MEMBERS, SET_STATE
from eventfold.plans.registry import query
from eventfold.plans.q_talks import COMMENTS
from eventfold.session import fresh_path
from eventfold.sources import exports, jsonlines, logs


@query(
    "s1_scan_log",
    with_parts(
        ["changes"],
        "SELECT event_uuid, kind, stream_seq FROM changes WHERE project_uuid = 'P2' AND kind = 'item.set-field'",
    ),
)
def scan_log(spark, sf):
    """One project read from a log partitioned by project and day."""
    path = fresh_path(spark, "log")
    logs.write(item_changes(table(spark, sf, "events")), path)
    return logs.scan(spark, path, "P2").where("kind = 'item.set-field'").select("event_uuid", "kind", "stream_seq")


def stamp_text(i, us, node):
    """Clock texts of many shapes: offsets, nanoseconds, and broken ones."""
    at = lambda u, f: F.date_format(F.timestamp_micros(u), f)
    plain = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    good = F.concat(at(us, plain), F.lit("Z"))
    tail = F.concat(F.lit("/"), node, F.lit("/"), F.lpad(text(i % 7), 4, "0"))
    shape = i % 10
    return (
        F.when(shape == 1, F.concat(at(us + 7_200_000_000, plain), F.lit("+02:00"), tail))
        .when(shape == 2, F.concat(at(us, plain), F.lit("789Z"), tail))
        .when(shape == 3, F.concat(good, F.lit("/"), node))
        .when(shape == 4, F.concat(F.lit("2026-13-01T00:00:00Z"), tail))
        .when(shape == 5, F.concat(good, F.lit("/not-a-node/0001")))
        .when(shape == 6, F.concat(good, F.lit("/"), node, F.lit("/x1")))
        .when(shape == 7, F.concat(good, F.lower(tail)))
        .when(shape == 8, F.concat(good, tail, F.lit("/9")))
        .otherwise(F.concat(good, tail))
    )


def event_lines(spark, sf):
    """Event rows as wire lines in batches of twenty, some of them damaged."""
    i, k = F.col("event_id"), F.col("k")
    node = F.concat(F.lit("01KZQ3V7WD5RN"), F.lpad(text(i % 3), 13, "0"))
    entity = F.concat(F.lit("01KZQ3V7WD5RZ"), F.lpad(text(F.col("user_id")), 13, "0"))
    kind = F.when(i % 50 == 11, F.lit("item.explode")).otherwise(F.lit("item.adjust-field"))
    seq = F.when(i % 50 == 15, F.lit("9223372036854775808")).otherwise(text(i))
    line = F.concat(
        F.lit('{"event_uuid":"'), padded(i),
        F.lit('","workspace_uuid":"W0","project_uuid":"P'), text(F.col("user_id") % 5),
        F.lit('","node_uuid":"'), node, F.lit('","actor":"user:u1","stream_id":"item:'), entity,
        F.lit('","stream_seq":'), seq,
        F.lit(',"hlc":"'), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit("Z/"), node, F.lit("/"), F.lpad(text(i % 7), 4, "0"),
        F.lit('","deps":[],"schema_version":"1","kind":"'), kind,
        F.lit('","payload":{"entity_uuid":"'), entity,
        F.lit('","field":"spend","delta":'), text(k - 50), F.lit("}}"),
    )
    shape = i % 50
    damaged = (
        F.when(shape == 7, F.substring(line, 1, 40))
        .when(shape == 9, F.concat(line, F.lit(" trailing")))
        .when(shape == 13, F.lit("  "))
        .when(shape == 17, F.concat(line, F.lit(","), line))
        .otherwise(line)
    )
    return with_k(table(spark, sf, "events")).select(
        F.floor(i / 20).alias("batch"), (i % 20).alias("line"), damaged.alias("line_text")
    )


STATUS_SQL = """SELECT event_id, user_id, k, us, event_id // 20 AS batch, event_id % 20 AS line,
  CASE WHEN event_id % 50 IN (7, 9, 15, 17) THEN 'malformed' WHEN event_id % 50 = 13 THEN 'blank'
  WHEN event_id % 50 = 11 THEN 'unknown_kind' ELSE 'good' END AS status FROM ev"""


@query(
    "s2_json_lines",
    with_parts(
        ["ev"],
        """SELECT status, CASE WHEN status = 'good' THEN lpad(CAST(event_id AS VARCHAR), 26, '0') END AS event_uuid,
        CASE WHEN status = 'good' THEN event_id END AS stream_seq FROM lines WHERE status <> 'blank'""",
        {"lines": STATUS_SQL},
    ),
)
def json_lines(spark, sf):
    """Lines written as text files, read back and split into envelopes and bad records."""
    path = fresh_path(spark, "lines")
    event_lines(spark, sf).select("line_text").write.text(path)
    good, bad = jsonlines.split_good_bad(jsonlines.decode_lines(jsonlines.read_lines(spark, path)))
    none = F.lit(None)
    return good.select(F.lit("good").alias("status"), "event_uuid", "stream_seq").unionByName(
        bad.select("status", none.cast("string").alias("event_uuid"), none.cast("bigint").alias("stream_seq"))
    )


@query(
    "s3_batch_cut_off",
    with_parts(
        ["ev"],
        """SELECT batch, line, lpad(CAST(event_id AS VARCHAR), 26, '0') AS event_uuid FROM lines l WHERE status = 'good'
        AND line < coalesce((SELECT min(line) FROM lines b WHERE b.batch = l.batch AND b.status IN ('malformed', 'unknown_kind')), 100000)""",
        {"lines": STATUS_SQL},
    ),
)
def batch_cut_off(spark, sf):
    """Rows that commit: nothing after the first bad line of a batch."""
    rows = jsonlines.cut_batches(jsonlines.decode_lines(event_lines(spark, sf)))
    return rows.select("batch", "line", "e.event_uuid")


@query(
    "s4_clock_decode",
    with_parts(
        ["ev"],
        """SELECT event_id, us IS NOT NULL AND event_id % 10 NOT IN (3, 4, 5, 6, 8) AS parsed,
        CASE WHEN event_id % 10 NOT IN (3, 4, 5, 6, 8) THEN us END AS hlc_us,
        CASE WHEN event_id % 10 = 2 THEN 789 WHEN event_id % 10 NOT IN (3, 4, 5, 6, 8) THEN 0 END AS hlc_ns,
        CASE WHEN event_id % 10 NOT IN (3, 4, 5, 6, 8) THEN '01KZQ3V7WD5RN' || lpad(CAST(event_id % 3 AS VARCHAR), 13, '0')
          END AS hlc_node, CASE WHEN event_id % 10 NOT IN (3, 4, 5, 6, 8) THEN event_id % 7 END AS hlc_seq FROM ev""",
    ),
)
def clock_decode(spark, sf):
    """Clock texts to instant, nanoseconds, node and counter; broken ones are NULL."""
    i = F.col("event_id")
    node = F.concat(F.lit("01KZQ3V7WD5RN"), F.lpad(text(i % 3), 13, "0"))
    rows = with_k(table(spark, sf, "events")).select(
        "event_id",
        padded(i).alias("event_uuid"),
        F.lit("user:u1").alias("actor"),
        F.lit("schema").alias("stream_id"),
        stamp_text(i, F.col("us"), node).alias("hlc"),
    )
    checked = jsonlines.check_stamps(rows)
    return checked.select(
        "event_id",
        F.col("problem").isNull().alias("parsed"),
        F.col("stamp.us").alias("hlc_us"),
        F.col("stamp.ns").alias("hlc_ns"),
        F.col("stamp.node").alias("hlc_node"),
        F.col("stamp.seq").alias("hlc_seq"),
    )


def payload_text(log):
    """The decoded log's payload columns as JSON text, as they are on the wire."""
    kind = F.col("kind")
    is_label = kind.isin("item.add-label", "item.remove-label")
    pair = lambda name, col: F.concat(F.lit(f'"{name}":"'), col, F.lit('"'))
    parts = F.concat_ws(
        ",",
        pair("entity_uuid", F.col("entity_uuid")),
        pair("field", F.col("field")),
        F.concat(F.lit('"value":'), F.col("value")),
        F.concat(F.lit('"delta":'), text(F.col("delta"))),
        F.when(is_label, pair("label", F.col("member"))),
        F.when(~is_label, pair("user", F.col("member"))),
        pair("state_key", F.col("state_key")),
    )
    return F.concat(F.lit("{"), parts, F.lit("}"))


@query(
    "s5_payload_decode",
    with_parts(
        ["changes"],
        """SELECT event_uuid, 'work' AS class, kind, entity_uuid, field, value, delta, member, state_key FROM changes""",
    ),
)
def payload_decode(spark, sf):
    """Events classified and their payload text decoded by kind."""
    from eventfold.functions.kinds import event_class

    log = item_changes(table(spark, sf, "events"))
    wire = log.select("event_uuid", "kind", payload_text(log).alias("payload"))
    return jsonlines.decode_payloads(wire).select(
        "event_uuid",
        event_class(F.col("kind")).alias("class"),
        "kind",
        "entity_uuid",
        "field",
        "value",
        "delta",
        "member",
        "state_key",
    )


@query(
    "s7_append_log",
    with_parts(["changes"], "SELECT event_uuid, project_uuid, kind FROM changes"),
)
def append_log(spark, sf):
    """Two overlapping deliveries written to one log: each event is stored once."""
    path = fresh_path(spark, "log")
    log = item_changes(table(spark, sf, "events"))
    logs.write(logs.new_events(log.where("schema_version = 1 or hlc_seq = 1"), None), path)
    logs.write(logs.new_events(log, spark.read.parquet(path)), path)
    return spark.read.parquet(path).select("event_uuid", "project_uuid", "kind")


def label_view(log):
    """Header and fields of every item with its labels."""
    members = sets.active_members(sets.or_set(sets.set_operations(log)))
    labels = list_parts(
        members.where("set_name = 'labels'"), ["entity_uuid"], F.col("member"), "labels"
    )
    return registers.item_fields(log, ITEM_FIELDS).join(labels, "entity_uuid", "left").withColumn("part", F.coalesce("part", F.lit(0)))


DOCS = {
    "state": FIELD_STATE,
    "members": MEMBERS,
    "set_state": SET_STATE,
    "headers": HEADERS,
    "wide": "SELECT entity_uuid, "
    + ", ".join(f"max(CASE WHEN name = '{f}' THEN trim(written, '\"') END) AS {f}" for f in ITEM_FIELDS)
    + " FROM state WHERE written IS NOT NULL GROUP BY entity_uuid",
    "labelled": "SELECT entity_uuid, part, string_agg(member, ',' ORDER BY member) AS labels FROM "
    + parted("set_state WHERE is_add AND set_name = 'labels'", "entity_uuid", "member")
    + " GROUP BY entity_uuid, part",
}


@query(
    "s8_documents",
    with_parts(
        ["log", "writes"],
        """SELECT h.project_uuid, h.entity_uuid, h.item_type AS type, h.state_key AS state, title, f0, f1, f2, f3,
          coalesce(part, 0) AS part, labels FROM headers h LEFT JOIN wide w ON w.entity_uuid = h.entity_uuid LEFT JOIN labelled l ON l.entity_uuid = h.entity_uuid""",
        DOCS,
    ),
)
def item_documents(spark, sf):
    """Items written as JSON documents by project, then read back from the files."""
    path = fresh_path(spark, "documents")
    exports.write_documents(exports.documents(label_view(item_log(spark, sf)), ITEM_FIELDS), path)
    back = spark.read.text(path)
    schema = "entity_uuid string, type string, state string, title string, f0 string, f1 string, f2 string, f3 string, part int, labels array<string>"
    rows = back.select("project_uuid", F.from_json("value", schema).alias("d")).select("project_uuid", "d.*")
    return rows.withColumn("part", F.coalesce("part", F.lit(0))).withColumn("labels", F.array_join("labels", ","))


DOC_TEXT = """SELECT h.entity_uuid, '{' || concat_ws(',', '"entity_uuid":"' || h.entity_uuid || '"',
    '"type":"' || h.item_type || '"', '"state":"' || h.state_key || '"', """ + ", ".join(
    f"'\"{f}\":' || CAST(to_json({f}) AS VARCHAR)" for f in ITEM_FIELDS
) + """, '"labels":["' || replace(labels, ',', '","') || '"]') || '}' AS doc
  FROM headers{n} h LEFT JOIN wide{n} w ON w.entity_uuid = h.entity_uuid LEFT JOIN labelled{n} l ON l.entity_uuid = h.entity_uuid"""


def early(sql: str) -> str:
    """A document part over the log up to the as-of instant."""
    for name in ("state", "members", "set_state", "wide", "labelled", "headers"):
        sql = sql.replace(f"FROM {name}", f"FROM {name}_old")
    return sql.replace("FROM log", "FROM log_old").replace("FROM writes", "FROM writes_old")


@query(
    "s9_changed_documents",
    with_parts(
        ["log", "writes"],
        """SELECT n.entity_uuid, sha256(n.doc) AS hash, CASE WHEN o.doc IS NULL THEN 'new' ELSE 'changed' END AS change
        FROM now_docs n LEFT JOIN old_docs o ON o.entity_uuid = n.entity_uuid WHERE o.doc IS NULL OR o.doc <> n.doc""",
        {
            **DOCS,
            "log_old": f"SELECT * FROM log WHERE hlc_us <= {AS_OF_US}",
            "writes_old": f"SELECT * FROM writes WHERE hlc_us <= {AS_OF_US}",
            **{f"{k}_old": early(v) for k, v in DOCS.items()},
            "now_docs": DOC_TEXT.replace("{n}", ""),
            "old_docs": DOC_TEXT.replace("{n}", "_old"),
        },
    ),
)
def changed_documents(spark, sf):
    """Documents whose hash differs from the registry of an earlier export."""
    log = item_log(spark, sf)
    now = exports.documents(label_view(log), ITEM_FIELDS)
    last = exports.registry(exports.documents(label_view(registers.as_of(log, AS_OF_US)), ITEM_FIELDS))
    return exports.changed(now, last).select("entity_uuid", "hash", "change")


BUNDLE = {
    **DIRECTED,
    "comments": COMMENTS.replace("SELECT a.comment_uuid, a.entity_uuid", "SELECT a.comment_uuid, replace(a.entity_uuid, 'V', 'O') AS entity_uuid"),
    "ids": "SELECT 'O' || o_orderkey AS entity_uuid FROM orders WHERE o_orderpriority = '1-URGENT'",
    "touched": "SELECT * FROM directed WHERE entity_uuid IN (SELECT entity_uuid FROM ids)",
    "near": "SELECT entity_uuid FROM ids UNION SELECT peer_uuid FROM touched",
}


@query(
    "s10_export_bundle",
    with_parts(
        ["edges", "talks"],
        """SELECT 'item' AS part, entity_uuid, entity_uuid AS ref FROM near
        UNION ALL SELECT 'relation', entity_uuid, relation_uuid FROM touched
        UNION ALL SELECT 'comment', entity_uuid, comment_uuid FROM comments WHERE entity_uuid IN (SELECT entity_uuid FROM near)""",
        BUNDLE,
    ),
)
def export_bundle(spark, sf):
    """Urgent items with their edges, the items one hop away and all their comments."""
    items = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(tag("O", F.col("o_orderkey")).alias("entity_uuid"))
    talk = threads.comments(talk_log(spark, sf)).withColumn("entity_uuid", F.translate("entity_uuid", "V", "O"))
    links = edges.directed(edges.relations(edge_log(spark, sf)))
    return exports.bundle(items, links, talk, "full")
