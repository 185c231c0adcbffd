"""JSON lines, clock texts, value coercion, exports."""

import json

from pyspark.sql import functions as F

from eventfold import api
from eventfold.functions.stamps import format_hlc, parse_hlc
from eventfold.functions.values import coerce, is_entity_ref, json_type
from eventfold.operators import registers
from eventfold.operators.index import ulid_time
from eventfold.session import fresh_path
from eventfold.sources import exports, jsonlines, logs

NODE = "01KZQ3V7WD5RN0000000000000"
EVENT = {
    "event_uuid": "01KB2N9TXA6HEVS0RMW4FJ8C32",
    "workspace_uuid": "01KZQ3V7WD5RW0000000000000",
    "project_uuid": "01KZQ3V7WD5RP0000000000000",
    "node_uuid": NODE,
    "actor": "agent:sorter",
    "stream_id": "item:01KZQ3V7WD5RZ0000000000000",
    "stream_seq": 7,
    "hlc": f"2025-03-02T08:14:09.512Z/{NODE}/0007",
    "schema_version": "5",
    "kind": "item.create",
    "payload": {"entity_uuid": "E1", "entity_kind": "issue", "item_type": "Task", "fields": {"title": "A \"b\"", "n": 3, "j": {"a": [1]}}},
}


def decoded(spark, lines):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(lines)], "batch int, line int, line_text string")
    return jsonlines.decode_lines(df)


def test_every_kind_of_bad_line(spark):
    good = json.dumps(EVENT)
    lines = [
        good,
        good[:50],
        good + " tail",
        good + "," + good,
        good + good,
        good + "],[1",
        good + '},"x":{"a":1',
        "",
        json.dumps({**EVENT, "kind": "item.explode"}),
        json.dumps({**EVENT, "stream_seq": 2**63}),
        json.dumps({k: v for k, v in EVENT.items() if k != "actor"}),
        "[1]",
        "null",
    ]
    got = [r.status for r in decoded(spark, lines).orderBy("line").collect()]
    assert got == ["good"] + ["malformed"] * 6 + ["blank", "unknown_kind"] + ["malformed"] * 4


def test_every_line_is_good_bad_or_blank(spark):
    wrong = {"hlc": "2026-13-01T00:00:00Z/x/1", "event_uuid": "no-id", "actor": "nobody", "stream_id": "item:7"}
    rows = decoded(spark, [json.dumps(EVENT), " ", *[json.dumps({**EVENT, k: v}) for k, v in wrong.items()]])
    good, bad = jsonlines.split_good_bad(rows)
    assert sorted(r.status for r in bad.collect()) == ["bad_actor", "bad_event_id", "bad_hlc", "bad_stream"]
    assert jsonlines.flat_log(good).count() == good.count() == 1
    later = decoded(spark, [json.dumps({**EVENT, "hlc": wrong["hlc"]}), json.dumps(EVENT)])
    assert jsonlines.cut_batches(later).count() == 0


def test_nothing_after_the_first_bad_line(spark):
    line = lambda n: json.dumps({**EVENT, "stream_seq": n})
    rows = decoded(spark, [line(0), "", line(2), "{", line(4)])
    assert [r.line for r in jsonlines.cut_batches(rows).orderBy("line").collect()] == [0, 2]


def test_wire_log_reduces(spark):
    wire = [
        EVENT,
        {**EVENT, "event_uuid": "01KB2N9TXA6HEVS0RMW4FJ8C33", "kind": "item.set-field",
         "hlc": f"2025-03-02T10:19:00+02:00/{NODE}/0001", "payload": {"entity_uuid": "E1", "field": "n", "value": "5"}},
    ]
    good, bad = jsonlines.split_good_bad(decoded(spark, [json.dumps(e) for e in wire]))
    log = jsonlines.flat_log(good)
    state = {r.field: (r.value, r.value_type) for r in registers.field_state(log).collect()}
    assert bad.count() == 0
    assert state["n"] == ('"5"', "string")
    assert state["j"] == ('{"a":[1]}', "json")


def test_wire_lines_go_through_the_whole_pipeline(spark):
    """Schema, typed writes, errors, conflicts and node events, all from JSON lines."""
    wire, item = [], {"entity_uuid": "E1"}

    def line(kind, payload, schema_version="1"):
        n = len(wire)
        wire.append({**EVENT, "event_uuid": f"01KB2N9TXA6HEVS0RMW4FJ8C{n:02d}", "kind": kind, "payload": payload, "stream_seq": n,
                     "hlc": f"2025-03-02T08:{n:02d}:00Z/{NODE}/0001", "schema_version": schema_version})

    types = {"bug": {"entity_kind": "issue", "fields": {"title": {"type": "text", "required": True}, "size": {"type": "counter"}}}}
    line("item.create", {**item, "entity_kind": "issue", "item_type": "bug", "fields": {"title": "A \"b\""}})
    line("schema.init", {"compatibility": "strict", "schema": {"version": "1", "item_types": types, "enums": {"level": {"values": ["low"]}}}})
    line("schema.add-field", {"entity_type": "issue", "field": "level", "definition": {"type": "enum", "enum_name": "level"}})
    line("item.set-field", {**item, "field": "level", "value": "low"})
    line("item.set-field", {**item, "field": "level", "value": 3})
    line("item.adjust-field", {**item, "field": "size", "delta": 2})
    line("item.set-field", {**item, "field": "level", "value": "odd"})
    line("item.set-field", {**item, "field": "due", "value": {"a": 1}}, "9")
    line("node.register", {"node_uuid": NODE})
    good, bad = jsonlines.split_good_bad(decoded(spark, [json.dumps(e) for e in wire]))
    out = api.reduce_log(jsonlines.flat_log(good))
    fates = [r.outcome for r in out["outcomes"].orderBy("event_uuid").collect()]
    assert bad.count() == 0
    assert fates == [
        "applied", "schema_updated", "schema_updated", "applied", "error", "applied", "conflict", "quarantined", "node_registered"
    ]
    assert {(r.field, r.value_type, r.stored) for r in out["fields"].collect()} == {
        ("title", "string", 'A "b"'), ("level", "string", "odd"), ("size", "integer", "2"),
    }
    assert [(r.conflict_type, r.field) for r in out["conflicts"].collect()] == [("unknown_enum_value", "level")]


def test_readme_example(spark):
    """The first code block of the README, on lines with a claim."""
    claim = {**EVENT, "event_uuid": EVENT["event_uuid"][:-1] + "5", "kind": "item.claim",
             "payload": {"entity_uuid": "E1", "executor": "agent:a", "claim_expires_at": "2025-03-02T09:00:00Z"}}
    schema = {**EVENT, "event_uuid": EVENT["event_uuid"][:-1] + "6", "kind": "schema.snapshot", "stream_id": "schema",
              "hlc": f"2025-03-02T08:00:00Z/{NODE}/0001",
              "payload": {"schema_version": "5", "snapshot": {"item_types": {"Task": {"entity_kind": "issue", "fields": {}}}}}}
    path = fresh_path(spark, "lines")
    spark.createDataFrame([(json.dumps(e),) for e in (EVENT, claim, schema)], "value string").coalesce(1).write.text(path)
    with open("README.md") as file:
        code = file.read().split("```python\n")[1].split("```")[0].replace("/data/logs", path)
    names = {"spark": spark}
    exec(code, names)  # noqa: S102  our own README
    assert names["state"]["headers"].count() == 1


def test_clock_texts(spark):
    texts = [
        f"2025-03-02T08:14:09.512Z/{NODE}/0007",
        f"2025-03-02T10:14:09.512+02:00/{NODE.lower()}/7",
        f"2025-03-02T08:14:09.512000123Z/{NODE}/0007",
        f"2025-03-02T08:14:09Z/{NODE}",
        f"2026-02-30T17:35:21Z/{NODE}/1",
        f"2025-03-02T08:14:09Z/{NODE}/x",
        "2025-03-02T08:14:09Z/short/1",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in df.select("i", parse_hlc(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got[0] == got[1] and got[2].us == got[0].us and got[2].ns == 123
    assert got[3:] == [None] * 4
    back = df.limit(1).select(format_hlc(F.lit(got[0].us), F.lit(NODE), F.lit(7)).alias("t")).collect()[0].t
    assert back == f"2025-03-02T08:14:09.512000Z/{NODE}/0007"


def test_coercion_table(spark):
    cases = [
        ('"a"', "text", "string", "a"), ("1", "text", None, None), ("7", "number", "integer", "7"),
        ("-7.9", "number", "integer", "-7"), ("1e30", "number", "integer", str(2**63 - 1)), ("1", "counter", None, None),
        ("2", "decimal", "decimal", "2"), ("true", "boolean", "boolean", "true"), ('"x"', "date", "date", "x"),
        ('"2026-01-01T00:00:00Z"', "date_time", "datetime", "2026-01-01T00:00:00Z"), ('"2026-01-01"', "date_time", None, None),
        ('"user:a"', "member", "member", "user:a"), ('"bot:a"', "member", None, None), ('"user:"', "member", None, None),
        (f'"work:issue:{NODE}"', "entity_ref", "entity_ref", f"work:issue:{NODE}"), ('{"a":1}', None, "json", '{"a":1}'),
        ('"q\\"x"', None, "string", 'q"x'), ("12345678901234567890", None, "decimal", "12345678901234567890"),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, v string, k string")
    rows = df.select("i", coerce(F.col("v"), F.col("k")).alias("c")).orderBy("i").collect()
    assert [(r.c.value_type, r.c.stored) for r in rows] == [c[2:] for c in cases]
    assert df.where(json_type(F.col("v")).isNull()).count() == 0
    assert df.where(is_entity_ref(F.lit("work:issue:nope"))).count() == 0


def test_documents_and_changes(spark):
    view = spark.createDataFrame(
        [("P", "e1", 0, "bug", "Todo", "A", ["l1"]), ("P", "e2", 0, "bug", None, None, None)],
        "project_uuid string, entity_uuid string, part int, item_type string, state_key string, title string, labels array<string>",
    )
    docs = exports.documents(view, ["title", "state"])
    texts = {r.entity_uuid: json.loads(r.doc) for r in docs.collect()}
    assert texts == {
        "e1": {"entity_uuid": "e1", "type": "bug", "state": "Todo", "title": "A", "labels": ["l1"]},
        "e2": {"entity_uuid": "e2", "type": "bug"},
    }
    last = exports.registry(docs.where("entity_uuid = 'e1'"))
    assert [(r.entity_uuid, r.change) for r in exports.changed(docs, last).collect()] == [("e2", "new")]


def test_log_append_is_idempotent(spark):
    path = fresh_path(spark, "log")
    log = spark.createDataFrame([(str(n), "P", n * 10**10) for n in range(20)], "event_uuid string, project_uuid string, hlc_us bigint")
    logs.write(logs.new_events(log.limit(12).union(log.limit(5)), None), path)
    logs.write(logs.new_events(log, spark.read.parquet(path)), path)
    assert logs.scan(spark, path).count() == 20 and logs.scan(spark, path, "Q").count() == 0
    stored, few = spark.read.parquet(path), log.where("hlc_us < 20000000000")
    met = logs.days_met(stored, few)
    assert {str(r.day) for r in met.select("day").distinct().collect()} == {"1970-01-01"}
    filters = met._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]
    assert "day" in filters.split("]")[0]  # folders of other days aren't listed
    assert logs.new_events(few, stored).count() == 0 and logs.new_events(log.limit(0), stored).count() == 0


def test_ulid_time(spark):
    row = spark.range(1).select(ulid_time(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV")).alias("ms")).collect()[0]
    assert row.ms == 1469922850259
