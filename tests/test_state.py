"""Comments, relations, claims, validation, quarantine on small logs."""

from pyspark.sql import functions as F

from eventfold.functions.values import json_text
from eventfold.operators import edges, gate, leases, registers, schema_log, threads, validate
from tests.logs import create, event, frame

ORDER = "event_uuid string, node_uuid string, stream_seq bigint, hlc_us bigint, hlc_ns int, hlc_node string, hlc_seq bigint"


def stamped(spark, rows, columns):
    """Rows of ``(instant, ...)`` with stamps in front."""
    full = [(f"e{i}", "N0", i, r[0], 0, "N0", 0, *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, f"{ORDER}, {columns}")


TALK = "kind string, comment_uuid string, entity_uuid string, author string, body string, comment_kind string, directed_at string, replaces string"


def talk(spark, *rows):
    return stamped(spark, [(at, f"comment.{k}", c, "V", "user:a", body, None, None, rep) for at, k, c, body, rep in rows], TALK)


def test_comment_edits_deletes_and_readds(spark):
    log = talk(
        spark,
        (1, "add", "a", "one", None),
        (2, "edit", "a", "A", None),
        (3, "edit", "a", "B", None),
        (1, "add", "b", "x", None),
        (2, "delete", "b", None, None),
        (3, "add", "b", "back", None),
        (5, "edit", "ghost", "?", None),
    )
    got = {r.comment_uuid: (r.body, r.deleted) for r in threads.comments(log).collect()}
    assert got == {"a": ("B", False), "b": ("back", False)}
    assert [r.comment_uuid for r in threads.orphan_edits(log).collect()] == ["ghost"]


def test_chains_show_only_their_head(spark):
    log = talk(spark, *[(n, "add", f"c{n}", "t", f"c{n - 1}" if n else None) for n in range(9)], (20, "add", "d", "t", "gone"))
    state = threads.comments(log)
    assert {r.comment_uuid for r in threads.visible(state).collect()} == {"c8", "d"}
    heads = {r.comment_uuid: (r.head, r.hops) for r in threads.chain_heads(state).collect()}
    assert heads == {f"c{n}": ("c8", 8 - n) for n in range(9)} | {"d": ("d", 0)}


EDGE = "kind string, relation_uuid string, project_uuid string, relation_kind string, from_uuid string, to_uuid string, attrs map<string,string>"


def test_relation_recreate_and_attributes(spark):
    make = lambda at, **a: (at, "relation.create", "r", "P", "blocks", "x", "y", a)
    log = stamped(
        spark,
        [
            make(1, a="1", old="1"),
            (2, "relation.set-attr", "r", None, None, None, None, {"b": "2"}),
            (3, "relation.delete", "r", None, None, None, None, None),
            make(4, a="3"),
            (5, "relation.set-attr", "r", None, None, None, None, {"a": "4", "c": "5"}),
            (6, "relation.set-attr", "ghost", None, None, None, None, {"a": "4"}),
        ],
        EDGE,
    )
    state = edges.relations(log)
    assert [(r.relation_uuid, r.deleted) for r in state.collect()] == [("r", False)]
    assert {r.key: r.value for r in edges.attributes(log, state).collect()} == {"a": "4", "c": "5"}
    assert edges.orphan_changes(log).count() == 1


CLAIM = "kind string, entity_uuid string, actor string, executor string, expires_us bigint"


def test_claim_spans_and_progress(spark):
    claim = lambda at, who, end: (at, "execution.claim", "E", who, who, end)
    note = lambda at, who: (at, "execution.progress", "E", who, None, None)
    rows = [claim(1, "a", 10), note(2, "a"), note(3, "b"), claim(4, "b", 6), note(7, "b"), (8, "execution.release", "E", "b", None, None), claim(9, "a", 20)]
    log = stamped(spark, rows, CLAIM)
    for limit in (None, 2):
        spans = [(r.start_us, r.end_us, r.ended_by) for r in leases.episodes(log, limit).orderBy("start_us").collect()]
        assert spans == [(1, 4, "steal"), (4, 6, "expiry"), (9, 20, "expiry")]
        notes = [(r.holder, r.accepted, r.sequence) for r in leases.progress_log(log, limit).orderBy("event_uuid").collect()]
        assert notes == [("a", True, 1), ("a", False, None), ("b", False, None)]


FIELDS = "project_uuid string, entity_kind string, item_type string, field string, field_kind string, enum_name string, required boolean"
BUG = [
    ("P0", "issue", "bug", "title", "text", None, True),
    ("P0", "issue", "bug", "priority", "enum", "level", False),
    ("P0", "issue", "bug", "estimate", "number", None, False),
]


def findings(spark, rows, members=("low", "urgent")):
    log = frame(spark, rows)
    items = registers.headers(log).select("entity_uuid", "project_uuid", "entity_kind", "item_type")
    fields = registers.live_fields(registers.field_state(log)).withColumn("stored", F.coalesce(json_text(F.col("value")), "value"))
    projects = spark.createDataFrame([("P0", "strict")], "project_uuid string, policy string")
    types = spark.createDataFrame([("P0", "issue", "bug")], "project_uuid string, entity_kind string, item_type string")
    enums = spark.createDataFrame([("P0", "level", m) for m in members], "project_uuid string, enum_name string, enum_value string")
    catalogs = enums.select("project_uuid", "enum_name").distinct()
    out = validate.item_conflicts(items, fields, projects, types, spark.createDataFrame(BUG, FIELDS), catalogs, enums)
    return sorted((r.conflict_type, r.field) for r in out.collect())


def test_conflicts_keep_the_item(spark):
    good = create(1, 1, title='"A"', priority='"urgent"', estimate="3")
    assert findings(spark, [good]) == []
    assert findings(spark, [good, event(2, "item.clear-field", 2, field="title")]) == [("missing_required_field", "title")]
    assert findings(spark, [good], members=("low",)) == [("unknown_enum_value", "priority")]
    assert findings(spark, [create(1, 1, title='"A"', estimate='"x"', odd="1")]) == [
        ("field_type_mismatch", "estimate"),
        ("unknown_field", "odd"),
    ]
    assert findings(spark, [create(1, 1, item_type="ghost", odd="1")]) == [("unknown_item_type", None)]


def test_dangling_relation(spark):
    live = spark.createDataFrame([("P", "r", "a", "gone")], "project_uuid string, relation_uuid string, from_uuid string, to_uuid string")
    known = spark.createDataFrame([("a",)], "entity_uuid string")
    rows = validate.dangling(live, known).collect()
    assert [(r.entity_uuid, r.conflict_type, r.field) for r in rows] == [("a", "missing_entity_ref", "to_uuid")]


def test_events_ahead_of_schema_wait_and_drain(spark):
    work = frame(spark, [event(n, "item.set-field", n, schema_version=v) for n, v in ((1, 1), (2, 2), (3, 99))])
    projects = spark.createDataFrame([("P0", 1)], "project_uuid string, version bigint")
    held = gate.gate(work, projects).where("quarantined")
    assert sorted(r.stream_seq for r in held.collect()) == [2, 3]
    reached = stamped(spark, [(0, "P0", 1), (5, "P0", 2)], "project_uuid string, version bigint")
    for limit in (None, 2):
        got = {r.event_uuid[-1]: r.outcome for r in gate.drain(work, reached, limit).collect()}
        assert got == {"1": "applied", "2": "drained", "3": "quarantined"}


def test_schema_versions(spark):
    rows = [(1, "schema.add-field", "P", None), (2, "schema.init", "P", None), (3, "schema.add-field", "P", None)]
    rows += [(4, "schema.snapshot", "P", 9), (5, "schema.add-field", "P", None), (6, "schema.init", "P", None)]
    log = stamped(spark, rows, "kind string, project_uuid string, given_version bigint")
    for limit in (None, 2):
        got = [r.version for r in schema_log.versions(log, rows_per_split=limit).orderBy("hlc_us").collect()]
        assert got == [None, 1, 2, 9, 10, 1]
    assert schema_log.latest(schema_log.ledger(schema_log.versions(log))).select("version").collect()[0][0] == 10
    assert log.select(F.max("hlc_us")).collect()[0][0] == 6
