"""The replay against a fold that takes one event after the other."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventfold import api
from eventfold.operators import replay as R
from eventfold.operators import schema_time, validate

COLUMNS = {
    "event_uuid": "string", "project_uuid": "string", "node_uuid": "string", "stream_seq": "bigint", "hlc_us": "bigint",
    "hlc_ns": "int", "hlc_node": "string", "hlc_seq": "bigint", "kind": "string", "schema_version": "bigint",
    "entity_uuid": "string", "entity_kind": "string", "item_type": "string", "fields": "map<string,string>", "field": "string",
    "value": "string", "delta": "bigint", "comment_uuid": "string", "relation_uuid": "string", "from_uuid": "string",
    "to_uuid": "string", "schema_body": "string", "policy": "string", "given_version": "bigint", "field_kind": "string",
    "required": "boolean", "enum_name": "string", "type_name": "string", "new_field": "string", "enum_value": "string",
    "new_value": "string", "relation_kind": "string", "arrival": "bigint", "state_key": "string",
}
ACCEPTS = {
    "text": "string", "enum": "string", "number": "integer", "counter": "integer", "decimal": "decimal", "boolean": "boolean",
    "member": "member",
}


def coerced(value, kind):
    """``(type, text, error)`` of a JSON text."""
    v = json.loads(value)
    is_number = isinstance(v, (int, float)) and not isinstance(v, bool)
    if kind is None:
        if isinstance(v, str):
            return "string", v, None
        of = "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "decimal" if is_number else "json"
        return of, value, None
    if kind == "counter":
        return None, None, "counter_scalar_set"
    if kind in ("text", "enum"):
        return ("string", v, None) if isinstance(v, str) else (None, None, "expected_string")
    if kind == "number":
        return ("integer", str(int(v)), None) if is_number else (None, None, "expected_integer")
    if kind == "decimal":
        return ("decimal", value, None) if is_number else (None, None, "expected_decimal")
    if kind == "boolean":
        return ("boolean", value, None) if isinstance(v, bool) else (None, None, "expected_boolean")
    assert kind == "member"
    good = isinstance(v, str) and v.startswith(("user:", "agent:")) and v[-1] != ":"
    return ("member", v, None) if good else (None, None, "expected_member")


class Schema:
    def __init__(self, body, policy, version):
        body = json.loads(body) if body else {}
        self.types = {n: (t["entity_kind"], {f: (d["type"], bool(d.get("required")), d.get("enum_name")) for f, d in t["fields"].items()})
                      for n, t in body.get("item_types", {}).items()}
        self.enums = {n: list(e["values"]) for n, e in body.get("enums", {}).items()}
        self.policy, self.version = policy or body.get("compatibility") or "strict", version

    def apply(self, e):
        kind = e["kind"]
        if kind == "schema.add-field":
            if e["entity_kind"] not in schema_time.ENTITY_KINDS:
                return "unknown_entity_kind"
            if e["field_kind"] not in ACCEPTS:
                return "bad_field"
            of_kind = [t for t in self.types.values() if t[0] == e["entity_kind"]]
            if not of_kind:
                name = {"issue": "bug", "effort": "sprint", "component": "module"}[e["entity_kind"]]
                self.types[name] = (e["entity_kind"], {})
                of_kind = [self.types[name]]
            for _, fields in of_kind:
                fields[e["field"]] = (e["field_kind"], bool(e["required"]), e["enum_name"])
            self.version += 1
        elif kind == "schema.add-enum-value":
            values = self.enums.setdefault(e["enum_name"], [])
            if e["enum_value"] not in values:
                values.append(e["enum_value"])
        elif kind == "schema.rename-enum-value":
            values = self.enums.setdefault(e["enum_name"], [])
            if e["enum_value"] != e["new_value"]:
                self.enums[e["enum_name"]] = [v for v in values if v not in (e["enum_value"], e["new_value"])] + [e["new_value"]]
        elif kind == "schema.set-compatibility":
            self.policy = e["policy"]
        elif kind == "schema.add-item-type":
            self.types[e["type_name"]] = (e["entity_kind"], {})
        elif e["type_name"] in self.types:
            fields = self.types[e["type_name"]][1]
            old = fields.get(e["field"])
            if kind == "schema.remove-field":
                fields.pop(e["field"], None)
            elif kind == "schema.rename-field" and e["field"] != e["new_field"]:
                fields.pop(e["field"], None)
                fields.pop(e["new_field"], None)
                if old:
                    fields[e["new_field"]] = old
            elif kind == "schema.change-field-type" and old and e["field_kind"] in ACCEPTS:
                fields[e["field"]] = (e["field_kind"], *old[1:])

    def declared(self, item, field):
        fields = self.fields(item)
        return None if fields is None else fields.get(field)

    def fields(self, item):
        kind, fields = self.types.get(item[1], (None, None))
        return fields if kind == item[0] else None


class Fold:
    """One event after the other, as the rules say."""

    def __init__(self):
        self.schemas, self.items, self.values, self.stamps, self.sums = {}, {}, {}, {}, Counter()
        self.comments, self.relations, self.waiting, self.fate, self.errors = set(), set(), [], {}, {}
        self.conflicts, self.scans = {}, {}

    def take(self, e, again=False):
        uuid, kind, project = e["event_uuid"], e["kind"], e["project_uuid"]
        schema = self.schemas.get(project)
        if kind == "node.register":
            fate, error = "node_registered", None
        elif kind.startswith("schema."):
            error = self.migrate(e)
            fate = "error" if error else "schema_updated"
            if not error:
                self.scan(e)
        elif not kind.startswith(("item.", "comment.", "relation.", "execution.")):
            fate, error = "error", "unknown_kind"
        elif schema is None or e["schema_version"] > schema.version:
            if not again:
                self.waiting.append(e)
            self.fate[uuid] = "quarantined"
            return False
        else:
            error = self.work(e, schema)
            fate = "error" if error else "conflict" if self.found(e, schema) else "applied"
        self.fate[uuid] = fate
        if error:
            self.errors[uuid] = error
        if fate == "schema_updated":
            held, self.waiting = self.waiting, []
            for w in held:
                if w["project_uuid"] != project or not self.take(w, True):
                    self.waiting.append(w)
        return True

    def migrate(self, e):
        kind, project = e["kind"], e["project_uuid"]
        if kind == "schema.init":
            if e["policy"] not in (None, *schema_time.POLICIES):
                return "bad_policy"
            self.schemas[project] = Schema(e["schema_body"], e["policy"] or "strict", 1)
        elif kind == "schema.snapshot":
            if e["given_version"] is None or e["schema_body"] is None:
                return "bad_schema"
            self.schemas[project] = Schema(e["schema_body"], None, e["given_version"])
        elif project not in self.schemas:
            wrong = Schema(None, None, 0).apply({**e}) if kind == "schema.add-field" else None
            return wrong or "no_schema"
        else:
            return self.schemas[project].apply(e)

    def work(self, e, schema):
        kind, item = e["kind"], e["entity_uuid"]
        if kind == "item.create":
            if e["entity_kind"] not in schema_time.ENTITY_KINDS:
                return "unknown_entity_kind"
            self.items[item] = (e["entity_kind"], e["item_type"], e["project_uuid"])
            for field in sorted(e["fields"] or {}):
                error = self.write(e, schema, field, e["fields"][field])
                if error:
                    return error
        elif kind in R.NEED_ITEM:
            if item not in self.items:
                return "entity_not_found"
            if kind == "item.set-field":
                return self.write(e, schema, e["field"], e["value"])
            if kind == "item.clear-field":
                self.put(e, e["field"], ("cleared", None))
            if kind == "item.adjust-field":
                declared = schema.declared(self.items[item], e["field"])
                if not declared or declared[0] != "counter":
                    return "not_a_counter" if declared else "unknown_field"
                self.sums[item, e["field"]] += e["delta"]
                self.put(e, e["field"], ("integer", None))
        elif kind == "comment.add":
            self.comments.add(e["comment_uuid"])
        elif kind == "comment.edit" and e["comment_uuid"] not in self.comments:
            return "comment_not_found"
        elif kind == "relation.create":
            self.relations.add(e["relation_uuid"])
        elif kind == "relation.set-attr" and e["relation_uuid"] not in self.relations:
            return "relation_not_found"

    def write(self, e, schema, field, value):
        declared = schema.declared(self.items[e["entity_uuid"]], field)
        of, text, error = coerced(value if value is not None else "null", declared and declared[0])
        if not error:
            self.put(e, field, (of, text))
        return error

    def put(self, e, field, value):
        key, stamp = (e["entity_uuid"], field), tuple(e[c] for c in R.STAMP)
        if key not in self.stamps or stamp > self.stamps[key]:
            self.values[key], self.stamps[key] = value, stamp

    def findings(self, item, schema):
        kind, name, _ = self.items[item]
        fields = schema.fields((kind, name))
        if fields is None:
            return [("unknown_item_type", None)]
        live = {f: v for (i, f), v in self.values.items() if i == item and v[0] != "cleared"}
        out = [("missing_required_field", f) for f, d in fields.items() if d[1] and f not in live]
        for f, (of, text) in live.items():
            if f not in fields:
                out += [("unknown_field", f)] * (schema.policy == "strict")
                continue
            want, _, enum = fields[f]
            out += [("field_type_mismatch", f)] * (ACCEPTS[want] != of)
            if want == "enum":
                if enum is None:
                    out.append(("field_type_mismatch", f))
                elif enum not in schema.enums:
                    out.append(("unknown_enum_value", f))
                elif of != "string":
                    out.append(("field_type_mismatch", f))
                elif text not in schema.enums[enum]:
                    out.append(("unknown_enum_value", f))
        return out

    def found(self, e, schema):
        if e["kind"] in R.VALIDATED and e["entity_uuid"] in self.items:
            found = self.findings(e["entity_uuid"], schema)
        elif e["kind"] == "relation.create":
            found = [("missing_entity_ref", end) for end in ("from_uuid", "to_uuid") if e[end] not in self.items]
        else:
            return False
        if found:
            self.conflicts[e["event_uuid"]] = Counter(found)
        return bool(found)

    def scan(self, e):
        of_project = [i for i, v in self.items.items() if v[2] == e["project_uuid"]]
        found = [f for i in of_project for f, _ in self.findings(i, self.schemas[e["project_uuid"]])]
        if found:
            self.scans[e["event_uuid"]] = Counter(found)


def random_log(seed, n):
    r = random.Random(seed)
    names, kinds = ["a", "b", "c", "d"], list(ACCEPTS)
    values = ['"x"', '"low"', '"user:me"', "7", "2.5", "true", "null", '{"k":1}']

    def body():
        types = {
            t: {"entity_kind": k, "fields": {f: {"type": r.choice(kinds), "required": r.random() < 0.3, "enum_name": r.choice(["e0", "e1", None])}
                                             for f in r.sample(names, r.randint(0, 3))}}
            for t, k in r.sample([("bug", "issue"), ("task", "issue"), ("sprint", "effort")], r.randint(0, 3))
        }
        return json.dumps({"item_types": types, "enums": {"e0": {"values": r.sample(["low", "x", "high"], 2)}}, "compatibility": r.choice(["strict", "additive"])})

    out = []
    for i in range(n):
        e = dict.fromkeys(COLUMNS) | {
            "event_uuid": f"{i:05d}", "project_uuid": r.choice("PPQ"), "node_uuid": r.choice("NM"), "stream_seq": i,
            "hlc_us": r.randint(0, n), "hlc_ns": 0, "hlc_node": "N", "hlc_seq": r.randint(0, 1), "arrival": i,
            "schema_version": r.choice([1, 1, 1, 1, 2, 4, 30]),
        }
        if r.random() < 0.15:
            e["kind"] = r.choice(
                ["schema.init", "schema.snapshot", "schema.add-field", "schema.add-field", "schema.add-field", "schema.remove-field",
                 "schema.rename-field", "schema.rename-field", "schema.rename-field", "schema.change-field-type", "schema.add-enum-value",
                 "schema.rename-enum-value", "schema.set-compatibility", "schema.add-item-type"]
            )
            e |= {
                "schema_body": body(), "given_version": r.choice([0, 2, 3, None]) if e["kind"] == "schema.snapshot" else None,
                "policy": r.choice(["strict", "additive"]), "entity_kind": r.choice(["issue", "effort", "component"]),
                "field": r.choice(names), "new_field": r.choice(names), "field_kind": r.choice([*kinds, "odd"]),
                "required": r.random() < 0.3, "enum_name": r.choice(["e0", "e1"]), "type_name": r.choice(["bug", "task", "sprint"]),
                "enum_value": r.choice(["low", "x", "high"]), "new_value": r.choice(["low", "x", "high"]),
            }
            if e["kind"] == "schema.add-item-type":  # a type name stays with its kind
                e["entity_kind"] = "effort" if e["type_name"] == "sprint" else "issue"
        else:
            item = r.choice("IJKL")
            e["project_uuid"] = "P" if item < "L" else "Q"  # an item is of one project
            e |= {"kind": r.choice(
                ["item.create", "item.set-field", "item.set-field", "item.set-field", "item.clear-field", "item.adjust-field", "item.set-state",
                 "item.add-label", "comment.add", "comment.edit", "relation.create", "relation.set-attr", "node.register", "odd.kind"]
            ), "entity_uuid": item, "field": r.choice(names), "value": r.choice(values), "delta": r.randint(-3, 3),
                "comment_uuid": r.choice("xyz"), "relation_uuid": r.choice("xyz"), "from_uuid": item, "to_uuid": r.choice("IJKLM")}
            if e["kind"] == "item.create":
                e |= {"entity_kind": r.choice(["issue", "issue", "effort", "odd"]), "item_type": r.choice(["bug", "task", "sprint", None]),
                      "fields": {f: r.choice(values) for f in r.sample(names, 2)}}
        out.append(e)
    return out


def frame(spark, events):
    ddl = ", ".join(f"{name} {of}" for name, of in COLUMNS.items())
    return spark.createDataFrame([tuple(e[name] for name in COLUMNS) for e in events], ddl).repartition(3)


@pytest.mark.parametrize(("seed", "split"), [(1, None), (3, 7)])
def test_replay_is_the_fold(spark, seed, split):
    log = random_log(seed, 400)
    fold = Fold()
    for e in sorted(log, key=lambda e: tuple(e[c] for c in R.STAMP)):
        fold.take(e)
    copies = [{**e, "arrival": e["arrival"] + 10_000} for e in log[::7]]
    done = R.replay(frame(spark, log + copies), split)
    rows = {(r.event_uuid, r.arrival): (r.outcome, r.error) for r in R.outcomes(done, "arrival").collect()}
    assert len(rows) == len(log) + len(copies)
    got = {i: o for (i, at), (o, _) in rows.items() if at < 10_000}
    assert got == fold.fate
    assert {i: e for (i, at), (_, e) in rows.items() if at < 10_000 and e} == fold.errors
    for e in copies:
        fate = fold.fate[e["event_uuid"]]
        assert rows[e["event_uuid"], e["arrival"]][0] == (fate if fate in ("quarantined", "error") else "already_reduced")
    want = {k: (of, str(fold.sums[k]) if of == "integer" and text is None else text) for k, (of, text) in fold.values.items()}
    assert {(r.entity_uuid, r.field): (r.value_type, r.stored) for r in R.state(done).collect()} == want
    found = {}
    for r in R.conflict_rows(done).collect():
        found.setdefault(r.event_uuid, Counter())[r.conflict_type, r.field] += 1
    assert found == fold.conflicts
    scans = {}
    for r in R.revalidations(done, split).collect():
        scans.setdefault(r.event_uuid, {})[r.conflict_type] = r.findings
    assert scans == {k: dict(v) for k, v in fold.scans.items()}
    assert {"applied", "conflict", "quarantined", "error", "schema_updated", "node_registered"} <= set(got.values())


def test_reduce_log_leaves_refused_writes_out(spark):
    body = json.dumps({"item_types": {"bug": {"entity_kind": "issue", "fields": {"n": {"type": "number"}, "d": {"type": "date"}}}}})
    make = lambda i, kind, **more: dict.fromkeys(COLUMNS) | {
        "event_uuid": f"{i}", "project_uuid": "P", "node_uuid": "N", "stream_seq": i, "hlc_us": i, "hlc_ns": 0, "hlc_node": "N",
        "hlc_seq": 0, "schema_version": 1, "kind": kind, "entity_uuid": "I", **more,
    }
    log = [
        make(1, "schema.init", schema_body=body),
        make(2, "item.create", entity_kind="issue", item_type="bug", fields={"d": '"2026-01-01"'}),
        make(3, "item.set-field", field="n", value="4"),
        make(4, "item.set-field", field="n", value='"five"'),
        make(5, "item.set-field", entity_uuid="J", field="n", value="1"),
    ]
    out = api.reduce_log(frame(spark, log))
    assert {(r.field, r.value_type, r.stored) for r in out["fields"].collect()} == {("n", "integer", "4"), ("d", "date", "2026-01-01")}
    assert {r.event_uuid: r.outcome for r in out["outcomes"].collect()} == {
        "1": "schema_updated", "2": "applied", "3": "applied", "4": "error", "5": "error",
    }
    assert out["headers"].count() == 1 and out["conflicts"].count() == 0


def test_no_events(spark):
    done = R.replay(frame(spark, []))
    assert R.state(done).count() == 0 and R.outcomes(done, "arrival").count() == 0 and R.conflict_rows(done).count() == 0


def test_long_rename_chains(spark):
    names = [f"f{i}" for i in range(20)]
    init = json.dumps({"item_types": {"bug": {"entity_kind": "issue", "fields": {"f0": {"type": "text", "required": True}}}}})
    base = dict.fromkeys(COLUMNS) | {"project_uuid": "P", "node_uuid": "N", "hlc_ns": 0, "hlc_node": "N", "hlc_seq": 0}
    log = [base | {"event_uuid": "00", "stream_seq": 0, "hlc_us": 0, "kind": "schema.init", "schema_body": init}]
    for i, (old, new) in enumerate(zip(names, names[1:]), 1):
        log.append(base | {"event_uuid": f"{i:02d}", "stream_seq": i, "hlc_us": i, "kind": "schema.rename-field", "type_name": "bug", "field": old, "new_field": new})
    rows = schema_time.reached(schema_time.schema_rows(frame(spark, log))).withColumn("pos", F.col("hlc_us"))
    fields = schema_time.timeline(rows).fields
    assert [(r.field, r.field_kind, r.required) for r in schema_time.in_force(fields).collect()] == [("f19", "text", True)]
    assert [r.field for r in schema_time.in_force(fields, 7).collect()] == ["f7"]


def test_findings_follow_the_events_of_items(spark, monkeypatch):
    """Schema changes that no event of an item follows make no rows for that item."""
    init = json.dumps({"item_types": {"bug": {"entity_kind": "issue", "fields": {"a": {"type": "text", "required": True}}}}})
    base = dict.fromkeys(COLUMNS) | {"project_uuid": "P", "node_uuid": "N", "hlc_ns": 0, "hlc_node": "N", "hlc_seq": 0, "schema_version": 1}
    log = [base | {"event_uuid": "000", "stream_seq": 0, "hlc_us": 0, "kind": "schema.init", "schema_body": init}]
    for i in range(1, 21):
        log.append(base | {"event_uuid": f"{i:03d}", "stream_seq": i, "hlc_us": i, "kind": "item.create", "entity_uuid": f"I{i}",
                           "entity_kind": "issue", "item_type": "bug", "fields": {"b": "7"}})
    for i in range(21, 61):
        log.append(base | {"event_uuid": f"{i:03d}", "stream_seq": i, "hlc_us": i, "kind": "schema.add-field", "entity_kind": "issue",
                           "field": "b", "field_kind": "boolean" if i % 2 else "number", "required": True})
    judged, made = R._judged, []

    def counting(checked, findings, rows_per_split):
        made.append(findings.count())
        return judged(checked, findings, rows_per_split)

    monkeypatch.setattr(R, "_judged", counting)
    done = R.replay(frame(spark, log))
    assert {(r.event_uuid, r.conflict_type) for r in R.conflict_rows(done).collect()} == {
        (f"{i:03d}", kind) for i in range(1, 21) for kind in ("missing_required_field", "unknown_field")
    }
    assert made == [40]
    scans = {(r.event_uuid, r.conflict_type): r.findings for r in R.revalidations(done).collect()}
    assert scans["021", "field_type_mismatch"] == 20 and ("022", "field_type_mismatch") not in scans
    assert scans["060", "missing_required_field"] == 20


def test_only_what_is_read_of_an_event_is_moved(spark, monkeypatch):
    """Columns for other operators and schema texts are written once, with the events."""
    wide, written = {"state_key", "new_value", "from_uuid"}, []
    plain = R.cut

    def noting(df):
        written.append(wide & set(df.columns))
        return plain(df)

    monkeypatch.setattr(R, "cut", noting)
    monkeypatch.setattr("eventfold.operators.skew.cut", noting)
    log = random_log(5, 60)
    done = R.replay(frame(spark, log + log[::3]), 7)
    # The events; the schema events, as they are read; nothing else.
    assert [w for w in written if "state_key" in w] == [wide]
    assert [w for w in written if "from_uuid" in w] == [wide]
    assert done.events.count() == len(log) and wide <= set(done.accepted.columns)


def test_a_reader_waits_only_for_what_it_reads(spark, monkeypatch):
    """The schema over time needs no typed writes, and typed state no validation; each runs once."""
    made, typed, findings = [], R._typed, R._findings
    monkeypatch.setattr(R, "_typed", lambda *a: made.append("writes") or typed(*a))
    monkeypatch.setattr(R, "_findings", lambda *a: made.append("findings") or findings(*a))
    log = random_log(6, 60)
    done = R.replay(frame(spark, log + log[::3]), 7)
    assert R.declared(done, 7).count() > 0 and made == []
    assert R.state(done).count() > 0 and R.revalidations(done, 7).count() > 0 and made == ["writes"]
    assert R.conflict_rows(done).count() > 0 and made == ["writes", "findings"]
    assert done.events.count() == len(log) and done.accepted.count() > 0 and made == ["writes", "findings"]


def test_conflict_log_reads_its_findings_once(spark):
    rows = spark.createDataFrame([("e1", ["b", "a"]), ("e2", [None])], "event_uuid string, fields array<string>")
    kind = F.lit("unknown_field").alias("conflict_type")
    log = validate.conflict_log(rows.select("event_uuid", F.lit("i").alias("entity_uuid"), kind, F.explode("fields").alias("field")))
    assert "Generate" not in log._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.event_uuid, r.findings, r.found) for r in log.collect())
    assert got == [("e1", 2, ["unknown_field:a", "unknown_field:b"]), ("e2", 1, ["unknown_field:-"])]
