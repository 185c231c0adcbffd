"""Hub checks against a one-by-one fold."""

import random

from pyspark.sql import functions as F

from eventfold.operators import hub, index, loops, snapshots
from eventfold.operators.loops import components, layers


def random_pushes(seed):
    pick = random.Random(seed)
    rows, sent = [], []
    for batch in range(25):
        node = f"N{batch % 2}"
        for line in range(pick.randrange(1, 8)):
            again = [e for e in sent if e[1] == node]
            if again and pick.random() < 0.2:
                event = pick.choice(again)
            else:
                event = (f"e{len(rows)}", node, f"s{pick.randrange(2)}", batch * 3 + pick.randrange(-6, 6))
            sent.append(event)
            rows.append((*event, batch, line))
    return rows


def fold(rows, whole_batch):
    """What a hub does, one event at a time."""
    last, stored, stopped, out = {}, set(), set(), {}
    for event, node, stream, seq, batch, line in sorted(rows, key=lambda r: r[4:]):
        if whole_batch and batch in stopped:
            verdict = "not_processed"
        elif event in stored:
            verdict = "duplicate"
        elif seq <= last.get((node, stream), -(10**9)):
            verdict = "regression"
            stopped.add(batch)
        else:
            verdict = "durable"
            stored.add(event)
            last[node, stream] = seq
        out[batch, line] = verdict
    return out


SCHEMA = "event_uuid string, node_uuid string, stream_id string, stream_seq bigint, batch bigint, line bigint"


def test_sequence_checks_match_the_fold(spark):
    for seed in (1, 2):
        rows = random_pushes(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        for check, whole in ((hub.sequence_checks, False), (hub.sequence_cuts, True)):
            for limit in (None, 5):
                got = {(r.batch, r.line): r.outcome for r in check(df, limit).collect()}
                assert got == fold(rows, whole)


def test_append_is_dense_and_idempotent(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "event_uuid string, hub_offset bigint")
    more = [("b", 1, 0), ("c", 1, 1), ("d", 2, 0), ("c", 2, 1)]
    rows = hub.append(stored, spark.createDataFrame(more, "event_uuid string, batch bigint, line bigint"))
    got = {(r.batch, r.line): (r.hub_offset, r.duplicate) for r in rows.collect()}
    assert got == {(1, 0): (2, True), (1, 1): (3, False), (2, 0): (4, False), (2, 1): (3, True)}


def test_watermark_stops_at_the_first_uncovered_event(spark):
    log = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3), ("B", 4)], "node_uuid string, hub_offset bigint")
    schema = "reporter string, author string, last_hub_offset bigint"
    mark = lambda rows: snapshots.watermark(log, spark.createDataFrame(rows, schema)).collect()[0][0]
    assert mark([("r", "A", 3), ("r", "B", 2)]) == 3
    assert mark([("r", "A", 3), ("r", "B", 4), ("s", "A", 1)]) == 1  # s never saw B
    assert mark([("r", "B", 4)]) == 0
    assert mark([]) == 0


def test_compaction_keeps_an_id_ledger(spark):
    log = spark.createDataFrame([(str(n), n) for n in range(1, 6)], "event_uuid string, hub_offset bigint")
    kept, gone = snapshots.compact(log, 3)
    assert (kept.count(), gone.count()) == (2, 3)


def test_components_match_union_find(spark):
    pick = random.Random(4)
    pairs = [(pick.randrange(60), pick.randrange(60)) for _ in range(45)] + [(n, n + 1) for n in range(100, 140)]
    pairs += [(200, n) for n in range(201, 230)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.id: r.cluster for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in pairs)}


def test_components_halve_their_nodes_in_each_round(spark, monkeypatch):
    """A ring, a star with the greatest id in the middle, and a path whose ids jump about."""
    sizes, hooked = [], loops._hooked

    def counting(links):
        sizes.append(links.select("a").distinct().count())
        return hooked(links)

    monkeypatch.setattr(loops, "_hooked", counting)
    path = [(1000 + i * 37 % 101, 1000 + (i + 1) * 37 % 101) for i in range(100)]
    pairs = [(i, (i + 1) % 40) for i in range(40)] + [(500, 100 + i) for i in range(30)] + path + [(7, 7), (900, 900), (1, 0)]
    got = {r.id: r.cluster for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(40)} | {i: 100 for i in (*range(100, 130), 500)} | {i: 1000 for i in range(1000, 1101)}
    assert got == want
    assert sizes[0] == len(want) and all(2 * after <= before for before, after in zip(sizes, sizes[1:]))


def test_layers_leave_cycles_open(spark):
    rows = [("c", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "x")]
    got = {r.node: r.layer for r in layers(spark.createDataFrame(rows, "node string, needs string")).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "x": None, "y": None, "z": None}


def test_report_of_a_replica_is_its_last_one(spark):
    rows = [("W", "r", 1, 10, "A", 5), ("W", "r", 1, 10, "B", 5), ("W", "r", 2, 20, "A", 7)]
    df = spark.createDataFrame(
        rows, "workspace_uuid string, reporter string, report_id bigint, reported_us bigint, author string, last_hub_offset bigint"
    )
    assert [(r.author, r.last_hub_offset) for r in hub.current_reports(df).collect()] == [("A", 7)]


def test_page_and_cursors(spark):
    log = spark.createDataFrame(
        [(str(n), "W", "P", "AB"[n % 2], n) for n in range(1, 9)],
        "event_uuid string, workspace_uuid string, project_uuid string, node_uuid string, hub_offset bigint",
    )
    known = spark.createDataFrame([("A", "4", 4)], "author string, last_event_uuid string, last_hub_offset bigint")
    page = hub.pull_page(log, known, "W", 3)
    assert [(r.hub_offset, r.has_more) for r in page.orderBy("hub_offset").collect()] == [(1, True), (3, True), (5, True)]
    merged = {r.author: r.last_hub_offset for r in hub.merge_cursors(known, hub.page_cursors(page)).collect()}
    assert merged == {"A": 4, "B": 5}
    last = hub.pull_page(log, known, "W", 50).agg(F.max("has_more")).collect()[0][0]
    assert last is False


def test_offsets_go_on_after_compaction(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("b", 0, 1)], "event_uuid string, batch int, line int")
    none = spark.createDataFrame([], "event_uuid string, hub_offset bigint")
    stored, ledger = snapshots.compact(hub.append(none, rows), 2)
    more = spark.createDataFrame([("c", 1, 0), ("a", 1, 1)], "event_uuid string, batch int, line int")
    got = {r.event_uuid: (r.hub_offset, r.duplicate) for r in hub.append(stored, more, ledger=ledger).collect()}
    assert stored.count() == 0 and got == {"c": (3, False), "a": (1, True)}


def test_every_project_below_the_bound_needs_its_snapshot(spark):
    log = spark.createDataFrame(
        [("P1", 1), ("P2", 2), ("P1", 3), ("P3", 9)], "project_uuid string, hub_offset long"
    )
    mark = spark.createDataFrame([(9,)], "watermark long")
    bounds = {"low": F.lit(1), "mid": F.lit(4), "top": F.lit(9), "none": F.lit(0)}

    def decide(kept):
        known = spark.createDataFrame(kept, "project_uuid string, through_offset long")
        rows = snapshots.compaction_decisions(log, bounds, mark, known).collect()
        return {r["request"]: (r["decision"], r["dropped"]) for r in rows}

    assert decide([("P1", 5)]) == {
        "none": ("compact", 0), "low": ("compact", 1), "mid": ("no_snapshot", 0), "top": ("no_snapshot", 0)
    }
    assert decide([("P1", 5), ("P2", 4)])["mid"] == ("compact", 3)
    assert decide([("P1", 9), ("P2", 9)])["top"] == ("no_snapshot", 0)


def test_lag_has_a_row_for_each_report_and_one_for_the_rest(spark):
    stored = spark.createDataFrame(
        [("W", a, n) for a, n in (("A", 5), ("A", 9), ("B", 7), ("C", 3))], "workspace_uuid string, node_uuid string, hub_offset bigint"
    )
    reports = spark.createDataFrame(
        [("W", "r", "A", 4), ("W", "s", "A", 9), ("W", "s", "B", 1), ("W", "s", "C", 3)],
        "workspace_uuid string, reporter string, author string, last_hub_offset bigint",
    )
    got = {(r.reporter, r.author): (r.authors, r.high, r.cursor, r.lag) for r in hub.replica_lag(stored, reports).collect()}
    assert got == {
        ("r", "A"): (1, 9, 4, 5), ("r", None): (2, 10, 0, 10),
        ("s", "A"): (1, 9, 9, 0), ("s", "B"): (1, 7, 1, 6), ("s", "C"): (1, 3, 3, 0),
    }


def test_prefixes_are_intervals(spark):
    pick = random.Random(3)
    ids = sorted({"".join(pick.choice("abz") for _ in range(6)) for _ in range(200)})
    refs = [*{x[: pick.randint(1, 6)] for x in ids}, "q", "b~", "zzzzzzz"]
    items = spark.createDataFrame([(x,) for x in ids], "entity_uuid string")
    wanted = spark.createDataFrame([(r,) for r in refs], "ref string")
    want = {r: (len(m), m[0]) for r in refs if (m := [x for x in ids if x.startswith(r)])}
    for split in (None, 9):
        assert {r.ref: (r.n, r.id) for r in index.prefix_matches(wanted, items, split).collect()} == want


def test_lag_in_full_has_a_row_for_every_reporter_and_author(spark):
    stored = spark.createDataFrame(
        [("W", a, n) for a, n in (("A", 5), ("A", 9), ("B", 7))], "workspace_uuid string, node_uuid string, hub_offset bigint"
    )
    reports = spark.createDataFrame(
        [("W", "r", "A", 4), ("W", "s", "B", 1)], "workspace_uuid string, reporter string, author string, last_hub_offset bigint"
    )
    got = {(r.reporter, r.author): (r.high, r.cursor, r.lag) for r in hub.pair_lag(stored, reports).collect()}
    assert got == {("r", "A"): (9, 4, 5), ("r", "B"): (7, 0, 7), ("s", "A"): (9, 0, 9), ("s", "B"): (7, 1, 6)}
