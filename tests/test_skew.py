"""Sliced windows against plain ones, with one group holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from eventfold.operators import skew
from eventfold.operators.loops import counted


@pytest.mark.parametrize("limit", [4, 25, 10_000])
def test_measures_match_one_by_one(spark, limit):
    pick = random.Random(limit)
    rows = [
        ("hot" if pick.random() < 0.7 else f"k{n % 5}", int(pick.expovariate(0.02)), n, pick.choice([None, n % 17]))
        for n in range(300)
    ]
    df = spark.createDataFrame(rows, "k string, pos bigint, id bigint, v bigint")
    order = [F.col("pos"), F.col("id")]
    got = skew.ordered(
        df,
        ["k"],
        order,
        {
            "place": skew.position(),
            "total": skew.running_sum(F.col("v")),
            "top": skew.max_before(F.col("v")),
            "rest": skew.max_after(F.col("v")),
            "last": skew.last_known(F.col("v"), order),
            "prev": skew.previous_row(F.struct("v"), order),
            "next": skew.following_row(F.struct("v"), order),
        },
        limit,
    ).collect()
    want = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        vs = [r[3] for r in group]
        for i, row in enumerate(group):
            known = [v for v in vs[: i + 1] if v is not None]
            before = [v for v in vs[:i] if v is not None]
            after = [v for v in vs[i + 1 :] if v is not None]
            want[row[2]] = (
                i + 1,
                sum(known),
                max(before) if before else None,
                max(after) if after else None,
                known[-1] if known else None,
                (vs[i - 1],) if i else None,
                (vs[i + 1],) if i + 1 < len(vs) else None,
            )
    have = {
        r.id: (r.place, r.total, r.top, r.rest, r.last, r.prev and tuple(r.prev), r.next and tuple(r.next))
        for r in got
    }
    assert have == want


def test_lists_are_bounded_and_whole(spark):
    df = spark.createDataFrame([("a", str(n)) for n in range(500)] + [("b", "x")], "k string, m string")
    for split in (None, 20):
        rows = sorted(skew.list_parts(df, ["k"], F.col("m"), "m", 50, split).collect())
        assert [x for r in rows if r.k == "a" for x in r.m] == sorted(str(n) for n in range(500))
        assert [(r.part, len(r.m)) for r in rows if r.k == "a"] == [(p, 50) for p in range(10)]
        assert [(r.part, r.m) for r in rows if r.k == "b"] == [(0, ["x"])]


@pytest.mark.parametrize("limit", [7, 10_000])
def test_numbered_is_the_place_in_the_whole_order(spark, limit):
    pick = random.Random(limit)
    rows = [(pick.choice([None, *range(4)]), n) for n in range(200)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "a bigint, id bigint")
    got = skew.numbered(df, [F.col("a"), F.col("id")], "place", len(rows), limit)
    assert got.columns == ["a", "id", "place"]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r)[:2] for r in got.orderBy("place").collect()] == want
    assert sorted(r.place for r in got.collect()) == list(range(1, 201))
    assert skew.numbered(df.limit(0), [F.col("id")], "place", 0, limit).count() == 0


def test_known_rows_are_not_counted(spark):
    df = spark.createDataFrame([("a", n) for n in range(20)], "k string, id bigint")
    context = spark.sparkContext
    context.setJobGroup("known-rows", "no job")
    try:
        few = skew.ordered(df, ["k"], [F.col("id")], {"place": skew.position()}, rows=20)
        assert not context.statusTracker().getJobIdsForGroup("known-rows")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    many = skew.ordered(df, ["k"], [F.col("id")], {"place": skew.position()}, 5, rows=20)
    for got in (few, many):
        assert sorted((r.id, r.place) for r in got.collect()) == [(n, n + 1) for n in range(20)]


def test_places_are_read_without_a_join(spark):
    df = spark.createDataFrame([(n,) for n in range(50)], "id bigint")
    got = skew.numbered(df, [F.col("id")], "place", 50, 10)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_counted_as_they_are_written(spark):
    df = spark.range(10).groupBy("id").count()
    for rows, n in ((df, 10), (df.limit(0), 0), (df.where("1 = 0"), 0), (spark.createDataFrame([], "id bigint"), 0)):
        out, seen = counted(rows)
        assert (out.count(), seen) == (n, n)
    assert counted(df, F.col("id") > 5)[1] == 4
