"""Ordered windows and lists that stay balanced when one key is hot.

A plain window puts a whole group into one task. Where no group is above
``rows_per_split`` rows that is what runs. Otherwise all rows are range-partitioned by the
keys and the *whole* order, at splitters that Spark samples, so that even a group of equal
instants is cut into even slices. Each slice is windowed by itself, and what earlier (or
later) slices contribute is one small row per slice, a prefix scan over partial sums.

Joins need no such help: every join here has one row per key on one side, or sides
reduced beforehand, so a hot key fills only one side and adaptive execution splits
it (``SETTINGS`` in the session module forces that).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.operators.loops import cut

# A table is cut into slices where a group is above this many rows.
# ``eventfold.rowsPerSplit`` in the session overrides it.
ROWS_PER_SPLIT = 4_000_000
ROWS_SETTING = "eventfold.rowsPerSplit"
# Slices for each ``rows_per_split`` rows.
SPREAD = 8
#: Items in one part of a list.
LIST_ITEMS = 10_000

_SLICE = "__slice"


@dataclass(frozen=True)
class Measure:
    """One ordered measure: the value in a slice, and its fold across slices."""

    local: object  # window -> Column
    total: Column  # one value per slice
    across: object  # (total column, window over slices) -> Column
    join: object  # (local, carry) -> Column
    backward: bool = False  # looks at later rows: windows are in reverse order


def split_size(df: DataFrame, given: int | None) -> int:
    return given or int(df.sparkSession.conf.get(ROWS_SETTING, str(ROWS_PER_SPLIT)))


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _through(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def position() -> Measure:
    """1-based position of a row in its group."""
    return Measure(
        lambda w: F.row_number().over(w).cast("bigint"),
        F.count(F.lit(1)),
        lambda t, w: F.sum(t).over(_before(w)),
        lambda a, b: a + F.coalesce(b, F.lit(0)),
    )


def running_sum(value: Column) -> Measure:
    """Sum up to and with the row."""
    return Measure(
        lambda w: F.coalesce(F.sum(value).over(_through(w)), F.lit(0)),
        F.sum(value),
        lambda t, w: F.sum(t).over(_before(w)),
        lambda a, b: a + F.coalesce(b, F.lit(0)),
    )


def max_before(value: Column) -> Measure:
    """Largest value of all earlier rows."""
    return Measure(
        lambda w: F.max(value).over(_before(w)),
        F.max(value),
        lambda t, w: F.max(t).over(_before(w)),
        lambda a, b: F.greatest(a, b),
    )


def greatest_through(value: Column) -> Measure:
    """Largest value up to and with the row; structs compare field by field."""
    return Measure(
        lambda w: F.max(value).over(_through(w)),
        F.max(value),
        lambda t, w: F.max(t).over(_before(w)),
        lambda a, b: F.greatest(a, b),
    )


def max_after(value: Column) -> Measure:
    """Largest value of all later rows."""
    return Measure(
        lambda w: F.max(value).over(_before(w)),
        F.max(value),
        lambda t, w: F.max(t).over(_before(w)),
        lambda a, b: F.greatest(a, b),
        backward=True,
    )


def last_known(value: Column, order: list[Column], with_row: bool = True) -> Measure:
    """Last non-null value up to the row (``with_row``) or before it."""
    frame = _through if with_row else _before
    stamp = F.struct(*order)
    return Measure(
        lambda w: F.last(value, ignorenulls=True).over(frame(w)),
        F.max_by(value, F.when(value.isNotNull(), stamp)),
        lambda t, w: F.last(t, ignorenulls=True).over(_before(w)),
        lambda a, b: F.coalesce(a, b),
    )


def previous_row(value: Column, order: list[Column]) -> Measure:
    """The row before; pass a struct so that 'no row' differs from NULL fields."""
    return Measure(
        lambda w: F.lag(value).over(w),
        F.max_by(value, F.struct(*order)),
        lambda t, w: F.lag(t).over(w),
        lambda a, b: F.coalesce(a, b),
    )


def following_row(value: Column, order: list[Column]) -> Measure:
    """The row after; pass a struct so that 'no row' differs from NULL fields."""
    return Measure(
        lambda w: F.lead(value).over(w),
        F.min_by(value, F.struct(*order)),
        lambda t, w: F.lead(t).over(w),
        lambda a, b: F.coalesce(a, b),
    )


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    measures: dict[str, Measure],
    rows_per_split: int | None = None,
    then: dict[str, Measure] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add ordered measures per group of ``keys``.

    ``order`` must be total. ``keys`` may be empty (one group for the whole table).
    ``then`` are measures over the first ones, on the same slices and shuffle. Group
    sizes are counted first, from the key columns alone; a sliced table is written once.
    Who knows that there are ``rows`` rows at most spares the count where no group can be too large.
    """
    if not keys:
        out = ordered(df.withColumn("__all", F.lit(0)), ["__all"], order, measures, rows_per_split, then, rows)
        return out.drop("__all")
    limit = split_size(df, rows_per_split)
    few = rows is not None and rows <= limit
    if not few:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        sizes = sizes.agg(F.max("__n").alias("top"), F.sum("__n").alias("all")).first()
    if few or (sizes["top"] or 0) <= limit:
        out = _within(df, keys, order, measures)
        return _within(out, keys, order, then) if then else out
    parts = -(-sizes["all"] // limit) * SPREAD
    by_range = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    # Written, as splitters are drawn anew whenever the partitioning is worked out again.
    out = cut(by_range.withColumn(_SLICE, F.spark_partition_id()))
    for some in (measures, then or {}):
        out = _across(out, keys, order, some) if some else out
    return out.drop(_SLICE)


def _within(df: DataFrame, keys: list[str], order: list[Column], measures: dict[str, Measure]) -> DataFrame:
    # A frame of all following rows is evaluated anew for each row; the reverse order
    # turns it into a running frame.
    forward = Window.partitionBy(*keys).orderBy(*order)
    backward = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.select(
        *df.columns, *[m.local(backward if m.backward else forward).alias(name) for name, m in measures.items()]
    )


def _across(sliced: DataFrame, keys: list[str], order: list[Column], measures: dict[str, Measure]) -> DataFrame:
    local = _within(sliced, [*keys, _SLICE], order, measures)
    totals = sliced.groupBy(*keys, _SLICE).agg(*[m.total.alias(f"__t_{name}") for name, m in measures.items()])
    slices = Window.partitionBy(*keys).orderBy(_SLICE)
    later = Window.partitionBy(*keys).orderBy(F.col(_SLICE).desc())
    carry = totals.select(
        *keys,
        _SLICE,
        *[
            m.across(F.col(f"__t_{n}"), later if m.backward else slices).alias(f"__c_{n}")
            for n, m in measures.items()
        ],
    )
    # A window takes rows without a key as one group, so the join does too.
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*keys, _SLICE)])
    return local.alias("l").join(carry.alias("c"), same, "left").select(
        *[F.col(f"l.{c}") for c in sliced.columns],
        *[m.join(F.col(f"l.{n}"), F.col(f"__c_{n}")).alias(n) for n, m in measures.items()],
    )


def numbered(df: DataFrame, order: list[Column], name: str, rows: int, rows_per_split: int | None = None) -> DataFrame:
    """Adds ``name``, the 1-based position of each of the ``rows`` rows in the whole table.

    The table is cut by ranges of the whole order, sorted and written once, each row with its
    slice and its place there; the rows of earlier slices are one number a slice, which is
    part of the expression, so who reads the numbered table has no join to make.
    """
    parts = max(1, -(-rows // split_size(df, rows_per_split))) * SPREAD
    by_range = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The upper bits of the id are the slice, the lower 33 the place from 0.
    out = cut(by_range.withColumn("__id", F.monotonically_increasing_id())).withColumn(_SLICE, F.shiftright("__id", 33))
    sizes = {r[_SLICE]: r["__n"] for r in out.groupBy(_SLICE).agg(F.count(F.lit(1)).alias("__n")).collect()}
    earlier = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    base = F.get(F.array(*[F.lit(n).cast("bigint") for n in earlier]), F.col(_SLICE).cast("int"))
    place = F.col("__id").bitwiseAND((1 << 33) - 1) + F.lit(1) + base
    return out.select(*df.columns, place.alias(name))


def list_parts(
    df: DataFrame,
    keys: list[str],
    item: Column,
    alias: str,
    part_items: int = LIST_ITEMS,
    rows_per_split: int | None = None,
    most: int | None = None,
) -> DataFrame:
    """Sorted lists in parts of ``part_items`` items: ``(keys, part, alias)``.

    The items of a group (texts, not null) are numbered in order; part 0 holds the first
    ``part_items`` of them, part 1 the next, and so on. Parts put one after the other are
    the whole sorted list, and no task ever holds an unbounded one. ``most``: as ``rows`` in ``ordered``.
    """
    rows = df.select(*keys, item.alias(alias))
    numbered = ordered(rows, keys, [F.col(alias)], {"__place": position()}, rows_per_split, rows=most)
    part = F.floor((F.col("__place") - 1) / part_items).cast("int")
    return numbered.groupBy(*keys, part.alias("part")).agg(
        F.sort_array(F.collect_list(alias)).alias(alias)
    )
