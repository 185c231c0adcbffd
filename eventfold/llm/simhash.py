"""SimHash near-duplicates found through tables of distances to reference fingerprints.

A reference fingerprint (pivot) gives every fingerprint one coordinate, its Hamming
distance to the pivot. By the triangle inequality two fingerprints that differ in ``r``
bits differ by ``r`` at most in every coordinate, so a pair with a larger difference
anywhere is discarded before the fingerprints themselves are compared.

The pivots here come in groups: those of a group differ from the base pivot within one
quarter of the bits only. The distances to them, less the distance to the base, depend
on that quarter alone. Of four quarters two hold no changed bit if at most two bits
changed, so every pair in range has equal coordinates in two groups: six tables, one for
each two groups, keyed by those coordinates, find every pair. This bounds the candidates
without a cross join.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import folded, texts, unfolded
from eventfold.operators.loops import components, cut

BITS, QUARTER, RADIUS = 64, 16, 2
#: Fixed pivots: the base and eight pseudorandom patterns in each quarter of the bits.
PIVOTS = [0] + [
    (xxhash.xxh64_intdigest(f"{g}/{i}", 7) & 0xFFFF) << (QUARTER * g) for g in range(4) for i in range(8)
]
#: Tables with more fingerprints than this under one key link them by common neighbours.
CROWD = 64

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of the lower-cased text's word shingles, as a signed 64-bit number."""
    parts = text.lower().split()  # bytes.lower() changes A-Z alone
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), (ends[words - 1 :] if len(parts) >= words else ends[-1:]).tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n)
    octets = hashes.astype("<u8", copy=False).view(np.uint8).reshape(n, 8)
    # Each byte position by its histogram: 256 counts times the bits of each value.
    ones = [np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS for i in range(8)]
    bits = (np.concatenate(ones) * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for each row; a text without words has fingerprint zero."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fps: DataFrame, pivots: list[int] = PIVOTS) -> DataFrame:
    """Adds ``dist``, the distances to all pivots."""
    signed = [p - (1 << 64) if p >> 63 else p for p in pivots]
    return fps.withColumn("dist", F.array(*[hamming(F.col("fp"), F.lit(p)).cast("tinyint") for p in signed]))


def links(fps: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` of different fingerprints, complete up to connection.

    Every returned pair differs in ``radius`` (2 at most) bits or fewer, and any two
    fingerprints that do so are joined by returned links. Keys shared by more than
    ``crowd`` fingerprints aren't expanded into pairs: fingerprints at two bits or fewer
    have a common neighbour at one bit or fewer each, so all that reach a neighbour are
    linked to the least of them. That is 65 rows for a fingerprint, however many there are.
    """
    if not 0 < radius <= 2:
        raise ValueError("two groups of four stay unchanged for one or two bits only")
    width = (len(PIVOTS) - 1) // 4
    base = F.element_at("dist", 1)

    def group(g: int) -> list[Column]:
        return [(F.element_at("dist", 2 + g * width + i) - base).cast("tinyint") for i in range(width)]

    tables = [
        F.struct(F.lit(t).alias("t"), F.array(*group(g), *group(h)).alias("key"))
        for t, (g, h) in enumerate(combinations(range(4), 2))
    ]
    rows = pivot_table(fps.select("fp").distinct())
    rows = cut(rows.select("fp", "dist", F.explode(F.array(*tables)).alias("e")).select("fp", "dist", "e.t", "e.key"))
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    few = rows.join(sizes.where(F.col("n") <= crowd).drop("n"), ["t", "key"], "left_semi")
    a, b = few.alias("a"), few.alias("b")
    apart = F.greatest(
        *[F.abs(F.element_at("a.dist", i + 1) - F.element_at("b.dist", i + 1)) for i in range(len(PIVOTS))]
    )
    pairs = a.join(
        b,
        (F.col("a.t") == F.col("b.t"))
        & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (apart <= radius)
        & (hamming(F.col("a.fp"), F.col("b.fp")) <= radius),
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    many = rows.join(sizes.where(F.col("n") > crowd).drop("n"), ["t", "key"], "left_semi").select("fp").distinct()
    return pairs.unionByName(_by_neighbours(many, radius)).distinct()


def _by_neighbours(fps: DataFrame, radius: int) -> DataFrame:
    if radius == 1:
        near = fps.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_bit(i))) for i in range(BITS)])).alias("b"))
        return near.join(fps.select(F.col("fp").alias("b")), "b").select(F.col("fp").alias("a"), "b")
    spots = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_bit(i))) for i in range(BITS)]]
    near = fps.select("fp", F.explode(F.array(*spots)).alias("spot"))
    least = near.groupBy("spot").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return near.join(least, "spot").where("fp <> a").select("a", F.col("fp").alias("b"))


def _bit(i: int) -> int:
    return (1 << i) - (1 << 64) if i == 63 else 1 << i


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id, cluster)`` for each row of ``docs``.

    ``cluster`` is the least fingerprint of the component and ``component_id`` the least id that is reachable over links. Null and empty texts
    have fingerprint zero and are linked like others; repeated rows stay; a null id takes
    part but is no component id unless all ids of the component are null. Columns other
    than ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, words))
    least = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(least, radius))
    member = (
        least.join(found.withColumnRenamed("id", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("cluster", "fp").alias("cluster"))
    )
    named = member.groupBy("cluster").agg(F.min("first").alias("component_id"))
    ids = member.join(named, "cluster").select("fp", "component_id", "cluster")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id", "cluster")


def keep_one(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one row for each component, that of the least id.

    Where that id stands on several rows of the component, or the component has null ids
    only, any one of these rows stays. All columns are kept as they are.
    """
    found = cut(near_duplicates(docs, words, radius))
    return rows_of_least_ids(docs, found, _fp_column(words))


def rows_of_least_ids(docs: DataFrame, found: DataFrame, fp: Column) -> DataFrame:
    """One row of ``docs`` for each ``cluster`` of ``found``; ``fp`` is the fingerprint of its column ``text``."""
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
    once = ids.where("n = 1 and doc_id = component_id").select("doc_id")
    again = ids.where("n > 1 or doc_id is null").select("doc_id")
    single = docs.join(once, "doc_id", "left_semi")
    # Ids are no keys of rows here, fingerprints are.
    several = docs.join(again, docs["doc_id"].eqNullSafe(again["doc_id"]), "left_semi")
    classes = found.select(
        F.col("fp").alias("_fp"), F.col("component_id").alias("_component"), F.col("cluster").alias("_cluster")
    ).distinct()
    # Null-safe, as a plain join would have the fingerprints tested for null, and so worked
    # out for all rows, ahead of the semi join.
    several = folded(several, doc_id=F.col("doc_id"), text=F.col("text")).withColumn("fp", fp)
    several = (
        several.join(classes, several["fp"].eqNullSafe(classes["_fp"]))
        .where(F.col("doc_id").eqNullSafe(F.col("_component")))
        .dropDuplicates(["_cluster"])
    )
    return single.unionByName(unfolded(several, docs))


def _fp_column(words: int) -> Column:
    @F.pandas_udf("bigint")
    def of(text):
        return text.map(lambda t: fingerprint((t or "").encode(), words))

    return of(F.coalesce("text", F.lit("")))
