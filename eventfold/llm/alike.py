"""Sets of five-word shingles that are alike at a Jaccard likeness of 0.8 or more.

MinHash bands bring sets together: at a likeness of 0.8 two sets share none of the
``BANDS`` bands of ``ROWS`` rows with a chance of (1 - 0.8 ** 4) ** 22, one in 100,000.

Sets that share a band aren't paired at once. In each turn a leader of the band, the same
one in most bands of a group, is compared with all others, so a group of copies costs a
comparison or two a member; pairs within one class add nothing then. What is left are sets
of bands with several classes. Two of them are alike only if they share one of the rarest
``n - ceil(0.8 n) + 1`` shingles of each, where shingles that a single class has come first,
as they can't be shared with another. So a crowd of sets that have a passage in common, or
copies that are a little too far apart, gives few pairs, and none is missed.

Every pair first has its sizes and its sketches compared. A sketch is a bit map of the
hashed shingles; bits that differ stand for shingles that differ, so at a likeness of 0.8
they are a ninth of both sizes at most. The bound never errs; on sets that fill their map it
says little. Pairs that pass are verified by their exact likeness.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventfold.llm.common import WordCache, texts
from eventfold.llm.simhash import rows_of_least_ids
from eventfold.operators.loops import components, cut

SHINGLE, ALIKE, BANDS, ROWS = 5, 0.8, 22, 4
#: Turns of leaders, and how many lead a band in each.
LEADERS = (1, 3)
#: Longs of a sketch, 64 bits each.
SKETCH = 16

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PERMUTED = np.random.default_rng(11).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_hash = None


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each lower-cased word; bytes.lower() changes A-Z alone."""
    global _hash
    if _hash is None:
        import xxhash

        _hash = WordCache(lambda w: xxhash.xxh64_intdigest(w, 5))
    return np.array([_hash[w] for w in text.lower().split()], np.uint64)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A value of each five words in a row; fewer words are one shingle."""
    n = len(hashes)
    size = min(SHINGLE, n)
    value = np.full(n - size + 1 if n else 0, size, np.uint64)
    for k in range(size):
        value = value * _MULTIPLIER + hashes[k : n - size + 1 + k]
    return mix(value)


def bit_maps(values: np.ndarray, of: np.ndarray, parts: int, longs: int = SKETCH) -> np.ndarray:
    """The sketch of each part: ``of`` tells the part of a value, ``longs`` is a power of two."""
    bits = np.zeros((parts, 64 * longs), np.uint8)
    bits[of, (values >> np.uint64(64 - (64 * longs).bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def band_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``BANDS`` keys for each part of ``values``; parts begin at ``starts``, none is empty."""
    step = max(1, (1 << 16) // len(values))
    least = np.concatenate(
        [np.minimum.reduceat(_PERMUTED[i : i + step, None] * values, starts, axis=1) for i in range(0, len(_PERMUTED), step)]
    )
    least = least.reshape(BANDS, ROWS, len(starts))
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(starts), axis=1)
    for r in range(ROWS):
        keys = mix(keys * _MULTIPLIER + least[:, r])
    return keys.T


def links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], leaders: tuple[int, ...] = LEADERS, longs: int = SKETCH) -> DataFrame:
    """Links ``(a, b)`` of sets that are alike, complete up to connection.

    ``nodes`` has ``(whole, n, bands, sketch)``: id, size of the set, band keys and sketch,
    one row each. ``sets_of`` takes ids as ``whole`` and gives ``(whole, shingles)``, one row each.
    Results don't hang on ``leaders``.
    """
    parts = [F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(longs)]
    keys = nodes.select("whole", F.explode("bands").alias("key"))
    # Written, so that its size is known and a small one needs no exchange of all rows.
    met = cut(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    keys = cut(keys.join(met, "key"))
    # Those that meet the most others lead; the text that copies were made from is one of them.
    some = cut(keys.groupBy("whole").agg(F.sum("m").alias("meets")))
    rows = cut(keys.drop("m").join(some.join(nodes.select("whole", "n", *parts), "whole"), "whole"))
    sets = cut(sets_of(some.select("whole")))
    by = Window.partitionBy("key").orderBy(F.desc("meets"), "whole")
    leads = rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= sum(leaders))
    leads = cut(leads.select("key", "whole", "place"))

    def verified(left: DataFrame, right: DataFrame, key: str, differ) -> DataFrame:
        least, most = F.least("l.n", "r.n"), F.greatest("l.n", "r.n")
        bits = sum((F.bit_count(F.col(f"l.s{i}").bitwiseXOR(F.col(f"r.s{i}"))) for i in range(longs)), F.lit(0))
        close = (least * 10 >= most * round(10 * ALIKE)) & (bits * 9 <= least + most)
        pairs = left.alias("l").join(right.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & differ & close)
        ends = F.least("l.whole", "r.whole").alias("a"), F.greatest("l.whole", "r.whole").alias("b")
        pairs = cut(pairs.select(*ends).distinct())
        ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("whole")).distinct())
        held = sets.join(ids, "whole", "left_semi")
        a = held.select(F.col("whole").alias("a"), F.col("shingles").alias("_a"))
        b = held.select(F.col("whole").alias("b"), F.col("shingles").alias("_b"))
        both = F.size(F.array_intersect("_a", "_b"))
        alike = both * 10 >= (F.size("_a") + F.size("_b") - both) * round(10 * ALIKE)
        return cut(pairs.join(a, "a").join(b, "b").where(alike).select("a", "b"))

    other = F.col("l.cluster") != F.col("r.cluster")
    found, named = None, rows.withColumn("cluster", F.col("whole"))
    for turn, lead in enumerate(leaders):
        past = sum(leaders[:turn])
        turns = leads.where(F.col("place").between(past + 1, past + lead))
        more = verified(named.join(turns.select("key", "whole"), ["key", "whole"], "left_semi"), named, "key", other)
        found = more if found is None else found.unionByName(more)
        named = _open_rows(rows, found)
    if found is None:
        named = _open_rows(rows, rows.select(F.col("whole").alias("a"), F.col("whole").alias("b")).limit(0))
    rare = cut(_rarest(named.drop("key", "meets").distinct(), sets))
    more = verified(rare, rare, "shingle", other & (F.col("l.whole") < F.col("r.whole")))
    return more if found is None else found.unionByName(more)


def _open_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the bands that hold more than one class, with the ``cluster`` of each."""
    classes = components(found).withColumnRenamed("id", "whole")
    named = cut(rows.join(classes, "whole", "left").withColumn("cluster", F.coalesce("cluster", "whole")))
    several = named.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high")
    return cut(named.join(several.select("key"), "key", "left_semi"))


def _rarest(named: DataFrame, sets: DataFrame) -> DataFrame:
    """``named`` with a row for each of the shingles that a set must share one of to be alike."""
    all_ = sets.join(named.select("whole", "cluster"), "whole").select("whole", "cluster", F.explode("shingles").alias("shingle"))
    all_ = cut(all_)
    shared = (
        all_.groupBy("shingle").agg(F.count("*").alias("m"), F.min("cluster").alias("low"), F.max("cluster").alias("high"))
        .where("low <> high").select("shingle", "m")
    )
    own = all_.join(shared, "shingle").groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("m", "shingle"))).alias("own"))
    met = named.join(own, "whole")
    # Shingles of one class only stand in front and fill the places first.
    places = F.col("n") - F.ceil(F.col("n") * round(10 * ALIKE) / 10) + 1 - (F.col("n") - F.size("own"))
    few = met.withColumn("places", places.cast("int")).where("places > 0")
    return few.withColumn("own", F.explode(F.slice("own", F.lit(1), F.col("places")))).withColumn("shingle", F.col("own.shingle")).drop("own", "places")


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, whole, n, bands, sketch)`` for each row; ``fp`` tells texts apart, ``whole`` sets."""
    rows = texts(docs).withColumn("fp", F.xxhash64("text"))

    def run(batches):
        for b in batches:
            whole, sizes, bands, short = [], [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                own = np.unique(shingles(word_hashes(text)))
                sizes.append(len(own))
                whole.append(int(mix(mix(own).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]))
                bands.append(band_keys(own, np.zeros(1, np.int64))[0].view(np.int64) if len(own) else [])
                short.append(bit_maps(own, np.zeros(len(own), np.int64), 1)[0])
            lists = pa.list_(pa.int64())
            columns = [b.column("doc_id"), b.column("fp"), pa.array(whole, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bands, lists), pa.array(short, lists)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "whole", "n", "bands", "sketch"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long, whole long, n int, bands array<long>, sketch array<long>")


def keep_one(docs: DataFrame, leaders: tuple[int, ...] = LEADERS) -> DataFrame:
    """The rows of ``docs`` with one row for each class of texts that are alike, that of the
    least id, as in ``simhash.keep_one``. Texts without words are one class."""
    rows = cut(sketches(docs))
    once = rows.groupBy("whole").agg(
        F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.any_value(F.struct("n", "bands", "sketch")).alias("own")
    )
    nodes = cut(once.select("whole", "first", "fp", "own.*"))

    def sets(batches):
        for b in batches:
            own = [np.unique(shingles(word_hashes(t))).view(np.int64) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("whole"), pa.array(own, pa.list_(pa.int64()))], ["whole", "shingles"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = nodes.join(wanted, "whole", "left_semi").select("fp", "whole")
        read = texts(docs).select("text").withColumn("fp", F.xxhash64("text")).join(wanted, "fp").select("text", "whole")
        return read.mapInArrow(sets, "whole long, shingles array<long>").dropDuplicates(["whole"])

    classes = components(links(nodes, sets_of, leaders)).withColumnRenamed("id", "whole")
    member = nodes.join(classes, "whole", "left").select("whole", "first", F.coalesce("cluster", "whole").alias("cluster"))
    named = member.groupBy("cluster").agg(F.min("first").alias("component_id"))
    ids = member.join(named, "cluster").select("whole", "component_id", "cluster")
    found = cut(rows.select("doc_id", "fp", "whole").join(ids, "whole").select("doc_id", "fp", "component_id", "cluster"))
    return rows_of_least_ids(docs, found, F.xxhash64(F.coalesce("text", F.lit(""))))
