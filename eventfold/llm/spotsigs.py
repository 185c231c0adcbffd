"""SpotSigs: signatures of content words that follow common words.

An anchor is a common word. From each anchor a chain of the content words that follow it,
common words skipped, forms a signature, so navigation and other text without common words
leaves few signatures. A fingerprint is the set of signatures. Sets are compared by
Jaccard likeness, pruned: sets of sizes ``m <= n`` are no more alike than ``m / n``, so
sizes are dealt into parts by powers of the least likeness, and only sets of equal or
neighbouring parts are compared at all.
"""

from __future__ import annotations

import bisect
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import WordCache, texts

# Fixed list of common words: English, German, French, Spanish.
ANCHORS = frozenset(
    "the a an of to and in is was are be that it for on with as at by this from or "
    "der die das und ist zu den von mit ein eine nicht auch auf für sich dem des im "
    "le la les de du et est un une en pour que qui dans sur pas par au "
    "el los las del y es con para su se lo no".split()
)
CHAIN = 2
#: Sets less alike than this count as not alike at all.
FLOOR = 0.05
STRIP = ".,;:!?\"'()[]{}<>|*#&%$«»„“”‚‘’…-_~/\\"

_code = None


def _word_code(word: bytes) -> int:
    """A hash of the bare lower-cased word; the last bit tells common words, 1 empty ones."""
    bare = word.decode().lower().strip(STRIP)
    if not bare:
        return 1
    return (xxhash.xxh64_intdigest(bare, 3) & ~3) | (2 if bare in ANCHORS else 0)


def _codes() -> WordCache:
    global _code
    if _code is None:
        _code = WordCache(_word_code)
    return _code


def signatures(text: bytes, chain: int = CHAIN) -> np.ndarray:
    """The signatures of a text as a sorted set of 32-bit numbers.

    Without any anchor every word is one, and without a chain the words as a whole are
    the one signature; a text without words has none.
    """
    words = text.split()
    if not words:
        return np.empty(0, np.uint32)
    known = _codes()
    codes = np.fromiter([known[w] for w in words], np.uint64, len(words))
    codes = codes[codes != 1]
    anchor = (codes & np.uint64(2)).astype(bool)
    content = codes[~anchor]
    if anchor.any():
        following = np.cumsum(~anchor)[anchor]
        heads = codes[anchor]
    else:
        following, heads = np.arange(1, len(content) + 1), content
    fits = following + chain <= len(content)
    following, value = following[fits], heads[fits]
    for k in range(chain):
        value = (value ^ content[following + k]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    found = np.unique((value >> np.uint64(32)).astype(np.uint32))
    if not len(found):
        found = np.array([xxhash.xxh32_intdigest(b" ".join(words))], np.uint32)
    return found


def as_text(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def length_part(n: int, floor: float = FLOOR) -> int:
    """Sets whose parts differ by two or more are less alike than ``floor``."""
    return int(math.log(max(1, n)) / -math.log(floor))


def likeness(a: np.ndarray, b: np.ndarray, floor: float = FLOOR) -> float:
    """Jaccard likeness of two sorted sets, 0 where it is under ``floor``; two empty sets are equal."""
    small, large = sorted((a, b), key=len)
    if not len(small):
        return 1.0 if not len(large) else 0.0
    if abs(length_part(len(large), floor) - length_part(len(small), floor)) > 1 or len(small) < floor * len(large):
        return 0.0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    found = both / (len(a) + len(b) - both)
    return found if found >= floor else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the next one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(docs: DataFrame) -> DataFrame:
    """``(part, carry, doc_id, text)``: ranges of descending ids, each with the next range's head.

    Splitting ids come from quantiles, as many as there are shuffle partitions, and the
    heads number the same; the texts are moved once.
    """
    spark = docs.sparkSession
    rows = texts(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = [i / parts for i in range(1, parts)]
    split = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", wanted, 0.2 / parts) if wanted else []
    split = sorted({int(s) for s in split or []})

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        # Descending ids, null ids last.
        return ids.map(lambda i: len(split) + 1 if pd.isna(i) else len(split) - bisect.bisect_left(split, i))

    placed = rows.withColumn("part", part_of("doc_id"))
    heads = sorted((r["part"], r["head"]) for r in placed.groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        return placed.select("part", F.lit(False).alias("carry"), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    to = [(heads[i - 1][0], head) for i, (_, head) in enumerate(heads)]  # the last range goes on with the first
    carried = spark.createDataFrame(to, f"to int, head {kind}")
    carry = rows.join(F.broadcast(carried), rows["doc_id"].eqNullSafe(carried["head"]))
    every = placed.select("part", F.lit(False).alias("carry"), "doc_id", "text").unionByName(
        carry.select(F.col("to").alias("part"), F.lit(True).alias("carry"), "doc_id", "text")
    )
    return every.repartition(parts, "part").sortWithinPartitions(
        "part", "carry", F.col("doc_id").desc_nulls_last(), "text"
    )


def compared(docs: DataFrame, chain: int = CHAIN, floor: float = FLOOR) -> DataFrame:
    """For each row its fingerprint, its edited text's, and their likenesses.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_signatures, length_part)``. The next document is the one with the next
    lower id, rows of one id by text, null ids last; after the last comes the first. Null
    texts are empty; an empty text has an empty fingerprint, like another empty text's;
    other columns are ignored.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures", "length_part"]
    dealt = _dealt(docs)
    field = dealt.schema["doc_id"]

    def run(batches):
        last = None
        for b in batches:
            out = [[] for _ in names]
            columns = [c.to_pylist() for c in (b.column("part"), b.column("carry"), b.column("doc_id"), b.column("text"))]
            for part, carry, doc_id, text in zip(*columns, strict=True):
                sigs = None if carry and last is None else signatures(text.encode(), chain)
                if last is not None and last[0] == part:
                    _, own_id, own, own_sigs = last
                    new = edited(own, text)
                    new_sigs = signatures(new.encode(), chain)
                    values = (
                        own_id, len(own), hashlib.sha256(new.encode()).hexdigest(), as_text(own_sigs), as_text(new_sigs),
                        likeness(own_sigs, new_sigs, floor), likeness(own_sigs, sigs, floor),
                        len(own_sigs), length_part(len(own_sigs), floor),
                    )
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                last = None if carry else (part, doc_id, text, sigs)
            if out[0]:
                kinds = [b.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    schema = f"doc_id {field.dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures int, length_part int"
    return dealt.mapInArrow(run, schema)
