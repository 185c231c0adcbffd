"""Best-fit packing planned over the histogram of lengths, not over documents.

1. Texts become token ids; longer ones are cut into full pieces and a rest.
2. The histogram of piece lengths, at most one row for each length up to the limit, goes
   to the driver. Best-fit decreasing runs on counts: all pieces of a length are placed
   into groups of equal sequences at once, so the plan depends on the limit alone.
3. The plan has segments: ranks ``first`` to ``first + n`` of a length fill sequences
   ``seq``, ``seq + 1``, ... with ``per`` pieces each, from offset ``offset``. Pieces take
   their place by joining with the segments on length and rank within length.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.common import WordCache, running, texts
from eventfold.llm.wordpiece import byte_letters
from eventfold.operators.loops import cut

LIMIT = 2048
#: The first sign beyond the Latin letters that are composed in themselves.
LATIN_END = "\u0250"
SEGMENTS = "length long, first long, n long, seq long, per long, offset long"

_tokenizers: dict[str, WordCache] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_ids(path: str) -> WordCache:
    """Ids, packed as little-endian 32-bit numbers, of words without ASCII white space.

    The tokenizer drops white space and no token spans it, so the ids of a text are those
    of its words in turn. Words of Latin letters, a stop or comma behind them or not, go
    to the merges at once: letters and marks are split before the merges, and such letters
    are composed already. All other words go through the whole tokenizer.
    """
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are packed as little-endian 32-bit numbers")
        tokenizer = Tokenizer.from_file(path)
        merges = tokenizer.model.tokenize
        letters = {byte: letter for letter, byte in byte_letters().items()}

        def of_word(word: bytes) -> bytes:
            text = word.decode()
            if text[-1] in ".," and text[:-1].isalpha():
                return ids[word[:-1]] + ids[word[-1:]]
            low = text.lower()
            if text.isalpha() and max(text) < LATIN_END and low.isalpha():
                return array("I", [t.id for t in merges(low.encode().decode("latin-1").translate(letters))]).tobytes()
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

        ids = _tokenizers[path] = WordCache(of_word, 500_000)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """``(doc_id, row_key, piece, start, length, ids_crc32)``, at least one row for a document.

    A document's ids end with ``end_id``, so an empty or null text has one. ``row_key``
    tells apart rows of one id.
    """
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids_of = word_ids(path)
        for b in batches:
            take, out = [], ([], [], [], [])
            for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                # Case doesn't matter to the ids, unless a special token could stand there.
                words = (text if b"<|" in text else text.lower()).split()
                ids = b"".join([ids_of[w] for w in words]) + end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    take.append(i)
                    for column, value in zip(out, (k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            at = pa.array(take, pa.int32())
            numbers = [pa.array(out[0], pa.int32()), *[pa.array(c, pa.int64()) for c in out[1:]]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), *numbers], names)

    keyed = rows.withColumn("row_key", F.xxhash64("text"))
    schema = f"doc_id {kind}, row_key long, piece int, start long, length long, ids_crc32 long"
    return keyed.mapInArrow(run, schema)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Segments ``(length, first, n, seq, per, offset)`` for a histogram of lengths.

    Longest lengths first; each piece goes to the fullest sequence that still has room.
    Sequences of equal room are kept as ranges of numbers; a length uses whole ranges,
    and splits one at most where its pieces run out.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges (seq, n)
    made, segments = 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for r in range(length, limit):  # the tightest first
            ranges, room[r] = room[r], []
            while ranges:
                seq, n = ranges.pop()
                per = min(r // length, left) if left else 0
                if not per:
                    room[r].append((seq, n))
                    continue
                full = min(n, left // per)
                segments.append((length, rank, full * per, seq, per, limit - r))
                room[r - per * length].append((seq, full))
                left, rank = left - full * per, rank + full * per
                if full < n:
                    ranges.append((seq + full, n - full))
        if left:
            per = limit // length
            full, rest = divmod(left, per)
            for n, k in ((full, per), (min(rest, 1), rest)):
                if n:
                    segments.append((length, rank, n * k, made, k, 0))
                    room[limit - k * length].append((made, n))
                    rank, made = rank + n * k, made + n
    return segments


def pack(cut_pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``length`` (1 to ``limit``).

    The rank within a length comes from parts of bounded size, so a length that a third
    of all pieces share is no single task. The segments number a few for each of at most
    ``limit`` lengths and are broadcast.
    """
    spark: SparkSession = cut_pieces.sparkSession
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    segments = spark.createDataFrame(plan(counts, limit), SEGMENTS)
    ranked = running(cut_pieces.withColumn("_one", F.lit(1)), "length", ["doc_id", "row_key", "piece"], "_one", "_rank")
    met = ranked.join(
        F.broadcast(segments.withColumnRenamed("length", "_l")),
        (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("n")),
    )
    k = F.col("_rank") - F.col("first")
    return met.select(
        *[c for c in cut_pieces.columns],
        (F.col("seq") + F.floor(k / F.col("per"))).alias("sequence_id"),
        (F.col("offset") + (k % F.col("per")) * F.col("length")).alias("offset"),
    )


def packed(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most ``limit`` tokens.

    ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``. Null texts count
    as empty and have one piece, the closing token; repeated rows have pieces of their
    own; other columns are ignored; no documents give no pieces.
    """
    return pack(cut(pieces(docs, path or vocabulary_path(), limit)), limit).drop("row_key")
