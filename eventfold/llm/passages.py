"""Substring dedup: paragraphs that repeat across documents, by MinHash banding.

Paragraphs are the lines of a text. Lines of eight words or more that are alike at 0.8 are
linked (see ``alike``), and connected components of the verified links are the clusters.

For passages inside of longer lines, lines are cut further into pieces, at places that
depend on the words around them alone (a word whose hash is the least within a few words
on both sides). A passage that was copied into the middle of another line is therefore cut
the same way there, but for its ends. Equal pieces are one cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventfold.llm import alike
from eventfold.llm.alike import LEADERS, SHINGLE, mix
from eventfold.llm.common import texts
from eventfold.operators.loops import components, cut, remove
from eventfold.session import fresh_path

REACH, MIN_WORDS, MAX_WORDS = 5, 5, 16
#: A passage is reported when so many of its words in a row repeat.
PASSAGE_WORDS = 20
#: Fewer shingles can't be alike without being equal: 3 of 4 are less than 0.8.
MIN_SHINGLES = 4
#: Longs of a paragraph's sketch.
LONGS = 4
#: Bytes of text that are cut together.
TOGETHER = 1 << 19

_SALTS = [np.uint64(c) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Cuts:
    """The words of texts, their paragraphs (lines) and their pieces.

    ``text`` may be several texts with line breaks between them, that begin at ``starts``;
    ``of`` is the text of each word. ``firsts`` and ``lasts`` are word numbers of paragraphs,
    ``pieces`` the first words of pieces.
    """

    def __init__(self, text: bytes, starts: np.ndarray | None = None):
        octets = self.octets = np.frombuffer(text, np.uint8)
        self.starts = np.zeros(1, np.int64) if starts is None else starts
        blank = np.concatenate(([True], (octets == 32) | ((octets >= 9) & (octets <= 13)), [True]))
        change = np.flatnonzero(blank[1:] != blank[:-1])
        self.begins, self.ends = change[::2], change[1::2]
        n = self.n = len(self.begins)
        self.firsts = self.lasts = self.of = np.empty(0, np.int64)
        if not n:
            return
        self.of = np.searchsorted(self.starts, self.begins, "right") - 1
        self.hashes = _word_hashes(octets, self.begins)
        line = np.cumsum(octets == 10, dtype=np.int32)[self.begins]
        self.new = np.append(True, line[1:] != line[:-1])
        self.firsts = np.flatnonzero(self.new)
        self.lasts = np.append(self.firsts[1:], n)
        self.shingles = alike.shingles(self.hashes) if n >= SHINGLE else np.empty(0, np.uint64)

    @cached_property
    def pieces(self) -> np.ndarray:
        n = self.n
        if not n:
            return np.empty(0, np.int64)
        rank = mix(self.hashes)
        least = np.ones(n, bool)
        for d in range(1, REACH + 1):
            apart = self.of[d:] != self.of[:-d]
            least[d:] &= (rank[d:] < rank[:-d]) | apart
            least[:-d] &= (rank[:-d] <= rank[d:]) | apart
        firsts = np.flatnonzero(least | self.new)
        times = -(-np.diff(np.append(firsts, n)) // MAX_WORDS)  # longer ones in parts of the most words
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(firsts, times) + within * MAX_WORDS

    @cached_property
    def signs(self) -> np.ndarray | None:
        """Code points before each byte; none where every byte is one."""
        if not (self.octets >= 0x80).any():
            return None
        return np.concatenate(([0], np.cumsum((self.octets & 0xC0) != 0x80)))

    def places(self, firsts: np.ndarray, lasts: np.ndarray) -> list[np.ndarray]:
        """Where words begin and end in their text, in code points."""
        ends = self.begins[firsts], self.ends[lasts - 1], self.starts[self.of[firsts]]
        begin, end, base = ends if self.signs is None else (self.signs[e] for e in ends)
        return [begin - base, end - base]

    def whole(self, firsts: np.ndarray | None = None) -> np.ndarray:
        """A hash of the words in order of each paragraph, or of each part that begins at ``firsts``."""
        firsts = self.firsts if firsts is None else firsts
        at = np.arange(self.n, dtype=np.uint64) - np.repeat(firsts, np.diff(np.append(firsts, self.n))).astype(np.uint64)
        return np.add.reduceat(mix(self.hashes + at * _SALTS[0]), firsts)

    def sketches(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Set sizes, band keys and sketches of the paragraphs ``some``, each of five words at least."""
        counts = self.lasts[some] - self.firsts[some] - SHINGLE + 1
        starts = np.cumsum(counts) - counts
        of = np.repeat(np.arange(len(some)), counts)
        values = self.shingles[np.arange(counts.sum()) - starts[of] + self.firsts[some][of]]
        # Only values that stand there twice can do so within a paragraph.
        order = np.argsort(values)
        twice = values[order][1:] == values[order][:-1]
        order = order[np.append(twice, False) | np.append(False, twice)]
        order = order[np.lexsort((values[order], of[order]))]
        same = (values[order][1:] == values[order][:-1]) & (of[order][1:] == of[order][:-1])
        sizes = counts - np.bincount(of[order][1:][same], minlength=len(some))
        return sizes, alike.band_keys(values, starts), alike.bit_maps(values, of, len(some), LONGS)

    def shingle_set(self, no: int) -> list[int]:
        """The shingles of a paragraph as a sorted set of signed numbers."""
        end = max(self.firsts[no], self.lasts[no] - SHINGLE + 1)
        return np.unique(self.shingles[self.firsts[no] : end].view(np.int64)).tolist()


def _word_hashes(octets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """``alike.word_hashes`` of words that begin at ``begins``: each different one is hashed once."""
    lower = octets + ((octets >= 65) & (octets <= 90)) * np.uint8(32)
    offsets = pa.py_buffer(np.append(begins, len(octets)).astype(np.int64))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, offsets, pa.py_buffer(lower)])
    # A word is cut with the blanks behind it, which the hash leaves out again.
    met = words.dictionary_encode()
    return alike.word_hashes(b" ".join(met.dictionary.to_pylist()))[met.indices.to_numpy()]


def _joined(texts: list[bytes], most: int = TOGETHER) -> Iterator[tuple[int, Cuts]]:
    """Cuts of texts taken together up to ``most`` bytes, and the number of the first of them."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) < most:
            size += len(texts[to])
            to += 1
        lengths = np.array([len(t) + 1 for t in texts[at:to]])
        yield at, Cuts(b"\n".join(texts[at:to]), np.cumsum(lengths) - lengths)
        at = to


def with_neighbours(whole: np.ndarray, short: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and hashes of pieces, where short ones are hashed with a neighbour of the same text."""
    pair, joined = whole[:-1] * _SALTS[1] + whole[1:], of[1:] == of[:-1]
    long, second, first = np.flatnonzero(~short), np.flatnonzero(short[1:] & joined) + 1, np.flatnonzero(short[:-1] & joined)
    hashes = whole[long], mix(pair[second - 1] + _SALTS[0]), mix(pair[first] + _SALTS[2])
    return np.concatenate((long, second, first)), np.concatenate(hashes)


def pieces_and_paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, no, last, start, end, words, whole, n, bands, sketch)``, from one reading.

    ``start`` and ``end`` are in code points. Null and empty texts have no row. Pieces have
    their number as ``no`` and ``last``, and no ``bands``; every piece has a row of its
    own, also where its paragraph has just this piece. Pieces under five words repeat by
    chance, so a short one counts together with the one before and with the one after it:
    one row for each, with the words of both in ``whole``. Paragraphs have rows with their
    first and last piece, set size ``n`` and ``bands`` where they can be alike without being equal.
    """
    rows = texts(docs).withColumn("row_key", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "row_key", "no", "last", "start", "end", "words", "whole", "n", "bands", "sketch"]
    lists = pa.list_(pa.int64())

    def listed(rows: np.ndarray) -> pa.Array:
        offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.view(np.int64).ravel()))

    def run(batches):
        for b in batches:
            for at, cuts in _joined(b.column(1).cast(pa.binary()).to_pylist()):
                if not cuts.n:
                    continue
                zero = np.searchsorted(cuts.pieces, np.searchsorted(cuts.of, np.arange(len(cuts.starts))))

                def batch(no, last, firsts, lasts, whole, n, bands, sketch):
                    of = cuts.of[firsts]
                    take = pa.array((at + of).astype(np.int32))
                    small = (no - zero[of], last - zero[of], *cuts.places(firsts, lasts), lasts - firsts)
                    columns = [b.column(0).take(take), b.column(2).take(take), *[pa.array(c.astype(np.int32)) for c in small]]
                    columns += [pa.array(whole.view(np.int64)), pa.array(n.astype(np.int32)), bands, sketch]
                    return pa.RecordBatch.from_arrays(columns, names)

                firsts, lasts = cuts.pieces, np.append(cuts.pieces[1:], cuts.n)
                some, own = with_neighbours(cuts.whole(firsts), lasts - firsts < MIN_WORDS, cuts.of[firsts])
                none = pa.nulls(len(some), lists)
                yield batch(some, some, firsts[some], lasts[some], own, np.zeros(len(some), np.int64), none, none)
                some = np.flatnonzero(cuts.lasts - cuts.firsts >= SHINGLE + MIN_SHINGLES - 1)
                if len(some):
                    n, keys, maps = cuts.sketches(some)
                    ends = [np.searchsorted(cuts.pieces, at_[some]) for at_ in (cuts.firsts, cuts.lasts)]
                    lines = cuts.firsts[some], cuts.lasts[some], cuts.whole()[some]
                    yield batch(ends[0], ends[1] - 1, *lines, n, listed(keys), listed(maps))

    return rows.mapInArrow(
        run,
        f"doc_id {kind}, row_key long, no int, last int, start int, end int, words int, whole long, n int, bands array<long>, sketch array<long>",
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """The rows of paragraphs that can be alike without being equal."""
    return pieces_and_paragraphs(docs).where(F.col("bands").isNotNull())


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(whole, shingles)`` of the paragraphs ``wanted``: ``(doc_id, wholes)``."""

    def run(batches):
        for b in batches:
            whole, sets = [], []
            asked = np.unique(b.column("wholes").flatten().to_numpy())
            for _, cuts in _joined(b.column("text").cast(pa.binary()).to_pylist()):
                if not cuts.n:
                    continue
                own = cuts.whole().view(np.int64)
                for no in np.flatnonzero(np.isin(own, asked)):
                    whole.append(own[no])
                    sets.append(cuts.shingle_set(no))
            yield pa.RecordBatch.from_arrays([pa.array(whole, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["whole", "shingles"])

    return texts(docs).join(wanted, "doc_id").select("text", "wholes").mapInArrow(run, "whole long, shingles array<long>")


def _links(docs: DataFrame, distinct: DataFrame, leaders: tuple[int, ...]) -> DataFrame:
    """Links ``(a, b)`` of different paragraphs that are alike, complete up to connection."""

    def sets_of(wanted: DataFrame) -> DataFrame:
        # Read again from one document that has the paragraph.
        homes = distinct.join(wanted, "whole", "left_semi").groupBy(F.col("home").alias("doc_id"))
        return shingle_sets(docs, homes.agg(F.collect_set("whole").alias("wholes"))).dropDuplicates(["whole"])

    # Whole keys: paragraphs that meet by chance in 32 bits of one grow with the square of the input.
    return alike.links(distinct.select("whole", "n", "bands", "sketch"), sets_of, leaders, LONGS)


def repeats(docs: DataFrame, passage_words: int = PASSAGE_WORDS, leaders: tuple[int, ...] = LEADERS) -> DataFrame:
    """Passages that stand in two documents or more, one row for each place.

    ``(doc_id, start, end, n_words, clusters, first_doc, removed)``: ``clusters`` are the
    ids of the clusters of its parts in order (of a paragraph with near copies, else of equal
    pieces), ``first_doc`` the least id of a document that
    has the first of them, and ``removed`` tells whether a document with a lower id keeps
    all of the passage's parts. Shorter runs of repeated pieces are ordinary
    lines and are left alone. Repeats within one document don't count. Null and empty
    texts have no passage; documents without an id are left out; rows of one id are one
    document; other columns are ignored.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    place = ["doc_id", "row_key", "no", "last", "start", "end", "words"]
    homes = [F.min("doc_id").alias("home"), F.max("doc_id").alias("last")]
    # What is read takes most of the room, its bands and sketches above all: it goes as soon as
    # the pieces that repeat are picked and each different line is written once, and the lines
    # go with their bands as soon as the links are known.
    spark = docs.sparkSession
    paths = [fresh_path(spark, name) for name in ("read", "lines", "lines")]
    read = cut(pieces_and_paragraphs(docs), paths[0])
    pieces, lines = read.where(F.col("bands").isNull()), read.where(F.col("bands").isNotNull())
    same = cut(
        pieces.groupBy("whole").agg(*homes).where("home < last").select(
            "whole", F.col("whole").alias("cluster"), F.col("home").alias("first")
        )
    )
    pieces = cut(pieces.select(*place, "whole").join(same, "whole"))
    once = lines.groupBy("whole").agg(*homes, F.any_value(F.struct("n", "bands", "sketch")).alias("own"))
    # In two halves, so that half of them stand on the disk as shuffles at a time.
    halves = [cut(once.where(F.pmod("whole", F.lit(2)) == i).select("whole", "home", "last", "own.*"), paths[1 + i]) for i in (0, 1)]
    distinct = halves[0].unionByName(halves[1])
    lines = cut(lines.select(*place, "whole"))
    remove(spark, paths[0])
    named = components(_links(docs, distinct, leaders)).withColumnRenamed("id", "whole")
    near = cut(distinct.select("whole", "home", "last").join(named, "whole"))
    for path in paths[1:]:
        remove(spark, path)
    spread = near.groupBy("cluster").agg(F.min("home").alias("first"), F.max("last").alias("last"))
    near = cut(near.join(spread.where("first < last").drop("last"), "cluster").select("whole", "cluster", "first"))
    rows = pieces.unionByName(lines.join(near, "whole"))
    # Equal rows of a document are one, and so are the rows of a piece; the windows then need
    # no other exchange.
    rows = (
        rows.repartition("doc_id", "row_key").groupBy(*place)
        .agg(F.min(F.struct("first", "cluster")).alias("least")).select(*place, "least.first", "least.cluster")
    )
    # A paragraph stands for its pieces; a run goes on as long as numbers do.
    in_doc = Window.partitionBy("doc_id", "row_key").orderBy("no", F.desc("last"))
    past = F.max("last").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("past", past).where("past is null or last > past")
    new = (F.col("past").isNull() | (F.col("no") > F.col("past") + 1)).cast("int")
    runs = rows.withColumn("run", F.sum(new).over(in_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    passages = runs.groupBy("doc_id", "row_key", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"),
        F.array_sort(F.collect_list(F.struct("no", "cluster", "first"))).alias("parts"),
    )
    return passages.where(F.col("n_words") >= passage_words).select(
        "doc_id", "start", "end", "n_words", F.col("parts.cluster").alias("clusters"),
        F.element_at("parts.first", 1).alias("first_doc"),
        F.forall("parts", lambda p: p["first"] < F.col("doc_id")).alias("removed"),
    )
