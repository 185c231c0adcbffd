"""How far the sources of a language are apart, from exact term shares.

Identical texts of a language are one row with a count for each source, and are split into
terms once. Terms are runs of ASCII letters and of anything beyond ASCII; only A-Z are
lower-cased. Kept are the terms in at least ``MIN_DOCS`` documents of their language. With
N occurrences of V kept terms a group gives a term the share
``p = 1 + floor(UNIT * (count + 1) / (N + V))``; the distance of p from q is
``floor((p - q) * (p - q) / q)``, summed over all kept terms for a pair of sources.

Most terms miss from most sources, where p is the constant of its group. So a pair is
worked out sparsely: terms of one source alone come from a histogram of that source's
counts, and only terms that both sources have are met by a join:

    D(A,B) = V f(a0,b0) + sum over A's terms of (f(a,b0) - f(a0,b0))
                        + sum over B's terms of (f(a0,b) - f(a0,b0))
                        + sum over common terms of (f(a,b) - f(a,b0) - f(a0,b) + f(a0,b0))

All numbers are longs; they hold up to 9e13 occurrences in a group. Null text, lang and
source count as empty. Repeated rows are documents of their own. Groups without any term
have rows of part ``pair``. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.llm.common import BATCH_ROWS
from eventfold.operators.loops import cut

MIN_DOCS, TOP_TERMS, UNIT = 3, 200, 1_000_000_000
#: Term counts that a task holds before it hands them on.
HELD_TERMS = 300_000

_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))
#: Bytes outside terms become spaces, A-Z become a-z.
_TERMS = bytes(b if b >= 0x80 else b | 0x20 if b in _LETTERS else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _rows(docs: DataFrame) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``(lang, text, sources)``: each text of a language once, ``sources`` with counts."""
    keyed = _rows(docs).withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = (
        keyed.groupBy("lang", "digest", "source").agg(F.count("*").alias("copies"))
        .groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "copies")).alias("sources"))
    )
    once = keyed.groupBy("lang", "digest").agg(F.any_value("text").alias("text"))
    return once.join(copies, ["lang", "digest"]).select("lang", "text", "sources")


def _counted(batches):
    held = defaultdict(lambda: (Counter(), Counter()))  # (lang, source): occurrences, documents

    def flush():
        for (lang, source), (counts, docs) in held.items():
            n = len(counts)
            names = pa.array(list(counts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), names,
                    pa.array([docs[t] for t in counts], pa.int64()), pa.array(list(counts.values()), pa.int64()),
                ],
                ["lang", "source", "term", "docs", "n"],
            )
        held.clear()

    for b in batches:
        texts = b.column(1).cast(pa.binary())
        for i, (lang, sources) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
            words = terms(texts[i].as_py())
            if len(sources) == 1 and sources[0]["copies"] == 1:
                counts, docs = held[lang, sources[0]["source"]]
                counts.update(words)
                docs.update(set(words))
                continue
            once = Counter(words)
            for s in sources:
                counts, docs = held[lang, s["source"]]
                for term, n in once.items():
                    counts[term] += n * s["copies"]
                    docs[term] += s["copies"]
        if sum(len(counts) for counts, _ in held.values()) > HELD_TERMS:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, term, source, n)`` of kept terms: the occurrences in each source that has some."""
    counted = distinct_texts(docs).mapInArrow(_counted, "lang string, source string, term string, docs long, n long")
    # Dealt by term once: its sources and its documents are summed up in place. A term has
    # a row for each source and task at most.
    by_source = (
        counted.repartition("lang", "term").groupBy("lang", "term", "source")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    )
    everywhere = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return by_source.withColumn("docs", everywhere).where(F.col("docs") >= MIN_DOCS).drop("docs")


def share(count: str, total: str) -> Column:
    """``1 + floor(UNIT * (count + 1) / total)`` in two steps, so that longs suffice."""
    high, low = 10_000, UNIT // 10_000
    scaled = f"(({count} + 1) * {high}L)"
    return F.expr(f"1L + ({scaled} div {total}) * {low}L + (({scaled} % {total}) * {low}L) div {total}")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def shares(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms ``(lang, term, source, n, p, absent, q)`` and groups ``(lang, source, total, terms, absent)``.

    ``p`` is the share of the term in its source, ``q`` in its language and ``absent`` the
    share of a term that the source lacks; ``total`` is N + V and ``terms`` V. Every source
    of a language has a group.
    """
    counts = cut(term_counts(docs))
    languages = (
        counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
        .groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("terms"))
    )
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = (
        _rows(docs).select("lang", "source").distinct()
        .join(sums, ["lang", "source"], "left").join(languages, "lang", "left")
        .select(
            "lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"),
            (F.coalesce("n", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("total"),
            (F.col("lang_n") + F.col("terms")).alias("lang_total"),
        )
        .withColumn("absent", F.when(F.col("total") > 0, share("0L", "total")))
    )
    groups = cut(groups)
    everywhere = F.sum("n").over(Window.partitionBy("lang", "term"))
    terms = (
        counts.withColumn("lang_n", everywhere).join(groups, ["lang", "source"])
        .withColumn("p", share("n", "total")).withColumn("q", share("lang_n", "lang_total"))
        .select("lang", "term", "source", "n", "p", "absent", "q")
    )
    return cut(terms), groups


def pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: the distance of each source from each other one."""
    one = groups.select("lang", "source", "terms", F.col("absent").alias("a0"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("b0"))
    every = one.join(other, "lang").where("source <> item")
    both = "lang", "source", "item"
    base = every.select(*both, F.coalesce(F.col("terms") * distance("a0", "b0"), F.lit(0)).alias("value"))

    histogram = terms.groupBy("lang", "source", "p").agg(F.count("*").alias("many"))
    own = every.join(histogram, ["lang", "source"]).groupBy(*both).agg(
        F.sum(F.col("many") * (distance("p", "b0") - distance("a0", "b0"))).alias("value")
    )
    others = every.join(histogram.withColumnRenamed("source", "item"), ["lang", "item"]).groupBy(*both).agg(
        F.sum(F.col("many") * (distance("a0", "p") - distance("a0", "b0"))).alias("value")
    )
    left = terms.select("lang", "term", "source", "p", F.col("absent").alias("a0"))
    right = terms.select(
        "lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("absent").alias("b0")
    )
    common = left.join(right, ["lang", "term"]).where("source <> item").groupBy(*both).agg(
        F.sum(distance("p", "q") - distance("p", "b0") - distance("a0", "q") + distance("a0", "b0")).alias("value")
    )
    parts = base.unionByName(own).unionByName(others).unionByName(common)
    return parts.groupBy(*both).agg(F.sum("value").alias("value"))


def typical(terms: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: terms that a source has more often than its language."""
    return terms.where("p > q").select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"))


def audit(docs: DataFrame, top_terms: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: all pairs, and the top terms of each source."""
    terms, groups = shares(docs)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        rows.withColumn("rank", F.row_number().over(by)).withColumn("part", F.lit(part))
        for part, rows in (("pair", pairs(terms, groups)), ("term", typical(terms)))
    ]
    found = ranked[0].unionByName(ranked[1].where(F.col("rank") <= top_terms))
    return found.select("lang", "source", "part", "item", "value", "rank")
