"""Mixing sources to target weights by blocks of tokens; DataFrame operations only.

1. The tokens (words) of a source, its documents one after the other, are packed into
   blocks of fixed length; the last block of a source may be shorter.
2. Every output shard draws its slots' sources: multinomial counts, by one hash draw a
   slot. Draws of a source beyond its target are drawn again among the sources short of
   theirs, so the totals come out as planned.
3. The slots of a source count on over all shards; a pseudorandom permutation of the
   block indices (a swap-or-not shuffle, another one for each pass over the source) maps
   them to blocks, so that no block comes again before all of its source have come.
4. Slots and blocks are joined by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.llm.common import folded, running, unfolded, word_count
from eventfold.operators.loops import cut

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
BLOCK, SHARD_SLOTS, CELLS, ROUNDS, SEED = 32, 4096, 4096, 6, 20240
#: Slots made by one task, and the most tasks that make some.
TASK_SLOTS, MOST_TASKS = 250_000, 20_000


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """``(ix, source, source_size, target)``, one row for each source.

    ``sizes`` has ``source`` and ``size``. Sources in code point order, null last, weigh
    ``weights`` in turn. ``share`` times all sizes is dealt by weight; a target stops at
    ``cap`` times its source's size and the excess goes to the others by weight.

    Sources fill up in the order of cap by weight, so the common level is found by running
    sums over the sources: those that would overflow are the first ones in that order.
    The windows see one row for each source, never a document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = (
        per.withColumn("ix", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
        .withColumn("w", F.element_at(turn, (F.col("ix") - 1).cast("int") % len(weights) + 1))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
    )
    every = Window.orderBy("fill", "ix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("fill", "ix").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("fill", "ix").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum(
        "w"
    ).over(onward)
    filled = per.withColumn("fill", F.col("most") / F.col("w")).withColumn("level", level)
    # Of the sources that don't fill up the first has the level of all of them, the largest.
    common = F.max(F.when(F.col("fill") > F.col("level"), F.col("level"))).over(every)
    return filled.withColumn("common", common).select(
        "ix", "source", "source_size",
        F.when(F.col("fill") > F.col("level"), F.col("w") * F.col("common")).otherwise(F.col("most")).alias("target"),
    )


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, row_key)``; the key tells rows of one id apart."""
    return docs.select(
        "doc_id", "source", word_count("text").alias("size"), F.xxhash64("text", "source").alias("row_key")
    )


def permuted(index: str, size: str, *key: str, rounds: int = ROUNDS, seed: int = SEED) -> Column:
    """The place of ``index`` within ``[0, size)``, another permutation for each key.

    Swap-or-not: a round pairs every ``x`` with ``k - x`` and a bit hashed from the larger
    of the two says whether they change places, which is a bijection for any size.
    """

    def swap(x: Column, r: Column) -> Column:
        pair = F.pmod(F.pmod(F.xxhash64(r, *key), F.col(size)) - x, F.col(size))
        bit = F.xxhash64(-r, *key, F.greatest(x, pair)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, pair).otherwise(x)

    return F.aggregate(F.sequence(F.lit(seed), F.lit(seed + rounds - 1)), F.col(index), swap)


def mix(
    docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, cap: int = CAP, **kw
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` (``doc_id, text, source``): placed pieces, and the documents.

    Placed pieces are ``(shard, slot, ix, pass, block, at, start, length)``: words ``start``
    to ``start + length`` of the document that begins at word ``at`` of source ``ix``, taken
    by a slot of a shard. Documents are ``(doc_id, source, row_key, ix, at, size,
    source_size, target)``, one row each; ``(ix, at)`` is the key where ``size > 0``.

    The same rows give the same mix. Null and empty texts have size 0 and are taken by
    no slot; repeated rows are documents of their own; a null source is one source, the
    last; other columns are ignored; no documents give no pieces.
    """
    sizes = cut(sized(docs))
    spark = docs.sparkSession
    goal = targets(sizes, cap=cap, **kw)
    n = F.ceil(F.col("source_size") / block)
    quota = F.least(n * cap, F.round(F.col("target") * n / F.col("source_size")).cast("long"))
    plan = goal.select(
        "ix", "source", "source_size", "target", n.cast("long").alias("n_blocks"),
        F.coalesce(quota, F.lit(0)).cast("long").alias("quota"),
    )
    upto = Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    plan = cut(plan.withColumn("lo", F.coalesce(F.sum("quota").over(upto), F.lit(0)).cast("long")))
    known = plan.select("ix", F.col("source").alias("_source"), "source_size", "target")
    of = sizes.join(known, sizes["source"].eqNullSafe(known["_source"])).drop("_source")
    some = running(of.where("size > 0"), "ix", ["doc_id", "row_key"], "size", "at", spread=100_000)
    none = of.where("size = 0").withColumn("at", F.lit(None).cast("long"))
    placed_docs = cut(some.unionByName(none))

    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    pieces = (
        placed_docs.where("size > 0")
        .select("ix", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
        .withColumn("start", F.greatest(F.lit(0), F.col("block") * block - F.col("at")))
        .withColumn("length", F.least(F.col("size"), (F.col("block") + 1) * block - F.col("at")) - F.col("start"))
        .withColumns({"start": F.col("start").cast("int"), "length": F.col("length").cast("int")})
        .drop("size")
    )
    total = plan.agg(F.sum("quota")).first()[0] or 0
    slots = _slots(spark, plan, total, shard_slots, seed)
    return slots.join(pieces, ["ix", "block"]).select(
        "shard", "slot", "ix", "pass", "block", "at", "start", "length"
    ), placed_docs


def _slots(spark, plan: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """``(shard, slot, ix, pass, block)`` of all slots."""
    width = max(1, -(-total // CELLS))
    owns = plan.where("quota > 0").withColumn("hi", F.col("lo") + F.col("quota"))
    # A cell of draws knows the few sources it touches: an equi-join in place of a range join.
    cells = owns.select(
        "ix", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"),
    )
    draws = (
        spark.range(total).withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))))
        .withColumn("cell", F.floor(F.col("draw") / width))
        .join(cells, "cell").where("draw >= lo and draw < hi")
    )
    counts = cut(
        draws.groupBy(F.floor(F.col("id") / shard_slots).alias("shard"), "ix").agg(F.count("*").alias("drawn"))
    )
    numbered = running(counts, "ix", ["shard"], "drawn", "first")
    # Few rows become many here: tasks follow the slots made, not the rows read.
    numbered = numbered.repartition(max(1, min(MOST_TASKS, total // TASK_SLOTS)), "shard", "ix")
    drawn = numbered.select(
        "shard", "ix", F.explode(F.sequence("first", F.col("first") + F.col("drawn") - 1)).alias("j")
    )
    # Too many or too few draws of a source, numbered over all sources.
    upto = Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("ix").agg(F.sum("drawn").alias("all"))
    bal = plan.join(sums, "ix", "left").withColumn("more", F.coalesce("all", F.lit(0)) - F.col("quota"))
    bal = (
        bal.withColumn("over", F.greatest(F.col("more"), F.lit(0))).withColumn("under", F.greatest(-F.col("more"), F.lit(0)))
        .withColumn("over_lo", F.coalesce(F.sum("over").over(upto), F.lit(0)))
        .withColumn("under_lo", F.coalesce(F.sum("under").over(upto), F.lit(0)))
    )
    drawn = drawn.join(bal.select("ix", "quota", "n_blocks", "over_lo"), "ix")
    fits = drawn.where("j < quota").select("shard", "ix", "j", "n_blocks")
    again = drawn.where("j >= quota").select("shard", (F.col("over_lo") + F.col("j") - F.col("quota")).alias("e"))
    short = bal.where("under > 0").select(
        "ix", "n_blocks", F.coalesce("all", F.lit(0)).alias("all"), "under_lo",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)).alias("i"),
    )
    short = short.select("ix", "n_blocks", (F.col("all") + F.col("i")).alias("j"), (F.col("under_lo") + F.col("i")).alias("e"))
    slots = fits.unionByName(again.join(short, "e").select("shard", "ix", "j", "n_blocks"))
    slots = slots.withColumn("pass", F.floor(F.col("j") / F.col("n_blocks"))).withColumn("block", F.col("j") % F.col("n_blocks"))
    slots = slots.withColumn("block", permuted("block", "n_blocks", "ix", "pass", seed=seed))
    # The order within a shard is by hash as well.
    return slots.select("shard", F.xxhash64(F.lit(seed), "ix", "j").alias("slot"), "ix", "pass", "block")


def taken(placed: DataFrame, documents: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row for each document."""
    words = placed.groupBy("ix", "at").agg(F.sum("length").alias("taken"))
    return documents.join(words, ["ix", "at"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_texts(docs: DataFrame, cap: int = CAP, **kw) -> DataFrame:
    """``docs`` as the mix has them: every text holds the words taken, pass after pass.

    Documents of which no word is taken are left out: that is how a source above its
    target shrinks. The white space after a word stays with it; passes are parted by a
    line end. Rows are told apart by id, text and source; of equal rows each has its own pieces.
    ``n_chars`` is counted again where there is such a column.
    """
    placed, documents = mix(docs, cap=cap, **kw)
    spans = placed.groupBy("ix", "at").agg(F.array_sort(F.collect_list(F.struct("pass", "start", "length"))).alias("_spans"))
    keys = documents.select("ix", "at", F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"))
    rows = folded(docs, doc_id=F.col("doc_id"), text=F.col("text"), row=F.xxhash64("text", "source"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_key"))
    # Equal rows are numbered on both sides, so that each has pieces of its own.
    again = cut(keys.groupBy("_id", "_key").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = None
    if not again.isEmpty():
        known = again.withColumnsRenamed({"_id": "_again", "_key": "_again_key"})
        repeated = F.col("_id").eqNullSafe(F.col("_again")) & (F.col("_key") == F.col("_again_key"))
        of_key = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("at"))
        numbered = keys.join(known, repeated, "left_semi").withColumn("_copy", of_key)
        keys = keys.join(known, repeated, "left_anti")
        of_row = F.row_number().over(Window.partitionBy("doc_id", "row").orderBy(F.lit(0)))
        twins = rows.join(again, same, "left_semi").withColumn("copy", of_row)
        copies = twins.join(numbered.join(spans, ["ix", "at"]), same & (F.col("copy") == F.col("_copy"))).drop("copy", "_copy")
    met = rows.join(keys.join(spans, ["ix", "at"]), same)
    met = met if copies is None else met.unionByName(copies)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    met = met.withColumn("_words", words)

    def of(p: int) -> Column:
        spans = F.filter("_spans", lambda s: s["pass"] == p)
        parts = F.transform(spans, lambda s: F.array_join(F.slice("_words", s["start"] + 1, s["length"]), ""))
        return F.array_join(parts, "")

    passes = F.col("_spans.pass")
    text = F.concat_ws("\n", *[F.when(F.array_contains(passes, F.lit(p).cast("long")), of(p)) for p in range(cap)])
    met = met.withColumn("text", text)
    more = {}
    if "n_chars" in docs.columns:
        more["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return unfolded(met, docs, text=F.col("text"), **more)
