"""What the text operators share: words, tables, word caches, running sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` finds the same.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch, and words that a worker remembers; both bound its memory.
BATCH_ROWS, CACHE_WORDS = 1_000, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text only, whatever other columns there are; a null text is empty.

    Batches for Python hold ``BATCH_ROWS`` rows, so that long texts fit into a worker.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def folded(docs: DataFrame, **more: Column) -> DataFrame:
    """Rows with all their columns in ``_doc``, so that no name of theirs meets one of ours."""
    row = F.struct(*[docs[c].alias(c) for c in docs.columns])
    return docs.select(row.alias("_doc"), *[column.alias(name) for name, column in more.items()])


def unfolded(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """``folded`` rows with the columns of ``docs`` again; ``changed`` replaces those that there are."""
    return rows.select(*[changed.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordCache(dict):
    """Results by word, worked out once; emptied when full, so memory stays bounded."""

    def __init__(self, make: Callable, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        made = self[word] = self.make(word)
        return made


def held_out() -> Column:
    """Rows whose labels may not be learnt: a fixed fifth by the checksum of the id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, label)`` of the ids whose labels may be learnt; of several labels the larger."""
    return (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """``(doc_id, text, label)`` of the labelled training rows, or of ``rows`` of them by id hash.

    Equal texts count once, so that copies don't outvote the rest. Ids and equal texts with
    several labels take the larger; unlabelled, held-out and id-less rows are left out.
    """
    known = training_labels(labels, label)
    if rows is not None:
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = texts(docs).join(known, "doc_id")
    return found.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))


def running(rows: DataFrame, key: str, order: list[str], value: str, out: str, spread: int = 50_000) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the key that come before.

    The rows of a key are dealt by a hash of ``order`` into parts of about ``spread``
    rows; windows see one part each, and the totals of the parts, one row each, are
    summed up. So no task holds a hot key. The order within a key is part, then ``order``.
    """
    parts = rows.groupBy(key).agg(F.ceil(F.count("*") / spread).alias("_parts"))
    dealt = rows.join(parts, key).withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts")))
    totals = dealt.groupBy(key, "_part").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(key, "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(bases, [key, "_part"])
        .withColumn(out, (F.col("_in") + F.col("_base")).cast("long"))
        .drop("_parts", "_part", "_in", "_base")
    )
