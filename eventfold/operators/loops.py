"""Iterative jobs: lineage cuts, connected components, dependency layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventfold.session import fresh_path

#: Shuffle files of a job go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    Unlike a checkpoint the table has a known size, so loops keep good join plans. Nothing
    reads the shuffles of the writing again, so their files don't wait on the disk.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "cut")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what ``cut`` wrote to ``path``, once all that is made of it is written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def counting(df: DataFrame, where: Column | None = None) -> tuple[DataFrame, Callable[[DataFrame], int]]:
    """``df`` to be written, and what tells how many of the rows are ``where`` when it was: they are
    counted in the writing, without a job of its own."""
    seen = Observation()
    ones = F.count(F.lit(1) if where is None else F.when(where, F.lit(1))).alias("n")

    def size(written: DataFrame) -> int:
        n = seen.get.get("n")  # a plan found to be empty may have lost the count
        return n if n is not None else written.select(ones).first()[0]

    return df.observe(seen, ones), size


def counted(df: DataFrame, where: Column | None = None) -> tuple[DataFrame, int]:
    """``cut``, and how many of the written rows are ``where``."""
    seen, size = counting(df, where)
    out = cut(seen)
    return out, size(out)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)`` pairs: ``(id, cluster)``, the least id.

    Each round joins every node to one neighbour, the first by hash, and goes on with the
    groups as nodes: at most half as many, whatever the graph looks like. So rounds are few,
    and all later ones together move less than the first.
    """
    edges = edges.where("a <> b")
    links = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    rounds = []
    while not links.isEmpty():
        rounds.append(_hooked(links))
        names = rounds[-1]
        left = links.join(names.withColumnsRenamed({"id": "a", "root": "x"}), "a")
        both = left.join(names.withColumnsRenamed({"id": "b", "root": "y"}), "b").where("x <> y")
        links = cut(both.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("b").alias("cluster"))
    # From the last groups back to the nodes.
    whole = rounds.pop()
    while rounds:
        whole = cut(rounds.pop().join(whole.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select(
            "id", F.coalesce("top", "root").alias("root")
        ))
    least = whole.groupBy("root").agg(F.min("id").alias("cluster"))
    return cut(whole.join(least, "root").select("id", "cluster"))


def _hooked(links: DataFrame) -> DataFrame:
    """``(id, root)``: each node and the root of the tree it hangs in, when every node hangs on
    its first neighbour by hash. Two nodes may hang on each other, more can't in a circle."""
    first = F.min(F.struct(F.xxhash64("b").alias("h"), "b"))["b"]
    on = cut(links.groupBy(F.col("a").alias("id")).agg(first.alias("root")))
    further = lambda df: df.join(df.select(F.col("id").alias("root"), F.col("root").alias("next")), "root")
    ends = (F.col("next") == F.col("id")) & (F.col("id") < F.col("root"))
    trees = cut(further(on).select("id", F.when(ends, F.col("id")).otherwise(F.col("root")).alias("root")))
    while True:
        step = cut(further(trees).select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        trees = step.select("id", "root")
        if step.where("moved").isEmpty():
            return trees


def layers(edges: DataFrame) -> DataFrame:
    """Dependency layers of ``(node, needs)``: ``(node, layer)``.

    Layer 1 needs nothing; others are one above the highest layer they need. Nodes
    on or behind a cycle have no layer (NULL). One round per layer.
    """
    left = cut(edges.select("node", "needs").distinct())
    nodes = cut(left.select("node").union(left.select("needs")).distinct())
    done, layer = None, 1
    while True:
        ready = nodes.join(left.select("node").distinct(), "node", "left_anti")
        ready = cut(ready.select("node", F.lit(layer).cast("bigint").alias("layer")))
        if ready.isEmpty():
            rest = nodes.select("node", F.lit(None).cast("bigint").alias("layer"))
            return rest if done is None else done.unionByName(rest)
        done = ready if done is None else cut(done.unionByName(ready))
        nodes = cut(nodes.join(ready, "node", "left_anti"))
        left = cut(left.join(ready.select(F.col("node").alias("needs")), "needs", "left_anti"))
        layer += 1
