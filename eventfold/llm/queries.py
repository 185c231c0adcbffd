"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm import (
    divergence, infill, lines, mixing, packing, passages, quality, secrets, simhash, spotsigs, topk, toxicity, wordpiece,
)
from eventfold.llm.common import held_out, table
from eventfold.llm.sql import DIVERGENCE_SQL, INFILL_SQL, LINES_SQL, TOPK_SQL
from eventfold.session import prepare


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judged(table(prepare(spark), sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(table(prepare(spark), sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compared(table(prepare(spark), sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    scored = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op7_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(prepare(spark), sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(prepare(spark), sf_dir, "documents"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(prepare(spark), sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(prepare(spark), sf_dir, "documents"))
    kinds = F.col("base.kind")
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind, *_ in secrets.KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans")
    )


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(prepare(spark), sf_dir, "documents"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(prepare(spark), sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(prepare(spark), sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(prepare(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_line_rules, op3_mixing, op4_toxicity, op5_spotsigs, op6_quality, op7_wordpiece,
        op8_packing, op9_passages, op10_secrets, op11_divergence, op12_topk, op13_infill, pipeline,
    )
}
ORACLES = {
    "op2_line_rules": LINES_SQL, "op11_divergence": DIVERGENCE_SQL, "op12_topk": TOPK_SQL, "op13_infill": INFILL_SQL,
}
