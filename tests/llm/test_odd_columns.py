"""Documents whose other columns are named as helper columns are."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventfold.llm import common
from tests.llm.test_operators import prose

CLASHES = ["_id", "_key", "_fp", "_row", "_doc", "_spans", "_words", "row", "fp", "copy", "text2", "whole", "cluster", "spans"]


@pytest.mark.parametrize("stage", ["near_duplicates", "secrets", "mixing"])
def test_stages_keep_columns_with_any_name(make, spark, stage):
    secret = "password: Zx81kd9Qm2Lp77"
    docs = make(*[prose(60, i) + " " + secret for i in range(6)], prose(60, 0) + " " + secret, (None, "x"), (3, None))
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(n).alias(n) for n in CLASHES])
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    rows = out.collect()
    assert out.columns == docs.columns and rows
    assert all([r[n] for n in CLASHES] == CLASHES for r in rows)


def test_equal_texts_with_clashing_labels(make, spark):
    docs = make(*[(i, "same text") for i in range(40)], (50, "other"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(50, 0)], "doc_id long, toxic int")
    sample = {r.text: r.label for r in common.labelled_sample(docs, labels, "toxic", 1000).collect()}
    assert sample["same text"] == 1
