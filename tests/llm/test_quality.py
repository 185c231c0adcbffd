"""Learning the quality model: texts stay where they are read."""

from pyspark.sql import functions as F

from eventfold.llm import common, quality


def test_learning_moves_features_not_texts(spark, monkeypatch):
    rows = [(i, ("SHOUT! " if i % 3 else "quiet words, ") * (3 + i % 7)) for i in range(60)] + [(60, None), (None, "quiet")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(62)] + [(1, 1), (2, None)], "doc_id bigint, quality int")
    plain, plans, tables = quality.cut, [], []

    def noting(df):
        plans.append(df._jdf.queryExecution().toString())
        tables.append(plain(df))
        return tables[-1]

    monkeypatch.setattr(quality, "cut", noting)
    quality.learn(docs, labels)
    assert plans and not any("hashpartitioning(text#" in p for p in plans)
    # Equal texts count once, with the larger label and the least id.
    want = common.labelled_sample(docs, labels, "quality").select(
        F.col("doc_id").cast("string"), F.when(F.col("label") == 1, 1).otherwise(0), F.xxhash64("text"), "text"
    )
    got = tables[0].select("doc_id", "label", "text_hash", "x").collect()
    assert sorted((r.doc_id, r.label, r.text_hash, list(r.x)) for r in got) == sorted(
        (d, n, h, quality.features(t.encode())) for d, n, h, t in want.collect()
    )
