"""A training corpus from raw documents: five stages, each on what the one before kept.

1. toxicity: documents scored 0.5 or more go.
2. near_duplicates: one document of each SimHash component stays, as in op1; of these, one of
   each class of texts whose five-word shingles have a Jaccard likeness of 0.8 or more.
3. secrets: found secrets are masked in the texts; no document goes.
4. mixing: sources are brought to their target weights; texts hold the words taken.
5. packing: pieces of at most 2048 tokens and their places in full sequences.

Every stage takes ``(spark, docs, sf_dir)``; its result is written to the shared folder and
read again as the next one's ``docs``. All but the last keep the columns of ``documents``,
whatever they are. Null texts count as empty; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventfold.llm import alike, mixing, packing, secrets, simhash, toxicity
from eventfold.llm.common import table
from eventfold.operators.loops import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return alike.keep_one(simhash.keep_one(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage is a learnt model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
