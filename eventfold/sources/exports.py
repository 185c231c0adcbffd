"""Items as documents: export, change detection, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names that the document header owns.
HEADER_FIELDS = ("type", "state")


def documents(view: DataFrame, fields: list[str]) -> DataFrame:
    """One JSON document per item part: header, fields, labels if any.

    ``view`` has the header columns, one column per field and ``labels``. Assignees
    and execution events are not exported; NULL fields are left out. Parts after the
    first carry their number.
    """
    named = [f for f in fields if f not in HEADER_FIELDS]
    labels = F.when(F.size("labels") > 0, F.col("labels"))
    doc = F.struct(
        "entity_uuid",
        *[c for c in ("number", "identifier") if c in view.columns],
        F.col("item_type").alias("type"),
        F.col("state_key").alias("state"),
        *named,
        F.when(F.col("part") > 0, F.col("part")).alias("part"),
        labels.alias("labels"),
    )
    return view.select(
        "project_uuid", "entity_uuid", "part", F.to_json(doc).alias("doc")
    )


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents as JSON lines, one folder per project, hot projects spread."""
    (
        docs.repartition("project_uuid", F.pmod(F.xxhash64("entity_uuid"), F.lit(32)))
        .select("project_uuid", "doc")
        .write.mode("errorifexists")
        .partitionBy("project_uuid")
        .text(path)
    )


def registry(docs: DataFrame) -> DataFrame:
    """Content hash per document part."""
    return docs.select("project_uuid", "entity_uuid", "part", F.sha2("doc", 256).alias("hash"))


def changed(docs: DataFrame, last: DataFrame) -> DataFrame:
    """Documents that are new or differ from the last registry."""
    now = docs.withColumn("hash", F.sha2("doc", 256))
    old = last.select("entity_uuid", "part", F.col("hash").alias("old_hash"))
    return (
        now.join(old, ["entity_uuid", "part"], "left")
        .where(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("hash")))
        .withColumn("change", F.when(F.col("old_hash").isNull(), F.lit("new")).otherwise(F.lit("changed")))
        .drop("old_hash")
    )


def bundle(items: DataFrame, edges: DataFrame, comments: DataFrame, cascade: str = "none") -> DataFrame:
    """Rows of an export bundle: the items, their edges, their comments.

    ``edges`` are directed rows. With ``relations`` the items one hop away are added,
    with ``full`` their comments too. Rows, not one nested value: an item may have
    any number of edges.
    """
    ids = items.select("entity_uuid").distinct()
    touching = edges.join(ids, "entity_uuid", "left_semi")
    near = ids
    if cascade in ("relations", "full"):
        near = ids.union(touching.select(F.col("peer_uuid").alias("entity_uuid"))).distinct()
    talked = near if cascade == "full" else ids
    row = lambda df, part, key, owner: df.select(
        F.lit(part).alias("part"), F.col(owner).alias("entity_uuid"), F.col(key).alias("ref")
    )
    return (
        row(near, "item", "entity_uuid", "entity_uuid")
        .unionByName(row(touching, "relation", "relation_uuid", "entity_uuid"))
        .unionByName(
            row(comments.join(talked, "entity_uuid", "left_semi"), "comment", "comment_uuid", "entity_uuid")
        )
    )
