"""Blob metadata and blob links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.stamps import order_key
from eventfold.operators.registers import lww


def metadata(log: DataFrame) -> DataFrame:
    """Last registered metadata per blob."""
    rows = log.where(F.col("kind") == "blob.add")
    return lww(rows, ["blob_uuid"], ["sha256", "size_bytes", "mime_type", "file_name"])


def links(log: DataFrame) -> DataFrame:
    """Link state per ``(blob, entity, role)``: active iff the last change is a link."""
    return (
        log.where(F.col("kind").isin("blob.link", "blob.unlink"))
        .groupBy("blob_uuid", "entity_uuid", "role")
        .agg(F.max_by(F.struct(F.col("kind"), F.col("event_uuid")), order_key()).alias("last"))
        .select(
            "blob_uuid",
            "entity_uuid",
            "role",
            (F.col("last.kind") == "blob.link").alias("active"),
            F.col("last.event_uuid").alias("changed_by"),
        )
    )


def attachments(links_state: DataFrame, meta: DataFrame) -> DataFrame:
    """Active links with the metadata of their blob (NULL when unknown)."""
    wanted = meta.select("blob_uuid", "sha256", "size_bytes", "mime_type", "file_name")
    return links_state.where("active").drop("active").join(wanted, "blob_uuid", "left")
