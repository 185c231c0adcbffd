"""Tables written by micro-batch: each batch is one generation.

A generation folder is named after its batch id and replaced when the batch is run
again, and readers only see generations that a marker, written last, has closed. So
a retried batch writes the same rows once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_part(df: DataFrame, path: str, name: str, batch_id: int, *by: str) -> None:
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(f"{path}/{name}/gen={batch_id}")


def read_part(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame | None:
    """All closed generations of a table, or those before a batch; NULL when none.

    Only a folder that isn't there yet counts as none; any other error is raised.
    """
    try:
        closed = spark.read.parquet(f"{path}/closed").select("gen")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    try:
        rows = spark.read.parquet(f"{path}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if before is not None:
        rows = rows.where(F.col("gen") < before)
        closed = closed.where(F.col("gen") < before)
    return rows.join(closed, "gen", "left_semi")


def close(spark: SparkSession, path: str, batch_id: int) -> None:
    """The commit of a batch: one marker row."""
    write_part(spark.range(1).select(F.lit(batch_id).alias("batch")), path, "closed", batch_id)
