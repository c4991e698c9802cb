"""Raw documents: files with their bytes, and where they are retained."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfolio.operators.pages import DEFAULT_NAME


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files of a folder as ``path, filename, content``."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return df.select("path", F.substring_index("path", "/", -1).alias("filename"), "content")


def retained_path(root: str | Column, job_id: Column, filename: Column) -> Column:
    """Where a job's document is kept; known without writing it."""
    root = F.lit(root) if isinstance(root, str) else root
    name = F.coalesce(F.nullif(filename, F.lit("")), F.lit(DEFAULT_NAME))
    return F.concat_ws("/", root, job_id, name)


def retain(documents: DataFrame, folder: str, root: str, received_on: Column, batch_id: int | str) -> None:
    """Keep ``job_id, filename, content`` with their paths, by day of receipt and batch.

    A batch that runs again replaces its own folders; documents of other batches stay.
    """
    (documents.select(retained_path(root, F.col("job_id"), F.col("filename")).alias("path"), "job_id",
                      "filename", "content", received_on.alias("received_on"), F.lit(batch_id).alias("batch_id"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("received_on", "batch_id").parquet(folder))
