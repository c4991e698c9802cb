"""What the corpus operators share: words, written tables, column names."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfolio.session import scratch_path

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and lost executors cannot undo it.

    The folder is the cluster's (``spark.checkpoint.dir``) and so is its clean-up. ``options``
    are the Parquet writer's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row(df: DataFrame, row: str, name: str, stored: bool = False) -> DataFrame:
    """``df`` with a column ``row`` that names a row alike whenever it is read again.

    ``stored`` says that ``df`` is Parquet files as they are read: file and position name the row,
    and nothing is copied. Without it, or where those are not to be had, the rows are written once.
    """
    if stored and "_metadata" not in {c.lower() for c in df.columns}:
        path = F.col("_metadata.file_path")
        try:
            return df.select("*", F.struct(F.xxhash64(path).alias("file"), F.hash(path).alias("file_too"),
                                           F.col("_metadata.row_index").alias("at")).alias(row))
        except AnalysisException:
            pass
    return written(df.withColumn(row, F.monotonically_increasing_id()), name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use, whatever the case of its letters."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words of a text in order; a null or blank text has none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def merged_spans(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends
