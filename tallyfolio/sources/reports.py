"""Report sinks: results as JSON, the ranking and the details as markdown text."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyfolio.operators.benchmark import detail_rows, report_rows

HEAD = ("# Readers compared", "", "| place | reader and model | overall | items F1 | seconds | dollars per document |",
        "|--:|--|--:|--:|--:|--:|")


def ranking_text(ranked: DataFrame) -> DataFrame:
    """The ranking as ordered lines: headings, one line per configuration, the best one named last."""
    spark = ranked.sparkSession
    head = spark.createDataFrame([(i - len(HEAD), line) for i, line in enumerate(HEAD)], "pos int, line string")
    best = ranked.filter(F.col("rank") == 1).select("config", "overall", "n_docs")
    # One row on either side, joined by a constant key.
    size = ranked.agg(F.max("rank").alias("last"), F.lit(1).alias("key"))
    tail = best.withColumn("key", F.lit(1)).join(size, "key").select((F.col("last") + 1).alias("pos"), F.format_string(
        "Best so far: `%s` with %.3f over %d labelled documents.", "config", "overall", "n_docs").alias("line"))
    return head.unionByName(report_rows(ranked)).unionByName(tail).orderBy("pos")


def detail_text(detail: DataFrame, ranked: DataFrame) -> DataFrame:
    """Details in the order of rank and document, a line per document whatever their number."""
    return detail_rows(detail, ranked).orderBy("rank", "doc")


def write_report(ranked: DataFrame, detail: DataFrame, folder: str) -> None:
    """``results`` as JSON in rank order, ``ranking`` and ``detail`` as markdown lines."""
    ranked.orderBy("rank").coalesce(1).write.mode("overwrite").json(f"{folder}/results")
    ranking_text(ranked).select("line").coalesce(1).write.mode("overwrite").text(f"{folder}/ranking")
    # A folder of part files; read in the order of their names they are the report's details.
    detail_text(detail, ranked).select("line").write.mode("overwrite").text(f"{folder}/detail")
