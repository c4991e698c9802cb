"""The labelled set: gold files, their pages, and completeness of the match."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfolio.functions.text import file_stem, page_number
from tallyfolio.schemas import GOLD_FILE, INVOICE


def _typed(df: DataFrame) -> DataFrame:
    inv = F.col("invoice")
    record = F.struct(*[
        (F.coalesce(inv[n], F.array().cast(INVOICE["line_items"].dataType)) if n == "line_items"
         else inv[n]).alias(n) for n in INVOICE.names])
    return df.select("doc", page_number(F.col("source")).alias("page"), "doc_type",
                     F.coalesce("notes", F.lit("")).alias("notes"), record.alias("invoice"))


def read_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.json`` file of a folder, one record per file, named after the file."""
    raw = (spark.read.schema(GOLD_FILE).option("multiLine", True).option("pathGlobFilter", "*.json")
           .option("mode", "FAILFAST").json(folder))
    return _typed(raw.withColumn("doc", file_stem(F.col("_metadata.file_name"))))


def parse_gold(files: DataFrame) -> DataFrame:
    """The same from a table ``(path, value)`` holding the files' texts."""
    parsed = files.select(file_stem(F.col("path")).alias("doc"),
                          F.from_json("value", GOLD_FILE, {"mode": "FAILFAST"}).alias("f"))
    return _typed(parsed.select("doc", "f.*"))


def attach_pages(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """Gold records with their page; ``pages(page, ...)`` has one row per page."""
    return gold.join(pages, "page")


def missing_pages(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """Gold records whose page is not there; anything here is an error of the set."""
    return gold.join(pages.select("page"), "page", "left_anti")


def check_pages(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """``attach_pages`` that refuses an incomplete set."""
    absent = missing_pages(gold, pages).count()
    if absent:
        raise ValueError(f"{absent} gold records without their page; missing_pages lists them")
    return attach_pages(gold, pages)
