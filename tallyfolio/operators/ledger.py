"""Normalise and reconcile over records kept as two flat tables: headers and lines.

The nested form holds a record on one row. Where lines arrive as rows of their own, nothing
is nested here: sums are partial aggregates, so a record with a third of all lines still
reduces to one row per task before it is shuffled.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyfolio.functions.records import derived_tax, is_tax_line, mismatch_warning

# Line amounts are added as decimals: exact, and independent of the order of arrival.
_AMOUNT = "decimal(18,2)"


def line_totals(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per record: number of lines, sum of amounts, sum of tax amounts; null sums where none."""
    amount = F.col("amount").cast(_AMOUNT)
    return lines.groupBy(key).agg(
        F.count("*").alias("n_lines"),
        F.sum(amount).cast("double").alias("line_sum"),
        F.sum(F.when(is_tax_line(F.col("description")), amount)).cast("double").alias("itemised_tax"))


def reconcile_ledger(headers: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Headers with the derived tax and the warning, for records with and without lines."""
    df = headers.join(line_totals(lines, key), key, "left")
    return (df.withColumn("tax", derived_tax(F.col("tax"), F.col("itemised_tax")))
            .withColumn("warning", mismatch_warning(F.col("total"), F.col("line_sum")))
            .withColumn("n_lines", F.coalesce("n_lines", F.lit(0).cast("bigint"))))
