"""Latency and cost of model calls by day, kept as counts that merge.

A value is counted in a bucket whose bounds grow by a fixed ratio, so a quantile read from the
counts is off by ``ERROR`` of itself at most, however many states were merged. Counts add up
exactly: the state of many days gives the same answer as one pass over all calls.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyfolio.functions.money import score_round

ERROR = 0.01
RATIO = (1 + ERROR) / (1 - ERROR)
# The bucket of values that are zero or less.
NOTHING = -(2 ** 31)
# Quantiles in thousandths.
QUANTILES = (500, 950, 990)


def bucket_of(value: Column) -> Column:
    """The bucket of a value; zero and less share one, null and what is not finite has none."""
    finite = F.abs(value) < math.inf
    return F.when(finite & (value <= 0), NOTHING).when(finite, F.ceil(F.ln(value) / math.log(RATIO)).cast("int"))


def value_of(bucket: Column) -> Column:
    """The value whose relative distance to both bounds of a bucket is the same."""
    return F.when(bucket == NOTHING, 0.0).otherwise(F.pow(F.lit(RATIO), bucket) * (2 / (RATIO + 1)))


def summarise(calls: DataFrame, groups: Sequence[str], measures: Sequence[str], failed: Column) -> DataFrame:
    """Counts per group, measure and bucket: ``groups``, measure, bucket, n, n_failed, total.

    One partial aggregation; a group with very many calls is reduced before the shuffle. A call
    without a value of a measure is not counted there. Totals are exact decimals, the same in any
    order. Other columns of ``calls``, whatever their names, are not looked at.
    """
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    rows = calls.select(*groups, failed.alias("_failed"), F.explode(each).alias("_m"))
    rows = rows.withColumn("_bucket", bucket_of(F.col("_m.value"))).filter("_bucket IS NOT NULL")
    return rows.groupBy(*groups, F.col("_m.measure").alias("measure"), F.col("_bucket").alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("_failed", F.lit(False))).alias("n_failed"),
        F.sum(F.col("_m.value").cast("decimal(28,10)")).alias("total"))


class UsageState:
    """Summaries of whole days, a folder each; a day that comes again replaces its own and no other.

    ``groups`` names the day first; calls without a day, or with an empty one, share a folder as day
    null. A batch is read once, when it is added; reports read summaries only.
    """

    def __init__(self, spark: SparkSession, path: str, groups: Sequence[str], measures: Sequence[str]):
        self.spark, self.path, self.groups, self.measures = spark, path, list(groups), list(measures)

    def add(self, calls: DataFrame, failed: Column) -> None:
        """All calls of the days in ``calls``; a batch without calls changes nothing."""
        found = summarise(calls, self.groups, self.measures, failed)
        # By day, and a large day in as many parts as its size asks for.
        (found.hint("rebalance", self.groups[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(self.groups[0]).parquet(self.path))

    def read(self) -> DataFrame:
        """The summaries of all days; a filter on the day opens only its folders."""
        kinds = ", ".join(f"`{g}` string" for g in [*self.groups[1:], "measure"])
        return self.spark.read.schema(
            f"{kinds}, bucket int, n bigint, n_failed bigint, total decimal(38,10), `{self.groups[0]}` string").parquet(self.path)


def usage_report(state: DataFrame, groups: Sequence[str], quantiles: Sequence[int] = QUANTILES) -> DataFrame:
    """Rolled up over ``groups`` from the right: level, groups, measure, n, n_failed, total, p<thousandths>.

    ``level`` is how many groups a row still names; a group that is null is told from one summed over
    by it. A quantile is that of the call with rank ``ceil(n * q)``. What one task gathers of a group is
    its buckets, which the range of values bounds, not its calls.
    """
    sets = [[*groups[:i], "measure", "bucket"] for i in range(len(groups) + 1)]
    level = sum((1 - F.grouping(g).cast("int") for g in groups), F.lit(0))
    merged = state.groupingSets(sets, *groups, "measure", "bucket").agg(
        level.alias("level"), F.sum("n").alias("n"), F.sum("n_failed").alias("n_failed"), F.sum("total").alias("total"))
    whole = ["level", *groups, "measure"]
    every = Window.partitionBy(*whole)
    upto = F.sum("n").over(every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumn("_upto", upto).withColumn("_n", F.sum("n").over(every))

    def quantile(q: int) -> Column:
        at = F.min(F.when(F.col("_upto") * 1000 >= F.col("_n") * q, F.col("bucket")))
        return score_round(value_of(at), 6).alias(f"p{q}")

    return ranked.groupBy(*whole).agg(
        F.sum("n").alias("n"), F.sum("n_failed").alias("n_failed"), F.sum("total").cast("double").alias("total"),
        *[quantile(q) for q in quantiles])
