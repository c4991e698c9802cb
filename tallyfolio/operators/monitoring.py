"""Change and certainty: alarms on rates, calibrated thresholds, gates that know their error.

Everything starts from a reduction that merges: counts per group and period, sums per confidence
point, weighted sums per replicate. What follows works on those small tables.
"""
from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyfolio.functions.money import score_round

# Chances that a Poisson(1) count is below 1, 2, ... 8, in parts of 2 ** 32.
POISSON = tuple(int(2 ** 32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k))) for k in range(1, 9))
REPLICATES = 100


# ------------------------------------------------------------------ alarms

def alarms(counts: DataFrame, group: str, period: str, n: str, hits: str, slack: float, limit: float) -> DataFrame:
    """Per group and period the cumulative sum of a rate's excess, and whether it sounds.

    The excess is the number of hits above ``(base rate + slack) * n``, the base rate being that of all
    other groups in all periods. The sum starts anew whenever it falls below zero; an alarm is
    a sum above ``limit`` hits. ``counts`` has one row per group and period; sums are kept in
    whole millionths, so they are the same in any order.
    """
    whole = counts.agg(F.sum(n).alias("_n"), F.sum(hits).alias("_hits"))
    own = counts.groupBy(group).agg(F.sum(n).alias("_own_n"), F.sum(hits).alias("_own_hits"))
    # One row, joined by a constant key.
    base = own.withColumn("_one", F.lit(1)).join(whole.withColumn("_one", F.lit(1)), "_one").select(
        group, F.coalesce(F.floor((F.col("_hits") - F.col("_own_hits")) * 1_000_000 / F.nullif(F.col("_n") - F.col("_own_n"), F.lit(0))),
                          F.lit(0)).cast("bigint").alias("_base"))
    excess = F.col(hits) * 1_000_000 - F.col(n) * (F.col("_base") + int(slack * 1_000_000))
    line = Window.partitionBy(group).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.join(base, group).withColumn("_total", F.sum(excess).over(line))
    # A sum that is never below zero is the total less its least value so far.
    score = F.col("_total") - F.least(F.lit(0), F.min("_total").over(line))
    return sums.withColumn("score", (score / 1_000_000).cast("double")).withColumn("alarm", F.col("score") > limit).drop("_base", "_total")


def stability(rows: DataFrame, group: str, bucket: Column, current: Column) -> DataFrame:
    """Population stability index per group: how far the current buckets are from the baseline's.

    Every count is raised by one half, so an empty bucket does not make it infinite.
    """
    counts = rows.groupBy(F.col(group), bucket.alias("_b")).agg(
        F.count_if(~current).alias("_old"), F.count_if(current).alias("_new"))
    every = Window.partitionBy(group)
    k = F.count("*").over(every)
    shares = counts.select(group, ((F.col("_old") + 0.5) / (F.sum("_old").over(every) + 0.5 * k)).alias("_p"),
                           ((F.col("_new") + 0.5) / (F.sum("_new").over(every) + 0.5 * k)).alias("_q"))
    part = (F.col("_q") - F.col("_p")) * F.log(F.col("_q") / F.col("_p"))
    return shares.groupBy(group).agg(score_round(F.sum(part), 6).alias("psi"), F.count("*").alias("n_buckets"))


# ------------------------------------------------------------------ calibration

def calibrated(points: DataFrame, x: str, n: str, total: str) -> DataFrame:
    """``points`` (x, n, total) with ``fitted``: the mean as a rising function of x.

    Isotonic regression by its closed form, the greatest over all starts of the least mean over all
    ends. ``points`` is reduced to whole points of confidence first, 101 rows at most.
    """
    up = Window.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    sums = points.select(x, n, total, F.sum(n).over(up).alias("_n"), F.sum(total).over(up).alias("_t"), F.lit(1).alias("_one"))
    start = sums.select(F.col(x).alias("_a"), (F.col("_n") - F.col(n)).alias("_n0"), (F.col("_t") - F.col(total)).alias("_t0"), "_one")
    end = sums.select(F.col(x).alias("_b"), F.col("_n").alias("_n1"), F.col("_t").alias("_t1"), "_one")
    blocks = start.join(end, "_one").filter("_a <= _b").withColumn(
        "_mean", (F.col("_t1") - F.col("_t0")).cast("double") / (F.col("_n1") - F.col("_n0")))
    onward = Window.partitionBy("_a").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    least = blocks.select("_a", F.col("_b").alias("_i"), F.min("_mean").over(onward).alias("_least"))
    fitted = least.groupBy("_i").agg(F.max("_least").alias("fitted"))
    return points.join(fitted, points[x] == fitted["_i"]).drop("_i")


def calibration_points(documents: DataFrame, confidence: str, score: str) -> DataFrame:
    """(conf, n, points): documents and their score per whole point of confidence; parts merge by adding."""
    return documents.groupBy(F.floor(confidence).cast("bigint").alias("conf")).agg(
        F.count("*").alias("n"), F.sum(F.col(score).cast("decimal(20,4)")).alias("points"))


# ------------------------------------------------------------------ gates

def weight(doc: Column, replicate: Column) -> Column:
    """How often a replicate draws a document: Poisson(1), decided by a hash of both."""
    # Eight hex digits sort like the number they write.
    u = F.substring(F.md5(F.concat_ws("|", doc.cast("string"), replicate.cast("string"))), 1, 8)
    count = F.lit(0)
    for bound in POISSON:
        count = count + F.when(u >= f"{bound:08x}", 1).otherwise(0)
    return count


def replicated(runs: DataFrame, config: str, doc: str, values: Mapping[str, Column], replicates: int = REPLICATES) -> DataFrame:
    """(config, replicate, each value's mean): Poisson bootstrap in one aggregate.

    Every row counts towards each replicate with its own weight, worked out once: a filter on it
    would work it out anew for each of its bounds. Tasks add up their part of a replicate before
    anything is shuffled. Values have at most four decimals and are added exactly, as whole
    ten-thousandths.
    """
    units = runs.select(config, F.col(doc).alias("_doc"), *[
        (v.cast("decimal(20,4)") * 10000).cast("bigint").alias(c) for c, v in values.items()])
    each = units.select(config, "_doc", *values, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    each = each.withColumn("_w", weight(F.col("_doc"), F.col("replicate")).cast("bigint"))
    sums = each.groupBy(config, "replicate").agg(F.sum("_w").alias("_n"), *[F.sum(F.col(c) * F.col("_w")).alias(c) for c in values])
    return sums.filter("_n > 0").select(config, "replicate", *[(F.col(c).cast("double") / 10000 / F.col("_n")).alias(c) for c in values])


def sure_gate(replicates: DataFrame, config: str, bars: Mapping[str, float], miss: float = 0.05) -> DataFrame:
    """(config, the lower end of each figure's interval, passes): a bar is cleared by the lower end."""
    rank = F.floor(F.count("*") * miss).cast("int")
    lows = replicates.groupBy(config).agg(*[score_round(F.element_at(F.sort_array(F.collect_list(c)), rank + 1), 6).alias(f"{c}_low") for c in bars])
    clears = F.lit(True)
    for c, bar in bars.items():
        clears = clears & (F.col(f"{c}_low") >= bar)
    return lows.withColumn("passes", clears)
