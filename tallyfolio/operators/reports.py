"""Reports over finished jobs: spend, quality, cost, drift, thresholds, release gate."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfolio.functions.money import score_round, token_cost
from tallyfolio.functions.text import norm_currency, norm_date

# Typical tokens per document, dollars per million tokens of the two tiers, share
# of documents the cheap tier settles, and the price range of handling one by hand.
TOKENS_IN, TOKENS_OUT = 2000, 600
TIER1_PRICE, TIER2_PRICE = (0.50, 3.00), (5.00, 25.00)
EASY_SHARE = 0.9
MANUAL_PRICE = (15.0, 25.0)


def spend(invoices: DataFrame) -> DataFrame:
    """Total per client, year and currency over ``invoice`` records."""
    inv = F.col("invoice")
    return (invoices.select(
        inv["bill_to"].alias("client"), F.substring(norm_date(inv["invoice_date"]), 1, 4).alias("year"),
        norm_currency(inv["currency"]).alias("currency"), inv["total"].cast("decimal(18,2)").alias("total"))
        .groupBy("client", "year", "currency")
        .agg(F.count("*").alias("n_invoices"), F.sum("total").cast("double").alias("spend")))


def quality(settled: DataFrame, attempts: DataFrame) -> DataFrame:
    """Schema-valid rate, escalation, flag and failure rates, call latency and calls per job."""
    jobs = settled.agg(
        F.count("*").alias("n_jobs"), F.count_if(F.col("status") == "SUCCEEDED").alias("n_succeeded"),
        F.count_if(F.col("status") == "FAILED").alias("n_failed"),
        F.count_if(F.size("warnings") > 0).alias("n_flagged"),
        F.count_if(F.col("first_warning").isNotNull()).alias("n_doubtful"),
        F.count_if(F.col("escalated")).alias("n_escalated"),
        F.count("first_fits").alias("n_answered"), F.count_if(F.col("first_fits")).alias("n_fitting"))
    calls = attempts.agg(
        F.count("*").alias("n_calls"), F.count_if(F.col("error_class").isNotNull()).alias("n_call_errors"),
        F.count_if(F.col("tier") == "tier-2").alias("n_tier2_calls"),
        F.sum(F.when(F.col("tier") == "tier-2", token_cost(F.col("tokens_in"), F.col("tokens_out"), *map(F.lit, TIER2_PRICE)))
              .otherwise(token_cost(F.col("tokens_in"), F.col("tokens_out"), *map(F.lit, TIER1_PRICE)))
              .cast("decimal(28,10)")).cast("double").alias("cost"),
        F.percentile_approx("latency_s", 0.5, 10000).alias("latency_p50"),
        F.percentile_approx("latency_s", 0.95, 10000).alias("latency_p95"))
    both = jobs.withColumn("_one", F.lit(1)).join(calls.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return (both.withColumn("failure_rate", score_round(F.col("n_failed") / F.col("n_jobs"), 4))
            .withColumn("flag_rate", score_round(F.col("n_flagged") / F.col("n_jobs"), 4))
            .withColumn("escalation_rate", score_round(F.col("n_escalated") / F.col("n_jobs"), 4))
            .withColumn("schema_valid_rate", score_round(F.col("n_fitting") / F.col("n_answered"), 4))
            .withColumn("cost_per_doc", score_round(F.col("cost") / F.col("n_jobs"), 6)).drop("cost", "n_answered", "n_fitting")
            .withColumn("calls_per_job", score_round(F.col("n_calls") / F.col("n_jobs"), 4)))


def path_costs(spark: SparkSession, volumes: DataFrame) -> DataFrame:
    """Monthly dollars for ``volumes(month, n_docs)`` by the blend, the premium tier and by hand."""
    def per_doc(price: tuple[float, float]) -> Column:
        return token_cost(F.lit(TOKENS_IN), F.lit(TOKENS_OUT), F.lit(price[0]), F.lit(price[1]))

    cheap, premium = per_doc(TIER1_PRICE), per_doc(TIER2_PRICE)
    blend = EASY_SHARE * cheap + (1 - EASY_SHARE) * (cheap + premium)
    n = F.col("n_docs")
    return volumes.select(
        "month", "n_docs", score_round(n * cheap, 4).alias("tier1_only"),
        score_round(n * blend, 4).alias("blended"), score_round(n * premium, 4).alias("premium_everywhere"),
        (n * MANUAL_PRICE[0]).alias("manual_low"), (n * MANUAL_PRICE[1]).alias("manual_high"))


def drift(jobs: DataFrame, ts: str, group: str, period: str = "1 day") -> DataFrame:
    """Flag and failure rates over time per group."""
    flagged = F.size("warnings") > 0
    return (jobs.groupBy(F.window(ts, period)["start"].alias("period"), group)
            .agg(F.count("*").alias("n_jobs"), F.count_if(flagged).alias("n_flagged"),
                 F.count_if(F.col("status") == "FAILED").alias("n_failed"))
            .withColumn("flag_rate", score_round(F.col("n_flagged") / F.col("n_jobs"), 4)))


def grow_gold(gold: DataFrame, corrected: DataFrame, key: str = "doc") -> DataFrame:
    """Gold set with the corrected cases that it does not hold yet."""
    return gold.unionByName(corrected.join(gold.select(key), key, "left_anti"))


def tune_threshold(documents: DataFrame, thresholds: range) -> DataFrame:
    """Accuracy and share of vision calls at each whole confidence threshold.

    ``documents(mean_conf, ocr_score, vlm_score)`` is first reduced to one row per whole
    confidence point (101 at most); only that small table meets the thresholds.
    """
    points = documents.groupBy(F.floor("mean_conf").alias("conf")).agg(
        F.count("*").alias("n"), F.sum(F.col("ocr_score").cast("decimal(20,4)")).alias("ocr"),
        F.sum(F.col("vlm_score").cast("decimal(20,4)")).alias("vlm"))
    grid = points.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    to_ocr = F.col("conf") >= F.col("threshold")
    return (grid.groupBy("threshold").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(to_ocr, F.col("ocr")).otherwise(F.col("vlm"))).cast("double").alias("points"),
        F.sum(F.when(to_ocr, 0).otherwise(F.col("n"))).alias("vlm_calls"))
        .withColumn("acc", score_round(F.col("points") / F.col("n_docs"), 6)).drop("points"))


def release_gate(results: DataFrame, bars: Mapping[str, float]) -> DataFrame:
    """Whether every figure of a configuration clears its bar."""
    clears = F.lit(True)
    for name, bar in bars.items():
        clears = clears & (F.col(name) >= bar)
    return results.withColumn("passes", F.coalesce(clears, F.lit(False)))
