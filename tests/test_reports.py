"""Benchmark summaries, ranking, strategies, thresholds, report files."""
from pyspark.sql import functions as F

from tallyfolio.operators import benchmark as B, reports as R
from tallyfolio.sources.reports import detail_text, write_report


MODELS = [("small-vision", 0.2, 0.2, True, True), ("plain-text", 0.5, 0.5, False, True), ("far-vision", 9.0, 9.0, True, False)]


def runs(spark):
    rows = [("vlm:small-vision", t, d, o, f, lat, 1000, 100) for t, d, o, f, lat in (
        (1, "a", 0.9, 1.0, 5.0), (1, "b", None, None, 7.0), (2, "a", 0.8, 0.5, 6.0), (2, "b", 0.6, 0.333, 6.5))]
    rows += [("ocr:small-vision", 1, d, 0.5625, 0.5, 1.0, 2000, 200) for d in ("a", "b")]
    return spark.createDataFrame(rows, "config string, trial int, doc string, overall double, f1 double, latency_s double, "
                                       "tokens_in bigint, tokens_out bigint")


def ranked(spark):
    trials = B.summarize_trials(runs(spark), B.config_matrix(B.registry(spark, MODELS)))
    return trials, B.rank_configs(B.average_trials(trials))


def test_failed_documents_count_as_zero(spark):
    trials, _ = ranked(spark)
    got = {(r.config, r.trial): r for r in trials.collect()}
    one = got["vlm:small-vision", 1]
    assert (one.n_docs, one.overall, one.line_item_f1, one.avg_latency_s) == (2, 0.45, 0.5, 6.0)
    assert one.est_cost_per_doc == round((2000 * 0.2 + 200 * 0.2) / 1e6 / 2, 6)


def test_trials_are_averaged_and_ties_keep_registry_order(spark):
    _, r = ranked(spark)
    rows = r.orderBy("rank").collect()
    assert [(x.config, x.overall, x.trials) for x in rows] == [
        ("vlm:small-vision", 0.575, 2), ("ocr:small-vision", 0.5625, 1)]
    assert B.best_config(r).first().config == "vlm:small-vision"
    tied = r.withColumn("overall", F.lit(0.5))
    assert [x.config for x in B.rank_configs(tied).orderBy("rank").collect()] == ["vlm:small-vision", "ocr:small-vision"]


def test_config_matrix(spark):
    m = B.config_matrix(B.registry(spark, MODELS))
    why = {r.config: r.skip_reason for r in m.collect()}
    assert len(why) == 6 and why["vlm:plain-text"] == "the model cannot read images" and why["ocr:plain-text"] is None
    assert why["ocr:far-vision"] == "no access to the model"
    wanted = spark.createDataFrame([("ocr:plain-text",), ("vlm:plain-text",)], "config string")
    assert [r.config for r in B.runnable(m, wanted).collect()] == ["ocr:plain-text"]
    no_text = {r.config: r.why for r in m.select("config", B.run_skip_reason(F.lit(False)).alias("why")).collect()}
    assert no_text["ocr:small-vision"] == "the document has no text for the text reader" and no_text["vlm:small-vision"] is None


def test_strategies(spark):
    docs = spark.createDataFrame([("a", "clean", 90.0), ("a", "degraded", 33.0)], "doc string, variant string, mean_conf double")
    results = spark.createDataFrame([
        ("a", "clean", "ocr", 0.9, 1.0, 2.0, None), ("a", "clean", "vlm", 0.8, 3.0, 4.0, None),
        ("a", "degraded", "ocr", 0.9, 9.0, 9.0, "boom"), ("a", "degraded", "vlm", 0.7, 3.0, 4.0, None)],
        "doc string, variant string, path string, overall double, cost double, latency_s double, error string")
    got = {r.strategy: r for r in B.compare_strategies(B.pick_paths(docs), results).collect()}
    assert (got["router"].acc, got["router"].vlm_calls, got["router"].cost_per_doc) == (0.8, 1, 2.0)
    assert (got["ocr-only"].acc, got["ocr-only"].acc_degraded, got["ocr-only"].latency_per_doc) == (0.45, 0.0, 1.0)
    own = B.pick_paths(docs, {"mine": F.lit("vlm")})
    assert B.compare_strategies(own, results).first().vlm_calls == 2


def test_thresholds(spark):
    docs = spark.createDataFrame([(69.9, 0.2, 0.8), (70.0, 0.9, 0.5)], "mean_conf double, ocr_score double, vlm_score double")
    got = {r.threshold: (r.acc, r.vlm_calls) for r in R.tune_threshold(docs, range(0, 101, 35)).collect()}
    assert got == {0: (0.55, 0), 35: (0.55, 0), 70: (0.85, 1)}


def test_report_files(spark, tmp_path):
    trials, r = ranked(spark)
    detail = B.last_trial_detail(runs(spark), trials)
    write_report(r, detail, str(tmp_path))
    lines = [x.value for x in spark.read.text(f"{tmp_path}/ranking").collect()]
    assert "| 1 | `vlm:small-vision` | 0.575 | 0.458 | 6.1s | $0.0002 |" in lines
    shown = [x.line for x in detail_text(detail, r).collect()]
    assert shown == ["- **vlm:small-vision**: a 0.80", "- **vlm:small-vision**: b 0.60",
                     "- **ocr:small-vision**: a 0.56", "- **ocr:small-vision**: b 0.56"]
    assert lines[-1] == "Best so far: `vlm:small-vision` with 0.575 over 2 labelled documents."


def test_gold_grows_by_new_cases_only(spark):
    gold = spark.createDataFrame([("a", 1)], "doc string, v int")
    more = spark.createDataFrame([("a", 2), ("b", 2)], gold.schema)
    assert sorted((r.doc, r.v) for r in R.grow_gold(gold, more).collect()) == [("a", 1), ("b", 2)]


def test_gate(spark):
    df = spark.createDataFrame([(0.9, 0.9), (0.9, 0.1), (None, 0.9)], "overall double, f1 double")
    assert [r.passes for r in R.release_gate(df, {"overall": 0.8, "f1": 0.5}).collect()] == [True, False, False]
