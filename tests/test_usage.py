"""Usage by day: merged states against one pass and against exact quantiles in plain Python."""
import math
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyfolio.operators import usage as U
from tallyfolio.plans import evaluation as E, tables as T

GROUPS, MEASURES = ["day", "vendor"], ["latency", "cost"]
SCHEMA = "day string, vendor string, latency double, cost double, error string, n int, bucket string, `_m` int"


def failed():
    return F.col("error").isNotNull()


def calls(n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vendor = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        latency = rng.choice([rng.lognormvariate(1, 2), rng.lognormvariate(1, 2), 7.0, 0.0, -1.0, None, math.nan, math.inf])
        rows.append((f"d{rng.randint(1, 5)}", vendor, latency, rng.lognormvariate(-6, 1), rng.choice([None, None, "timeout"]), i, "x", i))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def told(state):
    return sorted((tuple("" if v is None else str(v) for v in r) for r in state.select(*GROUPS, "measure", "bucket", "n", "n_failed", "total").collect()))


def kept(rows, *days):
    return [r for r in rows if r[0] in days]


def files(path):
    return {day.name: sorted((f.name, f.stat().st_mtime_ns) for f in day.glob("*.parquet")) for day in Path(path).glob("day=*")}


def test_merged_days_equal_one_pass_and_exact_quantiles(spark, tmp_path):
    rows = calls()
    state = U.UsageState(spark, str(tmp_path / "s"), GROUPS, MEASURES)
    state.add(frame(spark, kept(rows, "d1", "d2")), failed())
    before = files(state.path)
    state.add(frame(spark, kept(rows, "d3", "d4", "d5")), failed())
    after = files(state.path)
    assert set(after) == {f"day=d{i}" for i in range(1, 6)}
    assert {d: after[d] for d in before} == before          # only the new days were written
    assert told(state.read()) == told(U.summarise(frame(spark, rows), GROUPS, MEASURES, failed()))

    exact = defaultdict(list)
    for r in rows:
        for measure, x in zip(MEASURES, r[2:4]):
            if x is not None and math.isfinite(x):
                for level, key in enumerate([(None, None), (r[0], None), (r[0], r[1])]):
                    exact[level, *key, measure].append((max(x, 0.0), x, r[4]))
    got = {(r.level, r.day, r.vendor, r.measure): r for r in U.usage_report(state.read(), GROUPS).collect()}
    assert set(got) == set(exact)
    for key, held in exact.items():
        r, held = got[key], sorted(held, key=lambda h: h[0])
        assert r.n == len(held) and r.n_failed == sum(e is not None for _, _, e in held)
        assert r.total == pytest.approx(sum(x for _, x, _ in held), abs=1e-6)
        for q in U.QUANTILES:
            x = held[(len(held) * q + 999) // 1000 - 1][0]
            assert abs(r[f"p{q}"] - x) <= U.ERROR * x * (1 + 1e-9) + 1e-6


def test_a_day_that_comes_again_replaces_its_own(spark, tmp_path):
    rows = calls(600)
    state = U.UsageState(spark, str(tmp_path / "s"), GROUPS, MEASURES)
    state.add(frame(spark, kept(rows, "d1", "d2", "d3")), failed())
    before = files(state.path)
    # More calls of d2 are known by now; the same batch twice counts once.
    more = kept(rows, "d2") + [("d2", "late", 3.0, 0.5, None, 0, "x", 0)]
    for _ in range(2):
        state.add(frame(spark, more), failed())
    after = files(state.path)
    assert all(after[f"day={d}"] == before[f"day={d}"] for d in ("d1", "d3"))
    assert told(state.read()) == told(U.summarise(frame(spark, kept(rows, "d1", "d3") + more), GROUPS, MEASURES, failed()))


def test_empty_batches_and_an_empty_table(spark, tmp_path):
    state = U.UsageState(spark, str(tmp_path / "s"), GROUPS, MEASURES)
    state.add(frame(spark, calls(50)), failed())
    before = told(state.read())
    state.add(spark.createDataFrame([], SCHEMA), failed())
    assert told(state.read()) == before
    nothing = U.summarise(spark.createDataFrame([], SCHEMA), GROUPS, MEASURES, failed())
    assert U.usage_report(nothing, GROUPS).count() == 0


def test_a_day_opens_only_its_folder(spark, tmp_path):
    state = U.UsageState(spark, str(tmp_path / "s"), GROUPS, MEASURES)
    state.add(frame(spark, calls(200)), failed())
    one = state.read().filter("day = 'd3'")
    assert {Path(f).parent.name for f in one.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} == {"day=d3"}


def test_buckets_hold_their_error(spark):
    values = [1e-300, 1e-9, 0.5, 1.0, 7.0, 12345.678, 1e300, 0.0, -3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", U.value_of(U.bucket_of(F.col("x"))).alias("y"))
    for x, y in df.collect():
        assert y == 0.0 if x <= 0 else abs(y - x) <= U.ERROR * x * (1 + 1e-9)
    none = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,)], "x double")
    assert none.filter(U.bucket_of(F.col("x")).isNotNull()).count() == 0


def test_calls_without_a_day_are_one_day(spark, tmp_path):
    state = U.UsageState(spark, str(tmp_path / "s"), GROUPS, MEASURES)
    rows = [(None, "a", 1.0, 2.0, None, 0, "x", 0), ("", "a", 3.0, 2.0, "timeout", 1, "x", 0), ("d1", None, 5.0, 2.0, None, 2, "x", 0)]
    for _ in range(2):
        state.add(frame(spark, rows), failed())
    got = {(r.level, r.day, r.vendor): (r.n, r.n_failed, r.total) for r in U.usage_report(state.read(), GROUPS).filter("measure = 'latency'").collect()}
    assert got == {(0, None, None): (3, 1, 9.0), (1, None, None): (2, 1, 4.0), (1, "d1", None): (1, 0, 5.0),
                   (2, None, "a"): (2, 1, 4.0), (2, "d1", None): (1, 0, 5.0)}


def test_a_large_day_is_written_in_parts(spark, tmp_path):
    state = U.UsageState(spark, str(tmp_path / "s"), GROUPS, MEASURES)
    rows = [("d1", f"v{i}", float(i % 900 + 1), 0.5, None, i, "x", i) for i in range(4000)]
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for name, size in small.items():
        spark.conf.set(name, size)
    try:
        state.add(frame(spark, rows), failed())
    finally:
        for name in small:
            spark.conf.unset(name)
    assert len(files(state.path)["day=d1"]) > 1
    assert told(state.read()) == told(U.summarise(frame(spark, rows), GROUPS, MEASURES, failed()))


def test_calls_of_own_bills_are_not_joined_and_build_no_answer(spark, sf_dir):
    plan = E.billed_calls(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "invoice_number" not in plan
    every = T.attempts(spark, sf_dir).drop("response_json")
    assert every.exceptAll(T.calls(spark, sf_dir).select(*every.columns)).isEmpty() and every.count() == T.calls(spark, sf_dir).count()


def test_jobs_that_bills_share_give_every_bill_all_their_calls(spark, sf_dir, tmp_path):
    """Repeated lines, some shipped in another year or without numbers, against the plain join."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(400)
    later = lines.filter("l_orderkey % 3 = 0").withColumn("l_shipdate", F.expr("l_shipdate + interval 400 days").cast("timestamp"))
    bare = lines.filter("l_orderkey % 5 = 0").withColumn("l_partkey", F.lit(None).cast("bigint"))
    lines.union(later).union(bare).union(bare).write.parquet(f"{tmp_path}/lineitem.parquet")
    bills = T.bills(spark, str(tmp_path)).select("job_id", "vendor", F.date_format("shipped", "yyyy").alias("year"))
    columns = ["year", "vendor", "tier", "error_class", "latency_s"]
    want = T.attempts(spark, str(tmp_path)).join(bills, "job_id").select(*columns)
    got = E.billed_calls(spark, str(tmp_path)).withColumnRenamed("latency", "latency_s").select(*columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_calls_of_bills_without_a_date_are_counted(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(200)
    undated = F.when(F.col("l_orderkey") % 4 > 0, F.col("l_shipdate"))
    lines.withColumn("l_shipdate", undated).write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = E.usage_rollup(spark, str(tmp_path)).filter("level = 0 AND measure = 'latency'").first()
    assert whole.n == T.attempts(spark, str(tmp_path)).count()
