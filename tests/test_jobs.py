"""Job state, overlays, lifecycle, tables, flush and streams."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyfolio.operators import jobs as J
from tallyfolio.sources import jobstore as S
from tallyfolio.streaming import jobs as X

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_fold_keeps_the_last_write_of_each_column(spark):
    rows = [("a", at(0), 0, ("PENDING",), None), ("a", at(1), 1, ("RUNNING",), ("x",)), ("a", at(1), 2, None, (None,)),
            ("b", at(3), 0, ("PENDING",), None)]
    log = spark.createDataFrame(rows, "job_id string, ts timestamp, seq int, status struct<v string>, error struct<v string>")
    got = {r.job_id: r for r in J.fold(log, ["status", "error"]).collect()}
    assert (got["a"].status, got["a"].error, got["a"].updated_at) == ("RUNNING", None, at(1))
    early = J.state_as_of(log, ["status", "error"], F.lit("2024-01-01 00:00:30").cast("timestamp")).collect()
    assert [(r.job_id, r.status) for r in early] == [("a", "PENDING")]


def test_partial_update(spark):
    jobs = spark.createDataFrame([("a", at(0), "PENDING", "old"), ("b", at(0), "PENDING", "old")],
                                 "job_id string, updated_at timestamp, status string, error string")
    change = spark.createDataFrame([("a", ("RUNNING",), (None,))], "job_id string, status struct<v string>, error struct<v string>")
    now = F.lit("2024-01-02").cast("timestamp")
    got = {r.job_id: r for r in J.apply_update(jobs, change, ["status", "error"], now).collect()}
    assert (got["a"].status, got["a"].error, got["a"].updated_at) == ("RUNNING", None, datetime(2024, 1, 2))
    assert (got["b"].status, got["b"].error, got["b"].updated_at) == ("PENDING", "old", at(0))


def test_overlays(spark):
    live = spark.createDataFrame([("a", "live", None)], "job_id string, store string, error string")
    durable = spark.createDataFrame([("a", "durable", "x"), ("b", "durable", None)], live.schema)
    got = {r.job_id: (r.store, r.error) for r in J.overlay_jobs(live, durable).collect()}
    assert got == {"a": ("live", None), "b": ("durable", None)}
    both = J.overlay_events(live, durable.unionByName(durable))
    assert sorted((r.job_id, r.store) for r in both.collect()) == [("a", "live"), ("b", "durable"), ("b", "durable")]


def test_previous_row_agrees_with_a_plain_walk(spark):
    rng = random.Random(5)
    rows = sorted({(rng.choice("ab"), at(rng.randint(0, 5) + rng.choice([0, 0.25, 0.5])), i, rng.choice("xyz")) for i in range(300)})
    df = spark.createDataFrame(rows, "job_id string, ts timestamp, seq int, status string")
    expected, last = {}, {}
    for job, _, seq, status in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        expected[job, seq] = last.get(job)
        last[job] = status
    assert {(r.job_id, r.seq): r.previous for r in J.with_previous(df, "status").collect()} == expected


def test_lifecycle(spark):
    rows = [("good", 0, "PENDING"), ("good", 1, "RUNNING"), ("good", 2, "SUCCEEDED"), ("skip", 0, "PENDING"),
            ("skip", 1, "FAILED"), ("back", 0, "PENDING"), ("back", 1, "RUNNING"), ("back", 2, "FAILED"), ("back", 3, "RUNNING"),
            ("late", 5, "RUNNING"), ("same", 0, "PENDING"), ("same", 1, "PENDING")]
    log = spark.createDataFrame([(j, at(m), m, s) for j, m, s in rows], "job_id string, ts timestamp, seq int, status string")
    assert sorted((r.job_id, r.seq) for r in J.lifecycle_violations(log).collect()) == [("back", 3), ("late", 5), ("skip", 1)]


def test_stale(spark):
    jobs = spark.createDataFrame([("a", "RUNNING", at(0)), ("b", "RUNNING", at(50)), ("c", "FAILED", at(0))],
                                 "job_id string, status string, updated_at timestamp")
    late = J.stale_running(jobs, F.lit("2024-01-01 01:00:00").cast("timestamp"), 30).collect()
    assert [(r.job_id, r.idle_minutes) for r in late] == [("a", 60)]


def test_tables_and_bound_lookup(spark):
    S.create_tables(spark, "folio_test")
    S.create_tables(spark, "folio_test")
    assert spark.table("folio_test.jobs").columns == list(S.JOB_COLUMNS)
    spark.createDataFrame([("x' OR '1'='1", at(1), 0, "RECEIVED", "d"), ("b", at(2), 1, "X", ""), ("b", at(1), 0, "R", "")],
                          "job_id string, ts timestamp, seq int, stage string, detail string").createOrReplaceTempView("trail_test")
    assert [r.stage for r in S.get_trail(spark, "trail_test", "b").collect()] == ["R", "X"]
    assert S.get_trail(spark, "trail_test", "x' OR '1'='1").count() == 1
    assert S.get_trail(spark, "trail_test", "none").count() == 0
    assert S.get_job(spark, "folio_test.jobs", "none").count() == 0
    spark.sql("DROP DATABASE folio_test CASCADE")


def test_audit_rows(spark):
    batches = spark.createDataFrame([("a", [(at(0), "R", "x"), (at(1), "S", "y")]), ("b", [])],
                                    "job_id string, events array<struct<ts timestamp, stage string, detail string>>")
    rows = S.audit_rows(batches)
    assert [(r.job_id, r.seq, r.stage) for r in rows.orderBy("seq").collect()] == [("a", 0, "R"), ("a", 1, "S")]
    later = batches.withColumn("events", F.transform("events", lambda e: e.withField("ts", e["ts"] + F.expr("INTERVAL 1 HOUR"))))
    assert rows.union(S.audit_rows(later)).select("event_id").distinct().count() == 4
    assert rows.union(S.audit_rows(batches)).select("event_id").distinct().count() == 2


def test_flush_order_and_repeat(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "job_id string")
    order = []
    S.flush(df, df, df, "x", 1, write=lambda _, path, batch: order.append((path, batch)))
    assert order == [("x/documents", 1), ("x/jobs", 1), ("x/audit_events", 1)]
    for batch in (1, 1, 2):
        S.flush(df, df, df, str(tmp_path), batch)
    assert spark.read.parquet(f"{tmp_path}/jobs").count() == 2


def test_status_stream_over_several_batches(spark, tmp_path):
    schema = "job_id string, status string, ts timestamp, seq int"
    for i, status in enumerate(("PENDING", "RUNNING", "SUCCEEDED")):
        spark.createDataFrame([("a", status, at(i), i), (f"b{i}", status, at(i), i)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        X.write_batches(stream, X.keep_live(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination()
    got = {r.job_id: r.status for r in X.current_status(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == {"a": "SUCCEEDED", "b0": "PENDING", "b1": "RUNNING", "b2": "SUCCEEDED"}


def test_late_and_repeated_events_are_kept_once(spark, tmp_path):
    schema = "event_id string, ts timestamp"
    day = timedelta(days=1)
    for rows in ([("a", at(5)), ("a", at(5)), ("b", at(6))], [("late", at(0) - day), ("b", at(6))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        X.write_batches(stream, X.keep_new(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "late"]


@pytest.mark.parametrize("name", ["stream_routing", "stream_unique_events", "stream_live_status", "stream_final_flush"])
def test_streams_read_folders_of_part_files(spark, sf_dir, tmp_path, name):
    from tallyfolio.plans import lifecycle
    for table in ("events", "documents"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    one, parts = (sorted(map(str, lifecycle.QUERIES[name](spark, d).collect())) for d in (sf_dir, str(tmp_path)))
    assert one == parts and one


def test_hot_keys_are_split_between_tasks(spark):
    rows = spark.range(60_000).select((F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id"))).alias("job_id"), F.col("id").alias("seq"),
                                      F.lit("x" * 40).alias("detail")).repartition(6)
    known = rows.filter("job_id % 2 = 0").select("job_id").distinct()
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        dealt = J.with_known_jobs(rows, known)
        assert sorted(r.seq for r in dealt.collect()) == sorted(r.seq for r in rows.join(known, "job_id", "left_semi").collect())
        assert "skew=true" in dealt._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_positions_across_blocks(spark):
    rows = spark.createDataFrame([("a", at(m), m) for m in (0, 1, 70, 71, 200)] + [("b", at(3), 3)], "job_id string, ts timestamp, seq int")
    got = {(r.job_id, r.seq): r.position for r in J.numbered(rows).collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("a", 70): 3, ("a", 71): 4, ("a", 200): 5, ("b", 3): 1}
