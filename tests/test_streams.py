"""Streams: seen ids in merged runs, live status, stuck jobs by timers, three sinks at once."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyfolio.sources import jobstore as S
from tallyfolio.streaming import jobs as X, sweeper as W
from tallyfolio.streaming.runs import RunTable, seen_ids

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


# ------------------------------------------------------------------ seen ids

def test_an_id_sent_again_on_another_day_is_kept_once(spark, tmp_path):
    schema = "event_id string, ts timestamp"
    batches = [[("a", at(23 * 60 + 59)), ("b", at(0))], [("a", at(24 * 60 + 1)), ("c", at(3))], [("b", at(90 * 24 * 60)), ("a", at(0)), ("d", at(1))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        X.write_batches(stream, X.keep_new(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c", "d"]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    write = X.keep_new(f"{tmp_path}/out")
    one = spark.createDataFrame([("a", at(1)), ("b", at(2))], "event_id string, ts timestamp")
    two = spark.createDataFrame([("b", at(3)), ("c", at(4))], "event_id string, ts timestamp")
    for batch, df in ((0, one), (0, one), (1, two), (1, two), (1, two)):
        write(df, batch)
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_runs_are_merged_and_lookups_read_their_buckets_only(spark, tmp_path):
    table = seen_ids(spark, str(tmp_path), "event_id", "bigint", fan=3, bucket_rows=50)
    for batch in range(10):
        table.add(spark.range(batch * 200, batch * 200 + 200).toDF("event_id"), batch)
    assert table.read().count() == 2000 and len(table.runs()) <= 4
    assert max(r.tier for r in table.runs()) == 2 and max(r.bits for r in table.runs()) >= 5
    asked = spark.createDataFrame([(7,), (1999,), (5000,)], "event_id bigint")
    found = table.lookup(asked)
    assert sorted(r[0] for r in found.collect()) == [7, 1999]
    # What a lookup reads: the rows of a few buckets, not the history.
    read = sum(table._rows(r).filter(F.col("bucket").isin([x[0] for x in asked.select(table._bucket(r.bits)).collect()])).count()
               for r in table.runs())
    assert read < 500 and "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()
    assert [sorted(r[0] for r in table.lookup(asked, before=b).collect()) for b in (0, 9, 10)] == [[], [7], [7, 1999]]


def test_an_unfinished_batch_is_not_seen(spark, tmp_path, monkeypatch):
    table = seen_ids(spark, str(tmp_path), "event_id", "bigint", fan=2)
    table.add(spark.range(10).toDF("event_id"), 0)

    def crash(*_):
        raise RuntimeError("lost")
    monkeypatch.setattr(table, "merge", crash)
    with pytest.raises(RuntimeError):
        table.add(spark.range(10, 20).toDF("event_id"), 1)
    assert table.read().count() == 10
    monkeypatch.undo()
    table.add(spark.range(10, 20).toDF("event_id"), 1)
    table.add(spark.range(0).toDF("event_id"), 2)
    table.add(spark.range(20, 25).toDF("event_id"), 3)
    assert sorted(r[0] for r in table.read().collect()) == list(range(25))


def test_live_status_is_merged(spark, tmp_path):
    rng = random.Random(3)
    write, rows = X.merge_live(str(tmp_path)), []
    for batch in range(9):
        new = [(f"j{rng.randint(0, 9)}", rng.choice(["RUNNING", "FAILED"]), at(rng.randint(0, 999)), batch * 100 + i) for i in range(20)]
        rows += new
        write(spark.createDataFrame(new, "job_id string, status string, ts timestamp, seq int"), batch)
    table = X.live_table(spark, str(tmp_path))
    last = {}
    for job, status, ts, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        last[job] = status, ts, seq
    got = {r.job_id: (r.status, r.ts, r.seq) for r in X.current_status(table.read()).collect()}
    assert got == last
    assert sum(r.n_events for r in X.current_status(table.read()).collect()) == len(rows)
    assert table.read().count() <= 10 * len(table.runs()) < 10 * 9


# ------------------------------------------------------------------ stuck jobs

def test_stuck_jobs_over_several_batches(spark, tmp_path):
    W.use_rocksdb(spark)
    schema = "job_id string, status string, ts timestamp, seq int"
    batches = [
        [("done", "RUNNING", at(0), 1), ("done", "SUCCEEDED", at(5), 2), ("silent", "RUNNING", at(3), 3), ("slow", "RUNNING", at(0), 4),
         ("slow", "RUNNING", at(50), 5), ("waits", "PENDING", at(0), 6), ("late", "RUNNING", at(10), 7)],
        [("late", "SUCCEEDED", at(35), 8), ("clock", "PENDING", at(45), 9), ("slow", "SUCCEEDED", at(60), 10)],
        [("clock", "PENDING", at(300), 11), ("new", "RUNNING", at(299), 12)],
    ]
    found = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        X.write_batches(W.stuck_jobs(stream, 30, "20 minutes"), X.keep_batch(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination()
        found.append(sorted((r.job_id, r.seq) for r in spark.read.schema(W.REQUEUE).parquet(f"{tmp_path}/out").collect()))
    # "slow" ran out between two of its own events; "silent" when the watermark passed 33 minutes; "new" is still patient.
    assert found[0][0] == ("slow", 4) or ("slow", 4) in found[0]
    assert found[-1] == [("silent", 3), ("slow", 4)]


def test_stuck_jobs_are_those_of_a_pass_over_each_job(spark, tmp_path):
    """Random jobs in three batches, with rows out of order and of the same time, against one loop per job."""
    rng = random.Random(11)
    W.use_rocksdb(spark)
    schema, patience, late = "job_id string, status string, ts timestamp, seq int", 30, 60
    found, held, high, expected = [], {}, None, set()
    for batch in range(3):
        rows = [(f"j{rng.randint(0, 40)}", rng.choice(["RUNNING", "RUNNING", "PENDING", "FAILED"]),
                 at(batch * 100 + rng.choice([0, 7.25, 30, 31, 60, rng.randint(0, 100)])), batch * 1000 + i) for i in range(120)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for job, status, ts, seq in sorted(rows, key=lambda r: (r[2], r[3])):
            if job in held and (ts, seq) < held[job]:
                continue
            if job in held and ts > held[job][0] + timedelta(minutes=patience):
                expected.add((job, held[job][1]))
            held.pop(job, None)
            if status == "RUNNING":
                held[job] = ts, seq
        high = max([r[2] for r in rows] + ([high] if high else []))
        for job, (ts, seq) in list(held.items()):
            if ts + timedelta(minutes=patience) <= high - timedelta(minutes=late):
                expected.add((job, seq))
                del held[job]
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        X.write_batches(W.stuck_jobs(stream, patience, f"{late} minutes"), X.keep_batch(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination()
        found = [(r.job_id, r.seq) for r in spark.read.schema(W.REQUEUE).parquet(f"{tmp_path}/out").collect()]
    assert len(found) == len(set(found)) > 20 and set(found) == expected


def test_state_of_stuck_jobs_is_kept_by_bucket(spark, tmp_path):
    """Calls into Python are bounded by the buckets, not by the jobs."""
    W.use_rocksdb(spark)
    spark.range(20_000).select(F.concat(F.lit("j"), "id").alias("job_id"), F.lit("RUNNING").alias("status"), F.lit(at(0)).alias("ts"),
                               F.col("id").cast("int").alias("seq")).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("clock", "PENDING", at(500), 0)], "job_id string, status string, ts timestamp, seq int").write.mode("append").parquet(
        f"{tmp_path}/in")
    stream = spark.readStream.schema("job_id string, status string, ts timestamp, seq int").parquet(f"{tmp_path}/in")
    X.write_batches(W.stuck_jobs(stream, 30, "20 minutes"), X.keep_batch(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination()
    assert spark.read.schema(W.REQUEUE).parquet(f"{tmp_path}/out").distinct().count() == 20_000
    # A read of the stored state names its keys.
    keys = spark.read.format("statestore").option("stateVarName", "watched").load(f"{tmp_path}/cp").schema["key"].dataType
    assert keys.names == ["bucket"]


# ------------------------------------------------------------------ three sinks

def test_a_crash_between_sinks_leaves_nothing_visible(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "job_id string")
    written = []

    def dies(rows, path, batch):
        if path.endswith("audit_events"):
            raise RuntimeError("lost")
        S._write_batch(rows, path, batch)
        written.append(path)
    S.flush_together(df, df, df, str(tmp_path), 0)
    with pytest.raises(RuntimeError):
        S.flush_together(df, df, df, str(tmp_path), 1, write=dies)
    assert len(written) == 2
    assert [S.committed(spark, str(tmp_path), s).count() for s in S.SINKS] == [2, 2, 2]
    S.flush_together(df, df, df, str(tmp_path), 1)
    S.flush_together(df.limit(0), df, df, str(tmp_path), 1)
    assert [S.committed(spark, str(tmp_path), s).count() for s in S.SINKS] == [4, 4, 4]
    assert S.is_committed(spark, str(tmp_path), 1) and not S.is_committed(spark, str(tmp_path), 2)
