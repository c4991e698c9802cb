"""Registered queries over job logs: state, overlays, trails, lifecycle, stored form, streams."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfolio.operators import history as H, jobs as J
from tallyfolio.plans import tables as T
from tallyfolio.plans.records import flat_jobs, settled, text
from tallyfolio.schemas import INVOICE
from tallyfolio.session import scratch_path
from tallyfolio.sources import jobstore as S
from tallyfolio.streaming import jobs as X, sweeper as W

LOGGED = ["status", "was_scan", "source_path", "tier_used", "error"]
STATUS = {"signup": "PENDING", "view": "RUNNING", "purchase": "SUCCEEDED", "error": "FAILED"}
AS_OF = "2024-01-15 12:00:00"
NOW = "2024-02-01 00:00:00"


def moment(text_value: str) -> Column:
    return F.lit(text_value).cast("timestamp")


def shown(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def job_of(events: DataFrame) -> DataFrame:
    """A user's day is a job; the event number breaks ties of time."""
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.concat_ws("-", "user_id", F.date_format(ts, "yyyyMMdd")).alias("job_id"), "user_id",
        ts.alias("ts"), F.col("event_id").alias("seq"), "event_type", "value")


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_of(T.table(spark, sf_dir, "events"))


def status_of(event_type: Column) -> Column:
    pairs = [F.lit(x) for kv in STATUS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), event_type)


def changes(log: DataFrame) -> DataFrame:
    """What each event writes: a struct per written column, a null inside to clear it."""
    kind = F.col("event_type")

    def put(value: Column) -> Column:
        return F.struct(value.alias("v"))

    nothing = F.lit(None).cast("string")
    return log.select(
        "job_id", "ts", "seq",
        F.when(kind != "click", put(status_of(kind))).alias("status"),
        F.when(kind == "click", put(F.col("value") > 20)).alias("was_scan"),
        F.when(kind == "click", put(F.concat(F.lit("/documents/"), "job_id", F.lit("/"), "seq"))).alias("source_path"),
        F.when(kind == "purchase", put(F.when(F.col("value") > 30, "tier-2").otherwise("tier-1")))
        .when(kind == "error", put(nothing)).alias("tier_used"),
        F.when(kind == "error", put(F.concat(F.lit("event "), "seq"))).when(kind == "purchase", put(nothing)).alias("error"))


def flat_state(state: DataFrame) -> DataFrame:
    return state.select(
        "job_id", shown("created_at").alias("created_at"), shown("updated_at").alias("updated_at"),
        text("status").alias("status"), F.coalesce(F.col("was_scan").cast("string"), F.lit("")).alias("was_scan"),
        text("source_path").alias("source_path"), text("tier_used").alias("tier_used"), text("error").alias("error"))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.fold(changes(job_log(spark, sf_dir)), LOGGED)


# ------------------------------------------------------------------ state

def job_state(spark, sf_dir):
    return flat_state(state(spark, sf_dir))


def job_state_as_of(spark, sf_dir):
    return flat_state(J.state_as_of(changes(job_log(spark, sf_dir)), LOGGED, moment(AS_OF)))


def job_partial_update(spark, sf_dir):
    """State by the middle of the month, then one update from each job's second half."""
    log = changes(job_log(spark, sf_dir))
    before = J.fold(log.filter(F.col("ts") <= moment(AS_OF)), LOGGED)
    later = log.filter(F.col("ts") > moment(AS_OF))
    order = F.struct("ts", "seq")
    one = later.groupBy("job_id").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in LOGGED])
    return flat_state(J.apply_update(before, one, LOGGED, moment(NOW)))


def job_latest_rows(spark, sf_dir):
    rows = job_log(spark, sf_dir).filter(F.col("event_type") != "click").select(
        "job_id", status_of(F.col("event_type")).alias("status"), F.col("ts").alias("updated_at"), "seq")
    latest = J.latest_rows(rows, order=("updated_at", "seq"))
    return latest.select("job_id", "status", shown("updated_at").alias("updated_at"), "seq")


def terminal_jobs(spark, sf_dir):
    return flat_state(J.terminal(state(spark, sf_dir)))


def stale_jobs(spark, sf_dir):
    late = J.stale_running(state(spark, sf_dir), moment(NOW), 24 * 60)
    return late.select("job_id", shown("updated_at").alias("updated_at"), "idle_minutes")


def claim_history(spark, sf_dir):
    """When each status of a job held."""
    h = H.validity(changes(job_log(spark, sf_dir)), "status")
    return h.select("job_id", text("value").alias("status"), shown("valid_from").alias("valid_from"),
                    F.coalesce(shown("valid_to"), F.lit("")).alias("valid_to"))


def claim_states_asked(spark, sf_dir):
    """Every fifth event asks what its job, and the user's job of the day before, were 90 minutes later."""
    log = job_log(spark, sf_dir)
    moment_ = F.col("ts") + F.expr("INTERVAL 90 MINUTES")
    before = F.concat_ws("-", "user_id", F.date_format(F.col("ts") - F.expr("INTERVAL 1 DAY"), "yyyyMMdd"))
    asked = log.filter(F.col("seq") % 5 == 0).select(F.explode(F.array("job_id", before)).alias("job_id"), "seq", moment_.alias("moment"))
    s = H.as_of(changes(log), asked, LOGGED)
    return s.select("job_id", "seq", shown("moment").alias("moment"), text("status").alias("status"),
                    F.coalesce(F.col("was_scan").cast("string"), F.lit("")).alias("was_scan"), text("source_path").alias("source_path"),
                    text("tier_used").alias("tier_used"), text("error").alias("error"))


# ------------------------------------------------------------------ live over durable

def live_durable(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Even users are live, odd ones durable, every tenth user is in both."""
    both = F.col("user_id") % 10 == 0
    return log.filter(F.col("user_id") % 2 == 0), log.filter((F.col("user_id") % 2 == 1) | both)


def job_overlay(spark, sf_dir):
    live, durable = live_durable(job_log(spark, sf_dir))

    def newest(rows: DataFrame, store: str) -> DataFrame:
        return J.latest_rows(rows.select("job_id", "ts", "seq", "event_type", F.lit(store).alias("store")),
                             order=("ts", "seq"))

    # the durable copy lags: it has not seen events of the last days
    behind = durable.filter(F.col("ts") <= moment(AS_OF))
    rows = J.overlay_jobs(newest(live, "live"), newest(behind, "durable"))
    return rows.select("job_id", shown("ts").alias("ts"), "seq", "event_type", "store")


def trail_overlay(spark, sf_dir):
    live, durable = live_durable(job_log(spark, sf_dir))
    rows = J.overlay_events(live.withColumn("store", F.lit("live")), durable.withColumn("store", F.lit("durable")))
    return rows.select("job_id", "seq", shown("ts").alias("ts"), "event_type", "store")


def known_job_events(spark, sf_dir):
    """Events of jobs that were received (have a signup); the others are unknown jobs."""
    log = job_log(spark, sf_dir)
    known = log.filter(F.col("event_type") == "signup")
    return J.with_known_jobs(log, known).select("job_id", "seq", "event_type")


def trails_oldest_first(spark, sf_dir):
    trails = J.numbered(J.oldest_first(job_log(spark, sf_dir)))
    return trails.select("job_id", "position", shown("ts").alias("ts"), "seq", "event_type")


def lifecycle_violations(spark, sf_dir):
    log = job_log(spark, sf_dir).filter(F.col("event_type") != "click")
    log = log.withColumn("status", status_of(F.col("event_type")))
    bad = J.lifecycle_violations(log.select("job_id", "ts", "seq", "status"))
    return bad.select("job_id", "seq", text("previous").alias("previous"), "status")


# ------------------------------------------------------------------ rows written

def new_job_rows(spark, sf_dir):
    rows = S.new_jobs(T.submissions(spark, sf_dir), moment(NOW))
    return rows.select("id", "status", text("filename").alias("filename"), shown("created_at").alias("created_at"))


def received_events(spark, sf_dir):
    rows = S.received_events(T.submissions(spark, sf_dir), moment(NOW))
    return rows.select("event_id", "job_id", F.col("seq").cast("bigint").alias("seq"), shown("ts").alias("ts"),
                       "stage", "detail")


def appended_events(spark, sf_dir):
    """Two batches of events in one table: what was received, then what each document counted."""
    subs = T.submissions(spark, sf_dir)
    pages = S.audit_rows(subs.select("job_id", F.when(F.col("n_images") > 0, F.array(F.struct(
        moment(NOW).alias("ts"), F.lit("PAGES").alias("stage"),
        F.col("n_images").cast("string").alias("detail")))).otherwise(F.array()).alias("events")))
    both = S.received_events(subs, moment(NOW)).unionByName(pages)
    return both.select("event_id", "job_id", F.col("seq").cast("bigint").alias("seq"), "stage", "detail")


def _job_rows(spark, sf_dir) -> DataFrame:
    stamp = moment(NOW)
    return settled(spark, sf_dir).select(
        F.col("job_id").alias("id"), "status", "filename", stamp.alias("created_at"), stamp.alias("updated_at"),
        "was_scan", "source_path", "tier_used", "result", "warnings", "error")


def stored_jobs(spark, sf_dir):
    """Stored form, looked into with JSON paths."""
    s = S.stored_form(_job_rows(spark, sf_dir))

    def path(c: str, p: str) -> Column:
        return text(F.get_json_object(c, p))
    return s.select(
        "id", "status", path("result_json", "$.invoice_number").alias("number"),
        F.get_json_object("result_json", "$.total").cast("double").alias("total"),
        path("result_json", "$.line_items[0].description").alias("first_item"),
        F.col("warnings_json").isNull().alias("no_warnings"), path("warnings_json", "$[0]").alias("warning"))


def loaded_jobs(spark, sf_dir):
    """Written out and read back: the record is the same as before."""
    loaded = S.loaded_form(S.stored_form(_job_rows(spark, sf_dir)))
    return flat_jobs(loaded.withColumnRenamed("id", "job_id"))


def job_lookup(spark, sf_dir):
    """Scans of two pages; what is looked for is bound and never part of the statement."""
    return spark.sql(
        "SELECT job_id, filename IS NULL AS unnamed FROM {subs} WHERE n_images = :pages AND has_text = :has_text",
        args=S.bound({"pages": 2, "has_text": False}), subs=T.submissions(spark, sf_dir))


def job_by_id(spark, sf_dir):
    """A stored job looked up by a bound id and decoded; here the job with the largest id."""
    stored = S.stored_form(_job_rows(spark, sf_dir))
    wanted = T.submissions(spark, sf_dir).agg(F.max("job_id")).first()[0]
    stored.createOrReplaceTempView("stored_jobs_view")
    return flat_jobs(S.get_job(spark, "stored_jobs_view", wanted).withColumnRenamed("id", "job_id"))


def trail_by_id(spark, sf_dir):
    """The trail of one job, looked up by a bound id, oldest first."""
    subs = T.submissions(spark, sf_dir)
    wanted = subs.agg(F.max("job_id")).first()[0]
    S.received_events(subs, moment(NOW)).createOrReplaceTempView("stored_events_view")
    trail = S.get_trail(spark, "stored_events_view", wanted)
    return trail.select(shown("ts").alias("ts"), F.col("seq").cast("bigint").alias("seq"), "stage", "detail")


# ------------------------------------------------------------------ streams

FILES_PER_BATCH = 64


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A warehouse table as a stream, whether it is one file or a folder of part files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
            .parquet(f"{sf_dir}/{name}.parque[t]"))


def _run(stream: DataFrame, name: str, writer=X.keep_batch) -> DataFrame:
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    X.write_batches(stream, writer(f"{base}/out"), f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stream_routing(spark, sf_dir):
    """Documents routed as they arrive."""
    from tallyfolio.plans.documents import line_pages
    docs = _stream(spark, sf_dir, "documents")
    routed = X.route_arrivals(docs.select("doc_id", "text", line_pages(F.col("text")).alias("pages")))
    out = _run(routed.select("doc_id", "reader", "was_scan", F.size("images").alias("n_images")), "routing")
    return out.select("doc_id", "reader", "was_scan", F.greatest("n_images", F.lit(0)).cast("bigint").alias("n_images"))


def stream_unique_events(spark, sf_dir):
    """Every event sent twice, kept once."""
    twice = _stream(spark, sf_dir, "events").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    sent = twice.select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _run(sent, "unique", X.keep_new).select("event_id", "event_type", "user_id")


def stream_live_status(spark, sf_dir):
    log = job_of(_stream(spark, sf_dir, "events")).filter(F.col("event_type") != "click")
    rows = log.select("job_id", status_of(F.col("event_type")).alias("status"), "ts", "seq")
    base = scratch_path(spark, "status")
    X.write_batches(rows, X.merge_live(f"{base}/out"), f"{base}/checkpoint").awaitTermination()
    out = X.current_status(X.live_table(spark, f"{base}/out").read())
    return out.select("job_id", "status", shown("ts").alias("ts"), "seq", "n_events")


PATIENCE_MINUTES, DELAY = 6 * 60, "1 hour"


def stream_requeued_jobs(spark, sf_dir):
    """RUNNING events that nothing followed in time, found by timers while the stream runs."""
    W.use_rocksdb(spark)
    log = job_of(_stream(spark, sf_dir, "events")).filter(F.col("event_type") != "click")
    rows = log.select("job_id", status_of(F.col("event_type")).alias("status"), "ts", "seq")
    out = _run(W.stuck_jobs(rows, PATIENCE_MINUTES, DELAY), "requeued")
    return out.select("job_id", shown("running_since").alias("running_since"), "seq")


def stream_final_flush(spark, sf_dir):
    """Finished jobs to their three sinks; shows what the sinks hold."""
    base = scratch_path(spark, "flush")
    ev = job_of(_stream(spark, sf_dir, "events"))
    nothing = F.lit(None).cast("string")
    finished = ev.select(
        F.concat_ws("-", "job_id", "seq").alias("job_id"), F.coalesce(status_of(F.col("event_type")), F.lit("RUNNING")).alias("status"),
        F.concat(F.lit("statement_"), "seq", F.lit(".pdf")).alias("filename"), F.lit(False).alias("was_scan"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), nothing.alias("tier_used"),
        F.lit(None).cast(INVOICE).alias("result"), F.array(F.col("event_type")).alias("warnings"), nothing.alias("error"),
        F.encode(F.col("value").cast("string"), "UTF-8").alias("content"),
        F.array(F.struct("ts", F.lit("RECEIVED").alias("stage"), F.lit("").alias("detail")),
                F.struct("ts", F.upper("event_type").alias("stage"), F.col("event_type").alias("detail"))).alias("events"))
    X.write_batches(finished, X.flush_finished(f"{base}/out"), f"{base}/checkpoint").awaitTermination()

    def sink(name: str, key: str, *columns: str) -> DataFrame:
        value = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
        return S.committed(spark, f"{base}/out", name).select(F.lit(name).alias("sink"), F.col(key).alias("key"), value.alias("value"))

    return (sink("documents", "job_id", "path")
            .unionByName(sink("jobs", "id", "status", "source_path", "was_scan", "result_json", "warnings_json"))
            .unionByName(sink("audit_events", "event_id", "job_id", "seq", "stage", "detail")))


QUERIES = {f.__name__: f for f in (
    job_state, job_state_as_of, claim_history, claim_states_asked, job_partial_update, job_latest_rows, terminal_jobs, stale_jobs, job_overlay,
    trail_overlay, known_job_events, trails_oldest_first, lifecycle_violations, new_job_rows, received_events,
    appended_events, stored_jobs, loaded_jobs, job_lookup, job_by_id, trail_by_id, stream_routing, stream_unique_events,
    stream_live_status, stream_requeued_jobs, stream_final_flush)}
