"""Job lifecycle on streams: arriving documents, deduplicated trail, live status, final flush."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfolio.operators.jobs import terminal
from tallyfolio.operators.pages import route
from tallyfolio.operators.staging import written
from tallyfolio.sources.documents import retained_path
from tallyfolio.sources.jobstore import audit_rows, flush_together, is_committed, stored_form
from tallyfolio.streaming.runs import FAN, RunTable, seen_ids


def route_arrivals(documents: DataFrame) -> DataFrame:
    """Arriving documents with their reader; stateless, so it runs on a stream unchanged."""
    return route(documents)


def keep_new(folder: str, key: str = "event_id", ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """Batch writer for a trail that holds each id once, whenever and with whatever time it comes.

    The ids stand in merged runs beside the trail (``<folder>-ids``), in hash buckets that have
    nothing to do with the day: a batch looks up its own buckets and does not read the trail.
    Nothing is kept in stream state and no event is dropped for being late. Of rows with one id in
    a batch one is kept. A repeated batch replaces its own folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = seen_ids(spark, f"{folder}-ids", key, batch.schema[key].dataType.simpleString())
        sent = written(batch.dropDuplicates([key]), "sent")
        new = written(sent.join(seen.lookup(sent, batch_id), key, "left_anti"), "new")
        (new.withColumns({"day": F.date_format(ts, "yyyy-MM-dd"), "batch_id": F.lit(batch_id).cast("bigint")}).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(folder))
        seen.add(new.select(key), batch_id)
    return write


def live_status(events: DataFrame) -> DataFrame:
    """Latest stage per job and batch of a stream, to be merged by ``keep_live``.

    Each task reduces its part of a hot job before the shuffle.
    """
    return events.groupBy("job_id").agg(
        F.max_by(F.struct("status", "ts", "seq"), F.struct("ts", "seq")).alias("last"),
        F.count("*").alias("n_events")).select("job_id", "last.*", "n_events")


def keep_live(folder: str) -> Callable[[DataFrame, int], None]:
    """Batch writer of a live-status stream without endless state.

    Each batch is reduced to one row per job and written beside the others; a job takes no
    room in memory after its batch, whether it has ended or not. ``current_status`` merges.
    """
    keep = keep_batch(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        keep(live_status(batch), batch_id)
    return write


STATUS = "job_id string, status string, ts timestamp, seq bigint, n_events bigint"


def live_table(spark: SparkSession, folder: str, fan: int = FAN) -> RunTable:
    """Live status as merged runs: a job has one row in each of some log(batches) runs."""
    return RunTable(spark, folder, STATUS, "job_id", current_status, fan)


def merge_live(folder: str) -> Callable[[DataFrame, int], None]:
    """Batch writer of a live-status stream whose older batches are merged as it goes."""
    def write(batch: DataFrame, batch_id: int) -> None:
        now = live_status(batch).select("job_id", "status", "ts", F.col("seq").cast("bigint").alias("seq"), "n_events")
        live_table(batch.sparkSession, folder).add(written(now, "live"), batch_id)
    return write


def write_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> StreamingQuery:
    """Run a stream over what is there, batch by batch, and stop.

    The source's ``maxFilesPerTrigger`` (or its own rate option) bounds a batch.
    """
    return (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def keep_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: each batch replaces its own folder, so a repeated batch adds nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(folder))
    return write


def current_status(updates: DataFrame) -> DataFrame:
    """Status per job from the rows of all batches: the latest stage, all events counted."""
    return updates.groupBy("job_id").agg(
        F.max_by(F.struct("status", "ts", "seq"), F.struct("ts", "seq")).alias("last"),
        F.sum("n_events").alias("n_events")).select("job_id", "last.*", "n_events")


def flush_finished(folder: str, root: str = "/documents") -> Callable[[DataFrame, int], None]:
    """Batch writer for finished jobs: document, job row and trail, each once, as they are stored.

    Expects ``job_id, content, events ARRAY<ts, stage, detail>`` and the job's own columns. The
    batch is computed once, into a table of the shared folder, for its three writes; readers see
    the three together (``sources.jobstore.committed``).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if is_committed(batch.sparkSession, folder, batch_id):
            return
        done = written(terminal(batch), "finished")
        path = retained_path(root, F.col("job_id"), F.col("filename"))
        documents = done.select(path.alias("path"), "job_id", "filename", "content")
        rows = done.withColumnRenamed("job_id", "id").withColumn(
            "source_path", retained_path(root, F.col("id"), F.col("filename")))
        flush_together(documents, stored_form(rows), audit_rows(done.select("job_id", "events")), folder, batch_id)
    return write
