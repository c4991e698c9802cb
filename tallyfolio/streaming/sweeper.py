"""Stuck jobs found while the stream runs: keyed state with event-time timers.

A job is watched from the moment its last event says RUNNING. The next event moves or ends the
watch; an event that comes after the patience has run out, or the watermark passing the end of
the patience, gives a row to queue the job again. Jobs in any other status hold no state.

State is kept by hash bucket of the job, not by job: a call into Python and to the state store costs the
same for one job as for hundreds. A bucket holds the watches of its jobs (time and number of the
RUNNING event) as columns in the RocksDB state store, and one timer at the first end of a patience.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyfolio.schemas import RUNNING

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REQUEUE = "job_id string, running_since timestamp, seq bigint"
# Fixed for the life of a stream, as its state is kept by bucket.
BUCKETS = 256
_WATCH = "job_id array<string>, micros array<bigint>, seq array<bigint>"


def use_rocksdb(spark: SparkSession) -> None:
    """Timers need the RocksDB state store; a stream keeps the store it was started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Sweeper(StatefulProcessor):
    """Rows to requeue of one bucket of jobs: RUNNING events that nothing of the job followed in ``patience_ms``."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.watched = handle.getValueState("watched", _WATCH)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The bucket's rows of one batch; the source's options bound a batch.
        new = pd.concat(list(rows))[["job_id", "micros", "seq", "status"]]
        held = self._held()
        job, micros, seq = (np.concatenate((held[c].to_numpy(), new[c].to_numpy())) for c in ("job_id", "micros", "seq"))
        running = np.concatenate((np.full(len(held), True), (new["status"] == RUNNING).to_numpy(dtype=bool)))
        arrived = np.arange(len(job)) >= len(held)
        code = pd.factorize(job, use_na_sentinel=False)[0]
        # By job, in their order of time; at the same time what was known comes first.
        order = np.lexsort((arrived, seq, micros, code))
        job, micros, seq, running, arrived, code = (x[order] for x in (job, micros, seq, running, arrived, code))
        # Rows older than what is known of their job go.
        known = np.zeros(code.max() + 1, bool)
        known[code[~arrived]] = True
        seen = np.cumsum(~arrived)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        since = seen - (seen - ~arrived)[first].repeat(np.diff(first, append=len(code)))
        keep = ~known[code] | (since > 0)
        job, micros, seq, running, code = (x[keep] for x in (job, micros, seq, running, code))

        follows = np.append(code[1:] == code[:-1], False)
        after = np.append(micros[1:], 0)
        late = running & follows & (after // 1000 > micros // 1000 + self.patience_ms)
        watch = running & ~follows
        self._watch(job[watch], micros[watch], seq[watch])
        yield self._rows(job[late], micros[late], seq[late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        job, micros, seq = (held[c].to_numpy() for c in ("job_id", "micros", "seq"))
        out = micros // 1000 + self.patience_ms <= expiredTimerInfo.getExpiryTimeInMs()
        out |= micros // 1000 + self.patience_ms <= timerValues.getCurrentWatermarkInMs()
        self._watch(job[~out], micros[~out], seq[~out])
        yield self._rows(job[out], micros[out], seq[out])

    def _held(self) -> pd.DataFrame:
        job, micros, seq = self.watched.get() if self.watched.exists() else ([], [], [])
        return pd.DataFrame({"job_id": np.array(job, object), "micros": np.array(micros, np.int64), "seq": np.array(seq, np.int64)})

    def _watch(self, job: np.ndarray, micros: np.ndarray, seq: np.ndarray) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(job):
            self.watched.update((job.tolist(), micros.tolist(), seq.tolist()))
            self.handle.registerTimer(int(micros.min()) // 1000 + self.patience_ms)
        else:
            self.watched.clear()

    @staticmethod
    def _rows(job: np.ndarray, micros: np.ndarray, seq: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"job_id": job.astype(object), "running_since": pd.to_datetime(micros.astype(np.int64), unit="us"),
                             "seq": seq.astype(np.int64)})

    def close(self) -> None:
        pass


def stuck_jobs(events: DataFrame, patience_minutes: int, delay: str) -> DataFrame:
    """(job_id, running_since, seq) to queue again, from a stream of (job_id, status, ts, seq).

    ``delay`` is the watermark's: how late an event may come. Emitted once for each watch that ran out.
    """
    watched = events.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int").alias("bucket"), "job_id", "status", "ts",
        F.unix_micros("ts").alias("micros"), F.col("seq").cast("bigint").alias("seq"))
    return watched.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Sweeper(patience_minutes * 60_000), outputStructType=REQUEUE, outputMode="Append", timeMode="EventTime")
