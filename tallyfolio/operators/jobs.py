"""Job state as a fold over an append-only log, and reads over live and durable copies."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyfolio.operators.staging import summary_join, written
from tallyfolio.schemas import PENDING, RUNNING, TERMINAL

ORDER = ("ts", "seq")


def fold(changes: DataFrame, columns: list[str], key: str = "job_id",
         order: tuple[str, ...] = ORDER) -> DataFrame:
    """Current state per job: the last value written to each column, column by column.

    A change row carries each column as ``STRUCT<v>``: null means not written, a struct with a
    null inside means set to null. ``max_by`` keeps one value per job and task, so the log is
    reduced before it is shuffled. ``updated_at`` is the time of the last change.
    """
    when = F.struct(*order)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), when)).alias(c) for c in columns]
    folded = changes.groupBy(key).agg(F.min(order[0]).alias("created_at"),
                                      F.max(order[0]).alias("updated_at"), *last)
    return folded.select(key, "created_at", "updated_at",
                         *[F.col(f"{c}.v").alias(c) for c in columns])


def state_as_of(changes: DataFrame, columns: list[str], at: Column, key: str = "job_id") -> DataFrame:
    """State at a moment: the fold of what had been written by then."""
    return fold(changes.filter(F.col("ts") <= at), columns, key)


def apply_update(jobs: DataFrame, changes: DataFrame, columns: list[str], now: Column,
                 key: str = "job_id") -> DataFrame:
    """Jobs after one round of partial updates (at most one change row per job).

    Only written columns change, ``updated_at`` moves for every job that has a change row.
    """
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns],
                         F.lit(True).alias("changed"))
    df = jobs.join(new, key, "left")
    for c in columns:
        df = df.withColumn(c, F.when(F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}.v")).otherwise(F.col(c)))
    return (df.withColumn("updated_at", F.when(F.col("changed"), now).otherwise(F.col("updated_at")))
            .select(*jobs.columns))


def latest_rows(rows: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """One row per job where it was written more than once: the latest."""
    rest = [c for c in rows.columns if c != key]
    packed = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return packed.select(key, "row.*")


def overlay_jobs(live: DataFrame, durable: DataFrame, key: str = "job_id") -> DataFrame:
    """The live row where there is one, else the durable row, always as a whole."""
    rest = [c for c in live.columns if c != key]
    left = live.select(key, F.struct(*rest).alias("live"))
    right = durable.select(key, F.struct(*rest).alias("durable"))
    both = left.join(right, key, "full_outer")
    return both.select(key, F.coalesce("live", "durable").alias("row")).select(key, "row.*")


def overlay_events(live: DataFrame, durable: DataFrame, key: str = "job_id") -> DataFrame:
    """A job's live events if it has any, else its durable ones."""
    return live.unionByName(summary_join(durable, live.select(key).distinct(), key, "left_anti"))


def with_known_jobs(events: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """Events of jobs that exist; others are dropped."""
    return summary_join(events, jobs.select(key).distinct(), key, "left_semi")


def oldest_first(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Trails in reading order; the sort ranges over key and time, so a long trail is split."""
    return events.orderBy(key, *ORDER)


def numbered(events: DataFrame, key: str = "job_id", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Add ``position``: the place of an event in its job's trail, from one.

    Events are numbered within their part of a table sorted by job and time; what a job has in
    the parts before, one row per job and part, is added.
    """
    parts = ranged(events, key, order)
    sizes = parts.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    return (parts.withColumn("_inner", inner).join(starts, [key, "_part"])
            .withColumn("position", F.col("_before") + F.col("_inner")).drop("_part", "_inner", "_before"))


def terminal(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(*TERMINAL))


# ------------------------------------------------------------------ previous row, safe under skew

def ranged(df: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """``df`` as a table in parts of like size, sorted across parts by key and time (``_part``).

    Stored, so that the parts stay the same for everything that reads them.
    """
    return written(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranged")


def with_previous(df: DataFrame, value: str, key: str = "job_id", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Add ``previous``: the value on the row before, per key in time order.

    A window over the key alone would hand a hot key to one task. The window runs within the
    parts of a table sorted by key and time; the first row of a part takes the last row of the
    parts before, from a table with one row per part.
    """
    parts = ranged(df, key, order)
    here = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    rows = parts.withColumn("_before", F.lag(here).over(Window.partitionBy("_part").orderBy(key, *order)))
    ends = parts.groupBy("_part").agg(F.max_by(here, F.struct(key, *order)).alias("_last"))
    carried = ends.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_carried"))
    both = rows.join(carried, "_part").withColumn("_before", F.coalesce("_before", "_carried"))
    same = F.coalesce(F.col("_before.k") == F.col(key), F.lit(False))
    return (both.withColumn("previous", F.when(same, F.col("_before.v"))).withColumn("is_first", ~same)
            .drop("_part", "_before", "_carried"))


# The moves a job may make.
LEGAL_MOVES = ((PENDING, RUNNING), *((RUNNING, end) for end in TERMINAL))


def lifecycle_violations(status_log: DataFrame, key: str = "job_id") -> DataFrame:
    """Status changes that are not a legal move; a job has to start as PENDING.

    Writing the same status again is no change.
    """
    df = with_previous(status_log, "status", key)
    legal = reduce(lambda a, b: a | b, [
        (F.col("previous") == before) & (F.col("status") == after) for before, after in LEGAL_MOVES])
    legal = legal | (F.col("previous") == F.col("status"))
    legal = F.when(F.col("is_first"), F.col("status") == PENDING).otherwise(legal)
    return df.filter(~F.coalesce(legal, F.lit(False))).drop("is_first")


def stale_running(jobs: DataFrame, now: Column, limit_minutes: int) -> DataFrame:
    """Jobs that are RUNNING without a change for longer than the limit, to be queued again."""
    idle = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
    return (jobs.filter((F.col("status") == RUNNING) & (idle > 60 * limit_minutes))
            .withColumn("idle_minutes", F.floor(idle / 60)))
