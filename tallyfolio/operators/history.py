"""A claim's past: validity intervals of its columns, and its state at any asked moments.

Both read the log of changes once, range-sorted by key and time. A key's last values are carried
from one part of the sorted table to the next by a row per key and part, so a claim with most of
the changes, or most of the questions, is spread over tasks.

Changes carry each column as ``STRUCT<v>``: null means not written, a null inside means cleared.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyfolio.operators.staging import written

ORDER = ("ts", "seq")


def _parted(df: DataFrame, key: str, order: tuple[str, ...], name: str) -> DataFrame:
    return written(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), name)


def validity(changes: DataFrame, column: str, key: str = "job_id", order: tuple[str, ...] = ORDER) -> DataFrame:
    """(key, value, valid_from, valid_to): what a column held and when; the last interval is open.

    Writing the value again does not end an interval; of several writes at one time the last holds.
    """
    time, rest = order[0], order[1:]
    writes = changes.filter(F.col(column).isNotNull()).groupBy(key, time).agg(
        F.max_by(F.struct(F.col(f"{column}.v").alias("v")), F.struct(*rest) if rest else F.lit(0)).alias("w"))
    parts = _parted(writes, key, (time,), "history-writes")
    own = Window.partitionBy(key, "_part").orderBy(time)
    before = Window.partitionBy(key).orderBy("_part")
    ends = parts.groupBy(key, "_part").agg(F.max_by("w", time).alias("_last"))
    carried = ends.select(key, "_part", F.lag("_last").over(before).alias("_carried"))
    seen = parts.withColumn("_inner", F.lag("w").over(own)).join(carried, [key, "_part"])
    seen = seen.withColumn("_previous", F.coalesce("_inner", "_carried"))
    changed = F.col("_previous").isNull() | ~F.col("_previous.v").eqNullSafe(F.col("w.v"))
    # What is left begins an interval; the next beginning ends it.
    begins = _parted(seen.filter(changed).select(key, time, "w"), key, (time,), "history-begins")
    after = begins.groupBy(key, "_part").agg(F.min(time).alias("_first"))
    following = after.select(key, "_part", F.lead("_first").over(before).alias("_next"))
    return (begins.withColumn("_inner", F.lead(time).over(own)).join(following, [key, "_part"])
            .select(key, F.col("w.v").alias("value"), F.col(time).alias("valid_from"), F.coalesce("_inner", "_next").alias("valid_to")))


def as_of(changes: DataFrame, questions: DataFrame, columns: list[str], key: str = "job_id", moment: str = "moment",
          order: tuple[str, ...] = ORDER) -> DataFrame:
    """``questions`` (key, moment and others) with each column as it stood then, all moments in one pass.

    A change at the very moment counts. Columns not yet written, and keys without changes, give null.
    """
    asked = [c for c in questions.columns if c != key]
    kinds = dict(questions.dtypes)
    ask = F.struct(*[F.col(c) for c in asked])
    lines = changes.select(key, F.col(order[0]).alias("_at"), F.lit(0).alias("_kind"), F.struct(*order[1:]).alias("_seq") if order[1:] else F.lit(0).alias("_seq"),
                           *columns, F.lit(None).cast(f"struct<{', '.join(f'`{c}`: {kinds[c]}' for c in asked)}>").alias("_ask"))
    nothing = [F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in columns]
    seq = F.lit(None).cast(lines.schema["_seq"].dataType).alias("_seq")
    marks = questions.select(key, F.col(moment).alias("_at"), F.lit(1).alias("_kind"), seq, *nothing, ask.alias("_ask"))
    order_ = ("_at", "_kind", "_seq")
    parts = _parted(lines.unionByName(marks).withColumn("_tie", F.monotonically_increasing_id()), key, (*order_, "_tie"), "history-lines")
    own = Window.partitionBy(key, "_part").orderBy(*order_, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    here = parts.select("*", *[F.last(c, ignorenulls=True).over(own).alias(f"_now_{c}") for c in columns])
    written_at = F.struct(*order_, "_tie")
    ends = parts.groupBy(key, "_part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), written_at)).alias(f"_end_{c}") for c in columns])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_part", *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_old_{c}") for c in columns])
    both = here.filter("_kind = 1").join(carried, [key, "_part"])
    return both.select(key, "_ask.*", *[F.coalesce(f"_now_{c}", f"_old_{c}")["v"].alias(c) for c in columns])
