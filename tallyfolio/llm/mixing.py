"""Mix sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id. The j-th copy of a document
finishes at the virtual time (words of the source up to and with it) / (target of the
source), less the time of half its own words: it counts as served when its middle word is, so
that a long document at the end goes to the nearer side of the target. Copies of all sources
are sorted by that time and taken until the total budget is used up. At time 1 every source
has spent its target, so each ends within half a document or so of it. A document is taken
three times at most.

Running totals never stand in one task: rows are range-partitioned once into a table, each
block is summed on its own, and the sums before a block (one row per block) are added.

Defined results: a null text has no words and is never taken (``taken`` 0); a null source is
a group, ranked last; repeated rows are rows of their own; an empty table gives an empty table.
Text comparison is by code point; the shuffle depends on ``doc_id`` alone, so reruns agree.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyfolio.llm.common import documents, fresh, with_row, word_count, written

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


def running(df: DataFrame, name: str, order: list[Column], sums: dict[str, Column],
            within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with running totals of ``sums`` in ``order``, restarted per ``within``.

    ``within`` columns hold no nulls. Rows equal in ``order`` may stand in several blocks.
    """
    values = {f"v_{k}": v.cast("bigint") for k, v in sums.items()}
    tie = fresh(df, "tie")
    order = [*order, F.col(tie)]
    ranged = written(df.withColumns(values | {tie: F.monotonically_increasing_id()}).repartitionByRange(*within, *order)
                     .withColumn("block", F.spark_partition_id()), name)
    before = Window.partitionBy(*within).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*within, "block").agg(*[F.sum(v).alias(v) for v in values])
               .select(*within, "block",
                       *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias("b" + v) for v in values]))
    here = (Window.partitionBy(*within, "block").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(offsets, [*within, "block"]).select(
        *df.columns, *[(F.col("bv_" + k) + F.sum("v_" + k).over(here)).alias(k) for k in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """One row per source: its rank, words and target.

    Sources ordered by (cap / weight) reach their cap in that order; the first one that the
    common level does not fill ends the search, and one row with the level goes to the driver.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(total, "mix-rank", [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    rank = (F.col("rank") - 1) % len(weights)
    weight = F.lit(weights[0])
    for i, w in enumerate(weights[1:], 1):
        weight = F.when(rank == i, w).otherwise(weight)
    ranked = ranked.withColumns({"weight": weight.cast("bigint"), "cap": F.col("source_size") * most})
    ranked = ranked.withColumn("fill", F.col("cap") / F.col("weight"))
    level = written(running(ranked, "mix-fill", [F.col("fill"), F.col("rank")],
                            {"caps": F.col("cap"), "shares": F.col("weight")}), "mix-levels")
    whole = level.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("shares")).first()
    words, shares = whole["words"] or 0, whole["shares"] or 1
    # Level if every source before this one stands at its cap.
    height = ((F.lit(words) - (F.col("caps") - F.col("cap")))
              / (F.lit(shares) - (F.col("shares") - F.col("weight"))))
    open_ = level.filter(height * F.col("weight") <= F.col("cap")).agg(
        F.min_by(height, F.struct("fill", "rank")).alias("height")).first()
    height = open_["height"] or 0.0
    return written(level.select(
        "source", "rank", "source_size",
        F.least(F.lit(height) * F.col("weight"), F.col("cap").cast("double")).alias("target")), "mix-targets")


def _finish(copy: Column) -> Column:
    return (2 * (copy * F.col("source_size") + F.col("spent")) - F.col("size")) / (2 * F.col("target"))


def _turn(finish: Column, rank: Column, copy: Column, place: Column) -> Column:
    """Where a copy stands in the line; no two copies share it."""
    return F.struct(finish.cast("double").alias("finish"), rank.cast("bigint").alias("rank"),
                    copy.cast("bigint").alias("copy"), place.cast("bigint").alias("place"))


def schedule(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (doc_id, source, size and others) with source_size, target and ``copies`` taken.

    The others go along; they may not bear a name that the schedule adds.
    """
    added = {"rank", "source_size", "target", "ticket", "spent", "place", "block", "copies"}
    if clash := added & {c.lower() for c in sizes.columns}:
        raise ValueError(f"the schedule adds columns of these names: {sorted(clash)}")
    goal = targets(sizes, weights, most).withColumnRenamed("source", "of_source")
    known = sizes.join(goal, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    known = known.withColumn("ticket", F.md5(F.col("doc_id").cast("string")))
    queue = written(running(known, "mix-queue", [F.col("ticket"), F.col("doc_id"), F.col("size")],
                            {"spent": F.col("size"), "place": F.lit(1)}, ("rank",)), "mix-order")
    offers = queue.filter((F.col("size") > 0) & (F.col("target") > 0)).select(
        "rank", "place", "size", "source_size", "spent", "target",
        F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy"))
    offers = offers.select(_finish(F.col("copy")).alias("finish"), "rank", "copy", "place", "size")
    served = running(offers, "mix-line", [F.col(c) for c in ("finish", "rank", "copy", "place")],
                     {"used": F.col("size")})
    budget = queue.agg(F.sum("size").alias("n")).first()["n"] or 0
    last = served.filter(F.col("used") <= budget).agg(
        F.max(_turn(F.col("finish"), F.col("rank"), F.col("copy"), F.col("place"))).alias("cut")).first()["cut"]
    if last is None:
        return queue.withColumn("copies", F.lit(0))
    cut = _turn(*[F.lit(x) for x in last])
    taken = F.lit(0)
    for copy in range(most):
        turn = _turn(_finish(F.lit(copy)), F.col("rank"), F.lit(copy), F.col("place"))
        taken = taken + F.when(turn <= cut, 1).otherwise(0)
    live = (F.col("size") > 0) & (F.col("target") > 0)
    return queue.withColumn("copies", F.when(live, taken).otherwise(0))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
          weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, stored: bool = False) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns as they were.

    ``stored`` says that ``docs`` is Parquet files as they are read; otherwise the rows are written once.
    """
    row = fresh(docs, "mix_row")
    table = with_row(docs, row, "mix-docs", stored)
    narrow = written(table.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                  word_count(F.col(text)).alias("size")), "mix-sizes")
    picks = written(schedule(narrow, weights, most).filter("copies > 0").select(
        F.col("row").alias("pick_row"), F.col("copies").alias("pick_copies")), "mix-picks")
    # The picks grow with the documents: merged at any size, never broadcast.
    both = table.select(F.struct(*docs.columns).alias("doc"), F.col(row).alias("doc_row")).join(
        picks.hint("merge"), F.col("doc_row") == F.col("pick_row"))
    return both.select("doc", F.explode(F.sequence(F.lit(1), F.col("pick_copies")))).select("doc.*")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(documents(spark, sf_dir).select(
        "doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return schedule(sizes).select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


QUERIES = {"op6_source_mix": op6_source_mix}

_WEIGHT = "CASE (rank - 1) % 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 5 END"
ORACLE = {"op6_source_mix": rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM total),
capped AS (SELECT *, {_WEIGHT} AS weight, 3 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS fill,
         (sum(source_size) OVER () - (sum(cap) OVER o - cap))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS height
  FROM capped WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank)),
level AS (SELECT coalesce(arg_min(height, (fill, rank)), 0.0) AS h FROM levels WHERE height * weight <= cap),
goals AS (SELECT source, rank, source_size, least(h * weight, CAST(cap AS DOUBLE)) AS target FROM levels, level),
queue AS (
  SELECT doc_id, size, rank, source_size, target,
         sum(size) OVER q AS spent, row_number() OVER q AS place
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
  WINDOW q AS (PARTITION BY rank ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS UNBOUNDED PRECEDING)),
offers AS (
  SELECT doc_id, rank, place, copy, size, CAST(2 * (copy * source_size + spent) - size AS DOUBLE) / (2 * target) AS finish
  FROM queue, (VALUES (0), (1), (2)) c(copy) WHERE size > 0 AND target > 0),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, copy, place ROWS UNBOUNDED PRECEDING) AS used FROM offers),
taken AS (
  SELECT rank, place, count(*) AS copies FROM served
  WHERE used <= (SELECT sum(size) FROM sizes) GROUP BY rank, place)
SELECT doc_id, size, source_size, target, CAST(coalesce(copies, 0) * size AS BIGINT) AS taken
FROM queue LEFT JOIN taken USING (rank, place)"""}
