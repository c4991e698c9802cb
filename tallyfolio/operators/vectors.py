"""Near vectors by cosine: all rows in blocks, or an index of cells.

A query set (rows of a DataFrame, growing with the table) is held against all rows in blocks: a task
holds a bounded group of queries, the rows of a block stream past, and only the best k per query
leave the task.

The index keeps every row in the cell of its nearest centre. Centres are fitted by k-means on a
bounded sample (``SAMPLE`` rows), so their number is bounded too; cells are folders of a Parquet table, and new batches are
appended to them, a repeated batch replacing itself. A query probes the cells whose centres are
nearest; with ``exact`` it then also reads every cell that could hold something better, judged by
the cell's angle: cos(angle to the centre - widest angle of the cell) bounds what is inside.

Rows with a null, empty, zero or non-finite vector take no part; vectors of different length are
not compared (the index holds one length: that of its centres). Ties go to the smaller id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyfolio.operators.staging import written

SAMPLE = 20_000
# Fewest rows of the sample for each centre; more centres would be placed by chance, and they pass the driver.
ROWS_PER_CENTRE = 20
BLOCK_ROWS = 32_768
GROUP_ROWS = 4_096
# Products of a batch may differ in their last bits from sums taken alone; what is closer is compared anew.
_CLOSE = 1e-9


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & whole & F.exists(vector, lambda c: c != 0), F.lit(False))


def unit(vector: Column) -> Column:
    """The vector at length one, in doubles."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / length)


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(keys[0])])) if len(keys[0]) else []


def _scan(k: int):
    """Best k rows per query, over rows sorted by task key, the queries before the rows."""
    names = ["query", "row", "id", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asked, best, least = None, [], {}, None

        def kept() -> Iterator[pa.RecordBatch]:
            rows = [(q, r, i, -s) for q, of in best.items() for s, i, r in of]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names)

        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "cell", "part", "group", "kind")]
            rows, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id"))
            for a, b in _runs(*keys):
                key = tuple(x[a] for x in keys[:4])
                if key != here:
                    yield from kept()
                    here, asked, best, least = key, [], {}, None
                v = _matrix(batch.column("v").slice(a, b - a))
                if keys[4][a] == 0:
                    asked.append((rows[a:b], v, batch.column("floor").to_numpy(zero_copy_only=False)[a:b]))
                    continue
                if not asked:
                    continue
                if least is None:
                    names_, queries, least = (np.concatenate(x) for x in zip(*asked))
                    least = np.where(np.isnan(least), -2.0, least)
                near = queries @ v.T >= least[:, None] - _CLOSE
                for q in np.flatnonzero(near.any(axis=1)).tolist():
                    at = np.flatnonzero(near[q])
                    exact = (v[at] * queries[q]).sum(axis=1)
                    found = [(-s, i, r) for s, i, r in zip(exact.tolist(), ids[a:b][at].tolist(), rows[a:b][at].tolist())]
                    of = best[int(names_[q])] = sorted(best.get(int(names_[q]), []) + found)[:k]
                    if len(of) == k:
                        least[q] = max(least[q], -of[-1][0])
        yield from kept()
    return run


def scanned(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, row, id, similarity): best k per query and task, to be ranked by ``ranked``.

    ``rows`` (size, cell, part, row, id, v) and ``queries`` (size, cell, part, group, query, v, floor) meet by
    size, cell and part; a cell's rows are repeated for each group of queries that asks for them.
    """
    keys = ["size", "cell", "part", "group"]
    groups = queries.select(*keys).distinct()
    asked = queries.select(*keys, F.lit(0).alias("kind"), F.col("query").alias("row"), F.lit(None).cast("bigint").alias("id"), "v", "floor")
    there = rows.join(groups, ["size", "cell", "part"]).select(*keys, F.lit(1).alias("kind"), "row", "id", "v",
                                                               F.lit(None).cast("double").alias("floor"))
    return asked.unionByName(there).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(
        _scan(k), "query bigint, row bigint, id bigint, similarity double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id", "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _stored(vectors: DataFrame, vec_id: str, embedding: str, name: str, keep: list[str] | None = None) -> DataFrame:
    return written(vectors.filter(usable(F.col(embedding)) & F.col(vec_id).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("id"), F.size(embedding).alias("size"),
        unit(F.col(embedding)).alias("v"), *([F.struct(*keep).alias("kept")] if keep else [])), name)


def _groups(n: int, rows: int, of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(max(1, -(-n // rows))))


def nearest_to(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
               query_id: str = "query_id", block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS,
               keep: list[str] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, similarity): for each query row its ``k`` rows of highest cosine.

    ``queries`` holds ``query_id`` and ``embedding``; ``keep`` names columns of the rows to show beside. Rows and queries are dealt to blocks and groups
    of bounded size by hash; nothing passes the driver but two counts.
    """
    table = _stored(vectors, vec_id, embedding, "near-rows", keep)
    asked = _stored(queries, query_id, embedding, "near-queries")
    blocks = max(1, -(-table.count() // block_rows))
    rows = table.select("size", "row", "id", "v", _groups(blocks * block_rows, block_rows, "row").alias("cell"), F.lit(0).cast("bigint").alias("part"))
    grouped = asked.withColumn("group", _groups(asked.count(), group_rows, "row")).select(
        "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("cell"), F.lit(0).cast("bigint").alias("part"), "group",
        F.col("row").alias("query"), "v", F.lit(None).cast("double").alias("floor"))
    found = ranked(scanned(rows, grouped, k), k)
    if not keep:
        return _told(found, asked)
    named = found.join(asked.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query")
    return named.join(table.select("row", "kept"), "row").select(
        "query_id", F.col("id").alias(vec_id), "kept.*", "similarity", "rank")


def _told(found: DataFrame, asked: DataFrame) -> DataFrame:
    names = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return found.join(names, "query").select("query_id", "rank", F.col("id").alias("vec_id"), "similarity")


# ------------------------------------------------------------------ index of cells

class VectorIndex:
    """Cells of a folder around fixed centres."""

    def __init__(self, spark: SparkSession, folder: str, centres: np.ndarray):
        self.spark, self.folder = spark, folder
        self.centres = centres / np.sqrt((centres ** 2).sum(axis=1, keepdims=True))

    @classmethod
    def fit(cls, vectors: DataFrame, folder: str, cells: int, vec_id: str = "vec_id", embedding: str = "embedding",
            sample: int = SAMPLE, seed: int = 42) -> VectorIndex:
        """Centres by k-means on at most ``sample`` rows, those with the smallest id hashes.

        The sample bounds how many: ``cells`` of them, one for ``ROWS_PER_CENTRE`` of its rows at most. Beyond that
        cells grow with the table, and a search reads them in parts.
        """
        cells = min(cells, max(1, sample // ROWS_PER_CENTRE))
        good = vectors.filter(usable(F.col(embedding)) & F.col(vec_id).isNotNull())
        rows = good.select(unit(F.col(embedding)).alias("v"), F.xxhash64(vec_id).alias("h"), vec_id).orderBy("h", vec_id).limit(sample)
        model = KMeans(k=cells, seed=seed, maxIter=20, featuresCol="f", distanceMeasure="cosine").fit(
            rows.select(array_to_vector("v").alias("f")))
        return cls(vectors.sparkSession, folder, np.array(model.clusterCenters()))

    def append(self, vectors: DataFrame, batch: int, vec_id: str = "vec_id", embedding: str = "embedding") -> None:
        """Every row of a batch into its cell; a batch that is repeated replaces itself.

        Rows are range-partitioned by cell and id, so that a cell with most of the rows is
        written by many tasks and a small one into one file.
        """
        centres = self.centres

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = _matrix(b.column("v")) @ centres.T if b.num_rows else np.empty((0, len(centres)))
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(angle, pa.float64()), pa.array(cell, pa.int32())],
                                                 ["id", "v", "angle", "cell"])

        rows = vectors.filter(usable(F.col(embedding)) & F.col(vec_id).isNotNull() & (F.size(embedding) == centres.shape[1]))
        placed = rows.select(F.col(vec_id).cast("bigint").alias("id"), unit(F.col(embedding)).alias("v")).mapInArrow(
            place, "id bigint, v array<double>, angle double, cell int")
        (placed.withColumn("batch", F.lit(batch)).repartitionByRange("cell", "id").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("cell", "batch").parquet(self.folder))

    def rows(self) -> DataFrame:
        return self.spark.read.schema("id bigint, v array<double>, angle double, cell int, batch int").parquet(self.folder)

    def cells(self) -> DataFrame:
        """(cell, n, angle) of the cells in use, at most as many as centres."""
        return self.rows().groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle"))

    def search(self, queries: DataFrame, k: int = 5, probes: int = 8, exact: bool = False, query_id: str = "query_id",
               embedding: str = "embedding", block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
        """(query_id, rank, vec_id, similarity) from the ``probes`` nearest cells, or exactly."""
        asked = _stored(queries.filter(F.size(embedding) == self.centres.shape[1]), query_id, embedding, "near-queries")
        cells = {r["cell"]: (r["n"], r["angle"]) for r in self.cells().collect()}
        used = np.array(sorted(cells), np.int64)
        if not len(used):
            return _told(ranked(self.spark.createDataFrame([], "query bigint, row bigint, id bigint, similarity double"), k), asked)
        centres, widest = self.centres[used], np.array([cells[c][1] for c in used])
        grouped = asked.withColumn("group", _groups(asked.count(), group_rows, "row"))

        def choose(floors: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if not b.num_rows:
                        continue
                    near = np.clip(_matrix(b.column("v")) @ centres.T, -1, 1)
                    order = np.argsort(-near, axis=1, kind="stable")
                    first = np.zeros(near.shape, bool)
                    np.put_along_axis(first, order[:, :probes], True, axis=1)
                    if floors:
                        floor = b.column("floor").to_numpy(zero_copy_only=False)
                        bound = np.cos(np.maximum(0, np.arccos(near) - widest - 1e-7))
                        first = ~first & ~(bound + _CLOSE < floor[:, None])
                    i, j = np.nonzero(first)
                    yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(i)), pa.array(used[j], pa.int64())], ["query", "cell"])
            return run

        # Large cells are read in parts of bounded size.
        parts = self.spark.createDataFrame([(int(c), max(1, -(-cells[c][0] // block_rows))) for c in used], "cell bigint, parts bigint")
        there = self.rows().select(F.col("cell").cast("bigint").alias("cell"), "id", "v").join(F.broadcast(parts), "cell")
        there = there.select(F.lit(self.centres.shape[1]).alias("size"), "cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"),
                             F.col("id").alias("row"), "id", "v")

        def read(given: DataFrame, floors: bool) -> DataFrame:
            wants = given.select("query", "v", "floor").mapInArrow(choose(floors), "query bigint, cell bigint")
            wants = (wants.join(given, "query").join(F.broadcast(parts), "cell")
                     .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))))
            wants = written(wants.select("size", "cell", "part", "group", "query", "v", "floor"), "near-asked")
            return scanned(there, wants, k)

        given = grouped.select(F.col("row").alias("query"), "size", "group", "v", F.lit(None).cast("double").alias("floor"))
        found = read(given, False)
        if exact:
            found = written(found, "near-probed")
            floors = (ranked(found, k).groupBy("query").agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
                      .filter(F.col("n") == k).select("query", "least"))
            raised = given.drop("floor").join(floors, "query", "left").withColumnRenamed("least", "floor")
            found = found.unionByName(read(written(raised, "near-raised"), True))
        return _told(ranked(found, k), asked)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, n, hits): how many of a query's exact neighbours were found."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct()
    return exact.join(hit, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
