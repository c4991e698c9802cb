"""Exact top-k by integer inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards of bounded size at random. A task reads the vectors of a shard,
builds its tree, and answers the queries that follow as they stream past. Nodes are visited in
the order of their upper bound, ``q.centre + |q| * radius``; the search ends when the next
bound is below the k-th best score. Every query first goes to a pilot shard of its own, chosen by
hash, so all shards are pilots for their share; the k-th score found there is a floor for all other
shards, so they start pruning at once. Queries are dealt to groups of bounded size, and a
shard's vectors are repeated for each group: no task answers more queries than a group holds.
Only the best k of each shard leave it.

Defined results: vectors that are null or hold null or non-finite components take no part, nor
do rows without an id; vectors of different length are not compared; components beyond a long
are cut to its range, as are scores; equal scores go to the smaller id; repeated rows are
candidates of their own, also for each other (only a query's own row is left out).
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyfolio.llm.common import written

TOP = 5
SHARD_ROWS = 16384
GROUP_ROWS = 8192
LEAF = 64
# Products below this are exact in doubles.
_EXACT = 2.0 ** 52
_LONG = (1 << 63) - 1


class BallTree:
    """Vectors of one length, split at the median along the line between two far points."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        points = vectors.astype(np.float64)
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centres, radii = [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            node = len(self.spans)
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = node
                self.children[parent] = tuple(pair)
            part = points[order[start:end]]
            centre = part.mean(axis=0)
            away = np.sqrt(((part - centre) ** 2).sum(axis=1))
            self.spans.append((start, end))
            centres.append(centre)
            radii.append(away.max())
            if end - start <= leaf or away.max() == 0:
                self.children.append(None)
                continue
            one = part[away.argmax()]
            two = part[((part - one) ** 2).sum(axis=1).argmax()]
            along = part @ (two - one)
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(along, middle)]
            self.children.append((-1, -1))
            todo += [(start, start + middle, node, 0), (start + middle, end, node, 1)]
        self.rows, self.ids = rows[order], ids[order]
        self.points, self.vectors = points[order], vectors[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.longest = float(np.sqrt((self.points ** 2).sum(axis=1)).max())

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds [query, node], widened by more than the rounding of doubles."""
        size = np.sqrt((queries ** 2).sum(axis=1))[:, None]
        middle = queries @ self.centres.T
        return middle + size * self.radii + 1e-9 * (np.abs(middle) + size * self.radii) + 1e-6

    def search(self, row: int, query: np.ndarray, bound: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """The best k (score, -id) of the tree at or above ``floor``, in no order."""
        exact = math.sqrt(float((query.astype(np.float64) ** 2).sum())) * self.longest < _EXACT
        as_float = query.astype(np.float64)
        best: list[tuple[int, int]] = []
        open_ = [(-bound[0], 0)]
        while open_:
            top, node = heapq.heappop(open_)
            least = best[0][0] if len(best) == k else -math.inf
            if -top < max(least, floor):
                break
            if self.children[node] is None:
                start, end = self.spans[node]
                if exact:
                    scores = self.points[start:end] @ as_float
                else:
                    scores = self.vectors[start:end].astype(object) @ query.astype(object)
                    scores = np.clip(scores, -_LONG, _LONG)
                for i in np.flatnonzero(scores >= max(least, floor)):
                    if self.rows[start + i] != row:
                        found = (int(scores[i]), -int(self.ids[start + i]))
                        if len(best) < k:
                            heapq.heappush(best, found)
                        elif found > best[0]:
                            heapq.heapreplace(best, found)
            else:
                for child in self.children[node]:
                    heapq.heappush(open_, (-bound[child], child))
        return best


def _search_shards(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trees = None, {}
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            keys = np.stack([columns[c].to_numpy(zero_copy_only=False) for c in ("shard", "part", "kind")], axis=1)
            rows, ids = (columns[c].to_numpy(zero_copy_only=False) for c in ("row", "id"))
            floors = columns["floor"].fill_null(-_LONG - 1).to_numpy(zero_copy_only=False)
            lists = columns["v"]
            size = np.diff(lists.offsets.to_numpy())
            flat, offset = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (size[1:] != size[:-1])) + 1
            out: list[tuple[int, int, int, int]] = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
                if a == b:
                    continue
                if tuple(keys[a, :2]) != shard:
                    shard, trees, held = tuple(keys[a, :2]), {}, {}
                d = int(size[a])
                vectors = flat[offset[a]:offset[b]].reshape(b - a, d)
                if keys[a, 2] == 0:
                    held.setdefault(d, []).append((rows[a:b], ids[a:b], vectors))
                    continue
                if held:
                    trees = {n: BallTree(*map(np.concatenate, zip(*parts))) for n, parts in held.items()}
                    held = {}
                tree = trees.get(d)
                if tree is None:
                    continue
                bound = tree.bounds(vectors.astype(np.float64))
                for i in range(b - a):
                    for score, other in tree.search(int(rows[a + i]), vectors[i], bound[i], k, int(floors[a + i])):
                        out.append((int(rows[a + i]), int(ids[a + i]), -other, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 ["row", "query_id", "vec_id", "score"])
    return run


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(row, id, v): usable vectors as integers, floor(256 * x) of each component."""
    x = F.col(embedding)
    usable = F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    low, high = F.lit(-9.2e18), F.lit(9.2e18)
    whole = F.transform(x, lambda c: F.floor(F.greatest(low, F.least(high, c.cast("double") * 256))).cast("bigint"))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("id"), whole.alias("v"))


def nearest(table: DataFrame, is_query: Column, k: int = TOP, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``table`` (row, id, v) that are queries.

    ``table`` is stored data: its row numbers must not change between reads. Each query goes to
    every shard, and k rows come back from each.
    """
    queries = table.filter(is_query)
    shards = max(1, -(-table.count() // shard_rows))
    parts = max(1, -(-queries.count() // group_rows))
    none = F.lit(None).cast("bigint")
    parted = queries.select("row", "id", "v", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int").alias("part"),
                            F.pmod(F.xxhash64("row", F.lit(2)), F.lit(shards)).cast("int").alias("pilot"))
    vectors = table.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "id", "v")
    vectors = vectors.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"),
                             "row", "id", "v", none.alias("floor"))

    def ask(shard: Column, asked: DataFrame, floor: Column) -> DataFrame:
        rows = vectors.unionByName(asked.select(shard.alias("shard"), "part", F.lit(1).alias("kind"), "row", "id", "v", floor.alias("floor")))
        rows = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", F.size("v"), "row")
        return rows.mapInArrow(_search_shards(k), "row bigint, query_id bigint, vec_id bigint, score bigint")

    pilot = written(ask(F.col("pilot"), parted, none), "top-pilot")
    found = pilot
    if shards > 1:
        floors = (pilot.groupBy(F.col("row").alias("of")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
                  .filter(F.col("n") == k).select("of", "least"))
        known = parted.join(floors, parted["row"] == floors["of"], "left")
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("pilot"))
        found = pilot.union(ask(F.explode(others), known, F.col("least")))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    table = written(prepared(vectors), "top-vectors")
    return nearest(table, F.col("id") % 50 == 0)


QUERIES = {"op8_ball_tree": op8_ball_tree}
ORACLE = {"op8_ball_tree": """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5"""}
