"""Hard negatives by zone maps over blocks in Hilbert order.

Vectors are sorted by label and by their place on a Hilbert curve through all dimensions, and cut
into blocks. A block is one row of a Parquet table: its vectors, and as narrow columns its zone map,
the least and greatest value of every dimension. What an anchor looks for are windows of
scores: one for its positives (same label, at or above a floor), one per positive for its negatives
(other labels, between a share of the positive's score and that score). Interval arithmetic over a
zone map bounds the scores an anchor can have in a block; only blocks whose interval meets
one of the windows are read.

Floors rise before much is read: an anchor's own block gives k rows of its label, and the blocks with
the highest bounds give k negatives of each window. Anchors and zone maps meet in cells of bounded
size, and the same cells share out the reading; each sends the best k per window on.

Defined results: rows with a null label or vector, null or non-finite components, or without an id
take no part; vectors of different length are not compared; components beyond a long are
cut to its range, as are scores; equal scores go to the smaller id; repeated rows are rows of their
own, also as anchors, and each other's candidates; empty tables give empty results; other
columns are not looked at.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyfolio.llm.common import written

POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80
BLOCK = 256
# Anchors (about), and blocks, of one cell.
ANCHORS = 4096
BLOCKS = 64
# Bits of a dimension on the curve.
CURVE_BITS = 4
# Blocks an anchor reads in a cell before its floors are set.
PILOT = 2
_LONG = (1 << 63) - 1
_EXACT = 2.0 ** 52


# ------------------------------------------------------------------ curve, blocks, zone maps

def hilbert(cells: np.ndarray, bits: int = CURVE_BITS) -> list[bytes]:
    """Place on the Hilbert curve of each row of small integers [row, dimension], as sortable bytes.

    The integers are turned into the curve's transposed index (Skilling 2004), whose bits are then
    read across the dimensions from the highest on.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).reshape(bits * n, -1).T.astype(np.uint8)
    return [row.tobytes() for row in np.packbits(planes, axis=1)]


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Beginning and end of every run of equal keys."""
    n = len(keys[0])
    if not n:
        return []
    cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), n]))


def _places(low: float, high: float):
    step = max(high - low, 1.0) / (1 << CURVE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: list = [None] * batch.num_rows
            vectors, size = batch.column("v"), batch.column("size").to_numpy()
            order = np.argsort(size, kind="stable")
            for a, b in _runs(size[order]):
                rows = order[a:b]
                x = _matrix(vectors.take(pa.array(rows))).astype(np.float64)
                cells = np.clip((x - low) / step, 0, (1 << CURVE_BITS) - 1)
                for r, place in zip(rows.tolist(), hilbert(cells)):
                    places[r] = place
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.binary())], [*batch.schema.names, "place"])
    return run


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products [row of a, row of b] as longs, beyond their range cut."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    longest = [float(np.sqrt((v ** 2).sum(axis=1)).max(initial=0)) for v in (x, y)]
    if longest[0] * longest[1] < _EXACT:
        return (x @ y.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), -_LONG - 1, _LONG).astype(np.int64)


def intervals(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product [query, box], widened by more than the rounding of doubles."""
    q, low, high = (x.astype(np.float64) for x in (queries, low, high))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    room = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-6
    return least - room, most + room


_BLOCKS = ("block bigint, cell bigint, size int, label bigint, n bigint, low array<bigint>, high array<bigint>, "
           "rows array<bigint>, ids array<bigint>, v array<bigint>, asking array<struct<row:bigint,floor:bigint>>")


def _blocks(rows_of_block: int, k: int):
    """Blocks of rows sorted by vector size, label and place; with each block's own anchors' floors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        made, held, key = 0, [], None

        def block(size: int, label: int, parts: list) -> pa.RecordBatch:
            rows, ids, asks = (np.concatenate([p[i] for p in parts]) for i in range(3))
            v = np.concatenate([p[3] for p in parts])
            at = np.flatnonzero(asks)
            own = exact_scores(v[at], v)
            floors = []
            for i, scores in zip(at.tolist(), own):
                others = np.delete(scores, i)
                floors.append({"row": int(rows[i]), "floor": int(np.sort(others)[-k]) if len(others) >= k else -_LONG - 1})
            name = first + made
            values = [[name], [name // BLOCKS], [size], [label], [len(rows)], [v.min(axis=0)], [v.max(axis=0)], [rows], [ids],
                      [v.ravel()], [floors]]
            longs = pa.list_(pa.int64())
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[longs] * 5,
                     pa.list_(pa.struct([("row", pa.int64()), ("floor", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, types)],
                                              [c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            size, label = (batch.column(c).to_numpy() for c in ("size", "label"))
            rows, ids, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id", "asks"))
            vectors = batch.column("v")
            for a, b in _runs(size, label):
                if key != (size[a], label[a]):
                    if held:
                        yield block(*key, held)
                        made += 1
                    key, held = (int(size[a]), int(label[a])), []
                v = _matrix(vectors.slice(a, b - a))
                while a < b:
                    take = min(b - a, rows_of_block - sum(len(p[0]) for p in held))
                    held.append((rows[a:a + take], ids[a:a + take], asks[a:a + take], v[:take]))
                    a, v = a + take, v[take:]
                    if sum(len(p[0]) for p in held) == rows_of_block:
                        yield block(*key, held)
                        made, held = made + 1, []
        if held:
            yield block(*key, held)
    return run


def prepared(vectors: DataFrame, label: Column, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(row, id, label, asks, size, v): usable vectors as integers, floor(256 * x) of each component, as a table."""
    x = F.col(embedding)
    usable = F.col(vec_id).isNotNull() & label.isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    low, high = F.lit(-9.2e18), F.lit(9.2e18)
    whole = F.transform(x, lambda c: F.floor(F.greatest(low, F.least(high, c.cast("double") * 256))).cast("bigint"))
    return written(vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
        is_anchor.alias("asks"), F.size(x).alias("size"), whole.alias("v")), "hard-vectors")


def blocks(table: DataFrame, rows_of_block: int = BLOCK, k: int = POSITIVES) -> DataFrame:
    """The vectors of ``table`` as blocks in Hilbert order with zone maps, as a table."""
    ends = table.select(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    low, high = float(ends["low"] or 0), float(ends["high"] or 0)
    placed = table.mapInArrow(_places(low, high), "row bigint, id bigint, label bigint, asks boolean, size int, v array<bigint>, place binary")
    order = ["size", "label", "place", "row"]
    return written(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
                   .mapInArrow(_blocks(rows_of_block, k), _BLOCKS), "hard-blocks")


# ------------------------------------------------------------------ choosing and reading blocks

class Asking:
    """The anchors of a cell: row numbers, labels, vectors, and windows padded with empty ones."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.whole: tuple | None = None

    def add(self, batch: pa.RecordBatch, a: int, b: int, vector: str) -> None:
        lows, highs = ([x or [] for x in batch.column(c).slice(a, b - a).to_pylist()] for c in ("lows", "highs"))
        rows, labels = (batch.column(c).to_numpy(zero_copy_only=False)[a:b] for c in ("row", "label"))
        self.parts.append((rows, labels, _matrix(batch.column(vector).slice(a, b - a)), lows, highs))
        self.whole = None

    def get(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if self.whole is None:
            rows, labels, vectors = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
            n = max(len(w) for p in self.parts for w in p[3])
            lows = np.array([w + [_LONG] * (n - len(w)) for p in self.parts for w in p[3]], np.int64).reshape(len(rows), n)
            highs = np.array([w + [-_LONG - 1] * (n - len(w)) for p in self.parts for w in p[4]], np.int64).reshape(len(rows), n)
            self.whole = rows, labels, vectors, lows, highs
        return self.whole


def _choose(same: bool, most: int | None):
    """(row, block) pairs to read, over rows sorted by cell, anchors before zone maps.

    ``most`` keeps the blocks of a cell with the highest bounds only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asking, best = None, Asking(), {}

        def kept() -> Iterator[pa.RecordBatch]:
            if best:
                pairs = [(r, b) for r, of in best.items() for _, b in of]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["row", "block"])

        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "group", "cell", "kind")]
            for a, b in _runs(*keys):
                here = tuple(k[a] for k in keys[:3])
                if here != cell:
                    yield from kept()
                    cell, asking, best = here, Asking(), {}
                if keys[3][a] == 0:
                    asking.add(batch, a, b, "low")
                    continue
                if not asking.parts:
                    continue
                rows, labels, vectors, lows, highs = asking.get()
                names, of = (batch.column(c).to_numpy(zero_copy_only=False)[a:b] for c in ("row", "label"))
                least, top = intervals(vectors, *(_matrix(batch.column(c).slice(a, b - a)) for c in ("low", "high")))
                ok = np.zeros(top.shape, bool)
                for w in range(lows.shape[1]):
                    ok |= (top >= lows[:, w, None]) & (least <= highs[:, w, None])
                ok &= (labels[:, None] == of[None, :]) == same
                if most is not None:
                    order = np.argsort(np.where(ok, -top, np.inf), axis=1, kind="stable")[:, :most]
                    for i in np.flatnonzero(ok.any(axis=1)).tolist():
                        found = [(-top[i, j], int(names[j])) for j in order[i] if ok[i, j]]
                        best[int(rows[i])] = sorted(best.get(int(rows[i]), []) + found)[:most]
                    continue
                i, j = np.nonzero(ok)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[i], pa.int64()), pa.array(names[j], pa.int64())], ["row", "block"])
        yield from kept()
    return run


def chosen(anchors: DataFrame, index: DataFrame, same: bool, most: int | None = None) -> DataFrame:
    """(row, block): blocks of the anchors' own label, or of others, that can hold rows of their windows.

    Every anchor is held against every zone map, a query set against all blocks, in cells of
    ``ANCHORS`` anchors and ``BLOCKS`` zone maps; vectors are not read.
    """
    groups = anchors.select("size", "group").distinct()
    cells = index.select("size", "cell").distinct()
    none = F.lit(None).cast("array<bigint>")
    asked = anchors.join(cells, "size").select("size", "group", "cell", F.lit(0).alias("kind"), "row", "label", F.col("v").alias("low"),
                                               none.alias("high"), "lows", "highs")
    zones = index.select("size", "cell", "block", "label", "low", "high").join(groups, "size").select(
        "size", "group", "cell", F.lit(1).alias("kind"), F.col("block").alias("row"), "label", "low", "high", none.alias("lows"),
        none.alias("highs"))
    keys = ["size", "group", "cell"]
    return asked.unionByName(zones).repartition(*keys).sortWithinPartitions(*keys, "kind", "row").mapInArrow(
        _choose(same, most), "row bigint, block bigint")


def _read(k: int):
    """Best k per anchor and window, over rows sorted by cell, anchors before blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asking, wants, best = None, Asking(), {}, {}

        def kept() -> Iterator[pa.RecordBatch]:
            found = [(r, w, -o, p, s) for (r, w), of in best.items() for s, o, p in of]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["row", "window", "id", "other", "score"])

        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "group", "cell", "kind")]
            for a, b in _runs(*keys):
                here = tuple(x[a] for x in keys[:3])
                if here != cell:
                    yield from kept()
                    cell, asking, wants, best = here, Asking(), {}, {}
                if keys[3][a] == 0:
                    seen = sum(len(p[0]) for p in asking.parts)
                    for i, of in enumerate(batch.column("blocks").slice(a, b - a).to_pylist()):
                        for block in of:
                            wants.setdefault(block, []).append(seen + i)
                    asking.add(batch, a, b, "v")
                    continue
                asked, _, vectors, lows, highs = asking.get()
                for i in range(a, b):
                    who = np.array(wants[batch.column("row")[i].as_py()])
                    rows, ids, v = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("rows", "ids", "v"))
                    scores = exact_scores(vectors[who], v.reshape(len(rows), -1))
                    fits = rows[None, :] != asked[who][:, None]
                    for w in range(lows.shape[1]):
                        hit = fits & (scores >= lows[who, w][:, None]) & (scores <= highs[who, w][:, None])
                        for q in np.flatnonzero(hit.any(axis=1)).tolist():
                            at = np.flatnonzero(hit[q])
                            at = at[np.lexsort((rows[at], ids[at], -scores[q, at]))[:k]]
                            found = [(int(s), -int(o), int(r)) for s, o, r in zip(scores[q, at], ids[at], rows[at])]
                            key = int(asked[who[q]]), w
                            best[key] = sorted(best.get(key, []) + found, key=lambda x: (-x[0], -x[1], x[2]))[:k]
        yield from kept()
    return run


def read(pairs: DataFrame, anchors: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(row, window, id, other, score): the best k of each anchor's window in the blocks it reads of each cell."""
    none = F.lit(None).cast("array<bigint>")
    wants = (pairs.groupBy("row", F.floor(F.col("block") / BLOCKS).alias("cell"))
             .agg(F.collect_list("block").alias("blocks")).join(anchors, "row"))
    blocks_ = wants.select("size", "group", F.explode("blocks").alias("block")).distinct().join(
        index.select("block", "cell", "rows", "ids", "v"), "block").select(
        "size", "group", "cell", F.lit(1).alias("kind"), F.col("block").alias("row"), F.lit(None).cast("bigint").alias("label"), "v",
        none.alias("blocks"), none.alias("lows"), none.alias("highs"), "rows", "ids")
    rows = wants.select("size", "group", "cell", F.lit(0).alias("kind"), "row", "label", "v", "blocks", "lows", "highs",
                        none.alias("rows"), none.alias("ids"))
    keys = ["size", "group", "cell"]
    return rows.unionByName(blocks_).repartition(*keys).sortWithinPartitions(*keys, "kind", "row").mapInArrow(
        _read(k), "row bigint, window bigint, id bigint, other bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mined(table: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT,
          rows_of_block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors of ``table``."""
    index = blocks(table, rows_of_block, positives)
    asking = table.filter("asks").drop("asks")
    n_groups = max(1, -(-asking.count() // ANCHORS))
    floors = index.select(F.explode("asking").alias("a")).select("a.*")
    anchors = written(asking.join(floors, "row").select(
        "row", "id", "label", "size", F.pmod(F.xxhash64("row"), F.lit(n_groups)).alias("group"), "v",
        F.array("floor").alias("lows"), F.array(F.lit(_LONG)).alias("highs")), "hard-anchors")
    near = _best(read(chosen(anchors, index, True), anchors, index, positives), positives)
    near = written(near.select("row", (F.col("rank") - 1).cast("bigint").alias("window"), F.col("id").alias("positive_id"),
                               F.col("score").alias("positive_score")), "hard-positives")

    # A window per positive: 100 * score from least_percent * its score (rounded up) to 100 * its score.
    share = F.ceil(F.col("positive_score").cast("decimal(30,0)") * least_percent / F.lit(100)).cast("bigint")
    windows = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "window", share.alias("low"), F.col("positive_score").alias("high")))).alias("w"))
    wanting = written(anchors.drop("lows", "highs").join(windows, "row").select(
        "*", F.col("w.low").alias("lows"), F.col("w.high").alias("highs")).drop("w"), "hard-windows")
    pilot = written(chosen(wanting, index, False, PILOT), "hard-pilot")
    early = written(read(pilot, wanting, index, negatives), "hard-early")
    least = (_best(early, negatives).filter(F.col("rank") == negatives).groupBy("row")
             .agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("least")))
    raised = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.element_at("least", i.cast("bigint")), x)))
    narrowed = written(wanting.join(least, "row", "left").withColumn("lows", F.when(F.col("least").isNull(), F.col("lows"))
                                                                     .otherwise(raised)).drop("least"), "hard-narrowed")
    late = read(chosen(narrowed, index, False).join(pilot, ["row", "block"], "left_anti"), narrowed, index, negatives)
    far = _best(early.unionByName(late), negatives)
    names = anchors.select("row", F.col("id").alias("anchor_id"))
    return far.join(near, ["row", "window"]).join(names, "row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(prepared(given, label, F.col("vec_id") % 100 == 0))


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE = {"op12_hard_negatives": f"""
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r, a.vec_id AS anchor_id, o.vec_id AS other_id, o.label = a.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, o.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable a JOIN usable o ON a.vec_id % 100 = 0 AND a.r <> o.r AND len(a.v) = len(o.v)),
near AS (
  SELECT r, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER w AS place
  FROM scored WHERE same WINDOW w AS (PARTITION BY r ORDER BY score DESC, other_id)),
far AS (
  SELECT n.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER w AS rank
  FROM near n JOIN scored s ON s.r = n.r AND NOT s.same AND n.place <= {POSITIVES}
    AND {LEAST_PERCENT} * positive_score <= 100 * s.score AND s.score <= positive_score
  WINDOW w AS (PARTITION BY n.r, place ORDER BY s.score DESC, s.other_id))
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM far WHERE rank <= {NEGATIVES}"""}
