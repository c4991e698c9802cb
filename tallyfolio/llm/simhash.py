"""Near duplicates by SimHash, compared bit-sliced.

A fingerprint has 64 bits over 3-word shingles. Fingerprints that differ in at most two bits
agree on two of their four 16-bit blocks, so each goes into six buckets (one per pair of
blocks) and every link lies within a bucket: the search is exact. Inside a bucket the
fingerprints are stored as bit planes, 64 of them per machine word. One comparison updates 64
distances with carry-save counters (ones, twos, more), and a word is abandoned as soon as all
its lanes have more than two differences.

A bucket beyond ``WHOLE`` members is cut into chunks, and pairs of chunks become tasks of
their own. Every bucket reports a spanning star per group, not its pairs. Groups of all
buckets are joined by the large-star / small-star rounds of Kiveris et al. (2014); each round
is a table in the shared folder. Exact copies share one fingerprint and are one node.

``first_of_each``, the stage of the pipeline, takes five-word shingles. Its candidates are the
groups that the same search finds among their fingerprints; the whole shingle sets are compared
before a document goes. 64 bits within two do not reach down to a similarity of 0.8, so MinHash
bands add candidates to those groups. Groups of many documents that are alike but below 0.8 are
told apart by an exact prefix filter, not pair by pair.

Defined results: a null or blank text has fingerprint zero and links like any other; a null
``doc_id`` takes part but never names a group that has another id; repeated rows are copies of
each other; an empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfolio.llm.common import documents, fresh, with_row, written

SEED = 42
SHINGLE = 3
RADIUS = 2
BITS = 64
BLOCKS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
WHOLE = 4096
CHUNK = 2048
# Comparisons (a fingerprint against a word of 64 others) held in memory at once.
LANES = 1 << 18
# Bit planes between two looks at which words can be abandoned.
STRIDE = 8
# Documents that stay: words of a shingle, least similarity in hundredths.
STAGE_SHINGLE = 5
STAGE_PERCENT = 80
# Pairs of similarity 0.8 share no band with odds of (1 - 0.8 ** 4) ** 24, about 3 in a million.
BANDS, BAND_ROWS = 24, 4
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
_FACTORS, _SHIFTS = _MIX[0] | np.uint64(1), _MIX[1]
STAR_ROUNDS = 6


def hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """Unsigned hashes of the word shingles of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return [digest(data[a:b], SEED) for a, b in zip(starts[:len(words) - size + 1].tolist(),
                                                    (ends[size - 1:] - 1).tolist())]


def fingerprint(found: list[int]) -> int:
    """Bits that more than half of the hashes have set."""
    if not found:
        return 0
    grid = np.array(found, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(grid), 1 << 16):
        counts += np.unpackbits(grid[i:i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(grid), bitorder="little").view("<u8")[0])


def _signed(found: Iterable[int]) -> pa.Array:
    return pa.array(np.array(list(found), np.uint64).view(np.int64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _signed(fingerprint(hashes(t.as_py())) for t in batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, fp): one row per document, the fingerprint as a signed long."""
    kind = docs.select(F.col(doc_id).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(
        _fingerprints, f"id {kind}, fp bigint")


# ------------------------------------------------------------------ bit-sliced comparison

def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes [64, words]: bit l of word w in plane b is bit b of fingerprint 64w + l."""
    n_words = -(-len(fps) // 64)
    grid = np.zeros((n_words * 64, 8), np.uint8)
    grid[:len(fps)] = fps.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.ascontiguousarray(np.unpackbits(grid, axis=1, bitorder="little").T)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def close(fps: np.ndarray, plane: np.ndarray, who: np.ndarray, word: np.ndarray,
          radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Hits (index into ``who``, lane of the planes) where fps[who] is within the radius.

    ``who[i]`` is compared with the 64 lanes of ``word[i]``.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the counters hold a radius of at most two")
    none = np.uint64(0)
    found_i, found_lane = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start in range(0, len(who), LANES):
        live = np.arange(start, min(start + LANES, len(who)))
        q, w = fps[who[live]], word[live]
        ones, twos, over = (np.zeros(len(live), np.uint64) for _ in range(3))

        def differs(b: int) -> np.ndarray:
            return plane[b, w] ^ (none - ((q >> np.uint64(b)) & np.uint64(1)))

        for b in range(0, BITS, 2):
            # A full adder takes two planes: what leaves the twos is kept for good in ``over``.
            first, second = differs(b), differs(b + 1)
            half = ones ^ first
            carry = (ones & first) | (half & second)
            ones = half ^ second
            over |= twos & carry
            twos ^= carry
            if b % STRIDE == STRIDE - 2:
                beyond = over | ((ones & twos) if radius == 2 else twos if radius == 1 else ones | twos)
                keep = beyond != ~none
                n = int(keep.sum())
                if n < 0.7 * len(keep) or b == BITS - 2:
                    live, q, w, ones, twos, over = (x[keep] for x in (live, q, w, ones, twos, over))
                    beyond = beyond[keep]
                if not n:
                    break
        if len(live):
            lanes = np.unpackbits((~beyond).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(lanes)
            found_i.append(live[i])
            found_lane.append(w[i] * 64 + lane)
    return np.concatenate(found_i), np.concatenate(found_lane)


def _pairs_within(fps: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs i < j < ends[i]: each fingerprint against the rest of its own bucket."""
    at = np.arange(len(fps))
    first, last = (at + 1) // 64, (ends - 1) // 64
    count = np.where(ends > at + 1, last - first + 1, 0)
    who = np.repeat(at, count)
    word = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    i, j = close(fps, planes(fps), who, word, radius)
    i = who[i]
    ok = (j > i) & (j < ends[i])
    return i[ok], j[ok]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _stars(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = roots(len(fps), i, j)
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[member], fps[label[member]]


_LINKS = "a bigint, b bigint, key bigint, part int, members array<bigint>"


def _link_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(n, pa.int64()),
         pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], ["a", "b", "key", "part", "members"])


def _chunk_row(key: int, part: int, members: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64()),
         pa.array([part], pa.int32()), pa.array([members.view(np.int64)], pa.list_(pa.int64()))],
        ["a", "b", "key", "part", "members"])


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of a partition sorted by key; larger buckets leave as chunks."""
    keys, fps, part = np.empty(0, np.int64), np.empty(0, np.uint64), 0

    def whole(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        edge = np.flatnonzero(np.diff(keys)) + 1
        size = np.diff(np.concatenate(([0], edge, [len(keys)])))
        shared = np.repeat(size > 1, size)
        if shared.any():
            size, fps = size[size > 1], fps[shared]
            ends = np.repeat(np.cumsum(size), size)
            a, b = _stars(fps, *_pairs_within(fps, ends, RADIUS))
            if len(a):
                yield _link_rows(a, b)

    for batch in batches:
        keys = np.concatenate((keys, batch.column("key").to_numpy(zero_copy_only=False)))
        fps = np.concatenate((fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
        while len(keys):
            run = int(np.searchsorted(keys, keys[0], "right"))
            if run < len(keys) and (part or run > WHOLE):
                for k in range(0, run, CHUNK):
                    yield _chunk_row(int(keys[0]), part, fps[k:min(run, k + CHUNK)])
                    part += 1
                keys, fps, part = keys[run:], fps[run:], 0
                continue
            if run == len(keys):
                # The open bucket: full chunks go once it is known to be large.
                if part or run > WHOLE:
                    while len(keys) > CHUNK:
                        yield _chunk_row(int(keys[0]), part, fps[:CHUNK])
                        keys, fps, part = keys[CHUNK:], fps[CHUNK:], part + 1
                break
            # Everything up to the next large bucket, or to the open one.
            edge = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
            size = np.diff(np.concatenate((edge, [len(keys)])))
            big = np.flatnonzero(size[:-1] > WHOLE)
            stop = edge[big[0]] if len(big) else edge[-1]
            yield from whole(keys[:stop], fps[:stop])
            keys, fps = keys[stop:], fps[stop:]
    if len(keys):
        if part:
            yield _chunk_row(int(keys[0]), part, fps)
        else:
            yield from whole(keys, fps)


def _link_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two chunks of a bucket, or within one; partners follow each other."""
    held = None
    for batch in batches:
        for row in batch.to_pylist():
            name = (row["key"], row["low"], row["high"])
            mine = np.array(row["members"], np.int64).view(np.uint64)
            if row["low"] == row["high"]:
                both, i, j = mine, *_pairs_within(mine, np.full(len(mine), len(mine)), RADIUS)
            elif held and held[0] == name:
                other = held[1]
                plane = planes(other)
                who = np.repeat(np.arange(len(mine)), plane.shape[1])
                word = np.tile(np.arange(plane.shape[1]), len(mine))
                i, j = close(mine, plane, who, word, RADIUS)
                i, ok = who[i] + len(other), j < len(other)
                both, i, j = np.concatenate((other, mine)), i[ok], j[ok]
            else:
                held = (name, mine)
                continue
            a, b = _stars(both, i, j)
            if len(a):
                yield _link_rows(a, b)


def links(prints: DataFrame) -> DataFrame:
    """(a, b) edges that connect all distinct fingerprints ``fp`` within the radius."""
    spark = prints.sparkSession

    def block(k: int):
        return F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("bigint"))

    keys = F.array(*[F.shiftleft(F.lit(n).cast("bigint"), 32) + F.shiftleft(block(i), 16) + block(j)
                     for n, (i, j) in enumerate(BLOCKS)])
    buckets = prints.select("fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key")
    found = written(buckets.mapInArrow(_link_buckets, _LINKS), "simhash-links")
    chunks = found.filter("members IS NOT NULL").select("key", "part", "members")
    parts = chunks.groupBy("key").agg((F.max("part")).alias("last"))
    tasks = (chunks.join(parts, "key")
             .select("key", "part", "members", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
             .select("key", "part", "members", F.least("part", "other").alias("low"),
                     F.greatest("part", "other").alias("high")))
    across = (tasks.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "part")
              .mapInArrow(_link_chunks, _LINKS))
    return found.filter("members IS NULL").select("a", "b").union(across.select("a", "b"))


# ------------------------------------------------------------------ groups

def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges as stars around its smallest nodes."""
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        label = roots(len(nodes), at[:len(a)], at[len(a):])
        member = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[member]), pa.array(nodes[label[member]])], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round: neighbours (larger ones, or smaller ones) go to the smallest neighbour."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(low, "a")
    if large:
        out = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        out = out.select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
    return out.filter("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not itself the smallest of its group."""
    current = written(edges.mapInArrow(_contract, "a bigint, b bigint").distinct(), "simhash-stars")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(current)
    while before[0]:
        current = written(_star(_star(current, True), False), "simhash-stars")
        now = state(current)
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of ``prints`` (id, fp)."""
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-prints")
    groups = connected(links(nodes))
    linked = groups.union(groups.select("root", "root")).distinct()
    names = (linked.join(nodes, linked["node"] == nodes["fp"])
             .groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = linked.join(names, "root").select(F.col("node"), "component_id")
    return written(
        nodes.join(named, nodes["fp"] == named["node"], "left")
        .select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "simhash-groups")


def with_groups(prints: DataFrame) -> DataFrame:
    """The stored table ``prints`` (id, fp, ...) with the ``component_id`` of each row's group.

    Both sides of the join are tables, so Spark can split a fingerprint with many copies.
    """
    return prints.join(grouped(prints.select("id", "fp")), "fp").select(*prints.columns, "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, fp, component_id): one row per document."""
    return with_groups(written(fingerprints(docs, text, doc_id), "simhash-documents"))


# ------------------------------------------------------------------ documents that stay

def shingle_set(text: str | None, size: int = STAGE_SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of one whole text, sorted."""
    return np.unique(np.array(hashes(text, size), np.uint64))


def similar(a: np.ndarray, b: np.ndarray, percent: int = STAGE_PERCENT) -> bool:
    """Whether the Jaccard similarity of two shingle sets is at least ``percent`` hundredths."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def band_keys(found: np.ndarray) -> np.ndarray:
    """One bucket key per band of the smallest values of a set under ``BANDS * BAND_ROWS`` hashes."""
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for i in range(0, len(found), 4096):
        least = np.minimum(least, (found[i:i + 4096, None] * _FACTORS + _SHIFTS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(least.reshape(BANDS, BAND_ROWS))],
                    np.uint64).view(np.int64)


def _bands(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes(t.as_py(), size) for t in batch.column("text")]
            sets = [np.unique(np.array(f, np.uint64)) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), pa.array(map(len, sets), pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
                 _signed(map(fingerprint, found))], ["place", "n", "copy", "keys", "fp"])
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.list_(pa.int64()))], ["row", "shingles"])
    return run


def _verified(size: int, percent: int):
    """The rows (place, other) whose texts are similar; rows of one ``other`` follow each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            good = []
            for mine, text in zip(batch.column("text"), batch.column("other_text")):
                if last is None or text != last:
                    last, other = text, shingle_set(text.as_py(), size)
                good.append(similar(shingle_set(mine.as_py(), size), other, percent))
            yield batch.filter(pa.array(good, pa.bool_())).select(["place", "n", "other", "other_n"])
    return run


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be that similar at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def prefix_pairs(sets: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """(one, two): pairs of ``sets`` (member, n, shingles) that may be similar; no similar pair is left out.

    Shingles are ordered from the rarest on. Two sets of n <= m shingles that share ``need`` of them,
    ``percent / (100 + percent) * (n + m)`` at least, have one in common among the first
    ``n - 2 * percent / (100 + percent) * n + 1`` of the smaller and ``m - percent / 100 * m + 1`` of
    the larger, and beyond the first common one room for the others (the prefix and positional
    filters of similarity joins, Xiao et al. 2008). A passage in many texts is no rare shingle of
    any, so it makes no pairs. Shingles of one set only come first and can be left out.
    """
    flat = sets.select("member", "n", F.explode("shingles").alias("s"))
    counts = written(flat.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1"), "near-counts")
    n = F.col("n")
    common = flat.join(counts, "s").groupBy("member", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("l"))
    alone = n - F.size("l")
    probe = n - F.ceil(percent * n / 100) + 1
    index = n - F.ceil(2 * percent * n / (100 + percent)) + 1
    first = common.select("member", "n", index.alias("index"), alone.alias("alone"),
                          F.posexplode(F.slice("l", F.lit(1), F.greatest(probe - alone, F.lit(0)).cast("int"))).alias("k", "x"))
    first = written(first.select("member", "n", F.col("x.s").alias("s"), (F.col("alone") + F.col("k") + 1).alias("at"), "index"), "near-prefixes")
    one, two = (first.select("s", *[F.col(c).alias(f"{c}{k}") for c in ("member", "n", "at", "index")]) for k in (1, 2))
    need = F.ceil(percent * (F.col("n1") + F.col("n2")) / (100 + percent))
    near = ((F.struct("n1", "member1") < F.struct("n2", "member2")) & (F.col("at1") <= F.col("index1"))
            & _sizes_fit(F.col("n1"), F.col("n2"), percent)
            & (1 + F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) >= need))
    return (one.join(two, (one["s"] == two["s"]) & near)
            .select(F.col("member1").alias("one"), F.col("member2").alias("two")).distinct())


def _buckets(nodes: DataFrame) -> DataFrame:
    """(place, n, key): the buckets of candidates of ``nodes`` (place, n, keys, fp).

    A bucket per group of linked fingerprints, named by a row of it, and one per MinHash band. A name
    that two buckets happen to share joins them, which costs comparisons and no result.
    """
    prints = nodes.select(F.xxhash64("place.row").alias("id"), "fp", "place", "n")
    groups = written(with_groups(prints).select("place", "n", F.col("component_id").alias("key")), "near-groups")
    return nodes.select("place", "n", F.explode("keys").alias("key")).union(groups)


def _dropped(buckets: DataFrame, texts: DataFrame, size: int, percent: int) -> list[DataFrame]:
    """Tables (place) of the nodes that are similar to a staying node with a smaller place.

    ``buckets`` (place, n, key) says which nodes are candidates of each other. Round by round, a node that is the first of all its buckets stays, and what is similar to it
    in its buckets goes. Buckets of many nodes that are not similar would take a round for each:
    after ``STAR_ROUNDS`` the nodes left are joined by their rarest shingles, and the pairs that are
    similar go on as buckets of two. Tables that grow with the documents are joined by merging at any
    size: none is small enough to broadcast where it matters, and a hot row is split.
    """
    open_, gone, kept_texts = buckets, [], None
    kind = buckets.schema["place"].dataType.simpleString()
    rounds = 0

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.filter(_sizes_fit(F.col("n"), F.col("other_n"), percent)).distinct(), "near-pairs")
        mine = kept_texts.select(F.col("row").alias("mine"), "text")
        its = kept_texts.select(F.col("row").alias("its"), F.col("text").alias("other_text"))
        both = (pairs.join(mine.hint("merge"), F.col("place.row") == F.col("mine")).drop("mine")
                .join(its.hint("merge"), F.col("other.row") == F.col("its")).select("place", "n", "other", "other_n", "text", "other_text"))
        return written(both.sortWithinPartitions("other").mapInArrow(
            _verified(size, percent), f"place {kind}, n bigint, other {kind}, other_n bigint"), "near-verified")

    def similar_pairs(left: DataFrame) -> DataFrame:
        """All similar pairs of the nodes ``left`` (place, n), a smaller place as ``other``."""
        found = kept_texts.join(left.select(F.col("place.row").alias("row")), "row", "left_semi").mapInArrow(
            _sets(size), f"row {texts.schema['row'].dataType.simpleString()}, shingles array<bigint>")
        sets = written(left.join(found, F.col("place.row") == F.col("row")).select(
            F.monotonically_increasing_id().alias("member"), "place", "n", "shingles"), "near-sets")
        named = sets.select("member", F.struct("place", "n").alias("node"))
        pairs = (prefix_pairs(sets.select("member", "n", "shingles"), percent)
                 .join(named.toDF("one", "a"), "one").join(named.toDF("two", "b"), "two"))
        pairs = pairs.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        return verify(pairs.select("x.*", F.col("y.place").alias("other"), F.col("y.n").alias("other_n")))

    while True:
        firsts = written(open_.groupBy("key").agg(F.min(F.struct("place", "n")).alias("first"), F.count("*").alias("many"))
                         .filter("many > 1").select("key", F.col("first.place").alias("other"), F.col("first.n").alias("other_n")),
                         "near-firsts")
        if firsts.isEmpty():
            return gone
        shared = written(open_.join(firsts, "key"), "near-shared")
        if kept_texts is None:
            # Only texts with a candidate are read again.
            named = written(shared.select(F.col("place.row").alias("row")).distinct(), "near-named")
            kept_texts = written(texts.join(named.hint("merge"), "row", "left_semi"), "near-texts")
        if rounds == STAR_ROUNDS:
            found = similar_pairs(written(shared.select("place", "n").distinct(), "near-left"))
            node = F.array(F.struct("place", "n"), F.struct(F.col("other").alias("place"), F.col("other_n").alias("n")))
            open_ = found.select(F.xxhash64("place.row", "other.row").alias("key"), F.explode(node).alias("node")).select("node.*", "key")
            rounds += 1
            continue
        sure = written(shared.groupBy("place").agg(F.max(F.col("other") < F.col("place")).alias("waits"))
                       .filter("NOT waits").select("place"), "near-sure")
        pairs = shared.filter("other < place").select("place", "n", "other", "other_n")
        pairs = pairs.join(sure.select(F.col("place").alias("other")).hint("merge"), "other", "left_semi")
        out = written(verify(pairs).select("place").distinct(), "near-gone")
        gone.append(out)
        open_ = shared.select("place", "n", "key").join(out.union(sure), "place", "left_anti")
        rounds += 1


def first_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = STAGE_SHINGLE,
                  percent: int = STAGE_PERCENT, stored: bool = False) -> DataFrame:
    """The documents without those similar to a staying one with a smaller id (null ids last).

    A document goes only if the Jaccard similarity of its shingles with a document that stays,
    computed from both whole texts, is at least ``percent`` hundredths. ``stored`` says that ``docs``
    is Parquet files as they are read; otherwise the rows are written once.
    """
    row = fresh(docs, "simhash_row")
    table = with_row(docs, row, "simhash-input", stored)
    # The row goes along with the id, so that repeated ids stay apart.
    place = F.struct(F.col(doc_id).isNull().alias("unnamed"), F.col(doc_id).alias("id"), F.col(row).alias("row"))
    given = table.select(F.col(text).alias("text"), place.alias("place"))
    kind = given.schema["place"].dataType.simpleString()
    prints = given.mapInArrow(_bands(shingle), f"place {kind}, n bigint, copy binary, keys array<bigint>, fp bigint")
    # Copies have one set of shingles; the first of them stands for all.
    nodes = written(prints.groupBy("copy").agg(F.min(F.struct("place", "n", "keys", "fp")).alias("first")).select("first.*"), "near-nodes")
    kept = nodes.select("place")
    for out in _dropped(_buckets(nodes), table.select(F.col(row).alias("row"), F.col(text).alias("text")), shingle, percent):
        kept = kept.join(out, "place", "left_anti")
    kept = written(kept.select(F.col("place.row").alias(row)), "near-kept")
    return table.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
