"""The prefix trie of conversations, built from adaptive radix trees.

A turn (role, text) becomes an id of 16 bytes, big-endian; a conversation becomes the string of
its turns' ids. The distinct strings are range-sorted over the cluster, and each task builds
adaptive radix trees over runs of neighbours: nodes hold up to 4, 16, 48 or 256 children and
grow from one layout to the next, and chains of single children are kept as one compressed
path. A tree branches at any byte, but only depths that end a turn become nodes of the trie,
also those inside a compressed path.

Since strings are sorted, a node is complete in its run unless it is a prefix of what lies beyond
the run's ends. Such open nodes (the path of the first and last string at a task's edge,
the shared prefix where a task starts its next run) leave as partial sums, are merged by an
aggregate over the open nodes, and get their subtrees' sums along their few ancestors. A first
turn, or a whole conversation, in a third of all rows is therefore spread like any other.

The members ending at a node are hashed in numeric order as a stream: sorted ids become strings of
bounded runs in many tasks, and one hash reads those strings; they are never gathered.

Defined results: turns are ordered by number (null first), ties by their id; equal rows are turns of
their own; null role and text are empty; rows without a ``conv_id`` take no part, other null
columns are not looked at; a conversation without turns left is a member of the root; an empty
table gives no nodes, not even a root. A conversation is one row of turn ids (16 bytes each);
its texts are not gathered. Ids are MD5 digests of role and text.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfolio.llm.common import written

WIDTH = 16
# Bytes of keys in one tree.
RUN_BYTES = 8 << 20
# Ids in one string of an end list.
LIST_RUN = 1 << 14
FAMILY = 100
HEAD_RANGE = 6


# ------------------------------------------------------------------ adaptive radix tree

class Node:
    """A compressed path, a key that ends after it, and children by their next byte.

    The layout grows with the number of children: sorted bytes beside the children (4, 16), an
    index of 256 slots into the children (48), the children themselves by byte (256).
    """
    __slots__ = ("path", "end", "layout", "bytes", "children", "n")

    def __init__(self, path: bytes, end: int | None = None):
        self.path, self.end, self.layout, self.n = path, end, 4, 0
        self.bytes: bytearray | None = bytearray()
        self.children: list = []

    def find(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, child: Node) -> None:
        """Add or replace the child of a byte."""
        if self.layout <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.children[at] = child
                return
            if self.n < self.layout:
                at = sum(b < byte for b in self.bytes)
                self.bytes.insert(at, byte)
                self.children.insert(at, child)
                self.n += 1
                return
            self.grow()
            self.put(byte, child)
        elif self.layout == 48:
            if self.bytes[byte]:
                self.children[self.bytes[byte] - 1] = child
            elif self.n < 48:
                self.children.append(child)
                self.n += 1
                self.bytes[byte] = self.n
            else:
                self.grow()
                self.put(byte, child)
        else:
            self.n += self.children[byte] is None
            self.children[byte] = child

    def grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for i, b in enumerate(self.bytes):
                index[b] = i + 1
            self.layout, self.bytes = 48, index
        else:
            self.children = [self.children[at - 1] if at else None for at in self.bytes]
            self.layout, self.bytes = 256, None

    def sorted_children(self) -> list[Node]:
        if self.layout <= 16:
            return self.children
        if self.layout == 48:
            return [self.children[at - 1] for at in self.bytes if at]
        return [c for c in self.children if c is not None]


def _common(a: bytes, b: bytes) -> int:
    """Length of the shared beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTree:
    """Keys of bytes, each with the number of its row."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, row: int) -> None:
        node, at = self.root, 0
        while True:
            same = _common(node.path, key[at:at + len(node.path)])
            if same < len(node.path):
                # The path parts here: what follows becomes a child.
                rest = Node(node.path[same + 1:], node.end)
                rest.layout, rest.bytes, rest.children, rest.n = node.layout, node.bytes, node.children, node.n
                byte = node.path[same]
                node.path, node.end, node.layout, node.n = node.path[:same], None, 4, 0
                node.bytes, node.children = bytearray(), []
                node.put(byte, rest)
            at += same
            if at == len(key):
                node.end = row
                return
            child = node.find(key[at])
            if child is None:
                node.put(key[at], Node(key[at + 1:], row))
                return
            node, at = child, at + 1


# ------------------------------------------------------------------ trie nodes of a run

class Entry:
    """A node of the trie: a turn-aligned depth of the tree."""
    __slots__ = ("depth", "low", "high", "n", "first", "end", "kids", "leaves", "saved", "parent", "open")

    def __init__(self, depth: int, low: int, high: int, n: int, first: int, end: int | None):
        self.depth, self.low, self.high, self.n, self.first, self.end = depth, low, high, n, first, end
        self.kids = self.leaves = self.saved = 0
        self.parent: Entry | None = None
        self.open = False


def entries(rows: list[tuple], open_left: int, open_right: int) -> list[Entry]:
    """The trie nodes of sorted rows (key, lens, n, first, sha), parents after their children.

    A node is open if it is one of the first ``open_left`` turns of the first key, or of the first
    ``open_right`` of the last. An open node's kids, leaves and saved count closed nodes below only.
    """
    tree = RadixTree()
    for i, row in enumerate(rows):
        tree.insert(row[0], i)
    last = len(rows) - 1
    out: list[Entry] = []
    # Post-order: every node hands up the entries that still lack a parent, and its sums.
    done: dict[int, tuple[list[Entry], int, int, int, int]] = {}
    stack: list[tuple[Node, int, bool]] = [(tree.root, 0, False)]
    while stack:
        node, above, ready = stack.pop()
        depth = above + len(node.path)
        kids = node.sorted_children()
        if not ready:
            stack.append((node, above, True))
            stack += [(c, depth + 1, False) for c in kids]
            continue
        below, n, first, low, high = [], 0, None, len(rows), -1
        if node.end is not None:
            n, first, low, high = rows[node.end][2], rows[node.end][3], node.end, node.end
        for c in kids:
            entries_, n_, first_, low_, high_ = done.pop(id(c))
            below += entries_
            n += n_
            first = first_ if first is None else min(first, first_)
            low, high = min(low, low_), max(high, high_)
        # Aligned depths of the path from its end up; the byte before the path belongs to it.
        for d in range(depth // WIDTH, -(-above // WIDTH) - 1, -1):
            e = Entry(d, low, high, n, first, node.end if d * WIDTH == depth else None)
            e.open = (low == 0 and d <= open_left) or (high == last and d <= open_right)
            length = rows[low][1][d - 1] if d else 0
            for c in below:
                c.parent = e
                e.kids += not c.open
                e.leaves += c.leaves
                e.saved += c.saved
            if not e.open:
                e.leaves += not below
                e.saved += (n - 1) * length
            out.append(e)
            below = [e]
        done[id(node)] = (below, n, first, low, high)
    return out


_NODES = ("conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
          "ends_sha256 string, parent_conv_id bigint, open boolean, length bigint, up binary, path array<binary>")
_EMPTY = hashlib.sha256(b"").hexdigest()


def _digests(key: bytes, turns: int) -> list[bytes]:
    """A digest per prefix of the key, from none of its turns on."""
    state, out = hashlib.md5(), [hashlib.md5().digest()]
    for d in range(turns):
        state.update(key[d * WIDTH:(d + 1) * WIDTH])
        out.append(state.copy().digest())
    return out


def _run_rows(rows: list[tuple], open_left: int, open_right: int) -> pa.RecordBatch:
    found = entries(rows, open_left, open_right)
    left, right = _digests(rows[0][0], open_left), _digests(rows[-1][0], open_right)

    def path(e: Entry) -> list[bytes]:
        return (left if e.low == 0 and e.depth <= open_left else right)[:e.depth + 1]

    columns: list[list] = [[] for _ in range(12)]
    for e in found:
        p = e.parent
        closed_parent = p is not None and not p.open
        row = (e.first, e.depth, e.n, e.kids, e.leaves, e.saved, None if e.end is None else rows[e.end][4],
               p.first if closed_parent else None, e.open, rows[e.low][1][e.depth - 1] if e.depth else 0,
               None if closed_parent or p is None else path(p)[-1], path(e) if e.open else None)
        for c, v in zip(columns, row):
            c.append(v)
    types = [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
    names = [c.split()[0] for c in _NODES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _grow(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, used, left = [], 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "lens", "n", "first", "sha")]):
                if used >= size:
                    shared = _common(rows[-1][0], row[0]) // WIDTH
                    yield _run_rows(rows, len(rows[0][0]) // WIDTH if left is None else left, shared)
                    rows, used, left = [], 0, shared
                rows.append(row)
                used += len(row[0]) + WIDTH
        if rows:
            turns = len(rows[-1][0]) // WIDTH
            yield _run_rows(rows, len(rows[0][0]) // WIDTH if left is None else left, turns)
    return run


# ------------------------------------------------------------------ conversations as keys

def _crc32(ids: Column) -> Column:
    return F.crc32(ids.cast("string").cast("binary"))


def as_ids(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """(conv_id, turns): per conversation its turns in order, each as hex id and code points of the text."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turn_id = F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what))
    one = F.struct(F.col(turn).alias("turn"), turn_id.alias("id"), F.length(what).cast("bigint").alias("len"))
    ordered = F.sort_array(F.collect_list(one))
    return (conversations.filter(F.col(conv_id).isNotNull())
            .groupBy(F.col(conv_id).cast("bigint").alias("conv_id"))
            .agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["len"].alias("len"))).alias("turns")))


def rebuilt(whole: DataFrame) -> DataFrame:
    """``whole`` (conv_id, turns) with the first turns of each taken from the head of its family.

    A family is 100 ids; its head's first five turns travel to its members, at most 99 others.
    """
    head = (F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = whole.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("head"), F.slice("turns", 1, HEAD_RANGE - 1).alias("start"))
    h = (_crc32(F.col("conv_id")) % HEAD_RANGE).cast("int")
    none = F.slice("turns", 1, 0)
    both = whole.withColumn("head", head).join(heads, "head", "left")
    turns = F.concat(F.slice(F.coalesce("start", none), F.lit(1), h),
                     F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0))))
    return both.select("conv_id", turns.alias("turns"))


def _end_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, id) rows as comma-joined strings of bounded runs."""
    node, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()),
                                           pa.array([len(ids)], pa.int64()), pa.array([",".join(map(str, ids))])],
                                          ["node", "first", "n", "ids"])

    for batch in batches:
        for k, i in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (k != node or len(ids) == LIST_RUN):
                yield row()
                ids = []
            node = k
            ids.append(i)
    if ids:
        yield row()


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per node from its runs in order; only the state of the hash is held."""
    node, first, n, state = None, 0, 0, None
    for batch in batches:
        out = []
        for k, f, m, ids in zip(*[batch.column(c).to_pylist() for c in ("node", "first", "n", "ids")]):
            if k != node:
                if state:
                    out.append((node, first, n, state.hexdigest()))
                node, first, n, state = k, f, 0, hashlib.sha256()
            elif n:
                state.update(b",")
            state.update(ids.encode())
            n += m
        if out:
            yield _ends(out)
    if state:
        yield _ends([(node, first, n, state.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["node", "first", "n", "sha"])


def ends(keys: DataFrame) -> DataFrame:
    """(node, first, n, sha) per distinct key of (conv_id, node)."""
    runs = (keys.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
            .mapInArrow(_end_runs, "node binary, first bigint, n bigint, ids string"))
    return (written(runs, "trie-end-runs").repartition("node").sortWithinPartitions("node", "first")
            .mapInArrow(_end_hashes, "node binary, first bigint, n bigint, sha string"))


def trie(turns: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, turns), as ``op11`` returns them."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    keys = written(turns.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["len"]).alias("lens"))
                   .withColumn("node", F.unhex(F.md5("key"))), "trie-keys")
    ended = ends(keys).select(F.col("first").alias("conv_id"), "n", "sha")
    distinct = keys.drop("node").join(ended, "conv_id").withColumnRenamed("conv_id", "first")
    nodes = written(distinct.repartitionByRange("key").sortWithinPartitions("key")
                    .mapInArrow(_grow(run_bytes), _NODES), "trie-nodes")

    # Open nodes: parts of the same node are added, then what lies below each is.
    node = F.element_at("path", -1)
    merged = written(nodes.filter("open").withColumn("node", node).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("ends_sha256").alias("ends_sha256"), F.max("length").alias("length"), F.max("path").alias("path")), "trie-open")
    above = F.when(F.size("path") > 1, F.element_at("path", -2))
    kids = merged.filter("depth > 0").groupBy(F.element_at("path", -2).alias("node")).agg(F.count("*").alias("open_kids"))
    counted = merged.join(kids, "node", "left").withColumns({
        "up": above, "n_children": F.col("n_children") + F.coalesce("open_kids", F.lit(0))})
    own = counted.select(F.explode("path").alias("node"), (F.col("n_children") == 0).cast("bigint").alias("own_leaf"),
                         ((F.col("n_convs") - 1) * F.col("length")).alias("own_saved"))
    sums = own.groupBy("node").agg(F.sum("own_leaf").alias("own_leaf"), F.sum("own_saved").alias("own_saved"))
    opened = written(counted.join(sums, "node").select(
        "node", "up", "conv_id", "depth", "n_convs", "n_children", (F.col("n_leaves") + F.col("own_leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("own_saved")).alias("saved_tokens"), "ends_sha256"), "trie-merged")

    names = opened.select(F.col("node").alias("of"), F.col("conv_id").alias("parent"))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    closed = nodes.filter("NOT open")
    inner = closed.filter("up IS NULL").select(*result)
    edge = (closed.filter("up IS NOT NULL").join(names, F.col("up") == F.col("of"))
            .withColumn("parent_conv_id", F.col("parent")).select(*result))
    rest = (opened.join(names, F.col("up") == F.col("of"), "left")
            .withColumn("parent_conv_id", F.col("parent")).select(*result))
    return inner.unionByName(edge).unionByName(rest).fillna(_EMPTY, ["ends_sha256"])


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = written(as_ids(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-conversations")
    return trie(rebuilt(whole))


QUERIES = {"op11_conversation_trie": op11_conversation_trie}

# The check sum of decimal digits, bit by bit: 8 shifts after each byte (polynomial 0xEDB88320, reflected).
_CRC = """xor(list_reduce(
  list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""
ORACLE = {"op11_conversation_trie": f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, {_CRC} % {HEAD_RANGE} AS h FROM (SELECT DISTINCT conv_id FROM t)),
moved AS (
  SELECT h.conv_id, i, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % {FAMILY} AND i <= h.h
  UNION ALL
  SELECT t.conv_id, i, role, text FROM t JOIN h ON t.conv_id = h.conv_id AND i > h.h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d FROM moved),
paths AS (
  SELECT conv_id, d, length(text) AS len,
         string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path
  FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM h),
sizes AS (SELECT conv_id, max(d) AS turns FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, any_value(d) AS depth, any_value(len) AS len, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(CASE WHEN d = turns THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ended
  FROM paths JOIN sizes USING (conv_id) GROUP BY path),
families AS (
  SELECT p.path, count(*) FILTER (c.depth = p.depth + 1) AS n_children, sum((c.n_convs - 1) * c.len) AS saved_tokens
  FROM nodes p JOIN nodes c ON starts_with(c.path, p.path) GROUP BY p.path),
leafs AS (
  SELECT p.path, count(*) AS n_leaves
  FROM nodes p JOIN nodes c ON starts_with(c.path, p.path) JOIN families f ON f.path = c.path
  WHERE f.n_children = 0 GROUP BY p.path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ended, '')) AS ends_sha256
FROM nodes n JOIN families USING (path) JOIN leafs USING (path)
LEFT JOIN nodes up ON n.depth > 0 AND up.path = n.path[1:32 * (n.depth - 1)]"""}
