"""Benchmark decontamination over a distributed positional inverted index.

``build`` cuts the documents, as they are read, into segments of bounded size. A segment holds
one posting list per term, the sorted positions of that term in the segment, and a directory of
its documents; both are rows of one Parquet table. Documents lie ``GAP`` positions apart, so no
phrase and no tolerance below that gap reaches from one into the next.

A test item is cut into windows of consecutive words. The rarest term of each window (by its
count in the whole index) decides which segments the item must visit at all. There the lists
of the window's terms, each shifted by the term's offset, are intersected from the shortest
on: what is left are the exact places of the phrase. With a tolerance ``slop`` every term may
stand that many words off its place: a proximity match.

Segments and the items that visit them meet in one shuffle by segment: the lists of one segment
are held, items stream past. Test items are never broadcast, a frequent term is a list of
bounded length in each segment, and a passage in a third of all documents adds one row for each
of these documents.

Defined results: null and empty texts have no words, as documents (0 words, not contaminated) and
as items (no window); a null ``item_id`` marks words but is not listed; repeated item ids are
listed once, repeated documents are rows of their own; a text of any length is indexed whole, a
long one makes a long segment; an empty table of documents gives an empty result, an empty
table of items no hits; other columns are not looked at.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfolio.llm.common import documents, written

WINDOW = 10
# Positions of a segment, the gaps between documents included.
SEGMENT = 1 << 20
GAP = 64
_WORD_BYTES = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
_FOLDED = bytes(b if b in _WORD_BYTES else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The words of one whole text in order, A-Z in lower case, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLDED).split()


# ------------------------------------------------------------------ index

def _postings(size: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        code = defaultdict(count().__next__)
        ids, codes, used = [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            sizes = np.fromiter(map(len, codes), np.int64, len(codes))
            flat = np.concatenate(codes)
            at = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)) * GAP, sizes)
            starts = np.cumsum(sizes + GAP) - sizes - GAP
            order = np.argsort(flat, kind="stable")
            n = np.bincount(flat, minlength=len(code))
            yield _rows(segment, [None], [len(flat)], [0, len(starts)], starts,
                        pa.array([ids], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int32())))
            if len(flat):
                none = len(n)
                yield _rows(segment, list(code), n, np.concatenate(([0], np.cumsum(n))), at[order],
                            pa.nulls(none, pa.list_(id_type)), pa.nulls(none, pa.list_(pa.int32())))

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                found = terms(text.as_py())
                ids.append(doc)
                codes.append(np.fromiter(map(code.__getitem__, found), np.int64, len(found)))
                used += len(found) + GAP
                if used >= size:
                    yield from rows()
                    code = defaultdict(count().__next__)
                    ids, codes, used, segment = [], [], 0, segment + 1
        if ids:
            yield from rows()
    return run


def _rows(segment: int, words: list, n, offsets, at: np.ndarray, ids: pa.Array, sizes: pa.Array) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(words), segment), pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64()),
         lists, ids, sizes], ["segment", "term", "n", "at", "ids", "sizes"])


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", segment: int = SEGMENT) -> DataFrame:
    """The index of all documents, as a table: (segment, term, n, at, ids, sizes).

    A row with a term is its posting list in a segment. The row without one is the segment's
    directory: first position, id and number of words of each document.
    """
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    id_type = given.select("id").limit(0).toArrow().schema.field("id").type
    rows = given.mapInArrow(
        _postings(segment, id_type),
        f"segment bigint, term binary, n bigint, at array<int>, ids array<{kind}>, sizes array<int>")
    return written(rows, "positional-index", compression="zstd")


# ------------------------------------------------------------------ search

def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [terms(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item"), batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))],
            ["item", "item_id", "words"])


def cut(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item, item_id, words) of the items that have words, as a table; ``item`` is the row's number."""
    given = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"),
                         F.col(text).alias("text"))
    kind = given.schema["item_id"].dataType.simpleString()
    rows = given.mapInArrow(_cut, f"item bigint, item_id {kind}, words array<binary>")
    return written(rows.filter(F.size("words") > 0), "positional-items")


def phrase(lists: list[np.ndarray], slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions where the terms of these posting lists follow each other.

    ``lists[k]`` belongs to the term at offset k. The shortest list proposes the places, the others
    are looked up from the shortest on. Each term may be ``slop`` words off its place relative to
    the rarest one.
    """
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    rarest = lists[order[0]]
    start = rarest - order[0]
    first, last = rarest, rarest
    for k in order[1:]:
        if not len(start):
            break
        at = lists[k]
        place = np.searchsorted(at, start + (k - slop))
        found = at[np.minimum(place, len(at) - 1)]
        ok = np.abs(found - (start + k)) <= slop
        start, found = start[ok], found[ok]
        first, last = np.minimum(first[ok], found), np.maximum(last[ok], found)
    return first, last


def windows(words: list[bytes], lists: dict[bytes, np.ndarray], width: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) positions of every window of an item in one segment."""
    known = [lists.get(w) for w in words]
    width = min(width, len(words))
    firsts, lasts = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    absent = sum(at is None for at in known[:width - 1])
    for i in range(len(words) - width + 1):
        absent += known[i + width - 1] is None
        if not absent:
            first, last = phrase(known[i:i + width], slop)
            firsts.append(first)
            lasts.append(last)
        absent -= known[i] is None
    return np.concatenate(firsts), np.concatenate(lasts)


def _search(width: int, slop: int, spans: bool, item_type: pa.DataType):
    """Over rows sorted by segment, its lists before its items."""
    names = ["segment", "doc", "item_id", "first", "last"] if spans else ["segment", "doc", "n_hit", "items"]
    types = ([pa.int64(), pa.int32(), item_type, pa.int32(), pa.int32()] if spans
             else [pa.int64(), pa.int32(), pa.int64(), pa.list_(item_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, lists, starts, sizes, edges, listed, before = None, {}, None, None, None, {}, None

        def table(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        def hits() -> Iterator[pa.RecordBatch]:
            """One row per document of the segment that has a hit."""
            if edges is not None and not spans:
                hit = np.cumsum(edges) > 0
                total = np.concatenate(([0], np.cumsum(hit)))
                n = total[np.minimum(starts + sizes, len(total) - 1)] - total[starts]
                docs = np.flatnonzero(n)
                yield table([np.full(len(docs), segment), docs, n[docs], [sorted(listed.get(d, ())) for d in docs.tolist()]])

        for batch in batches:
            of = batch.column("segment").to_numpy()
            kind = batch.column("kind").to_numpy()
            word, at, n_words = batch.column("term"), batch.column("at"), batch.column("sizes")
            item, words = batch.column("item_id"), batch.column("words")
            out: list[tuple] = []
            for i in range(len(of)):
                if of[i] != segment:
                    yield from hits()
                    segment, lists, starts, sizes, edges, listed, before = of[i], {}, None, None, None, {}, None
                if kind[i] == 0:
                    starts = at[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                    sizes = n_words[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                elif kind[i] == 1:
                    lists[word[i].as_py()] = at[i].values.to_numpy(zero_copy_only=False)
                else:
                    # Items of equal text follow each other and are searched once.
                    asked = words[i].as_py()
                    if before is None or before[0] != asked:
                        first, last = windows(asked, lists, width, slop)
                        before = (asked, first, last, np.searchsorted(starts, first, "right") - 1)
                    _, first, last, doc = before
                    if not len(first):
                        continue
                    name = item[i].as_py()
                    if spans:
                        for d, a, b in sorted(set(zip(doc.tolist(), (first - starts[doc]).tolist(), (last - starts[doc]).tolist()))):
                            out.append((segment, d, name, a, b))
                        continue
                    if edges is None:
                        edges = np.zeros(int(starts[-1] + sizes[-1]) + 1, np.int64)
                    np.add.at(edges, first, 1)
                    np.add.at(edges, last + 1, -1)
                    for d in np.unique(doc).tolist():
                        names_ = listed.setdefault(d, set())
                        if name is not None:
                            names_.add(name)
            if out:
                yield table(list(zip(*out)))
        yield from hits()
    return run


def _visits(index: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(segment, item): the item has a window whose rarest term occurs in the segment."""
    asked = items.select("item", F.posexplode("words").alias("pos", "term"))
    lists = index.filter("term IS NOT NULL").select("segment", "term", "n")
    counts = written(lists.join(asked.select("term").distinct(), "term", "left_semi")
                     .groupBy("term").agg(F.sum("n").alias("n")), "positional-counts")
    known = asked.join(counts, "term", "left").groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("t"))
    rarest = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("t") - width, F.lit(0))),
        lambda i: F.array_min(F.transform(F.slice("t", i + 1, F.lit(width)), lambda x: F.struct(x["n"], x["term"]))))
    anchors = known.select("item", F.explode(F.array_distinct(rarest)).alias("r")).filter("r.n > 0")
    return (anchors.select("item", F.col("r.term").alias("term"))
            .join(lists.select("segment", "term"), "term").select("segment", "item").distinct())


def _found(index: DataFrame, items: DataFrame, width: int, slop: int, spans: bool) -> DataFrame:
    if not 0 <= slop < GAP:
        raise ValueError(f"the tolerance must be below {GAP}")
    kind = items.schema["item_id"].dataType.simpleString()
    item_type = items.select("item_id").limit(0).toArrow().schema.field("item_id").type
    empty = {c: F.lit(None).cast(t) for c, t in (("term", "binary"), ("at", "array<int>"), ("sizes", "array<int>"),
                                                 ("item_id", kind), ("words", "array<binary>"))}

    def row(which: int, *given: str) -> list:
        return ["segment", F.lit(which).alias("kind"), *[c if c in given else v.alias(c) for c, v in empty.items()]]

    asked = items.select(F.explode("words").alias("term")).distinct()
    rows = (index.filter("term IS NULL").select(*row(0, "at", "sizes"))
            .unionByName(index.filter("term IS NOT NULL").join(asked, "term", "left_semi").select(*row(1, "term", "at")))
            .unionByName(_visits(index, items, width).join(items, "item").select(*row(2, "item_id", "words"))))
    shape = ("segment bigint, doc int, " + (f"item_id {kind}, first int, last int" if spans
                                            else f"n_hit bigint, items array<{kind}>"))
    return rows.repartition("segment").sortWithinPartitions("segment", "kind", "words").mapInArrow(
        _search(width, slop, spans, item_type), shape)


def _directory(index: DataFrame) -> DataFrame:
    listed = index.filter("term IS NULL").select("segment", F.posexplode(F.arrays_zip("ids", "sizes")).alias("doc", "d"))
    return listed.select("segment", "doc", F.col("d.ids").alias("doc_id"), F.col("d.sizes").cast("bigint").alias("n_words"))


def matches(index: DataFrame, items: DataFrame, width: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc_id, item_id, first, last): word positions of every phrase or proximity match.

    ``items`` are those of ``cut``. ``slop`` 0 finds exact phrases; above it, the terms of a window
    stand at most so many words off their places (one word may serve two equal terms).
    """
    found = _found(index, items, width, slop, True)
    return found.join(_directory(index), ["segment", "doc"]).select("doc_id", "item_id", "first", "last")


def contaminated(index: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items): one row per document of the index."""
    found = written(_found(index, items, width, 0, False), "positional-hits")
    kind = found.schema["items"].dataType.simpleString()
    return _directory(index).join(found, ["segment", "doc"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast(kind)).alias("items"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(documents(spark, sf_dir))
    rows = contaminated(index, cut(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op13_decontamination": op13_decontamination}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {"op13_decontamination": f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT item_id, ws, least(len(ws), {WINDOW}) AS width FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
wins AS (
  SELECT DISTINCT item_id, width, array_to_string(ws[i:i + width - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(ws) - width + 2)) AS i FROM items)),
places AS (
  SELECT doc, width, i, array_to_string(ws[i:i + width - 1], ' ') AS phrase
  FROM (SELECT doc, ws, width, unnest(range(1, greatest(len(ws) - width + 2, 1))) AS i
        FROM docs, (SELECT DISTINCT width FROM wins))),
found AS (SELECT doc, i, width, item_id FROM places JOIN wins USING (width, phrase)),
hits AS (
  SELECT doc, count(DISTINCT p) AS n_hit
  FROM (SELECT doc, unnest(range(i, i + width)) AS p FROM (SELECT DISTINCT doc, i, width FROM found)) GROUP BY doc),
listed AS (
  SELECT doc, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc) LEFT JOIN listed USING (doc)"""}
