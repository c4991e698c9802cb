"""Conversation trie, hard negatives, positional index: against brute force and on odd rows."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfolio.llm import catalog, hard_negatives, positional, prefix_trie


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ op 11

def plain_nodes(conversations):
    """The contract's columns by walking every rebuilt conversation."""
    turns = {c: [] for c, *_ in conversations if c is not None}
    for c, t, role, text in conversations:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    ordered = {c: [x[3:] for x in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, ts in ordered.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = (*ordered.get(c - c % 100, [])[:h], *ts[h:])
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = {n: [m for m in below if len(m) == len(n) + 1 and m[:len(n)] == n] for n in below}
        ends = ",".join(map(str, sorted(c for c in who if len(whole[c]) == len(node))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]),
                    sum(not k for k in kids.values()), sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=140, alphabet=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, 7)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["", None, "é漢", "aa", "bbb"][:alphabet])))
    rows += [(300, None, "user", "first"), (300, 1, "user", "x"), (300, 1, "user", "x"), (300, 1, "bot", "x"), (None, 0, "user", "x")]
    return rows


@pytest.mark.parametrize("run_bytes", [prefix_trie.RUN_BYTES, 200])
@pytest.mark.parametrize("alphabet", [2, 5])
def test_trie_equals_brute_force(spark, run_bytes, alphabet):
    rows = conversations(alphabet, alphabet=alphabet)
    rng = random.Random(1)
    rows += [(1000 + c, t, "user", "same") for c in range(40) for t in range(3)]            # copies in many runs
    rows += [(2000, t, "user", str(rng.random())) for t in range(300)]                       # a long one
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumns({"key": F.lit(1), "node": F.lit("x"), "turns": F.lit(2), "id": F.lit(3)}).repartition(5)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.as_ids(df)), run_bytes)
    assert rows_of(got) == plain_nodes(rows)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.as_ids(df))).count() == 0


def test_end_lists_run_over_several_strings(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST_RUN", 7)
    rows = [(c, b"a" if c % 3 else b"b") for c in range(100)]
    # Tasks run in worker processes: the bound is passed by building the runs here.
    got = {}
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([k for _, k in sorted(rows, key=lambda r: (r[1], r[0]))], pa.binary()),
                                        pa.array([c for c, _ in sorted(rows, key=lambda r: (r[1], r[0]))], pa.int64())], ["node", "conv_id"])
    runs = list(prefix_trie._end_runs(iter([batch])))
    assert len(runs) > 10
    for r in prefix_trie._end_hashes(iter(runs)):
        for node, first, n, sha in zip(*[r.column(i).to_pylist() for i in range(4)]):
            got[node] = first, n, sha
    for key in (b"a", b"b"):
        ids = sorted(c for c, k in rows if k == key)
        assert got[key] == (ids[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_radix_tree_grows_through_all_layouts():
    rng = random.Random(3)
    keys = sorted({bytes([b]) + rng.randbytes(31) for b in range(256)} | {bytes([7]) * 16, b""})
    tree = prefix_trie.RadixTree()
    layouts = set()
    order = list(enumerate(keys))
    rng.shuffle(order)
    for i, key in order:
        tree.insert(key, i)
        layouts.add(tree.root.layout)
    assert layouts == {4, 16, 48, 256}

    def walk(node, before):
        here = before + node.path
        found = [(here, node.end)] if node.end is not None else []
        for c in node.sorted_children():
            byte = next(b for b in range(256) if node.find(b) is c)
            found += walk(c, here + bytes([byte]))
        return found
    assert sorted(walk(tree.root, b"")) == list(zip(keys, range(len(keys))))


# ------------------------------------------------------------------ op 12

def plain_negatives(rows, k=5):
    use = [(r, i, y, np.floor(np.array(v, np.float64) * 256).astype(np.int64)) for r, (i, v, y) in enumerate(rows)
           if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for r, i, y, v in use:
        if i % 100:
            continue
        scored = [(-int(v @ w), j, s, z) for s, j, z, w in use if s != r and len(w) == len(v)]
        near = sorted(x for x in scored if x[3] == y)[:k]
        for score, j, _, _ in near:
            far = sorted(x for x in scored if x[3] != y and 80 * -score <= 100 * -x[0] <= 100 * -score)[:k]
            out += [(i, j, n + 1, x[1], -score, -x[0]) for n, x in enumerate(far)]
    return sorted(out)


def vectors(seed, n=900, d=6, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, d))
    rows = [(int(i * 20 if i % 5 == 0 else 10_000 + i), [float(x) for x in centre[i % labels] * 0.3 + rng.normal(size=d) * 0.4], int(i % labels))
            for i in range(n)]
    rows += [(100, [1.0] * d, None), (100, None, 1), (None, [1.0] * d, 1), (200, [float("nan")] + [1.0] * (d - 1), 1),
             (300, [None] + [1.0] * (d - 1), 1), (400, [], 1), (500, [float("inf")] * d, 1), (600, [0.5] * (d + 1), 0), (700, [0.25] * (d + 1), 0)]
    return rows + [rows[0], rows[0], (rows[0][0], rows[0][1], 1), (40_000, rows[0][1], 2), (40_001, [0.0] * d, 2)]


@pytest.mark.parametrize("seed, block", [(1, 256), (2, 16), (3, 7)])
def test_hard_negatives_equal_brute_force(spark, seed, block):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    df = df.withColumns({"row": F.lit(1), "block": F.lit(2), "cell": F.lit(3), "v": F.lit(4)})
    table = hard_negatives.prepared(df, F.col("label"), F.col("vec_id") % 100 == 0)
    kept = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    got = sorted(tuple(r) for r in hard_negatives.mined(table, rows_of_block=block).collect())
    assert got == plain_negatives(kept) and got


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.mined(hard_negatives.prepared(df, F.col("label"), F.col("vec_id") % 100 == 0)).count() == 0


@pytest.mark.parametrize("n, bits", [(2, 4), (3, 3), (5, 2)])
def test_hilbert_places_are_a_walk_through_neighbours(n, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * n, indexing="ij"), -1).reshape(-1, n)
    places = hard_negatives.hilbert(cells, bits)
    assert len(set(places)) == len(cells)
    walk = cells[np.argsort(np.array(places, dtype=object))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_intervals_hold_all_scores_and_prune():
    rng = np.random.default_rng(0)
    box = rng.integers(-300, 300, (50, 8))
    queries = rng.integers(-300, 300, (20, 8))
    least, most = hard_negatives.intervals(queries, box.min(axis=0)[None], box.max(axis=0)[None])
    scores = hard_negatives.exact_scores(queries, box)
    assert (scores >= least).all() and (scores <= most).all()
    big = np.array([[1 << 40, 3]])
    assert hard_negatives.exact_scores(big, big)[0, 0] == (1 << 63) - 1
    assert hard_negatives.exact_scores(np.array([[1 << 30, 1]]), np.array([[1 << 30, 7]]))[0, 0] == (1 << 60) + 7


def test_zone_maps_leave_blocks_unread(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=2)], i % 2) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    table = hard_negatives.prepared(df, F.col("label"), F.col("vec_id") % 100 == 0)
    index = hard_negatives.blocks(table, 50)
    floors = index.select(F.explode("asking").alias("a")).select("a.*")
    anchors = table.filter("asks").join(floors, "row").select(
        "row", "label", "size", F.lit(0).cast("bigint").alias("group"), "v", F.array("floor").alias("lows"),
        F.array(F.lit((1 << 63) - 1)).alias("highs"))
    n = hard_negatives.chosen(anchors, index, True).count()
    assert n < 0.5 * 40 * index.count() / 2


# ------------------------------------------------------------------ op 13

def plain_words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def plain_hits(docs, items, width=10):
    out = []
    for doc, text in docs:
        words, hit, names = plain_words(text), set(), set()
        for name, item in items:
            iw = plain_words(item)
            w = min(width, len(iw))
            if not w:
                continue
            grams = {tuple(iw[i:i + w]) for i in range(len(iw) - w + 1)}
            for i in range(len(words) - w + 1):
                if tuple(words[i:i + w]) in grams:
                    hit |= set(range(i, i + w))
                    if name is not None:
                        names.add(name)
        out.append((doc, len(words), len(hit), sorted(names)))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    def some(n, vocabulary):
        return " ".join(rng.choice(vocabulary) for _ in range(n))
    small, large = "ab Ab é x1 the THE".split(), [f"w{i}" for i in range(300)] + ["the", "of"]
    items = [(i, some(rng.randint(11, 40), large)) for i in range(12)] + [(50, "The, of!"), (51, some(12, small)), (52, None), (53, " .,"),
                                                                         (None, some(15, large)), (0, some(20, large)), (54, "é")]
    docs = []
    for d in range(120):
        parts = [some(rng.randint(0, 60), rng.choice([small, large]))]
        for _ in range(rng.randint(0, 2)):
            words = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, len(words))
            parts += ["-".join(words[a:a + rng.randint(1, 30)]).upper(), some(rng.randint(0, 9), large)]
        docs.append((d, "\n".join(parts)))
    docs += [(None, docs[3][1]), (3, docs[3][1]), (200, None), (201, ""), (202, " ,. "), (203, items[0][1] * 2), (204, some(5000, small))]
    return docs, items


@pytest.mark.parametrize("segment", [positional.SEGMENT, 300])
def test_contamination_equals_brute_force(spark, segment):
    docs, items = passages(7)
    given = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"term": F.lit(1), "segment": F.lit(2), "id": F.lit(3)})
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumns({"item": F.lit(1), "words": F.lit(2)})
    index = positional.build(given.repartition(3), segment=segment)
    got = positional.contaminated(index, positional.cut(asked))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got.collect()), key=repr) == plain_hits(docs, items)


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "one then two and three four"), (3, "three one two"), (4, "two"), (5, "one two")],
                                 "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(9, "One, two three")], "item_id bigint, text string")
    index, asked = positional.build(docs), positional.cut(items)
    assert rows_of(positional.matches(index, asked)) == [(1, 9, 0, 2)]
    near = rows_of(positional.matches(index, asked, slop=2))
    assert (2, 9, 0, 4) in near and (1, 9, 0, 2) in near and not any(r[0] in (4, 5) for r in near)
    with pytest.raises(ValueError):
        positional.matches(index, asked, slop=positional.GAP)


def test_index_holds_every_position(spark):
    docs, _ = passages(2)
    index = positional.build(spark.createDataFrame(docs, "doc_id bigint, text string"), segment=500)
    lists = index.filter("term IS NOT NULL")
    assert lists.agg(F.sum("n")).first()[0] == lists.agg(F.sum(F.size("at"))).first()[0] == sum(len(plain_words(t)) for _, t in docs)
    assert lists.filter("at <> array_sort(at)").count() == 0
    assert lists.groupBy("segment", "term").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), ([(1, "a b")], []), ([], [])])
def test_contamination_of_nothing(spark, docs, items):
    index = positional.build(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = positional.contaminated(index, positional.cut(spark.createDataFrame(items, "item_id bigint, text string")))
    assert [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()] == [(1, 2, 0, [])] * len(docs)


# ------------------------------------------------------------------ registered queries

def test_new_queries_have_twins():
    for name in ("op11_conversation_trie", "op12_hard_negatives", "op13_decontamination"):
        assert name in catalog.queries() and name in catalog.oracle_sql()
