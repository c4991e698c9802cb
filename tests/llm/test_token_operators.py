"""Tokenizers, token files, vector search, toxicity, pipeline: against the library or brute force."""
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyfolio.llm import ball_tree, catalog, pair_index, prefix_counts, token_files, toxicity
from tallyfolio.llm.common import written
from tallyfolio.llm.units import UnitValues

ALPHABET = "aAbBzZ éÉßΣςİı \n\t\r\x0b\x1c\x85\xa0 'sStTrReEmMdDlLvV,.!?<|>endoftext start0129٣½²ñŁ漢字🙂́̈#$%&*"


def strange_texts(n, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    texts += [a + "<|endoftext|>" + b for a, b in zip(texts[:100], texts[100:200])]
    return [*texts, "", " ", "  ", "\n\n", "a" * 3000, "ab" * 2000, "ha" * 300 + " " + "!" * 900, "we'll they've 're 'l",
            "<|startoftext|><|endoftext|>x", "word " * 4000]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(prefix_counts.vocabulary_path())


# ------------------------------------------------------------------ op 1

def test_pair_index_matches_the_library():
    library, bpe = Tokenizer.from_file(pair_index.vocabulary_path()), pair_index.PairIndex(pair_index.vocabulary_path())
    texts = strange_texts(1500, 3)
    for text, data in zip(texts, bpe.encode_bytes(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(data, bpe.kind).tolist() == ids, repr(text)
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)
    with pytest.raises(KeyError):
        bpe.decode([10 ** 6])


def test_encode_and_decode_tables(spark):
    df = spark.createDataFrame([(1, "Hello World", "x"), (None, None, "y"), (1, "Hello World", "x"), (2, "", "z")],
                               "doc_id bigint, text string, tokens string")
    out = pair_index.decode(pair_index.encode(df)).collect()
    assert [r.n_tokens for r in out] == [2, 0, 2, 0] and out[0].decoded == "hello</w> world</w>" and out[1].decoded == ""
    with pytest.raises(ValueError):
        pair_index.encode(df.withColumn("IDS", F.lit(1)))
    assert pair_index.encode(df.limit(0)).count() == 0
    assert pair_index.digests(df).count() == 4


def test_kept_units_do_not_change_results():
    def work(units):
        return [len(u) for u in units]
    texts = strange_texts(300, 5) * 2
    small, large = (UnitValues(work, sum, ["<|endoftext|>"], kept=k) for k in (20, 10 ** 6))
    got = [[s for i, s in enumerate(p) if i % 2 == 0] for p in small.of(texts)]
    assert got == [[s for i, s in enumerate(p) if i % 2 == 0] for p in large.of(texts)]
    assert [sum(g) for g in got] == [len(t.replace("<|endoftext|>", "")) for t in texts]


# ------------------------------------------------------------------ op 7

def test_counts_of_every_prefix_match_the_library(byte_library):
    counter = prefix_counts.PrefixCounter(prefix_counts.vocabulary_path())

    def n(text):
        return len(byte_library.encode(text, add_special_tokens=False).ids)
    texts = strange_texts(1200, 7)
    assert [sum(c) for c in counter.counts(texts)] == list(map(n, texts))
    for text in [t for t in texts if len(t) < 120][::4]:
        want = [n(text[:i]) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want, repr(text)
        for budget in (0, 3, 9):
            assert counter.cut_for(text, budget) == max(i for i, c in enumerate(want) if c <= budget)


def test_every_token_of_the_vocabulary_stands_for_itself():
    counter = prefix_counts.PrefixCounter(prefix_counts.vocabulary_path())
    assert all(counter.whole(i) for i in counter.vocab.values())


def test_token_counts_table(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (None, "x " * 2000), (1, "one two")], "doc_id bigint, text string")
    got = {(r.id, r.n_bytes, r.n_tokens, r.over_limit, r.cut_chars) for r in prefix_counts.token_counts(df).collect()}
    assert {(1, 7, 2, False, 7), (2, 0, 0, False, 0)} < got and len(got) == 3
    table = prefix_counts.prefix_table(df.withColumn("prefix_tokens", F.lit(0)).filter("doc_id = 1")).first()
    library = Tokenizer.from_file(prefix_counts.vocabulary_path())
    assert table["prefix_tokens_"] == [len(library.encode("one two"[:i], add_special_tokens=False).ids) for i in range(8)]
    assert prefix_counts.token_counts(df.limit(0)).count() == 0 == prefix_counts.prefix_table(df.limit(0)).count()


def test_budgets_are_answered_from_stored_counts(spark, byte_library):
    texts = strange_texts(60, 21)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    counted = written(prefix_counts.prefix_table(df), "test-prefixes")
    budgets = [0, 1, 5, 40]
    got = {(r.doc_id, r.budget): r for r in prefix_counts.truncations(counted, budgets).collect()}
    for i, t in enumerate(texts):
        # Very long texts are held against the library at the cut and beside it only.
        if len(t) <= 200:
            n = [len(byte_library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
            for b in budgets:
                k = max(k for k, x in enumerate(n) if x <= b)
                r = got[i, b]
                assert (r.cut_chars, r.cut_tokens, r.whole) == (k, n[k], n[-1] <= b), (t, b)
    with pytest.raises(ValueError):
        prefix_counts.truncations(counted.withColumn("Whole", F.lit(1)), budgets)


# ------------------------------------------------------------------ the registered queries against their contracts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_registered_bpe(spark, small):
    library = Tokenizer.from_file(pair_index.vocabulary_path())
    got = {r.doc_id: r for r in pair_index.op1_bpe(spark, SMALL).collect()}
    assert got.keys() == small.keys()
    for i, text in small.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == sha(" ".join(map(str, ids)))
        assert got[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_registered_counts_and_files(spark, small, byte_library):
    counts = {r.doc_id: r for r in prefix_counts.op7_token_counts(spark, SMALL).collect()}
    files = {r.doc_id: r for r in token_files.op10_token_files(spark, SMALL).collect()}
    assert counts.keys() == files.keys() == small.keys()
    start = 0
    for i in sorted(small):
        ids = byte_library.encode(small[i], add_special_tokens=False).ids
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len(small[i].encode()), len(ids), len(ids) > 512)
        ids = [*ids, 2]
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_decoding_keeps_a_column_of_its_own_name(spark):
    df = spark.createDataFrame([("a", "kept")], "text string, decoded string")
    out = pair_index.decode(pair_index.encode(df))
    assert out.columns == ["text", "decoded", "ids", "n_tokens", "decoded_"] and out.first().decoded == "kept"


# ------------------------------------------------------------------ op 10

def test_token_files(spark, tmp_path, byte_library):
    rng = random.Random(11)
    rows = [(i, rng.choice(["", None, "one two three " * rng.randint(1, 300), "x<|endoftext|>y"])) for i in rng.sample(range(400), 300)]
    rows += [(7, "b"), (7, "a"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    manifest = token_files.write_files(docs, f"{tmp_path}/out", length=64)
    got = sorted(token_files.read_documents(manifest).collect(), key=lambda r: r.start)
    at = 0
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == sorted(-1 if i is None else i for i, _ in rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    for r in got:
        found = [[*byte_library.encode(t, add_special_tokens=False).ids, 2] for t in texts[r.doc_id]]
        crcs = {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in found}
        assert r.start == at and (r.n_tokens, r.ids_crc32) in crcs
        at += r.n_tokens
    # sequences of equal length, read in place
    for row in manifest.collect():
        file = token_files.TokenFile(row.file)
        ids, mask = file[0]
        assert len(ids) == len(mask) == 64 and ids.dtype == np.uint16 and not ids.flags.owndata
        flat = np.concatenate([b.column(0).values.to_numpy() for b in file.batches()])
        real = np.concatenate([b.column(1).values.to_numpy(zero_copy_only=False) for b in file.batches()])
        assert real.sum() == row.n_ids and len(flat) % 64 == 0
        i = len(flat) // 64 - 1
        assert (file[i][0] == flat[64 * i:]).all()
    empty = token_files.write_files(docs.limit(0), f"{tmp_path}/none")
    assert empty.count() == 0 and token_files.read_documents(empty).count() == 0


def test_documents_across_batches(monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "BATCH_ROWS", 2)
    kind = np.dtype("<u2")
    writer = token_files._Writer(f"{tmp_path}/f.arrow", kind, 4, pa.int64())
    lengths = [1, 30, 8, 3, 16, 1, 5]
    for i, n in enumerate(lengths):
        writer.add(i, np.arange(n, dtype=kind).tobytes())
    writer.close()
    want, at = [], 0
    for i, n in enumerate(lengths):
        want.append((i, at, n, zlib.crc32(np.arange(n, dtype="<u4").tobytes())))
        at += n
    assert list(token_files.TokenFile(f"{tmp_path}/f.arrow").documents()) == want


# ------------------------------------------------------------------ op 8

def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=8) * (1 if i % 50 else 3)]) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(300)]                       # many ties
    rows += [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, rows[0][1]),
             (2050, [1.0, 2.0]), (2100, [3.0, 1.0]), (2150, [1e300] * 8), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    from tallyfolio.llm.common import written
    table = written(ball_tree.prepared(df), "test-vectors")
    vectors = [(r.row, r.id, np.array(r.v, dtype=object)) for r in table.collect()]
    assert {i for _, i, _ in vectors} >= {0, 2050, 2100, 2150} and not {2000, 2001, 2002, 2003, None} & {i for _, i, _ in vectors}
    want = []
    for row, i, q in vectors:
        if i % 50 == 0:
            top = sorted((-max(-(2 ** 63 - 1), min(2 ** 63 - 1, int((q * v).sum()))), j) for r, j, v in vectors if r != row and len(v) == len(q))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(top)]
    for shard_rows, group_rows in ((10 ** 6, 10 ** 6), (150, 10 ** 6), (150, 7)):
        got = ball_tree.nearest(table, F.col("id") % 50 == 0, 5, shard_rows, group_rows)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert ball_tree.nearest(table.limit(0), F.col("id") % 50 == 0).count() == 0


# ------------------------------------------------------------------ op 3

def test_nnpu_separates_without_negative_labels():
    rng = np.random.default_rng(3)
    positive = (rng.random((300, 12)) < np.r_[np.full(4, 0.7), np.full(8, 0.1)]).astype(float)
    clean = (rng.random((2700, 12)) < np.r_[np.full(4, 0.02), np.full(8, 0.1)]).astype(float)
    hidden = (rng.random((300, 12)) < np.r_[np.full(4, 0.7), np.full(8, 0.1)]).astype(float)
    w, b = toxicity.fit(positive, np.vstack([clean, hidden]), 0.1)
    assert ((hidden @ w + b) > 0).mean() > 0.9 and ((clean @ w + b) > 0).mean() < 0.02


def test_scores_are_the_model_over_the_features(spark):
    """Scoring sums beginnings by a path of its own: the same as weights over ``features``."""
    rng = random.Random(4)
    words = ["abcde", "abcdx", "abc", "ab", "zzzz", "bad", "badly", "éclair", "Bad", "a"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["", None, "bad " * 50_000, "bad " * 50_000]
    every = sorted(set().union(*(toxicity.features(t) for t in texts)))
    weights = {f: rng.uniform(-1, 1) for f in every if rng.random() < 0.6}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"id": F.lit("x"), "score": F.lit("y")})
    got = {r.id: r.score for r in toxicity.scored(df, (weights, -0.3)).collect()}
    for i, t in enumerate(texts):
        z = -0.3 + sum(weights.get(f, 0.0) for f in toxicity.features(t))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-min(max(z, -40), 40)))), t
    assert got[202] == got[203] and toxicity.scored(df.limit(0), (weights, -0.3)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(12)

    def text(toxic):
        ws = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(60)]
        for _ in range(rng.randint(2, 4) if toxic else 0):
            ws[rng.randrange(60)] = "zorg" + rng.choice(["ak", "et", "ish", "om", "un"])
        return " ".join(ws)
    rows = [(i, text(i % 10 == 3), int(i % 10 == 3)) for i in range(3000)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(None, 1), (5000, None)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels)
    assert all(f.startswith("zorg") for f, w in model[0].items() if w > 1)
    got = {r.id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [(y, got[i] >= 0.5) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(y == p for y, p in held) / len(held) > 0.97 and got[None] < 0.5
    # held-out labels are never looked at
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.learn(docs, flipped)
    assert again[0].keys() == model[0].keys() and np.allclose(list(again[0].values()), list(model[0].values()))
    nothing = toxicity.learn(docs, labels.filter("toxic = 0"))
    assert toxicity.scored(docs, nothing).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.scored(docs.limit(0), model).count() == 0


# ------------------------------------------------------------------ pipeline

def test_every_operator_has_its_query():
    names = catalog.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(catalog.oracle_sql()) <= set(names)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), f"test-{name}")
        seen[name] = docs
        assert name == "encode" or docs.columns == columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["encode"] == ids["mix"] <= ids["secrets"] == ids["near_duplicates"] < ids["quality"]
    assert not seen["secrets"].filter(F.col("text").rlike("[0-9a-f]{16}")).count()
    assert seen["mix"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    bpe = Tokenizer.from_file(pair_index.vocabulary_path())
    texts = {r.doc_id: r.text for r in seen["mix"].collect()}
    assert all(r.ids == bpe.encode(texts[r.doc_id], add_special_tokens=False).ids for r in seen["encode"].limit(40).collect())
    assert corpus_pipeline.run(spark, sf_dir).count() == seen["encode"].count()


def test_pipeline_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, 0), (3, "w " * 50000, None, "s", 9)]
    rows += [(4, " ".join(f"w{i}x{i * i}" for i in range(90)), "en", "s", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = corpus_pipeline.written(stage(spark, frame, ""), "test-odd")
        assert {r.doc_id for r in frame.collect()} <= {4}
