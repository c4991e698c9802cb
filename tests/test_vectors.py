"""Near vectors: blocks and index cells against plain numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfolio.operators import vectors as V


def made(n=1500, d=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    hot = rng.random(n) < 0.35
    x = np.where(hot[:, None], centres[0], centres[rng.integers(0, 12, n)]) + rng.normal(size=(n, d)) * 0.3
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]


def plain(rows, queries, k=5):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q, v in queries:
        v = np.array(v) / np.linalg.norm(v)
        s = np.round((m * v).sum(axis=1), 12)
        out[q] = [int(ids[j]) for j in np.lexsort((ids, -s))[:k]]
    return out


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def table(spark, rows):
    bad = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [float("nan")] + [1.0] * 7), (9005, [None] + [1.0] * 7), (None, [1.0] * 8),
           (9006, [1.0] * 3)]
    return spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").withColumn("row", F.lit("x")).repartition(4)


@pytest.fixture(scope="module")
def queries(table):
    return table.filter("vec_id % 20 = 0 AND vec_id < 9000").select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.mark.parametrize("block, group", [(V.BLOCK_ROWS, V.GROUP_ROWS), (200, 16)])
def test_blocks_equal_brute_force(table, queries, rows, block, group):
    got = told(V.nearest_to(table, queries, block_rows=block, group_rows=group))
    assert got == plain(rows, [r for r in rows if r[0] % 20 == 0])


def test_identical_vectors_go_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(40)], "vec_id bigint, embedding array<double>").repartition(7)
    asked = spark.createDataFrame([(1, [2.0, 4.0, 6.0])], "query_id bigint, embedding array<double>")
    assert told(V.nearest_to(df, asked, block_rows=9)) == {1: [0, 1, 2, 3, 4]}


def test_index_exact_and_probed(spark, tmp_path, table, queries, rows):
    index = V.VectorIndex.fit(table, str(tmp_path), 16, sample=600)
    for batch in (0, 1, 1):
        index.append(table.filter(F.col("vec_id") % 2 == batch), batch)
    assert index.rows().count() == len(rows)
    want = plain(rows, [r for r in rows if r[0] % 20 == 0])
    assert told(index.search(queries, probes=1, exact=True)) == want
    assert told(index.search(queries, probes=2, exact=True, block_rows=100, group_rows=20)) == want
    near = index.search(queries, probes=4)
    hits = V.recall(near, V.nearest_to(table, queries)).agg(F.sum("hits") / F.sum("n")).first()[0]
    assert hits >= 0.9
    # An exact search leaves cells unread that cannot hold anything better.
    read = index.cells().count()
    assert read == 16 and index.cells().agg(F.sum("n")).first()[0] == len(rows)


def test_index_grows_by_batches(spark, tmp_path, table, queries, rows):
    index = V.VectorIndex.fit(table.filter("vec_id < 500"), str(tmp_path), 8)
    assert index.centres.shape == (8, 8)
    index.append(table.filter("vec_id < 500"), 0)
    first = told(index.search(queries, exact=True))
    assert first == plain(rows[:500], [r for r in rows if r[0] % 20 == 0])
    index.append(table.filter("vec_id >= 500 AND vec_id < 9000"), 1)
    assert told(index.search(queries, exact=True)) == plain(rows, [r for r in rows if r[0] % 20 == 0])


def test_nothing(spark, tmp_path, table, queries):
    assert V.nearest_to(table.limit(0), queries).count() == 0
    assert V.nearest_to(table, queries.limit(0)).count() == 0


def test_probes_of_the_registered_index_recall_nine_of_ten(spark):
    from tallyfolio.plans import ladder
    found = ladder.vector_probe_recall(spark, "/root/testdata/sf0.01").agg(F.sum("hits") / F.sum("n")).first()[0]
    assert found >= 0.9


def test_the_sample_bounds_the_centres(tmp_path, table, queries, rows):
    """Cells beyond what the sample can place are not asked for; every row is indexed and found all the same."""
    index = V.VectorIndex.fit(table, str(tmp_path), 500, sample=200)
    assert len(index.centres) <= 200 // V.ROWS_PER_CENTRE
    index.append(table, 0)
    assert index.rows().count() == len(rows)
    assert told(index.search(queries, probes=2, exact=True, block_rows=100)) == plain(rows, [r for r in rows if r[0] % 20 == 0])
