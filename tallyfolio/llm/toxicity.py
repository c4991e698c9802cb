"""Toxicity scores from confirmed toxic examples and unlabelled text (nnPU learning).

Labels that say "not toxic" are not used: the learner sees confirmed toxic documents and a
sample of unlabelled ones, and minimises the non-negative positive-unlabelled risk of Kiryo et
al. (2017),

    prior * E_pos[loss(f, +)] + max(0, E_unl[loss(f, -)] - prior * E_pos[loss(f, -)]),

where the prior is the share of toxic rows among the labelled ones of the training folds. When
the second term turns negative the step goes against it instead. The classifier is linear over
words and word beginnings that stand out in the toxic documents; it is fitted with numpy.

The sample is bounded by ``POSITIVES`` and ``UNLABELLED``, the vocabulary by ``VOCABULARY``: so
is what reaches the driver. Candidate words are counted where the sampled texts lie, summed
per batch before the shuffle. Scoring is one pass over every whole text.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out: neither their labels nor their texts
are learnt from. Defined results: a null or blank text gets the score of no words; very long texts
are scored whole; repeated rows score alike, and equal scores are left equal; only id, text and
``toxic`` are looked at, whatever other columns are called; an empty table gives an empty one; without any confirmed toxic row all scores are 0; null labels are unlabelled.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfolio.llm.common import documents, written

FOLDS = 5
POSITIVES = 4000
UNLABELLED = 8000
VOCABULARY = 1024
# A feature enters if it is this much more frequent in toxic documents than by chance, and if
# by the prior most documents that hold it are toxic.
LEAST_DOCS = 2
LEAST_Z = 4.0
LEAST_SHARE = 0.5
STEPS = 300
STEEPEST = 0.3
RIDGE = 1e-4
_WORDS = re.compile(r"[^\W\d_]{3,}")
_BEGINNINGS = (4, 5, 6)
# How often a beginning occurs tells a habit from a chance word.
LEVELS = 3


def features(text: str | None) -> set[str]:
    """Distinct words of a whole text, and word beginnings with one star per occurrence, up to three."""
    words = Counter(_WORDS.findall((text or "").lower()))
    found = set(words)
    for n in _BEGINNINGS:
        starts: Counter = Counter()
        for w, k in words.items():
            if len(w) > n:
                starts[w[:n]] += k
        for level in range(1, LEVELS + 1):
            found.update([p + "*" * level for p, k in starts.items() if k >= level])
    return found


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


# ------------------------------------------------------------------ learning

def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS,
        rate: float = STEEPEST, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier with the smallest nnPU risk (Adam steps)."""
    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))

    def softplus(z: np.ndarray) -> np.ndarray:
        return np.logaddexp(0.0, z)

    n = positive.shape[1]
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        fp, fu = positive @ w + b, unlabelled @ w + b
        # Slopes of the three risk terms in the scores.
        plus = -sigmoid(-fp) / len(fp)
        minus_p, minus_u = sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
        negative = softplus(fu).mean() - prior * softplus(fp).mean()
        grad_n = np.append(unlabelled.T @ minus_u - prior * (positive.T @ minus_p),
                           minus_u.sum() - prior * minus_p.sum())
        if negative >= 0:
            grad = grad_n + prior * np.append(positive.T @ plus, plus.sum())
        else:
            grad = -grad_n
        grad[:n] += ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        move = rate / np.sqrt(step) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, b = w - move[:n], b - float(move[n])
    return w, b


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per feature among the positive and the unlabelled ones of a batch."""
    for batch in batches:
        totals = Counter(), Counter()
        for text, positive in zip(batch.column("text"), batch.column("positive").to_pylist()):
            totals[positive].update(features(text.as_py()))
        names = list(totals[0].keys() | totals[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *[pa.array([t[x] for x in names], pa.int64()) for t in totals]],
            ["feature", "unlabelled", "positive"])


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
           fold_of=fold) -> DataFrame:
    """(text, positive) of the training documents: ids with the smallest hashes, up to the bounds.

    The chosen ids are few by construction and are broadcast; texts are not shuffled.
    """
    first = [F.xxhash64(F.col("doc_id")), F.col("doc_id")]
    train = F.coalesce(fold_of(F.col("doc_id")) != 0, F.lit(False))
    toxic = labels.filter(train & (F.col("toxic") == 1)).select("doc_id").distinct()
    positive = toxic.orderBy(*first).limit(positives).withColumn("positive", F.lit(1))
    # The hash is salted, so that the unlabelled are not the same few documents.
    other = docs.filter(train).select("doc_id").orderBy(F.xxhash64(F.col("doc_id"), F.lit(1)), "doc_id").limit(unlabelled)
    chosen = positive.union(other.distinct().withColumn("positive", F.lit(0)))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "positive")


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
          fold_of=fold) -> tuple[dict[str, float], float]:
    """Weights by feature and the bias, from (doc_id, text) and (doc_id, toxic)."""
    train = labels.filter(F.coalesce(fold_of(F.col("doc_id")) != 0, F.lit(False)) & F.col("toxic").isNotNull())
    known = train.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("int")).alias("toxic")).first()
    if not known["toxic"]:
        return {}, -40.0
    prior = min(max(known["toxic"] / known["n"], 1e-4), 0.99)
    texts = written(sample(docs, labels, positives, unlabelled, fold_of), "toxicity-sample")
    n = {r["positive"]: r["n"] for r in texts.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_pos, n_unl = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_unl:
        return {}, float(np.log(prior / (1 - prior)))
    share_p, share_u = F.col("positive") / n_pos, F.col("unlabelled") / n_unl
    pooled = (F.col("positive") + F.col("unlabelled")) / (n_pos + n_unl)
    z = (share_p - share_u) / F.sqrt(pooled * (1 - pooled) * (1 / n_pos + 1 / n_unl) + 1e-12)
    counted = texts.mapInArrow(_counts, "feature string, unlabelled bigint, positive bigint").groupBy("feature").agg(
        F.sum("unlabelled").alias("unlabelled"), F.sum("positive").alias("positive"))
    telling = prior * share_p >= LEAST_SHARE * share_u
    chosen = (counted.withColumn("z", z)
              .filter((F.col("positive") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z) & telling)
              .orderBy(F.col("z").desc(), "feature").limit(VOCABULARY).select("feature").collect())
    names = [r["feature"] for r in chosen]
    place = {f: i for i, f in enumerate(names)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(place[f] for f in features(t.as_py()) & place.keys()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(rows, pa.list_(pa.int32()))],
                                             ["positive", "hits"])

    table = texts.mapInArrow(hits, "positive int, hits array<int>").toArrow()
    grids = []
    for kind in (1, 0):
        rows = sorted(h for h, p in zip(table["hits"].to_pylist(), table["positive"].to_pylist()) if p == kind)
        grid = np.zeros((len(rows), len(names)), np.float32)
        for i, row in enumerate(rows):
            grid[i, row] = 1
        grids.append(grid)
    w, b = fit(*grids, prior)
    return dict(zip(names, w.tolist())), b


# ------------------------------------------------------------------ scoring

def scored(docs: DataFrame, model: tuple[dict[str, float], float], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, score): the probability of each whole text to be toxic."""
    weights, bias = model
    words = {f: w for f, w in weights.items() if not f.endswith("*")}
    # Per beginning the weight of one, two, ... occurrences.
    starts: dict[int, dict[str, list[float]]] = {n: {} for n in _BEGINNINGS}
    for f, w in weights.items():
        if f.endswith("*"):
            start = f.rstrip("*")
            levels = starts[len(start)].setdefault(start, [0.0] * (LEVELS + 1))
            for k in range(len(f) - len(start), LEVELS + 1):
                levels[k] += w
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def score(text: str | None) -> float:
        found = Counter(_WORDS.findall((text or "").lower()))
        total = bias + sum([words[w] for w in found.keys() & words.keys()])
        for n, known in starts.items():
            seen: dict[str, int] = {}
            for w, k in found.items():
                if w[:n] in known and len(w) > n:
                    seen[w[:n]] = seen.get(w[:n], 0) + k
            total += sum([known[p][min(k, LEVELS)] for p, k in seen.items()])
        return float(1.0 / (1.0 + np.exp(-min(max(total, -40.0), 40.0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return scored(docs, learn(docs, labels)).select(
        F.col("id").alias("doc_id"), (fold(F.col("id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
