"""Redaction, resubmissions, rules classifier, chunks, parties, links, vectors, text classifier."""
import random

import pytest
from pyspark.sql import functions as F

from tallyfolio.operators import intake as I, parties as P, similar as N
from tallyfolio.operators.score import pair_with_labels


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")


def test_redaction(spark):
    df = texts(spark, "mail a.b@c.example.org or +1 (659) 555-3949 from 10.0.0.7, card 4111 1111-11111111", None, "plain")
    assert [r.t for r in df.select(I.redact(F.col("text")).alias("t")).collect()] == [
        "mail [EMAIL] or [PHONE] from [IP], card [CARD]", None, "plain"]


def test_only_the_first_of_equal_documents_is_read(spark):
    df = texts(spark, *["same"] * 40, "other", "", None)
    got = {r.doc_id: (r.first_id, r.n_copies, r.resubmitted) for r in I.resubmissions(df, F.coalesce("text", F.lit(""))).collect()}
    assert got[0] == (0, 40, False) and got[39] == (0, 40, True) and got[40] == (40, 1, False) and got[42] == (41, 2, True)


def test_rules_name_what_fired(spark):
    df = texts(spark, "Invoice No. INV-2024-0042 Bill To: Acme Subtotal $420.00 Total Due $462.00",
               "This Service Agreement is made. WHEREAS the parties; WHEREAS an invoice; governing law",
               "From: a\nTo: b\nSubject: c\nplease find attached", "nothing here", None)
    got = [(r.kind, r.score, r.fired) for r in I.classify(df, "text").orderBy("doc_id").collect()]
    assert [g[0] for g in got] == ["invoice", "contract", "email", "unknown", "unknown"]
    assert got[0][1] == 5 + 3 + 3 + 2 + 4 + 2 and got[1][2] == ["agreement", "whereas", "governing law"] and got[4][1:] == (0, [])


def test_chunks_hold_every_word_once(spark):
    rng = random.Random(1)
    rows = ["\n".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 23))) for _ in range(4)) for _ in range(20)]
    df = texts(spark, *rows, None)
    got = I.page_chunks(df, "text", ["doc_id"], 7).orderBy("doc_id", "page", "chunk").collect()
    for i, row in enumerate(rows):
        assert " ".join(r.chunk_text for r in got if r.doc_id == i).split() == row.split()
    assert max(len(r.chunk_text.split()) for r in got) <= 7


def test_parties(spark):
    df = spark.createDataFrame([("Acme Corp.",), ("ACME",), ("acme, Inc",), ("Acme Works",), (None,), ("Company Co",)], "name string")
    got = {r.name: (r.party_key, r.canonical) for r in P.resolve_parties(df).collect()}
    assert {got[n][1] for n in ("Acme Corp.", "ACME", "acme, Inc")} == {"ACME"} and got["Acme Works"][1] == "Acme Works"
    assert len(got) == 5


def test_links_go_to_the_first_document(spark):
    df = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "x"), ("d", None), ("e", "k")], "doc_id string, po string")
    assert {(r.doc_id, r.first_doc, r.n_docs) for r in P.link_documents(df, "po").collect()} == {("a", "a", 3), ("b", "a", 3), ("e", "a", 3)}


def test_nearest_and_vote(spark):
    rows = [(i, [float(i % 7), float(i % 5) + 1, 1.0], i % 3) for i in range(60)] + [(99, None, 1)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    near = N.nearest_to(v.filter("embedding IS NOT NULL"), [(1, [1.0, 1.0, 0.0])], 5)

    def cos(e):
        return (e[0] + e[1]) / (sum(x * x for x in e) * 2) ** 0.5
    want = sorted((-round(cos(e), 9), i) for i, e, _ in rows[:60])[:5]
    assert [(r.vec_id) for r in near.orderBy("rank").collect()] == [i for _, i in want]
    votes = [dict((i, y) for i, _, y in rows)[i] for _, i in want]
    assert N.vote(near).first().label == min(set(votes), key=lambda y: (-votes.count(y), y))


def test_text_classifier_on_held_out_documents(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = [rng.choice("red green blue tree house".split()) for _ in range(12)]
        label = i % 2
        rows.append((i, " ".join(words + (["bad"] if label else ["good"])), label))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = N.fit_text_classifier(df.filter("doc_id < 300"), features=256)
    held = N.score_texts(model, df.filter("doc_id >= 300")).collect()
    assert sum(r.predicted == r.label for r in held) / len(held) > 0.95
    assert N.score_texts(model, df.limit(1).withColumn("text", F.lit(None).cast("string"))).count() == 1


def test_predictions_and_labels_that_lack_each_other(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, pred int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "k string, gold int")
    assert {(r.k, r.state) for r in pair_with_labels(a, b, "k").collect()} == {("x", "prediction only"), ("y", "both"), ("z", "label only")}
