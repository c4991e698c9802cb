"""Pages, names, routing, confidence, text reading, gold files, retention."""
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyfolio.functions.scoring import FIELD_WEIGHTS
from tallyfolio.operators import pages as P
from tallyfolio.operators.textread import read_text
from tallyfolio.sources import documents as D, gold as G

PAGES = "doc_id int, filename string, text string, pages array<struct<page_index int, text string, ink double, png binary>>"


def docs(spark, *rows):
    return spark.createDataFrame([
        (i, name, text, [(p, f"page {p}", ink, b"png%d" % p) for p, ink in enumerate(inks)])
        for i, (name, text, inks) in enumerate(rows)], PAGES)


def test_split_keeps_content_pages(spark):
    d = docs(spark, ("a.b.pdf", "", [0.2, 0.0, 0.3]), ("scan", "", [0.5, 0.5]), (None, "", [0.0, 0.005, 0.005]),
             ("one.pdf", "", [0.4]), (None, "", [0.4, 0.4]))
    got = {}
    for r in P.split_documents(d.drop("text")).orderBy("doc_id", "page_index").collect():
        got.setdefault(r.doc_id, []).append((r.page_index, r.page_name))
    assert got == {0: [(0, "a.b_p0.pdf"), (2, "a.b_p2.pdf")], 1: [(0, "scan_p0.scan"), (1, "scan_p1.scan")],
                   2: [(1, "document.pdf")], 3: [(0, "one.pdf")], 4: [(0, "document_p0.pdf"), (1, "document_p1.pdf")]}
    summary = P.ingest_summary(d.drop("text")).orderBy("doc_id").first()
    assert (summary.document, summary.invoices, [j.page for j in summary.jobs]) == ("a.b.pdf", 2, [0, 2])


def test_pages_as_rows_agree_with_nested_pages(spark):
    rng = random.Random(3)
    rows = [(None, "", [rng.choice([0.0, 0.005, 0.01, 0.2]) for _ in range(rng.randint(1, 5))]) for _ in range(60)]
    d = docs(spark, *rows)
    flat = d.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_index", "p.ink")
    nested = {(r.doc_id, r.page_index, r.n_invoices) for r in P.split_documents(d.drop("text")).collect()}
    assert nested == {(r.doc_id, r.page_index, r.n_invoices) for r in P.keep_content_rows(flat, "doc_id").collect()}


def test_routing(spark):
    d = docs(spark, ("t", "INVOICE Total: $100.00 and more", [0.1]), ("v", "", [0.1, 0.3, 0.001]),
             ("blank", None, [0.001, 0.002]), ("none", "", []))
    got = {r.filename: r for r in P.route(d).collect()}
    assert [got[n].reader for n in ("t", "v", "blank", "none")] == ["text", "vision", "vision", None]
    assert [p.page_index for p in got["v"].images] == [1, 0] and [p.page_index for p in got["blank"].images] == [1]
    assert got["none"].route_error == "scanned PDF produced no renderable pages"
    given = {r.doc_id: r for r in P.reader_input(P.route(d)).collect()}
    assert given[0].image_uri is None and given[1].text is None and len(given) == 3
    assert given[1].image_uri.startswith("data:image/png;base64,")


def test_document_text_is_in_page_order(spark):
    d = docs(spark, ("a", "", [0.1, 0.1, 0.1])).withColumn("pages", F.reverse("pages"))
    assert d.select(P.document_text(F.col("pages"))).first()[0] == "page 0\npage 1\npage 2"


def test_ink(spark):
    rasters = [b"", b"\xff" * 6 + b"\x00" * 2, b"\x80\xfe", b"\xff"]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rasters)], "i int, r binary")
    assert [r[0] for r in df.orderBy("i").select(P.ink_ratio(F.col("r"))).collect()] == [0.0, 0.25, 1.0, 0.0]


def test_confidence(spark):
    df = spark.createDataFrame([(1, 80), (1, -1), (1, 60), (2, -1), (3, 69)], "doc_id int, conf int")
    got = {r.doc_id: (r.mean_conf, r.path) for r in P.mean_confidence(df).withColumn(
        "path", P.by_confidence(F.col("mean_conf"))).collect()}
    assert got == {1: (70.0, "ocr"), 2: (0.0, "vlm"), 3: (69.0, "vlm")}


def test_intake(spark):
    df = spark.createDataFrame([(1, bytearray(b"")), (2, bytearray(b"x")), (3, None), (4, bytearray(b"?"))], "i int, content binary")
    intake = P.with_intake(df, F.when(F.col("i") == 4, "encrypted"))
    assert {r.i: r.reject_reason for r in P.rejected(intake).collect()} == {
        1: "empty file", 3: "empty file", 4: "could not read PDF: encrypted"}
    assert [r.i for r in P.accepted(intake).collect()] == [2]


TEXT = """Ride receipt
Date: June 17, 2025
Vendor: Rides
Bill To: Ada

Base Fare   CA$3.17
Distance  19.12
Subtotal  22.29
Booking Fee  1,006.00
Promo discount  6.00
Tip  11.03
TPS  2.32
TVQ  4.64
Page total  999.00
Total Paid  CA$1,040.28
Paid with: Visa 4043"""


def test_text_rules(spark):
    inv = read_text(spark.createDataFrame([(TEXT,)], "text string")).first().invoice
    assert (inv.invoice_number, inv.invoice_date, inv.vendor, inv.bill_to) == (None, "June 17, 2025", "Rides", "Ada")
    assert (inv.currency, inv.subtotal, inv.tax, inv.total, inv.payment_method) == ("CAD", 22.29, 6.96, 1040.28, "Visa 4043")
    assert [(i.description, i.amount) for i in inv.line_items] == [
        ("Base Fare", 3.17), ("Distance", 19.12), ("Booking Fee", 1006.0), ("Promo discount", -6.0), ("Tip", 11.03),
        ("TPS", 2.32), ("TVQ", 4.64)]


def test_text_without_anything(spark):
    inv = read_text(spark.createDataFrame([("nothing here",)], "text string")).first().invoice
    assert inv.line_items == [] and all(inv[n] is None for n in FIELD_WEIGHTS)


def test_gold_files(spark, tmp_path):
    for name, page in (("b_ride", 0), ("a_rent", 1)):
        (tmp_path / f"{name}.json").write_text(json.dumps({
            "source": f"set.pdf#page={page}", "doc_type": "receipt",
            "invoice": {"total": 5.0, "line_items": [{"description": "x", "amount": 5.0}]}}, indent=1))
    gold = G.read_gold(spark, str(tmp_path))
    rows = gold.orderBy("doc").collect()
    assert [(r.doc, r.page, r.notes, r.invoice.total) for r in rows] == [("a_rent", 1, "", 5.0), ("b_ride", 0, "", 5.0)]
    pages = spark.createDataFrame([(0, "x"), (1, "y")], "page int, image string")
    assert G.check_pages(gold, pages).count() == 2
    with pytest.raises(ValueError, match="1 gold records"):
        G.check_pages(gold, pages.filter("page = 0"))


def test_files_are_read_and_retained(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF")
    d = D.read_files(spark, str(tmp_path / "in"), "*.pdf").withColumn("job_id", F.lit("j1"))
    other = d.withColumn("job_id", F.lit("j2"))
    for batch, docs_ in ((1, d), (2, other), (1, d)):  # another batch of the day stays, a repeated one leaves one copy
        D.retain(docs_, str(tmp_path / "out"), "/documents", F.lit("2025-01-01"), batch)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("path").collect()
    assert [(r.path, bytes(r.content)) for r in rows] == [("/documents/j1/a.pdf", b"%PDF"), ("/documents/j2/a.pdf", b"%PDF")]
