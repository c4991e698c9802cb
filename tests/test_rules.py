"""Record rules on literal rows: gate, normal forms, tax, reconciliation, conformance."""
import base64
import json

import pytest
from pyspark.sql import functions as F

from tallyfolio.functions import money as M, records as R, text as X
from tallyfolio.schemas import INVOICE


def column(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def invoice(total=None, items=(), **fields):
    row = {n: None for n in INVOICE.names}
    row.update(fields, total=total, line_items=[
        {"description": d, "quantity": None, "unit_price": None, "amount": a} for d, a in items])
    return row


def records(spark, *rows):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("inv", INVOICE)])
    return spark.createDataFrame(list(enumerate(rows)), schema)


def test_text_gate(spark):
    texts = ["INVOICE Number INV-1 Total: $100.00", "short", None, "    padded  \n" + " " * 40,
             "\x01" * 30 + "readable", "a" * 12 + "é" * 8, "a" * 11 + "é" * 9]
    assert column(spark, texts, X.is_usable_text) == [True, False, False, False, False, True, False]


def test_normal_strings(spark):
    assert column(spark, [None, " Acme,  Corp. ", "A@B.com", "***"], X.norm_str) == ["", "acme corp.", "a@b.com", ""]
    assert column(spark, ["", "a b a"], X.tokens) == [[], ["a", "b"]]


def test_normal_currency_keeps_its_traps(spark):
    given = [None, "CA$", "c$", "$", "US$", "eur ", "CASH", "AUS", "¥", "£ 5"]
    assert column(spark, given, X.norm_currency) == ["", "CAD", "CAD", "USD", "USD", "EUR", "CAD", "USD", "¥", "£ 5"]


def test_normal_dates(spark):
    given = [None, "2025-06-17", "on 2025-99-17.", "June 17, 2025", "Jul 01 2025", "6/17/25", "6/7/2025",
             "Room 12, 2025", "Room 12, 2025 on 6/17/25", " Soon ", "1/2/123"]
    assert column(spark, given, X.norm_date) == [
        "", "2025-06-17", "2025-99-17", "2025-06-17", "2025-07-01", "2025-06-17", "2025-06-07",
        "room 12, 2025", "2025-06-17", "soon", "0123-01-02"]


def test_money_equal(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (2.0, 2.005), (1.01, 1.0), (5.0, 5.02)], "a double, b double")
    got = [r[0] for r in df.select(M.money_eq(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, True, abs(1.01 - 1.0) <= 0.01, False]


def test_names_and_sources(spark):
    assert column(spark, ["case.pdf#page=2", "x", "page=1&page=7"], X.page_number) == [2, None, 7]
    assert column(spark, ["/a/b.c.json", "b", "/x/.hidden"], X.file_stem) == ["b.c", "b", ".hidden"]
    assert column(spark, ["True", "false", None], X.as_bool) == [True, False, None]
    content = bytes(range(256)) * 2
    uri = column(spark, [content], X.data_uri, "v binary")[0]
    assert uri == "data:image/png;base64," + base64.b64encode(content).decode()


def test_plain_numbers(spark):
    given = [100.0, 64.46, None, 12345678.5, 10000000.0, -20000000.25]
    assert column(spark, given, M.plain_number, "v double") == [
        "100.0", "64.46", "None", "12345678.5", "10000000.0", "-20000000.25"]


def test_tax_lines(spark):
    given = ["GST (5%)", "tps", "Sales Tax", "gstx", "taxi", None, "VAT"]
    assert column(spark, given, R.is_tax_line) == [True, True, True, False, False, False, True]


def test_tax_is_derived_from_its_lines(spark):
    rows = records(
        spark, invoice(64.46, [("TVQ", 4.64), ("TPS", 2.32), ("Tip", 11.03)], tax=11.03),
        invoice(10.0, [("TVQ", 4.64)], tax=4.645), invoice(10.0, [("Tip", 3.0)], tax=9.0),
        invoice(10.0, [("VAT", None)], tax=9.0), invoice(10.0, [("VAT", 1.5)]), invoice(1.0, []))
    got = [r[0] for r in rows.orderBy("i").select(R.normalize(F.col("inv"))["tax"]).collect()]
    assert got == [6.96, 4.645, 9.0, 9.0, 1.5, None]


RECEIPT = [3.17, 19.12, 11.79, 1.00, 6.00, 4.49, 0.90, 11.03, 4.64, 2.32]


def test_reconcile(spark):
    lines = [("x", a) for a in RECEIPT]
    rows = records(
        spark, invoice(64.46, lines), invoice(53.43, [("a", 64.46), ("b", 19.12), ("c", 47.06)]),
        invoice(99.0, []), invoice(100.0, [("a", 50.0), ("b", 49.99)]), invoice(None, lines),
        invoice(5.0, [("a", None)]), invoice(-42.5, [("a", -42.5)]))
    got = [r[0] for r in rows.orderBy("i").select(R.reconcile(F.col("inv"))).collect()]
    assert [len(w) for w in got] == [0, 1, 0, 0, 0, 0, 0]
    assert got[1][0].startswith("line items sum to 130.64 but the total is 53.43")


VALID = {"invoice_number": "INV-1", "total": 100.0, "line_items": [{"description": "a", "amount": 1}]}


@pytest.mark.parametrize("given, fault", [
    (VALID, None), ({"total": 5}, None), ({**VALID, "total": -42.5}, None), ({"vendor": "x"}, None),
    ({}, None), ({"extra": [1], "total": 1}, None), ({"total": "46.11"}, None), ({"total": " 1e3 "}, None),
    ({"total": True}, None), ({"total": None, "vendor": None}, None),
    ({"total": "N/A"}, "total"), ({"vendor": 5}, "vendor"), ({"tax": {}}, "tax"), ({"total": ""}, "total"),
    ({"line_items": None}, "line_items"), ({"line_items": "x"}, "line_items"),
    ({"line_items": [{"amount": 1}]}, "line_items: description"),
    ({"line_items": [{"description": None}]}, "line_items: description"),
    ({"line_items": [{"description": "a", "amount": "x"}]}, "line_items: amount"),
    ({"line_items": [5]}, "line_items: not an object"), ([1], "not an object"), ("text", "not an object")])
def test_conformance(spark, given, fault):
    df = spark.createDataFrame([(json.dumps(given),)], "v string")
    row = R.conform(df, "v").first()
    assert row.fault == fault
    assert (row.invoice is None) == (fault is not None)


def test_conformance_of_broken_text(spark):
    df = spark.createDataFrame([("",), (None,), ("{",), ('{"total": 1',)], "v string")
    assert [r.fault for r in R.conform(df, "v").collect()] == ["not JSON"] * 4


def test_conforming_values_are_typed(spark):
    text = json.dumps({"total": "46.11", "tax": 2, "line_items": [{"description": "a", "amount": "1.5"}]})
    row = R.conform(spark.createDataFrame([(text,)], "v string"), "v").first().invoice
    assert (row.total, row.tax, row.vendor, row.line_items[0].amount) == (46.11, 2.0, None, 1.5)
    again = R.conform(spark.createDataFrame([('{"total":1}',)], "v string"), "v").first().invoice
    assert again.line_items == []


def test_sums_of_a_record_are_folded_once(spark):
    """Each sum over the lines is one fold in the plan, however often the rules look at it."""
    df = spark.createDataFrame([], "r " + INVOICE.simpleString())
    for rule in (R.normalize, R.reconcile):
        plan = df.select(rule(F.col("r")).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("aggregate(") == 1


def test_numbers_joined_by_a_low_line_are_read(spark):
    texts = [('{"total":"1_0.5","line_items":[{"description":"a","amount":" 2_0 "}]}',), ('{"total":"3.5","line_items":[{"description":"a_1"}]}',)]
    rows = R.conform(spark.createDataFrame(texts, "v string"), "v").collect()
    assert [r.fault for r in rows] == [None, None]
    assert [r.invoice.total for r in rows] == [10.5, 3.5] and rows[0].invoice.line_items[0].amount == 20.0
