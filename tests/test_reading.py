"""Reading answers in one pass: a plain record is told by its schema, all else field by field."""
import json

import pytest
from pyspark.sql import functions as F

from tallyfolio.functions import records as R
from tallyfolio.operators import cascade as C
from tallyfolio.schemas import ATTEMPTS

LINE = {"description": "a", "amount": 1.5}
PLAIN = [
    {}, {"total": 1}, {"line_items": []}, {"total": 1.25, "line_items": [LINE, {"description": "b", "quantity": 2}]},
    {"vendor": None, "tax": None, "extra": 0.9, "line_items": [{"description": "b", "amount": None, "note": "x"}]},
    {"total": 1e300, "subtotal": True, "invoice_number": "STRING, total: VOID"}]
OTHER = [
    {"vendor": 5}, {"total": "12.50"}, {"total": "x"}, {"line_items": None}, {"line_items": 3}, {"line_items": [None]},
    {"line_items": [LINE, {"amount": 2}]}, {"line_items": [LINE, {"description": None}]}, {"line_items": [LINE, 5]},
    {"line_items": [{"description": 5}]}, {"line_items": [{"description": "a", "amount": "1_000.5"}]},
    {"line_items": [{"description": "a", "amount": [1]}]}, {"total": {"vendor": "a"}}, {"more": {"total": 1}},
    {"line_items": [{"meta": {"description": "a"}, "amount": 1}]}, {"odd key": 1}, {"a: STRING, vendor": "x", "vendor": 5}, [], 5, "x"]


def slowly(df):
    """As it was read before: every field asked for its type, then the record."""
    df = df.withColumn("_doc", R.parse_response(F.col("v"))).withColumn("fault", R.response_fault("_doc"))
    return df.withColumn("invoice", F.when(F.col("fault").isNull(), R.response_invoice("_doc", "v")))


def test_one_pass_reads_what_field_by_field_reads(spark):
    df = spark.createDataFrame([(json.dumps(x),) for x in PLAIN + OTHER] + [("",), (None,), ("{",), ("null",)], "v string")
    want = slowly(df).select("v", "fault", "invoice").collect()
    assert [(r.fault is None, r.invoice is None) for r in want[:len(PLAIN)]] == [(True, False)] * len(PLAIN)
    assert R.conform(df, "v").select("v", "fault", "invoice").collect() == want


@pytest.mark.parametrize("text, plain", [(x, True) for x in PLAIN] + [(x, False) for x in OTHER])
def test_what_is_plain(spark, text, plain):
    df = spark.createDataFrame([(json.dumps(text),)], "v string").select(R.parse_response(F.col("v")).alias("d"))
    df = df.withColumn("r", R.response_read("d"))
    assert df.select(R.response_is_plain("d", "r")).first()[0] is plain


def test_fields_not_asked_for_are_checked_but_not_read(spark):
    rows = [("j", "tier-1", "extract", i, json.dumps(x), None, None, 1.0, 1, 1) for i, x in enumerate(
        [{"total": 3.0, "vendor": "v", "line_items": [LINE, {"description": "GST", "amount": 0.5, "quantity": 1}]}, {"total": 1, "vendor": 5}])]
    calls = C.read_calls(spark.createDataFrame(rows, ATTEMPTS), ("total", "n_items"))
    assert R._layout(("total", "n_items")).simpleString() == "struct<tax:double,total:double,line_items:array<struct<description:string,amount:double>>>"
    got = {r.attempt_no: r for r in calls.collect()}
    assert got[0].invoice.asDict() == {"read": True, "total": 3.0, "n_items": 2} and len(got[0].warnings) == 1
    assert (got[1].fault, got[1].invoice, got[1].warnings) == ("vendor", None, None)


def test_escalation_reads_before_it_shuffles(spark):
    def call(job, tier, x):
        return (job, tier, "extract", 1, json.dumps(x), None, None, 1.0, 1, 1)
    rows = [call("a", "tier-1", {"total": 1}), call("b", "tier-1", {"total": "x"}), call("b", "tier-2", {"total": 2}),
            call("c", "tier-1", {"vendor": 5}), call("c", "tier-2", []), call("d", "tier-1", {"total": "x"})]
    attempts = spark.createDataFrame(rows, ATTEMPTS)
    r, want = C.read_extraction(attempts, fields=("total",)), C.resolve_extraction(C.resolve_calls(attempts))
    shown = ["job_id", "read_tier", "read_error", "waiting", F.col("read_invoice.total").alias("total")]
    assert r.select(*shown).orderBy("job_id").collect() == want.select(*shown).orderBy("job_id").collect()
    shuffled = [x for x in r._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert shuffled and "response_json" not in "".join(shuffled)
    above = r._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    assert "try_parse_json" not in above and "parseJson" not in above
