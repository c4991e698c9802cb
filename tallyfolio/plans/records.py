"""Registered queries over invoice records: rules, conformance, cascade, scoring, text reading."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfolio.functions.records import conform, itemised_tax, line_sum, normalize, reconcile
from tallyfolio.functions.scoring import (
    FIELD_WEIGHTS, field_correct, item_f1, item_precision, item_recall, matched_items)
from tallyfolio.functions.text import norm_currency, norm_date, norm_str
from tallyfolio.operators import cascade as C
from tallyfolio.operators.extract import CallError, Reply, call_model, run_cascade
from tallyfolio.operators.ledger import reconcile_ledger
from tallyfolio.operators.score import field_accuracy as field_accuracy_of, metric, score_records
from tallyfolio.operators.textread import read_text
from tallyfolio.plans import tables as T
from tallyfolio.session import scratch_path


def text(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(""))


# ------------------------------------------------------------------ flat tables

def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines per line item: the goods at their net price, and their tax where there is any."""
    b = T.bills(spark, sf_dir)
    rows = F.array_compact(F.array(
        F.struct(F.col("goods_label").alias("description"), T.dollars(F.col("net_c")).alias("amount")),
        F.when(F.col("tax_c") > 0, F.struct(F.col("tax_label").alias("description"),
                                            T.dollars(F.col("tax_c")).alias("amount")))))
    return b.select(F.col("k").alias("doc_id"), F.explode(rows).alias("r")).select("doc_id", "r.*")


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as printed: their total, and a tax only urgent ones state."""
    total_c = T.cents(F.col("o_totalprice"))
    return T.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), T.dollars(total_c).alias("total"),
        F.when(F.col("o_orderpriority") == "1-URGENT", T.dollars(F.floor(total_c / 20))).alias("tax"))


def reconcile_orders(spark, sf_dir):
    df = reconcile_ledger(order_headers(spark, sf_dir), order_lines(spark, sf_dir))
    return df.select("doc_id", "total", "tax", "n_lines", "line_sum", text("warning").alias("warning"))


# ------------------------------------------------------------------ record rules

def derive_tax(spark, sf_dir):
    r = T.readings(spark, sf_dir).withColumn("fixed", normalize(F.col("pred")))
    return r.select("job_id", F.col("pred.tax").alias("given"), F.col("fixed.tax").alias("tax"),
                    itemised_tax(F.col("pred.line_items")).alias("itemised"))


def reconcile_records(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    return r.select("job_id", line_sum(F.col("pred.line_items")).alias("line_sum"),
                    text(F.get(reconcile(F.col("pred")), F.lit(0))).alias("warning"))


def schema_conformance(spark, sf_dir):
    r = conform(T.responses(spark, sf_dir).select("job_id", "first"), "first").withColumnRenamed("invoice", "inv")
    return r.select("job_id", text("fault").alias("fault"), F.col("inv.total").alias("total"),
                    F.col("inv.tax").alias("tax"), text("inv.vendor").alias("vendor"),
                    F.coalesce(F.size("inv.line_items"), F.lit(-1)).cast("bigint").alias("n_items"),
                    line_sum(F.col("inv.line_items")).alias("line_sum"))


# ------------------------------------------------------------------ cascade

def retry_policy(spark, sf_dir):
    calls = T.attempts(spark, sf_dir).withColumn("n_chars", F.length("response_json"))
    r = C.retry_outcomes(calls, kept="n_chars")
    return r.select("job_id", "tier", "purpose", F.col("attempt_no").cast("bigint").alias("attempt_no"),
                    "outcome", text("error_text").alias("error_text"),
                    F.coalesce("n_chars", F.lit(-1)).cast("bigint").alias("n_chars"))


def extraction_escalation(spark, sf_dir):
    r = C.read_extraction(T.attempts(spark, sf_dir), fields=("invoice_number", "total"))
    return r.select("job_id", text("read_tier").alias("tier"), text("read_error").alias("error"),
                    F.col("read_invoice.total").alias("total"),
                    text("read_invoice.invoice_number").alias("invoice_number"))


FLAT_FIELDS = ("invoice_number", "currency", "tax", "total", "n_items")


def settled(spark: SparkSession, sf_dir: str, fields: Sequence[str] | None = None) -> DataFrame:
    return C.settle(T.submissions(spark, sf_dir), T.attempts(spark, sf_dir), fields=fields)


def flat_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs in one level; of their records, ``FLAT_FIELDS`` or the whole may have gone along."""
    n_items = F.col("result.n_items") if "n_items" in jobs.schema["result"].dataType.names else F.size("result.line_items")
    return jobs.select(
        "job_id", "status", text("filename").alias("filename"), "was_scan", "source_path",
        text("tier_used").alias("tier_used"), text("result.invoice_number").alias("invoice_number"),
        text("result.currency").alias("currency"), F.col("result.tax").alias("tax"),
        F.col("result.total").alias("total"),
        F.coalesce(n_items, F.lit(0)).cast("bigint").alias("n_items"),
        F.array_join("warnings", "; ").alias("warnings"), text("error").alias("error"))


def job_outcomes(spark, sf_dir):
    return flat_jobs(C.outcomes(settled(spark, sf_dir, FLAT_FIELDS)))


def review_queue(spark, sf_dir):
    return flat_jobs(C.review_queue(C.outcomes(settled(spark, sf_dir, FLAT_FIELDS))))


def quarantine(spark, sf_dir):
    return C.quarantine(C.outcomes(settled(spark, sf_dir, ()))).select("job_id", "error")


def audit_trail(spark, sf_dir):
    t = C.trail(settled(spark, sf_dir, C.TRAIL_FIELDS))
    return t.select("event_id", "job_id", F.col("seq").cast("bigint").alias("seq"), "stage", "detail")


# ------------------------------------------------------------------ scoring

def normal_forms(spark, sf_dir):
    p = F.col("pred")
    return T.readings(spark, sf_dir).select(
        "job_id", norm_str(p["vendor"]).alias("vendor"), norm_str(p["payment_method"]).alias("paid"),
        norm_currency(p["currency"]).alias("currency"), norm_date(p["invoice_date"]).alias("date"),
        norm_date(p["due_date"]).alias("due"))


def field_checks(spark, sf_dir):
    p, g = F.col("pred"), F.col("gold")
    return T.readings(spark, sf_dir).select(
        "job_id", *[field_correct(n, p[n], g[n]).alias(n) for n in FIELD_WEIGHTS],
        field_correct("vendor", p["vendor"], g["vendor"], strict_missing=True).alias("vendor_strict"))


def item_matching(spark, sf_dir):
    r = T.readings(spark, sf_dir).withColumn(
        "m", matched_items(F.col("pred.line_items"), F.col("gold.line_items")))
    r = r.withColumn("p", item_precision(F.col("m"), F.size("pred.line_items"), F.size("gold.line_items")))
    r = r.withColumn("r", item_recall(F.col("m"), F.size("gold.line_items")))
    return r.select("job_id", F.col("m").cast("bigint").alias("matched"), F.bround("p", 3).alias("precision"),
                    F.bround("r", 3).alias("recall"), F.bround(item_f1(F.col("p"), F.col("r")), 3).alias("f1"))


def text_line_matching(spark, sf_dir):
    """Documents as records, lines as items: read in reverse order against the original.

    Many lines share words, and amounts repeat, so which line is taken first matters.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(
        x.alias("description"), F.lit(None).cast("double").alias("quantity"),
        F.lit(None).cast("double").alias("unit_price"),
        F.floor(F.length(x) / 40).cast("double").alias("amount")))
    d = T.table(spark, sf_dir, "documents").select("doc_id", lines.alias("items"))
    m = d.select("doc_id", F.size("items").alias("n"),
                 matched_items(F.reverse("items"), F.col("items")).alias("m"))
    return m.select("doc_id", F.col("n").cast("bigint").alias("n_items"), F.col("m").cast("bigint").alias("matched"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions scored; documents whose read failed (variant 3) have none."""
    r = T.readings(spark, sf_dir)
    r = r.withColumn("pred", F.when(F.col("variant") != 3, normalize(F.col("pred"))))
    return score_records(r)


def prediction_scores(spark, sf_dir):
    return metric(scored(spark, sf_dir)).select(
        "job_id", "metric", F.col("score.line_items.f1").alias("f1"),
        F.aggregate(F.map_values("score.fields"), F.lit(0).cast("bigint"),
                    lambda n, ok: n + F.when(ok, 1).otherwise(0)).alias("n_correct"))


def field_accuracy(spark, sf_dir):
    return field_accuracy_of(scored(spark, sf_dir))


# ------------------------------------------------------------------ reading plain text

def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bill as a printed text."""
    def money(c: Column) -> Column:
        return F.format_number(T.dollars(c), 2)

    unit = F.floor((F.col("goods_c") + F.floor(F.col("qty") / 2)) / F.col("qty"))
    lines = F.concat_ws(
        "\n", F.lit("INVOICE"), F.concat(F.lit("Invoice Number: "), "number"),
        F.concat(F.lit("Invoice Date: "), T.printed_date()), F.concat(F.lit("Payment Due: "), "due"),
        F.concat(F.lit("Purchase Order: "), "po"), F.concat(F.lit("Vendor: "), "vendor"),
        F.concat(F.lit("Bill To: "), "bill_to"), F.lit(""),
        F.concat("goods_label", F.lit("  "), "qty", F.lit(" x "), money(unit), F.lit("  "), money(F.col("goods_c"))),
        F.when(F.col("disc_c") > 0, F.concat(F.lit("Discount  "), money(F.col("disc_c")))),
        F.concat(F.lit("Subtotal  "), money(F.col("net_c"))),
        F.when(F.col("tps_c") > 0, F.concat(F.lit("TPS  "), money(F.col("tps_c")))),
        F.when(F.col("tax_c") > F.col("tps_c"), F.concat(
            "tax_label", F.lit("  "), money(F.col("tax_c") - F.col("tps_c")))),
        F.when(F.col("tip_c") > 0, F.concat(F.lit("Tip  "), money(F.col("tip_c")))),
        F.concat(F.lit("Page total  "), money(F.col("goods_c"))),
        F.concat(F.lit("Grand Total  "), T.printed_currency(), F.lit(" "), money(F.col("total_c"))),
        F.concat(F.lit("Payment Method: "), "paid_by"))
    return T.bills(spark, sf_dir).select("job_id", "k", "p", lines.alias("text"), T.truth().alias("gold"))


def text_reading(spark, sf_dir):
    i = F.col("invoice")
    r = read_text(printed(spark, sf_dir).drop("gold"))
    return r.select(
        "job_id", *[text(i[n]).alias(n) for n in (
            "invoice_number", "invoice_date", "due_date", "purchase_order", "vendor", "bill_to",
            "currency", "payment_method")],
        i["subtotal"].alias("subtotal"), i["tax"].alias("tax"), i["total"].alias("total"),
        F.size(i["line_items"]).cast("bigint").alias("n_items"), line_sum(i["line_items"]).alias("line_sum"),
        i["line_items"][0]["quantity"].alias("quantity"), i["line_items"][0]["unit_price"].alias("unit_price"))


def text_reading_scores(spark, sf_dir):
    """Print, read back, score against the truth: all but what the print does not show is right."""
    r = read_text(printed(spark, sf_dir))
    s = score_records(r, "invoice", "gold")
    return s.groupBy(F.col("score.overall").alias("overall")).agg(F.count("*").alias("n_docs"))


def _echo():
    """Stand-in predictor: answers with the length of the text, fails on some lengths."""
    last = [None, 0]        # the text being tried, and how often: tries of a text follow each other

    def predict(doc_text, image_uri):
        n = len(doc_text)
        last[:] = [doc_text, last[1] + 1 if last[0] == doc_text else 1]
        tries = last[1]
        if n % 5 == 0 and tries <= 1 + n % 4:
            raise CallError("timeout", "request timed out")
        if n % 7 == 0:
            raise CallError("bad_request", f"cannot read {n} characters")
        return Reply(f'{{"total": {n}}}', n, 9)
    return predict


def model_calls(spark, sf_dir):
    """A predictor run over whole documents; every call it made, with retries."""
    inputs = T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("job_id"),
        F.concat(F.lit("document "), "doc_id", F.lit("\n"), "text").alias("text"),
        F.lit(None).cast("string").alias("image_uri"))
    calls = call_model(inputs, _echo, "tier-1", min_wait=0.0, max_wait=0.0)
    return calls.select("job_id", F.col("attempt_no").cast("bigint").alias("attempt_no"),
                        text("response_json").alias("response"), text("error_class").alias("error_class"),
                        text("error_text").alias("error_text"), "tokens_in")


def _tier(answer: str):
    """Stand-in model of the cascade: short texts are refused, others get the given answer."""
    def make():
        def predict(doc_text, image_uri):
            if len(doc_text) % 11 == 0:
                raise CallError("bad_request", "cannot read this")
            return Reply(answer.replace("N", str(len(doc_text))), len(doc_text), 9)
        return predict
    return make


def live_cascade(spark, sf_dir):
    """The whole cascade over documents with stand-in models: every call of every tier.

    The first tier answers with lines that do not add up, so that each record is read again.
    """
    inputs = T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("job_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("image_uri"))
    off = '{"total": N, "line_items": [{"description": "x", "amount": 1}]}'
    good = '{"total": N, "line_items": [{"description": "x", "amount": N}]}'
    calls = run_cascade(inputs, _tier(off), _tier(good), scratch_path(spark, "cascade"), min_wait=0.0, max_wait=0.0)
    return calls.select("job_id", "tier", "purpose", F.col("attempt_no").cast("bigint").alias("attempt_no"),
                        text("response_json").alias("response"), text("error_text").alias("error_text"))


QUERIES = {f.__name__: f for f in (
    reconcile_orders, derive_tax, reconcile_records, schema_conformance, retry_policy,
    extraction_escalation, job_outcomes, review_queue, quarantine, audit_trail, normal_forms,
    field_checks, item_matching, text_line_matching, prediction_scores, field_accuracy, text_reading,
    text_reading_scores, model_calls, live_cascade)}
