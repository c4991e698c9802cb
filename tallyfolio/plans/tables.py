"""Working tables derived from the warehouse tables.

Every invoice here is one line of ``lineitem`` turned into a document of its own: goods,
discount, tax lines, tip. All of it is built on the row itself with whole cents, so building
the record tables costs one scan and no shuffle, and no key can gather an unbounded group.
``variant`` (0-19) decides which reading fault a document's first response carries.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfolio.functions.records import let

WRONG_TOTAL = (0, 1, 7)
# Whole numbers that make up the id of a job.
JOB_KEYS = ("k", "n", "p", "s", "qty", "goods_c")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A warehouse table as it is stored; the session's file settings decide its splits."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def dollars(c: Column) -> Column:
    return c / F.lit(100.0)


def cents_text(c: Column) -> Column:
    size = F.abs(c)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(size / 100).cast("string"),
                    F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat facts of every document: keys, cents, printed labels."""
    k, n, p, s = F.col("k"), F.col("n"), F.col("p"), F.col("s")
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("n"),
        F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        cents(F.col("l_extendedprice")).alias("goods_c"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc_pct"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("tax_pct"),
        F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("shipped"))
    df = df.withColumn("disc_c", F.floor((F.col("goods_c") * F.col("disc_pct") + 50) / 100))
    df = df.withColumn("net_c", F.col("goods_c") - F.col("disc_c"))
    df = df.withColumn("tax_c", F.floor((F.col("net_c") * F.col("tax_pct") + 50) / 100))
    df = df.withColumn("tip_c", F.when(n == 7, 300).otherwise(0).cast("bigint"))
    return df.select(
        "*",
        F.concat_ws("-", *JOB_KEYS).alias("job_id"),
        # Alike for equal ids: absent numbers are skipped by both.
        F.xxhash64(*JOB_KEYS).alias("job"),
        ((k * 7 + p + n) % 20).alias("variant"),
        (F.col("net_c") + F.col("tax_c") + F.col("tip_c")).alias("total_c"),
        # tax lines: 'N' documents print two, the others one
        F.when(F.col("flag") == "N", F.floor(F.col("tax_c") / 3)).otherwise(0).cast("bigint").alias("tps_c"),
        F.when(F.col("flag") == "A", "GST (5%)").when(F.col("flag") == "N", "TVQ")
        .otherwise("Sales Tax").alias("tax_label"),
        F.when(k % 10 != 9, F.concat_ws("-", F.lit("INV"), k, n, p, s)).alias("number"),
        F.date_format("shipped", "yyyy-MM-dd").alias("iso_date"),
        F.when(p % 4 == 0, F.date_format(F.date_add(F.col("shipped").cast("date"), 30),
                                         "yyyy-MM-dd")).alias("due"),
        F.when(s % 3 == 0, F.concat(F.lit("PO "), p)).alias("po"),
        F.concat(F.lit("Supplier#"), F.lpad(s.cast("string"), 9, "0")).alias("vendor"),
        F.concat(F.lit("Customer of order "), k).alias("bill_to"),
        F.when(k % 3 == 0, "CAD").when(k % 3 == 1, "USD").otherwise("EUR").alias("currency"),
        F.when(n % 2 == 1, F.concat(F.lit("Visa ending in "),
                                    F.lpad((k % 10000).cast("string"), 4, "0"))).alias("paid_by"),
        F.concat(F.lit("Parts lot "), p).alias("goods_label"))


def _line(label: Column, amount_c: Column, qty: Column | None = None,
          unit_c: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(label.alias("description"),
                    (qty.cast("double") if qty is not None else none).alias("quantity"),
                    (dollars(unit_c) if unit_c is not None else none).alias("unit_price"),
                    dollars(amount_c).alias("amount"))


def _goods_line(sign: Column) -> Column:
    unit = F.floor((F.col("goods_c") + F.floor(F.col("qty") / 2)) / F.col("qty"))
    return _line(F.col("goods_label"), sign * F.col("goods_c"), F.col("qty"), unit)


def _extra_lines(sign: Column) -> list[Column]:
    """Discount, tax and tip lines, null where the document has none."""
    return [
        F.when(F.col("disc_c") > 0, _line(F.lit("Discount"), -sign * F.col("disc_c"))),
        F.when(F.col("tps_c") > 0, _line(F.lit("TPS"), sign * F.col("tps_c"))),
        F.when(F.col("tax_c") > F.col("tps_c"),
               _line(F.col("tax_label"), sign * (F.col("tax_c") - F.col("tps_c")))),
        F.when(F.col("tip_c") > 0, _line(F.lit("Tip"), sign * F.col("tip_c"))),
    ]


def truth() -> Column:
    """The labelled record of a bill."""
    one = F.lit(1)
    return F.struct(
        F.col("number").alias("invoice_number"), F.col("iso_date").alias("invoice_date"),
        F.col("due").alias("due_date"), F.col("po").alias("purchase_order"), F.col("vendor"),
        F.col("bill_to"), F.col("currency"), dollars(F.col("net_c")).alias("subtotal"),
        dollars(F.col("tax_c")).alias("tax"), dollars(F.col("total_c")).alias("total"),
        F.col("paid_by").alias("payment_method"),
        F.array_compact(F.array(_goods_line(one), *_extra_lines(one))).alias("line_items"))


def printed_currency() -> Column:
    c = F.col("currency")
    return F.when(c == "CAD", "CA$").when(c == "USD", "$").otherwise("EUR")


def printed_date() -> Column:
    return (F.when(F.col("k") % 3 == 0, F.col("iso_date"))
            .when(F.col("k") % 3 == 1, F.date_format("shipped", "MMMM d, yyyy"))
            .otherwise(F.date_format("shipped", "M/d/yy")))


def wrong_total_c() -> Column:
    return F.floor(F.col("total_c") * 105 / 100) + 100


def prediction() -> Column:
    """What the first reading returned: printed forms, with the fault of the variant."""
    v = F.col("variant")
    sign = F.when(v == 8, -1).otherwise(1)
    total = F.when(v.isin(*WRONG_TOTAL), wrong_total_c()).otherwise(sign * F.col("total_c"))
    tax = F.when(v == 6, F.col("goods_c")).otherwise(sign * F.col("tax_c"))
    goods = _goods_line(sign)
    lines = F.array_compact(F.array(
        F.when(v != 13, goods), *_extra_lines(sign), F.when(v == 14, goods)))
    return F.struct(
        F.when(v == 12, F.col("iso_date")).otherwise(F.col("number")).alias("invoice_number"),
        printed_date().alias("invoice_date"), F.col("due").alias("due_date"),
        F.col("po").alias("purchase_order"),
        F.when(v == 11, "").otherwise(F.concat(F.upper("vendor"), F.lit(", Inc."))).alias("vendor"),
        F.col("bill_to"), printed_currency().alias("currency"),
        dollars(sign * F.col("net_c")).alias("subtotal"), dollars(tax).alias("tax"),
        dollars(total).alias("total"), F.col("paid_by").alias("payment_method"),
        F.when(v.isin(15, 19), F.filter(lines, lambda _: F.lit(False))).otherwise(lines)
        .alias("line_items"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gold`` and ``pred`` side by side for every document."""
    return bills(spark, sf_dir).select(
        "job_id", "k", "n", "p", "s", "variant", truth().alias("gold"), prediction().alias("pred"))


# ------------------------------------------------------------------ recorded model calls

def _quoted(text: Column) -> Column:
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def _json_line(label: Column, amount_c: Column) -> Column:
    return F.concat(F.lit('{"description":"'), label, F.lit('","amount":'), cents_text(amount_c),
                    F.lit("}"))


def _apart(value: Column) -> Column:
    """``value`` as it is, in a way that keeps its projection out of the one generated method of a stage.

    Many long texts in one method make it larger than the JVM compiles; a projection of its own is cut
    into small methods.
    """
    return let(value, lambda x: x)


def responses(spark: SparkSession, sf_dir: str, corrected: Column | None = None) -> DataFrame:
    """Per document the texts a model may have answered: ``first``, ``good`` and ``off``.

    Where ``corrected`` is given and does not hold, the last two are null and not built.
    """
    v = F.col("variant")
    corrected = F.lit(True) if corrected is None else corrected
    shouted = F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("s").cast("string"), 9, "0"))
    sign = F.when(v == 8, -1).otherwise(1)

    def middle(vendor: Column, tax_c: Column, sign: Column | int) -> Column:
        return F.concat(
            F.lit(',"vendor":'), _quoted(vendor), F.lit(',"bill_to":'), _quoted(F.col("bill_to")),
            F.lit(',"invoice_date":'), _quoted(printed_date()),
            F.lit(',"due_date":'), _quoted(F.col("due")),
            F.lit(',"purchase_order":'), _quoted(F.col("po")),
            F.lit(',"currency":'), _quoted(printed_currency()),
            F.lit(',"payment_method":'), _quoted(F.col("paid_by")),
            F.lit(',"subtotal":'), cents_text(sign * F.col("net_c")),
            F.lit(',"tax":'), cents_text(tax_c))

    def lines(sign: Column | int, goods: Column, again: Column) -> Column:
        return F.concat_ws(
            ",", goods,
            F.when(F.col("disc_c") > 0, _json_line(F.lit("Discount"), -sign * F.col("disc_c"))),
            F.when(F.col("tps_c") > 0, _json_line(F.lit("TPS"), sign * F.col("tps_c"))),
            F.when(F.col("tax_c") > F.col("tps_c"),
                   _json_line(F.col("tax_label"), sign * (F.col("tax_c") - F.col("tps_c")))),
            F.when(F.col("tip_c") > 0, _json_line(F.lit("Tip"), sign * F.col("tip_c"))), again)

    def whole(number: Column, mid: str, total: Column, items: Column) -> Column:
        return F.concat(F.lit('{"invoice_number":'), number, F.col(mid), F.lit(',"total":'), total,
                        F.lit(',"line_items":['), items, F.lit("]}"))

    goods = _json_line(F.col("goods_label"), F.col("goods_c"))
    signed_goods = _json_line(F.col("goods_label"), sign * F.col("goods_c"))
    no_line = F.lit(None).cast("string")
    bare_goods = F.concat(F.lit('{"quantity":1,"amount":'), cents_text(F.col("goods_c")), F.lit("}"))

    df = bills(spark, sf_dir).select(
        "job_id", "k", "n", "p", "s", "flag", _apart(v).alias("variant"),
        _quoted(F.when(v == 12, F.col("iso_date")).otherwise(F.col("number"))).alias("first_number"),
        _quoted(F.col("number")).alias("number_json"),
        cents_text(F.when(v.isin(*WRONG_TOTAL), wrong_total_c())
                   .otherwise(sign * F.col("total_c"))).alias("first_total"),
        cents_text(F.col("total_c")).alias("good_total"),
        cents_text(wrong_total_c()).alias("off_total"),
        middle(F.when(v == 11, "").otherwise(shouted),
               F.when(v == 6, F.col("goods_c")).otherwise(sign * F.col("tax_c")), sign).alias("first_mid"),
        F.when(corrected, middle(shouted, F.col("tax_c"), 1)).alias("good_mid"),
        lines(sign, F.when(v != 13, signed_goods), F.when(v == 14, signed_goods)).alias("first_lines"),
        F.when(corrected, lines(1, goods, no_line)).alias("good_lines"),
        F.when(v == 18, lines(1, bare_goods, no_line)).alias("bare_lines"))

    number, total = F.col("first_number"), F.col("first_total")
    first = (
        F.when(v == 2, whole(number, "first_mid", F.lit('"N/A"'), F.col("first_lines")))
        .when(v == 3, F.concat(F.lit('{"vendor":5,"total":'), total, F.lit("}")))
        .when(v == 9, whole(F.col("k").cast("string"), "first_mid", total, F.col("first_lines")))
        .when(v == 10, F.concat(F.lit('{"invoice_number":'), number, F.col("first_mid")))
        .when(v == 15, whole(number, "first_mid", total, F.lit("")))
        .when(v == 16, "")
        .when(v == 17, whole(number, "first_mid", _quoted(total), F.col("first_lines")))
        .when(v == 18, whole(number, "first_mid", total, F.col("bare_lines")))
        .when(v == 19, F.concat(F.lit('{"invoice_number":'), number, F.col("first_mid"),
                                F.lit(',"confidence":0.9,"total":'), total, F.lit("}")))
        .otherwise(whole(number, "first_mid", total, F.col("first_lines"))))
    return df.select(
        "job_id", "k", "n", "p", "s", "flag", _apart(v).alias("variant"), first.alias("first"),
        whole(F.col("number_json"), "good_mid", F.col("good_total"), F.col("good_lines")).alias("good"),
        whole(F.col("number_json"), "good_mid", F.col("off_total"), F.col("good_lines")).alias("off"))


def _made(variant: int | None) -> list[tuple]:
    """(tier, purpose, attempt_no, answer, error_class, error_text) of the calls made for a variant; None: any other."""
    limit = ("rate_limit", "rate limit reached")
    slow = ("timeout", "request timed out")
    down = ("server_error", "service unavailable")

    def call(tier: str, purpose: str, no: int, answer: str | None = None, failure: tuple = (None, None)) -> tuple:
        return tier, purpose, no, answer, *failure

    cheap = {
        4: [call("tier-1", "extract", 1, None, limit), call("tier-1", "extract", 2, None, slow), call("tier-1", "extract", 3, "first")],
        5: [call("tier-1", "extract", 1, None, limit), call("tier-1", "extract", 2, None, slow), call("tier-1", "extract", 3, None, down)]}
    second = {2: "good", 9: "good", 18: "good", 10: "off", 3: "first"}
    premium = {0: "good", 10: "good", 13: "good", 1: "off"}
    calls = list(cheap.get(variant, [call("tier-1", "extract", 1, "first")]))
    if variant in second:
        calls.append(call("tier-2", "extract", 1, second[variant]))
    if variant == 16:
        calls += [call("tier-2", "extract", 1, None, limit), call("tier-2", "extract", 2, "good")]
    if variant in premium:
        calls.append(call("tier-2", "reconcile", 1, premium[variant]))
    if variant == 7:
        calls.append(call("tier-2", "reconcile", 1, None, ("bad_request", "image input not supported")))
    if variant == 14:
        calls += [call("tier-2", "reconcile", no, None, why) for no, why in ((1, slow), (2, limit), (3, down))]
    return calls


def _recorded(rows: DataFrame, answers: bool, *kept: str) -> DataFrame:
    """The calls of ``rows`` with the columns ``kept``; without ``answers`` no response is built.

    What is made for a variant is a constant that a row looks up; figures and answers come after the explode.
    """
    names = ("tier", "purpose", "attempt_no", "answer", "error_class", "error_text")

    def made(variant: int | None) -> Column:
        return F.array(*[F.struct(*[F.lit(x).cast("int" if name == "attempt_no" else "string").alias(name)
                                    for name, x in zip(names, c)]) for c in _made(variant)])

    calls = F.coalesce(F.get(F.array(*[made(v) for v in range(20)]), F.col("variant").cast("int")), made(None))
    texts = ("first", "good", "off") if answers else ()
    answer = F.coalesce(*[F.when(F.col("c.answer") == t, F.col(t)) for t in texts]) if answers else None
    open_ = ((F.col("p") % 13 == 5) & (F.col("c.tier") == "tier-2")) | ((F.col("p") % 17 == 3) & (F.col("c.attempt_no") > 1))
    return rows.select(*kept, F.explode(calls).alias("c"), "k", "n", "p", "s", *texts).filter(~open_).select(
        *kept, "c.tier", "c.purpose", "c.attempt_no", *([answer.alias("response_json")] if answers else []),
        "c.error_class", "c.error_text",
        (5 + (F.col("k") + F.col("n") + F.col("c.attempt_no")) % 7).cast("double").alias("latency_s"),
        (1500 + F.col("p") % 500).alias("tokens_in"), (400 + F.col("s") % 200).alias("tokens_out"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per recorded model call; some jobs are still waiting for their next one."""
    again = [v for v in range(20) if any(answer in ("good", "off") for _, _, _, answer, _, _ in _made(v))]
    return _recorded(responses(spark, sf_dir, F.col("variant").isin(again)), True, "job_id")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``attempts`` without their answers, beside ``job``, ``vendor`` and ``shipped`` of the bill that each came from."""
    return _recorded(bills(spark, sf_dir), False, "job_id", "job", "vendor", "shipped")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per submitted document: its name, whether it has text, how many page images."""
    return bills(spark, sf_dir).select(
        "job_id",
        F.when(F.col("p") % 11 != 0,
               F.concat(F.lit("statement_"), F.col("k"), F.lit("_p"), F.col("n"), F.lit(".pdf")))
        .alias("filename"),
        (F.col("flag") != "R").alias("has_text"),
        F.when(F.col("flag") != "R", 0).when(F.col("p") % 50 == 0, 0)
        .otherwise(1 + F.col("n") % 3).cast("int").alias("n_images"))
