"""Registered queries over documents, pages and recognised words."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfolio.functions.text import (
    data_uri, file_stem, is_usable_text, norm_str, page_number, readable_share, strip, text_or_fallback)
from tallyfolio.operators import pages as P
from tallyfolio.plans.tables import table
from tallyfolio.sources.documents import retained_path

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
STRICT_SHARE = 0.8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def file_name(doc_id: Column) -> Column:
    """Most files carry a normal name, some none and some one without a dot."""
    return (F.when(doc_id % 7 == 0, F.lit(None).cast("string"))
            .when(doc_id % 7 == 1, F.concat(F.lit("scan"), doc_id))
            .otherwise(F.concat(F.lit("batch.v2_"), doc_id, F.lit(".pdf"))))


def line_pages(text: Column) -> Column:
    """Each line of a text as a page; its ink grows with its length."""
    return F.transform(F.split(text, "\n"), lambda line, i: F.struct(
        i.alias("page_index"), line.alias("text"),
        F.least(F.lit(1.0), F.length(line) / 200.0).alias("ink"), F.encode(line, "UTF-8").alias("png")))


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", file_name(F.col("doc_id")).alias("filename"), "text",
                    line_pages(F.col("text")).alias("pages"))


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paged documents whose text layer is sound, garbled, or missing (then some lack pages)."""
    m = F.col("doc_id") % 10
    text = (F.when(m == 0, F.translate("text", LETTERS, "\x01" * len(LETTERS)))
            .when(m.isin(1, 2), F.lit(None).cast("string")).otherwise(F.col("text")))
    d = paged(spark, sf_dir)
    pages = F.when(m == 2, F.filter("pages", lambda p: F.lit(False))).otherwise(F.col("pages"))
    return d.withColumn("pages", pages).withColumn("text", text)


# ------------------------------------------------------------------ queries

def document_intake(spark, sf_dir):
    d = documents(spark, sf_dir)
    raw = F.encode("text", "UTF-8")
    content = (F.when(F.col("n_chars") < 20, F.unhex(F.lit("")))
               .when(F.col("source") == "src7", F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw))
    d = d.select("doc_id", content.alias("content"))
    error = F.when(~F.is_valid_utf8(F.col("content").cast("string")), "text is not UTF-8")
    return P.with_intake(d, error).select(
        "doc_id", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"),
        F.octet_length("content").cast("bigint").alias("n_bytes"))


def text_gate(spark, sf_dir):
    s = strip(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id", is_usable_text(F.col("text")).alias("usable"),
        is_usable_text(F.col("text"), min_share=STRICT_SHARE).alias("usable_strict"),
        F.coalesce(F.round(readable_share(s) * F.length(s)), F.lit(0.0)).cast("bigint").alias("n_readable"))


def reader_routing(spark, sf_dir):
    return P.route(layered(spark, sf_dir)).select(
        "doc_id", F.coalesce("reader", F.lit("none")).alias("reader"), "was_scan",
        F.coalesce(F.size("images"), F.lit(0)).cast("bigint").alias("n_images"),
        F.coalesce(F.get("images", F.lit(0))["page_index"], F.lit(-1)).cast("bigint").alias("densest_page"),
        F.coalesce("route_error", F.lit("")).alias("route_error"))


def vision_inputs(spark, sf_dir):
    given = P.reader_input(P.route(layered(spark, sf_dir)))
    return given.select("doc_id", "reader", F.sha2(F.coalesce("text", "image_uri"), 256).alias("input_sha"))


def split_documents(spark, sf_dir):
    rows = P.split_documents(paged(spark, sf_dir).drop("text"))
    return rows.select("doc_id", F.col("page_index").cast("bigint").alias("page_index"), "page_name",
                       F.col("n_invoices").cast("bigint").alias("n_invoices"), "job_id",
                       F.length("page.text").cast("bigint").alias("n_chars"))


def ingest_summary(spark, sf_dir):
    s = P.ingest_summary(paged(spark, sf_dir).drop("text"))
    return s.select("doc_id", F.coalesce("document", F.lit("")).alias("document"),
                    F.col("invoices").cast("bigint").alias("invoices"),
                    F.array_join(F.transform("jobs", lambda j: j["filename"]), "|").alias("job_files"))


def split_page_rows(spark, sf_dir):
    """Conversations as documents, turns as pages; short turns are blank pages."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"),
        F.least(F.lit(1.0), F.length("text") / 400.0).alias("ink"))
    return P.keep_content_rows(rows, "doc_id", min_ink=0.5)


def vision_pages(spark, sf_dir):
    order = F.transform(P.image_pages(F.col("pages")), lambda p: p["page_index"].cast("string"))
    return paged(spark, sf_dir).select("doc_id", F.array_join(order, ",").alias("page_order"))


def joined_text(spark, sf_dir):
    shuffled = F.reverse("pages")
    return paged(spark, sf_dir).select(
        "doc_id", F.sha2(P.document_text(shuffled), 256).alias("text_sha"))


def page_ink(spark, sf_dir):
    """Each text as a raster: blanks and line breaks white, everything else ink."""
    raster = F.encode(F.regexp_replace(F.translate("text", " \n", "ÿÿ"), "[^ÿ]", "x"), "ISO-8859-1")
    d = documents(spark, sf_dir).select("doc_id", raster.alias("raster"))
    return d.select("doc_id", P.ink_ratio(F.col("raster")).alias("ink"),
                    F.octet_length("raster").cast("bigint").alias("n_bytes"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words with confidence; every sixth document is hard to read."""
    w = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    raw = (F.col("doc_id") * 31 + F.col("pos") * 17) % 101 - 1
    boost = F.least(F.lit(100).cast("bigint"), raw + 60)
    conf = (F.when(raw < 0, raw).when(F.col("doc_id") % 6 == 0, F.floor(raw / 3)).otherwise(boost))
    return w.select("doc_id", "pos", "word", conf.cast("int").alias("conf"))


def ocr_confidence(spark, sf_dir):
    m = P.mean_confidence(words(spark, sf_dir))
    return m.select("doc_id", F.bround("mean_conf", 6).alias("mean_conf"),
                    P.by_confidence(F.col("mean_conf")).alias("path"))


def text_source(spark, sf_dir):
    m = F.col("doc_id") % 5
    layer = F.when(m == 0, "").when(m.isin(1, 2), F.lit(None).cast("string")).otherwise(F.col("text"))
    ocr = F.when(m == 2, "").otherwise(F.concat(F.lit("ocr: "), "text"))
    d = documents(spark, sf_dir).select("doc_id", layer.alias("layer"), ocr.alias("ocr"))
    used = text_or_fallback(F.col("layer"), F.col("ocr"))
    return d.select("doc_id", used.isNull().alias("skipped"),
                    F.sha2(F.coalesce(used, F.lit("")), 256).alias("text_sha"))


def retained_paths(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", retained_path(
        "/documents", F.concat(F.lit("job-"), F.col("doc_id")), file_name(F.col("doc_id"))).alias("path"))


def normalized_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(norm_str(F.col("text")), 256).alias("norm_sha"))


def encoded_pages(spark, sf_dir):
    html = F.encode("html", "UTF-8")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(data_uri(html), 256).alias("uri_sha"))


def source_names(spark, sf_dir):
    """File stem and page number of every page address."""
    bare = F.regexp_replace("url", "[?#].*", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", file_stem(bare).alias("stem"),
        F.coalesce(page_number(F.regexp_replace("url", "[&#].*", "")), F.lit(-1)).cast("bigint").alias("page"))


QUERIES = {f.__name__: f for f in (
    document_intake, text_gate, reader_routing, vision_inputs, split_documents, ingest_summary,
    split_page_rows, vision_pages, joined_text, page_ink, ocr_confidence, text_source, retained_paths,
    normalized_text, encoded_pages, source_names)}
