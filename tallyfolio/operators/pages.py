"""Documents and their pages: intake, blank pages, splitting, routing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyfolio.functions.text import data_uri, is_usable_text
from tallyfolio.operators.staging import summary_join

# Ink below which a page is no content (splitting), and at or below which its
# image is not worth reading (vision route).
SPLIT_MIN_INK = 0.01
IMAGE_MIN_INK = 0.002
# Default name, reject reasons.
DEFAULT_NAME = "document.pdf"
EMPTY_FILE = "empty file"
UNREADABLE = "could not read PDF"


# ------------------------------------------------------------------ intake

def with_intake(documents: DataFrame, reader_error: Column | None = None) -> DataFrame:
    """Add ``reject_reason``: empty content, or what the page reader reported."""
    reason = F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, EMPTY_FILE)
    if reader_error is not None:
        reason = reason.when(reader_error.isNotNull(),
                             F.concat(F.lit(UNREADABLE + ": "), reader_error))
    return documents.withColumn("reject_reason", reason)


def accepted(intake: DataFrame) -> DataFrame:
    return intake.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(intake: DataFrame) -> DataFrame:
    return intake.filter(F.col("reject_reason").isNotNull())


# ------------------------------------------------------------------ pages held on the document's row

def ink_ratio(raster: Column) -> Column:
    """Share of bytes that are not white (255); empty rasters have none.

    Latin-1 maps every byte to one character, so counting white bytes stays a string
    expression in the JVM and needs no Python worker.
    """
    chars = F.decode(raster, "ISO-8859-1")
    white = F.length(chars) - F.length(F.translate(chars, "ÿ", ""))
    return F.when(F.length(raster) > 0, 1.0 - white / F.length(raster)).otherwise(0.0)


def _densest(pages: Column) -> Column:
    """The page with most ink as a one-element array; equal ink goes to the lowest index."""
    first = F.array_max(F.transform(pages, lambda p: F.struct(
        p["ink"].alias("ink"), (-p["page_index"]).alias("back"))))
    return F.filter(pages, lambda p: p["page_index"] == -first["back"])


def content_pages(pages: Column, min_ink: float = SPLIT_MIN_INK) -> Column:
    """Pages with content, in order; the densest one where all look blank."""
    full = F.filter(pages, lambda p: p["ink"] >= min_ink)
    return F.when(F.size(full) > 0, full).otherwise(_densest(pages))


def image_pages(pages: Column, min_ink: float = IMAGE_MIN_INK) -> Column:
    """Pages for the vision reader, densest first; the densest one where all are near blank."""
    inked = F.filter(pages, lambda p: p["ink"] > min_ink)
    kept = F.when(F.size(inked) > 0, inked).otherwise(_densest(pages))
    ranked = F.array_sort(F.transform(kept, lambda p: F.struct(
        (-p["ink"]).alias("order"), p["page_index"].alias("page_index"), p.alias("page"))))
    return F.transform(ranked, lambda r: r["page"])


def document_text(pages: Column) -> Column:
    """Page texts joined by newline in page order."""
    ordered = F.array_sort(F.transform(pages, lambda p: F.struct(
        p["page_index"].alias("page_index"), p["text"].alias("text"))))
    return F.array_join(F.transform(ordered, lambda p: p["text"]), "\n")


def page_name(filename: Column, page_index: Column, n_pages: Column) -> Column:
    """File name of one page of a split document; a document of one page keeps its name.

    A name without a dot is taken as base and extension both.
    """
    name = F.coalesce(F.nullif(filename, F.lit("")), F.lit(DEFAULT_NAME))
    head = F.regexp_extract(name, r"(?s)\A(.*)\.([^.]*)\z", 1)
    base = F.coalesce(F.nullif(head, F.lit("")), name)
    ext = F.coalesce(F.nullif(F.substring_index(name, ".", -1), F.lit("")), F.lit("pdf"))
    return F.when(n_pages > 1, F.concat(base, F.lit("_p"), page_index.cast("string"), F.lit("."), ext)
                  ).otherwise(name)


def job_id_of(path: Column, page_index: Column) -> Column:
    """Job id derived from the document and page, so that a retried task repeats it."""
    return F.sha2(F.concat_ws("#", path, page_index), 256)


def split_documents(documents: DataFrame, min_ink: float = SPLIT_MIN_INK,
                    key: str = "doc_id") -> DataFrame:
    """One row per content page: ``job_id, page_index, page_name, n_invoices, page``.

    Narrow: choosing pages happens inside the document's row, then they are exploded.
    """
    df = documents.withColumn("kept", content_pages(F.col("pages"), min_ink))
    df = df.withColumn("n_invoices", F.size("kept"))
    df = df.withColumn("page", F.explode("kept")).drop("kept", "pages")
    index = F.col("page.page_index")
    return df.select(
        job_id_of(F.col(key), index).alias("job_id"), *documents.drop("pages").columns,
        index.alias("page_index"), page_name(F.col("filename"), index, F.col("n_invoices")).alias("page_name"),
        "n_invoices", "page")


def ingest_summary(documents: DataFrame, min_ink: float = SPLIT_MIN_INK,
                   key: str = "doc_id") -> DataFrame:
    """Per document: its name, number of invoices and the list of jobs, without a shuffle."""
    df = documents.withColumn("kept", content_pages(F.col("pages"), min_ink))
    df = df.withColumn("invoices", F.size("kept"))
    jobs = F.transform("kept", lambda p: F.struct(
        job_id_of(F.col(key), p["page_index"]).alias("job_id"), p["page_index"].alias("page"),
        page_name(F.col("filename"), p["page_index"], F.col("invoices")).alias("filename")))
    return df.select(key, F.col("filename").alias("document"), "invoices", jobs.alias("jobs"))


# ------------------------------------------------------------------ pages as rows

def keep_content_rows(pages: DataFrame, key: str, min_ink: float = SPLIT_MIN_INK) -> DataFrame:
    """The same choice where each page is a row of its own (``key, page_index, ink``).

    Documents are summarised by partial aggregation (count of content pages, densest page) and
    the summary, one row per document, is joined back; no document is ever gathered.
    """
    is_content = F.col("ink") >= min_ink
    summary = pages.groupBy(key).agg(
        F.count_if(is_content).alias("n_content"),
        F.max(F.struct(F.col("ink"), (-F.col("page_index")).alias("back"))).alias("top"))
    joined = summary_join(pages, summary, key)
    keep = is_content | ((F.col("n_content") == 0) & (F.col("page_index") == -F.col("top.back")))
    return (joined.filter(keep)
            .withColumn("n_invoices", F.greatest(F.col("n_content"), F.lit(1).cast("bigint")))
            .drop("n_content", "top"))


# ------------------------------------------------------------------ routing

def route(documents: DataFrame) -> DataFrame:
    """Choose the reader per document from ``text`` and ``pages``.

    Adds ``has_text, was_scan, reader, images`` and ``route_error``: usable text goes to the
    text reader, otherwise the page images go to the vision reader, otherwise it is an error.
    """
    df = documents.withColumn("has_text", is_usable_text(F.col("text")))
    df = df.withColumn("images", F.when(~F.col("has_text"), image_pages(F.col("pages"))))
    renderable = F.coalesce(F.size("images") > 0, F.lit(False))
    # Fixed value: the text of the error.
    return (df.withColumn("was_scan", ~F.col("has_text"))
            .withColumn("reader", F.when(F.col("has_text"), "text").when(renderable, "vision"))
            .withColumn("route_error", F.when(F.col("reader").isNull(),
                                              "scanned PDF produced no renderable pages")))


def reader_input(routed: DataFrame) -> DataFrame:
    """What each reader is given: the whole text, or the densest page as a data URI."""
    return routed.filter(F.col("reader").isNotNull()).select(
        "doc_id", "reader", F.when(F.col("reader") == "text", F.col("text")).alias("text"),
        F.when(F.col("reader") == "vision", data_uri(F.get("images", F.lit(0))["png"])).alias("image_uri"))


# ------------------------------------------------------------------ recognition confidence

CONFIDENCE_THRESHOLD = 70.0  # fixed value: at or above it a page is clean enough for OCR


def mean_confidence(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean confidence of recognised words per document; negative marks no word, none is 0."""
    real = F.when(F.col("conf") >= 0, F.col("conf"))
    return words.groupBy(key).agg(F.coalesce(F.avg(real), F.lit(0.0)).alias("mean_conf"))


def by_confidence(mean_conf: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    return F.when(mean_conf >= threshold, "ocr").otherwise("vlm")
