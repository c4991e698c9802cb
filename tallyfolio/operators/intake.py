"""Before a document is read: redaction, resubmissions, classification by rules, chunks."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallyfolio.operators.staging import summary_join

# ------------------------------------------------------------------ redaction

# What is masked before text leaves for a model: name and pattern, applied in this order.
REDACTIONS = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("IP", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("CARD", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}"),
    ("PHONE", r"\+[0-9][0-9 ().-]{6,}[0-9]"),
)


def redact(text: Column, rules: tuple[tuple[str, str], ...] = REDACTIONS) -> Column:
    """The whole text with every match of a rule replaced by its name in brackets."""
    for name, pattern in rules:
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


# ------------------------------------------------------------------ resubmissions

def resubmissions(documents: DataFrame, content: Column, key: str = "doc_id") -> DataFrame:
    """Per document the first one with the same content; only that one has to be read.

    Only the content's digest is shuffled. Copies are counted before they meet, and the rows of
    a content with very many copies can be split between tasks.
    """
    digests = documents.select(key, F.sha2(content, 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min(key).alias("first_id"), F.count("*").alias("n_copies"))
    return (summary_join(digests, first, "digest")
            .select(key, "first_id", "n_copies", (F.col(key) != F.col("first_id")).alias("resubmitted")))


# ------------------------------------------------------------------ rules classifier

class Signal(NamedTuple):
    """A pattern that speaks for a kind; each of up to ``most`` matches is worth ``weight``."""
    kind: str
    name: str
    pattern: str
    weight: int
    most: int = 1


INVOICE_SIGNALS = (
    Signal("invoice", "invoice number", r"(?i)invoice (no|number|#)", 5),
    Signal("invoice", "bill to", r"(?i)bill(ed)? to", 3),
    Signal("invoice", "amount due", r"(?i)(amount|total|balance) due", 3),
    Signal("invoice", "subtotal", r"(?i)sub-?total", 2),
    Signal("invoice", "number pattern", r"INV-[0-9]+", 4),
    Signal("invoice", "currency amounts", r"[$€£] ?[0-9][0-9,]*\.[0-9]{2}", 1, 4),
    Signal("contract", "agreement", r"(?i)this [a-z ]*agreement", 4),
    Signal("contract", "whereas", r"WHEREAS", 3, 2),
    Signal("contract", "governing law", r"(?i)governing law", 3),
    Signal("email", "header lines", r"(?im)^(from|to|subject): ", 3, 3),
)
UNKNOWN = "unknown"


def classify(documents: DataFrame, text: str, signals: tuple[Signal, ...] = INVOICE_SIGNALS,
             threshold: int = 6) -> DataFrame:
    """Add ``kind``, ``score`` and ``fired`` (names of the signals found, in their order).

    The kind with the highest score wins if it reaches the threshold, ties go to the kind that is
    listed first; else the kind is unknown and the document goes up the ladder. Row-local.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = list(dict.fromkeys(s.kind for s in signals))
    found = documents.withColumn("_hits", F.array(*[F.regexp_count(body, F.lit(s.pattern)) for s in signals]))

    def score(kind: str) -> Column:
        parts = [s.weight * F.least(F.get("_hits", F.lit(i)), F.lit(s.most)) for i, s in enumerate(signals) if s.kind == kind]
        return sum(parts[1:], parts[0]).cast("bigint")

    fired = F.array_compact(F.array(*[F.when(F.get("_hits", F.lit(i)) > 0, s.name) for i, s in enumerate(signals)]))
    ranked = F.array(*[F.struct(score(k).alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("kind"))
                       for i, k in enumerate(kinds)])
    best = found.withColumn("_best", F.array_max(ranked)).withColumn("fired", fired)
    sure = F.col("_best.score") >= threshold
    return (best.withColumn("kind", F.when(sure, F.col("_best.kind")).otherwise(UNKNOWN))
            .withColumn("score", F.col("_best.score")).drop("_hits", "_best"))


# ------------------------------------------------------------------ chunks

def page_chunks(documents: DataFrame, text: str, tags: list[str], words: int = 50) -> DataFrame:
    """Every page (line) of a document in chunks of up to ``words`` words, each with its tags.

    Columns: the tags, ``page``, ``chunk``, ``chunk_text``; nothing is shuffled.
    """
    pages = documents.select(*tags, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("page", "line"))
    split = pages.withColumn("w", F.filter(F.split("line", " "), lambda x: x != "")).filter(F.size("w") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / words).cast("int")),
                        lambda i: F.array_join(F.slice("w", i * words + 1, words), " "))
    return split.select(*tags, "page", F.posexplode(parts).alias("chunk", "chunk_text"))
