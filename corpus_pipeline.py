"""From raw documents to token ids: the corpus pipeline over the operators of tallyfolio.llm.

Stages in order: quality rules, near duplicates, secrets, source mix, BPE. Each takes and (but
for the last) returns the columns of ``documents``; its result is written as Parquet to the
shared folder and read again as the next one's input.

* ``quality``: rejected documents go.
* ``near_duplicates``: a document goes if it is 0.8 similar to a staying one with a smaller id.
* ``secrets``: secret values are masked in the text, and ``n_chars`` is counted anew.
* ``mix``: a document appears as often as the mix takes it, up to three times.
* ``encode``: doc_id, lang, source, ids and n_tokens.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfolio.llm import mixing, pair_index, quality, secrets, simhash
from tallyfolio.llm.common import documents, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs, stored=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.mask_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, stored=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pair_index.encode(docs, columns=["doc_id", "lang", "source"])


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("encode", encode),
]

# Secret masking by guess costs and BPE cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
