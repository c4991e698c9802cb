"""Who and what belongs together: one id per party, documents that share a key."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyfolio.operators.staging import summary_join

# Legal forms that do not tell parties apart.
LEGAL_FORMS = ("inc", "corp", "corporation", "ltd", "limited", "llc", "gmbh", "co", "company", "plc")


def party_key(name: Column) -> Column:
    """Lower case, no punctuation, no legal form at the end, single spaces."""
    plain = F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9#]+", " "))
    return F.trim(F.regexp_replace(plain, rf"( ({'|'.join(LEGAL_FORMS)}))+$", ""))


def resolve_parties(names: DataFrame, name: str = "name") -> DataFrame:
    """Each distinct name with its canonical one: the smallest among names with the same key."""
    keyed = names.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("party_key", party_key(F.col(name)))
    canonical = keyed.groupBy("party_key").agg(F.min(name).alias("canonical"), F.count("*").alias("n_names"))
    return summary_join(keyed, canonical, "party_key").select(name, "party_key", "canonical", "n_names")


def link_documents(documents: DataFrame, key: str, doc: str = "doc_id") -> DataFrame:
    """Documents that share a key with another: the first of them and how many there are.

    A link is to the first document of the key, so a frequent key gives as many rows as documents.
    """
    keyed = documents.select(doc, key).filter(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min(doc).alias("first_doc"), F.count("*").alias("n_docs")).filter("n_docs > 1")
    return summary_join(keyed, first, key).select(doc, key, "first_doc", "n_docs")
