"""What belongs together through several keys, and names that are spelt alike.

Keys shared by many documents are stars around their first document, never pairs. Groups are
found by rounds of large stars and small stars (Kiveris et al. 2014); each round is a table.
Names are joined by the rarest pairs of letters they hold: two names within ``d`` edits share one of
their ``2 d + 1`` rarest pairs at nearly the same place, so a word that all names have makes no pairs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyfolio.operators.parties import party_key
from tallyfolio.operators.staging import summary_join, written

# Names shorter than LEAST letters are only joined if equal; from LONG letters on two edits are one name.
LEAST, LONG = 5, 9


# ------------------------------------------------------------------ groups

def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the least of its neighbours and itself."""
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    low = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")), "group-low")
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = written(down.groupBy("a").agg(F.min("b").alias("low")), "group-low")
    return down.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))


def groups(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the least node it is connected to."""
    current = written(edges.select(F.col("a"), F.col("b")).filter("a <> b").distinct(), "group-edges")
    before = None
    while True:
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        stars = written(_large_star(current).filter("a <> b").distinct(), "group-large")
        current = written(_small_star(stars).filter("a <> b").distinct(), "group-small")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.union(members.select("root", "root").distinct())


def link_groups(documents: DataFrame, keys: list[str], doc: str = "doc_id") -> DataFrame:
    """(doc, group_id, n_docs, n_links) for documents linked through any of the keys, over others too.

    ``n_links`` counts, key by key, the other documents that share the document's value. Null keys
    link nothing; a document that shares no value is a group of its own.
    """
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k")
    held = written(documents.select(doc, value).select(doc, "k.*").filter("value IS NOT NULL")
                   .withColumn("key", F.concat_ws("=", "kind", "value")).select(doc, "key").distinct(), "group-held")
    first = held.groupBy("key").agg(F.min(doc).alias("first"), F.count("*").alias("n")).filter("n > 1")
    shared = written(summary_join(held, first, "key"), "group-shared")
    members = groups(shared.select(F.col(doc).alias("a"), F.col("first").alias("b")))
    links = shared.groupBy(doc).agg(F.sum(F.col("n") - 1).alias("n_links"))
    named = documents.select(doc).distinct().join(members.withColumnRenamed("node", doc), doc, "left").join(links, doc, "left")
    named = written(named.select(doc, F.coalesce("root", doc).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "group-named")
    sizes = named.groupBy("group_id").agg(F.count("*").alias("n_docs"))
    return summary_join(named, sizes, "group_id").select(doc, "group_id", "n_docs", "n_links")


# ------------------------------------------------------------------ names spelt alike

def edits(length: Column) -> Column:
    """Edits that two names of this length (the shorter one's) may differ by."""
    return F.when(length < LEAST, 0).when(length < LONG, 1).otherwise(2)


def alike(names: DataFrame, name: str = "party_key") -> DataFrame:
    """(one, two): pairs of distinct names within ``edits`` of each other; their numbers must agree.

    No pair is missed: an edit changes two pairs of letters at most, and moves the others by one place.
    """
    each = names.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct()
    each = each.withColumn("len", F.length("name")).withColumn("d", edits(F.col("len"))).filter("d > 0")
    padded = F.concat(F.lit("\u0001"), F.col("name"), F.lit("\u0002"))
    grams = each.select("name", "len", "d", F.regexp_replace("name", "[^0-9]", "").alias("number"),
                        F.posexplode(F.transform(F.sequence(F.lit(1), F.col("len") + 1), lambda i: F.substring(padded, i, F.lit(2)))).alias("at", "gram"))
    grams = written(grams, "alike-grams")
    counts = grams.groupBy("number", "gram").agg(F.count("*").alias("n"))
    # A pair of letters at several places is as many pairs, told apart by place.
    kept = grams.join(written(counts, "alike-counts"), ["number", "gram"]).groupBy("name", "number", "len", "d").agg(
        F.sort_array(F.collect_list(F.struct("n", "gram", "at"))).alias("g"))
    rare = written(kept.select("name", "number", "len", "d", F.explode(F.slice("g", F.lit(1), 2 * F.col("d") + 1)).alias("g"))
                   .select("name", "number", "len", "d", "g.gram", "g.at"), "alike-rare")
    one, two = (rare.select("number", "gram", *[F.col(c).alias(f"{c}{k}") for c in ("name", "len", "d", "at")]) for k in (1, 2))
    d = F.least("d1", "d2")
    near = (F.col("name1") < F.col("name2")) & (F.abs(F.col("len1") - F.col("len2")) <= d) & (F.abs(F.col("at1") - F.col("at2")) <= d)
    same = (one["number"] == two["number"]) & (one["gram"] == two["gram"])
    pairs = one.join(two, same & near).select("name1", "name2", d.alias("d")).distinct()
    return pairs.filter(F.levenshtein("name1", "name2") <= F.col("d")).select(F.col("name1").alias("one"), F.col("name2").alias("two"))


def resolve_alike(names: DataFrame, name: str = "name") -> DataFrame:
    """Each distinct name with its key, and the canonical name of all that are spelt like it.

    Spelling is compared key by key; a chain of likenesses is one party, named by its smallest name.
    """
    keyed = written(names.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("party_key", party_key(F.col(name))), "alike-names")
    same = groups(alike(keyed).toDF("a", "b"))
    party = keyed.join(same.withColumnRenamed("node", "party_key"), "party_key", "left").withColumn("root", F.coalesce("root", "party_key"))
    party = written(party, "alike-parties")
    canonical = party.groupBy("root").agg(F.min(name).alias("canonical"), F.count("*").alias("n_names"))
    return summary_join(party, canonical, "root").select(name, "party_key", "canonical", "n_names")
