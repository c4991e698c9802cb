"""Quality rules with thresholds learnt per language and source.

Four rates of a document (symbols, duplicate lines, repeated word windows, word length) are
summarised per (language, source) in mergeable quantile sketches: counts per log-linear
bucket of an integer rate, as in DDSketch. Sketches add: a group's sketch is merged with
``PRIOR`` documents' worth of its language's, a language's with as much of everything, so a
small group leans on its language and a large one speaks for itself. A document is rejected
where a rate lies above the group's fence, ``median + REACH * spread``. The spread is that from
the median to the upper quartile; where they coincide, to the upper tenth; and ``UNITS`` at
least, since a source without any symbols must not make two of them an outlier. A source that
is mostly junk has a high fence, so the fence of its language is a second bound.

A rate of a short document says little: its count must exceed what the fence allows by a few
symbols, lines, words or characters (``COUNTED``); one repeated sentence is no evidence.

Defined results: a null text has no words and fails the base rules; a null language or source
is a group of its own; repeated rows are judged alike; an empty table gives an empty table.
Repeated word windows are found by 64-bit hashes within one document.
"""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyfolio.llm.common import documents, fresh, words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[^#*$%&|<>]"
# Documents' worth of the wider sketch that a group's own is merged with.
PRIOR = 50
REACH = 12
# Rates are per 1000 words (or lines); word length is in hundredths of a character.
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length")
# Least spread, in units of the rate.
UNITS = 5
# Count, what it is counted in, rate units, and how many of it must lie beyond the fence.
COUNTED = {"symbol_rate": ("n_symbols", "n_words", 1000, 3), "dup_line_rate": ("n_dup_lines", "n_lines", 1000, 3),
           "repeat_rate": ("n_repeat_words", "n_words", 1000, 30), "word_length": ("word_chars", "n_words", 100, 30)}
_EXACT = 64


def _same_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("distinct"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column as generator output: later steps read it, none evaluates it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def measured(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct ``out`` of the counts and rates of every whole text."""
    w, h, p, again_, ln = (fresh(docs, n) for n in ("_words", "_windows", "_repeats", "_places", "_lines"))
    body = F.coalesce(F.col(text), F.lit(""))
    df = _once(docs, w, words(F.col(text)))
    ahead = F.greatest(F.size(w) - 2, F.lit(0))
    df = _once(df, h, F.transform(
        F.slice(F.col(w), F.lit(1), ahead),
        lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2))))
    # Sorted (hash, position): equal neighbours are windows that occur again.
    order = F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = _once(df, p, F.when(F.size(F.array_distinct(h)) < F.size(h), order)
               .otherwise(F.slice(order, 1, 0)))
    again = F.sort_array(F.transform(
        F.filter(F.col(p), lambda x, k: (F.get(F.col(p), k - 1)["h"] == x["h"])
                 | (F.get(F.col(p), k + 1)["h"] == x["h"])), lambda x: x["i"]))
    df = _once(df, again_, again)
    covered = F.aggregate(
        F.transform(F.col(again_), lambda x, k: F.least(
            F.lit(3), F.coalesce(F.get(F.col(again_), k + 1) - x, F.lit(3)))),
        F.lit(0).cast("int"), lambda a, x: a + x)
    df = _once(df, ln, _same_lines(body))
    n = F.size(w).cast("bigint")
    chars = F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("bigint")
    symbols = F.length(F.regexp_replace(body, SYMBOLS, "")).cast("bigint")
    counts = F.struct(
        n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"),
        (F.col(ln)["n"] - F.col(ln)["distinct"]).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"), F.col(ln)["n"].cast("bigint").alias("n_lines"))
    df = df.select(*docs.columns, F.explode(F.array(counts)).alias(out))
    q = F.col(out)

    def per(top: Column, bottom: Column, unit: int) -> Column:
        return F.when(bottom > 0, F.floor(top * unit / bottom)).otherwise(0).cast("bigint")

    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    return df.withColumn(out, F.struct(
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")],
        failed.alias("base_failed"), *[per(q[top], q[of], unit).alias(r) for r, (top, of, unit, _) in COUNTED.items()]))


def bucket(v: Column) -> Column:
    """Lower end of the log-linear bucket of a count: exact below 64, then 1/32 wide."""
    width = F.pow(F.lit(2.0), F.length(F.bin(v)) - 6).cast("bigint")
    return F.when(v < _EXACT, v).otherwise(v - v % width)


def sketches(features: DataFrame, lang: str = "lang", source: str = "source",
             out: str = "quality") -> DataFrame:
    """Counts per (lang, source, rate, bucket); sketches of several tables merge by adding.

    Documents that fail the base rules take no part: they are rejected whatever the fence.
    """
    rates = F.array(*[F.struct(F.lit(r).alias("rate"), bucket(F.col(out)[r]).alias("b")) for r in RATES])
    return (features.filter(~F.col(out)["base_failed"])
            .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(rates))
            .groupBy("lang", "source", "rate", "b").agg(F.count("*").alias("n")))


def merged(own: DataFrame, wide: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Sketches ``own`` (keys, rate, b, n), each with ``PRIOR`` documents' worth of ``wide`` (on, rate, b, n).

    Counts are multiplied by the wide sketch's total instead of dividing the prior by it.
    """
    whole = "decimal(38,0)"
    wide = wide.select(*[F.col(c).alias(f"w_{c}") for c in [*on, "rate", "b", "n"]])
    totals = wide.groupBy(*[f"w_{c}" for c in [*on, "rate"]]).agg(F.sum("w_n").alias("w_total"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in [*on, "rate"]])
    mine = own.join(totals, same).select(*keys, "rate", "b", (F.col("n").cast(whole) * F.col("w_total").cast(whole)).cast(whole).alias("n"))
    prior = own.select(*keys, "rate").distinct().join(wide, same).select(
        *keys, "rate", F.col("w_b").alias("b"), (F.col("w_n").cast(whole) * PRIOR).cast(whole).alias("n"))
    return mine.unionByName(prior).groupBy(*keys, "rate", "b").agg(F.sum("n").alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The fence per group, read off its sketch."""
    group = Window.partitionBy(*keys, "rate")
    ranked = sketch.select(
        *keys, "rate", "b", F.sum("n").over(group).alias("total"),
        F.sum("n").over(group.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)).alias("seen"))

    def quantile(part: int, of: int) -> Column:
        # The first bucket at which that share of the rows has been seen.
        return F.min(F.when(F.col("seen") * of >= F.col("total") * part, F.col("b")))

    quart = ranked.groupBy(*keys, "rate").agg(
        quantile(1, 2).alias("mid"), quantile(3, 4).alias("high"), quantile(9, 10).alias("tail"))
    spread = F.greatest(F.when(F.col("high") > F.col("mid"), F.col("high")).otherwise(F.col("tail")) - F.col("mid"), F.lit(UNITS))
    return quart.select(*keys, "rate", (F.col("mid") + REACH * spread).alias("fence"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): the value above which each rate rejects."""
    of_lang = sketch.groupBy("lang", "rate", "b").agg(F.sum("n").alias("n"))
    overall = of_lang.groupBy("rate", "b").agg(F.sum("n").alias("n"))
    own = _fences(merged(sketch, of_lang, ["lang", "source"], ["lang"]), ["lang", "source"])
    wide = _fences(merged(of_lang, overall, ["lang"], []), ["lang"]).select(
        F.col("lang").alias("l"), F.col("rate").alias("r"), F.col("fence").alias("wide"))
    df = own.join(wide, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rate") == F.col("r")))
    return df.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("rate") == r, F.least("fence", "wide"))).alias(r) for r in RATES])


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
           out: str = "quality", columns: list[str] | None = None) -> DataFrame:
    """``docs`` with the struct ``out``: counts, rates, ``base_failed`` and the verdict ``kept``.

    ``columns`` names the columns to carry along (all, if not given).

    Texts are measured once, into a table of the shared folder. The thresholds are a table of
    one row per group: Spark broadcasts it if its files are below its limit, and otherwise
    both sides have a shuffle of their own, which lets it split the rows of a hot source.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"documents already have a column {out}")
    columns = docs.columns if columns is None else columns
    features = measured(docs, text, out).select(*dict.fromkeys([*columns, lang, source]), out)
    features = written(features, "quality-features")
    limits = written(thresholds(written(sketches(features, lang, source, out), "quality-sketches")), "quality-thresholds")
    limit = fresh(features, "limit")
    limits = limits.select(F.struct("*").alias(limit))
    df = features.join(limits, F.col(lang).eqNullSafe(F.col(limit)["lang"])
                       & F.col(source).eqNullSafe(F.col(limit)["source"]), "left")
    fine = F.lit(True)
    for r, (top, of, unit, least) in COUNTED.items():
        fine = fine & (unit * (F.col(out)[top] - least) <= F.col(limit)[r] * F.col(out)[of])
    kept = ~F.col(out)["base_failed"] & F.coalesce(fine, F.lit(False))
    return df.select(*columns, F.col(out).withField("kept", kept).alias(out))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    out = fresh(docs, "quality")
    return judged(docs, text, lang, source, out).filter(F.col(out)["kept"]).select(*docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    df = judged(docs, columns=["doc_id"])
    return df.select("doc_id", *[F.col("quality")[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "symbol_rate", "dup_line_rate", "repeat_rate", "word_length")])


QUERIES = {"op9_quality_rules": op9_quality_rules}

_BUCKET = "CASE WHEN {0} < 64 THEN {0} ELSE {0} - {0} % CAST(pow(2, length(bin({0})) - 6) AS BIGINT) END"


def _oracle() -> str:
    w = r"[^\x20\x09-\x0D]+"
    stacked = " UNION ALL ".join(
        f"SELECT lang, source, '{r}' AS rate, {_BUCKET.format(r)} AS b FROM feats WHERE NOT base_failed"
        for r in RATES)

    def merged_sql(name: str, own: str, wide: str, keys: str, on: str) -> str:
        same = f"o.{on} IS NOT DISTINCT FROM w.{on} AND " if on else ""
        of = f"{on}, " if on else ""
        names = ", ".join(f"o.{k.strip()}" for k in keys.split(","))
        return f"""{name} AS (
  SELECT {keys}, rate, b, sum(n) AS n FROM (
    SELECT {names}, o.rate, o.b, o.n::HUGEINT * w.total AS n
    FROM {own} o JOIN (SELECT {of}rate, sum(n) AS total FROM {wide} GROUP BY {of}rate) w ON {same}o.rate = w.rate
    UNION ALL
    SELECT {names}, o.rate, w.b, w.n::HUGEINT * {PRIOR}
    FROM (SELECT DISTINCT {keys}, rate FROM {own}) o JOIN {wide} w ON {same}o.rate = w.rate)
  GROUP BY {keys}, rate, b)"""

    def fences(name: str, sketch: str, keys: str) -> str:
        return f"""{name} AS (
  SELECT {keys}, rate, mid + {REACH} * greatest(CASE WHEN high > mid THEN high ELSE tail END - mid, {UNITS}) AS fence
  FROM (SELECT {keys}, rate, min(b) FILTER (seen * 2 >= total) AS mid, min(b) FILTER (seen * 4 >= total * 3) AS high,
               min(b) FILTER (seen * 10 >= total * 9) AS tail
        FROM (SELECT {keys}, rate, b, sum(n) OVER (PARTITION BY {keys}, rate) AS total,
                     sum(n) OVER (PARTITION BY {keys}, rate ORDER BY b ROWS UNBOUNDED PRECEDING) AS seen
              FROM {sketch})
        GROUP BY {keys}, rate))"""

    limits = ", ".join(f"max(fence) FILTER (rate = '{r}') AS {r}" for r in RATES)
    fine = " AND ".join(f"{unit} * (f.{top} - {least}) <= l.{r} * f.{of}" for r, (top, of, unit, least) in COUNTED.items())
    return f"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{w}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '{w}')) AS ls
  FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM base),
wins AS (
  SELECT doc_id, i, w || ' ' || lead(w) OVER d || ' ' || lead(w, 2) OVER d AS g
  FROM pos WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins WHERE g IS NOT NULL)
  WHERE c > 1),
reps AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN reps USING (doc_id)),
feats AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbol_rate,
         CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line_rate,
         CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_rate,
         CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_length
  FROM counted),
stacked AS ({stacked}),
sketch AS (SELECT lang, source, rate, b, count(*) AS n FROM stacked GROUP BY ALL),
of_lang AS (SELECT lang, rate, b, sum(n) AS n FROM sketch GROUP BY ALL),
overall AS (SELECT rate, b, sum(n) AS n FROM of_lang GROUP BY ALL),
{merged_sql("own_merged", "sketch", "of_lang", "lang, source", "lang")},
{merged_sql("lang_merged", "of_lang", "overall", "lang", "")},
{fences("own", "own_merged", "lang, source")},
{fences("by_lang", "lang_merged", "lang")},
fence AS (
  SELECT o.lang, o.source, o.rate, least(o.fence, l.fence) AS fence
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate),
limits AS (SELECT lang, source, {limits} FROM fence GROUP BY lang, source)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
       NOT f.base_failed AND coalesce({fine}, false) AS kept,
       f.symbol_rate, f.dup_line_rate, f.repeat_rate, f.word_length
FROM feats f LEFT JOIN limits l
  ON f.lang IS NOT DISTINCT FROM l.lang AND f.source IS NOT DISTINCT FROM l.source"""


ORACLE = {"op9_quality_rules": _oracle()}
