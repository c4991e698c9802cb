"""Evaluate once what is expensive, keep tables, and join so that hot keys can be split."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyfolio.session import scratch_path


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns as the output of a one-row generator.

    A filter on a computed column is normally rewritten in terms of what it was computed from,
    so a long chain of parsing and checking steps would be repeated inside the filter, and
    nested steps multiply. Generator output is never rewritten that way. The generator itself only
    passes on what a projection has worked out: a generator's own expressions are interpreted, and
    what they share is worked out again at every place, where a projection is compiled.
    """
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, *[c.alias(f"_made_{n}") for n, c in columns.items()])
    return made.select(*kept, F.inline(F.array(F.struct(*[F.col(f"_made_{n}").alias(n) for n in columns]))))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which losing executors cannot undo or change."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def summary_join(rows: DataFrame, summary: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with a ``summary`` of one row per key.

    An aggregate between the summary and its shuffle would keep adaptive execution from splitting a
    hot key. The summary is therefore a table of its own: both sides come straight from a shuffle,
    and only what is hot is split, at any number of rows.
    """
    return rows.join(written(summary, "summary"), key, how)
