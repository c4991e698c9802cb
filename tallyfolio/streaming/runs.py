"""Tables that streams write as merged runs, and the ids a stream has seen.

Every batch adds one run, a folder of rows in hash buckets of its key. ``FAN`` runs of one tier are
merged into one of the next, so that a table of n batches is some log(n) runs and a row is rewritten
as often. A manifest per batch names the runs that make up the table; it is written last. A
batch that is run again starts from the manifest of the batch before and replaces its own run, and
readers take the newest manifest: half-written runs are never seen.

A run has as many buckets as its rows need (``BUCKET_ROWS`` each), so looking up the keys of a batch
reads only the buckets they fall into, however long the history. Runs that are no longer named are
emptied a batch later. The folder belongs to the stream and lives as long as it does.
"""
from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FAN = 4
BUCKET_ROWS = 1 << 16
MOST_BITS = 14
# Manifests are kept for this many batches.
KEPT = 3


class Run(NamedTuple):
    name: str
    tier: int
    rows: int
    bits: int


_MANIFEST = "batch_id bigint, name string, tier int, rows bigint, bits int"


class RunTable:
    """Rows of ``schema`` under ``key``; ``merge`` reduces the rows of several runs to those of one."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, merge: Callable[[DataFrame], DataFrame],
                 fan: int = FAN, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.folder, self.schema, self.key, self.merge = spark, folder, schema, key, merge
        self.fan, self.bucket_rows = fan, bucket_rows

    def runs(self, before: int | None = None) -> list[Run]:
        """The runs of the newest manifest (of a batch before ``before``)."""
        return self._manifests(before)[0]

    def _manifests(self, before: int | None) -> tuple[list[Run], list[Run]]:
        """Runs of the newest manifest, and of the one before it."""
        try:
            known = self.spark.read.schema(_MANIFEST + ", slot int").parquet(f"{self.folder}/manifests").drop("slot").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            known = []
        batches = sorted({r["batch_id"] for r in known if before is None or r["batch_id"] < before}, reverse=True)[:2]
        found = [[Run(*tuple(r)[1:]) for r in known if r["batch_id"] == b and r["name"] is not None] for b in batches]
        return tuple((found + [[], []])[:2])

    def _bucket(self, bits: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(1 << bits)).cast("int")

    def _rows(self, run: Run) -> DataFrame:
        return self.spark.read.schema(self.schema + ", bucket int").parquet(f"{self.folder}/runs/{run.name}")

    def read(self, runs: list[Run] | None = None) -> DataFrame:
        """The rows of all runs; the same key may stand in several."""
        runs = self.runs() if runs is None else runs
        out = self.spark.createDataFrame([], self.schema)
        for run in runs:
            out = out.unionByName(self._rows(run).drop("bucket"))
        return out

    def lookup(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Rows under the keys of ``keys``, from the buckets they fall into only."""
        out = self.spark.createDataFrame([], self.schema)
        wanted = keys.select(self.key).distinct()
        for run in self.runs(before):
            # At most 2 ** MOST_BITS numbers.
            buckets = [r[0] for r in wanted.select(self._bucket(run.bits)).distinct().collect()] if run.bits else [0]
            rows = self._rows(run).filter(F.col("bucket").isin(buckets)).drop("bucket")
            out = out.unionByName(rows.join(wanted, self.key, "left_semi"))
        return out

    def _write(self, rows: DataFrame, name: str, tier: int, n: int) -> Run:
        bits = min(MOST_BITS, max(0, (max(n, 1) - 1) // self.bucket_rows).bit_length())
        bucketed = rows.withColumn("bucket", self._bucket(bits))
        # A bucket of a large run may be written by several tasks: no task holds more than its share.
        bucketed = bucketed.repartitionByRange("bucket", self.key) if bits else bucketed
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/runs/{name}")
        return Run(name, tier, n, bits)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """A batch's rows as a run, merges that are due, then the manifest.

        ``rows`` is read twice: a stored table.
        """
        active, previous = self._manifests(batch_id)
        for run in previous:
            if run not in active:
                # No batch can start from it any more.
                self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.folder}/runs/{run.name}")
        n = rows.count()
        runs = [*active, self._write(rows, f"b{batch_id}-0", 0, n)] if n else list(active)
        tier = 0
        while len(due := [r for r in runs if r.tier == tier]) >= self.fan:
            tier += 1
            name = f"b{batch_id}-{tier}"
            merged = self.merge(self.read(due))
            run = self._write(merged, name, tier, sum(r.rows for r in due))
            runs = [r for r in runs if r not in due] + [run]
        told = [(batch_id, *r) for r in runs] or [(batch_id, None, None, None, None)]
        (self.spark.createDataFrame(told, _MANIFEST).coalesce(1).withColumn("slot", F.lit(batch_id % KEPT)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(f"{self.folder}/manifests"))


def seen_ids(spark: SparkSession, folder: str, key: str, kind: str = "string", fan: int = FAN,
             bucket_rows: int = BUCKET_ROWS) -> RunTable:
    """The ids a stream has kept, each once."""
    return RunTable(spark, folder, f"{key} {kind}", key, lambda rows: rows.distinct(), fan, bucket_rows)
