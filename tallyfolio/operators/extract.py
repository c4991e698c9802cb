"""Live extraction: a caller's predictor run over a table of inputs.

The one place that needs Python workers. Everything the predictor returned or failed with
becomes rows of the attempts table; what they mean is decided by the cascade's columns.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

import tallyfolio
from tallyfolio.functions.records import normalize, reconcile
from tallyfolio.operators.cascade import (
    MAX_ATTEMPTS, TRANSIENT, CascadeOptions, resolve_calls, resolve_extraction, with_conformed)
from tallyfolio.schemas import ATTEMPTS

# Send this package's functions along with the tasks, so that workers need no copy of it.
cloudpickle.register_pickle_by_value(tallyfolio)


class CallError(Exception):
    """A failed call; ``error_class`` says whether it is worth another attempt."""

    def __init__(self, error_class: str, message: str):
        super().__init__(error_class, message)
        self.error_class = error_class

    def __str__(self) -> str:
        return self.args[1]


@dataclass(frozen=True)
class Reply:
    response_json: str
    tokens_in: int = 0
    tokens_out: int = 0


Predictor = Callable[[str | None, str | None], Reply]

# Seconds between attempts grow from the first to the second.
MIN_WAIT, MAX_WAIT = 1.0, 10.0


def call_model(inputs: DataFrame, make_predictor: Callable[[], Predictor], tier: str,
               purpose: str = "extract", max_attempts: int = MAX_ATTEMPTS,
               min_wait: float = MIN_WAIT, max_wait: float = MAX_WAIT,
               partitions: int | None = None, at_once: int = 1) -> DataFrame:
    """One attempts row per call over ``inputs(job_id, text, image_uri)``.

    The predictor is built once per partition. Passing failures are tried again up to the
    budget, with a growing wait; every other failure is final at once. ``partitions`` spreads
    the calls by job where the inputs come in too few pieces. ``at_once`` calls of a partition
    wait for their answers side by side; the predictor must then bear several threads.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make_predictor()

        def calls(job_id, text, image_uri) -> list[tuple]:
            rows = []
            for number in range(1, max_attempts + 1):
                started = time.monotonic()
                reply, failure = None, (None, None)
                try:
                    reply = predictor(text, image_uri)
                except Exception as exc:  # errors are rows, one document never stops others
                    failure = (getattr(exc, "error_class", "other"), str(exc))
                rows.append((job_id, tier, purpose, number, reply and reply.response_json,
                             *failure, time.monotonic() - started,
                             reply.tokens_in if reply else 0, reply.tokens_out if reply else 0))
                if failure[0] not in TRANSIENT or number == max_attempts:
                    break
                time.sleep(min(max_wait, max(min_wait, 2.0 ** (number - 1))))
            return rows

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                found = pool.map(calls, batch["job_id"], batch["text"], batch["image_uri"])
                yield pd.DataFrame([row for rows in found for row in rows], columns=ATTEMPTS.names)

    source = inputs.select("job_id", "text", "image_uri")
    if partitions:
        source = source.repartition(partitions, "job_id")
    return source.mapInPandas(run, ATTEMPTS)


def run_cascade(inputs: DataFrame, make_tier1: Callable[[], Predictor],
                make_tier2: Callable[[], Predictor], folder: str,
                options: CascadeOptions = CascadeOptions(), **call_options) -> DataFrame:
    """Call the tiers as far as each job needs them and return all attempts.

    Each pass is written to ``folder`` before the next one reads it: calls cost money, so a
    lost executor must never repeat a finished pass. Jobs that a pass has already are not called
    again, so starting over with the same folder only makes the calls that are missing. Later
    passes only see the rows that need them, filtered before Python is reached.
    """
    spark = inputs.sparkSession

    def keep(rows: DataFrame, name: str, make: Callable[[], Predictor], tier: str, purpose: str) -> DataFrame:
        path = f"{folder}/{name}"
        try:
            done = spark.read.schema(ATTEMPTS).parquet(path).select("job_id").distinct()
            rows = rows.join(done, "job_id", "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise       # else the pass begins
        calls = call_model(rows, make, tier, purpose, options.max_attempts, **call_options)
        calls.write.mode("append").parquet(path)
        return spark.read.schema(ATTEMPTS).parquet(path)

    first = keep(inputs, "tier1", make_tier1, options.tier1, "extract")
    unfit = with_conformed(resolve_calls(first, options), "first").filter(F.col("first_fault").isNotNull())
    second = keep(inputs.join(unfit.select("job_id"), "job_id", "left_semi"), "tier2", make_tier2, options.tier2, "extract")

    read = resolve_extraction(resolve_calls(first.unionByName(second), options), options)
    doubtful = read.filter(F.size(reconcile(normalize(F.col("read_invoice")))) > 0)
    premium = keep(inputs.join(doubtful.select("job_id"), "job_id", "left_semi"), "premium", make_tier2, options.tier2,
                   "reconcile")
    return first.unionByName(second).unionByName(premium)
