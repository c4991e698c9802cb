"""Spark session defaults and the shared scratch folder."""
from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tallyfolio", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs rely on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the launcher decides the
    first, and AQE coalesces from the cluster's own default for the second.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The JVM does not compile methods above this size; wide projections are split instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Recording the call site of every column costs several round trips to the JVM each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        # A small machine reads small files in as many pieces as it has cores.
        builder = builder.config("spark.sql.files.minPartitionNum", str(shuffle_partitions))
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="tallyfolio-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where the cluster names it.

    Only a local-mode session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_dir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten or reused."""
    return os.path.join(shared_dir(spark), "tallyfolio", f"{name}-{uuid.uuid4().hex}")
