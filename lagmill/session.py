"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "lagmill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with adaptive execution; ``master`` and ``shuffle_partitions`` are for local runs only."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # No call-site capture per column expression: it dominates the time to build plans of many expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; the cluster names it in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="lagmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Within, rows go to Python workers in batches of at most about ``size`` bytes; jobs must run within, not be planned only."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.getAll.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
