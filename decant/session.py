"""Session helpers shared by library code, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes a driver-side matrix may take before it is no longer broadcast.
SMALL_BYTES = 64 << 20


def local_session(cpus: int | str = "*", app: str = "decant", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a ``local[...]`` session, whose tasks all run in this process, may do without: it gets one temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_root(spark.sparkContext.applicationId)


@lru_cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a written table, so a lost executor re-reads instead of re-computing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Jobs run inside hand their Python steps ``rows`` rows at a time at most, so whole texts take a task little memory.

    Only the size of the pieces changes. What is planned later, such as a lazy frame made inside, follows the session again.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for what is planned inside; they are as before afterwards."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def even(df: DataFrame) -> DataFrame:
    """Even partitions, two a core, where heavy steps that follow stay."""
    d = df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    # a later filter would be pushed below the shuffle, to the pieces as they came; it stops at a column that is not deterministic
    return d.withColumn("_piece", F.spark_partition_id()).filter("_piece >= 0").drop("_piece")


def spread(df: DataFrame) -> DataFrame:
    """Even partitions ahead of a heavy per-row step, when the input comes in fewer pieces than there are cores.

    Input with enough pieces, the normal case on a cluster, is left as it is.
    """
    return even(df) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def attach(df: DataFrame, *totals: DataFrame) -> DataFrame:
    """Add the columns of one-row aggregates as scalar subqueries: nothing is joined or shuffled."""
    for t in totals:
        row = t.select(F.struct(*t.columns).alias("_t")).scalar()
        df = df.withColumn("_t", row).select(*df.columns, "_t.*")
    return df
