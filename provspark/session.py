"""Session defaults and shared-folder helpers used by every layer."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "provspark", cpus: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is spark.checkpoint.dir. Where that is unset, a local master uses a
    temporary folder that goes when the process ends; on a cluster this is an
    error, as executors would each write to a disk of their own.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
        folder = tempfile.mkdtemp(prefix="provspark-")
        atexit.register(shutil.rmtree, folder, True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scopes: list[list[tuple[SparkSession, str]]] = []


def stored(df: DataFrame, name: str = "step", **options: str) -> tuple[str, DataFrame]:
    """df written as Parquet to the shared folder: (its path, the table read back); options of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    if _scopes:
        _scopes[-1].append((spark, path))
    return path, spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives the planner true sizes.
    """
    return stored(df, name, **options)[1]


def materialize_large(df: DataFrame, name: str = "step") -> DataFrame:
    """materialize() of rows that are megabytes each.

    Spark reads a row group in batches of up to 4,096 rows and the writer looks
    at sizes after 100 rows, so row groups and pages are held to a few rows.
    """
    few = {"parquet.block.row.count.limit": "8", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
    return materialize(df, name, **few)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that operators store inside this scope are removed at its end, when the results have been written."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            discard(spark, path)
