"""Incremental runs over a landing folder: each new file is decoded once.

Per-binary tables need no event time, so there is no watermark. The stream's
checkpoint keeps which files were read; contents that were seen under another
name are dropped by digest against the output itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provspark.sources.sinks import append_new

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def process_landing(spark: SparkSession, landing: str, state: str, decode: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Decode all files that are new since the last call and append the rows to out (Parquet, with a digest column).

    decode takes (path, content) and returns rows with binary_id. A batch that
    is tried again after a failure adds nothing twice.
    """

    def batch(files: DataFrame, _: int) -> None:
        named = files.select("path", F.sha2("content", 256).alias("digest"))
        one = named.groupBy("digest").agg(F.min("path").alias("binary_id"))
        append_new(decode(files.select("path", "content")).join(one, "binary_id"), out, ["digest"])

    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).load(landing)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
