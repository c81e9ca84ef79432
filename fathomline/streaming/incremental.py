"""Continuation of a run as a stream: each input is done once, however often the stream restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def continue_run(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, key: str, process: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Process new files of ``source`` and append the results of keys that ``sink`` lacks.

    Exactly once by key: within a batch a key is processed once; a batch that is
    run again after a loss finds its keys in the sink and adds nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if _exists(spark, sink):
            fresh = fresh.join(spark.read.parquet(sink).select(key).distinct(), key, "left_anti")
        process(fresh).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def stage_counts_stream(events: DataFrame, time: str, keys: list[str], late: str = "2 days", window: str = "1 day") -> DataFrame:
    """Rows per window and keys of a stream, with rows later than ``late`` left out of closed windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(target) and any(s.isFile() and s.getPath().getName().endswith(".parquet") for s in fs.listStatus(target))
