"""Structured Streaming: idempotent appends and tumbling rollups with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lifecycle

LATENESS = "10 minutes"


def append_once(table: str, path: str, stream_id: str):
    """A ``foreachBatch`` sink into a stored table, whose batches are written at most once.

    A batch is one commit that carries its number; a number that the table has, of this stream, is
    left out. A batch that broke off before its commit left nothing that is read, and is written anew.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        lifecycle.write(batch, table, path, batch=(stream_id, batch_id))

    return sink


def ingest(stream: DataFrame, table: str, path: str, checkpoint: str, stream_id: str = "main") -> StreamingQuery:
    """All that is there, into a stored table; a later call goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(append_once(table, path, stream_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup(stream: DataFrame, time: str, width: str, keys: tuple[str, ...], value: str, lateness: str = LATENESS) -> DataFrame:
    """Count, sum, min and max by key in epoch-aligned windows; later rows than the watermark are left out."""
    timed = stream.withWatermark(time, lateness)
    return timed.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("window.start").alias("bucket"), *keys, "n", "total", "least", "most")


def replay(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
