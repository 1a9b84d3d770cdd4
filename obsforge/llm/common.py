"""Shared pieces of the training-data operators: table access, durable intermediates, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that is sent to a Python worker: bound its memory where texts are long. A longer row is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 256, 4 << 20
#: Rows that a join broadcasts at most (about 100 bytes each at most), counted beforehand; with more of them both sides are shuffled.
BROADCAST_ROWS = 200_000

_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application that the driver and all executors share.

    It lies in ``spark.checkpoint.dir``. Only in a local session, as in tests, a temporary folder is
    made where that is unset; a cluster's executors would not see it, so there it is an error. The
    folder is deleted when the driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not top:
            if not is_local(spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="obsforge-")
        _folders[app] = f"{top.rstrip('/')}/obsforge-{app}"
        atexit.register(_forget, spark, _folders[app])
    return _folders[app]


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, and so see the same local folders."""
    return master == "local" or master.startswith("local[")


def _forget(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        delete_folder(spark, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Durable:
    """Parquet intermediates that cut lineage and survive lost executors.

    ``keep`` writes a frame and gives it back as read from the files; ``drop`` deletes those that
    are no longer read.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                delete_folder(self.spark, path)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Hold Arrow batches of this session to so many rows and bytes, since documents may be very long.

    Spark reads both settings when a query starts, after its operators are made, so they stay set
    for the session; they are only ever lowered.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not now.isdigit() or int(now) not in range(1, most + 1):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def sized(written: DataFrame) -> DataFrame:
    """A written table for the right of a join: to be broadcast if it is counted to be small."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def hashed_share(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash is among the smallest ``share`` of all hashes, however small the share."""
    below = int(share * (1 << 64)) - (1 << 63)
    return F.lit(share >= 1) | (hashed < F.lit(min(below, (1 << 63) - 1)))


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``each`` over the Arrow batches of ``df``, one at a time."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def utf8(column: str | Column) -> Column:
    """The bytes of a text; a null text is an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def unsigned_hex(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
