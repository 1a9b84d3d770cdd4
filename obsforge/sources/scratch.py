"""Files that the driver and all executors share: folders for tables that a query writes, and small files that are created once."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a temporary one where that is unset, in a local session only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not top and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(top or 'file://' + tempfile.mkdtemp(prefix='obsforge-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def create_once(spark: SparkSession, file: str, content: bytes) -> bool:
    """Create a file, whole, if there is none; False if there is, whoever created it.

    Stores of their own refuse a second creation. Hadoop's local file system only looks before it
    writes, so there a finished file is linked to the name, which one writer alone can do.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        name = path.toUri().getPath()
        os.makedirs(os.path.dirname(name), exist_ok=True)
        made = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        with open(made, "wb") as f:
            f.write(content)
        try:
            os.link(made, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(made)
        return True
    try:
        out = fs.create(path, False)
    except Py4JJavaError:
        if fs.exists(path):
            return False
        raise
    out.write(bytearray(content))
    out.close()
    return True


def content_of(spark: SparkSession, file: str) -> bytes:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()
