"""Files in a place that driver and executors share: the folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import SparkSession


def fresh(spark: SparkSession, name: str) -> str:
    """A new path there; only where the setting is absent (tests, notebooks) a local folder serves."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='strikeline-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, through the file system that its path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def at(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or address, and the path there (for tasks, which have no JVM)."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
