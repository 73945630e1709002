"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which
driver and executors share, so a lost executor costs a re-read and never a
result.  Only when that setting is absent (tests, notebooks) a local temporary
folder is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Intermediate tables by the owner that may delete them; no owner: they stay until the program ends.
_SCRATCH: dict[str | None, list[tuple[SparkSession, str]]] = {}
_OWNER: list[str | None] = [None]


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; sets one only where none is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        found = found or "file://" + tempfile.mkdtemp(prefix="strikeline-")
        sc.setCheckpointDir(found)
        current = sc._jsc.sc().getCheckpointDir()
    return (found or current.get()).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one intermediate table."""
    path = f"{shared_dir(spark)}/scratch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(_OWNER[-1], []).append((spark, path))
    return path


@contextmanager
def owned_by(owner: str) -> Iterator[None]:
    """Tables written meanwhile belong to ``owner``, which may delete them by :func:`clear_scratch`."""
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def materialise(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(owner: str | None) -> None:
    """Delete the intermediate tables of ``owner``, whose results have been written by now."""
    for spark, path in _SCRATCH.pop(owner, []):
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already
            continue


@atexit.register
def _clear_all() -> None:
    for owner in list(_SCRATCH):
        clear_scratch(owner)


def free_names(taken: Iterable[str], *stems: str) -> list[str]:
    """Column names that no column of ``taken`` has, whatever the case of its letters."""
    held = {t.lower() for t in taken}
    found = []
    for stem in stems:
        name = f"own_{stem}"
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        found.append(name)
    return found


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Split record batches so that ``column`` holds at most ``max_bytes`` in each (or one row)."""
    for batch in batches:
        start, size = 0, 0
        values = batch.column(batch.schema.get_field_index(column))
        if values.nbytes <= max_bytes:
            yield batch
            continue
        import pyarrow.compute as pc

        for i, n in enumerate(pc.fill_null(pc.binary_length(values), 0).to_pylist()):
            if size and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
