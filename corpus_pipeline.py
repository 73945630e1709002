"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and reread as the next stage's ``docs``.  All but the last
return the columns of ``documents``.  Part of subpackage ``strikeline.llm``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from strikeline.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from strikeline.llm.common import clear_scratch, owned_by, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RUN = [""]


@contextmanager
def _stage(first: bool = False) -> Iterator[None]:
    """What a stage writes for itself belongs to its run.  A later stage deletes what earlier ones
    left: their results are written by then.  Tables of other runs and queries stay."""
    if first:
        _RUN[0] = uuid.uuid4().hex
    else:
        clear_scratch(_RUN[0])
    with owned_by(_RUN[0]):
        yield


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled rows of ``documents``."""
    with _stage(first=True):
        model = quality.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
        return quality.keep_good(docs, model)


def exact_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest id."""
    with _stage():
        return exact_dedup.drop_repeats(docs)


def near_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest id."""
    with _stage():
        return near_dedup.drop_near_repeats(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    with _stage():
        return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document."""
    with _stage():
        return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_repeats),
    ("near_dedup", near_repeats),
    ("decontamination", no_benchmark),
    ("packing", packed),
]

#: Classifier and tokenizer are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return result
        # no stage owns it, so none deletes it
        path = scratch_path(spark, f"stage-{name}")
        result.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
