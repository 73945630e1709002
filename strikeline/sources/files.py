"""Scans: CSV as text with lineage, envelopes, manifests, archives in ZIP files, byte probes."""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.functions.parsing import require


def read_csv(spark: SparkSession, path: str | list[str], required: tuple[str, ...] = ()) -> DataFrame:
    """All columns as text, a byte-order mark ignored; an empty file or a missing column is an error."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if not df.columns:
        raise ValueError(f"no header in {path}")
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})
    return require(df, required)


def with_lineage(df: DataFrame) -> DataFrame:
    """Add the file each row comes from."""
    return df.withColumns({"_source_file": F.col("_metadata.file_name"), "_artifact": F.col("_metadata.file_path")})


def read_csv_union(spark: SparkSession, path: str, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """All CSV files of a folder by column name, and (file, error) of those whose header lacks a column.

    Headers are one line per file; files with equal headers are read by one scan.
    """
    first = spark.read.option("pathGlobFilter", "*.csv").text(path)
    first = first.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), "value").where("at = 0")
    heads = first.groupBy("file").agg(F.min_by("value", "row").alias("head"))
    layouts: dict[tuple[str, ...], list[str]] = {}
    errors = []
    for file, head in heads.toLocalIterator():  # one short line per file
        names = tuple(n.strip() for n in next(csv.reader([head.lstrip("﻿")])))
        if missing := sorted(set(required) - set(names)):
            errors.append((file, f"missing required columns: {missing}"))
        else:
            layouts.setdefault(names, []).append(file)
    parts = [with_lineage(read_csv(spark, files, required)) for _, files in sorted(layouts.items())]
    bad = spark.createDataFrame(sorted(errors), "file string, error string")
    if not parts:
        raise ValueError(f"no readable CSV file in {path}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out, bad


def read_envelope(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The one-row header and the records of a JSON envelope."""
    whole = require(spark.read.option("multiLine", True).json(path), ("records",))
    return whole.drop("records"), whole.selectExpr("inline(records)")


def read_manifests(spark: SparkSession, path: str, source_prefix: str, name: str = "MANIFEST.json") -> DataFrame:
    """All manifests below ``path`` whose source begins with a prefix."""
    found = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(path)
    return found.where(F.col("source").startswith(source_prefix))


def read_zipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, fields) of the first CSV member of every archive: fields is a map of texts.

    An archive without such a member, or with a bad checksum, gives one row with ``error``.
    """
    return unzip_csv(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path))


def unzip_csv(archives: DataFrame) -> DataFrame:
    """The same for archives that are rows (path, content)."""

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        if (bad := z.testzip()) is not None:
                            raise ValueError(f"bad checksum: {bad}")
                        member = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                        if member is None:
                            raise ValueError("no CSV member")
                        rows = pd.read_csv(io.BytesIO(z.read(member)), dtype=str, keep_default_na=False, chunksize=20_000)
                        at = 0
                        for chunk in rows:
                            names = [c.strip().lstrip("﻿") for c in chunk.columns]
                            fields = [{n: v for n, v in zip(names, r, strict=True) if not n.startswith("Unnamed")} for r in chunk.itertuples(index=False, name=None)]
                            yield pd.DataFrame({"path": file, "row": range(at, at + len(fields)), "fields": fields, "error": None})
                            at += len(fields)
                except Exception as e:  # a bad archive is a result, not a failure
                    yield pd.DataFrame({"path": [file], "row": [0], "fields": [{}], "error": [str(e)]})

    return archives.select("path", "content").mapInPandas(run, "path string, row long, fields map<string,string>, error string")


def probe(spark: SparkSession, path: str) -> DataFrame:
    """Size, hash and first line of every file."""
    head = F.substring_index(F.decode("content", "UTF-8"), "\n", 1)
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.rtrim(head, F.lit("\r")).alias("first_line"))


def probe_json(spark: SparkSession, path: str, sample: int = 3) -> DataFrame:
    """Kind, keys, number of rows and a sample of a stored JSON answer."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    data = F.coalesce(F.get_json_object("v", "$.data"), F.get_json_object("v", "$.records"), F.col("v"))
    rows = F.from_json(data, "array<string>")
    return text.select(F.when(F.col("v").startswith("["), "list").otherwise("dict").alias("kind"), F.json_object_keys("v").alias("keys"), F.json_array_length(data).alias("row_count"), F.slice(rows, 1, sample).alias("sample"))
