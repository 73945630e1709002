"""A date-partitioned archive as a Python data source, and the manifests of acquisitions and snapshots.

A partition is a run of days (``daysPerTask``); the fetcher is pluggable.  The one
here looks for the day's file in a list of folders (a primary and its mirrors, in
order; paths or addresses that every executor reaches), retries with growing
pauses, and calls a day missing only if no tier has it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strikeline.sources.shared import at

CUTOVER = dt.date(2024, 7, 8)
SCHEMA = "day date, route string, status string, source_tier int, attempts array<struct<tier: int, outcome: string>>, bytes long, sha256 string, content binary"


def route_of(day: dt.date, cutover: dt.date = CUTOVER) -> str:
    return "udiff" if day >= cutover else "legacy"


# Names of months, files and folders of the public archive.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def file_name(day: dt.date, cutover: dt.date = CUTOVER) -> str:
    """Where, below its root, the archive keeps a day's file."""
    if route_of(day, cutover) == "udiff":
        return f"content/fo/BhavCopy_NSE_FO_0_0_0_{day:%Y%m%d}_F_0000.csv.zip"
    month = MONTHS[day.month - 1]
    return f"content/historical/DERIVATIVES/{day:%Y}/{month}/fo{day:%d}{month}{day:%Y}bhav.csv.zip"


class Days(InputPartition):
    def __init__(self, days: list[dt.date]):
        self.days = days


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.first, self.last = (dt.date.fromisoformat(options[k]) for k in ("start", "end"))
        self.tiers = options["tiers"].split(",")
        self.retries, self.pause = int(options.get("retries", 4)), float(options.get("pause", 0))
        self.together, self.delay = int(options.get("daysPerTask", 1)), float(options.get("delay", 0))

    def partitions(self):
        days = [self.first + dt.timedelta(days=i) for i in range((self.last - self.first).days + 1)]
        return [Days(days[i : i + self.together]) for i in range(0, len(days), self.together)]

    def fetch(self, day: dt.date) -> tuple[str, int | None, list[tuple[int, str]], bytes | None]:
        attempts: list[tuple[int, str]] = []
        for tier, folder in enumerate(self.tiers):
            system, root = at(folder)
            path = f"{root.rstrip('/')}/{file_name(day)}"
            for k in range(self.retries + 1):
                try:
                    with system.open_input_stream(path) as f:
                        content = f.read()
                    attempts.append((tier, "OK"))
                    return "VALIDATED", tier, attempts, content
                except FileNotFoundError:
                    attempts.append((tier, "NOT_FOUND"))
                    break
                except OSError as e:
                    attempts.append((tier, type(e).__name__))
                    time.sleep(self.pause * 2**k)
        missing = all(outcome == "NOT_FOUND" for _, outcome in attempts)
        return "NO_ARCHIVE" if missing else "ERROR", None, attempts, None

    def read(self, partition):
        for i, day in enumerate(partition.days):
            time.sleep(self.delay if i else 0)  # the least pause between two requests of a task
            status, tier, attempts, content = self.fetch(day)
            yield day, route_of(day), status, tier, attempts, len(content) if content is not None else None, hashlib.sha256(content).hexdigest() if content is not None else None, content


class ArchiveSource(DataSource):
    """``spark.read.format("daily_archive").option("start", ...).option("end", ...).option("tiers", "a,b").load()``."""

    @classmethod
    def name(cls) -> str:
        return "daily_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def write_raw(days: DataFrame, folder: str) -> DataFrame:
    """Preserve the bytes of every day that has any, unchanged, under the archive's own names; (day, path, bytes, sha256)."""

    def run(batches):
        system, root = at(folder)
        for pdf in batches:
            paths = []
            for day, content in zip(pdf["day"], pdf["content"], strict=True):
                path = f"{root.rstrip('/')}/{file_name(day)}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as f:
                    f.write(content)
                paths.append(path)
            yield pdf.assign(path=paths, bytes=pdf["content"].map(len), sha256=[hashlib.sha256(c).hexdigest() for c in pdf["content"]])[["day", "path", "bytes", "sha256"]]

    return days.where("content IS NOT NULL").select("day", "content").mapInPandas(run, "day date, path string, bytes long, sha256 string")


def acquisition_manifest(days: DataFrame) -> DataFrame:
    """One row: counts per status, whether the run failed, and an id made of the contents' hashes alone."""
    hashes = F.concat_ws(",", F.array_sort(F.collect_set("sha256")))
    return days.agg(
        F.min("day").alias("start"),
        F.max("day").alias("end"),
        F.count("*").alias("row_count"),
        F.count_if(F.col("status") == "VALIDATED").alias("validated"),
        F.count_if(F.col("status") == "NO_ARCHIVE").alias("no_archive"),
        F.count_if(F.col("status") == "ERROR").alias("errors"),
        F.sha2(hashes, 256).alias("sha256"),
    ).withColumns({"dataset_id": F.substring("sha256", 1, 16), "failed": (F.col("errors") > 0) | (F.col("validated") == 0)})


def snapshot_manifest(spark: SparkSession, path: str, source: str, source_version: str, code_commit: str) -> DataFrame:
    """One row per file: hash, size and, for JSON envelopes, the number of records."""
    files = spark.read.format("binaryFile").load(path)
    text = F.when(F.lower("path").endswith(".json"), F.decode("content", "UTF-8"))
    return files.select(
        "path",
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"),
        F.json_array_length(F.get_json_object(text, "$.records")).cast("long").alias("row_count"),
        F.lit(source).alias("source"),
        F.lit(source_version).alias("source_version"),
        F.lit("1").alias("preprocessing_version"),
        F.lit(code_commit).alias("code_commit"),
        F.current_timestamp().alias("snapshot_created_at"),
    ).withColumn("dataset_id", F.substring("sha256", 1, 16))
