"""WARC round trips: whole tables, tiny splits, damaged archives."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strikeline.llm import warc

HTML = {1: "<p>a</p>", 2: None, 3: "", 4: "<p>a</p>", 5: "é" * 5000, 6: "<p>a</p>", 7: "x" * 300_000}


def pages(spark):
    return spark.createDataFrame([(k, f"http://h/{k} b", v, "x", "y") for k, v in HTML.items()], "page_id long, url string, html string, payload string, digest string")


def expected():
    last = {}
    for k, v in HTML.items():
        last[v or ""] = k
    for k, v in HTML.items():
        data = (v or "").encode()
        own = last[v or ""]
        yield str(k), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own == k else "revisit", None if own == k else str(own)


@pytest.mark.parametrize("split", [37, 200, 4096, 1 << 22])
def test_every_record_has_one_owner(spark, split):
    manifest = warc.write_archives(pages(spark).coalesce(2))
    rows = warc.read_archives(spark, manifest, split_bytes=split, with_payload=True).collect()
    assert sorted((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == sorted(expected())
    assert all(r.payload.decode() == (HTML[int(r.record_id)] or "") for r in rows if r.record_type == "response")
    assert len({(r.path, r.offset) for r in rows}) == len(HTML)


def test_archives_are_plain_gzip(spark):
    manifest = warc.write_archives(pages(spark).coalesce(1)).collect()
    data = gzip.open(manifest[0].path).read()
    assert data.count(b"WARC/1.1\r\n") == len(HTML) + 1


def test_reader_goes_on_after_damage(spark, tmp_path):
    found = warc.write_archives(pages(spark).coalesce(1))
    row = found.collect()[0]
    data = open(row.path, "rb").read()
    at = warc.read_archives(spark, found).where("record_id = '5'").first().offset
    junk = b"\x1f\x8b\x08junk" * 3
    (tmp_path / "a.warc.gz").write_bytes(junk + data[: at + 12] + b"\0\xff\x17" + data[at + 15 :] + junk)
    size = (tmp_path / "a.warc.gz").stat().st_size
    manifest = found.select(F.lit(f"{tmp_path}/a.warc.gz").alias("path"), F.lit(size).cast("long").alias("bytes"), "records", "root")
    for split in (64, 1 << 20):
        ids = sorted(r.record_id for r in warc.read_archives(spark, manifest, split_bytes=split).collect())
        assert ids == ["1", "2", "3", "4", "6", "7"]


def test_missing_ids_repeated_rows_and_small_payloads(spark):
    rows = [(None, "u", "same"), (9, "u", "same"), (9, "u", "same"), (3, None, "same"), (None, "u", "alone")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.read_archives(spark, warc.write_archives(table)).collect()
    assert sorted((r.record_id or "", r.record_type, r.refers_to or "") for r in found) == [("", "response", ""), ("", "revisit", "9"), ("3", "revisit", "9"), ("9", "response", ""), ("9", "response", "")]
    found = warc.read_archives(spark, warc.write_archives(table, min_bytes=5)).collect()
    assert all(r.record_type == "response" for r in found)


def test_long_headers(spark):
    rng = random.Random(0)
    urls = {i: "http://h/" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)) for i, n in enumerate((10, 70_000, 200_000, 3_000_000, 10))}
    table = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in urls.items()], "page_id long, url string, html string")
    manifest = warc.write_archives(table.coalesce(1))
    for split in (5000, 1 << 22):
        found = warc.read_archives(spark, manifest, split_bytes=split, with_payload=True, complete=True).collect()
        assert {int(r.record_id): r.url for r in found} == urls and len(found) == len(urls)
        assert all(r.payload.decode() == f"<p>{r.record_id}</p>" for r in found)


def test_complete_or_nothing(spark, tmp_path):
    found = warc.write_archives(pages(spark).coalesce(1))
    data = open(found.first().path, "rb").read()
    at = warc.read_archives(spark, found).where("record_id = '5'").first().offset
    (tmp_path / "a.warc.gz").write_bytes(data[: at + 12] + b"\0\xff\x17" + data[at + 15 :])
    manifest = found.withColumn("path", F.lit(f"{tmp_path}/a.warc.gz"))
    assert warc.read_archives(spark, found, complete=True).count() == len(HTML)
    with pytest.raises(ValueError, match="holds 7 records and 6 were read"):
        warc.read_archives(spark, manifest, complete=True)


def test_empty_table(spark):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(table)).collect() == []


def test_share_of_a_reading_task_is_bounded():
    for splits in (0, 1, 4096, 4097, 131_073, 10**7):
        tasks = warc.read_tasks(splits)
        assert tasks >= min(max(1, splits), warc.READ_TASKS) and splits <= tasks * warc.TASK_SPLITS
