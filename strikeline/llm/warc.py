"""WARC archives: a writer with revisit records and a splittable reader.

Writer: each task writes the records of its rows to an archive of its own in the
shared folder, one gzip member per record.  Of equal payloads the one with the
largest id becomes a response, the others revisit it.  A file's name holds the
task attempt, and the manifest (itself a written table) lists the files of
successful attempts only, so retries and speculative tasks do no harm.

Reader: archives are cut into byte ranges.  A task looks for gzip magic in its
range, takes a candidate as a member only if its first bytes decode to a WARC
header, and owns the records that start inside its range (it reads the last one
past the range's end).  After a record the next one is expected right behind it;
after damaged bytes the search for magic goes on.

A header may have any length.  Damage is passed over, so a reader that must have
every record asks for ``complete``: then the records read are written and counted
against the manifest.

Payloads are UTF-8 text here, in which the magic (1F 8B) cannot occur, so a
member stored uncompressed shows no false start.  Memory per task: one range
buffer and one record.

Defined results: null html is an empty payload; rows without an id are written
with an unknown id and, when their payload has another owner, revisit it;
repeated rows with the largest id are all responses; an empty table makes an
empty manifest and no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.llm.common import materialise, pieces, scratch_path

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 4 << 20
#: So many tasks read one range each; beyond them a task reads at most TASK_SPLITS ranges.
READ_TASKS, TASK_SPLITS = 4096, 32
READ_BYTES = 1 << 20
HEADER_BYTES = 64 << 10
BATCH_BYTES = 8 << 20
BROADCAST_GROUPS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response, or a revisit that carries the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join(c for c in url or "" if c > " ")
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", f"<urn:page:{page or ''}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
        return member(fields, http)
    return member(fields, http + payload)


def with_owners(pages: DataFrame, id_col: str, body_col: str, min_bytes: int) -> DataFrame:
    """id, url, payload and, for repeats, the id of the response they refer to."""
    rows = pages.withColumn("payload", F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max(id_col).alias("owner"), F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups.select(F.col("digest").alias("of"), "owner"), "warc-repeats")
    if groups.count() <= BROADCAST_GROUPS:  # 32 + 8 bytes each; beyond it the payloads are shuffled once
        groups = F.broadcast(groups)
    rows = rows.join(groups, rows["digest"] == groups["of"], "left")
    refers = F.when(F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col(id_col)), F.col("owner"))
    return rows.select(F.col(id_col).cast("string").alias("id"), F.col("url").cast("string").alias("url"), "payload", refers.cast("string").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", body_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """Write the archives; return the manifest (path, bytes, records)."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    own = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(body_col).alias("body"))

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        path = f"{base}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        size = n = 0
        with fs.open_output_stream(path, compression=None, buffer_size=READ_BYTES) as out:
            info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            out.write(info)
            size += len(info)
            for batch in pieces(batches, "payload", BATCH_BYTES):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = page_record(*row)
                    out.write(data)
                    size += len(data)
                    n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})
        else:
            fs.delete_file(path)

    manifest = with_owners(own, "page", "body", min_bytes).mapInArrow(run, "path string, bytes long, records long")
    return materialise(manifest.withColumn("root", F.lit(folder)), "warc-manifest")


def header_of(data: bytes) -> tuple[dict[str, str], int] | None:
    """The named fields of a WARC header and where its block begins; None if this is none."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        return None
    fields = dict(line.split(": ", 1) for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    if "WARC-Type" not in fields or not fields.get("Content-Length", "").isdigit():
        return None
    return fields, end + 4


class Source:
    """Random access to a file, by pieces."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def record(self, at: int) -> tuple[dict[str, str], bytes, int] | None:
        """The record whose member starts at ``at``, and where the member ends; None if there is none."""
        inflate, data, pos, fields, begin = zlib.decompressobj(31), [], at, None, 0
        try:
            while not inflate.eof:
                if not (more := self.read(pos, HEADER_BYTES if pos == at else READ_BYTES)):
                    return None
                pos += len(more)
                data.append(inflate.decompress(more))
                if fields is None:
                    head = b"".join(data)
                    data = [head]
                    if (found := header_of(head)) is not None:
                        fields, begin = found
                    elif not b"WARC/".startswith(head[:5]) and not head.startswith(b"WARC/") or b"\r\n\r\n" in head or inflate.eof:
                        return None
        except zlib.error:
            return None
        whole, length = b"".join(data), int(fields["Content-Length"])
        if len(whole) < begin + length:
            return None
        return fields, whole[begin : begin + length], pos - len(inflate.unused_data)

    def records(self, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """The records that start in [start, end)."""
        at = start
        while at < min(end, self.size):
            data = self.read(at, READ_BYTES + len(MAGIC) - 1)
            found = data.find(MAGIC)
            if found < 0 or at + found >= end:
                at += READ_BYTES
                continue
            at += found
            while at < end and (record := self.record(at)):
                yield at, record[0], record[1]
                at = record[2]
            else:
                at += at < end
                continue


OUT = "path string, offset long, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string"


def read_tasks(splits: int) -> int:
    """The number of reading tasks: a task's share is bounded, however many ranges there are."""
    return max(1, min(splits, READ_TASKS), -(-splits // TASK_SPLITS))


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False, complete: bool = False) -> DataFrame:
    """The page records of the archives in a manifest, each read by the task whose byte range it starts in.

    With ``complete``, fail unless every archive gave as many records as its manifest says.
    """
    total = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = manifest.select("root", "path", starts.alias("start")).repartition(read_tasks(int(total)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = pafs.FileSystem.from_uri(row["root"])
                rows, size = [], 0
                with fs.open_input_file(row["path"]) as file:
                    for at, fields, block in Source(file).records(row["start"], row["start"] + split_bytes):
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(payload), base32_sha1(payload)) != (length, digest):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its header")
                        page = lambda name, fields=fields: fields.get(name, "").removeprefix("<urn:page:").removesuffix(">") or None
                        rows.append((row["path"], at, page("WARC-Record-ID"), fields["WARC-Type"], fields.get("WARC-Target-URI"), length, digest, page("WARC-Refers-To"), payload if with_payload else None))
                        size += len(payload)
                        if size > BATCH_BYTES:
                            yield _batch(rows, with_payload)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, with_payload)

    found = splits.mapInArrow(run, OUT + ", payload binary" * with_payload)
    if not complete:
        return found
    found = materialise(found, "warc-records")
    read = found.groupBy("path").agg(F.count("*").alias("read"))
    short = manifest.join(read, "path", "left").where(F.col("records") != F.coalesce("read", F.lit(0))).select("path", "records", F.coalesce("read", F.lit(0)).alias("read")).first()
    if short:
        raise ValueError(f"{short.path} holds {short.records} records and {short.read} were read")
    return found


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in OUT.split(", ")] + ["payload"]
    n = 8 + with_payload
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[:n], kinds, strict=False)], names[:n])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = read_archives(spark, manifest, complete=True)
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h),
b AS (
  SELECT p.page_id, p.h, g.owner, array_to_string(list_transform(range(1, 41), lambda i:
    substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', substr(sha1(p.h), i, 1)) - 3, 4)), '') AS bits
  FROM p JOIN g ON p.h = g.h
)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT)
      + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM b
"""
