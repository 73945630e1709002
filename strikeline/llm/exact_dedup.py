"""Exact dedup as a stateful stream over an arrival log.

1. A compact log (id, sequence number, digest of the normalised text, hash of the
   raw text) is written to the shared folder, one row for every document; it is
   the only pass that normalises and hashes all texts.
2. Structured Streaming reads it file by file (``trigger(availableNow)``) into
   a keyed aggregation whose state lives in RocksDB on the executors' disks and
   in the checkpoint folder.  Per digest the state retains the smallest id with
   its locator (sequence number and raw hash, by which id and text are found in
   the table), and the group's size.  There is no watermark: nothing expires,
   so a stream that goes on later still finds every earlier text.
3. On hits the full bytes are compared: the members of groups of several are
   found by their locators, and of each digest the least and the greatest whole
   text must be equal.  Should bytes differ under one digest, the rows of that
   digest are grouped again by their whole texts.

Partial aggregation keeps a hot group down to one row per task, in the state as
in the comparison; the joins that bring results back to rows have written tables
on both sides, so AQE can split a hot key.

Defined results: a null text counts as empty; among equal texts the row with
the smallest id stays, null ids coming last; of repeated rows with that id
exactly one stays; an empty table gives no rows; other columns, whatever their
names, are carried through by :func:`drop_repeats` and ignored by :func:`annotate`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.llm.common import free_names, materialise, scratch_path

#: Locators that are broadcast at most (under 60 bytes each); beyond it the texts are shuffled.
BROADCAST_ROWS = 200_000
FILES_PER_TRIGGER = 100_000

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no space ahead of need in hundreds of small stores
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def raw_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def arrival_log(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per document, in the shared folder: its id, number, digest and the hash of its raw text."""
    log = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("seq"),
        digest(normalised(F.col(text_col))).alias("digest"),
        raw_hash(F.col(text_col)).alias("h"),
    )
    return materialise(log, "arrivals")


def run_stream(spark: SparkSession, log: DataFrame, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Feed the log to the keyed state; return its last value for every digest."""
    updates = scratch_path(spark, "dedup-updates")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(log_path(log))
    state = source.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "seq", "h")).alias("first"),
        F.count("*").alias("group_size"),
    )

    def emit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    for k, v in _ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        stream = state.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", scratch_path(spark, "dedup-state")).trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if stream.lastProgress is None or not log.take(1):
        return spark.createDataFrame([], state.schema)
    last = spark.read.schema(state.schema).parquet(updates)
    return last.groupBy("digest").agg(F.min("first").alias("first"), F.max("group_size").alias("group_size"))


def log_path(log: DataFrame) -> str:
    files = log.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else scratch_path(log.sparkSession, "none")


def at_locators(docs: DataFrame, found: DataFrame, id_col: str, h: Column) -> Column:
    """The condition that a document lies where ``found`` (id, h) says."""
    return docs[id_col].eqNullSafe(found["id"]) & (h == found["h"])


def differing(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The digests under which whole texts differ; ``members`` has id, h and digest of the rows to compare."""
    members = materialise(members.select("id", "h", "digest").distinct(), "dedup-members")
    few = members.count() <= BROADCAST_ROWS
    texts = docs.select(id_col, text_col)
    found = texts.join(F.broadcast(members) if few else members, at_locators(texts, members, id_col, raw_hash(texts[text_col])))
    found = found.select("digest", normalised(texts[text_col]).alias("body"))
    return found.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most")).where("least <> most").select("digest")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """One row per document: id, h, seq, digest, keep_id, keep_seq, group_size."""
    spark = docs.sparkSession
    log = arrival_log(docs, id_col, text_col, digest)
    state = materialise(run_stream(spark, log, files_per_trigger), "dedup-groups")
    several = state.where("group_size > 1")
    decided = log.join(state, "digest").select("id", "h", "seq", "digest", F.col("first.id").alias("keep_id"), F.col("first.seq").alias("keep_seq"), "group_size")
    if not several.take(1):
        return decided
    differ = materialise(differing(docs, log.join(several.select("digest"), "digest", "left_semi"), id_col, text_col), "dedup-differ")
    if not differ.take(1):
        return decided
    # one digest, several texts: the whole text decides
    whole = docs.select(F.col(id_col).alias("id"), raw_hash(F.col(text_col)).alias("h"), normalised(F.col(text_col)).alias("body"), F.monotonically_increasing_id().alias("seq"))
    whole = materialise(whole.withColumn("digest", digest(F.col("body"))).join(differ, "digest", "left_semi"), "dedup-whole")
    group = whole.groupBy("body").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "seq")).alias("first"), F.count("*").alias("group_size"))
    again = whole.join(group, "body").select("id", "h", "seq", "digest", F.col("first.id").alias("keep_id"), F.col("first.seq").alias("keep_seq"), "group_size")
    return decided.join(differ, "digest", "left_anti").unionByName(again)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept and digest (hex)."""
    found = decide(docs, id_col, text_col, digest, files_per_trigger)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("seq") == F.col("keep_seq")).alias("kept"), F.lower(F.hex("digest")).alias("digest"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    decided = materialise(decide(docs, id_col, text_col).select("id", "h", (F.col("seq") == F.col("keep_seq")).alias("kept")), "dedup-decided")
    kept = decided.where("kept")
    own_id, own_h = free_names(docs.columns, "id", "h")
    rows = docs.withColumns({own_id: F.col(id_col), own_h: raw_hash(F.col(text_col))})
    rows = rows.join(kept, at_locators(rows, kept, own_id, rows[own_h]), "left_semi")
    if decided.groupBy("id", "h").count().where("count > 1").take(1):  # the same row twice: both lie at one locator
        rows = rows.dropDuplicates([own_id, own_h])
    return rows.drop(own_id, own_h)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("digest", "text_sha256")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
