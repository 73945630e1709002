"""Quality classifier: nearest labelled neighbours in a latent-semantic space.

Terms of a text are hashed byte pairs (log counts times inverse document
frequency) and bins of its make-up: repeated words, distinct words, classes of
characters, word length.  A truncated singular value decomposition of the
labelled rows' term matrix gives the latent space.  Labelled vectors are
broadcast; each block of documents is multiplied with all of them (exact cosine
products), and the labels of the nearest ``NEIGHBOURS`` vote with
similarity ** ``SHARPNESS``.

Fitted on at most ``SAMPLE`` labelled rows outside the held-out fold, those
with the smallest hash of their id; so what is broadcast and collected is bounded
(``SAMPLE`` x 1,096 terms while fitting, ``SAMPLE`` x ``RANK`` afterwards).  Scoring
is one scan: no shuffle.  Labels, lang, source and id are no inputs of a score.

Defined results: null and empty texts have the make-up of an empty text and are
scored like any other; of several labels of a document the smallest counts; null
labels are ignored, and of several rows with a labelled id the least text counts; neighbours
as near as the last of ``NEIGHBOURS`` all vote; without labelled rows every score
is 0.5; repeated rows are scored each; an empty table gives no rows; extra columns are carried through by
:func:`keep_good` and ignored by :func:`annotate`.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.llm.common import pieces

SAMPLE = 4_000
RANK = 24
NEIGHBOURS = 15
SHARPNESS = 16
THRESHOLD = 0.3
FOLDS = 5
PAIRS = 1_024
MAKEUP_WEIGHT = 3.0
BATCH_BYTES = 4 << 20
BLOCK = 512

_SLOT = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
_EDGES = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7])
_MAKEUP = 9


def _class(c: int) -> int:
    if 97 <= c <= 122 or c >= 128:
        return 0
    if 65 <= c <= 90:
        return 1
    if 48 <= c <= 57:
        return 2
    if c in b" \t\v\f\r":
        return 3
    return 4 if c == 10 else 5 if c in b".," else 6


_CLASS = np.array([_class(c) for c in range(256)], np.int64)


def terms(text: bytes | None) -> np.ndarray:
    """Counts of hashed byte pairs, then the make-up bins, as one row."""
    text = text or b""
    out = np.zeros(PAIRS + _MAKEUP * (len(_EDGES) + 1), np.float32)
    codes = np.frombuffer(text, np.uint8)
    if len(codes) > 1:
        pair = codes[:-1].astype(np.int32) << 8 | codes[1:]
        out[:PAIRS] = np.bincount(_SLOT, np.bincount(pair, minlength=65536), PAIRS) if len(pair) > 65536 else np.bincount(_SLOT[pair], minlength=PAIRS)
    words = text.split()
    n, size = max(1, len(words)), max(1, len(codes))
    share = np.bincount(_CLASS[codes], minlength=7) / size
    repeats = sum(map(operator.eq, words, words[1:])) / n
    makeup = [repeats, len(set(words)) / n, share[1], share[2], share[6], share[5], share[3], share[4], min(1.0, size / n / 20)]
    bins = np.searchsorted(_EDGES, makeup)
    out[PAIRS + np.arange(_MAKEUP) * (len(_EDGES) + 1) + bins] = 1
    return out


@dataclass
class Model:
    """Everything a score needs: at most SAMPLE vectors and the projection to them."""

    weight: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, rows: np.ndarray) -> np.ndarray:
        pairs = np.log1p(rows[:, :PAIRS]) * self.weight
        pairs /= np.maximum(np.linalg.norm(pairs, axis=1, keepdims=True), 1e-12)
        whole = np.concatenate([pairs, rows[:, PAIRS:] * (MAKEUP_WEIGHT / np.sqrt(_MAKEUP))], axis=1)
        found = whole @ self.projection if len(self.projection) else whole
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        out = np.empty(len(rows))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(rows), BLOCK):
            near = self.latent(rows[i : i + BLOCK]) @ self.vectors.T
            last = np.partition(near, -k, axis=1)[:, -k]
            row, at = np.nonzero(near >= last[:, None])  # all that are as near as the last one vote
            votes = np.maximum(near[row, at], 1e-3).astype(np.float64) ** SHARPNESS
            total = np.bincount(row, votes, len(near))
            out[i : i + BLOCK] = np.bincount(row, votes * self.labels[at], len(near)) / total
        return np.clip(out, 0.0, 1.0)


def train(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Term weights, the latent space and the labelled vectors in it."""
    model = Model(np.ones(PAIRS, np.float32), np.zeros(0, np.float32), np.zeros((0, RANK), np.float32), labels.astype(np.float64))
    if not len(labels):
        return model
    model.weight = (np.log((1 + len(rows)) / (1 + (rows[:, :PAIRS] > 0).sum(axis=0))) + 1).astype(np.float32)
    whole = model.latent(rows).astype(np.float64)
    _, vectors = np.linalg.eigh(whole.T @ whole)  # right singular vectors, smallest first
    top = vectors[:, ::-1][:, :RANK]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
    model.projection = np.ascontiguousarray(top, np.float32)
    model.vectors = model.latent(rows).astype(np.float32)
    return model


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    """Learn from at most ``sample`` labelled documents outside the held-out fold."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds))
    known = known.groupBy(F.col(id_col).alias("of")).agg(F.min(label_col).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("of"), "of").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    picked = texts.join(F.broadcast(chosen), F.col("id") == F.col("of"))
    # of several rows with a labelled id the least text counts, whatever the order of tasks
    picked = picked.groupBy("id").agg(F.min("label").alias("label"), F.min(F.coalesce("text", F.lit(b""))).alias("text"))

    def run(batches):
        for batch in pieces(batches, "text", BATCH_BYTES):
            own = [terms(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(own, pa.binary())], ["id", "label", "terms"])

    found = sorted((r.id, r.label, bytes(r.terms)) for r in picked.mapInArrow(run, "id string, label double, terms binary").collect())
    rows = np.frombuffer(b"".join(t for _, _, t in found), np.float32).reshape(len(found), PAIRS + _MAKEUP * (len(_EDGES) + 1))
    return train(rows, np.array([x for _, x, _ in found]))


def annotate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """One row per document: id, held_out, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches, "text", BATCH_BYTES):
            score = sent.value.score(np.stack([terms(t) for t in batch.column(2).to_pylist()])) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score, pa.float64())], ["id", "held_out", "score"])

    texts = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), folds).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = texts.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows predicted to be good, as they came."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches, text_col, BATCH_BYTES):
            if not batch.num_rows:
                continue
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            score = sent.value.score(np.stack([terms(t) for t in texts]))
            yield batch.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return annotate(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
