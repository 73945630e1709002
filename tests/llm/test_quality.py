"""The quality classifier: held-out accuracy, exact products, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from strikeline.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = quality.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r.predicted == 1 for r in rows if r.quality == 1]
    bad = [r.predicted == 0 for r in rows if r.quality == 0]
    assert len(rows) > 500 and np.mean(good) > 0.99 and np.mean(bad) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_votes_by_hand():
    rng = np.random.default_rng(0)
    rows = np.stack([quality.terms(bytes(rng.integers(97, 123, 200, dtype=np.uint8))) for _ in range(50)])
    model = quality.train(rows, (np.arange(50) % 2).astype(float))
    near = model.latent(rows) @ model.vectors.T
    for i, s in enumerate(model.score(rows)):
        at = np.argsort(-near[i], kind="stable")[: quality.NEIGHBOURS]
        votes = np.maximum(near[i, at], 1e-3).astype(float) ** quality.SHARPNESS
        assert abs(s - (votes * (at % 2)).sum() / votes.sum()) < 1e-4


def test_terms_of_long_texts():
    text = bytes(np.random.default_rng(0).integers(0, 256, 200_000, dtype=np.uint8))
    pair = np.frombuffer(text, np.uint8)
    slots = quality._SLOT[pair[:-1].astype(int) * 256 + pair[1:]]
    assert (quality.terms(text)[: quality.PAIRS] == np.bincount(slots, minlength=quality.PAIRS)).all()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x"), (None, "a b"), (3, "x"), (4, "y " * 100_000)]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (3, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert len(model.labels) <= 3
    found = quality.annotate(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted for r in found)
    none = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.annotate(docs, none).collect()} == {0.5}
    assert quality.annotate(docs.where("false"), model).collect() == []


def test_sample_is_bounded(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert len(quality.fit(docs, labels, sample=10).labels) == 10
