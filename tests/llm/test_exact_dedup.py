"""Exact dedup: state over several batches, digests that collide, odd rows."""

import re

from pyspark.sql import functions as F

from strikeline.llm import exact_dedup

TEXTS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (4, " "), (6, "\n\n"), (7, "a b"), (8, "x" * 200_000), (10, "x" * 200_000), (None, "a b"), (None, "alone"), (3, "a b"), (11, "c")]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        stays = False
        for i in ids:
            now = i == keep and not stays
            stays |= now
            yield str(i), str(keep), len(ids), now


def check(spark, digest, **more):
    docs = spark.createDataFrame([(i, t, "z", 0) for i, t in TEXTS], "doc_id long, text string, digest string, seq int").repartition(5)
    found = exact_dedup.annotate(docs, digest=digest, **more).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in found) == sorted(brute(TEXTS))


def test_odd_rows(spark):
    check(spark, exact_dedup.sha256)


def test_state_lives_across_batches(spark):
    check(spark, exact_dedup.sha256, files_per_trigger=1)


def test_full_bytes_decide_when_digests_collide(spark):
    check(spark, lambda body: F.encode(F.substring(body, 1, 1), "utf-8"))


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame([(i, t, i, "z", 0, "w") for i, t in TEXTS], "doc_id long, text string, __id long, __digest string, own_h int, OWN_ID string")
    kept = exact_dedup.drop_repeats(docs)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, _, _, now in brute(TEXTS) if now)


def test_one_of_equal_rows_stays(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a  b"), (2, "c"), (None, None), (None, None)], "doc_id long, text string")
    found = exact_dedup.drop_repeats(docs).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "2", "None"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.annotate(docs).collect() == []
    assert exact_dedup.drop_repeats(docs).collect() == []
