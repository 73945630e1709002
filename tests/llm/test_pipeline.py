"""The pipeline, stage by stage, against brute force on its own input."""

import re

import pytest

import corpus_pipeline
from strikeline.llm import quality

SF = "/root/testdata/sf0.001"


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams(t):
    w = re.split(r"[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).strip(" \t\n\x0b\x0c\r"))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], SF).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    raw, good, exact, near, clean, packed = tables
    assert all(t.columns == docs.columns for t in tables[:-1])
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(good) == ids(quality.annotate(raw, model).where("predicted = 1"))
    first = {}
    for r in good.orderBy("doc_id").collect():
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r.text or ""), r.doc_id)
    assert ids(exact) == set(first.values())
    rows = {r.doc_id: grams(r.text) for r in exact.collect()}
    order, root = sorted(rows), {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(order):
        for j in order[:k]:
            if 100 * len(rows[i] & rows[j]) >= 75 * len(rows[i] | rows[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert ids(near) == {find(i) for i in order}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    hit = {r.doc_id for r in near.collect() for n in sizes for w in [words(r.text)] for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows}
    assert ids(clean) == ids(near) - hit
    assert ids(packed) == ids(clean)
    assert {r.sequence_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.sequence_id for r in packed.collect()}


ODD = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "One  two three four five six. " * 400), (5, "x" * 100_000), (None, "left alone"), (6, " \n"), (7, "one two")]


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_odd_rows(spark, number):
    """Nulls, empty and long texts, repeated rows, clashing columns and an empty table, stage by stage."""
    name, stage = corpus_pipeline.STAGES[number]
    schema = "doc_id long, text string, __id long, own_h string, __found int, score double, id string"
    docs = spark.createDataFrame([(i, t, i, "x", 1, 0.5, "y") for i, t in ODD], schema)
    found, last = stage(spark, docs, SF), number == len(corpus_pipeline.STAGES) - 1
    kept = [str(r.doc_id) for r in found.collect()]
    if not last:
        assert found.schema == docs.schema
        want = {"exact_dedup": ["1", "3", "4", "5", "6", "None"], "near_dedup": ["1", "2", "3", "4", "5", "6", "None"], "decontamination": [str(i) for i, _ in ODD]}
        assert name not in want or sorted(kept) == sorted(want[name])
    else:
        assert set(kept) == {str(i) for i, _ in ODD}
    none = stage(spark, docs.limit(0), SF)
    assert none.collect() == [] and none.schema == found.schema


def test_scratch_belongs_to_its_run(spark):
    """A stage deletes what its own run wrote, and no table of another query that is still to be read."""
    from strikeline.llm import exact_dedup

    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    waiting = exact_dedup.annotate(docs)
    corpus_pipeline.good_quality(spark, docs, SF).collect()
    corpus_pipeline.exact_repeats(spark, docs, SF).collect()
    corpus_pipeline.near_repeats(spark, docs, SF).collect()
    assert len(waiting.collect()) == 3
