"""Packing against a plain tokenisation of every document."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from strikeline.llm import packing

SF = "/root/testdata/sf0.001"


def brute(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    brute.t = getattr(brute, "t", None) or Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*brute.t.encode(text or "", add_special_tokens=False).ids, 1]


def held(rows, texts):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = brute(texts[d])
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    padding = total = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        n = sum(r.length for r in own)
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
        total += n
    return padding / total


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert held(packing.query(spark, SF).collect(), texts) < 0.05


def test_odd_texts(spark):
    texts = {1: None, 2: "", 3: "  \n ", 4: "a " * 5000, 5: "x" * 3000, 6: "Été  \x1c can't <|endoftext|>b", 7: "a " * 5000, 8: " A\u0085B"}
    docs = spark.createDataFrame([(k, v, 1, "z") for k, v in texts.items()], "doc_id long, text string, part int, bin string")
    held(packing.pack(docs).collect(), texts)
    rows = packing.sequences(packing.pack(docs, with_ids=True)).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(brute(t)) for t in texts.values())
    assert all(len(r.ids) == 4 * (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 2048) for r in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_the_histogram_exactly(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(b): int(n) for b, n in zip(range(1, 65), rng.integers(0, 50, 64), strict=True)}
    used = defaultdict(int)
    for bins, n in packing.plan(histogram, 64):
        assert sum(bins) <= 64 and n > 0
        for b in bins:
            used[b] += n
    assert dict(used) == {b: n for b, n in histogram.items() if n}


def test_nnls_is_optimal():
    rng = np.random.default_rng(1)
    a, b = rng.random((8, 20)), rng.random(8)
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert x.min() >= 0 and slope.max() < 1e-6 and abs(slope[x > 0]).max() < 1e-6


def test_combinations():
    assert packing.combinations(6) == [(6,), (5, 1), (4, 2), (4, 1, 1), (3, 3), (3, 2, 1), (2, 2, 2)]


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_BYTES", 200_000)
    brute("")
    chunks = packing.Chunks(brute.t.to_str())
    for i in range(60):
        texts = [f"again word{i} {'x' * (500 * i + j)}" for j in range(4)]
        assert [np.frombuffer(d, "<u4").tolist() for d in chunks.encode([t.encode() for t in texts])] == [brute(t)[:-1] for t in texts]
        for kept in (chunks.young, chunks.old):
            assert sum(len(c) + len(d) for c, d in kept.items()) <= 200_000 + sum(5 * len(t) for t in texts)
    assert b"again" in chunks.young
