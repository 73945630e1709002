"""Language-model scores against the formulas, word by word; the trie against a dictionary."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strikeline.llm import eliasfano, lm

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out = [""]
    for c in low:
        if c == " " or "\x09" <= c <= "\x0d":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def brute(docs):
    rows = [(i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, [*words(t), None]) for i, t in docs]
    count, pairs = Counter(), Counter()
    for _, held, tokens in rows:
        if not held:
            count.update(tokens)
            pairs.update(zip([None, *tokens[:-1]], tokens, strict=True))
    n, v = sum(count.values()), len(count)
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else lm.DISCOUNT
    after = defaultdict(int)
    for u, _ in pairs:
        after[u] += 1

    def alone(w):
        return (max(count[w] - d, 0) / n if n else 0) + (d * v / n if n else 1) / (v + 1)

    def given(u, w):
        if not count[u]:
            return alone(w)
        return max(pairs[u, w] - lm.DISCOUNT, 0) / count[u] + lm.DISCOUNT * after[u] / count[u] * alone(w)

    for i, held, tokens in rows:
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        score = sum(math.log10(given(u, w)) for u, w in zip([None, *tokens[:-1]], tokens, strict=True))
        yield i, held, len(tokens), sum(count[w] > 0 for w in tokens), n, base, score


def compare(found, docs):
    found = sorted(found, key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    want = sorted(brute(docs), key=lambda r: (str(r[0]), r[2], r[5]))
    assert len(found) == len(want)
    for r, (i, held, n, known, total, base, score) in zip(found, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert score - 0.005 * n <= r.score <= score + 1e-6


@pytest.mark.parametrize(("tokens", "shard"), [(lm.BLOCK_TOKENS, lm.SHARD_BYTES), (500, 20_000)])
def test_whole_table(spark, monkeypatch, tokens, shard):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(lm, "SHARD_BYTES", shard)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = lm.query(spark, SF).collect()
    compare(found, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b\x0bc A B x É"), (None, "a b"), (1, "a b c"), (30, "z" * 100_000), (9, "the " * 30_000)] + [(i, f"a b w{i}") for i in range(100, 160)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kind string, block int")
    compare(lm.annotate(docs).collect(), rows)


def test_no_training_rows_and_no_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(held, "a b")]
    compare(lm.annotate(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    assert lm.annotate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
@pytest.mark.parametrize("top", [0, 3, 10**9, 10**13])
def test_sequences(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n))
    coded = eliasfano.EliasFano.encode(values)
    for _ in range(5):
        i, j = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (coded.slice(i, j) == values[i:j]).all()


@pytest.mark.parametrize("n", [1, 10, 20_000])
def test_trie(n):
    rng = np.random.default_rng(n)
    pairs = np.unique(np.stack([rng.integers(0, n // 20 + 1, n), rng.zipf(1.3, n) % 10**7], 1), axis=0)
    codes = rng.integers(1, 4096, len(pairs)).astype(np.uint16)
    trie = eliasfano.Trie(pairs[:, 0], pairs[:, 1], codes)
    asked = np.concatenate([pairs, np.stack([rng.integers(0, n + 3, n), rng.integers(0, 100, n)], 1)])
    asked = asked[np.lexsort((asked[:, 1], asked[:, 0]))]
    known = dict(zip(map(tuple, pairs.tolist()), codes.tolist(), strict=True))
    assert trie.query(asked[:, 0], asked[:, 1], slice_size=500).tolist() == [known.get(tuple(a), 0) for a in asked.tolist()]


def test_quantiles_round_down():
    p = np.random.default_rng(0).random(1000)
    q = eliasfano.dequantise(eliasfano.quantise(p))
    assert (q <= p * (1 + 1e-7)).all() and (q > 0.98 * p).all()
