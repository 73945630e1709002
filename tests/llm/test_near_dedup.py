"""Near-dedup against all pairs, with chains, copies, odd rows and tiny blocks."""

import random

import numpy as np
import pytest

from strikeline.llm import graph, near_dedup


def sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    size = min(5, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def brute(rows):
    own = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j]:
                same = len(own[i] & own[j])
                if 100 * same >= 75 * (len(own[i]) + len(own[j]) - same):
                    parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        first = min(g, key=lambda i: (rows[i][0] is None, rows[i][0] if rows[i][0] is not None else 0, i))
        out += [(str(rows[i][0]), len(own[i]), str(rows[first][0])) for i in g]
    return sorted(out), len(groups)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo"), (6, "one two three"), (7, "a b c d e"), (8, "A B C D E"), (None, "a b c d e"), (9, "a b c d e f")]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 200))]
        text = list(base)
        for _ in range(rng.randint(1, 12)):  # a chain: each a few words from the last
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows) + 100, " ".join(text)))
    shared = [word() for _ in range(60)]
    for _ in range(15):  # half in common: candidates that are no links
        rows.append((len(rows) + 100, " ".join(shared + [word() for _ in range(45)])))
    rows += [(i + 1000, t) for i, t in rows[10:30] if i]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block", "group"), [(0, near_dedup.BLOCK, near_dedup.GROUP), (1, 3, 2)])
def test_all_pairs(spark, monkeypatch, seed, block, group):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "GROUP", group)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, h int, kept string")
    found = near_dedup.annotate(docs).collect()
    want, groups = brute(rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == want
    assert sum(r.kept for r in found) == groups
    assert all((r.doc_id == r.component_id) == r.kept for r in found if r.doc_id is not None)


@pytest.mark.parametrize(("block", "shingles"), [(near_dedup.BLOCK, near_dedup.BLOCK_SHINGLES), (4, 900)])
def test_rounds_after_the_first(spark, monkeypatch, block, shingles):
    """Without any first-round link, the second round finds all of them, in whole keys and in tiny blocks."""
    first = near_dedup.confirm
    monkeypatch.setattr(near_dedup, "confirm", lambda pairs, *a: first(pairs.limit(0), *a))
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    rows = corpus(2)
    found = near_dedup.annotate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute(rows)[0]


def test_second_round_emits_no_pairs(spark, monkeypatch):
    """Of many pairs that sketches admit and sets refute, members go on but no pair does."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(100)]
    rows = [(i, " ".join(shared + [word() for _ in range(20)])) for i in range(80)]  # a similarity of about 0.69 each
    written = {}
    kept = near_dedup.materialise

    def noted(df, name, *a):
        written[name] = kept(df, name, *a)
        return written[name]

    monkeypatch.setattr(near_dedup, "materialise", noted)
    found = near_dedup.annotate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.component_id for r in found}) == 80 == brute(rows)[1]
    assert written["near-joins"].count() == 0
    assert 80 <= written["near-touched"].count() <= 80 * near_dedup.BANDS


def test_sketches_tell_similarities():
    """The cuts admit every pair at 0.75 and few at 0.55."""
    rng = np.random.default_rng(1)
    for n, share, least, most in ((40, 0.75, 1.0, 1.0), (400, 0.75, 1.0, 1.0), (400, 0.55, 0.0, 0.05)):
        common = round(2 * n * share / (1 + share))
        admitted = 0
        for _ in range(150):
            hashes = rng.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
            a, b = np.sort(hashes[:n]), np.sort(hashes[n - common :])
            x, y = (near_dedup.signature(s)[1].view(np.uint64) for s in (a, b))
            bits = np.bitwise_count(x ^ y)
            admitted += bits.sum() <= near_dedup.MOST_BITS and bits[:8].sum() <= near_dedup.MOST_FIRST
        assert least <= admitted / 150 <= most


def test_filter(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "x", i, t) for i, t in rows], "doc_id long, text string, __id string, own_id long, OWN_H string")
    kept = near_dedup.drop_near_repeats(docs)
    assert kept.schema == docs.schema
    found = kept.collect()
    assert len(found) == brute(rows)[1]
    assert all(r.doc_id == r.own_id and r.text == r.OWN_H for r in found)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.annotate(docs).collect() == []
    assert near_dedup.drop_near_repeats(docs).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(n, n) == find(n) for n in parent)
