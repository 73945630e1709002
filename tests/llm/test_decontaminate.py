"""Decontamination against a scan of every window, with one and several chunks."""

import re

import pytest

from strikeline.llm import decontaminate as d

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short one"), (3, None), (4, ""), (10, "ONE two-three four five six seven eight nine ten, eleven"), (10, "x y"), (20, "x y"), (5, "é ü ß a b c d e f g é ü ß a b c d e f g")]
DOCS = [(1, "zero one two three four five six seven eight nine ten eleven twelve thirteen"), (2, None), (3, ""), (4, "... !!"), (5, "short ONE x Y short one"), (6, "one two three four five six seven eight nine tenth"), (7, "é ü ß a b c d e f g " * 300), (7, "x y"), (8, "w " * 60_000 + "x  y"), (9, "x.y x1y")]


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute():
    windows = {}
    for i, t in ITEMS:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    for i, t in DOCS:
        w, hit, items = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    items |= found
        yield i, len(w), len(hit), sorted(items)


@pytest.mark.parametrize("chunk", [d.CHUNK_WORDS, 12, 1])
def test_every_window(spark, monkeypatch, chunk):
    monkeypatch.setattr(d, "CHUNK_WORDS", chunk)
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = d.annotate(docs, bench).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in found) == sorted(brute())
    first = next(r for r in found if r.doc_id == 1)
    assert (first.longest_match, first.longest_start) == (12, 1)
    clean = d.remove(docs, bench)
    assert clean.schema == docs.schema
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _, hit, _ in brute() if not hit)


def test_a_prompt_of_many_items(monkeypatch):
    """Ranges of items give what one range gives, and hot windows take bounded memory."""
    import tracemalloc

    prompt = [b"p%d" % i for i in range(30)]
    suffixes = d.Suffixes([(str(i), [*prompt, b"own%d" % i]) for i in range(1_000)], 10)
    text = b" ".join(prompt * 400 + [b"own7"])
    want = suffixes.scan([text, b"", text])
    assert want[0][:2] == (12_001, 12_001) and len(want[0][2]) == 1_000 and want[0][3:] == (31, 399 * 30) and want[1] == (0, 0, [], 0, -1)
    monkeypatch.setattr(d, "PAIRS", 1 << 17)
    tracemalloc.start()
    assert suffixes.scan([text, b"", text]) == want
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("chunk", [d.CHUNK_WORDS, 1])
def test_items_without_an_id(spark, monkeypatch, chunk):
    monkeypatch.setattr(d, "CHUNK_WORDS", chunk)
    rows = [(1, "so one two three here"), (2, "four five"), (3, "x y one two three"), (4, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), (None, "four five"), (7, "x y"), (8, "one two three")], "item_id long, text string")
    found = {r.doc_id: (r.n_hit, r.item_ids) for r in d.annotate(docs, bench).collect()}
    assert found == {1: (3, ["8", None]), 2: (2, [None]), 3: (5, ["7", "8", None]), 4: (0, [])}
    assert [r.doc_id for r in d.remove(docs, bench).collect()] == [4]


def test_query_agrees_with_its_sql_without_ids(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(1, "so one two three here"), (2, "four five"), (3, "x y one two three"), (4, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "one two three"), (None, "four five"), (7, "x y"), (8, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = d.query(spark, str(tmp_path))
    names = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    assert sorted(map(tuple, found.selectExpr(*names.split(", ")).collect())) == sorted(con.execute(f"SELECT {names} FROM ({d.ORACLE})").fetchall())


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and r.item_ids == [] for r in d.annotate(docs, none).collect())
    assert d.annotate(spark.createDataFrame([], docs.schema), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []
