"""Benchmark decontamination with suffix arrays over the training documents.

Every Arrow piece of documents is one shard.  Its words become integers of the
benchmark's own vocabulary (0: a word no item has), and a suffix array is built
over the positions at which some benchmark window can start (their first words
are looked up first; other suffixes cannot be reached by any search).  Every
suffix of every item, cut to the window length, is then binary-searched in the
array; the ranges found are all its verbatim occurrences.  Consecutive
occurrences of one item join into the longest match.

Memory per task: one piece of documents and one chunk of the benchmark.  A
benchmark larger than a chunk is applied chunk after chunk, each broadcast on
its own (``CHUNK_WORDS`` bounds it), with a checkpoint between two chunks; the
search is the same, and hit words of several chunks are joined by position.
Occurrences of a window that many items share are looked up item range by item
range, ``PAIRS`` at a time, so a common prompt costs time and no memory.

Defined results: null or empty text has no words and no hits; items without
words match nothing; an item without an id is searched like any other and found
as one null, the last of the ids; repeated items and repeated rows each keep their own id or
row; extra columns are carried through by :func:`remove` and ignored by
:func:`annotate`; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import free_names, pieces

WINDOW = 10
CHUNK_WORDS = 500_000
SHARD_BYTES = 4 << 20
PAIRS = 1 << 20

#: A-Z to a-z; digits, a-z and bytes from 0x80 stay; all else separates words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(TABLE).split() if data else []


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The integers first[i] .. first[i] + many[i] - 1 of every i, one after the other."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


def in_order(ids: list[str | None]) -> list[str | None]:
    """Every id once, a null last."""
    return sorted(set(ids), key=lambda i: (i is None, i or ""))


class Suffixes:
    """The benchmark side: distinct word sequences, their windows and search keys."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        by_words: dict[tuple[bytes, ...], list[str | None]] = {}
        for item, words in items:
            by_words.setdefault(tuple(words), []).append(item)
        self.names = [in_order(ids) for ids in by_words.values()]
        keys: dict[bytes, int] = {}
        lengths, of_window, of_item, offsets = [], [], [], []
        for i, words in enumerate(by_words):
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], ">u4")
            size = min(window, len(ids))
            for j in range(len(ids) - size + 1):
                w = keys.setdefault(ids[j : j + size].tobytes(), len(keys))
                if w == len(lengths):
                    lengths.append(size)
                of_window.append(w)
                of_item.append(i)
                offsets.append(j)
        self.lengths = np.array(lengths, np.int64)
        width = 4 * window
        self.low = np.array([k.ljust(width, b"\0") for k in keys], f"S{width}")
        self.high = np.array([k.ljust(width, b"\xff") for k in keys], f"S{width}")
        order = np.argsort(of_window, kind="stable")
        self.item = np.array(of_item, np.int64)[order]
        self.offset = np.array(offsets, np.int64)[order]
        #: window and item of every place in an item, in order
        self.pairs = np.array(of_window, np.int64)[order] * max(1, len(self.names)) + self.item
        self.gram = int(min(3, self.lengths.min())) if lengths else 0
        if lengths:
            starts = np.frombuffer(b"".join(k[: 4 * self.gram] for k in keys), ">u4").reshape(-1, self.gram)
            self.grams = np.unique(self.code([starts[:, c] for c in range(self.gram)]))

    def code(self, columns: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            total = total * (len(self.vocab) + 1) + c
        return total

    def scan(self, texts: list[bytes | None], places: list[list[int]] | None = None) -> list[tuple[int, int, list[str | None], int, int]]:
        """For each text: words, hit words, ids of items found, longest match (the first of equal ones) and its first word (-1: none).

        ``places``, if given, gets a list for each text: the positions of its hit words.
        """
        if places is not None:
            places[:] = [[] for _ in texts]
        get, counts, arrays, zero = self.vocab.get, [], [], np.zeros(1, np.int32)
        for t in texts:
            words = words_of(t)
            counts.append(len(words))
            arrays += [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)), zero]
        out: list[tuple[int, int, list[str | None], int, int]] = [(n, 0, [], 0, -1) for n in counts]
        if not self.gram or not texts:
            return out
        ids = np.concatenate([*arrays, np.zeros(self.window, np.int32)])
        begins = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
        n = len(ids) - self.window
        may = ids[:n] > 0
        for c in range(1, self.gram):
            may &= ids[c : n + c] > 0
        at = np.flatnonzero(may)
        grams = self.code([ids[at + c] for c in range(self.gram)])
        slot = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        at = at[self.grams[slot] == grams]
        if not len(at):
            return out
        rows = ids.astype(">u4")[at[:, None] + np.arange(self.window)].view(f"S{4 * self.window}").ravel()
        order = np.argsort(rows, kind="stable")
        array, rows = at[order], rows[order]  # the suffix array and what it sorts by
        low, high = np.searchsorted(rows, self.low, "left"), np.searchsorted(rows, self.high, "right")
        found = high - low
        if not found.any():
            return out
        window = np.repeat(np.arange(len(found)), found)
        place = array[spread(low, found)]
        cover = np.bincount(place, minlength=n + 1) - np.bincount(place + self.lengths[window], minlength=n + 1)
        covered = np.cumsum(cover) > 0
        hit = np.concatenate([[0], np.cumsum(covered)])
        hits = hit[begins[1:]] - hit[begins[:-1]]
        if places is not None:
            for d in np.flatnonzero(hits).tolist():
                places[d] = np.flatnonzero(covered[begins[d] : begins[d + 1]]).tolist()
        best, seen = np.zeros(len(texts), np.int64), []
        for found_best, found_items in self._matches(window, place, begins):
            best = np.maximum(best, found_best)
            seen.append(found_items)
        items: dict[int, list[str | None]] = {}
        for pairs in seen:
            for d, i in zip((pairs // len(self.names)).tolist(), (pairs % len(self.names)).tolist(), strict=True):
                items.setdefault(d, []).extend(self.names[i])
        for d, found_items in items.items():
            m, p = int(best[d]) >> 40, (1 << 40) - 1 - (int(best[d]) & ((1 << 40) - 1))
            out[d] = (counts[d], int(hits[d]), in_order(found_items), m, p - int(begins[d]))
        return out

    def _matches(self, window: np.ndarray, place: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per range of items: each text's longest match with its place, as one number, and the (text, item) pairs found."""
        n = len(self.names)
        whole = (np.searchsorted(self.pairs, (window + 1) * n) - np.searchsorted(self.pairs, window * n)).sum()
        bounds = np.unique(np.linspace(0, n, min(n, int(whole) // PAIRS + 1) + 1).astype(np.int64))
        for least, most in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            low = np.searchsorted(self.pairs, window * n + least)
            many = np.searchsorted(self.pairs, window * n + most) - low
            if many.any():
                yield self._runs(spread(low, many), np.repeat(place, many), np.repeat(self.lengths[window], many), begins)

    def _runs(self, pair: np.ndarray, place: np.ndarray, size: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of consecutive occurrences of one item: matches longer than a window."""
        item, diagonal = self.item[pair], place - self.offset[pair]
        order = np.lexsort((place, diagonal, item))
        item, diagonal, place, size = item[order], diagonal[order], place[order], size[order]
        fresh = np.concatenate([[True], (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)])
        run = np.flatnonzero(fresh)
        length = np.diff(np.concatenate([run, [len(item)]])) - 1 + size[run]
        doc = np.searchsorted(begins, place[run], "right") - 1
        best = np.zeros(len(begins) - 1, np.int64)
        np.maximum.at(best, doc, (length << 40) | ((1 << 40) - 1 - place[run]))
        return best, np.unique(doc * len(self.names) + item[run])


def _chunks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The benchmark in chunks of at most CHUNK_WORDS words (or one item); one empty chunk if there are none."""
    chunk: list[tuple[str | None, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary"))
    for item, text in rows.toLocalIterator():
        words = words_of(bytes(text)) if text else []
        if not words:
            continue
        if size and size + len(words) > CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
        chunk.append((item, words))
        size += len(words)
    yield chunk


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("longest_match", T.LongType()),
        T.StructField("longest_start", T.LongType()),
    ]
)
_ARROW = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64())


def search(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text", only_clean: bool = False) -> DataFrame:
    """Add what was found to every row, as a struct, and the hit positions (if there are several chunks); the last two columns.

    With ``only_clean``, return the rows without any hit as they came.
    """
    spark, names = docs.sparkSession, docs.columns
    own_found, own_at = free_names(names, "found", "at")
    chunks = _chunks(benchmark, item_col, item_text_col)
    chunk, following = next(chunks), next(chunks, None)
    several, started, current = following is not None, False, docs
    schema = docs.schema if only_clean else T.StructType([*docs.schema.fields, T.StructField(own_found, FOUND), T.StructField(own_at, T.ArrayType(T.LongType()))])
    while chunk is not None:
        sent = spark.sparkContext.broadcast((chunk, window))

        def run(batches, sent=sent, key=uuid.uuid4().hex, started=started, several=several):
            suffixes = _cached(key, sent)
            for batch in pieces(batches, text_col, SHARD_BYTES):
                column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
                texts = column(text_col).cast(pa.binary()).to_pylist()
                at: list[list[int]] = []
                found = suffixes.scan(texts, at if several else None)
                if only_clean:
                    yield batch.filter(pa.array([f[1] == 0 for f in found], pa.bool_()))
                    continue
                at = at or [[] for _ in texts]
                if started:
                    at = [sorted({*a, *b}) for a, b in zip(column(own_at).to_pylist(), at, strict=True)]
                    for i, o in enumerate(column(own_found).to_pylist()):
                        n, _, items, m, p = found[i]
                        m, p = max((o["longest_match"], -o["longest_start"]), (m, -p))
                        found[i] = (n, len(at[i]), in_order([*o["item_ids"], *items]), m, -p)
                fields = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, _ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays([*map(column, names), pa.StructArray.from_arrays(fields, FOUND.names), pa.array(at, pa.list_(pa.int64()))], [*names, own_found, own_at])

        current = current.mapInArrow(run, schema)
        started, chunk, following = True, following, next(chunks, None)
        if chunk is not None:
            current = current.checkpoint()
    return current


_CACHE: dict[str, Suffixes] = {}


def _cached(key: str, sent) -> Suffixes:
    """One benchmark chunk per Python worker."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Suffixes(*sent.value)
    return _CACHE[key]


def annotate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items found, longest verbatim match and where it starts."""
    found = search(docs.select(id_col, text_col), benchmark, text_col, window)
    return found.select(id_col, f"{found.columns[-2]}.*")


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that hold no benchmark window, all columns as they came."""
    return search(docs, benchmark, text_col, window, only_clean=True)


def query(spark, sf_dir: str) -> DataFrame:
    found = annotate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same words, windows and hits in DuckDB's SQL.
ORACLE = r"""
WITH lowered AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), worded AS (
  SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), windows AS (
  SELECT id AS item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS win
  FROM worded WHERE kind = 'b' AND len(w) > 0
), sizes AS (SELECT DISTINCT size FROM windows
), grams AS (
  SELECT id AS doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS win
  FROM worded, sizes WHERE kind = 'd' AND len(w) >= size
), found AS (
  SELECT DISTINCT g.doc_id, g.i, g.size, x.item_id FROM grams g JOIN windows x ON g.win = x.win AND g.size = x.size
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id
)
SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM worded d LEFT JOIN hit h ON d.id = h.doc_id LEFT JOIN items n ON d.id = n.doc_id
WHERE d.kind = 'd'
"""
