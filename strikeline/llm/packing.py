"""Packing token sequences by non-negative least squares over a length histogram.

1. Every document is tokenised (white-space chunks are tokenised once per Python
   worker and remembered) and cut at multiples of the window.  The pieces get a
   bin, their length in units of ``UNIT`` tokens rounded up, and a rank within
   (task, bin); they are written to the shared folder once.
2. The histogram of bins (``window / UNIT`` numbers, whatever the input) goes to
   the driver.  All combinations of up to ``DEPTH`` bins that fill the window
   are columns of a matrix; non-negative least squares finds how often each is
   to be used.  Counts are rounded without exceeding the histogram; what is left
   is packed greedily, largest bin first, again on counts and not on pieces.
3. The plan is a bounded table of (bin, range of ranks) -> sequences.  A piece's
   global rank is its rank in the task plus the pieces of its bin in earlier
   tasks; one broadcast join on the bin then gives sequence and slot, and a
   window over each sequence (at most ``window`` pieces) gives the offset.

No step gathers pieces on the driver or in one task.  Defined results: null text
is the empty text and still yields its end token; repeated rows are packed each
on their own; an empty table packs to no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeline.llm.common import materialise, pieces

WINDOW = 2048
UNIT = 8
DEPTH = 3
END_ID = 1
#: Bytes of chunks and ids that one generation of the cache may hold, with what an entry costs besides.
CACHED_BYTES, ENTRY_BYTES = 80 << 20, 150
PIECE_BYTES = 2 << 20


#: Letters, then punctuation that the tokenizer splits off (an apostrophe may belong to the letters after it).
WORD = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)")


class Chunks:
    """White-space chunks and their ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its chunks, one after the other; likewise a chunk of letters and
    punctuation is the two, one after the other.  Case is folded first, except in
    texts that may hold a special token.  Chunks are remembered in two
    generations: when the young one is full it becomes the old one, and what is
    met again comes back from there; so frequent chunks stay, rare ones go.  A
    generation is full by its bytes, so long chunks do not make it grow; only the
    chunks of one piece of documents are ever held beyond that.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _keep(self, chunk: bytes, ids: bytes) -> None:
        self.young[chunk] = ids
        self.held += len(chunk) + len(ids) + ENTRY_BYTES

    def _recall(self, chunks: Iterable[bytes]) -> list[bytes]:
        """Bring chunks back into the young generation; return the unknown ones."""
        young, old, unknown = self.young, self.old, []
        for c in chunks:
            if c not in young:
                if (ids := old.get(c)) is None:
                    unknown.append(c)
                else:
                    self._keep(c, ids)
        return unknown

    def _encode_words(self, words: list[bytes]) -> None:
        """Plain words: each ends with its only token that ends a word."""
        found = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[found]) + 1
        if len(ends) != len(words):
            self._encode_any(words)
            return
        data, at = found.tobytes(), 0
        for w, end in zip(words, (4 * ends).tolist(), strict=True):
            self._keep(w, data[at:end])
            at = end

    def _encode_any(self, chunks: list[bytes]) -> None:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        data = np.array(found.ids, "<u4").tobytes()
        at = 4 * np.searchsorted(np.array([o[0] for o in found.offsets], np.int64), starts)
        for c, i, j in zip(chunks, at[:-1].tolist(), at[1:].tolist(), strict=True):
            self._keep(c, data[i:j])

    def learn(self, chunks: set[bytes]) -> None:
        """Make sure that ``chunks`` are in the young generation."""
        unknown = self._recall(chunks)
        if self.held + sum(map(len, unknown)) + ENTRY_BYTES * len(unknown) > CACHED_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
            unknown = self._recall(chunks)
        split, words, other = [], set(), set()
        for c in unknown:
            m = WORD.fullmatch(c)
            word, tail = m.groups() if m else (b"", b"")
            if word and plain(word):
                words.add(word)
                if tail:
                    other.add(tail)
                    split.append((c, word, tail))
            else:
                other.add(c)
        if words := self._recall(words):
            self._encode_words(words)
        if other := self._recall(other):
            self._encode_any(other)
        for c, word, tail in split:
            self._keep(c, self.young[word] + self.young[tail])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text."""
        split = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts]
        self.learn(set().union(*split))
        get = self.young.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


def plain(word: bytes) -> bool:
    """Letters of the Latin blocks, which case folding and composition leave letters."""
    if word.isascii():
        return True
    text = word.decode("utf-8", "replace")
    return max(text) < "\u0250" and text.isalpha() and "\u0130" not in text


_CACHE: dict[str, Chunks] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """Documents cut at multiples of ``window``: one row per piece, with its bin and its rank in (part, bin)."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # a file of the driver's; its text (some MB) is broadcast
        spec = spark.sparkContext.broadcast(f.read())
    key = uuid.uuid4().hex
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("bin", pa.int32()), ("rank", pa.int64())] + [("ids", pa.binary())] * with_ids
    kinds = {"int64": "long", "int32": "int", "binary": "binary"}
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {id_type}", *(f"{n} {kinds[str(t)]}" for n, t in fields)])
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        if key not in _CACHE:
            _CACHE.clear()
            _CACHE[key] = Chunks(spec.value)
        chunks, seen, part = _CACHE[key], np.zeros(window // unit + 2, np.int64).tolist(), TaskContext.get().partitionId()
        for batch in pieces(batches, "text", PIECE_BYTES):
            rows, columns = [], [[] for _ in fields]
            for i, ids in enumerate(chunks.encode(batch.column(1).to_pylist())):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    own = ids[4 * start : 4 * (start + window)]
                    length = len(own) // 4
                    b = -(-length // unit)
                    rows.append(i)
                    for c, v in zip(columns, (start, length, zlib.crc32(own), total, part, b, seen[b], own), strict=False):
                        c.append(v)
                    seen[b] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], ["id", *(n for n, _ in fields)])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, schema)


def combinations(size: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``depth`` positive integers with the sum ``size``."""

    def fill(rest: int, most: int, left: int):
        if rest <= most:
            yield (rest,)
        if left > 1:
            for first in range(min(most, rest - 1), 0, -1):
                if first * left < rest:
                    break
                for more in fill(rest - first, first, left - 1):
                    yield (first, *more)

    return sorted(fill(size, size, depth), reverse=True)


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """Minimise |a x - b| over x >= 0 by active sets: add the column of the steepest descent, drop what turns negative."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    scale = tolerance * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= scale:
            break
        active[best] = True
        while True:
            use = np.flatnonzero(active)
            solved = np.linalg.lstsq(a[:, use], b, rcond=None)[0]
            if solved.min(initial=1) > 0:
                x[:] = 0
                x[use] = solved
                break
            low = solved <= 0
            old = x[use]
            step = np.min(old[low] / np.maximum(old[low] - solved[low], 1e-300), initial=1.0)
            x[use] = old + step * (solved - old)
            gone = use[low & (x[use] <= 1e-12 * max(1.0, old.max(initial=0)))]
            if not len(gone):
                gone = use[low][:1]
            x[gone] = 0
            active[gone] = False
    return x


def plan(histogram: dict[int, int], size: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, how many such sequences), using up the histogram of bins 1..size exactly."""
    left = {b: n for b, n in histogram.items() if n}
    chosen: list[tuple[tuple[int, ...], int]] = []
    if left.get(size):
        chosen.append(((size,), left.pop(size)))
    kinds = [c for c in combinations(size, depth) if all(b in left for b in c)]
    if kinds:
        a = np.zeros((size + 1, len(kinds)))
        for j, c in enumerate(kinds):
            for b in c:
                a[b, j] += 1
        b = np.array([left.get(i, 0) for i in range(size + 1)], float)
        use = [i for i in range(size + 1) if left.get(i)]
        x = nnls(a[use], b[use])
        for j in np.argsort(-x, kind="stable").tolist():
            most = min(left.get(b, 0) // kinds[j].count(b) for b in kinds[j])
            n = min(round(float(x[j])), most)
            if n > 0:
                chosen.append((kinds[j], n))
                for b in kinds[j]:
                    left[b] -= n
    left = {b: n for b, n in left.items() if n}
    while left:
        room, bins, rest = size, [], dict(left)
        while fitting := [b for b, n in rest.items() if n and b <= room]:
            b = max(fitting)
            bins.append(b)
            rest[b] -= 1
            room -= b
        n = min(left[b] // bins.count(b) for b in set(bins))
        chosen.append((tuple(bins), n))
        for b in bins:
            left[b] -= n
        left = {b: n for b, n in left.items() if n}
    return chosen


def assign(spark: SparkSession, cut: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """Add sequence_id and offset to written pieces."""
    counts = materialise(cut.groupBy("part", "bin").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r.bin: r.n for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    segments, used, next_id = [], dict.fromkeys(histogram, 0), 0
    for bins, n in plan(histogram, window // unit):
        slots = list(accumulate((bins.count(b) for b in dict.fromkeys(bins)), initial=0))
        for slot, b in zip(slots, dict.fromkeys(bins), strict=False):
            many = bins.count(b)
            segments.append((b, used[b], used[b] + n * many, many, slot, next_id))
            used[b] += n * many
        next_id += n
    table = spark.createDataFrame(segments, "bin int, first long, last long, many long, slot long, base long")
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("part", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = cut.join(earlier, ["part", "bin"]).withColumn("at", F.col("rank") + F.col("earlier"))
    # the table has at most some thousand rows: it depends on the bins only
    placed = ranked.join(F.broadcast(table.withColumnRenamed("bin", "b")), (F.col("bin") == F.col("b")) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("last")))
    within = F.col("at") - F.col("first")
    placed = placed.withColumn("sequence_id", F.col("base") + F.expr("(at - first) div many")).withColumn("place", F.col("slot") + within % F.col("many"))
    earlier_in = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier_in), F.lit(0))).drop("part", "bin", "rank", "b", "at", "first", "last", "many", "slot", "base", "earlier", "place")


def pack(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    cut = materialise(token_pieces(docs, tokenizer_path, id_col, text_col, window, unit, with_ids), "packing-pieces")
    return assign(docs.sparkSession, cut, window, unit).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """The token sequences of pieces packed ``with_ids``: sequence_id, ids (padded with zeros to the window unless their number is a power of two), n_tokens."""
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("all"))
    ids = F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    n = F.col("n_tokens")
    full = F.when(F.bit_count(n) == 1, n).otherwise(F.lit(window))
    return joined.select("sequence_id", F.rpad(ids, (4 * full).cast("int"), F.lit(b"\0")).alias("ids"), "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
