"""Language-model scoring with an Elias-Fano bigram trie, built and queried in shards.

The model interpolates absolute discounting: P1(w) = max(c(w) - d, 0) / N + d V / N / (V + 1)
and P(w | u) = max(c(u w) - D, 0) / c(u) + D s(u) / c(u) * P1(w), where s(u) counts
the distinct successors of u.  The first term lies, quantised (rounded down, so
that nothing sums to more than one), in the trie; unknown words share the class
``V + 1``.  The end of a document is the context of the next one's first word.

Nothing that grows with the corpus is broadcast or collected:

1. documents become *blocks* of some million tokens (local word ids, compressed),
   written once; each block sends its distinct words, once, to vocabulary shards;
2. a vocabulary shard adds up its words' training counts, gives out ids and
   answers every block for the words it sent;
3. each block sends its distinct known bigrams with training counts to trie
   shards (by the context; contexts that fill more than a shard's share are
   spread by the successor as well, as their successor counts add up);
4. a trie shard adds up the counts, builds its trie, memory-maps it, and answers
   each block with the codes of the bigrams it sent;
5. each block turns answers into scores.  Only N, V and two counts of counts
   (four numbers) pass through the driver.

A hot word is one entry per block, whatever its frequency.  Blocks and shards have
bounded sizes, and every shuffle has as many partitions as there are shards, so a
task's share does not grow with the input.

Defined results: null text is the empty text and has only its end token; rows
without an id count as training rows; repeated rows are scored each on their
own; an empty table gives no rows; other columns are ignored.  Without training
rows every probability is that of the one unknown class.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.llm.common import materialise, pieces
from strikeline.llm.eliasfano import Trie, dequantise, quantise
from strikeline.llm.near_dedup import mix

BLOCK_TOKENS = 2_000_000
BATCH_BYTES = 4 << 20
#: Bytes of input per shard.
SHARD_BYTES = 8 << 20
#: Estimates from here on mean that the size is not known.
UNKNOWN_BYTES = 1 << 60
DISCOUNT = 0.75
#: Contexts with more than one part in SPREAD of all tokens may be spread over shards: there are fewer than SPREAD.
SPREAD = 10_000
FOLDS = 10


def pack(values: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane, compressed."""
    values = np.ascontiguousarray(values, np.int64)
    return zstandard.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), 1) if len(values) else b""


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def shard_count(docs: DataFrame, text_col: str) -> int:
    """In proportion to the input, as the optimizer estimates it; measured where it can't."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    return max(4, min(1 << 20, size // SHARD_BYTES))


_BLOCK = "kind string, block long, shard int, ids array<string>, held array<boolean>, lengths binary, a binary, b binary, c binary"
_ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("shard", pa.int32()), ("ids", pa.list_(pa.string())), ("held", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _block_rows(block: int, shards: int, ids: list, held: list, words: dict, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """One row of tokens (local ids; 0 is the end) and a row of distinct words for each vocabulary shard."""
    lengths = np.array([len(x) for x in arrays], np.int64)
    tokens = np.concatenate(arrays)
    train = np.bincount(tokens[~np.repeat(np.array(held, bool), lengths)], minlength=len(words))
    rows = [("tokens", block, -1, ids, held, pack(lengths), pack(tokens), None, None)]
    names = list(words)
    shard = np.fromiter((xxhash.xxh3_64_intdigest(w) % shards for w in names), np.int64, len(names))
    order = np.argsort(shard, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        rows.append(("words", block, int(shard[own[0]]), None, None, None, zstandard.compress(b"\n".join(names[i] for i in own), 1), pack(own), pack(train[own])))
    return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], _ARROW)


def blocks(docs: DataFrame, shards: int, id_col: str, text_col: str, folds: int) -> DataFrame:
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0

        def fresh():
            words = defaultdict()
            words.default_factory = words.__len__
            words[b""]  # the end token is word 0
            return [], [], words, [], 0

        ids, held, words, arrays, size = fresh()
        for batch in pieces(batches, "text", BATCH_BYTES):
            for i, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = text.lower().split() if text else []
                tokens = np.zeros(len(own) + 1, np.int64)
                tokens[:-1] = np.fromiter(map(words.__getitem__, own), np.int64, len(own))
                ids.append(i)
                held.append(h)
                arrays.append(tokens)
                size += len(tokens)
                if size >= BLOCK_TOKENS:
                    yield _block_rows((part << 24) + number, shards, ids, held, words, arrays)
                    number += 1
                    ids, held, words, arrays, size = fresh()
        if ids:
            yield _block_rows((part << 24) + number, shards, ids, held, words, arrays)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), held_out(F.col(id_col), folds).alias("held"), F.col(text_col).cast("binary").alias("text"))
    return materialise(rows.mapInArrow(run, _BLOCK), "lm-blocks", ["kind"])


def number_words(sent: DataFrame, shards: int) -> DataFrame:
    """Per (block, shard): ids (0: not in training) and training counts of the words sent; per shard: n, v, n1, n2."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, index = int(pdf["shard"].iloc[0]), defaultdict()
        index.default_factory = index.__len__
        at = []
        for data in pdf["a"]:
            own = zstandard.decompress(data).split(b"\n")
            at.append(np.fromiter(map(index.__getitem__, own), np.int64, len(own)))
        count = np.zeros(len(index), np.int64)
        for where, data in zip(at, pdf["c"], strict=True):
            count[where] += unpack(data)  # a block sends a word once
        known = count > 0
        number = np.where(known, (np.cumsum(known) - 1) * shards + shard + 1, 0)
        rows = [("numbers", b, local, pack(number[where]), pack(count[where]), 0, 0, 0, 0) for b, local, where in zip(pdf["block"], pdf["b"], at, strict=True)]
        rows.append(("sums", -1, None, None, None, int(count.sum()), int(known.sum()), int((count == 1).sum()), int((count == 2).sum())))
        return pd.DataFrame(rows, columns=["kind", "block", "b", "a", "c", "n", "v", "n1", "n2"])

    told = sent.select("block", "shard", "a", "b", "c").repartition(shards, "shard").groupBy("shard").applyInPandas(run, "kind string, block long, b binary, a binary, c binary, n long, v long, n1 long, n2 long")
    return materialise(told, "lm-numbers", ["kind"])


class Block:
    """A block's tokens with the numbers its words were given."""

    def __init__(self, pdf: pd.DataFrame):
        own = pdf[pdf["kind"] == "tokens"].iloc[0]
        self.ids, self.held, self.lengths, self.tokens = list(own["ids"]), np.array(own["held"], bool), unpack(own["lengths"]), unpack(own["a"])
        told = pdf[pdf["kind"] == "numbers"]
        size = int(self.tokens.max()) + 1
        self.number, self.count = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for local, number, count in zip(told["b"], told["a"], told["c"], strict=True):
            at = unpack(local)
            self.number[at], self.count[at] = unpack(number), unpack(count)
        self.size = size
        before = np.concatenate([[0], self.tokens[:-1]])
        self.starts = np.cumsum(self.lengths) - self.lengths
        before[self.starts] = 0  # the end token
        self.before = before

    def bigrams(self, shards: int, share: float):
        """Distinct known bigrams, sorted by (shard, context, word): local keys, shard, context, word, training count."""
        known = self.number[self.before] > 0  # unknown words go along as 0: their context must be asked for
        key = self.before[known] * self.size + self.tokens[known]
        train = ~np.repeat(self.held, self.lengths)[known]
        order = np.argsort(key, kind="stable")
        key, train = key[order], train[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key, count = key[first], np.add.reduceat(train.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        left, right = key // max(1, self.size), key % max(1, self.size)
        context, word = self.number[left], self.number[right]
        with np.errstate(over="ignore"):
            home = mix(context.astype(np.uint64))
            home = np.where(self.count[left] > share, mix(home + word.astype(np.uint64)), home)
        shard = (home % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((word, context, shard))
        return key[order], shard[order], context[order], word[order], count[order], self.count[left][order]


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


def _grouped(rows: list[DataFrame], shards: int, function, schema: str) -> DataFrame:
    """All rows of a block, from several tables, to ``function``."""
    columns = ["kind", "block", "ids", "held", "lengths", "a", "b", "c", "shard"]
    kinds = {"ids": "array<string>", "held": "array<boolean>", "shard": "int", "kind": "string", "block": "long"}
    same = [t.select(*(F.col(c) if c in t.columns else F.lit(None).cast(kinds.get(c, "binary")).alias(c) for c in columns)) for t in rows]
    union = same[0]
    for t in same[1:]:
        union = union.unionByName(t)
    return union.repartition(shards, "block").groupBy("block").applyInPandas(function, schema)


def send_bigrams(tokens: DataFrame, numbers: DataFrame, shards: int, share: float) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(pdf)
        _, shard, context, word, count, total = block.bigrams(shards, share)
        rows = []
        bounds = _runs(shard)
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            runs = _runs(context[i:j])
            begin = i + runs[:-1]
            rows.append((int(pdf["block"].iloc[0]), int(shard[i]), pack(np.diff(context[begin], prepend=0)), pack(np.diff(runs)), pack(total[begin]), pack(word[i:j]), pack(count[i:j])))
        return pd.DataFrame(rows, columns=["block", "shard", "contexts", "runs", "totals", "words", "counts"])

    return _grouped([tokens, numbers], shards, run, "block long, shard int, contexts binary, runs binary, totals binary, words binary, counts binary")


def build_and_query(sent: DataFrame, shards: int, share: float) -> DataFrame:
    """Per trie shard: add up, build the trie, answer each block with codes and successor counts.

    Of contexts that are spread over shards, the successor counts go into rows of their own.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, contexts, totals, words, counts = [], [], [], [], []
        for c, r, t, w, n in zip(pdf["contexts"], pdf["runs"], pdf["totals"], pdf["words"], pdf["counts"], strict=True):
            runs = unpack(r)
            sizes.append(runs)
            contexts.append(np.cumsum(unpack(c)))
            totals.append(unpack(t))
            words.append(unpack(w))
            counts.append(unpack(n))
        known, at = np.unique(np.concatenate(contexts), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        total[at] = np.concatenate(totals)
        node = np.repeat(at, np.concatenate(sizes))
        spelled, word = np.unique(np.concatenate(words), return_inverse=True)
        key, back = np.unique(node * len(spelled) + word, return_inverse=True)
        count = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        node, word = key // len(spelled), spelled[key % len(spelled)]
        seen = count > 0
        part = np.maximum(count[seen] - DISCOUNT, 0) / total[node[seen]]
        trie = Trie(known[node[seen]], word[seen], quantise(part))
        codes = trie.query(known[node], word).astype(np.int64)[back]
        different = np.bincount(node[seen], minlength=len(known))[at]
        rows, i, j = [], 0, 0
        for b, shard, runs in zip(pdf["block"], pdf["shard"], sizes, strict=True):
            n = int(runs.sum())
            rows.append(("codes", b, shard, pack(codes[i : i + n]), pack(different[j : j + len(runs)])))
            i, j = i + n, j + len(runs)
        hot = np.flatnonzero(total > share)
        rows.append(("spread", -1, -1, pack(known[hot]), pack(np.bincount(node[seen], minlength=len(known))[hot])))
        return pd.DataFrame(rows, columns=["kind", "block", "shard", "a", "b"])

    told = sent.repartition(shards, "shard").groupBy("shard").applyInPandas(run, "kind string, block long, shard int, a binary, b binary")
    return materialise(told, "lm-codes", ["kind"])


def spread_counts(codes: DataFrame) -> dict[int, int]:
    """Distinct successors of the contexts that are spread over shards: at most SPREAD contexts."""
    total: dict[int, int] = defaultdict(int)
    for a, b in codes.where("kind = 'spread'").select("a", "b").toLocalIterator():
        for context, n in zip(unpack(a and bytes(a)).tolist(), unpack(b and bytes(b)).tolist(), strict=True):
            total[context] += n
    return dict(total)


def score(tokens: DataFrame, numbers: DataFrame, codes: DataFrame, shards: int, share: float, hot: dict[int, int], n: int, v: int, n1: int, n2: int) -> DataFrame:
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else DISCOUNT

    def probabilities(block: Block, pdf: pd.DataFrame):
        key, shard, context, _, _, _ = block.bigrams(shards, share)
        seen, spread = np.zeros(len(key)), np.zeros(block.size)
        answers = {int(s): (unpack(a), unpack(b)) for k, s, a, b in zip(pdf["kind"], pdf["shard"], pdf["a"], pdf["b"], strict=True) if k == "codes"}
        bounds = _runs(shard)
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own, different = answers[int(shard[i])]
            seen[i:j] = dequantise(own)
            begin = i + _runs(context[i:j])[:-1]
            spread[key[begin] // block.size] = different
        if hot:
            names, counts = (np.array(x, np.int64) for x in zip(*sorted(hot.items()), strict=True))
            at = np.minimum(np.searchsorted(names, block.number), len(names) - 1)
            spread = np.where(names[at] == block.number, counts[at], spread)
        order = np.argsort(key)
        key, seen = key[order], seen[order]
        count = block.count
        alone = (np.maximum(count - d, 0) / n if n else np.zeros(block.size)) + (d * v / n if n else 1.0) / (v + 1)
        rest = np.where(count > 0, DISCOUNT * spread / np.maximum(count, 1), 1.0)
        pair = block.before * block.size + block.tokens
        at = np.minimum(np.searchsorted(key, pair), max(0, len(key) - 1))
        found = (key[at] == pair) if len(key) else np.zeros(len(pair), bool)
        first = np.where(found, seen[at] if len(key) else 0.0, 0.0)
        return first, rest, alone

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(pdf)
        first, rest, alone = probabilities(block, pdf)
        p = np.where(block.number[block.before] > 0, first + rest[block.before] * alone[block.tokens], alone[block.tokens])
        base = (block.count + 0.1) / (n + 0.1 * (v + 1))
        total = lambda x: np.add.reduceat(x, block.starts)
        return pd.DataFrame(
            {
                "id": block.ids,
                "held_out": block.held,
                "n_tokens": block.lengths,
                "n_known": total((block.count[block.tokens] > 0).astype(np.int64)),
                "train_tokens": n,
                "base_score": total(np.log10(base)[block.tokens]),
                "score": total(np.log10(p)),
            }
        )

    return _grouped([tokens, numbers, codes], shards, rows, "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    shards = shard_count(docs, text_col)
    table = blocks(docs, shards, id_col, text_col, folds)
    tokens, words = table.where("kind = 'tokens'"), table.where("kind = 'words'")
    told = number_words(words, shards)
    sums = told.where("kind = 'sums'").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n1", "n2"))).first()
    numbers = told.where("kind = 'numbers'").select("kind", "block", "a", "b", "c")
    n, v, n1, n2 = map(int, sums)
    share = max(1.0, n / min(4 * shards, SPREAD))
    codes = build_and_query(send_bigrams(tokens, numbers, shards, share), shards, share)
    found = score(tokens, numbers, codes.where("kind = 'codes'"), shards, share, spread_counts(codes), n, v, n1, n2)
    return found.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
