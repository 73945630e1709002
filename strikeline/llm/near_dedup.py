"""Near-dedup: MinHash bands find candidates, odd sketches verify them, full sets confirm.

A document's set holds its distinct 5-word shingles.  ``SAMPLES`` MinHash values
are folded into parity bitmaps (odd sketches) of ``BITS`` bits in ``PARTS`` equal
parts; the population count of the XOR of two bitmaps estimates their similarity,
most precisely where it is high.  The first ``BANDS * ROWS`` values also make
``BANDS`` keys of ``ROWS`` values: two sets of similarity 0.75 share a key with
probability 1 - (1 - 0.75**4)**32 > 0.99999, and the cuts on sketches lie five
standard deviations beyond what 0.75 gives.  What the cuts admit is confirmed on
whole sets, from the texts.

No pair explosion and no unbounded group in a task:

* equal sets are one class; only its first row goes on (its copies follow it);
* round 1 compares each class with one leader per shared key (the minimum under
  a hash that differs from key to key, a plain aggregation) by the first part of
  the sketch and confirms its best candidate: at most one link per class, from
  which components are grown;
* round 2 looks only into keys whose members are still in several components.
  Such a key is cut into blocks, bounded in members and in shingles, and every
  two blocks are compared by whole sketches.  A first pass names the members that
  have an admitted pair in another component (a pair belongs to the first key its
  members share, so it is looked at once); a second pass gets these members' texts,
  once per block, and confirms pairs there, with a union-find over the block's
  roots: only links that join two components leave it.  So neither pass emits
  more rows than it reads, and no admitted pair goes unconfirmed unless its
  members are in one component already;
* in round 1 confirming streams members past their leader's set; a leader of many
  is spread over several (leader, salt) groups.

Defined results: documents without words are linked with nothing; of a component
the row with the smallest id stays, null ids coming last; of repeated rows one
stays; ties between candidates go to the smaller row number; an empty table gives
no rows; extra columns, whatever their names, are ignored or, by
:func:`drop_near_repeats`, carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeline.llm.common import free_names, materialise, pieces
from strikeline.llm.graph import components

WORDS = 5
PERCENT = 75
SAMPLES = 1_024
BITS = 2_048
PARTS = 4
BANDS, ROWS = 32, 4
#: XOR population counts up to which sketches admit a pair.  Expected at 0.75: 101 in one part, 403 in all; deviations 12 and 25.
MOST_FIRST, MOST_BITS = 160, 528
BATCH_BYTES = 4 << 20
CACHED_BYTES = 16 << 20
GROUP = 1_000
#: A block's members and shingles.
BLOCK, BLOCK_SHINGLES = 2_048, 1 << 20
BROADCAST_ROWS = 100_000

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEEDS = (mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * _P) >> _HALF).astype(np.uint32)
_XOR, _ODD = _SEEDS[:SAMPLES], _SEEDS[SAMPLES:] | np.uint32(1)
_INDEX = np.arange(SAMPLES, dtype=np.uint64)
_PART = (np.arange(SAMPLES) // (SAMPLES // PARTS)) * (BITS // PARTS)
_STEP = 64


class Words(dict):
    """Hashes of words, forgotten when the words held exceed a number of bytes."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 100
        if self.held > CACHED_BYTES:
            self.clear()
            self.held = len(word) + 100
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = Words()


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles (of its one short sequence, if it has fewer words)."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(h))
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    for c in range(size):
        total = total * _P + h[c : n + c]
    return np.unique(mix(total))


def signature(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Band keys, odd sketch (as signed 64-bit integers), and a 128-bit digest of the set."""
    least = np.full(SAMPLES, np.uint32(2**32 - 1))
    short = (own >> _HALF).astype(np.uint32)
    table = np.empty((min(_STEP, len(own)), SAMPLES), np.uint32)
    for i in range(0, len(own), _STEP):
        rows = short[i : i + _STEP, None]
        part = np.bitwise_xor(rows, _XOR, out=table[: len(rows)])
        np.multiply(part, _ODD, out=part)
        np.minimum(least, part.min(axis=0), out=least)
    least = least.astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for c in range(ROWS):
        keys = mix(keys * _P + least[c : BANDS * ROWS : ROWS])
    places = (mix(least + _INDEX * _P) % np.uint64(BITS // PARTS)).astype(np.int64) + _PART
    sketch = np.packbits((np.bincount(places, minlength=BITS) & 1).astype(np.uint8)).view("<i8")
    digest = own.sum(dtype=np.uint64), mix(own + _P).sum(dtype=np.uint64)
    return keys.view(np.int64), sketch, *(int(d.astype(np.int64)) for d in digest)


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One written row per document: rid, id, h (hash of the text), n, the set's digest, band keys, the sketch's first part and its rest."""
    kind = docs.schema[id_col].dataType.simpleString()
    cut = BITS // PARTS // 64
    names = ["rid", "id", "h", "n", "lo", "hi", "keys", "sketch", "rest"]

    def run(batches):
        for batch in pieces(batches, "text", BATCH_BYTES):
            out: list[list] = [[], [], [], [], [], []]
            for text in batch.column(3).to_pylist():
                own = shingles(text)
                keys, sketch, lo, hi = signature(own) if len(own) else ([], [], 0, 0)
                for c, v in zip(out, (len(own), lo, hi, keys, sketch[:cut], sketch[cut:]), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names)

    rows = keyed(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    return materialise(rows.select("rid", "id", "h", "text").mapInArrow(run, f"rid long, id {kind}, h long, n long, lo long, hi long, keys array<long>, sketch array<long>, rest array<long>"), "signatures")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("binary").alias("text"))


def _with_bits(pairs: DataFrame, rep: DataFrame) -> DataFrame:
    """Pairs (a, b) that the sketches' first parts and sizes admit, with the population count ``bits``."""
    for side in "ab":
        pairs = pairs.join(rep.select(F.col("rid").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    bits = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(BITS // PARTS // 64)), F.lit(0))
    sizes = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return pairs.withColumn("bits", bits).where((F.col("bits") <= MOST_FIRST) & sizes).select("a", "b", "bits")


def alike(own: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets that are not empty are similar enough."""
    if len(own) < len(other):
        own, other = other, own
    same = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
    return 100 * same >= PERCENT * (len(own) + len(other) - same)


def _with_texts(orders: DataFrame, columns: list[str], signed: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``orders`` (with a column rid) and their documents' texts."""
    orders = materialise(orders.join(signed.select("rid", F.col("id").alias("of"), F.col("h").alias("oh")), "rid"), "near-orders")
    # 600 bytes each at most; beyond the bound texts are shuffled by their key first
    few = orders.count() <= BROADCAST_ROWS
    rows = keyed(docs, id_col, text_col)
    return rows.join(F.broadcast(orders) if few else orders, rows["h"].eqNullSafe(F.col("oh")) & rows["id"].eqNullSafe(F.col("of"))).select(*columns, "text")


def confirm(pairs: DataFrame, signed: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; written."""
    pairs = materialise(pairs.select("a", "b"), "near-candidates")
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    members = pairs.join(sizes, "b").select(F.col("b").alias("to"), F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"), F.col("a").alias("rid"))
    leaders = sizes.select(F.col("b").alias("to"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("b").alias("rid"))
    sent = _with_texts(members.unionByName(leaders), ["to", "salt", "role", "rid"], signed, docs, id_col, text_col)
    sent = sent.repartition("to", "salt").sortWithinPartitions("to", "salt", "role")

    def run(batches):
        group, own = None, None
        for batch in pieces(batches, "text", BATCH_BYTES):
            a, b = [], []
            for to, salt, role, rid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if role == 0:
                    if group != (to, salt):
                        group, own = (to, salt), shingles(text)
                    continue
                if group != (to, salt):
                    raise RuntimeError("a member came before its leader")
                if alike(own, shingles(text)):
                    a.append(rid)
                    b.append(to)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return materialise(sent.mapInArrow(run, "a long, b long").distinct(), "near-links")


def _groups(batches) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each (key, i, j), which come in order, with their key."""
    group, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([np.asarray(batch.column(c)) for c in range(3)], axis=1).astype(np.int64)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            here = tuple(marks[start].tolist())
            if here != group and held:
                yield group[0], pa.Table.from_batches(held)
                held = []
            group = here
            held.append(batch.slice(start, end - start))
    if held:
        yield group[0], pa.Table.from_batches(held)


def _wide(table: pa.Table, name: str) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    found = table.column(name).combine_chunks()
    return np.asarray(found.flatten()).reshape(len(found), -1)


def _admitted(key: int, table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of pairs that belong to ``key``, lie in two components, and that sketches and sizes admit; in runs of bounded size."""
    block, root, n = (np.asarray(table.column(c)) for c in ("block", "root", "n"))
    sketch = np.concatenate([_wide(table, "sketch"), _wide(table, "rest")], axis=1).view(np.uint64)
    keys = _wide(table, "keys")
    place = np.arange(len(block))
    first = np.flatnonzero(block == block.min())
    one = len(first) == len(block)
    step = max(1, (1 << 20) // (len(block) * sketch.shape[1]))
    for at in range(0, len(first), step):
        left = first[at : at + step]
        bits = np.bitwise_count(sketch[left][:, None, :] ^ sketch[None, :, :]).sum(axis=2, dtype=np.int64)
        fits = (bits <= MOST_BITS) & (root[left][:, None] != root) & (100 * np.minimum(n[left][:, None], n) >= PERCENT * np.maximum(n[left][:, None], n))
        if one:
            fits &= left[:, None] < place
        else:
            fits[:, first] = False
        x, y = np.nonzero(fits)
        order = np.argsort(bits[x, y], kind="stable")
        x, y = left[x[order]], y[order]
        for i in range(0, len(x), 1 << 14):
            u, v = x[i : i + (1 << 14)], y[i : i + (1 << 14)]
            shared = (keys[u] == keys[v]).argmax(axis=1)
            mine = keys[u, shared] == key
            yield u[mine], v[mine]


def _touched(batches):
    """Pass 1: members of a (key, i, j) that have an admitted pair there."""
    for key, table in _groups(batches):
        if table.num_rows < 2:
            continue
        hit = np.zeros(table.num_rows, bool)
        for x, y in _admitted(key, table):
            hit[x] = hit[y] = True
        found = table.filter(pa.array(hit)).select(["key", "i", "j", "block", "rid", "root"])
        yield from found.combine_chunks().to_batches()


def _joining(batches):
    """Pass 2: links (a, b) of a (key, i, j) that join two components there."""
    for key, table in _groups(batches):
        _, only = np.unique(np.asarray(table.column("rid")), return_index=True)  # repeated rows have one rid and come once per repeat
        table = table.take(pa.array(np.sort(only)))
        rid, root = (np.asarray(table.column(c)) for c in ("rid", "root"))
        sets = [shingles(t) for t in table.column("text").to_pylist()]
        up: dict[int, int] = {}

        def top(r: int, up: dict[int, int] = up) -> int:
            while up.setdefault(r, r) != r:
                up[r] = r = up[up[r]]
            return r

        a, b = [], []
        for xs, ys in _admitted(key, table):
            for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                s, t = top(int(root[x])), top(int(root[y]))
                if s != t and alike(sets[x], sets[y]):
                    up[s] = t
                    a.append(int(rid[x]))
                    b.append(int(rid[y]))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _rest(members: DataFrame, signed: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links between components among ``members`` (key, rid, root, n, keys, sketch, rest); written."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    size = materialise(members.groupBy("key").agg(blocks.alias("blocks")), "near-sizes")
    rows = members.join(size, "key").withColumn("block", F.pmod(F.xxhash64("rid", "key"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rid", "root", "n", "keys", "sketch", "rest")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    touched = materialise(rows.mapInArrow(_touched, "key long, i int, j int, block int, rid long, root long"), "near-touched")
    columns = ["key", "i", "j", "block", "rid", "root", "n", "keys", "sketch", "rest"]
    orders = touched.join(signed.select("rid", "n", "keys", "sketch", "rest"), "rid").select(columns)
    sent = _with_texts(orders, columns, signed, docs, id_col, text_col)
    sent = sent.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return materialise(sent.mapInArrow(_joining, "a long, b long").distinct(), "near-joins")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, h, n_shingles, component_id, kept."""
    signed = sign(docs, id_col, text_col)
    # aggregations are written before a join with them, so that AQE sees plain shuffles and can split a hot group
    sets = signed.where("n > 0").groupBy("n", "lo", "hi").agg(F.min("rid").alias("class"), F.count("*").alias("size"))
    sets = materialise(sets.where("size > 1").drop("size"), "near-sets")
    members = signed.join(sets, ["n", "lo", "hi"], "left").withColumn("class", F.coalesce("class", "rid"))
    members = materialise(members.select("rid", "id", "h", "n", "class"), "near-classes")
    rep = signed.join(members.where("n > 0 AND rid = class").select("rid"), "rid", "left_semi")
    rep = materialise(rep.select("rid", "n", "keys", "sketch", "rest"), "near-representatives")
    bands = rep.select("rid", F.explode("keys").alias("key"))
    leaders = bands.groupBy("key").agg(F.min_by("rid", F.xxhash64("rid", "key")).alias("b"), F.count("*").alias("size")).where("size > 1")
    shared = materialise(bands.join(leaders.select("key", "b"), "key"), "near-shared")
    pairs = _with_bits(shared.where("rid != b").select(F.col("rid").alias("a"), "b").distinct(), rep)
    best = pairs.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    links = confirm(best, signed, docs, id_col, text_col)
    roots = components(links)
    rooted = shared.select("key", "rid").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    rooted = materialise(rooted, "near-rooted")
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("key")
    open_keys = materialise(open_keys, "near-open")
    more = _rest(rooted.join(open_keys, "key", "left_semi").join(rep, "rid"), signed, docs, id_col, text_col)
    if more.take(1):
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a != b")
        roots = components(stars.unionByName(more))
    rooted = members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("first"), F.count("*").alias("size"))
    first = materialise(first.where("size > 1").select("root", "first"), "near-first")
    found = rooted.join(first, "root", "left")
    # a row without a match is alone in its component
    least = F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id"))
    return found.select("id", "h", F.col("n").alias("n_shingles"), least.alias("component_id"), (F.col("rid") == F.coalesce("first.rid", "rid")).alias("kept"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_shingles, component_id and kept."""
    return link(docs, id_col, text_col).drop("h").withColumnRenamed("id", id_col)


def drop_near_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each component, with all their columns."""
    own_id, own_h = free_names(docs.columns, "id", "h")
    found = materialise(link(docs, id_col, text_col).select("id", "h", "kept"), "near-found")
    kept = found.where("kept")
    rows = docs.withColumns({own_id: F.col(id_col), own_h: F.xxhash64(F.col(text_col).cast("string"))})
    rows = rows.join(kept, rows[own_id].eqNullSafe(kept["id"]) & (rows[own_h] == kept["h"]), "left_semi")
    if found.groupBy("id", "h").count().where("count > 1").take(1):  # the same row twice: one of them stays
        rows = rows.dropDuplicates([own_id, own_h])
    return rows.drop(own_id, own_h)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i : i + least(len(w), 5) - 1], ' ')) END) AS s FROM worded
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS same FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM pairs WHERE 100 * same >= 75 * (na + nb - same)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_of AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.c AS component_id, s.doc_id = c.c AS kept
FROM sets s JOIN least_of c ON s.doc_id = c.a
"""
