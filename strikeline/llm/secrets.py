"""Secret scan: credential patterns, and guess costs of values in a credential's place.

Base spans come from three patterns over the whole text.  The method adds spans
of kind ``guess``: whatever value follows a credential word and a separator is
split into dictionary words, dates, repeats, keyboard walks and sequences, and
brute-force characters, at the least total cost over all segmentations (log10 of
the guesses an attacker needs; dynamic programming over positions).  A walk or
repeat is at most ``SPAN`` characters; a longer one is several.  Values at or above
``GUESSES`` are reported unless a base ``assign`` span holds them already;
placeholders such as ``password = password123`` fall below it.

The dictionary is a short list of frequent passwords, followed by the corpus's own
``LEARNED`` most frequent words (counted over every text; ties by the alphabet), so
a phrase of the corpus's language is no secret.  Its size is all that is collected.

Scanning is a projection of each row: no shuffle, memory bound by one batch.
Defined results: null and empty texts have no spans; repeated rows are each
scanned; values of any length are scored whole (the cost of a step is bounded,
so time is linear in the value); an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.llm.common import pieces

BATCH_BYTES = 8 << 20
#: log10 of the guesses from which a value counts as a secret.
GUESSES = 9.0

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
HEX_BYTES = re.compile(rb"[0-9a-f]{32,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "guess")

CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth")
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_-]?key|credentials?|auth)["']?\x20*(?::=|=>|[:=]|\x20is\x20)\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"']+))""",
    re.IGNORECASE | re.ASCII,
)

# Frequent passwords and words in them, most frequent first.
WORDS = """password qwerty letmein welcome admin login master dragon monkey shadow sunshine princess football baseball iloveyou
superman batman trustno hello freedom whatever secret charlie michael jordan hunter killer george andrew thomas robert daniel
summer winter spring autumn january february march april june july august september october november december monday friday
love money test guest root user default changeme example sample dummy placeholder token none null your here this that with
pass word key access server database company internet computer network google apple cheese coffee chocolate flower orange
banana purple silver golden tiger lion eagle falcon wizard magic star angel happy lucky family mother father sister brother""".split()
#: Learned words: how many, and their least and most letters.
LEARNED, SHORTEST, LONGEST = 10_000, 4, 16
COUNTED = re.compile(rb"(?<![A-Za-z0-9\x80-\xff])[A-Za-z]{%d,%d}(?![A-Za-z0-9\x80-\xff])" % (SHORTEST, LONGEST))
HELD_WORDS = 200_000
CACHED_BYTES = 8 << 20
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz")
NEXT = {(a, b) for row in ROWS for r in (row, row[::-1]) for a, b in zip(r, r[1:], strict=False)}
DATES = (
    (re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"), math.log10(365 * 100)),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"), math.log10(365 * 100)),
    (re.compile(r"(?:19|20)\d\d"), math.log10(119)),
)
#: Each further segment doubles the guesses: the attacker has to find where it begins.
SEGMENT = math.log10(2)
REPEAT_PERIOD = 8
SPAN = 64


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() and c.isascii() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


class Guesser:
    """Guess costs under a ranked dictionary: the fixed words, then learned ones."""

    def __init__(self, learned: list[str] = ()):
        self.rank: dict[str, int] = {}
        for w in (*WORDS, *learned):
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))
        self.known: dict[str, float] = {}
        self.held = 0

    def word(self, value: str) -> float | None:
        """The cost of a dictionary word, in any case, with the usual digits for letters, or backwards."""
        low = value.lower()
        rank = min((k for k in (self.rank.get(low), 2 * self.rank.get(low.translate(LEET), 0), 2 * self.rank.get(low[::-1], 0)) if k), default=0)
        if not rank:
            return None
        upper = 0 if value == low else 1 if value[1:] == low[1:] or value.isupper() else 3
        return math.log10(rank + 1) + upper * SEGMENT

    def cost(self, value: str) -> float:
        """log10 of the guesses for the cheapest segmentation of ``value``."""
        if value not in self.known:
            self.held += 2 * len(value) + 100
            if self.held > CACHED_BYTES:
                self.known.clear()
                self.held = 2 * len(value) + 100
            self.known[value] = self._cost(value)
        return self.known[value]

    def _cost(self, value: str) -> float:
        n, low = len(value), value.lower()
        brute = [_brute(c) for c in value]
        sums = [0.0]
        for x in brute:
            sums.append(sums[-1] + x)
        best = [0.0] + [math.inf] * n
        spelled = [math.inf] * (n + 1)  # the same with a last segment of brute force, which may go on
        walk = 1  # length of the keyboard walk that ends before i
        run = [0] * (REPEAT_PERIOD + 1)  # run[p]: characters before i that equal those p earlier
        dates: dict[int, list[tuple[int, float]]] = {}
        for i in range(1, n + 1):
            if value[i - 1].isdigit():
                for pattern, own in DATES:
                    if m := pattern.match(value, i - 1):
                        dates.setdefault(m.end(), []).append((i - 1, own))
            walk = walk + 1 if i > 1 and (low[i - 2], low[i - 1]) in NEXT else 1
            for p in range(1, min(REPEAT_PERIOD, i - 1) + 1):
                run[p] = run[p] + 1 if value[i - 1] == value[i - 1 - p] else 0
            spelled[i] = brute[i - 1] + min(spelled[i - 1], best[i - 1] + (SEGMENT if i > 1 else 0))
            options = dates.pop(i, [])
            for size in range(3, min(self.longest, i) + 1):
                if (own := self.word(value[i - size : i])) is not None:
                    options.append((i - size, own))
            options += [(i - size, math.log10(50 * size)) for size in range(3, min(walk, SPAN) + 1)]
            for p in range(1, REPEAT_PERIOD + 1):
                for more in range(max(2, p), min(run[p], SPAN - p) + 1):
                    j = i - p - more
                    options.append((j, sums[j + p] - sums[j] + math.log10(1 + more / p)))
            best[i] = min([spelled[i], *(best[j] + own + (SEGMENT if j else 0) for j, own in options)])
        return best[n]


_PLAIN = Guesser()


def guess_cost(value: str) -> float:
    """The cost under the fixed words alone."""
    return _PLAIN.cost(value)


def scan(text: str | None, raw: bytes | None = None, guesser: Guesser = _PLAIN) -> list[tuple[int, int, str]]:
    """All spans of a text: (start, end, kind), in code points, by start and then kind."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    low, found = raw.lower(), []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if HEX_BYTES.search(raw):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        assigned = [(s, e) for s, e, k in found if k == "assign"]  # in order, and apart from each other
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            before = bisect_left(assigned, (end,)) - 1  # the last that begins before the value ends
            if (before < 0 or assigned[before][1] <= start) and guesser.cost(text[start:end]) >= GUESSES:
                found.append((start, end, "guess"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def learn(docs: DataFrame, text_col: str = "text", most: int = LEARNED) -> list[str]:
    """The ``most`` most frequent words of all texts, in lower case; counted with partial sums in every task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in pieces(batches, "text", BATCH_BYTES):
            for raw in batch.column(0).to_pylist():
                held.update(COUNTED.findall(raw.lower()) if raw else ())
                if len(held) > HELD_WORDS:
                    yield told()
                    held.clear()
        if held:
            yield told()

    counts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r.word for r in top.collect()]


_GUESSERS: dict[str, Guesser] = {}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learned: list[str] | None = None) -> DataFrame:
    """One row per document: id and ``spans``, an array of (start, end, kind).

    ``learned`` are words by rank; if not given, they are learned from ``docs``.
    """
    span = "array<struct<start: long, end: long, kind: string>>"
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col) if learned is None else list(learned))

    def run(batches, key=uuid.uuid4().hex):
        if key not in _GUESSERS:  # one per Python worker
            _GUESSERS.clear()
            _GUESSERS[key] = Guesser(sent.value)
        for batch in pieces(batches, "text", BATCH_BYTES):
            out = []
            for raw in batch.column(1).to_pylist():
                spans = scan(raw.decode("utf-8", "replace"), raw, _GUESSERS[key]) if raw else []
                out.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow)], ["id", "spans"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, spans {span}").withColumnRenamed("id", id_col)


def digest(spans: list[tuple[int, int, str]]) -> str:
    """The digest of the base spans, as the query gives it."""
    return hashlib.sha256(joined([s for s in spans if s[2] != "guess"]).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(said(F.filter("spans", lambda x: x["kind"] != "guess")), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
