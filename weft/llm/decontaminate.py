"""Benchmark passages in whole documents, by one Aho-Corasick automaton over words.

Texts are normalised alike: ASCII capitals become small, and words are runs of ASCII
letters, digits and characters from U+0080 up. Every run of ``n`` words of a benchmark
text is a pattern; a shorter text, if it has a word, is one pattern as a whole. The
automaton takes word numbers, not characters, so one pass over a document's words
finds all patterns, and a word's number leads back to its bytes in the original.

Patterns are told apart and given their items in Spark, so that no benchmark text comes to
the driver as a whole. They are broadcast in parts of about ``MOST_PATTERNS``: with one
part, as a rule, documents are scanned once; with more, there is one automaton and one
scan for each, what was hit is written with the documents in between, and a worker builds
each automaton once. The result is the same.

Defined results: a null or empty document has no words and no hits; a null or empty
benchmark text has no pattern; items that are repeated under one id count once; an item
without an id makes its words count as hit, but is no item that could be listed. Repeated
documents are scanned each on its own. Texts are read whole, however long, one at a time
beyond 2 MB. An empty table gives an empty table, and an empty benchmark no hits. Columns to
keep whose names clash with the results give way to them.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrowtext import buffers, cut, find_words, slices

WINDOW = 10
MOST_PATTERNS = 400_000

_fold = np.zeros(256, np.uint8)
_fold[:] = 0x20
for _lo, _hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _fold[_lo:_hi] = np.arange(_lo, _hi)
_fold[0x41:0x5B] = np.arange(0x61, 0x7B)
_TABLE = _fold.tobytes()
_apart = np.zeros(256, bool)
_apart[0x20] = True

#: A word's number as a character: the code points above the surrogates, then those below.
_FIRST, _ABOVE = 0xE000, 0x110000 - 0xE000
MOST_WORDS = _ABOVE + 0xD000


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_TABLE).split()


def windows(text: str | bytes | None, n: int = WINDOW) -> list[bytes]:
    """The patterns of a benchmark text, their words joined by a blank."""
    w = words(text)
    return [b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []


class Automaton:
    """Patterns with their items. ``scan`` gives hit words and the items found."""

    def __init__(self, patterns: list[tuple[bytes, list[str]]]):
        self.number: dict[bytes, str] = {}
        self.owners = [owners for _, owners in patterns]
        self.find = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        self.shortest = 1 << 30
        for k, (pattern, _) in enumerate(patterns):
            w = pattern.split(b" ")
            self.shortest = min(self.shortest, len(w))
            self.find.add_word("".join([self.number.get(x) or self._new(x) for x in w]), (len(w), k))
        self.any = bool(patterns)
        if self.any:
            self.find.make_automaton()

    @staticmethod
    def of_items(items: list[tuple[str | None, str | None]], n: int = WINDOW) -> Automaton:
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for x in windows(text, n):
                owners.setdefault(x, set()).update(() if item is None else (item,))
        return Automaton([(x, sorted(o)) for x, o in owners.items()])

    def _new(self, word: bytes) -> str:
        k = len(self.number)
        if k >= MOST_WORDS:
            raise ValueError("the automaton has too many different words")
        self.number[word] = chr(_FIRST + k if k < _ABOVE else k - _ABOVE + 1)
        return self.number[word]

    def scan(self, w: list[bytes], hit: np.ndarray, items: set[str]) -> None:
        """``hit`` is counted up at the start of each match and down after its end."""
        number = self.number.get
        letters = [number(x, "\0") for x in w]
        known = np.array([x != "\0" for x in letters])
        for lo, hi in _runs(known, self.shortest):
            for end, (size, k) in self.find.iter("".join(letters[lo:hi])):
                hit[lo + end + 1 - size] += 1
                hit[lo + end + 1] -= 1
                items.update(self.owners[k])


def _runs(known: np.ndarray, least: int):
    """Starts and ends of the runs of known words that can hold a pattern."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], known, [0])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return zip(starts[long].tolist(), ends[long].tolist(), strict=True)


def examine(automaton: Automaton, texts: pa.Array) -> list[tuple[int, np.ndarray, set[str]]]:
    """Of each text: number of words, hit words, items."""
    out = []
    for raw in texts.cast(pa.binary()):
        w = words(raw.as_py())
        hit, items = np.zeros(len(w) + 1, np.int64), set()
        if automaton.any and w:
            automaton.scan(w, hit, items)
        out.append((len(w), np.cumsum(hit)[:-1] > 0, items))
    return out


_built: dict[str, Automaton] = {}


def _use(part: tuple[str, object]) -> Automaton:
    """The automaton of a part, kept by its patterns' digest while a worker uses it; one at a time."""
    if part[0] not in _built:
        _built.clear()
        _built[part[0]] = Automaton(part[1].value)
    return _built[part[0]]


def pattern_table(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """(pattern, owners): each pattern once, with the sorted ids of its items as texts."""
    source = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                each = [windows(x.as_py(), n) for x in part.column("t").cast(pa.binary())]
                rows = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("i").take(rows), pa.array([p for x in each for p in x], pa.binary())], ["i", "pattern"])

    return source.mapInArrow(run, "i string, pattern binary").groupBy("pattern").agg(F.array_sort(F.collect_set("i")).alias("owners"))


def parts_of(patterns: DataFrame, most: int = MOST_PATTERNS) -> list[tuple[str, object]]:
    """(digest, broadcast) of patterns with their items, each with about ``most`` of them."""
    sc = patterns.sparkSession.sparkContext
    patterns = cut(patterns)
    parts, out = max(1, -(-patterns.count() // most)), []
    for k in range(parts):
        some = patterns if parts == 1 else patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k)
        rows = sorted((bytes(r.pattern), list(r.owners)) for r in some.collect())  # patterns differ, so a hash deals them evenly
        out.append((hashlib.sha256(repr(rows).encode()).hexdigest(), sc.broadcast(rows)))
    return out


def find_passages(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", n: int = WINDOW, keep: tuple[str, ...] | None = None, most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """``keep`` columns (all by default), ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    names = [c for c in (keep or df.columns) if c not in added]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema]
    parts = parts_of(pattern_table(benchmark, item, "text", n), most_patterns)
    rows = df.select(*names, F.col(text).cast("string").alias("__text"))
    if len(parts) > 1:
        rows = rows.withColumns({"__hit": F.lit(b""), "__items": F.array().cast("array<string>")})

    def found(part, shared):
        """Of each text of a slice: number of words, hit words and items, with those found before."""
        got = examine(_use(shared), part.column("__text"))
        if len(parts) == 1:
            return got
        before = zip(part.column("__hit"), part.column("__items"), strict=True)
        return [(w, hit | np.unpackbits(np.frombuffer(b.as_py().ljust(-(-w // 8), b"\0"), np.uint8), count=w).astype(bool), items.union(i.as_py())) for (w, hit, items), (b, i) in zip(got, before, strict=True)]

    def carry(shared):
        def run(batches):
            for batch in batches:
                for part in slices(batch, "__text"):
                    got = found(part, shared)
                    hits = pa.array([np.packbits(hit).tobytes() for _, hit, _ in got], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in (*names, "__text")], hits, pa.array([sorted(i) for _, _, i in got], pa.list_(pa.string()))], [*names, "__text", "__hit", "__items"])

        return run

    for shared in parts[:-1]:
        rows = cut(rows.mapInArrow(carry(shared), ", ".join([*fields, "__text string", "__hit binary", "__items array<string>"])))
    last = parts[-1]

    def finish(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                got = found(part, last)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names]
                    + [
                        pa.array([w for w, _, _ in got], pa.int64()),
                        pa.array([int(hit.sum()) for _, hit, _ in got], pa.int64()),
                        pa.array([len(items) for _, _, items in got], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() for _, _, items in got], pa.string()),
                        pa.array([bool(hit.any()) for _, hit, _ in got], pa.bool_()),
                    ],
                    [*names, *added],
                )

    return rows.mapInArrow(finish, ", ".join([*fields, "n_words long", "n_hit long", "n_items long", "items_sha256 string", "contaminated boolean"]))


def spans(text: str, automaton: Automaton) -> list[tuple[int, int]]:
    """Start and end characters, in the original text, of the runs of hit words."""
    col = pa.array([text], pa.string())
    (_, hit, _), (buf, offs) = examine(automaton, col)[0], buffers(col)
    starts, ends, _ = find_words(_fold[buf], offs, _apart)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8)))
    at = np.cumsum(np.concatenate(([0], (buf & 0xC0) != 0x80)))
    return [(int(at[starts[a]]), int(at[ends[b - 1]])) for a, b in zip(edge[::2], edge[1::2], strict=True)]
