"""SentencePiece merge-type encoding by a prefix table, and decoding.

For each prefix of a text the table stores one thing: the last token of that prefix's
encoding, which is unique. The tokens that end at a place are the matches of one
Aho-Corasick automaton over the vocabulary; of these exactly one is compatible with the
token stored where it starts. Two tokens are compatible if greedy merging leaves the
border between them: no pair of their right and left parts that exist side by side at
some moment makes a vocabulary piece that would be merged before they are used up.
Ids are recovered backwards from the last prefix.

If no piece has the blank mark after another character, no merge crosses from a
character to a following blank mark; then the table is made for each such part of a
text alone, and equal parts are remembered within a worker up to a fixed number.

Defined results: a null text is the empty text, which has no ids and decodes to the
empty text. A character outside the vocabulary becomes its byte pieces. Repeated rows are
encoded each on its own, and alike. Texts are encoded whole, however long, one after
another. An empty table gives an empty table. Columns whose names clash with the results
give way to them; all others stay.
"""

from __future__ import annotations

import gc
import hashlib
import re
import struct

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Piece kinds of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts of texts that a worker remembers; the memory is emptied when it is full.
REMEMBERED = 400_000
MOST_MODEL_BYTES = 64 << 20


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, i
        shift += 7


def _fields(data: bytes):
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(data, i)
        else:
            if kind == 2:
                size, i = _varint(data, i)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} in a tokenizer model")
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class Codec:
    """Vocabulary, merge trees and automaton of one model file."""

    def __init__(self, model: bytes):
        pieces, normal, trainer = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                x = dict(_fields(value))
                pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0], x.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only models of the merge type are supported")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0) or any(k in (USER, UNUSED) for _, _, k in pieces):
            raise ValueError("the model asks for a normaliser or piece kind that is not supported")
        self.prefix = bool(normal.get(3, 1))
        self.pieces = [p for p, _, _ in pieces]
        self.sizes = [len(p) for p in self.pieces]
        self.kinds = [k for _, _, k in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.plain = frozenset(self.ids.values())
        order = {s: r for r, s in enumerate(sorted({s for _, s, k in pieces if k == NORMAL}, reverse=True))}
        self.rank = [order.get(s, -1) if k == NORMAL else -1 for _, s, k in pieces]
        self.chars = {p for p in self.ids if len(p) == 1}
        if any(c not in self.chars for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.parts: dict[int, tuple[int, int]] = {}
        self.reached = {i for p, i in self.ids.items() if len(p) == 1 or self._tree(p, i)}
        for i in self.reached:  # a character has been there from the start
            if len(self.pieces[i]) == 1:
                self.rank[i] = -1
        if any(self.rank[c] > self.rank[i] for i, lr in self.parts.items() for c in lr):
            raise ValueError("a piece is made of pieces that are merged after it")
        self.automaton = ahocorasick.Automaton()
        for i in self.reached:
            self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i])))
        self.automaton.make_automaton()
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.joins: dict[int, bool] = {}
        self.known: dict[str, tuple[bytes, int, str]] = {}

    def _merge_rank(self, piece: str) -> int | None:
        i = self.ids.get(piece)
        return None if i is None else self.rank[i]

    def _tree(self, piece: str, i: int) -> bool:
        """Merges the characters greedily; notes the last merge, if the piece comes out whole."""
        part, last = list(piece), None
        while len(part) > 1:
            best, at = None, -1
            for k in range(len(part) - 1):
                r = self._merge_rank(part[k] + part[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return False
            last = part[at : at + 2]
            part[at : at + 2] = ["".join(last)]
        self.parts[i] = (self.ids[last[0]], self.ids[last[1]])
        return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether greedy merging of the two tokens' text gives the two tokens."""
        key = left * len(self.pieces) + right
        if (known := self.joins.get(key)) is None:
            if len(self.joins) > 4 * REMEMBERED:
                self.joins.clear()
            known = self.joins[key] = left == len(self.pieces) or self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # a and b stand side by side until the merges of rank a_end and b_end use them up; of equal
        # ranks the leftmost merge is first. Step by step the later of the two is taken apart.
        pieces, ids, rank = self.pieces, self.ids, self.rank
        a_end = b_end = 1 << 60
        while True:
            whole = ids.get(pieces[a] + pieces[b])
            if whole is not None and rank[whole] < a_end and rank[whole] <= b_end:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                a_end, a = rank[a], self.parts[a][1]
            else:
                b_end, b = rank[b], self.parts[b][0]

    def _run(self, text: str) -> list[int]:
        """Ids of a text of vocabulary characters only."""
        n, width = len(text), len(self.pieces)
        last = [-1] * (n + 1)  # by prefix length; the empty prefix has a token of its own that fits all
        last[0] = width
        known, compatible = self.joins.get, self.compatible
        for end, (i, size) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - size]
                fits = known(before * width + i)
                if compatible(before, i) if fits is None else fits:
                    last[end] = i
        out, sizes = [], self.sizes
        while n:
            i = last[n]
            out.append(i)
            n -= sizes[i]
        out.reverse()
        return out

    def _part(self, text: str) -> list[int]:
        if self.chars.issuperset(text):
            return self._run(text)
        out, at = [], 0
        for k, c in enumerate(text):
            if c not in self.chars:
                out += self._run(text[at:k])
                out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
                at = k + 1
        return out + self._run(text[at:])

    def _split(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return _PARTS.findall(text) if self.splits else [text]

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self._split(text) for i in self._part(part)]

    def _surface(self, ids: list[int]) -> str:
        if all(map(self.plain.__contains__, ids)):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, raw = [], bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(_lossy(bytes(raw)))
                raw.clear()
            if self.kinds[i] == NORMAL:
                out.append(self.pieces[i].replace(MARK, " "))
            elif self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
        if raw:
            out.append(_lossy(bytes(raw)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._surface(ids)
        return text[1:] if self.prefix and text[:1] == " " and ids and self.kinds[ids[0]] == NORMAL else text

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids joined by commas, and sha256 of the decoded text."""
        known, count, ids, surface = self.known, 0, [], []
        for part in self._split(text):
            if (got := known.get(part)) is None:
                each = self._part(part)
                got = (",".join(map(str, each)).encode(), len(each), self._surface(each))
                if len(part) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = got
            ids.append(got[0])
            count += got[1]
            surface.append(got[2])
        whole = "".join(surface)
        if self.prefix and whole[:1] == " ":  # the first piece begins with the mark put before the text
            whole = whole[1:]
        return count, hashlib.sha256(b",".join(ids)).hexdigest(), hashlib.sha256(whole.encode()).hexdigest()


_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _lossy(raw: bytes) -> str:
    """UTF-8, with one replacement character for each byte that is not part of a character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec per model in a process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def read_model(path: str) -> bytes:
    """The model file, read on the driver: executors need no copy in their own folders."""
    with open(path, "rb") as f:
        data = f.read(MOST_MODEL_BYTES + 1)
    if len(data) > MOST_MODEL_BYTES:
        raise ValueError("the tokenizer model is too large to broadcast")
    return data


def _fields_of(df: DataFrame, names: list[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema]


def with_digests(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text."""
    model = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    names = [c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    source = df.select(*names, F.col(text).cast("string").alias("__text"))

    def run(batches):
        use = codec(model.value)
        gc.disable()  # nothing here makes cycles, and looking for them walks through all that is remembered
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [use.digests(t.as_py()) for t in part.column("__text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())],
                    [*names, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return source.mapInArrow(run, ", ".join([*_fields_of(df, names), "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]))


def encoded(df: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of each text as an array of int."""
    model = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    names = [c for c in df.columns if c != out]

    def run(batches):
        use = codec(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([use.encode(t.as_py()) for t in part.column(text)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], ids], [*names, out])

    return df.select(*names).mapInArrow(run, ", ".join([*_fields_of(df, names), f"`{out}` array<int>"]))


def decoded(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids; a null array gives the empty text."""
    model = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    names = [c for c in df.columns if c != out]

    def run(batches):
        use = codec(model.value)
        for batch in batches:
            text = pa.array([use.decode(x.as_py() or []) for x in batch.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], text], [*names, out])

    return df.select(*names).mapInArrow(run, ", ".join([*_fields_of(df, names), f"`{out}` string"]))
