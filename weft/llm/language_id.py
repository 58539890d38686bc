"""Language of whole texts by error-correcting output codes.

Each language gets a codeword. One binary classifier per code bit, logistic over
hashed character n-grams, predicts that bit; a text's language is the codeword with
the least total logistic loss, so that a few wrong bits are corrected. The margin to
the second codeword flags ambiguous texts.

Up to seven languages the exhaustive code is used (all splits into two groups);
beyond, the best of a fixed number of random codes by smallest distance.

Defined results: a text that is null or has no letter gets ``und`` with score 0, as
does every text where no labelled text was given to learn from. With one language in
the labels, that language is predicted with score 1. Repeated rows are predicted alike.
Texts are read whole, however long, one at a time beyond 1 MB. An empty table gives an
empty table. Columns whose names clash with ``lang_pred``, ``score``, ``margin`` or
``ambiguous`` give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrowtext import SPACE, buffers, by_row, mix, slices

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BITS = 16

#: Bounds of what is learned from: texts of each language, and bytes of all of them.
TEXTS_PER_LANGUAGE = 500
SAMPLE_BYTES = 8_000_000
#: Losses are divided by this before they become a score; it changes no decision.
TEMPERATURE = 20.0
#: More different labels than this are an error; there is no language that is left out.
MOST_LANGUAGES = 1000


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        width = 2 ** (n - 1) - 1
        out = np.ones((n, width), np.int8)
        for row in range(1, n):
            run = 2 ** (n - 1 - row)
            out[row] = np.where((np.arange(width) // run) % 2 == 0, -1, 1)
        return out
    width, rng, best, far = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None, -1.0
    for _ in range(200 if n <= 64 else 5):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        same = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(same, -width)
        if (least := (width - same.max()) / 2) > far:
            best, far = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray

    def losses(self, logits: np.ndarray) -> np.ndarray:
        """Loss of each codeword: texts x languages."""
        yes, no = np.logaddexp(0, -logits), np.logaddexp(0, logits)
        is_yes = (self.code > 0).astype(np.float64)
        return yes @ is_yes.T + no @ (1 - is_yes).T

    def decode(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share in (0, 1], and the loss margin to the second."""
        loss = self.losses(logits)
        best = loss.argmin(axis=1)
        low = loss.min(axis=1)
        share = 1 / np.exp((low[:, None] - loss) / TEMPERATURE).sum(axis=1)
        if loss.shape[1] == 1:
            return best, np.ones(len(best)), np.full(len(best), np.inf)
        second = np.partition(loss, 1, axis=1)[:, 1]
        return best, share, second - low


def _clean(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with ASCII letters and bytes of other characters kept, and a blank for the rest."""
    buf, offs = buffers(pc.utf8_lower(col))
    return _LETTERS[buf], offs


_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[i for i in range(128) if not 97 <= i <= 122]] = 0x20


def grams(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashed n-gram buckets of all rows one after another, and the number in each row.

    N-grams run over bytes and start at a non-blank; those that cross a row's end are cut out.
    """
    n = len(buf)
    row_end = np.repeat(offs[1:], np.diff(offs))
    live = ~SPACE[buf]
    if n > 1:
        live[1:] |= live[:-1] & (np.arange(1, n) < row_end[:-1])  # one blank after a word counts as its end
    padded = np.zeros(n + max(ORDERS), np.uint64)
    padded[:n] = buf
    for k in ORDERS:
        key = np.full(n, k, np.uint64)
        for j in range(k):
            key = key * np.uint64(257) + padded[j : j + n]
        ok = live & (np.arange(n) + k <= row_end)
        yield (mix(key[ok]) >> np.uint64(64 - BITS)).astype(np.int64), by_row(ok, offs)


def frequencies(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, bucket, share of the row's n-grams)."""
    out = ([], [], [])
    at = 0
    batch = pa.RecordBatch.from_arrays([col], ["t"])
    for part in slices(batch, "t"):
        buf, offs = _clean(part.column("t"))
        both = [np.repeat(np.arange(part.num_rows), n) << BITS | keys for keys, n in grams(buf, offs)]
        both, n = np.unique(np.concatenate(both), return_counts=True)
        r = both >> BITS
        total = np.bincount(r, weights=n, minlength=part.num_rows)
        for x, y in zip(out, (r + at, both & (2**BITS - 1), n / np.maximum(total[r], 1)), strict=True):
            x.append(y)
        at += part.num_rows
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def fit(texts: list[str], labels: list[str], epochs: int = 40, seed: int = 3) -> Model | None:
    """Learns all bit classifiers together by full-batch accelerated gradient steps; None without texts."""
    known = sorted(set(labels))
    if not known:
        return None
    code = codewords(len(known))
    if len(known) == 1:
        return Model(known, code, np.zeros((2**BITS, 1), np.float32), np.zeros(1))
    r, k, v = frequencies(pa.array(texts, pa.string()))
    r, k = r.astype(np.int64), k.astype(np.int64)
    used, k = np.unique(k, return_inverse=True)
    rare = np.bincount(k)  # scales a bucket by how common it is
    scale = 1 / np.sqrt(np.bincount(k, weights=v * v, minlength=len(used)) / len(texts) + 1e-6 + 1e-5 / np.maximum(rare, 1))
    v = v * scale[k]
    y = np.searchsorted(known, labels)
    target = code[y].astype(np.float64)
    share = np.bincount(y, minlength=len(known))
    each = (len(y) / (len(known) * share))[y]
    each = (each / each.sum())[:, None]
    w, b = np.zeros((len(used), code.shape[1])), np.zeros(code.shape[1])
    m, mb, s, sb = np.zeros_like(w), np.zeros_like(b), np.zeros_like(w), np.zeros_like(b)
    for t in range(1, epochs + 1):
        z = np.stack([np.bincount(r, weights=v * w[k, j], minlength=len(y)) for j in range(w.shape[1])], axis=1) + b
        g = -target / (1 + np.exp(np.clip(target * z, -50, 50))) * each
        gw = np.stack([np.bincount(k, weights=v * g[r, j], minlength=len(used)) for j in range(w.shape[1])], axis=1) + 1e-6 * w
        for p, q, mm, ss in ((w, gw, m, s), (b, g.sum(axis=0), mb, sb)):
            mm *= 0.9
            mm += 0.1 * q
            ss *= 0.99
            ss += 0.01 * q * q
            p -= 0.1 * (mm / (1 - 0.9**t)) / (np.sqrt(ss / (1 - 0.99**t)) + 1e-9)
    full = np.zeros((2**BITS, w.shape[1]), np.float32)
    full[used] = w * scale[:, None]
    return Model(known, code, full, b)


def learn(df: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", per_language: int = TEXTS_PER_LANGUAGE, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fits on a bounded sample of the labelled rows: of each language the rows lowest by a hash of ``order``.

    What reaches the driver is at most about ``per_language`` texts a language and ``most_bytes`` of text.
    """
    # The hash must not see the text, so that all copies of a text don't come or go together.
    seen = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("t"), F.col(lang).alias("l"), F.pmod(F.xxhash64(F.col(order).cast("string"), F.lit(11)), F.lit(1 << 40)).alias("h")
    )
    counts = seen.groupBy("l").agg(F.count("*").alias("n"), F.avg(F.octet_length("t")).alias("b")).limit(MOST_LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels: these are no languages")
    share = most_bytes / max(1.0, sum(min(per_language, c.n) * c.b for c in counts))
    limits = {c.l: int(min(1.0, min(1.0, share) * per_language / c.n) * (1 << 40)) for c in counts}
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("l")]
    rows = seen.where(F.col("h") < limit).select("t", "l", "h").collect()
    rows.sort(key=lambda x: (x.h, x.l, x.t))
    total, keep = 0, []
    for x in rows:  # the expected size is the bound; this holds it in any case
        total += len(x.t)
        if total > 2 * most_bytes:
            break
        keep.append(x)
    return fit([x.t for x in keep], [x.l for x in keep])


def scores(model: Model, col: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    """Language (``und`` without letters), score and margin of each text of a slice."""
    buf, offs = _clean(col)
    n, bits = len(col), model.weights.shape[1]
    sums, count = np.zeros((n, bits)), np.zeros(n)
    if len(buf):
        for keys, each in grams(buf, offs):
            count += each
            full = each > 0
            if full.any():
                sums[full] += np.add.reduceat(model.weights[keys], (np.cumsum(each) - each)[full], axis=0)
    best, share, margin = model.decode(sums / np.maximum(count, 1)[:, None] + model.bias)
    letters = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    lang = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(best, letters, strict=True)]
    return lang, np.where(letters, share, 0.0), np.where(letters, margin, 0.0)


def identify(df: DataFrame, model: Model | None, text: str = "text", ambiguous_below: float = 2.0) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``ambiguous`` (margin below the given loss)."""
    added = ("lang_pred", "score", "margin", "ambiguous")
    names = [c for c in df.columns if c not in added]
    if model is None:
        return df.select(*names).withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "margin": F.lit(0.0), "ambiguous": F.lit(True)})
    shared = df.sparkSession.sparkContext.broadcast(model)  # buckets x bits: a fixed size

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                lang, share, margin = scores(shared.value, part.column(text))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [pa.array(lang, pa.string()), pa.array(share), pa.array(margin)], [*names, "lang_pred", "score", "margin"]
                )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema]
    out = df.select(*names).mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "margin double"]))
    return out.withColumn("ambiguous", F.col("margin") < ambiguous_below)
