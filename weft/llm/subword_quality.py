"""Quality of whole texts by supervised subword embeddings.

A text is the bag of its words, word pairs (a word said twice running is one and the same
pair for all words) and the character n-grams of its words. Each hashes to one of ``BUCKETS`` learned vectors; the text's embedding is their mean, and a
softmax layer over it gives the class. Vectors and layer are learned together by
stochastic gradient descent in numpy, on a bounded sample of labelled texts.

For scoring, the layer is folded into the vectors: each bucket adds a number to the
logit, and a text's logit is the mean of its buckets' numbers. Whole texts are scored
in slices, without an object for a word.

Defined results: a null or empty text, or one of white space, has no features and gets
the bias' score, as every text does if there were no labels of both classes to learn from
(then 0.5). Repeated rows score alike. A text of any length is read whole, in memory that
follows the longest one. An empty table gives an empty table. Columns to keep whose names
clash with ``score`` or ``predicted`` give way to the results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrowtext import SPACE, buffers, find_words, hash_spans, mix, slices

BITS = 17
BUCKETS = 1 << BITS
WIDTH = 16
CHARS = (3, 4)

#: Bounds of the sample: texts of each class, bytes in all.
PER_CLASS = 1000
SAMPLE_BYTES = 5_000_000
PREDICTED_FROM = 0.7


def features(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, word pairs and each character order: buckets of all rows one after another, and row offsets."""
    buf, offs = buffers(col)
    starts, ends, first = find_words(buf, offs, SPACE)
    words = hash_spans(buf, starts, ends)
    shift = np.uint64(64 - BITS)
    out = [((mix(words + np.uint64(1)) >> shift).astype(np.int64), first)]
    if len(words):
        same = np.ones(len(words), bool)
        same[first[1:][first[1:] > 0] - 1] = False
        same[-1] = False
        at = np.flatnonzero(same)
        pairs = mix(words[at] * np.uint64(0x9E3779B97F4A7C15) + words[at + 1])
        pairs[words[at] == words[at + 1]] = 0  # a word that follows itself is one feature, whatever the word: stutter marks bad text in any language
        out.append(((pairs >> shift).astype(np.int64), np.searchsorted(at, first)))
    n = len(buf)
    inside = ~SPACE[buf]
    row_end = np.repeat(offs[1:], np.diff(offs))
    gap = np.flatnonzero(~inside)  # the next blank after each byte
    stop = np.minimum(np.concatenate((gap, [n]))[np.searchsorted(gap, np.arange(n))], row_end) if n else row_end
    padded = np.zeros(n + max(CHARS), np.uint64)
    padded[:n] = buf
    for k in CHARS:
        key = np.full(n, k, np.uint64)
        for j in range(k):
            key = key * np.uint64(257) + padded[j : j + n]
        ok = inside & (np.arange(n) + k <= stop)
        total = np.zeros(n + 1, np.int64)
        np.cumsum(ok, out=total[1:])
        out.append(((mix(key[ok]) >> shift).astype(np.int64), total[offs]))
    return out


@dataclass
class Model:
    weight: np.ndarray  # of each bucket
    bias: float

    def scores(self, col: pa.Array) -> np.ndarray:
        total, count = np.zeros(len(col)), np.zeros(len(col))
        for keys, offs in features(col):
            each = np.zeros(len(keys) + 1)
            np.cumsum(self.weight[keys], out=each[1:])
            total += each[offs[1:]] - each[offs[:-1]]
            count += np.diff(offs)
        logit = np.clip(total / np.maximum(count, 1) + self.bias, -40, 40)
        return 1 / (1 + np.exp(-logit))


def fit(texts: list[str], labels: list[int], epochs: int = 8, rate: float = 0.6, seed: int = 4) -> Model:
    y = np.asarray(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
    for part in slices(batch, "t"):
        got = features(part.column("t"))
        for r in range(part.num_rows):
            keys, n = np.unique(np.concatenate([k[o[r] : o[r + 1]] for k, o in got]), return_counts=True)
            bags.append((keys.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    layer[:, 1] = rng.normal(0, 0.5, WIDTH)
    layer[:, 0] = -layer[:, 1]
    balance = len(y) / (2 * np.bincount(y, minlength=2))
    # A mean over hundreds of features moves little with each of them: steps on vectors are longer by this.
    longer = 60.0
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for d in rng.permutation(len(y)):
            keys, share = bags[d]
            now = rate * (1 - done / steps)
            done += 1
            if not len(keys):
                continue
            mean = share @ vectors[keys]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1
            p *= balance[y[d]]
            back = layer @ p
            layer -= now * np.outer(mean, p)
            bias -= now * 0.1 * p
            vectors[keys] -= (now * longer) * share[:, None] * back
    fold = layer[:, 1] - layer[:, 0]
    return Model((vectors @ fold).astype(np.float32), float(bias[1] - bias[0]))


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``score`` (0 to 1) and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # one number a bucket: a fixed size
    names = [c for c in keep if c not in ("score", "predicted")]
    source = df.select(*names, F.col(text).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                got = shared.value.scores(part.column("__text"))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(got)], [*names, "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema]
    out = source.mapInArrow(run, ", ".join([*fields, "score double"]))
    return out.withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))
