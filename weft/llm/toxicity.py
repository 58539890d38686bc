"""Toxicity of whole texts: a bidirectional gated recurrent network with attention, over all windows.

A word enters as its hashed vector beside the mean vector of its character n-grams. Two
recurrent layers run over a window of ``LENGTH`` words, one from either end; attention
weighs the steps into one vector, and a logistic unit scores the window. Windows begin
every ``STRIDE`` words, so they overlap and cover the whole text.

A label belongs to a text and not to a window. Every window is trained on its text's
label, so that its logit says how much that window tells of the text. The text's score
is a logistic unit over all its windows' logits: the largest, the sum of what speaks for
the label, and the share of windows that do. One word that turns up by chance in a long
text thus counts for less than one in every window.

Training is numpy, by backpropagation through time, on a bounded sample of labelled
texts. A fifth of them, chosen by a hash of the text so that equal texts stay together,
is held back: the weights kept are those of the round with the least loss there, rounds
end when it has not fallen for ``PATIENCE`` of them, and the unit over windows is fitted
there. A fitted model can be written to bytes and read again.

Windows of a slice are run together, step by step, and a word's share of the inputs is
computed once per slice.

Defined results: a null or empty text, or one of white space and punctuation, has no
window and scores 0. Without labels of both classes every text scores 0. Repeated rows
score alike. A text of any length is read whole; memory follows the longest one. An empty
table gives an empty table. Columns to keep whose names clash with ``score`` or
``predicted`` give way to the results.
"""

from __future__ import annotations

import io
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrowtext import SPACE, buffers, find_words, hash_spans, mix, slices

LENGTH, STRIDE = 32, 24
WORD_BITS, CHAR_BITS = 14, 14
WIDTH, HIDDEN = 12, 12
CHARS = (3, 5, 7)

#: Bounds of the sample: texts by class, bytes in all.
TOXIC_TEXTS, CLEAN_TEXTS = 800, 2400
SAMPLE_BYTES = 8_000_000
PREDICTED_FROM = 0.5
#: Rounds without a fall of the loss on the texts held back, and rounds at most.
PATIENCE, MOST_ROUNDS = 3, 16
#: Windows of a text in a round, and the decay of vectors.
PICKED, DECAY = 4, 0.05

_drop = np.zeros(256, bool)
_drop[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


@dataclass
class Words:
    """The words of some texts: distinct ones with their buckets, and each text's sequence of them."""

    bucket: np.ndarray
    grams: np.ndarray
    gram_offs: np.ndarray
    sequence: np.ndarray
    first: np.ndarray

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows x LENGTH) numbers of distinct words, their count standing for none, and window offsets by text."""
        n = np.diff(self.first)
        count = np.where(n > 0, np.maximum(-(-(n - LENGTH) // STRIDE), 0) + 1, 0)
        offs = np.concatenate(([0], np.cumsum(count)))
        text = np.repeat(np.arange(len(n)), count)
        at = (np.arange(offs[-1]) - offs[:-1][text]) * STRIDE
        at = np.minimum(at, np.maximum(n[text] - LENGTH, 0)) + self.first[:-1][text]
        place = at[:, None] + np.arange(LENGTH)
        inside = place < self.first[1:][text][:, None]
        out = np.full(place.shape, len(self.bucket))
        out[inside] = self.sequence[place[inside]]
        return out, offs


def read(col: pa.Array) -> Words:
    buf, offs = buffers(pc.utf8_lower(col))
    keep = ~_drop[buf]
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    buf, offs = buf[keep], total[offs]
    starts, ends, first = find_words(buf, offs, SPACE)
    hashes, at, sequence = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
    lo, size = starts[at], ends[at] - starts[at]
    # The distinct words one after another, each between two marks.
    wide = size + 2
    begin = np.cumsum(wide) - wide
    flat = np.full(int(wide.sum()), 1, np.uint64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[inner + np.repeat(begin + 1, size)] = buf[inner + np.repeat(lo, size)]
    stop = np.repeat(begin + wide, wide)
    owner = np.repeat(np.arange(len(at)), wide)
    padded = np.concatenate((flat, np.zeros(max(CHARS), np.uint64)))
    keys, owners = [], []
    for k in CHARS:
        key = np.full(len(flat), k, np.uint64)
        for j in range(k):
            key = key * np.uint64(257) + padded[j : j + len(flat)]
        ok = np.arange(len(flat)) + k <= stop
        keys.append((mix(key[ok]) >> np.uint64(64 - CHAR_BITS)).astype(np.int32))
        owners.append(owner[ok])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    gram_offs = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(at)))))
    bucket = (mix(hashes + np.uint64(9)) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    return Words(bucket, np.concatenate(keys)[order], gram_offs, sequence, first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _sums(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sums of ``rows`` with equal keys below n."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        out[keys[at]] = np.add.reduceat(rows[order], at, axis=0)
    return out


def _summary(logit: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of each text with windows: the largest logit, the sum of those above 0 beside the number of windows, and their share."""
    z = np.clip(logit.astype(np.float64), -12, 12)
    at, n = offs[:-1], np.diff(offs)
    above = np.maximum(z, 0)
    return np.stack((np.maximum.reduceat(z, at), np.add.reduceat(above, at) / np.sqrt(n), np.add.reduceat((z > 0) * 1.0, at) / n), axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.003) -> np.ndarray:
    """Weights and bias of a logistic unit, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.concatenate(((x - mean) / scale, np.ones((len(x), 1))), axis=1)
    w = np.zeros(z.shape[1])
    keep = np.append(np.full(x.shape[1], ridge), 1e-6) * len(y)
    for _ in range(30):
        p = _sigmoid(np.clip(z @ w, -30, 30))
        curve = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(keep)
        w = w - np.linalg.solve(curve, z.T @ (p - y) + keep * w)
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


@dataclass
class Model:
    """``p``: the network; ``over``: the unit over a text's windows, its bias last."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    over: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0, 0.0]))

    @staticmethod
    def fresh(seed: int) -> Model:
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        p = {"word": normal(0.1, 1 << WORD_BITS, WIDTH), "char": normal(0.3, 1 << CHAR_BITS, WIDTH)}
        for side in ("f", "b"):
            p[f"w{side}"] = normal(0.35, 2 * WIDTH, 3 * HIDDEN)
            p[f"u{side}"] = normal(0.35, HIDDEN, 3 * HIDDEN)
            p[f"c{side}"] = np.zeros(3 * HIDDEN, np.float32)
            p[f"g{side}"] = np.zeros(HIDDEN, np.float32)
        p["att"], p["out"], p["bias"] = normal(0.3, 2 * HIDDEN), normal(0.5, 2 * HIDDEN), np.full(1, -1.0, np.float32)
        return Model(p)

    def inputs(self, w: Words, some: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Input vectors of some distinct words, with the n-grams that went into them."""
        size = np.diff(w.gram_offs)[some]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(w.gram_offs[:-1][some], size)
        keys = w.grams[at]
        chars = np.zeros((len(some), WIDTH), np.float32)
        full = size > 0
        if len(keys):
            chars[full] = np.add.reduceat(self.p["char"][keys], first[full], axis=0) / size[full][:, None]
        return np.concatenate((self.p["word"][w.bucket[some]], chars), axis=1), (keys, size)

    def run(self, x: np.ndarray, idx: np.ndarray, keep: bool = False):
        """Window logits. x: input vectors, one row for each number in ``idx``; len(x) stands for no word."""
        n, steps = idx.shape
        live = idx < len(x)
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        saved = {}
        for s, side in enumerate("fb"):
            u, g = self.p[f"u{side}"], self.p[f"g{side}"]
            ahead = np.concatenate((x @ self.p[f"w{side}"] + self.p[f"c{side}"], np.zeros((1, 3 * HIDDEN), np.float32)))
            h = np.zeros((n, HIDDEN), np.float32)
            trail = []
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                a, b = ahead[idx[:, t]], h @ u
                zr = _sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                part = b[:, 2 * HIDDEN :] + g
                new = np.tanh(a[:, 2 * HIDDEN :] + r * part)
                m = live[:, t, None]
                after = np.where(m, new + z * (h - new), h)
                if keep:
                    trail.append((t, h, z, r, part, new))
                h = after
                states[t, :, s * HIDDEN : (s + 1) * HIDDEN] = h
            saved[side] = trail
        e = np.where(live.T, states @ self.p["att"], np.float32(-1e9))
        e -= e.max(axis=0)
        alpha = np.exp(e)
        alpha /= alpha.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, alpha, pooled, saved, live)) if keep else logit

    def logits(self, w: Words, idx: np.ndarray) -> np.ndarray:
        x, _ = self.inputs(w, np.arange(len(w.bucket)))
        return np.concatenate([self.run(x, idx[k : k + 4096]) for k in range(0, len(idx), 4096)]) if len(idx) else np.zeros(0)

    def scores(self, col: pa.Array) -> np.ndarray:
        """Of each text of a slice."""
        w = read(col)
        out = np.zeros(len(col))
        if not self.p or not len(w.bucket):
            return out
        idx, offs = w.windows()
        full = np.diff(offs) > 0
        out[full] = _sigmoid(_summary(self.logits(w, idx), offs[np.concatenate((full, [True]))]) @ self.over[:-1] + self.over[-1])
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, over=self.over, **{f"p_{k}": v for k, v in self.p.items()})
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as got:
            return Model({k[2:]: got[k] for k in got.files if k.startswith("p_")}, got["over"])

    def gradients(self, w: Words, idx: np.ndarray, y: np.ndarray, weight: np.ndarray, drop: np.random.Generator | None = None) -> dict[str, np.ndarray]:
        """Of the loss of texts with some windows each: ``idx`` has the windows of one text after another, as many for every text.

        A text's logit is the logarithm of the mean of its windows' odds, so that the windows that speak for the label
        learn most. With ``drop`` half the words go without their own vector, so that characters are learned from, too.
        """
        some, local = np.unique(idx, return_inverse=True)
        local = local.reshape(idx.shape)
        if some[-1] == len(w.bucket):
            some = some[:-1]
        x, (keys, size) = self.inputs(w, some)
        kept = (drop.random((len(some), 1)) < 0.5).astype(x.dtype) if drop else np.ones((len(some), 1), x.dtype)
        x[:, :WIDTH] *= kept
        logit, (states, alpha, pooled, saved, live) = self.run(x, local, keep=True)
        p, n = self.p, len(idx)
        z = logit.reshape(len(y), -1).astype(np.float64)
        top = z.max(axis=1, keepdims=True)
        odds = np.exp(z - top)
        whole = np.log(odds.mean(axis=1)) + top[:, 0]
        d = (((_sigmoid(whole) - y) * weight)[:, None] * (odds / odds.sum(axis=1, keepdims=True))).ravel().astype(np.float32) / len(y)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["out"]
        da = np.einsum("tnh,nh->tn", states, dp)
        de = alpha * (da - (alpha * da).sum(axis=0))
        g["att"] = np.einsum("tn,tnh->h", de, states)
        ds = alpha[:, :, None] * dp + de[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        for s, side in enumerate("fb"):
            u, dh = p[f"u{side}"], np.zeros((n, HIDDEN), np.float32)
            du, flow = np.zeros_like(u), np.zeros((idx.shape[1], n, 3 * HIDDEN), np.float32)
            dg = np.zeros(HIDDEN, np.float32)
            for t, h, z, r, part, new in reversed(saved[side]):
                dh = dh + ds[t, :, s * HIDDEN : (s + 1) * HIDDEN]
                m = live[:, t, None]
                now = dh * m
                dn = now * (1 - z) * (1 - new * new)
                dz = now * (h - new) * z * (1 - z)
                dr = dn * part * r * (1 - r)
                dpart = dn * r
                through = np.concatenate((dz, dr, dpart), axis=1)
                du += h.T @ through
                dg += dpart.sum(axis=0)
                flow[t] = np.concatenate((dz, dr, dn), axis=1)
                dh = now * z + dh * ~m + through @ u.T
            dahead = _sums(local.T.ravel(), flow.reshape(-1, 3 * HIDDEN), len(x) + 1)[:-1]
            g[f"u{side}"], g[f"g{side}"] = du, dg
            g[f"w{side}"], g[f"c{side}"] = x.T @ dahead, dahead.sum(axis=0)
            dx += dahead @ p[f"w{side}"].T
        g["word"] = _sums(w.bucket[some], dx[:, :WIDTH] * kept, len(p["word"]))
        g["char"] = _sums(keys, np.repeat(dx[:, WIDTH:] / np.maximum(size, 1)[:, None], size, axis=0), len(p["char"]))
        return g


def fit(texts: list[str], labels: list[int], batch: int = 64, rate: float = 0.01, rounds: int = MOST_ROUNDS, seed: int = 6) -> Model:
    y = np.asarray(labels, np.float32)
    w = read(pa.array(texts, pa.string()))
    idx, offs = w.windows()
    full = np.diff(offs) > 0
    back = np.array([zlib.crc32(t.encode()) % 5 == 0 for t in texts], bool)
    if len(set(y[full & back].tolist())) < 2:  # too few texts to hold some back
        back = full
    train = np.flatnonzero(full & ~back) if (full & ~back).any() else np.flatnonzero(full)
    if len(set(y[train].tolist())) < 2:
        return Model()
    held = np.flatnonzero(full & back)
    rows = np.concatenate([np.arange(offs[t], offs[t + 1]) for t in held])
    held_offs = np.concatenate(([0], np.cumsum(np.diff(offs)[held])))
    weight = np.zeros(len(y))
    weight[train] = _balance(y[train])
    model, rng = Model.fresh(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    best, least, since, step = Model(), np.inf, 0, 0
    for k in range(rounds):
        # The same number of windows of every text in each round, so that long texts don't outweigh others; short samples go round more often.
        owner = rng.permutation(np.tile(train, max(1, -(-32 * batch // len(train)))))
        chosen = offs[owner, None] + (rng.random((len(owner), PICKED)) * (offs[owner + 1] - offs[owner])[:, None]).astype(np.int64)
        for lo in range(0, len(owner), batch):
            part = slice(lo, lo + batch)
            g = model.gradients(w, idx[chosen[part].ravel()], y[owner[part]], weight[owner[part]], rng)
            step += 1
            for name, v in g.items():
                first[name] += 0.1 * (v - first[name])
                second[name] += 0.01 * (v * v - second[name])
                model.p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
                if name in ("word", "char"):
                    model.p[name] *= 1 - DECAY * rate
        of = _summary(model.logits(w, idx[rows]), held_offs)
        model.over = _logistic(of, y[held])
        z = of @ model.over[:-1] + model.over[-1]
        loss = float((np.logaddexp(0, z) - y[held] * z).mean())
        since += 1
        if loss < least:
            best, least, since = Model({name: v.copy() for name, v in model.p.items()}, model.over), loss, 0
        if since >= PATIENCE:
            break
    return best


def _balance(y: np.ndarray) -> np.ndarray:
    """Weights that make either class count the same."""
    return (len(y) / (2 * np.maximum(np.bincount(y.astype(int), minlength=2), 1)))[y.astype(int)]


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``score`` (0 to 1) and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size
    names = [c for c in keep if c not in ("score", "predicted")]
    source = df.select(*names, F.col(text).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                got = shared.value.scores(part.column("__text"))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(got)], [*names, "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema]
    out = source.mapInArrow(run, ", ".join([*fields, "score double"]))
    return out.withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))
