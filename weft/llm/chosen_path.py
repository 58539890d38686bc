"""Self-join of documents on the Jaccard similarity of their word n-grams, by chosen paths.

Documents with the same set of n-grams are one class, and only classes are joined. A
run splits the classes recursively: each node of the recursion samples one coordinate
of ``T`` min-wise hashes, and classes that share the token with the least hash there go
on together. A class thus follows a path of shared sampled tokens, and two classes of
similarity s stay together at each step with probability s. Buckets of at most ``SMALL``
classes are compared outright; larger ones are split again, down to ``DEPTH`` steps. What
is still large then is compared outright too, block by block; blocks are bounded by their
members and by the n-grams of these, so that long texts make more of them, and a
comparison holds two blocks, or two texts. Runs are independent, and
there are as many as the target recall needs for a pair just at the threshold, in the
deepest buckets; most pairs stop earlier and are safer.

In a bucket a sketch (one byte of each min-wise hash) and the set sizes rule out pairs
that can't reach the threshold, with six standard deviations to spare. For the rest the
exact sets are fetched and intersected. A pair that meets in several buckets counts in
the first only. Pairs are never rows: each bucket gives one row per member, with its
number of links and the least member it hangs together with there.

Words are runs of non-blank characters, in lower case and without ASCII punctuation; a
text of fewer than n words, but not none, is one n-gram.

Defined results: a null text, or one without words, has no set, no links and is a class
of its own. Documents with a null id take part; a class's id is its least id that is not
null. Repeated rows are copies of one another. Texts are read whole, however long, one at
a time beyond 1 MB. An empty table gives an empty table. ``join_ngrams`` returns its own
columns only, and ``keep_one`` all columns of the table, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrowtext import SPACE, buffers, cut, find_words, hash_spans, mix, slices, windows
from weft.llm.components import components
from weft.llm.skew import join_groups

N = 5
THRESHOLD = 0.8
RECALL = 0.9998
T = 128
DEPTH = 3
SMALL = 256
#: Members of a block, and n-grams of all its members.
BLOCK, BLOCK_GRAMS = 256, 2_000_000

_punctuation = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_multipliers = np.random.default_rng(99).integers(1, 2**63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_skip = np.zeros(256, bool)
_skip[list(_punctuation)] = True


def runs_for(recall: float, threshold: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold is together in a deepest bucket of one, with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of a slice."""
    buf, offs = buffers(pc.utf8_lower(texts))
    keep = ~_skip[buf]
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    buf, offs = buf[keep], total[offs]
    starts, ends, first = find_words(buf, offs, SPACE)
    hashes = hash_spans(buf, starts, ends)
    keys, _, woffs = windows(hashes, first, n)
    out = []
    for r in range(len(texts)):
        lo, hi = first[r], first[r + 1]
        if hi - lo >= n:
            s = np.sort(keys[woffs[r] : woffs[r + 1]])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif hi > lo:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[lo:hi].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _paths(low: np.ndarray, runs: int) -> np.ndarray:
    """Keys of the nodes on each class's path: classes x runs x depth."""
    out = np.zeros((len(low), runs, DEPTH), np.uint64)
    rows = np.arange(len(low))
    order = np.random.default_rng(5).permutation(T)
    for r in range(runs):
        at = np.full(len(low), order[r % T])
        key = np.full(len(low), mix(np.array([r + 1], np.uint64))[0])
        for d in range(DEPTH):
            key = mix(key ^ mix(low[rows, at] + at.astype(np.uint64)))
            out[:, r, d] = key
            at = (mix(key + np.uint64(d + 1)) % np.uint64(T)).astype(np.int64)  # the next coordinate depends on the path
    return out


def _keyed(df: DataFrame, text: str, key: str) -> DataFrame:
    x = F.col(text).cast("string")
    return df.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(x, F.lit(""))).alias("t"), x.alias("x"))


def _sketched(source: DataFrame, n: int, runs: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "x", 1 << 20):
                sets = ngram_sets(part.column("x"), n)
                size = np.array([len(s) for s in sets])
                full = size > 0
                low = np.zeros((len(sets), T), np.uint64)
                if full.any():
                    every = np.concatenate(sets)
                    first = (np.cumsum(size) - size)[full]
                    for j in range(T):
                        low[full, j] = np.minimum.reduceat(every * _multipliers[j], first)
                sketch = ((low >> np.uint64(20)) & np.uint64(255)).astype(np.uint8)
                paths = _paths(low, runs).reshape(len(sets), -1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("k"),
                        part.column("t"),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array(size, pa.int32()),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, paths.size + 1, paths.shape[1], dtype=np.int32), paths.ravel()),
                    ],
                    ["k", "t", "f", "n", "sketch", "paths"],
                )

    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, t long, f binary, n int, sketch binary, paths array<long>")


def _groups(batches, name: str):
    """Batches that hold whole groups of equal ``name``; rows come sorted by it. With each the group offsets."""
    rest = None
    for batch in batches:
        tab = pa.Table.from_batches([batch])
        rest = tab if rest is None else pa.concat_tables([rest, tab])
        if not rest.num_rows:
            continue
        col = rest.column(name).to_pylist()
        cut_at = len(col)
        while cut_at and col[cut_at - 1] == col[-1]:
            cut_at -= 1
        if cut_at:
            yield rest.slice(0, cut_at).combine_chunks(), _offsets(col[:cut_at])
            rest = rest.slice(cut_at)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), _offsets(rest.column(name).to_pylist())


def _offsets(col: list) -> list[int]:
    return [0, *[i for i in range(1, len(col)) if col[i] != col[i - 1]], len(col)]


def _pairs(offs: list[int]):
    """All pairs within groups, some thousand at a time."""
    lefts, rights, n = [], [], 0
    for lo, hi in zip(offs[:-1], offs[1:], strict=True):
        if hi - lo < 2:
            continue
        i, j = np.triu_indices(hi - lo, 1)
        lefts.append(i + lo)
        rights.append(j + lo)
        n += len(i)
        if n > 20_000:
            yield np.concatenate(lefts), np.concatenate(rights)
            lefts, rights, n = [], [], 0
    if lefts:
        yield np.concatenate(lefts), np.concatenate(rights)


def _first_meeting(terms: np.ndarray, bucket: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the bucket is the first that the two rows share. ``terms``: rows x runs, 0 for none."""
    same = (terms[i] == terms[j]) & (terms[i] != 0)
    return terms[i, same.argmax(axis=1)] == bucket[i]


def _matrix(tab: pa.Table, name: str, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(tab.column(name).to_pylist()), dtype).reshape(-1, width)


def _in_blocks(tab: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In a unit of two blocks only pairs across them count; each block's own pairs have a unit of their own."""
    a, b = (tab.column(c).to_numpy() for c in ("lo", "hi"))
    own = tab.column("own").to_numpy()
    return (a[i] == b[i]) | (own[i] != own[j])


def _buckets(classes: DataFrame, runs: int) -> DataFrame:
    """(f, run, bucket, size, grams) of the buckets where a class ends, those with two members or more."""
    step = classes.select("f", "n", F.posexplode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run", "r"), "paths")
    rows = step.select("f", "n", "run", *[F.element_at("paths", (F.col("r") * DEPTH + d + 1).cast("int")).alias(f"p{d}") for d in range(DEPTH)])
    ended = []
    for d in range(DEPTH):
        counts = cut(rows.groupBy(f"p{d}").agg(F.count("*").alias("size"), F.sum("n").alias("grams")).where("size > 1"))
        rows = join_groups(rows, counts, [f"p{d}"], "size", ["f"])
        if d + 1 == DEPTH:
            ended.append(rows.select("f", "run", F.col(f"p{d}").alias("bucket"), "size", "grams"))
            break
        rows = cut(rows)
        ended.append(rows.where(F.col("size") <= SMALL).select("f", "run", F.col(f"p{d}").alias("bucket"), "size", "grams"))
        rows = rows.where(F.col("size") > SMALL).drop("size", "grams")
    out = ended[0]
    for x in ended[1:]:
        out = out.unionByName(x)
    return out


def _units(rows: DataFrame) -> DataFrame:
    """One row per comparison unit: the bucket, or two blocks of it if it is large. A unit has at most about 2 * BLOCK members."""
    blocks = F.greatest(F.when(F.col("size") <= SMALL, F.lit(1)).otherwise(F.ceil(F.col("size") / F.lit(BLOCK))), F.least(F.ceil(F.col("grams") / F.lit(BLOCK_GRAMS)), "size")).cast("int")
    own = F.pmod(F.xxhash64("f", "bucket"), F.col("blocks")).cast("int")
    each = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return each.withColumns({"lo": lo, "hi": hi, "unit": F.xxhash64("bucket", lo, hi)}).drop("blocks", "other")


def _together(units: DataFrame) -> DataFrame:
    """Rows of a unit in one partition, one after another."""
    return units.repartition(F.col("unit")).sortWithinPartitions("unit")


def linked(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links): documents ``k, t, f``; classes ``f, size, first``; links ``f, n_links, root``, one row
    per class and unit where it has a link."""
    runs = runs_for(recall, threshold)
    source = _keyed(df, text, key)
    rows = cut(_sketched(source, n, runs))
    documents = rows.select("k", "t", "f")
    classes = rows.where(F.col("f").isNotNull()).groupBy("f").agg(
        F.count("*").alias("size"), F.min(F.struct(F.col("k").isNull().alias("dn"), "k", "t")).alias("first"), F.min(F.struct("n", "sketch", "paths")).alias("s")
    )
    classes = cut(classes.select("f", "size", "first", "s.n", "s.sketch", "s.paths"))
    buckets = cut(_buckets(classes, runs))
    terms = buckets.groupBy("f").agg(F.map_from_entries(F.collect_list(F.struct("run", "bucket"))).alias("m"), F.collect_set(F.struct("bucket", "size", "grams")).alias("ends"))
    every = F.array(*[F.coalesce(F.element_at("m", F.lit(r)), F.lit(0).cast("long")) for r in range(runs)])
    placed = classes.select("f", F.col("size").alias("copies"), "first", "n", "sketch").join(terms.select("f", every.alias("terms"), "ends"), "f")
    units = _units(placed.select("f", "copies", "first", "n", "sketch", "terms", F.explode("ends").alias("e")).select("*", "e.bucket", "e.size", "e.grams").drop("e"))
    least = math.floor(T * (threshold - 6 * math.sqrt(threshold * (1 - threshold) / T)))

    def likely(batches):
        for tab, offs in _groups(batches, "unit"):
            sketch, term = _matrix(tab, "sketch", np.uint8, T), np.array(tab.column("terms").to_pylist(), np.int64).reshape(-1, runs)
            bucket, size = tab.column("bucket").to_numpy(), tab.column("n").to_numpy().astype(np.float64)
            live = np.zeros(tab.num_rows, bool)
            for i, j in _pairs(offs):
                fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
                fits &= _in_blocks(tab, i, j)
                i, j = i[fits], j[fits]
                alike = np.count_nonzero(sketch[i] == sketch[j], axis=1) >= least
                i, j = i[alike], j[alike]
                ok = _first_meeting(term, bucket, i, j)
                live[i[ok]] = True
                live[j[ok]] = True
            names = ["unit", "f", "copies", "k", "t", "bucket", "own", "lo", "hi", "terms"]
            out = tab.select(names).filter(pa.array(live))
            yield from out.to_batches()

    kind = documents.schema["k"].dataType.simpleString()
    flat = units.select("unit", "f", "copies", F.col("first.k").alias("k"), F.col("first.t").alias("t"), "n", "sketch", "terms", "bucket", "own", "lo", "hi")
    active = cut(_together(flat).mapInArrow(likely, f"unit long, f binary, copies long, k {kind}, t long, bucket long, own int, lo int, hi int, terms array<long>"))

    # The exact sets, of one document of each class that may have a link.
    wanted = active.select(F.col("k").alias("wk"), F.col("t").alias("wt"), "f").distinct()
    on = (F.col("t") == F.col("wt")) & F.col("k").eqNullSafe(F.col("wk"))
    texts = source.join(wanted.hint("shuffle_hash"), on).select("f", "x")

    def full(batches):
        for batch in batches:
            for part in slices(batch, "x"):
                sets = ngram_sets(part.column("x"), n)
                yield pa.RecordBatch.from_arrays([part.column("f"), pa.array([s.tobytes() for s in sets], pa.binary())], ["f", "set"])

    sets = texts.mapInArrow(full, "f binary, set binary").dropDuplicates(["f"])
    units = active.drop("k", "t").join(sets, "f")

    def exact(batches):
        for tab, offs in _groups(batches, "unit"):
            ids, copies = tab.column("f").to_pylist(), tab.column("copies").to_numpy()
            term, bucket = np.array(tab.column("terms").to_pylist(), np.int64).reshape(-1, runs), tab.column("bucket").to_numpy()
            raw = tab.column("set")
            n_links, root = np.zeros(tab.num_rows, np.int64), np.arange(tab.num_rows)
            for lo, hi in zip(offs[:-1], offs[1:], strict=True):
                if hi - lo < 2:
                    continue
                own = [np.frombuffer(raw[r].as_py(), np.uint64) for r in range(lo, hi)]
                i, j = np.triu_indices(hi - lo, 1)
                shared = intersections(own)[i, j]
                size = np.array([len(s) for s in own])
                ok = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
                i, j = i[ok] + lo, j[ok] + lo
                ok = _in_blocks(tab, i, j)
                i, j = i[ok], j[ok]
                ok = _first_meeting(term, bucket, i, j)
                i, j = i[ok], j[ok]
                np.add.at(n_links, i, copies[j])
                np.add.at(n_links, j, copies[i])
                root[lo:hi] = _least_together(lo, hi, i, j, ids)
            some = n_links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, y in zip(ids, some, strict=True) if y], pa.binary()), pa.array(n_links[some]), pa.array([ids[r] for r, y in zip(root, some, strict=True) if y], pa.binary())],
                ["f", "n_links", "root"],
            )

    links = cut(_together(units).mapInArrow(exact, "f binary, n_links long, root binary"))
    return documents, classes.select("f", "size", "first"), links


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets of distinct numbers."""
    g = len(sets)
    out = np.zeros((g, g), np.int64)
    if g <= 4:
        for i in range(g):
            for j in range(i + 1, g):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1  # what only one set has adds nothing
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    step, total = 8192, np.zeros((g, g), np.float64)
    for lo in range(0, int(often.sum()), step):
        a, b = np.searchsorted(column, (lo, lo + step))
        m = np.zeros((g, step), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        total += m @ m.T  # exact: counts below 2 to the 24th
    return np.rint(total).astype(np.int64)


def _least_together(lo: int, hi: int, i: np.ndarray, j: np.ndarray, ids: list[bytes]) -> np.ndarray:
    """Of each member the row of the least id that it hangs together with."""
    up = list(range(hi - lo))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip((i - lo).tolist(), (j - lo).tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            a, b = (a, b) if ids[lo + a] < ids[lo + b] else (b, a)
            up[b] = a
    return np.array([top(x) + lo for x in range(hi - lo)])


def _grouped(df: DataFrame, text: str, key: str, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(documents ``k, t, f``; classes ``f, n_links, group, head``), where ``head`` is the group's first document."""
    documents, classes, links = linked(df, text, key, n, threshold, recall)
    count = links.groupBy("f").agg(F.sum("n_links").alias("n_links"))
    labels = components(links, "f", "root")
    rows = classes.join(count, "f", "left").join(labels.withColumnRenamed("node", "f"), "f", "left")
    rows = cut(rows.select("f", "size", "first", (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("label", "f").alias("group")))
    heads = rows.groupBy("group").agg(F.min("first").alias("head"))
    return documents, rows.join(heads, "group").select("f", "n_links", "group", "head")


def join_ngrams(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: ``key``, ``class_id`` (the least key among the documents that links connect) and
    ``n_links``, the number of other documents at the threshold or above, copies included."""
    documents, classes = _grouped(df, text, key, n, threshold, recall)
    out = documents.join(classes.withColumnRenamed("f", "cf"), F.col("f") == F.col("cf"), "left")
    alone = F.col("cf").isNull()
    return out.select(
        F.col("k").alias(key), F.when(alone, F.col("k")).otherwise(F.col("head.k")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The first document (by key, nulls last) of each group that links connect, with all its columns.

    Of rows with equal key and text one stays; documents without words all stay.
    """
    documents, classes = _grouped(df, text, key, n, threshold, recall)
    heads = classes.select(F.col("head.k").alias("__k"), F.col("head.t").alias("__t")).distinct()
    x = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = df.withColumn("__x", x)
    on = (F.col("__x") == F.col("__t")) & F.col(key).eqNullSafe(F.col("__k"))
    kept = rows.join(heads.hint("shuffle_hash"), on).drop("__k", "__t")
    if not documents.groupBy("k", "t").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([key, "__x"])
    wordless = rows.where(F.coalesce(F.regexp_replace(F.col(text).cast("string"), r"[!-/:-@\[-`{-~ \t-\r]", ""), F.lit("")) == "")
    return kept.unionByName(wordless).select(*df.columns)
