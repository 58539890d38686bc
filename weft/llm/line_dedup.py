"""Repeated runs of lines across documents, by a suffix array over line ids and prefix doubling.

The corpus is one sequence of lines with a break after every document; lines without a
word are left out of it and never removed. Prefix doubling ranks its suffixes by their
first 1, 2, 4, ... lines: the rank of a suffix at 2h is the place of the pair of ranks at h,
of the suffix itself and of the one h lines on, among all such pairs in order. Pairs are
put in order by range partitions, so that ranks are made in all tasks at once; they go up
with the pairs but not in steps of one. A suffix whose first h lines occur nowhere else
needs no rank at 2h, so each round handles only suffixes that occur again, and rounds end
when none is left that could begin a run. Suffixes of one rank stand together in the
suffix array: they are an interval whose longest common prefix is h lines or more, known
by its size and its first member in corpus order.

A run counts if it has ``min_words`` words. The least runs that count, from every first
line on and up to every last line, have lengths m between two powers of two; two ranks
at the lower power, at the run's start and at its end, name the interval of depth m. Of
each interval all members but the first in corpus order are later copies, and go. If a
later copy overlaps the first in the same document, the lines of the first stay. The lines
that go are the same as if all runs were tried, of any length: every maximal repeated run
is made of least ones. A line goes only if an equal one stands earlier, so that of every
line in the corpus one copy stays.

No step gathers an interval: its members are counted with partial sums and meet what was
found by an equality join, in which the largest intervals are dealt to many tasks. What a document's own
lines need is at most that document.

Defined results: null and empty texts have no lines and stay as they are. Corpus order
is doc_id (nulls last), then a hash of the text, then line. Rows with equal doc_id and
text count as one document: all of them keep the same lines. A document whose lines all
go has an empty text. An empty table stays empty. Texts are read whole, however long, one
at a time beyond 2 MB. Other columns are kept, whatever their names; with ``report`` a
column named ``n_lines_dropped`` gives way to the report.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.arrowtext import cut, slices
from weft.llm.skew import join_groups

MIN_WORDS = 50
#: A row of the corpus: the key's nullness, the key, a hash of the text.
DOC = ("dn", "k", "t")


def least_runs(words: list[int], least: int) -> tuple[list[list[int]], list[int]]:
    """For the word counts of a document's lines: the lengths of the least runs that start at each line,
    and the length of the longest least run around each line.

    Least runs have ``least`` words and stop having them if the last line, or if the first line, is left out.
    """
    n = len(words)
    spans: set[tuple[int, int]] = set()
    end = total = 0
    for start in range(n):
        while end < n and total < least:
            total += words[end]
            end += 1
        if total < least:
            break
        spans.add((start, end - start))
        total -= words[start]
    start = total = 0
    for end in range(n):
        total += words[end]
        while total - words[start] >= least:
            total -= words[start]
            start += 1
        if total >= least:
            spans.add((start, end + 1 - start))
    lengths: list[list[int]] = [[] for _ in range(n)]
    need = [0] * n
    for start, m in sorted(spans):
        lengths[start].append(m)
        for i in range(start, start + m):
            need[i] = max(need[i], m)
    return lengths, need


def lines_with_words(text: bytes | None) -> list[tuple[int, bytes, int]]:
    """(line number, line, number of words)"""
    return [(j, x, n) for j, x in enumerate((text or b"").split(b"\n")) if (n := len(x.split()))]


def _source(df: DataFrame, text: str, key: str) -> DataFrame:
    x = F.col(text).cast("string")
    return df.select(F.col(key).isNull().alias("dn"), F.col(key).alias("k"), F.xxhash64(F.coalesce(x, F.lit(""))).alias("t"), x.alias("x"))


def positions(df: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line with a word: the document, the line's number ``i`` among these, its name ``c``, the
    lengths ``ms`` of the least runs that start there, and ``need``, the longest one around it."""
    source = _source(df, text, key)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "x"):
                row, at, name, lengths, needs = [], [], [], [], []
                for r, raw in enumerate(part.column("x").cast(pa.binary()).to_pylist()):
                    lines = lines_with_words(raw)
                    starts, need = least_runs([n for _, _, n in lines], min_words)
                    row += [r] * len(lines)
                    at += range(len(lines))
                    name += [xxhash.xxh3_128_digest(x) for _, x, _ in lines]
                    lengths += starts
                    needs += need
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(take) for c in DOC] + [pa.array(at, pa.int32()), pa.array(name, pa.binary()), pa.array(lengths, pa.list_(pa.int32())), pa.array(needs, pa.int32())],
                    [*DOC, "i", "c", "ms", "need"],
                )

    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"dn boolean, k {kind}, t long, i int, c binary, ms array<int>, need int")


def _intervals(rows: DataFrame, by: list[str], ranked: bool = True) -> DataFrame:
    """Rows whose values of ``by`` occur twice or more, with the interval's ``rank`` in the order of ``by`` and its ``first`` member."""
    found = rows.groupBy(*by).agg(F.count("*").alias("size"), F.min(F.struct(*DOC, "i")).alias("first")).where("size > 1")
    if ranked:
        found = found.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())
    return join_groups(rows, cut(found), by, "size", ["t", "i"]).drop("size")


def _on(rows: DataFrame, shift: Column) -> DataFrame:
    """Rows with the rank ``c2`` of the suffix ``shift`` lines on in the same document, if it has one."""
    far = rows.select(*[F.col(x).alias(f"{x}2") for x in (*DOC, "i", "c")])
    near = rows.withColumn("to", F.col("i") + shift)
    on = (F.col("t") == F.col("t2")) & (F.col("to") == F.col("i2")) & F.col("k").eqNullSafe(F.col("k2"))
    return near.join(far, on).drop("dn2", "k2", "t2", "i2", "to")


def _later(rows: DataFrame) -> DataFrame:
    """(document, ``i``, ``m``): what later copies take away, without lines of the first copy where they overlap it."""
    first = F.col("first")
    same = (F.col("t") == first["t"]) & F.col("k").eqNullSafe(first["k"])
    start = F.when(same, F.greatest("i", first["i"] + F.col("m"))).otherwise(F.col("i"))
    out = rows.where(~same | (F.col("i") != first["i"])).select(*DOC, start.alias("i"), (F.col("m") - (start - F.col("i"))).alias("m"))
    return out.where("m > 0")


def copied_runs(df: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """Lines (document, first line ``i``, number ``m``) of least runs that are there earlier in the corpus, too."""
    rows = cut(positions(df, text, key, min_words).where("need > 0"))
    by, found, h = ["c"], [], 1
    while True:
        live = _intervals(rows, by).drop(*by).withColumnRenamed("rank", "c")
        live = cut(live.dropDuplicates([*DOC, "i"]) if h == 1 else live)  # equal rows are one document
        found.append(_later(live.where(F.array_contains("ms", h)).withColumn("m", F.lit(h))))
        if h > 1:  # depths between h and 2h: the ranks at h of the start and of the last h lines
            some = live.select(*DOC, "i", "c", F.explode_outer(F.filter("ms", lambda m: (m > h) & (m < 2 * h))).alias("m"))
            run = _on(some.withColumn("m", F.coalesce("m", F.lit(0))), F.greatest(F.col("m") - h, F.lit(0))).where("m > 0").distinct()
            found.append(_later(_intervals(cut(run), ["c", "c2", "m"], ranked=False)))
        deeper = live.where(F.col("need") >= 2 * h).drop("first")
        if deeper.isEmpty():
            break
        rows, by = cut(_on(deeper, F.lit(h))), ["c", "c2"]
        h *= 2
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def drop_repeated(df: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """The documents without the later copies of repeated runs. ``report`` adds ``n_lines_dropped``."""
    runs = copied_runs(df, text, key, min_words).groupBy(*DOC).agg(F.collect_set(F.struct("i", "m")).alias("__runs"))
    runs = runs.select(F.col("dn").alias("__dn"), F.col("k").alias("__k"), F.col("t").alias("__t"), "__runs")
    names = [c for c in df.columns if not (report and c == "n_lines_dropped")]
    x = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    on = (x == F.col("__t")) & F.col(key).eqNullSafe(F.col("__k"))
    joined = df.join(runs.hint("shuffle_hash"), on, "left").select(*[df[c] for c in names], "__runs")

    def run(batches):
        for batch in batches:
            texts, dropped = [], []
            col = batch.column(text)
            marks = batch.column("__runs")
            for r in range(batch.num_rows):
                runs = marks[r].as_py()
                if not runs:
                    texts.append(col[r].as_py())
                    dropped.append(0)
                    continue
                raw = col[r].as_py()
                lines = raw.split("\n")
                worded = [j for j, _, _ in lines_with_words(raw.encode())]
                gone = {worded[i] for s in runs for i in range(s["i"], s["i"] + s["m"])}
                texts.append("\n".join(x for j, x in enumerate(lines) if j not in gone))
                dropped.append(len(gone))
            cols = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(dropped, pa.int64())], [*names, "__n"])

    fields = [f"`{f.name}` {'string' if f.name == text else f.dataType.simpleString()}" for f in df.select(*names).schema]
    out = joined.mapInArrow(run, ", ".join([*fields, "__n long"]))
    return out.withColumnRenamed("__n", "n_lines_dropped") if report else out.drop("__n")
