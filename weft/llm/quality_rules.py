"""Rule ledger: every rule is evaluated once per document, and kept as one failure bit.

``ledger`` measures each whole text in one pass and stores the measurements and the
bit mask of failed rules. A policy is a named, versioned set of rules, that is a mask:
it is applied to a stored ledger by one bitwise AND, without reading a text again.
``ablations`` counts what each rule of a policy removes alone, from a count by mask.

Defined results: a null text has no words and no lines, so it fails ``few_words``;
repeated rows are measured each on its own; columns other than the text are kept as
they are, and a column of the input with the name of a measurement gives way to it.
An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.arrowtext import SPACE, buffers, by_row, find_words, hash_spans, mix, slices, windows

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_chars_all",
)
WINDOW = 5

_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True
_mark = np.zeros(256, bool)
_mark[list(b"!?")] = True
_capital = np.zeros(256, bool)
_capital[0x41:0x5B] = True


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition on the measurements; it is true where the rule removes."""

    bit: int
    name: str
    fails: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


RULES = (
    Rule(0, "few_words", lambda: _c("n_words") < 10),
    Rule(1, "repeated_windows", lambda: 100 * _c("n_repeat_words") > 20 * _c("n_words")),
    Rule(2, "symbols", lambda: 10 * _c("n_symbols") > 2 * _c("n_words")),
    Rule(3, "repeated_lines", lambda: (_c("n_lines") >= 4) & (100 * _c("n_dup_lines") > 50 * _c("n_lines"))),
    Rule(4, "word_length", lambda: (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 20 * _c("n_words"))),
    Rule(5, "capitals", lambda: 10 * _c("n_upper") > 4 * _c("word_chars")),
    Rule(6, "exclamations", lambda: 10 * _c("n_marks") > 5 * _c("n_words")),
)

#: A policy names its rules; a change makes a new version, so that old verdicts can be had again.
POLICIES = {
    "base@1": ("few_words", "repeated_windows"),
    "prose@1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "capitals", "exclamations"),
}


def mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def _lines(texts: pa.Array) -> tuple[list[int], list[int]]:
    """Lines with a word, and those of them equal to an earlier line, by row."""
    n_lines, n_dup = [], []
    for raw in texts.cast(pa.binary()).to_pylist():
        lines = [x for x in (raw or b"").split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        n_lines.append(len(lines))
        n_dup.append(len(lines) - len(set(lines)))
    return n_lines, n_dup


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text of a slice."""
    buf, offs = buffers(texts)
    starts, ends, first = find_words(buf, offs, SPACE)
    inside = ~SPACE[buf]
    points = (buf & 0xC0) != 0x80
    accented = np.zeros(len(buf), bool)  # U+00C0 to U+00DE but the multiplication sign
    if len(buf) > 1:
        accented[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    keys, at, woffs = windows(hash_spans(buf, starts, ends), first, WINDOW)
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.uint64), np.diff(woffs))
    keys = keys ^ mix(row + np.uint64(1))
    order = np.argsort(keys)
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = keys[order][1:] == keys[order][:-1]
        same[order[1:][equal]] = True
        same[order[:-1][equal]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[same], 1)
    np.add.at(cover, at[same] + WINDOW, -1)
    n_lines, n_dup = _lines(texts)
    return {
        "n_words": np.diff(first),
        "word_chars": by_row(inside & points, offs),
        "n_symbols": by_row(_symbol[buf], offs),
        "n_lines": np.array(n_lines, np.int64),
        "n_dup_lines": np.array(n_dup, np.int64),
        "n_repeat_words": by_row(np.cumsum(cover)[:-1] > 0, first),
        "n_upper": by_row(_capital[buf] | accented, offs),
        "n_marks": by_row(_mark[buf], offs),
        "n_chars_all": by_row(points, offs),
    }


def ledger(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the measurements, and ``fail_bits`` with one bit for each rule that fails."""
    kept = [c for c in keep if c not in (*MEASURES, "fail_bits")]
    source = df.select(*kept, F.col(text).cast("string").alias("__text"))
    names = list(kept)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                got = measure(part.column("__text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [pa.array(got[m], pa.int64()) for m in MEASURES], [*names, *MEASURES]
                )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"] + [f"{m} long" for m in MEASURES])
    bits = sum((F.when(r.fails(), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES), F.lit(0))
    return source.mapInArrow(run, schema).withColumn("fail_bits", bits.cast("long"))


def apply_policy(entries: DataFrame, policy: str, out: str = "kept") -> DataFrame:
    """A boolean column: no rule of the policy failed."""
    return entries.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, and documents that it alone removes.

    One aggregation by failure mask (at most two to the number of rules), then bit tests on those counts.
    """
    whole = mask(policy)
    counts = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if whole >> r.bit & 1])
    each = counts.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_only_this"),
        F.coalesce(F.sum(F.when((F.col("bits") == 0) | alone, F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )
