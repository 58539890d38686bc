"""Whole-text work on Arrow batches with numpy: words, hashes and sums by document.

Text columns stay UTF-8 bytes in Arrow's own buffers; no Python object is made
for a word. Every helper takes a slice of at most ``MAX_BYTES`` of text (or one
document, if that alone is longer), so memory follows the longest document and
not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 2 << 20

#: The white space that ends a word: the blank and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 4096), _BASE, np.uint64)
        more[0] = 1
        _powers = np.cumprod(more)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offset of each row, from 0; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, name: str, most: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose text has at most ``most`` bytes, or that are one row."""
    _, offs = buffers(batch.column(name))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def find_words(buf: np.ndarray, offs: np.ndarray, separates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and where each row's words begin in those arrays."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = ~separates[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans lie in order and don't overlap."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(first, size)
    data = buf[pos + np.repeat(starts, size)]
    value = _BYTE[data] * _power(int(size.max()) + 1)[pos]
    return mix(np.add.reduceat(value, first))


def by_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-word windows, the word where each starts, and each row's offsets in them."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    offs = np.zeros(len(first), np.int64)
    np.cumsum(count, out=offs[1:])
    at = np.arange(int(offs[-1])) - np.repeat(offs[:-1] - first[:-1], count)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k]
    return mix(out), at, offs


def crc32_mod(col: Column | str, n: int) -> Column:
    """crc32 of the column's text, modulo n; a null counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, as texts are long; a setting that the session has already stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage by a checkpoint in the folder the cluster names in spark.checkpoint.dir.

    Where that is not set, a folder below the warehouse is taken if Spark runs in this one process, as in tests; on a
    cluster it is an error, as other machines might not see that folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(where or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return df.checkpoint(eager)
