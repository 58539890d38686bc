"""Bounded samples of labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: dict[int, int], most_bytes: int, key: str = "doc_id", text: str = "text", seed: int = 17) -> list[tuple[str, int]]:
    """(text, 0 or 1) of at most about ``per_class`` documents by class and ``most_bytes`` of text.

    ``usable`` is a condition on the key. The documents lowest by a hash of the key are taken, so the sample is
    the same in every run. Labels that contradict one another for one key leave it out; null labels are ignored.
    Of rows with one key only the least text is taken, so that a key that is repeated very often adds one text.
    """
    known = labels.where(F.col(label).isin(0, 1) & usable).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    h = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 40))
    known = known.select(F.col(key).alias("__k"), "y", h.alias("h"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    limit = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, int(min(1.0, per_class[y] / n) * (1 << 40)))])[F.col("y")]
    chosen = known.where(F.col("h") < limit)  # bounded: about per_class keys
    mine = docs.select(F.col(key).alias("__d"), F.col(text).cast("string").alias("x")).where("x IS NOT NULL")
    got = mine.join(F.broadcast(chosen), F.col("__d") == F.col("__k")).groupBy("__k", "y", "h").agg(F.min("x").alias("x")).select("x", "y", "h")
    # The largest share of the bytes that fits; the same share of either class.
    share = got.agg(F.sum(F.octet_length("x")).alias("b")).first().b or 0
    if share > most_bytes:
        got = got.where(F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.lit(1 << 20)) < int(most_bytes / share * (1 << 20)))
    rows = got.collect()
    rows.sort(key=lambda r: (r.h, r.x))
    return [(r.x, int(r.y)) for r in rows]
