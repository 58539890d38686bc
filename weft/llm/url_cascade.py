"""URL verdicts by longest rule, then by exact membership in a list of hosts without a join.

The list, a table of hosts, is encoded as a cascade of Bloom filters over the complete
universe of keys, that is the distinct hosts of the corpus. The first filter holds the
listed keys, the second those unlisted keys of the universe that the first accepts
wrongly, the third the listed keys that the second accepts, and so on until a filter
accepts nothing wrongly. For any key of the universe the first filter that refuses it
tells its side, so the answer is exact. Which keys of the universe are listed is told by
one grouping of both, not by a join. Filters are constants in the plan: a row is judged by
a few hashes and bit tests. Everything here is DataFrame functions.

A cascade holds at most about ``MOST_KEYS`` listed keys. A longer list is dealt by a hash
of the key to as many cascades as it takes, and rows are judged in as many passes, each
with one cascade in its plan and written before the next. So what a plan carries is
bounded, and there is a cascade and no join whatever the length of the list.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule and is not listed, so it is allowed. Repeated rows are judged each on its own; a host
that is listed twice is listed, a null one is no host. With an empty list all hosts are
unlisted, and an empty table gives an empty table. Urls of any length are read whole.
Columns whose names clash with ``host``, ``path``, ``rule`` or ``verdict`` give way to the
results; all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.arrowtext import cut

ALLOW, BLOCK = "allow", "block"

#: (verdict, host, path)
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)

#: For a list where none is given: hosts with one of these words between dots or hyphens.
LISTED_WORDS = (
    "ads", "adserver", "adult", "bets", "betting", "casino", "gambling", "malware", "phishing", "pills", "poker", "porn",
    "sex", "spam", "tracker", "viagra", "warez", "xxx",
)

BITS_PER_KEY = 12
HASHES = 4
MOST_KEYS = 1_000_000
MOST_LEVELS = 40

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for a null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    blank = F.lit("")
    return F.coalesce(F.translate(raw, _UPPER, _UPPER.lower()), blank), F.coalesce(path, blank)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text of the longest rule that fits (null if none does) and its verdict."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def has_listed_word(host: Column, words=LISTED_WORDS) -> Column:
    return F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*[F.lit(w) for w in words])) if words else F.lit(False)


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    n_bits: int
    seed: int

    def accepts(self, key: Column) -> Column:
        bits = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = None
        for p in _positions(key, self.n_bits, self.seed):
            one = F.element_at(bits, (F.shiftright(p, 6) + 1).cast("int"))
            hit = F.bit_get(one, p.bitwiseAND(F.lit(63)).cast("int")) == 1
            out = hit if out is None else out & hit
        return out


def _positions(key: Column, n_bits: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + j)), F.lit(n_bits)) for j in range(HASHES)]


def _filter(keys: DataFrame, n: int, seed: int) -> Level:
    """A filter of n keys; its words are put together by bitwise OR before they reach the driver."""
    size = max(64, -(-n * BITS_PER_KEY // 64) * 64)
    each = keys.select(F.explode(F.array(*_positions(F.col("key"), size, seed))).alias("p"))
    got = each.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("v"))
    words = [0] * (size // 64)
    for r in got.collect():  # at most the filter's size
        words[r.w] = r.v
    return Level(tuple(words), size, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].accepts(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build(universe: DataFrame) -> Cascade:
    """From distinct (key, listed)."""
    listed, others = universe.where("listed").select("key"), universe.where(~F.col("listed")).select("key")
    levels: list[Level] = []
    n, inside, outside = listed.count(), listed, others
    while n:
        if len(levels) == MOST_LEVELS:
            raise ValueError("the cascade does not end; are there equal keys on both sides?")
        levels.append(_filter(inside, n, len(levels)))
        wrong = outside.where(levels[-1].accepts(F.col("key")))
        n = wrong.count()
        inside, outside = wrong, inside
    return Cascade(tuple(levels))


def key_universe(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct (key, listed) of the keys, both tables having one column; listed keys that are no keys of the first are left out."""
    one, two = keys.toDF("key"), listed.toDF("key").where("key IS NOT NULL")
    both = one.select("key", F.lit(True).alias("there"), F.lit(False).alias("listed")).unionByName(two.select(F.col("key").cast("string"), F.lit(False).alias("there"), F.lit(True).alias("listed")))
    return both.groupBy("key").agg(F.bool_or("there").alias("there"), F.bool_or("listed").alias("listed")).where("there").select("key", "listed")


def hosts_with_words(pages: DataFrame, url: str = "url", words=LISTED_WORDS) -> DataFrame:
    """A list made from the corpus: its distinct hosts with a listed word."""
    host = pages.select(split_url(F.col(url).cast("string"))[0].alias("host")).distinct()
    return host.where(has_listed_word(F.col("host"), words))


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, most_keys: int = MOST_KEYS) -> DataFrame:
    """All columns, and ``host``, ``path``, ``rule`` and ``verdict``. ``listed``: a table of one column, the hosts on the list."""
    host, path = split_url(F.col(url).cast("string"))
    rows = pages.withColumns({"host": host, "path": path})
    universe = cut(key_universe(rows.select("host"), listed))
    parts = max(1, -(-universe.where("listed").count() // most_keys))
    if parts == 1:
        member = build(universe).contains(F.col("host"))
    else:
        part = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))
        rows = rows.withColumn("__listed", F.lit(False))
        for k in range(parts):
            here = build(universe.where(part(F.col("key")) == k)).contains(F.col("host"))
            rows = cut(rows.withColumn("__listed", F.when(part(F.col("host")) == k, here).otherwise(F.col("__listed"))))
        member = F.col("__listed")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    out = rows.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(member, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))})
    return out.drop("__listed")
