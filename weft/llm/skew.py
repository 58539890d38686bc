"""Joins of rows with what is known of their groups, where one group may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that share the rows of one large group, groups that are dealt so at most, and the rows from which a group is large.
SALTS, MOST_LARGE, LARGE = 64, 1000, 2000


def join_groups(rows: DataFrame, groups: DataFrame, by: list[str], size: str, own: list[str], salts: int = SALTS, large: int = LARGE) -> DataFrame:
    """Inner equality join of ``rows`` with ``groups``, one row for each value of ``by`` with its number of rows in ``size``.

    The ``MOST_LARGE`` largest groups, of those with more than ``large`` rows, are dealt to ``salts`` tasks each by a hash of
    the row's ``own`` columns; they are so few that they can be broadcast. Any other group has less than one in
    ``MOST_LARGE`` of all rows. ``groups`` is read more than once: it should be written.
    """
    keys = groups.where(F.col(size) > large).orderBy(F.col(size).desc(), *by).limit(MOST_LARGE).select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(by)], F.lit(True).alias("__large"))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(keys), [df[c] == F.col(f"__{k}") for k, c in enumerate(by)], "left")

    salt = F.when(F.col("__large"), F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    each = F.when(F.col("__large"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = marked(rows).select(*rows.columns, salt.alias("__salt"))
    return dealt.join(marked(groups).select(*groups.columns, F.explode(each).alias("__salt")), [*by, "__salt"]).drop("__salt")
