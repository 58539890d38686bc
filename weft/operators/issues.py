"""Findings as rows: path, message, code, severity; grouped by severity and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "array<struct<path:string,message:string,code:string,severity:string>>"
SEVERITIES = ("ERROR", "WARNING", "INFO")
DROP = "DROP"


def issue(path: Column, message: Column | str, code: Column | str, severity: str | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(path.alias("path"), text(message).alias("message"), text(code).alias("code"), F.lit(severity).cast("string").alias("severity"))


def none() -> Column:
    return F.array().cast(KIND)


def issues_if(*pairs: tuple[Column, Column]) -> Column:
    """The issues whose conditions hold, in order."""
    if not pairs:
        return none()
    return F.filter(F.array(*[F.when(c, i) for c, i in pairs]), lambda x: x.isNotNull()).cast(KIND)


def gathered(*parts: Column) -> Column:
    return F.concat(*parts) if parts else none()


def with_severity(issues: Column, overrides: dict[str, str] | None = None, default: str = "ERROR") -> Column:
    """An issue's own severity stands first, then an override by code, then the default; DROP takes it out."""
    by_code = F.create_map(*[F.lit(x) for kv in (overrides or {}).items() for x in kv]) if overrides else None

    def one(x: Column) -> Column:
        by = F.element_at(by_code, x["code"]) if by_code is not None else F.lit(None).cast("string")
        s = F.upper(F.coalesce(F.nullif(x["severity"], F.lit("")), by, F.lit(default)))
        return F.struct(x["path"].alias("path"), x["message"].alias("message"), x["code"].alias("code"), s.alias("severity"))

    return F.filter(F.transform(issues, one), lambda x: x["severity"] != DROP)


def bucketed(issues: Column, overrides: dict[str, str] | None = None) -> Column:
    """Struct (errors, warnings, infos, valid)."""
    from weft.functions import bind

    pick = lambda xs, s: F.filter(xs, lambda x: x["severity"] == s)
    return bind(
        with_severity(issues, overrides),
        lambda xs: F.struct(
            F.filter(xs, lambda x: ~x["severity"].isin("WARNING", "INFO")).alias("errors"), pick(xs, "WARNING").alias("warnings"), pick(xs, "INFO").alias("infos"),
            (~F.exists(xs, lambda x: ~x["severity"].isin("WARNING", "INFO"))).alias("valid"),
        ),
    )


def first_only(issues: Column) -> Column:
    return F.slice(issues, 1, 1)


def summary(issues: Column) -> Column:
    """One issue as its own text; several as the first ten joined, with how many more there are."""
    texts = F.transform(issues, lambda x: F.concat(x["path"], F.lit(": "), x["message"]))
    n = F.size(issues)
    more = F.when(n > 10, F.concat(F.lit(" ... and "), (n - 10).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(texts, 1, 10), "; "), more))


def exploded(df: DataFrame, issues: str, *keep: str) -> DataFrame:
    """One row per issue, with its number from 0.

    By the outer form: for the inner one the optimizer adds a filter on the array's size below all projections, which
    computes the array there again with everything it is made of.
    """
    return df.select(*keep, F.posexplode_outer(issues).alias("n", "issue")).where("n IS NOT NULL").select(*keep, "n", "issue.*")
