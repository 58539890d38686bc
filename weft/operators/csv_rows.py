"""Rows of a typed table, given as a JSON array of objects, checked against column definitions."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import bind
from weft.operators import issues as I  # noqa: E741
from weft.operators import json_schema as J
from weft.operators.json_schema import Options, Property

TYPES = ("STRING", "NUMBER", "DATE")


@dataclass(frozen=True)
class CsvSchema:
    columns: dict[str, Property]
    name: str = ""
    delimiter: str = ","

    @property
    def row(self) -> Property:
        return Property("OBJECT", properties=self.columns)


def compile_schema(schema: str | dict) -> CsvSchema:
    """Columns in the order declared, or by position if every column has one of its own."""
    raw = json.loads(schema) if isinstance(schema, str) else schema
    headers = raw.get("columnHeaders")
    if not isinstance(headers, dict) or not headers:
        raise ValueError("a row schema needs columnHeaders")
    for name, c in headers.items():
        if c.get("type") not in TYPES:
            raise ValueError(f"column '{name}': type must be one of {', '.join(TYPES)}")
    names = list(headers)
    at = [headers[n].get("position") for n in names]
    if all(isinstance(p, int) and p >= 0 for p in at) and len(set(at)) == len(at):
        names.sort(key=lambda n: (headers[n]["position"], n))
    return CsvSchema({n: J._property(headers[n], n) for n in names}, raw.get("name") or "", raw.get("delimiter") or ",")


def rows_of(v: Column) -> Column:
    return J.elements(v)


def issues(rows: Column, schema: CsvSchema, collect_all: bool = True) -> Column:
    """Findings of all rows, with paths like ``rows[0].Age``; without ``collect_all`` those of the first bad row."""
    per_row = F.transform(rows, lambda r, i: J.value_issues(r, schema.row, F.concat(F.lit("rows["), i.cast("string"), F.lit("]"))))
    if collect_all:
        return F.flatten(per_row)
    return bind(F.filter(per_row, lambda x: F.size(x) > 0), lambda bad: F.coalesce(F.get(bad, F.lit(0)), I.none()))


def process(df: DataFrame, column: str, schema: str | dict | CsvSchema, options: Options = Options()) -> DataFrame:
    """Adds ``data`` (JSON text), ``errors``, ``warnings``, ``infos``, ``valid`` and ``failure``."""
    s = schema if isinstance(schema, CsvSchema) else compile_schema(schema)
    rows = rows_of(F.try_parse_json(column))
    rows = F.when(~F.exists(rows, lambda r: J.members(r).isNull()), rows)
    if options.apply_defaults:
        rows = bind(rows, lambda xs: F.transform(xs, lambda r: J.apply_defaults(r, s.row)))
    if options.structure:
        rows = bind(rows, lambda xs: F.transform(xs, lambda r: J.structure(r, s.row)))
    out = df.withColumn("__r", rows)
    found = F.when(F.col("__r").isNotNull(), issues(F.col("__r"), s, options.collect_all)).otherwise(I.none())
    out = out.withColumn("__b", I.bucketed(found, options.severity)).withColumn("failure", F.when(F.col("__r").isNull(), F.lit("no JSON array of objects")))
    return out.select(
        *df.columns, F.to_json(J._to_array(F.col("__r"))).alias("data"), F.col("__b.errors").alias("errors"), F.col("__b.warnings").alias("warnings"),
        F.col("__b.infos").alias("infos"), (F.col("__b.valid") & F.col("failure").isNull()).alias("valid"), "failure",
    )


def process_table(df: DataFrame, schema: str | dict | CsvSchema, index: str, options: Options = Options()) -> DataFrame:
    """The same for rows that are rows of a DataFrame already: adds ``issues`` with paths by the ``index`` column."""
    s = schema if isinstance(schema, CsvSchema) else compile_schema(schema)
    names = [c for c in s.columns if c in df.columns]
    v = F.call_function("to_variant_object", F.struct(*names))
    path = F.concat(F.lit("rows["), F.col(index).cast("string"), F.lit("]"))
    return df.withColumn("__v", v).withColumn("issues", I.with_severity(J.value_issues(F.col("__v"), s.row, path), options.severity)).drop("__v")
