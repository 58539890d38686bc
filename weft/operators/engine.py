"""One entry for all schema formats: ``process(df, column, schema, format, options)``.

Formats are looked up in a registry, so that one's own can be added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import csv_rows, hl7
from weft.operators import json_schema as J
from weft.operators.json_schema import Options

Processor = Callable[[DataFrame, str, object, Options], DataFrame]
PROCESSORS: dict[str, Processor] = {}


def register(name: str, processor: Processor) -> None:
    PROCESSORS[name.upper()] = processor


def _hl7(df: DataFrame, column: str, schema, options: Options) -> DataFrame:
    """The message stays as it is; defaults and structure don't apply."""
    out = hl7.process(df, column, schema, options.collect_all, options.severity)
    return out.withColumn("data", F.col(column)).withColumn("failure", F.lit(None).cast("string"))


register("JSON", J.process)
register("CSV", csv_rows.process)
register("HL7", _hl7)


def process(df: DataFrame, column: str, schema, form: str = "JSON", options: Options = Options()) -> DataFrame:
    """Adds ``data``, ``errors``, ``warnings``, ``infos``, ``valid`` and ``failure``."""
    if form.upper() not in PROCESSORS:
        raise ValueError(f"unknown format {form!r}")
    return PROCESSORS[form.upper()](df, column, schema, options)


def validate_only(df: DataFrame, column: str, schema, form: str = "JSON", options: Options = Options()) -> DataFrame:
    return process(df, column, schema, form, Options(options.collect_all, options.severity)).drop("data")
