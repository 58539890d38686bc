"""Message envelopes: decoding, payloads, results, and the tables they are written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INLINE_LIMIT = 500 * 1024
MOST_DELIVERIES = 5
#: Error types, whether they are tried again, and their status names.
ERRORS = {
    "Internal": (True, "INTERNAL"), "NotFound": (False, "NOT_FOUND"), "BadRequest": (False, "INVALID_ARGUMENT"), "Unauthorized": (False, "UNAUTHENTICATED"),
    "Conflict": (False, "ALREADY_EXISTS"), "ValidationFailed": (False, "INVALID_ARGUMENT"), "PermissionDenied": (False, "PERMISSION_DENIED"),
}

ENVELOPE = """
correlationId string, workflow struct<id:string,run:string>, node struct<id:string,executionId:string>,
payload struct<inlineData:string,blobReference:struct<url:string,sizeBytes:bigint>>, metadata map<string,string>,
embeddedNodes array<struct<id:string,type:string,depth:int,executionOrder:int>>, createdAt string, updatedAt string, _corrupt string
"""


def decode(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds the envelope's columns under ``message``; a text that is no envelope leaves ``message._corrupt``."""
    text = F.col(value).cast("string")
    return df.withColumn("message", F.from_json(text, ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine)"""
    bad = F.col("message").isNull() | F.col("message._corrupt").isNotNull()
    return df.where(~bad), df.where(bad)


def problems(m: Column) -> Column:
    """What is wrong with an envelope, as an array of texts."""
    nodes = m["embeddedNodes"]
    ids = F.transform(F.coalesce(nodes, F.array().cast("array<struct<id:string,type:string,depth:int,executionOrder:int>>")), lambda n: n["id"])
    places = F.transform(F.coalesce(nodes, F.array().cast("array<struct<id:string,type:string,depth:int,executionOrder:int>>")), lambda n: F.concat_ws("/", n["depth"], n["executionOrder"]))
    checks = [
        (F.coalesce(m["workflow"]["id"], F.lit("")) == "", "workflow id is missing"),
        (F.coalesce(m["workflow"]["run"], F.lit("")) == "", "run id is missing"),
        (F.coalesce(m["node"]["id"], F.lit("")) == "", "node id is missing"),
        (F.exists(ids, lambda i: F.coalesce(i, F.lit("")) == ""), "an embedded node has no id"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "embedded node ids are not unique"),
        (F.size(F.array_distinct(places)) < F.size(places), "two embedded nodes have the same place"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in checks]), lambda x: x.isNotNull())


def with_transport(m: Column, **values: Column) -> Column:
    """Metadata with transport facts, such as the delivery count and sequence numbers, as text."""
    extra = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    own = F.coalesce(m, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(extra, k)), extra)


def read_blobs(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, content) of text blobs; only the named paths are read."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def resolve_payload(df: DataFrame, blobs: DataFrame) -> DataFrame:
    """Adds ``data`` (inline, else the blob's content) and ``payload_error`` where there is neither."""
    inline, url = F.col("message.payload.inlineData"), F.col("message.payload.blobReference.url")
    got = df.join(blobs.select(F.col("path").alias("__p"), F.col("content").alias("__c")), F.when(inline.isNull(), url) == F.col("__p"), "left")
    out = got.withColumn("data", F.coalesce(inline, F.col("__c"))).drop("__p", "__c")
    return out.withColumn("payload_error", F.when(F.col("data").isNull(), F.lit("message has neither inline data nor a readable blob")))


def clean_part(x: Column, otherwise: str) -> Column:
    """A part of a blob path: trimmed, with a stand-in for nothing, and without slashes."""
    return F.translate(F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(otherwise)), "/\\", "--")


def blob_path(workflow: Column, run: Column, execution: Column) -> Column:
    return F.concat(F.lit("results/"), clean_part(workflow, "unknown-workflow"), F.lit("/"), clean_part(run, "unknown-run"), F.lit("/"), clean_part(execution, "unknown-execution"), F.lit(".json"))


def inline_or_blob(df: DataFrame, text: str, path: Column, limit: int = INLINE_LIMIT) -> DataFrame:
    """Adds ``inline_result`` or ``blob_reference`` (url, size) by the text's bytes; the text itself stays."""
    n = F.octet_length(text)
    ref = F.struct(path.alias("url"), n.cast("bigint").alias("sizeBytes"))
    return df.withColumn("inline_result", F.when(n <= limit, F.col(text))).withColumn("blob_reference", F.when(n > limit, ref))


def node_of_execution(execution: Column, workflow: Column) -> Column:
    """The node id in an execution id: without the workflow's id and a number at the end."""
    rest = F.when(execution.startswith(F.concat(workflow, F.lit("-"))), execution.substr(F.char_length(workflow) + 2, F.char_length(execution))).otherwise(execution)
    return F.coalesce(F.nullif(F.regexp_replace(rest, r"-[0-9]+$", ""), F.lit("")), execution)


def classify(error_type: Column) -> tuple[Column, Column]:
    """(retryable, status name) of an error type; unknown types count as internal."""
    retry = F.create_map(*[F.lit(x) for k, v in ERRORS.items() for x in (k, v[0])])
    name = F.create_map(*[F.lit(x) for k, v in ERRORS.items() for x in (k, v[1])])
    return F.coalesce(F.element_at(retry, error_type), F.lit(True)), F.coalesce(F.element_at(name, error_type), F.lit("INTERNAL"))


def result_rows(df: DataFrame, output: str = "output", failure: str = "failure", error_type: str | None = None) -> DataFrame:
    """Adds ``status``, ``result`` (JSON text), ``events`` flags, ``error`` (struct) and ``result_size``."""
    kind = F.col(error_type) if error_type else F.lit("ValidationFailed")
    retry, code = classify(kind)
    failed = F.col(failure).isNotNull()
    text = F.to_json(output)
    error = F.struct(kind.alias("type"), code.alias("code"), F.col(failure).alias("message"), retry.alias("retryable"))
    return (
        df.withColumn("status", F.when(failed, F.lit("failed")).otherwise(F.lit("success")))
        .withColumn("result", F.when(~failed, text))
        .withColumn("event", F.when(failed, F.lit("error")).otherwise(F.lit("success")))
        .withColumn("error", F.when(failed, error))
        .withColumn("result_size", F.coalesce(F.octet_length("result"), F.lit(0)))
    )


def node_result(df: DataFrame) -> Column:
    """The result file's entry of a node: _meta, _events, _error, result."""
    null = F.lit(None).cast("string")
    return F.struct(
        F.struct(F.col("status").alias("status")).alias("_meta"),
        F.struct((F.col("status") == "success").alias("success"), (F.col("status") == "failed").alias("error")).alias("_events"),
        F.when(F.col("status") == "failed", F.col("error.message")).otherwise(null).alias("_error"), F.col("result").alias("result"),
    )
