"""Queries over the driver's tables, one or more per operator, and the same as DuckDB SQL.

Names begin with the operator's id. A query without SQL is one that SQL can't tell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import paths
from weft.functions import conditions as C
from weft.functions import dates as D
from weft.functions import nodes as N
from weft.functions import strings as S
from weft.operators import csv_rows, hl7, rules
from weft.operators import documents as docs
from weft.operators import issues as I  # noqa: E741
from weft.operators import json_schema as J
from weft.plans import flow, resolve
from weft.plans.flow import Mapping, NodeDef, Unit
from weft.sources import messages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _simple(name: str, table: str, key: str, make: Callable[[], dict[str, Column]], sql: str) -> None:
    """A projection of one table: its key and computed columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, table).select(key, *[v.alias(k) for k, v in make().items()])

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {key}, {sql} FROM {table}"


# ---- strings

_simple("s01_concatenate", "customer", "c_custkey", lambda: {"r": S.concatenate(c("c_name"), c("c_mktsegment"), separator="/")}, "concat_ws('/', c_name, c_mktsegment) AS r")


@query("SELECT p_partkey, i - 1 AS pos, w[i] AS part FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def s02_split(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.posexplode(S.split(c("p_name"), " ")).alias("pos", "part")).select("p_partkey", c("pos").cast("long").alias("pos"), "part")


_simple("s03_join", "part", "p_partkey", lambda: {"r": S.join(S.split(c("p_name"), " "), "-")}, "array_to_string(string_split(p_name, ' '), '-') AS r")
_simple("s04_trim", "orders", "o_orderkey", lambda: {"r": S.trim(c("o_orderpriority"), "12345-"), "w": S.trim(F.concat(F.lit(" \t"), c("o_orderpriority"), F.lit("\n ")))}, "trim(o_orderpriority, '12345-') AS r, o_orderpriority AS w")
_simple("s05_replace", "part", "p_partkey", lambda: {"r": S.replace(c("p_name"), "e", "E")}, "replace(p_name, 'e', 'E') AS r")
_simple(
    "s05_replace_regex", "part", "p_partkey",
    lambda: {"r": S.replace(c("p_brand"), r"([A-Za-z]+)#(\d)", "$2-$1", use_regex=True), "w": S.replace(c("p_brand"), ".*", "all", use_regex=True), "e": S.replace(F.lit("aXbbY"), "b*", "-", use_regex=True), "f": S.replace(F.lit("aXbbY"), "b*", "-", 3, True)},
    r"regexp_replace(p_brand, '([A-Za-z]+)#(\d)', '\2-\1', 'g') AS r, 'all' AS w, '-a-X-Y-' AS e, '-a-X-Y' AS f",
)
_simple("s05_replace_first", "part", "p_partkey", lambda: {"r": S.replace(c("p_name"), "[aeiou]", "*", 1, True), "l": S.replace(c("p_name"), " ", "_", 1)}, "regexp_replace(p_name, '[aeiou]', '*') AS r, CASE WHEN contains(p_name, ' ') THEN left(p_name, position(' ' IN p_name) - 1) || '_' || substr(p_name, position(' ' IN p_name) + 1) ELSE p_name END AS l")
_simple("s06_substring_neg", "customer", "c_custkey", lambda: {"r": S.substring(c("c_name"), -4), "m": S.substring(c("c_name"), 2, 5)}, "right(c_name, 4) AS r, substr(c_name, 3, 3) AS m")
_simple("s07_upper", "part", "p_partkey", lambda: {"r": S.to_upper(c("p_name"))}, "upper(p_name) AS r")
_simple("s08_lower", "region", "r_regionkey", lambda: {"r": S.to_lower(c("r_name"))}, "lower(r_name) AS r")
_simple("s09_title_case", "part", "p_partkey", lambda: {"r": S.title_case(c("p_name"))}, "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') AS r")
_simple("s10_capitalize", "part", "p_partkey", lambda: {"r": S.capitalize(c("p_name"))}, "upper(left(p_name, 1)) || substr(p_name, 2) AS r")
_simple("s11_contains", "documents", "doc_id", lambda: {"r": S.contains(c("text"), "the")}, "contains(text, 'the') AS r")
_simple("s11_contains_regex", "documents", "doc_id", lambda: {"r": S.contains(c("text"), r"[0-9]{3}", True)}, "regexp_matches(text, '[0-9]{3}') AS r")
_simple("s12_length", "documents", "doc_id", lambda: {"r": S.length(c("text"))}, "length(text)::INT AS r")


@query(r"""SELECT page_id, i - 1 AS n, w[i] AS whole, regexp_extract(w[i], '([a-z_]+)=([^&#]*)', 1) AS k, regexp_extract(w[i], '([a-z_]+)=([^&#]*)', 2) AS v
FROM (SELECT page_id, regexp_extract_all(url, '([a-z_]+)=([^&#]*)') AS w, unnest(range(1, len(regexp_extract_all(url, '([a-z_]+)=([^&#]*)')) + 1)) AS i FROM pages)""")
def s13_regex_extract(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(S.regex_extract(c("url"), r"([a-z_]+)=([^&#]*)")).alias("n", "m"))
    return rows.select("page_id", c("n").cast("long").alias("n"), c("m")[0].alias("whole"), c("m")[1].alias("k"), c("m")[2].alias("v"))


_simple("s14_format", "nation", "n_nationkey", lambda: {"r": S.format_text("${name} ({key}) {other}", {"name": c("n_name"), "key": c("n_nationkey")})}, "concat(n_name, ' (', n_nationkey, ') {other}') AS r")
_simple("s15_base64", "documents", "doc_id", lambda: {"e": S.base64_encode(c("text")), "same": S.base64_decode(S.base64_encode(c("text"))) == c("text")}, "base64(encode(text)) AS e, true AS same")
_simple("s17_uri_encode", "pages", "page_id", lambda: {"r": S.uri_encode(c("url"))}, "replace(url_encode(url), '%20', '+') AS r")
_simple("s18_uri_decode", "pages", "page_id", lambda: {"r": S.uri_decode(S.uri_encode(c("url")))}, "url AS r")
_simple(
    "s19_normalize", "documents", "doc_id", lambda: {"r": S.normalize(c("text"))},
    f"replace(replace(replace(replace(translate(text, '{S.FOLD_FROM}', '{S.FOLD_TO}'), 'Æ', 'AE'), 'æ', 'ae'), 'ẞ', 'SS'), 'ß', 'ss') AS r",
)

# ---- conditions


def _condition(name: str, table: str, key: str, condition: C.Condition, sql: str) -> None:
    @query(f"SELECT {key}, ({sql}) AS met FROM {table}", name)
    def run(spark, sf_dir):
        df = read(spark, sf_dir, table)
        return df.select(key, C.node(df.schema, [condition])["route"].alias("met"))


_condition("f01_equals", "orders", "o_orderkey", C.Condition("o_orderstatus", "equals", "O"), "o_orderstatus = 'O'")
_condition("f01_equals_number", "part", "p_partkey", C.Condition("p_size", "equals", "17", "number"), "p_size = 17")
_condition("f02_not_equals", "orders", "o_orderkey", C.Condition("o_orderstatus", "not_equals", "O"), "o_orderstatus <> 'O'")
_condition("f03_greater_than", "events", "event_id", C.Condition("value", "greater_than", "50", "number"), "value > 50")
_condition("f04_less_than", "orders", "o_orderkey", C.Condition("o_totalprice", "less_than", 1000.5, "number"), "o_totalprice < 1000.5")
_condition("f05_greater_or_equal", "part", "p_partkey", C.Condition("p_size", "greater_than_or_equal", "25", "number"), "p_size >= 25")
_condition("f06_less_or_equal", "part", "p_partkey", C.Condition("p_size", "less_than_or_equal", "25", "number"), "p_size <= 25")
_condition("f07_contains", "part", "p_partkey", C.Condition("p_name", "contains", "e"), "contains(p_name, 'e')")
_condition("f08_not_contains", "part", "p_partkey", C.Condition("p_name", "not_contains", "e"), "NOT contains(p_name, 'e')")
_condition("f09_starts_with", "customer", "c_custkey", C.Condition("c_mktsegment", "starts_with", "B"), "starts_with(c_mktsegment, 'B')")
_condition("f10_ends_with", "customer", "c_custkey", C.Condition("c_mktsegment", "ends_with", "G"), "ends_with(c_mktsegment, 'G')")
_condition("f11_regex", "pages", "page_id", C.Condition("url", "regex", r"^https://.*/(de|fr)/\d+"), r"regexp_matches(url, '^https://.*/(de|fr)/\d+')")
_condition("f12_is_empty", "part", "p_partkey", C.Condition("p_name", "is_empty"), "p_name IS NULL OR p_name = ''")
_condition("f13_is_not_empty", "events", "event_id", C.Condition("value", "is_not_empty", kind="number"), "NOT (value IS NULL OR value = 0)")


@query("SELECT event_id, CAST(NULL AS BOOLEAN) AS route, true AS warned, true AS empty_met FROM events")
def f14_missing_field(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    r = C.node(df.schema, [C.Condition("absent", "equals", "x")])
    e = C.node(df.schema, [C.Condition("absent", "equals", "")])
    return df.select("event_id", r["route"].alias("route"), r["warning"].isNotNull().alias("warned"), e["route"].alias("empty_met"))


@query("SELECT o_orderkey, (o_orderstatus = 'F' AND o_totalprice > 5000) AS both_met, (o_orderstatus = 'F' OR o_totalprice > 5000) AS any_met FROM orders")
def f15_and_or(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    parts = [C.Condition("o_orderstatus", "equals", "F"), C.Condition("o_totalprice", "greater_than", "5000", "number")]
    return df.select("o_orderkey", C.node(df.schema, parts, "AND")["route"].alias("both_met"), C.node(df.schema, parts, "OR")["route"].alias("any_met"))


_simple("f16_canonical", "orders", "o_orderkey", lambda: {"r": C.canonical(F.round(c("o_totalprice"), 0) * 100)}, "CAST(CAST(round(o_totalprice, 0) * 100 AS BIGINT) AS VARCHAR) AS r")

# ---- dates

_ORDER_TEXT = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"


def _date(name: str, config: D.DateFormat, source: Callable[[], Column], sql: str) -> None:
    _simple(name, "orders", "o_orderkey", lambda: {"r": D.reformat(source(), config)["result"]}, f"{sql} AS r")


def _stamp() -> Column:
    return F.date_format(c("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


_date("d01_rfc1123", D.DateFormat("DateTime", "RFC1123"), _stamp, "strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S UTC')")
_date("d01_kitchen", D.DateFormat("DateTime", "Kitchen"), _stamp, "strftime(o_orderdate, '%-I:%M%p')")
_date("d01_rfc3339", D.DateFormat("DateTime", "RFC3339"), _stamp, "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')")
_date("d05_partial_datetime", D.DateFormat("DateTime", "DateTime"), lambda: F.substring(_stamp(), 1, 10), "strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00'")
_date("d05_compact_date", D.DateFormat("DateOnly", "DateOnly"), lambda: F.date_format(c("o_orderdate").cast("timestamp"), "yyyyMMdd"), "strftime(o_orderdate, '%Y-%m-%d')")
_date("d06_rubydate", D.DateFormat("DateTime", "RubyDate"), _stamp, "strftime(o_orderdate, '%a %b %d %H:%M:%S +0000 %Y')")
_date("d06_ansic", D.DateFormat("DateTime", "ANSIC"), _stamp, "strftime(o_orderdate, '%a %b ') || lpad(day(o_orderdate)::VARCHAR, 2, ' ') || strftime(o_orderdate, ' %H:%M:%S %Y')")
_date("d06_compact_offset", D.DateFormat("DateTime", "CompactOffset"), _stamp, "strftime(o_orderdate, '%Y%m%d%H%M%S+0000')")
_date("d07_date_style", D.DateFormat("DateTime", "DateOnly", date_style="DD/MM/YYYY"), _stamp, "strftime(o_orderdate, '%d/%m/%Y')")
_date("d08_time_style", D.DateFormat("DateTime", "DateTime", date_style="MM-DD-YYYY", time_style="12h"), _stamp, "strftime(o_orderdate, '%m-%d-%Y %I:%M:%S %p')")


@query("SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS r FROM events")
def d03_timezone(spark, sf_dir):
    s = F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf_dir, "events").select("event_id", D.reformat(s, D.DateFormat("DateTime", "DateTime", out_timezone="America/New_York"))["result"].alias("r"))


@query("SELECT event_id, strftime(timezone('UTC', timezone('Europe/Berlin', ts)), '%Y-%m-%dT%H:%M:%SZ') AS r FROM events")
def d02_zone_of_input(spark, sf_dir):
    s = F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf_dir, "events").select("event_id", D.reformat(s, D.DateFormat("DateTime", "UTC", in_timezone="Europe/Berlin"))["result"].alias("r"))


# ---- JSON schema

_EVENT_SCHEMA = {
    "type": "OBJECT",
    "properties": {
        "type": {"type": "STRING", "required": True, "validation": {"minLength": 5, "maxLength": 7, "enum": ["click", "view", "purchase"]}},
        "value": {"type": "NUMBER", "validation": {"minimum": 5, "maximum": 90}},
        "user": {"type": "STRING"},
        "gone": {"type": "STRING", "required": True},
    },
}


def _event_json(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.to_json(F.struct(c("event_type").alias("type"), F.round("value", 2).alias("value"), c("user_id").alias("user"))).alias("j"))


@query("""SELECT event_id, code, path FROM (
  SELECT event_id, unnest([
    CASE WHEN strlen(event_type) < 5 THEN {'c': 'MIN_LENGTH', 'p': 'root.type'} END, CASE WHEN strlen(event_type) > 7 THEN {'c': 'MAX_LENGTH', 'p': 'root.type'} END,
    CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN {'c': 'ENUM_MISMATCH', 'p': 'root.type'} END,
    CASE WHEN round(value, 2) < 5 THEN {'c': 'MIN_VALUE', 'p': 'root.value'} END, CASE WHEN round(value, 2) > 90 THEN {'c': 'MAX_VALUE', 'p': 'root.value'} END,
    {'c': 'TYPE_MISMATCH', 'p': 'root.user'}, {'c': 'REQUIRED', 'p': 'root.gone'}]) AS x FROM events) t, LATERAL (SELECT x.c AS code, x.p AS path) WHERE code IS NOT NULL""")
def v05_v16_findings(spark, sf_dir):
    out = J.process(_event_json(read(spark, sf_dir, "events")), "j", _EVENT_SCHEMA, J.Options(True))
    return I.exploded(out, "errors", "event_id").select("event_id", "code", "path")


@query("""SELECT event_id, CASE WHEN strlen(event_type) < 5 THEN 'MIN_LENGTH' WHEN strlen(event_type) > 7 THEN 'MAX_LENGTH' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'ENUM_MISMATCH'
  WHEN round(value, 2) < 5 THEN 'MIN_VALUE' WHEN round(value, 2) > 90 THEN 'MAX_VALUE' ELSE 'TYPE_MISMATCH' END AS code FROM events""")
def o05_first_error(spark, sf_dir):
    out = J.process(_event_json(read(spark, sf_dir, "events")), "j", _EVENT_SCHEMA, J.Options(False))
    return out.select("event_id", c("errors")[0]["code"].alias("code"))


@query("""SELECT event_id, (CASE WHEN strlen(event_type) < 5 OR strlen(event_type) > 7 THEN 1 ELSE 0 END) + (CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END) + 1 AS n_errors, 1 AS n_warnings, 0 AS n_infos, false AS valid FROM events""")
def a09_bucket(spark, sf_dir):
    severity = {"REQUIRED": "WARNING", "MIN_VALUE": "DROP", "MAX_VALUE": "drop"}
    out = J.process(_event_json(read(spark, sf_dir, "events")), "j", _EVENT_SCHEMA, J.Options(True, severity))
    return out.select("event_id", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), F.size("infos").alias("n_infos"), "valid")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'none' WHEN event_id % 3 = 1 THEN CAST(NULL AS VARCHAR) ELSE event_type END AS kind, CAST(7 AS BIGINT) AS level FROM events")
def v02_defaults(spark, sf_dir):
    schema = {"type": "OBJECT", "properties": {"kind": {"type": "STRING", "default": "none"}, "deep": {"type": "OBJECT", "properties": {"level": {"type": "NUMBER", "default": 7}}}}}
    missing, null = F.lit("{}"), F.lit('{"kind":null}')
    j = F.when(c("event_id") % 3 == 0, missing).when(c("event_id") % 3 == 1, null).otherwise(F.to_json(F.struct(c("event_type").alias("kind"))))
    out = J.process(read(spark, sf_dir, "events").select("event_id", j.alias("j")), "j", schema, J.Options(True, None, True))
    v = F.parse_json("data")
    return out.select("event_id", F.try_variant_get(v, "$.kind", "string").alias("kind"), F.try_variant_get(v, "$.deep.level", "bigint").alias("level"))


@query("SELECT event_id, '{\"tags\":[],\"type\":\"' || event_type || '\"}' AS data FROM events")
def v04_structure(spark, sf_dir):
    schema = {"type": "OBJECT", "properties": {"type": {"type": "STRING"}, "tags": {"type": "ARRAY", "items": {"type": "STRING"}}}}
    return J.process(_event_json(read(spark, sf_dir, "events")), "j", schema, J.Options(True, None, False, True)).select("event_id", "data")


@query("""SELECT conv_id, n, CASE WHEN n > 3 THEN 1 ELSE 0 END AS too_many, CASE WHEN n > d THEN 1 ELSE 0 END AS doubled FROM (SELECT conv_id, count(*)::INT AS n, count(DISTINCT role) AS d FROM conversations GROUP BY conv_id)""")
def v14_array_rules(spark, sf_dir):
    schema = {"type": "OBJECT", "properties": {"roles": {"type": "ARRAY", "items": {"type": "STRING"}, "validation": {"maxItems": 3, "uniqueItems": True}}}}
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    out = J.process(rows.select("conv_id", F.size("roles").alias("n"), F.to_json(F.struct("roles")).alias("j")), "j", schema, J.Options(True))
    has = lambda code: F.size(F.filter("errors", lambda e: e["code"] == code))
    return out.select("conv_id", "n", has("MAX_ITEMS").alias("too_many"), has("DUPLICATE_ITEM").alias("doubled"))


@query("SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%Y-%m-%d') < '1994-01-01' THEN 'MIN_DATE' WHEN strftime(o_orderdate, '%Y-%m-%d') > '1996-12-31' THEN 'MAX_DATE' END AS code FROM orders")
def v12_dates(spark, sf_dir):
    schema = {"type": "OBJECT", "properties": {"d": {"type": "DATE", "validation": {"format": "date", "minDate": "1994-01-01", "maxDate": "1996-12-31"}}}}
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.date_format(c("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("d"))).alias("j"))
    return J.process(rows, "j", schema, J.Options(True)).select("o_orderkey", F.get("errors", F.lit(0))["code"].alias("code"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 2000 THEN 'MAX_LENGTH' END AS code FROM documents")
def v13_bytes(spark, sf_dir):
    schema = {"type": "OBJECT", "properties": {"b": {"type": "BYTE", "validation": {"maxLength": 2000}}}}
    rows = read(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(S.base64_encode(c("text")).alias("b"))).alias("j"))
    return J.process(rows, "j", schema, J.Options(True)).select("doc_id", F.get("errors", F.lit(0))["code"].alias("code"))


@query("""SELECT c_custkey, code, path FROM (
  SELECT c_custkey, unnest([CASE WHEN c_acctbal < 0 THEN 'MIN_VALUE' END, CASE WHEN strlen(c_mktsegment) > 8 THEN 'MAX_LENGTH' END]) AS code,
    unnest(['rows[' || c_custkey || '].c_acctbal', 'rows[' || c_custkey || '].c_mktsegment']) AS path FROM customer) WHERE code IS NOT NULL""")
def v25_csv_rows(spark, sf_dir):
    schema = {"columnHeaders": {"c_acctbal": {"type": "NUMBER", "validation": {"minimum": 0}}, "c_mktsegment": {"type": "STRING", "validation": {"maxLength": 8}}}}
    out = csv_rows.process_table(read(spark, sf_dir, "customer"), schema, "c_custkey")
    return I.exploded(out, "issues", "c_custkey").select("c_custkey", "code", "path")


# ---- shaping


@query("SELECT n_nationkey, unnest(['n-/key', 'n-/of/name', 'n-/of/region']) AS k, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS v FROM nation")
def p04_flatten(spark, sf_dir):
    v = F.call_function("to_variant_object", F.struct(c("n_nationkey").alias("key"), F.struct(c("n_name").alias("name"), c("n_regionkey").alias("region")).alias("of")))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", v.alias("v")).select("n_nationkey", F.explode(docs.without_roots(docs.flatten(c("v"), "n"))).alias("k", "x"))
    return rows.select("n_nationkey", "k", F.try_variant_get("x", "$", "string").alias("v"))


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def p05_unflatten(spark, sf_dir):
    rows = read(spark, sf_dir, "nation")
    flat = docs.flatten_struct("n", rows.select("n_name", "n_regionkey").schema)
    back = rows.select("n_nationkey", F.element_at(docs.documents_of(F.transform_values(flat, lambda _, v: N.variant(v))), "n").alias("d"))
    return back.select("n_nationkey", F.try_variant_get("d", "$.n_name", "string").alias("name"), F.try_variant_get("d", "$.n_regionkey", "int").alias("region"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def p01_get_nested(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(paths.get(F.parse_json("props"), "/k"), "$", "string").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS t FROM events")
def p02_set_nested(spark, sf_dir):
    v = paths.put(F.parse_json("props"), ("a", "b"), N.variant(c("event_type")))
    return read(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", F.try_variant_get("v", "$.k", "string").alias("k"), F.try_variant_get("v", "$.a.b", "string").alias("t"))


def _conversation_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.call_function("to_variant_object", F.struct(c("t.role").alias("role"), c("t.text").alias("text"))).alias("v"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role, text FROM conversations")
def p16_transposed(spark, sf_dir):
    rows = _conversation_arrays(spark, sf_dir).select("conv_id", F.posexplode(J.elements(docs.transposed(c("v")))).alias("i", "x"))
    return rows.select("conv_id", c("i").cast("long").alias("i"), F.try_variant_get("x", "$.role", "string").alias("role"), F.try_variant_get("x", "$.text", "string").alias("text"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role, text, conv_id::VARCHAR AS conv FROM conversations")
def j02_j05_zip(spark, sf_dir):
    mappings = [Mapping("t", "/role", ("/items//role",), iterate=True), Mapping("t", "/text", ("/items//text",), iterate=True), Mapping("k", "/id", ("/items//conv",))]
    rows = _conversation_arrays(spark, sf_dir)
    sources = F.map_from_arrays(F.array(F.lit("t"), F.lit("k")), F.array(c("v"), F.call_function("to_variant_object", F.struct(c("conv_id").cast("string").alias("id")))))
    out = rows.select("conv_id", resolve.resolve(sources, mappings)["data"].alias("d"))
    each = out.select("conv_id", F.posexplode(J.elements(paths.get(c("d"), "/items"))).alias("i", "x"))
    return each.select("conv_id", c("i").cast("long").alias("i"), *[F.try_variant_get("x", f"$.{k}", "string").alias(k) for k in ("role", "text", "conv")])


@query("SELECT c_custkey, c_name AS name, n_name AS nation, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def m05_resolve(spark, sf_dir):
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    both = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    key = c("c_custkey").cast("string")
    pack = lambda **m: F.call_function("to_variant_object", F.struct(*[v.alias(k) for k, v in m.items()]))
    rows = both.select(key.alias("workflow_id"), F.lit("r").alias("run_id"), pack(name=c("c_name"), segment=c("c_mktsegment")).alias("a"), pack(data=F.struct(c("n_name").alias("nation"))).alias("b"))
    results = rows.select("workflow_id", "run_id", F.lit("cust").alias("node_id"), F.lit("success").alias("status"), c("a").alias("data")).unionAll(
        rows.select("workflow_id", "run_id", F.lit("nat").alias("node_id"), F.lit("Success").alias("status"), c("b").alias("data"))
    )
    mappings = [Mapping("cust", "/name", ("/out/name",)), Mapping("nat", "/nation", ("/out/nation",)), Mapping("cust", "/segment", ("/out/segment",))]
    out = resolve.documents_by_run(results, resolve.needed_sources(mappings)).select("workflow_id", resolve.resolve(c("sources"), mappings)["data"].alias("d"))
    return out.select(c("workflow_id").cast("long").alias("c_custkey"), *[F.try_variant_get("d", f"$.out.{k}", "string").alias(k) for k in ("name", "nation", "segment")])


# ---- units


def _values(df: DataFrame, key: str, column: str = "output") -> DataFrame:
    rows = df.select(key, F.explode_outer(column).alias("k", "v")).where("k IS NOT NULL")  # see issues.exploded
    return rows.select(key, "k", F.try_variant_get("v", "$", "string").alias("v"))


_GATED = Unit(
    "p",
    (
        NodeDef("cond", "plugin-simple-condition", {"manual_inputs": [{"name": "v", "operator": "greater_than", "value": "50", "type": "number"}]}, (Mapping("p", "/value", ("/v",)),), 0, 1),
        NodeDef("up", "plugin-strings", {"action": "to_upper"}, (Mapping("p", "/type", ("/value",)), Mapping("cond", "/true", kind="EVENT", trigger=True)), 1, 1),
    ),
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: a condition on the value, and the type in capitals where it is met."""
    rows = read(spark, sf_dir, "events")
    doc = F.call_function("to_variant_object", F.struct(c("event_type").alias("type"), F.coalesce("value", F.lit(0.0)).alias("value")))
    out = flow.run_unit(rows.select("event_id", doc.alias("parent")), _GATED)
    met = F.map_contains_key("output", F.lit("up-/result"))
    return out.select("event_id", met.alias("met"), F.try_variant_get(F.element_at("output", F.lit("up-/result")), "$", "string").alias("result"))


query("SELECT event_id, coalesce(value, 0) > 50 AS met, CASE WHEN coalesce(value, 0) > 50 THEN upper(event_type) END AS result FROM events", "e01_gate")(flagship)


def _orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_partkey"))).alias("lines"))
    doc = F.struct(F.lit("o").alias("kind"), F.transform("lines", lambda x: F.struct(x["l_returnflag"].alias("flag"), x["l_linenumber"].cast("string").alias("n"))).alias("lines"))
    return lines.select("l_orderkey", F.call_function("to_variant_object", doc).alias("parent"))


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey) - 1 AS i, lower(l_returnflag) || '-o' AS r FROM lineitem")
def i01_iterate(spark, sf_dir):
    nodes = (
        NodeDef("low", "plugin-strings", {"action": "to_lower"}, (Mapping("p", "/lines//flag", ("/value",), iterate=True),), 0, 1),
        NodeDef("cat", "plugin-strings", {"action": "concatenate", "separator": "-"}, (Mapping("low", "/result", ("/a",)), Mapping("p", "/kind", ("/b",))), 1, 1),
    )
    rows = _values(flow.run_unit(_orders_with_lines(spark, sf_dir), Unit("p", nodes)), "l_orderkey").where(paths.key_node(c("k")) == "cat").where(paths.key_path(c("k")) == "/result")
    return rows.select("l_orderkey", F.get(paths.key_index(c("k")), F.lit(0)).cast("long").alias("i"), c("v").alias("r"))


@query("""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey) - 1 AS j, l_returnflag FROM lineitem),
o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT o_custkey, 'n-/result[' || i || '][' || j || ']' AS k, l_returnflag || '@' || o_orderkey AS v FROM o JOIN l ON o_orderkey = l_orderkey""")
def i03_nested(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_partkey"))).alias("lines"))
    orders = read(spark, sf_dir, "orders").join(lines, c("o_orderkey") == c("l_orderkey"))
    docs_ = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(c("o_orderkey"), F.transform("lines", lambda x: F.struct(x["l_returnflag"].alias("flag"))).alias("lines")))).alias("orders"))
    shaped = F.transform("orders", lambda o: F.struct(o["o_orderkey"].cast("string").alias("key"), o["lines"].alias("lines")))
    rows = docs_.select("o_custkey", F.call_function("to_variant_object", F.struct(shaped.alias("orders"))).alias("parent"))
    nodes = (NodeDef("n", "plugin-strings", {"action": "concatenate", "separator": "@"}, (Mapping("p", "/orders//lines//flag", ("/a",), iterate=True), Mapping("p", "/orders//key", ("/b",))), 0, 1),)
    out = _values(flow.run_unit(rows, Unit("p", nodes)), "o_custkey")
    return out.where(c("k").startswith("n-/result"))


@query("SELECT page_id, true AS failed, 'caught' AS r, CAST(NULL AS VARCHAR) AS failure FROM pages")
def e04_error_section(spark, sf_dir):
    nodes = (
        NodeDef("dec", "plugin-strings", {"action": "base64_decode"}, (Mapping("p", "/url", ("/value",)),), 0, 1),
        NodeDef("say", "plugin-strings", {"action": "replace", "old": ".*", "new": "caught", "use_regex": True, "count": -1}, (Mapping("p", "/kind", ("/value",)), Mapping("dec", "/error", kind="EVENT", trigger=True, section=flow.ERROR_SECTION)), 1, 1),
    )
    doc = F.call_function("to_variant_object", F.struct("url", F.lit("caught").alias("kind")))
    out = flow.run_unit(read(spark, sf_dir, "pages").select("page_id", doc.alias("parent")), Unit("p", nodes))
    at = lambda k, t: F.try_variant_get(F.element_at("output", F.lit(k)), "$", t)
    return out.select("page_id", at("dec-/error", "boolean").alias("failed"), at("say-/result", "string").alias("r"), "failure")


@query("SELECT event_id, k, 'false' AS v FROM events, (SELECT unnest(['p-/error', 'low-/error']) AS k)")
def e06_event_outputs(spark, sf_dir):
    doc = F.call_function("to_variant_object", F.struct(c("event_type").alias("type")))
    unit = Unit("p", (NodeDef("low", "plugin-strings", {"action": "to_lower"}, (Mapping("p", "/type", ("/value",)),), 0, 1),))
    out = _values(flow.run_unit(read(spark, sf_dir, "events").select("event_id", doc.alias("parent")), unit), "event_id", "events")
    return out.where(c("k").endswith("/error"))


# ---- HL7


def _hl7_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    msh = F.lit("MSH|^~\\&|A|B|C|D|20250101120000||ADT^A01|1|P|2.5\r")
    pid = F.concat(F.lit("PID|1||"), c("c_custkey").cast("string"), F.lit("^^^NHS||"), F.replace(c("c_name"), F.lit("#"), F.lit("^")), F.lit("~x||"), c("c_mktsegment"))
    obx = F.concat(F.lit("\rOBX|1|NM|bal||"), F.format_string("%.2f", "c_acctbal"), F.lit("\rOBX|2|ST|seg||"), c("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", F.concat(msh, pid, obx).alias("raw"))


@query("""SELECT c_custkey, c_custkey::VARCHAR || '^^^NHS' AS pid3, 'NHS' AS pid34, replace(c_name, '#', '^') AS pid5, 'x' AS second, c_mktsegment AS obx25, 'ADT^A01' AS kind, 2 AS n_obx FROM customer""")
def h06_locations(spark, sf_dir):
    m, at = c("message"), hl7.location
    rows = hl7.parse(_hl7_messages(spark, sf_dir), "raw")
    return rows.select(
        "c_custkey", at(m, "PID-3").alias("pid3"), at(m, "PID-3.4").alias("pid34"), at(m, "PID-5").alias("pid5"), at(m, "PID-5(2)").alias("second"), at(m, "OBX-5", 2).alias("obx25"),
        at(m, "MSH-9").alias("kind"), hl7.instances(m, "OBX").alias("n_obx"),
    )


_HL7_SCHEMA = {
    "messageType": "ADT_A01", "version": "2.5",
    "segments": [
        {"name": "MSH", "usage": "R", "rpt": "1", "fields": [{"position": "MSH.12"}]},
        {"name": "PID", "usage": "R", "rpt": "1", "fields": [{"position": "PID.3", "usage": "R"}, {"position": "PID.5", "rpt": "1"}, {"position": "PID.7", "length": 8}]},
        {"name": "PV1", "usage": "R"},
        {"name": "OBX", "rpt": "*", "fields": [{"position": "OBX.1", "dataType": "SI"}, {"position": "OBX.5"}]},
    ],
    "rules": [{"id": "bal", "name": "Balance", "when": "msg('OBX-2') == 'NM'", "assert": "toNumber('OBX-5') >= 0.0", "errorPath": "OBX-5", "severity": "WARNING"}],
}


@query("""SELECT c_custkey, unnest(['PV1', 'PID-5'] || CASE WHEN length(c_mktsegment) > 8 THEN ['PID-7'] ELSE [] END) AS path,
  unnest(['HL7_MISSING_REQUIRED', 'HL7_REPETITION_VIOLATION'] || CASE WHEN length(c_mktsegment) > 8 THEN ['HL7_LENGTH'] ELSE [] END) AS code FROM customer""")
def h16_findings(spark, sf_dir):
    out = hl7.process(_hl7_messages(spark, sf_dir), "raw", _HL7_SCHEMA)
    return I.exploded(out, "errors", "c_custkey").select("c_custkey", "path", "code")


@query("SELECT c_custkey, 'OBX[1]-5' AS path, 'HL7_CUSTOM_RULE_VIOLATION' AS code FROM customer WHERE round(c_acctbal, 2) < 0")
def r02_rules(spark, sf_dir):
    out = hl7.process(_hl7_messages(spark, sf_dir), "raw", _HL7_SCHEMA)
    return I.exploded(out, "warnings", "c_custkey").select("c_custkey", "path", "code")


@query("SELECT c_custkey, 'OBX[1]-5' AS path, 'HL7_CUSTOM_RULE_VIOLATION' AS code FROM customer WHERE round(c_acctbal, 2) < 0")
def r02_rules_native(spark, sf_dir):
    rule = rules.compile_rules(_HL7_SCHEMA["rules"])[0]
    rows = hl7.parse(_hl7_messages(spark, sf_dir), "raw").withColumn("found", rules.rule_issues(rule, c("message")))
    return I.exploded(rows, "found", "c_custkey").select("c_custkey", "path", "code")


@query("""SELECT o_orderkey, true AS whole, o_orderkey % 28 + 10 BETWEEN 1 AND day(last_day(make_date(year(o_orderdate), o_orderkey % 12 + 1, 1))) AS day_ok, o_orderkey % 30 < 24 AS hour_ok,
  false AS text_ok FROM orders""")
def h13_scalars(spark, sf_dir):
    k = c("o_orderkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    stamp = F.date_format(c("o_orderdate").cast("timestamp"), "yyyyMMddHHmmss")
    day = F.concat(F.substring(stamp, 1, 4), two(k % 12 + 1), two(k % 28 + 10))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", hl7.is_scalar(stamp, "DTM").alias("whole"), hl7.is_scalar(day, "DT").alias("day_ok"), hl7.is_scalar(F.concat(two(k % 30), F.lit("15")), "TM").alias("hour_ok"),
        hl7.is_scalar(c("o_orderpriority"), "NM").alias("text_ok"),
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'HL7_VERSION_MISMATCH' END AS code FROM customer")
def h08_header(spark, sf_dir):
    version = F.when(c("c_custkey") % 2 == 0, F.lit("2.4")).otherwise(F.lit("v2.5.0"))
    found = hl7.header_issues(F.lit("adt^a01^x"), version, hl7.compile_schema(_HL7_SCHEMA))
    return read(spark, sf_dir, "customer").select("c_custkey", F.get(found, F.lit(0))["code"].alias("code"))


# ---- messages


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 2000 THEN 'inline' ELSE 'blob' END AS place, CASE WHEN octet_length(encode(text)) > 2000 THEN 'results/' || lang || '/r-1/' || doc_id || '.json' END AS url FROM documents""")
def snk05_inline_or_blob(spark, sf_dir):
    rows = messages.inline_or_blob(read(spark, sf_dir, "documents"), "text", messages.blob_path(c("lang"), F.lit("r/1"), c("doc_id").cast("string")), 2000)
    return rows.select("doc_id", F.when(c("inline_result").isNotNull(), F.lit("inline")).otherwise(F.lit("blob")).alias("place"), c("blob_reference.url").alias("url"))


@query("SELECT event_id, event_id % 5 <> 0 AS good, CASE WHEN event_id % 5 <> 0 THEN event_type END AS node, CASE WHEN event_id % 5 <> 0 THEN 1 END AS n_problems FROM events")
def src02_decode(spark, sf_dir):
    good = F.to_json(F.struct(F.struct(c("event_id").cast("string").alias("id")).alias("workflow"), F.struct(c("event_type").alias("id")).alias("node")))
    rows = read(spark, sf_dir, "events").select("event_id", F.when(c("event_id") % 5 == 0, F.lit("no json")).otherwise(good).alias("value"))
    m = messages.decode(rows)
    ok = m["message._corrupt"].isNull()
    return m.select("event_id", ok.alias("good"), F.when(ok, m["message.node.id"]).alias("node"), F.when(ok, F.size(messages.problems(c("message")))).alias("n_problems"))


@query("SELECT o_orderkey, 'node-' || (o_orderkey % 7) AS node FROM orders")
def snk11_node_of_execution(spark, sf_dir):
    wf, node = F.concat(F.lit("wf"), c("o_custkey").cast("string")), F.concat(F.lit("node-"), (c("o_orderkey") % 7).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", messages.node_of_execution(F.concat_ws("-", wf, node, c("o_orderkey").cast("string")), wf).alias("node"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def snk07_latest(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return resolve.latest(rows, "event_id", ("user_id",))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_type = 'click' THEN event_id % 2 = 0 END AS again FROM events")
def t04_redelivery(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.create_map(F.lit("v"), c("value")).alias("output"), F.when(c("event_type") == "click", F.lit("no")).alias("failure"),
        F.when(c("event_id") % 2 == 0, F.lit("Internal")).otherwise(F.lit("BadRequest")).alias("kind"),
    )
    return messages.result_rows(rows, error_type="kind").select("event_id", "status", c("error.retryable").alias("again"))


@query("SELECT event_id, event_type || '!' AS result FROM events")
def u01_python_node(spark, sf_dir):
    node = N.python_node(lambda d: {"result": d["type"] + "!"})
    doc = F.call_function("to_variant_object", F.struct(c("event_type").alias("type")))
    out = read(spark, sf_dir, "events").select("event_id", node(doc, {}).alias("o"))
    return out.select("event_id", F.try_variant_get("o.data", "$.result", "string").alias("result"))


def _typed_events(spark: SparkSession, sf_dir: str, node: str, settings: dict, **members: Column) -> DataFrame:
    """A node over a document of each event: its output as ``o``."""
    doc = F.call_function("to_variant_object", F.struct(*[v.alias(k) for k, v in members.items()]))
    events = read(spark, sf_dir, "events")
    if hasattr(N.NODES[node], "function_of"):
        events = _spread(events, "event_id")
    return events.select("event_id", doc.alias("d")).select("event_id", N.NODES[node](c("d"), settings).alias("o"))


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores, where a file has fewer parts than that: for Python, which takes its time for each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


@query("SELECT event_id, upper(event_type) || '!' AS r, event_id % 2 = 0 AS failed FROM events")
def u02_script(spark, sf_dir):
    code = "const up = s => s.toUpperCase() + '!'; return {r: up(input.type), failed: input.n % 2 === 0}"
    out = _typed_events(spark, sf_dir, "plugin-js", {"script": code}, type=c("event_type"), n=c("event_id"))
    return out.select("event_id", F.try_variant_get("o.data", "$.r", "string").alias("r"), F.try_variant_get("o.data", "$.failed", "boolean").alias("failed"))


@query("SELECT event_id, 200 + (length(event_type)) AS status, base64(encode('POST /e/' || event_type)) AS body FROM events")
def u03_http(spark, sf_dir):
    from weft.sources import http

    request = http.request({"method": "POST"}, url=F.concat(F.lit("/e/"), c("event_type")))
    rows = read(spark, sf_dir, "events").select("event_id", request.alias("q"))
    return http.call(rows, "q", _echo).select("event_id", "status", "body")


def _echo(method: str, url: str, headers: dict, body: bytes) -> tuple[int, bytes]:
    return 200 + len(url) - 3, f"{method} {url}".encode()


@query("SELECT event_id, true AS error, coalesce(nullif(event_type, 'click'), 'fallback') AS said FROM events")
def u04_error_node(spark, sf_dir):
    out = _typed_events(spark, sf_dir, "plugin-error", {"message": "fallback"}, message=F.when(c("event_type") != "click", c("event_type")))
    return out.select("event_id", c("o.error").alias("error"), c("o.errorDescription").alias("said"))


@query("SELECT event_id, event_type AS kind, 'x' AS extra, event_type = 'click' AS error FROM events WHERE event_type <> 'click' UNION ALL SELECT event_id, NULL, NULL, true FROM events WHERE event_type = 'click'")
def v23_json_parse_node(spark, sf_dir):
    schema = {"type": "OBJECT", "properties": {"kind": {"type": "STRING", "required": True, "validation": {"pattern": "^[^c]"}}, "extra": {"type": "STRING", "default": "x"}}}
    encoded = S.base64_encode(F.to_json(F.struct(c("event_type").alias("kind"))))
    out = _typed_events(spark, sf_dir, "plugin-json-parse", {"schema": schema}, data=encoded)
    at = lambda k: F.try_variant_get("o.data", f"$.{k}", "string").alias(k)
    return out.select("event_id", at("kind"), at("extra"), c("o.error").alias("error"))


@query("""SELECT event_id, '{"kind":"' || event_type || '"}' AS made FROM events""")
def v24_json_produce_node(spark, sf_dir):
    schema = {"type": "OBJECT", "properties": {"kind": {"type": "STRING"}}}
    out = _typed_events(spark, sf_dir, "plugin-json-produce", {"schema": schema}, kind=c("event_type"), dropped=c("event_id"))
    return out.select("event_id", S.base64_decode(F.try_variant_get("o.data", "$.encoded", "string")).alias("made"))


@query("SELECT event_id, event_id % 13 AS n, CASE WHEN event_id % 13 = 0 THEN '' ELSE array_to_string(list_transform(range(1, least(event_id % 13, 10) + 1), lambda i: 'p' || i || ': m'), '; ') || CASE WHEN event_id % 13 > 10 THEN ' ... and ' || (event_id % 13 - 10) || ' more' ELSE '' END END AS r FROM events")
def a10_summary(spark, sf_dir):
    n = (c("event_id") % 13).cast("int")
    found = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: I.issue(F.concat(F.lit("p"), i.cast("string")), "m", "C"))
    return read(spark, sf_dir, "events").select("event_id", (c("event_id") % 13).alias("n"), I.summary(found).alias("r"))


@query("SELECT n_nationkey, '{\"deep\":{\"__truncated\":true},\"list\":[\"__truncated\"],\"name\":\"' || n_name || '\"}' AS r FROM nation")
def p17_truncate(spark, sf_dir):
    v = F.call_function("to_variant_object", F.struct(c("n_name").alias("name"), F.struct(c("n_regionkey").alias("r")).alias("deep"), F.array(c("n_regionkey")).alias("list")))
    return read(spark, sf_dir, "nation").select("n_nationkey", v.alias("v")).select("n_nationkey", F.to_json(J.truncate(c("v"), 1)).alias("r"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role FROM conversations")
def p18_unwrap(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    v = F.call_function("to_variant_object", F.transform("t", lambda x: F.struct(x["role"].alias("data"))))
    each = rows.select("conv_id", v.alias("v")).select("conv_id", F.posexplode(J.elements(docs.unwrapped(c("v")))).alias("i", "x"))
    return each.select("conv_id", c("i").cast("long").alias("i"), F.try_variant_get("x", "$", "string").alias("role"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role, conv_id AS conv FROM conversations")
def m09_set_through(spark, sf_dir):
    rows = _conversation_arrays(spark, sf_dir)
    doc = resolve.set_through(F.parse_json(F.lit("{}")), ("xs",), ("role",), paths.member(c("v"), "role"))
    out = rows.select("conv_id", resolve.set_through(doc, ("xs",), ("conv",), N.variant(c("conv_id"))).alias("d"))
    each = out.select("conv_id", F.posexplode(J.elements(paths.get(c("d"), "/xs"))).alias("i", "x"))
    return each.select("conv_id", c("i").cast("long").alias("i"), F.try_variant_get("x", "$.role", "string").alias("role"), F.try_variant_get("x", "$.conv", "bigint").alias("conv"))


@query("SELECT event_id, upper(event_type) AS result FROM events WHERE value IS NOT NULL AND value > 0")
def t01_stream(spark, sf_dir):
    """The unit as a streaming query that works off what is there; the batch tables are read back."""
    import uuid

    from weft.streaming.runner import Runner, shared_folder

    place = f"{shared_folder(spark)}/t01-{uuid.uuid4().hex}"
    schema = read(spark, sf_dir, "events").schema
    unit = Unit("p", (NodeDef("up", "plugin-strings", {"action": "to_upper"}, (Mapping("p", "/type", ("/value",)),), 0, 1),))

    def process(df: DataFrame) -> DataFrame:
        rows = df.where("value IS NOT NULL AND value > 0").withColumn("parent", F.call_function("to_variant_object", F.struct(c("event_type").alias("type"))))
        out = flow.run_unit(rows, unit).drop("parent", "events")
        return out.withColumn("output", F.map_filter("output", lambda k, _: k == "up-/result")).withColumn("execution_id", c("event_id"))

    runner = Runner(process, f"{place}/out")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/events*.parquet")
    runner.start(source, f"{place}/checkpoint").awaitTermination()
    rows = runner.current(spark)
    return rows.select(c("execution_id").alias("event_id"), F.get_json_object("result", "$.up-/result").alias("x"), F.from_json("result", "map<string,string>").alias("m")).select("event_id", F.element_at("m", F.lit("up-/result")).alias("result"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


from weft import more_queries  # noqa: E402, F401  they register themselves
