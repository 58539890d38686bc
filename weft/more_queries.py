"""More queries with SQL: cases of iteration, gates, resolution, shaping, schemas and dates that ``queries`` leaves out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import paths
from weft.functions import dates as D
from weft.functions import nodes as N
from weft.functions import strings as S
from weft.operators import csv_rows, hl7
from weft.operators import documents as docs
from weft.operators import issues as I  # noqa: E741
from weft.operators import json_schema as J
from weft.plans import flow, resolve
from weft.plans.flow import Mapping, NodeDef, Unit
from weft.queries import _conversation_arrays, _date, _hl7_messages, _orders_with_lines, _stamp, _values, query, read

c = F.col


def _doc(**members):
    return F.call_function("to_variant_object", F.struct(*[v.alias(k) for k, v in members.items()]))


def _text(x, path: str = "$"):
    return F.try_variant_get(x, path, "string")


# ---- units


def _items(rows: DataFrame, key: str, node: str, path: str) -> DataFrame:
    """(key, i, v) of a node's values in one iteration."""
    got = _values(rows, key).where(c("k").startswith(f"{node}-{path}") & (paths.key_node(c("k")) == node) & (paths.key_path(c("k")) == path))
    return got.select(key, F.get(paths.key_index(c("k")), F.lit(0)).cast("long").alias("i"), "v")


_LINES = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey) - 1 AS i, l_linenumber, l_returnflag FROM lineitem"


@query(f"SELECT l_orderkey, i, lower(l_returnflag) AS r FROM ({_LINES}) WHERE l_linenumber > 2")
def e02_gate_per_item(spark, sf_dir):
    nodes = (
        NodeDef("c", "plugin-simple-condition", {"manual_inputs": [{"name": "n", "operator": "greater_than", "value": "2", "type": "number"}]}, (Mapping("p", "/lines//n", ("/n",), iterate=True),), 0, 1),
        NodeDef("low", "plugin-strings", {"action": "to_lower"}, (Mapping("p", "/lines//flag", ("/value",), iterate=True), Mapping("c", "/true", kind="EVENT", trigger=True)), 1, 1),
    )
    rows = flow.run_unit(_orders_with_lines(spark, sf_dir), Unit("p", nodes))
    return _items(rows, "l_orderkey", "low", "/result").withColumnRenamed("v", "r")


@query("SELECT page_id, false AS next_ran, true AS failed FROM pages")
def e03_skipped_after_errors(spark, sf_dir):
    nodes = (
        NodeDef("dec", "plugin-strings", {"action": "base64_decode"}, (Mapping("p", "/url", ("/value",)),), 0, 1),
        NodeDef("up", "plugin-strings", {"action": "to_upper"}, (Mapping("dec", "/result", ("/value",)),), 1, 1),
    )
    out = flow.run_unit(read(spark, sf_dir, "pages").select("page_id", _doc(url=c("url")).alias("parent")), Unit("p", nodes))
    return out.select("page_id", F.map_contains_key("output", F.lit("up-/error")).alias("next_ran"), c("failure").isNotNull().alias("failed"))


@query("SELECT event_id, 'true' AS r FROM events")
def e05_event_value_as_data(spark, sf_dir):
    nodes = (
        NodeDef("low", "plugin-strings", {"action": "to_lower"}, (Mapping("p", "/type", ("/value",)),), 0, 1),
        NodeDef("fmt", "plugin-strings", {"action": "format", "template": "{ok}"}, (Mapping("low", "/success", ("/ok",), kind="EVENT"),), 1, 1),
    )
    out = flow.run_unit(read(spark, sf_dir, "events").select("event_id", _doc(type=c("event_type")).alias("parent")), Unit("p", nodes))
    return out.select("event_id", _text(F.element_at("output", F.lit("fmt-/result"))).alias("r"))


_WORDS = "SELECT p_partkey, i - 1 AS i, upper(w[i]) AS r FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)"


@query(_WORDS)
def i02_iterate_over_a_node(spark, sf_dir):
    nodes = (
        NodeDef("cut", "plugin-strings", {"action": "split", "delimiter": " "}, (Mapping("p", "/name", ("/value",)),), 0, 1),
        NodeDef("up", "plugin-strings", {"action": "to_upper"}, (Mapping("cut", "/result//$value", ("/value",), iterate=True),), 1, 1),
    )
    rows = read(spark, sf_dir, "part").select("p_partkey", _doc(name=c("p_name")).alias("parent"))
    return _items(flow.run_unit(rows, Unit("p", nodes)), "p_partkey", "up", "/result").withColumnRenamed("v", "r")


@query(_WORDS)
def i06_primitive_items(spark, sf_dir):
    nodes = (NodeDef("up", "plugin-strings", {"action": "to_upper"}, (Mapping("p", "/words//$value", ("/value",), iterate=True),), 0, 1),)
    rows = read(spark, sf_dir, "part").select("p_partkey", _doc(words=F.split("p_name", " ")).alias("parent"))
    return _items(flow.run_unit(rows, Unit("p", nodes)), "p_partkey", "up", "/result").withColumnRenamed("v", "r")


@query("SELECT n_nationkey, n_name AS shared, 0 AS n_items FROM nation")
def i08_empty_array(spark, sf_dir):
    nodes = (NodeDef("up", "plugin-strings", {"action": "to_upper"}, (Mapping("p", "/xs//t", ("/value",), iterate=True), Mapping("p", "/name", ("/b",))), 0, 1),)
    rows = read(spark, sf_dir, "nation").select("n_nationkey", _doc(name=c("n_name"), xs=F.array().cast("array<struct<t:string>>")).alias("parent"))
    out = flow.run_unit(rows, Unit("p", nodes))
    return out.select("n_nationkey", _text(F.element_at("output", F.lit("p-/name"))).alias("shared"), F.size(F.filter(F.map_keys("output"), lambda k: k.startswith("up-"))).alias("n_items"))


@query("SELECT l_orderkey, i, l_linenumber || ':' || l_returnflag AS r FROM (" + _LINES + ")")
def u02_in_iteration(spark, sf_dir):
    nodes = (NodeDef("js", "plugin-js", {"script": "return {r: input.n + ':' + input.flag}"}, (Mapping("p", "/lines//flag", ("/flag",), iterate=True), Mapping("p", "/lines//n", ("/n",), iterate=True)), 0, 1),)
    return _items(flow.run_unit(_orders_with_lines(spark, sf_dir), Unit("p", nodes)), "l_orderkey", "js", "/r").withColumnRenamed("v", "r")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role || '!' AS r FROM conversations")
def u01_in_iteration(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    rows = t.select("conv_id", _doc(turns=F.transform("t", lambda x: F.struct(x["role"].alias("role")))).alias("parent"))
    N.NODES["weft-shout"] = N.python_node(lambda d: {"r": d["role"] + "!"})
    nodes = (NodeDef("py", "weft-shout", {}, (Mapping("p", "/turns//role", ("/role",), iterate=True),), 0, 1),)
    return _items(flow.run_unit(rows, Unit("p", nodes)), "conv_id", "py", "/r").withColumnRenamed("v", "r")


@query("SELECT n_nationkey, 'p-/a/b/c/d/e/f/g/h' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'p-/error', 'false' FROM nation UNION ALL SELECT n_nationkey, 'p-/errorDescription', '' FROM nation")
def p04_eight_levels(spark, sf_dir):
    x = c("n_name")
    for name in "hgfedcba":
        x = F.struct(x.alias(name))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.call_function("to_variant_object", x).alias("parent"))
    return _values(flow.run_unit(rows, Unit("p", ())), "n_nationkey")


# ---- resolution


def _resolved(rows: DataFrame, key: str, sources: dict, mappings: list[Mapping]) -> DataFrame:
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in sources]), F.array(*sources.values()))
    return rows.select(key, resolve.resolve(m, mappings).alias("o"))


@query("SELECT n_nationkey, unnest([0, 1, 2]) AS i, unnest([n_name, 'x', NULL]) AS a, unnest(['p', 'q', n_name]) AS b FROM nation")
def j03_longer_array(spark, sf_dir):
    sources = {"a": _doc(xs=F.array(c("n_name"), F.lit("x"))), "b": _doc(ys=F.array(F.lit("p"), F.lit("q"), c("n_name")))}
    out = _resolved(read(spark, sf_dir, "nation"), "n_nationkey", sources, [Mapping("a", "/xs", ("/i//a",)), Mapping("b", "/ys", ("/i//b",))])
    each = out.select("n_nationkey", F.posexplode(J.elements(paths.get(c("o.data"), "/i"))).alias("i", "x"))
    return each.select("n_nationkey", "i", _text("x", "$.a").alias("a"), _text("x", "$.b").alias("b"))


@query("SELECT n_nationkey, true AS failed, true AS says_lengths FROM nation")
def j04_lengths_differ(spark, sf_dir):
    sources = {"a": _doc(xs=F.array(c("n_name"), F.lit("x"))), "b": _doc(ys=F.array(F.lit("p"), F.lit("q"), c("n_name")))}
    out = _resolved(read(spark, sf_dir, "nation"), "n_nationkey", sources, [Mapping("a", "/xs", ("/i//a",), iterate=True), Mapping("b", "/ys", ("/i//b",), iterate=True)])
    return out.select("n_nationkey", c("o.error").isNotNull().alias("failed"), c("o.error").contains("length").alias("says_lengths"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS n_sources FROM nation")
def j07_seeded_runs(spark, sf_dir):
    rows = read(spark, sf_dir, "nation")
    runs = rows.select(c("n_nationkey").cast("string").alias("workflow_id"), F.lit("r").alias("run_id"), "n_nationkey")
    results = rows.where("n_nationkey % 2 = 0").select(c("n_nationkey").cast("string").alias("workflow_id"), F.lit("r").alias("run_id"), F.lit("n").alias("node_id"), F.lit("success").alias("status"), _doc(name=c("n_name")).alias("data"))
    out = resolve.seeded(runs, results, ["n"])
    return out.select("n_nationkey", _text(F.element_at("sources", F.lit("n")), "$.name").alias("name"), F.size("sources").alias("n_sources"))


@query("SELECT n_nationkey, n_name AS a, 'x' AS b, n_regionkey AS r FROM nation")
def a05_members_at_one_place(spark, sf_dir):
    flat = F.call_function("to_variant_object", F.create_map(F.lit("f-/v[0]"), _doc(a=c("n_name"), r=c("n_regionkey")), F.lit("f-/v[1]"), _doc(b=F.lit("x"))))
    out = _resolved(read(spark, sf_dir, "nation"), "n_nationkey", {"f": flat}, [Mapping("f", "/v", ("/v",))])
    d = c("o.data")
    return out.select("n_nationkey", _text(d, "$.v[0].a").alias("a"), _text(d, "$.v[1].b").alias("b"), F.try_variant_get(d, "$.v[0].r", "int").alias("r"))


@query("SELECT n_nationkey, true AS failed, true AS lists_both FROM nation")
def m10_nothing_resolved(spark, sf_dir):
    out = _resolved(read(spark, sf_dir, "nation"), "n_nationkey", {"a": _doc(x=c("n_name"))}, [Mapping("a", "/nope", ("/q",)), Mapping("b", "/gone", ("/w",))])
    return out.select("n_nationkey", c("o.data").isNull().alias("failed"), (c("o.error").contains("/nope") & c("o.error").contains("/gone")).alias("lists_both"))


# ---- shaping


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS r, 'kept' AS old FROM nation")
def p03_merge_at_root(spark, sf_dir):
    v = paths.put(_doc(name=F.lit("gone"), old=F.lit("kept")), (), _doc(name=c("n_name"), r=c("n_regionkey")))
    return read(spark, sf_dir, "nation").select("n_nationkey", v.alias("v")).select("n_nationkey", _text("v", "$.name").alias("name"), F.try_variant_get("v", "$.r", "int").alias("r"), _text("v", "$.old").alias("old"))


@query("SELECT n_nationkey, unnest(['n-/xs/0/name', 'n-/xs/1/name', 'n-/k']) AS k, unnest([n_name, 'x', n_regionkey::VARCHAR]) AS v FROM nation")
def p07_index_in_path(spark, sf_dir):
    v = _doc(xs=F.array(F.struct(c("n_name").alias("name")), F.struct(F.lit("x").alias("name"))), k=c("n_regionkey").cast("string"))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", v.alias("v"))
    return rows.select("n_nationkey", F.explode(docs.flatten_items(c("v"), "n")).alias("e")).select("n_nationkey", c("e.key").alias("k"), _text("e.value").alias("v"))


def _flat_nation():
    return F.map_from_arrays(F.array(F.lit("n-/v[0]"), F.lit("n-/v[1]"), F.lit("n-/w"), F.lit("m-/")), F.array(*[N.variant(x) for x in (c("n_name"), F.lit("x"), c("n_regionkey"), F.lit("r"))]))


@query("SELECT n_nationkey, n_name AS v0, 'x' AS v1, n_regionkey::VARCHAR AS w1, 2 AS n_items, ['m', 'n'] AS nodes, 3 AS of_n, true AS flat FROM nation")
def p10_items_by_index(spark, sf_dir):
    m = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", _flat_nation().alias("m"))
    at = lambda key, i: _text(docs.value_at(c("m"), key, i))
    return m.select(
        "n_nationkey", at("n-/v", 0).alias("v0"), at("n-/v", 1).alias("v1"), at("n-/w", 1).alias("w1"), docs.item_count(c("m")).alias("n_items"), docs.node_ids(c("m")).alias("nodes"),
        F.size(docs.of_node(c("m"), "n")).alias("of_n"), paths.is_flat(c("m")).alias("flat"),
    )


@query("SELECT n_nationkey, n_name AS a, 'false' AS e, '' AS d, 1 AS n_left FROM nation")
def p14_no_error_defaults(spark, sf_dir):
    m = docs.no_error_defaults(F.create_map(F.lit("a"), N.variant(c("n_name"))))
    left = J.members(docs.drop_member(_doc(a=c("n_name"), xs=F.array(F.lit(1))), "xs"))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", m.alias("m"), F.size(left).alias("n_left"))
    at = lambda k: _text(F.element_at("m", F.lit(k)))
    return rows.select("n_nationkey", at("a").alias("a"), at("error").alias("e"), at("errorDescription").alias("d"), "n_left")


@query("SELECT n_nationkey, n_name AS x, 'b' AS y, CAST(NULL AS VARCHAR) AS hole, 3 AS n FROM nation")
def p12_documents_with_arrays(spark, sf_dir):
    flat = F.map_from_arrays(F.array(F.lit("n-/xs[0]/t"), F.lit("n-/xs[2]/t")), F.array(N.variant(c("n_name")), N.variant(F.lit("b"))))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.element_at(docs.documents_of(flat), "n").alias("d"))
    return rows.select("n_nationkey", _text("d", "$.xs[0].t").alias("x"), _text("d", "$.xs[2].t").alias("y"), _text("d", "$.xs[1].t").alias("hole"), F.size(J.elements(paths.get(c("d"), "/xs"))).alias("n"))


def _firsts(df: DataFrame, keys: list[str], more: list[str], value: str) -> DataFrame:
    """A value of the first row with each of the keys and more, in the order of files and of their rows; its groups by the keys alone need no other shuffle."""
    row = F.col("_metadata.row_index")
    place = row if len(df.inputFiles()) == 1 else F.struct(F.col("_metadata.file_path").alias("file"), row.alias("row"))
    rows = df.select(*keys, *more, value, place.alias("__place")).repartition(*keys)
    return rows.groupBy(*keys, *more).agg(F.min_by(value, "__place").alias(value))


@query("SELECT l_orderkey, i, f FROM (SELECT l_orderkey, max(l_linenumber) AS n, map_from_entries(list((l_linenumber, l_returnflag))) AS m FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem) GROUP BY l_orderkey), LATERAL (SELECT unnest(range(0, n + 1)) AS i), LATERAL (SELECT CASE WHEN i = 0 THEN NULL ELSE element_at(m, i::INT)[1] END AS f)")
def a02_arrays_with_holes(spark, sf_dir):
    lines = _firsts(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber"], "l_returnflag")
    rows = docs.collected(lines, ["l_orderkey"], "l_linenumber", "l_returnflag")
    return rows.select("l_orderkey", F.posexplode("items").alias("i", "f")).select("l_orderkey", c("i").cast("long").alias("i"), "f")


@query("SELECT n_nationkey, unnest(['n-/v', 'n-/v[0]', 'n-/v[1]', 'n-/w']) AS k, unnest(['[\"' || n_name || '\",\"x\"]', '\"' || n_name || '\"', '\"x\"', '1']) AS v FROM nation")
def a03_arrays_by_index(spark, sf_dir):
    m = F.map_from_arrays(F.array(F.lit("n-/v"), F.lit("n-/w")), F.array(F.array(c("n_name"), F.lit("x")).cast("variant"), N.variant(F.lit(1))))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.explode(docs.reindexed(m)).alias("k", "x"))
    return rows.select("n_nationkey", "k", F.to_json("x").alias("v"))


@query("SELECT n_nationkey, 'n' AS node_id, '/a/b' AS path, n_name AS v FROM nation")
def a04_fewest_brackets(spark, sf_dir):
    m = F.map_from_arrays(F.array(F.lit("n-/a[0]/b[0]"), F.lit("n-/a/b[0]")), F.array(N.variant(F.lit("long")), N.variant(c("n_name"))))
    rows = docs.fewest_brackets(read(spark, sf_dir, "nation").select("n_nationkey", m.alias("m")), "m", "n_nationkey")
    return rows.select("n_nationkey", "node_id", "path", _text("value").alias("v"))


# ---- schemas


def _checked(rows: DataFrame, key: str, schema: dict, **members) -> DataFrame:
    out = J.process(rows.select(key, F.to_json(F.struct(*[v.alias(k) for k, v in members.items()])).alias("j")), "j", schema, J.Options(True))
    return I.exploded(out, "errors", key).select(key, "code", "path")


@query("SELECT n_nationkey, true AS ok FROM nation")
def v03_new_uuids(spark, sf_dir):
    schema = {"type": "OBJECT", "properties": {"id": {"type": "UUID", "prefix": "a-", "postfix": "-z"}}}
    out = J.process(read(spark, sf_dir, "nation").select("n_nationkey", F.lit("{}").alias("j")), "j", schema, J.Options(True, None, True))
    return out.select("n_nationkey", F.get_json_object("data", "$.id").rlike(r"^a-[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}-z$").alias("ok"))


@query("""SELECT n_nationkey, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['INVALID_UUID'] ELSE [] END || CASE WHEN n_nationkey % 3 = 0 THEN ['MISMATCH'] ELSE [] END) AS code FROM nation""")
def v17_v18_uuid_and_own_format(spark, sf_dir):
    J.register_format("weft-capitals", lambda s: s == F.upper(s))
    schema = {"type": "OBJECT", "properties": {"id": {"type": "UUID", "prefix": "urn:"}, "n": {"type": "STRING", "validation": {"format": "weft-capitals"}}}}
    k = c("n_nationkey")
    ident = F.concat(F.lit("urn:0000"), F.lpad(k.cast("string"), 4, "0"), F.lit("-0000-"), F.when(k % 2 == 0, F.lit("0")).otherwise(F.lit("4")), F.lit("000-8000-000000000000"))
    name = F.when(k % 3 == 0, F.concat(F.lower("n_name"), F.lit("x"))).otherwise(F.upper("n_name"))
    out = _checked(read(spark, sf_dir, "nation"), "n_nationkey", schema, id=ident, n=name)
    return out.select("n_nationkey", F.replace("code", F.lit("FORMAT_"), F.lit("")).alias("code"))


@query("""SELECT conv_id, 'ENUM_MISMATCH' AS code, 'root.roles[' || (i - 1) || ']' AS path FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role FROM conversations) WHERE role <> 'user'
UNION ALL SELECT conv_id, 'MIN_ITEMS', 'root.roles' FROM conversations GROUP BY conv_id HAVING count(*) < 4""")
def v15_items(spark, sf_dir):
    schema = {"type": "OBJECT", "properties": {"roles": {"type": "ARRAY", "items": {"type": "STRING", "validation": {"enum": ["user"]}}, "validation": {"minItems": 4}}}}
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return _checked(rows, "conv_id", schema, roles=c("t.role"))


@query("""SELECT o_orderkey, true AS email, o_orderkey % 2 = 0 AS uuid, true AS date, o_orderkey % 3 <> 0 AS datetime, o_orderkey % 5 <> 0 AS uri FROM orders""")
def v09_formats(spark, sf_dir):
    k, f = c("o_orderkey"), J.FORMATS
    ident = F.concat(F.lpad(k.cast("string"), 8, "0"), F.lit("-0000-"), F.when(k % 2 == 0, F.lit("4")).otherwise(F.lit("9")), F.lit("000-8000-000000000000"))
    day, time = F.date_format(c("o_orderdate").cast("timestamp"), "yyyy-MM-dd"), F.when(k % 3 == 0, F.lit(" 10:00:00")).otherwise(F.lit("T10:00:00+02:00"))
    uri = F.concat(F.when(k % 5 == 0, F.lit("mailto:")).otherwise(F.lit("ws://")), k.cast("string"))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", f["email"](F.concat(F.lit("a.b+"), k.cast("string"), F.lit("@x-y.org"))).alias("email"), f["uuid"](ident).alias("uuid"), f["date"](day).alias("date"), f["datetime"](F.concat(day, time)).alias("datetime"), f["uri"](uri).alias("uri"),
    )


@query("SELECT event_id, event_type <> 'click' AS valid, '{\"kind\":\"' || event_type || '\",\"x\":\"d\"}' AS data FROM events")
def v22_one_half_only(spark, sf_dir):
    schema = {"type": "OBJECT", "properties": {"kind": {"type": "STRING", "validation": {"pattern": "^[^c]"}}, "x": {"type": "STRING", "default": "d"}}}
    rows = read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(c("event_type").alias("kind"), F.lit(1).alias("other"))).alias("j"))
    checked = J.validate_only(rows, "j", schema).select("event_id", "j", c("valid").alias("ok"))
    return J.transform_only(checked, "j", schema).select("event_id", c("ok").alias("valid"), "data")


@query("SELECT n_nationkey, '[{\"name\":\"' || n_name || '\",\"score\":0},{\"name\":\"N/A\",\"score\":0}]' AS data, true AS valid FROM nation")
def v26_row_defaults(spark, sf_dir):
    schema = {"columnHeaders": {"name": {"type": "STRING", "default": "N/A"}, "score": {"type": "NUMBER", "default": 0}}}
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit('[{"name":"'), c("n_name"), F.lit('","more":1},{}]')).alias("j"))
    return csv_rows.process(rows, "j", schema, J.Options(True, None, True, True)).select("n_nationkey", "data", "valid")


@query("SELECT n_nationkey, 'TYPE_MISMATCH' AS code, 'rows[1].Age' AS path FROM nation UNION ALL SELECT n_nationkey, 'MIN_LENGTH', 'rows[1].Name' FROM nation")
def o06_first_bad_row(spark, sf_dir):
    schema = {"columnHeaders": {"Name": {"type": "STRING", "validation": {"minLength": 2}}, "Age": {"type": "NUMBER"}}}
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.lit('[{"Name":"ab","Age":1},{"Name":"a","Age":"x"},{"Name":"b","Age":"y"}]').alias("j"))
    return I.exploded(csv_rows.process(rows, "j", schema), "errors", "n_nationkey").select("n_nationkey", "code", "path")


# ---- strings, dates, HL7


@query("SELECT c_custkey, c_name AS name, CAST(NULL AS VARCHAR) AS bad FROM customer")
def s16_base64_decode(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", S.base64_decode(F.base64(c("c_name").cast("binary"))).alias("name"), S.base64_decode(F.concat(c("c_name"), F.lit("%"))).alias("bad"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS r FROM orders")
def d01_invalid(spark, sf_dir):
    s = F.when(c("o_orderkey") % 2 == 0, F.concat(F.substring(_stamp(), 1, 10), F.lit("T00:00:00Z"))).otherwise(c("o_orderpriority"))
    return read(spark, sf_dir, "orders").select("o_orderkey", D.reformat(s, D.DateFormat("RFC3339", "DateOnly"))["result"].alias("r"))


_DAY = "lpad(day(o_orderdate)::VARCHAR, 2, ' ')"
for _name, _sql in {
    "UnixDate": f"strftime(o_orderdate, '%a %b ') || {_DAY} || strftime(o_orderdate, ' %H:%M:%S UTC %Y')", "RFC822": "strftime(o_orderdate, '%d %b %y %H:%M UTC')", "RFC822Z": "strftime(o_orderdate, '%d %b %y %H:%M +0000')",
    "RFC850": "strftime(o_orderdate, '%A, %d-%b-%y %H:%M:%S UTC')", "RFC1123Z": "strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000')", "Stamp": f"strftime(o_orderdate, '%b ') || {_DAY} || strftime(o_orderdate, ' %H:%M:%S')",
    "StampMilli": f"strftime(o_orderdate, '%b ') || {_DAY} || strftime(o_orderdate, ' %H:%M:%S') || '.000'", "TimeOnly": "strftime(o_orderdate, '%H:%M:%S')", "Layout": "strftime(o_orderdate, '%m/%d %I:%M:%S%p ''%y +0000')",
    "RFC3339Nano": "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')", "UTC": "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')",
}.items():
    _date(f"d06_{_name.lower()}", D.DateFormat("DateTime", _name), _stamp, _sql)
for _style, _sql in {"DD-MM-YYYY": "%d-%m-%Y", "YYYY/MM/DD": "%Y/%m/%d", "MM/DD/YYYY": "%m/%d/%Y"}.items():
    _date(f"d07_{_style.lower().replace('/', '_').replace('-', '_')}", D.DateFormat("DateTime", "DateOnly", date_style=_style), _stamp, f"strftime(o_orderdate, '{_sql}')")
for _style, _sql in {"24h-HM": "%H:%M", "12h-HM": "%I:%M %p"}.items():
    _date(f"d08_{_style.lower().replace('-', '_')}", D.DateFormat("DateTime", "DateTime", date_style="YYYY-MM-DD", time_style=_style), _stamp, f"strftime(o_orderdate, '%Y-%m-%d {_sql}')")


@query("SELECT c_custkey, c_custkey % 4 AS n_obx, 1 AS n_pid FROM customer")
def a08_instance_numbers(spark, sf_dir):
    more = F.concat(c("raw"), F.lit("\r"), F.array_join(F.array_repeat(F.lit("obx|1|ST|a||b"), (c("c_custkey") % 4).cast("int")), "\r"))
    only = _hl7_messages(spark, sf_dir).select("c_custkey", F.regexp_replace(more, r"\rOBX[^\r]*", "").alias("raw"))
    rows = hl7.parse(only.select("c_custkey", F.replace("raw", F.lit("obx"), F.lit("OBX")).alias("raw")), "raw")
    return rows.select("c_custkey", hl7.instances(c("message"), "OBX").cast("long").alias("n_obx"), hl7.instances(c("message"), "PID").cast("int").alias("n_pid"))


def _run_twice(spark: SparkSession, sf_dir: str):
    """A runner over events in two batches: clicks fail for a passing reason at their first attempt, purchases for good."""
    from weft.streaming.runner import Runner, shared_folder

    def process(df: DataFrame) -> DataFrame:
        failed = (c("event_type") == "purchase") | ((c("event_type") == "click") & (c("attempt") == 1))
        kind = F.when(c("event_type") == "click", F.lit("Internal")).otherwise(F.lit("BadRequest"))
        return df.withColumns({"output": F.create_map(F.lit("type"), c("event_type")), "failure": F.when(failed, F.lit("no")), "error_type": kind})

    runner = Runner(process, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}", "event_id")
    rows = read(spark, sf_dir, "events").select("event_id", "event_type")
    runner.write(rows, 0)
    runner.write(rows.limit(0), 1)
    return runner


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS attempt FROM events")
def t04_retried(spark, sf_dir):
    runner = _run_twice(spark, sf_dir)
    return runner.current(spark).select("event_id", "status", "attempt").unionByName(runner.current(spark, "dead_letters").select("event_id", "status", "attempt"))


@query("""SELECT 0 AS batch, count(*) AS processed, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS errors, 0 AS retried FROM events
UNION ALL SELECT 1, count(*), 0, count(*) FROM events WHERE event_type = 'click'""")
def a11_metrics(spark, sf_dir):
    m = _run_twice(spark, sf_dir).metrics(spark)
    return m.select("batch", "processed", "errors", "retried")
