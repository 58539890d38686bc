from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weft.functions import nodes as N
from weft.plans import flow, resolve
from weft.plans.flow import Mapping as M
from weft.plans.flow import NodeDef, Unit
from weft.sources import http, messages
from weft.streaming.runner import Runner, chain


def run(spark, unit, *docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").withColumn("parent", F.parse_json("j"))
    rows = flow.run_unit(df, unit).orderBy("i").select(F.to_json("output").alias("o"), F.to_json("events").alias("e"), "failure").collect()
    return [(json.loads(r.o), json.loads(r.e), r.failure) for r in rows]


COND = NodeDef("c", "plugin-simple-condition", {"manual_inputs": [{"name": "v", "operator": "greater_than", "value": "100", "type": "number"}]}, (M("p", "/value", ("/v",)),), 0, 1)
UP = NodeDef("up", "plugin-strings", {"action": "to_upper"}, (M("p", "/type", ("/value",)), M("c", "/true", kind="EVENT", trigger=True)), 1, 1)


def test_gate(spark):
    (met, _, f1), (not_met, ev, f2), (missing, _, f3), (bad, _, f4) = run(spark, Unit("p", (COND, UP)), {"value": 150, "type": "click"}, {"value": 5, "type": "x"}, {"type": "x"}, {"value": "abc", "type": "x"})
    assert met["up-/result"] == "CLICK" and "up-/result" not in not_met and not_met["c-/false/v"] == 5 and f1 is f2 is f3 is None
    assert "warning" in "".join(missing) and bad["c-/error"] is True and f4
    assert "p-/error" in ev and "p-/type" not in ev


def test_iteration_and_shared_fields(spark):
    doc = {"data": [{"name": "alice", "as": [{"t": "alg"}, {"t": "phy"}]}, 7, {"name": "bob", "as": [{"t": "his"}]}], "org": "x"}
    nodes = (
        NodeDef("n1", "plugin-strings", {"action": "to_upper"}, (M("p", "/data//name", ("/value",), iterate=True),), 0, 1),
        NodeDef("n2", "plugin-strings", {"action": "concatenate", "separator": "-"}, (M("p", "/data//as//t", ("/b",), iterate=True), M("n1", "/result", ("/a",)), M("p", "/org", ("/c",))), 1, 1),
    )
    unit = Unit("p", nodes)
    assert [len(c) for c in flow.contexts(unit).values()] == [1, 2]
    (out, _, _), (empty, _, _) = run(spark, unit, doc, {"data": [], "org": "y"})
    assert [out[k] for k in ("n1-/result[0]", "n1-/result[1]", "n2-/result[0][1]", "n2-/result[1][0]")] == ["ALICE", "BOB", "ALICE-phy-x", "BOB-his-x"]
    assert not [k for k in empty if k.startswith("n1")] and empty["p-/org"] == "y"


def test_mid_flow_iteration_over_primitives(spark):
    nodes = (
        NodeDef("s", "plugin-strings", {"action": "split", "delimiter": ","}, (M("p", "/csv", ("/value",)),), 0, 1),
        NodeDef("u", "plugin-strings", {"action": "to_upper"}, (M("s", "/result//$value", ("/value",), iterate=True),), 1, 1),
        NodeDef("j", "plugin-strings", {"action": "length"}, (M("p", "/csv", ("/value",)),), 2, 1),
    )
    ((out, _, _),) = run(spark, Unit("p", nodes), {"csv": "a,b,c"})
    assert [out[f"u-/result[{i}]"] for i in range(3)] == ["A", "B", "C"] and out["j-/result"] == 5


def test_error_section(spark):
    nodes = (
        NodeDef("d", "plugin-strings", {"action": "base64_decode"}, (M("p", "/x", ("/value",)),), 0, 1),
        NodeDef("h", "plugin-strings", {"action": "length"}, (M("d", "/errorDescription", ("/value",), section=flow.ERROR_SECTION), M("d", "/error", kind="EVENT", trigger=True)), 1, 1),
        NodeDef("k", "plugin-strings", {"action": "to_upper"}, (M("d", "/result", ("/value",)),), 1, 2),
    )
    (bad, _, f), (good, _, g) = run(spark, Unit("p", nodes), {"x": "%%%"}, {"x": "aGk="})
    assert f is None and g is None and bad["h-/result"] > 5 and "h-/result" not in good and good["k-/result"] == "HI" and "k-/result" not in bad


def test_plan_is_checked():
    bad = Unit("p", (NodeDef("a", "nope", {}, (M("x"),), 0, 1), NodeDef("a", "plugin-strings", {}, (), 0, 1)))
    assert len(bad.problems()) >= 4
    deep = "/" + "//".join("a" * 12) + "//b"
    with pytest.raises(ValueError):
        flow.contexts(Unit("p", (NodeDef("n", "plugin-strings", {}, (M("p", deep, iterate=True),)),)))


def test_json_nodes_and_python_nodes(spark):
    schema = {"type": "OBJECT", "properties": {"a": {"type": "NUMBER", "required": True}, "b": {"type": "STRING", "default": "x"}}}
    N.NODES["test-double"] = N.python_node(lambda d: d["n"] * 2)
    import base64

    enc = base64.b64encode(b'{"a":4}').decode()
    df = spark.createDataFrame([(enc,), (base64.b64encode(b"{}").decode(),)], "raw string")
    one = N.NODES["plugin-json-parse"](F.call_function("to_variant_object", F.struct(F.col("raw").alias("data"))), {"schema": schema})
    rows = df.select(one.alias("r"), F.to_json(one["data"]).alias("d")).collect()
    assert json.loads(rows[0].d) == {"a": 4, "b": "x"} and rows[1].r.error
    got = df.limit(1).select(N.NODES["test-double"](F.parse_json(F.lit('{"n":3}')), {}).alias("r")).select(F.to_json("r.data").alias("d"), "r.error").first()
    assert json.loads(got.d) == {"result": 6} and not got.error
    failed = df.limit(1).select(N.NODES["test-double"](F.parse_json(F.lit("{}")), {}).alias("r")).first().r
    assert failed.error and "KeyError" in failed.errorDescription
    del N.NODES["test-double"]


def test_python_and_script_nodes_in_units(spark):
    N.NODES["test-double"] = N.python_node(lambda d: {"n": d["n"] * 2})
    try:
        nodes = (
            NodeDef("two", "test-double", {}, (M("p", "/n", ("/n",)),), 0, 1),
            NodeDef("js", "plugin-js", {"script": "return {r: input.n + 1, xs: ['a', 'b']}"}, (M("two", "/n", ("/n",)),), 1, 1),
            NodeDef("up", "plugin-strings", {"action": "to_upper"}, (M("js", "/xs//$value", ("/value",), iterate=True),), 2, 1),
            NodeDef("no", "plugin-js", {"script": "return 1"}, (M("p", "/n", ("/n",)), M("two", "/absent", kind="EVENT", trigger=True)), 2, 2),
        )
        (good, _, f), (bad, _, g) = run(spark, Unit("p", nodes), {"n": 3}, {"n": None})
        assert good["js-/r"] == 7 and good["up-/result[1]"] == "B" and "no-/result" not in good and f is None
        assert bad["two-/error"] is True and g
    finally:
        del N.NODES["test-double"]


def test_python_and_script_nodes_inside_iterations(spark):
    N.NODES["test-double"] = N.python_node(lambda d: {"n": d["n"] * 2})
    try:
        nodes = (
            NodeDef("two", "test-double", {}, (M("p", "/xs//n", ("/n",), iterate=True),), 0, 1),
            NodeDef("c", "plugin-simple-condition", {"manual_inputs": [{"name": "v", "operator": "greater_than", "value": "3", "type": "number"}]}, (M("two", "/n", ("/v",)),), 1, 1),
            NodeDef("js", "plugin-js", {"script": "return {r: input.n + ':' + input.t}"}, (M("two", "/n", ("/n",)), M("p", "/xs//ts//t", ("/t",), iterate=True), M("c", "/true", kind="EVENT", trigger=True)), 2, 1),
            NodeDef("up", "plugin-strings", {"action": "to_upper"}, (M("js", "/r", ("/value",)),), 3, 1),
        )
        doc = {"xs": [{"n": 1, "ts": [{"t": "a"}]}, {"n": 2, "ts": [{"t": "b"}, {"t": "c"}]}, {"n": "x", "ts": []}]}
        ((out, _, f), (empty, _, g)) = run(spark, Unit("p", nodes), doc, {"xs": []})
        assert [out.get(f"two-/n[{i}]") for i in range(3)] == [2, 4, "xx"] and out["up-/result[1][0]"] == "4:B" and out["up-/result[1][1]"] == "4:C"
        assert "js-/r[0][0]" not in out and "js-/error[0][0]" not in out and not [k for k in empty if k.startswith("two")] and "can't be compared" in f and g is None
    finally:
        del N.NODES["test-double"]


def test_too_many_items_fail_the_row(spark, monkeypatch):
    monkeypatch.setattr(flow, "MOST_COMBINATIONS", 5)
    unit = Unit("p", (NodeDef("n", "plugin-strings", {"action": "to_upper"}, (M("p", "/a//b//c", ("/value",), iterate=True),), 0, 1),))
    few, many = {"a": [{"b": [{"c": "x"}] * 5}]}, {"a": [{"b": [{"c": "x"}] * 3}] * 2}
    (ok, _, f), (out, _, g) = run(spark, unit, few, many)
    assert f is None and ok["n-/result[0][4]"] == "X" and "6 items" in g and not [k for k in out if k.startswith("n-")]


def test_deep_objects_come_out_flat(spark):
    doc = {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"i": 1, "j": {}}}, "k": [{"l": 2}]}}}}}}}
    unit = Unit("p", (NodeDef("n", "plugin-simple-condition", {"manual_inputs": [{"name": "v.a.b", "operator": "is_not_empty"}]}, (M("p", "", ("/v",)),), 0, 1),))
    ((out, ev, _),) = run(spark, unit, doc)
    assert out["p-/a/b/c/d/e/f/g/h/i"] == 1 and out["p-/a/b/c/d/e/f/g/h/j"] == {} and out["p-/a/b/c/d/e/f/k"] == [{"l": 2}]
    assert out["n-/true/v/a/b/c/d/e/f/g/h/i"] == 1 and out["n-/false"] is None and set(ev) >= {"p-/error", "n-/error"} and "p-/a/b/c/d/e/f/k" not in ev


def resolved(spark, mappings, rows):
    df = spark.createDataFrame([("w", "r", n, s, json.dumps(d)) for n, s, d in rows], "workflow_id string, run_id string, node_id string, status string, j string").withColumn("data", F.parse_json("j"))
    r = resolve.documents_by_run(df).select(resolve.resolve(F.col("sources"), mappings).alias("o")).select(F.to_json("o.data").alias("d"), "o.error").first()
    return json.loads(r.d) if r.d else None, r.error


def test_resolution(spark):
    rows = [("a", "success", {"users": [{"n": "x"}, {"n": "y"}], "org": "o"}), ("b", "SUCCESS", {"ages": [1, 2], "data": {"z": 5}}), ("c", "failed", {"org": "no"}), ("f", "success", {"f-/v[0]": 1, "f-/v[1]": 2})]
    data, error = resolved(spark, [M("a", "/users//n", ("/items//name",)), M("b", "/ages", ("/items//age",), iterate=True), M("a", "/org", ("/items//org", "/top")), M("b", "/z", ("/deep/z",)), M("c", "/org", ("/q",)), M("f", "/v", ("/fv",))], rows)
    assert error is None and data == {"items": [{"name": "x", "age": 1, "org": "o"}, {"name": "y", "age": 2, "org": "o"}], "top": "o", "deep": {"z": 5}, "fv": [1, 2]}
    assert resolved(spark, [M("b", "/nope", ("/q",))], rows)[1].startswith("no field")
    three = [("a", "success", {"xs": [1, 2, 3]}), ("b", "success", {"ys": [1, 2]})]
    assert "length" in resolved(spark, [M("a", "/xs", ("/i//x",), iterate=True), M("b", "/ys", ("/i//y",), iterate=True)], three)[1]
    assert resolved(spark, [M("a", "/xs", ("/i//x",)), M("b", "/ys", ("/i//y",))], three)[0] == {"i": [{"x": 1, "y": 1}, {"x": 2, "y": 2}, {"x": 3}]}


def test_wrapped_scalars(spark):
    data = {"data": [{"data": f"EMP{i:03d}"} for i in range(100)]}
    got, _ = resolved(spark, [M("a", "/data", ("/data//employeeno",), iterate=True)], [("a", "success", data)])
    assert got["data"][99] == {"employeeno": "EMP099"} and len(got["data"]) == 100


def test_messages(spark):
    env = spark.createDataFrame([('{"workflow":{"id":"wf","run":"r1"},"node":{"id":"n"},"payload":{"inlineData":"{}"}}',), ("nope",), ('{"workflow":{"id":""}}',)], "value string")
    good, bad = messages.split_corrupt(messages.decode(env))
    assert (good.count(), bad.count()) == (2, 1)
    assert sorted(len(r[0]) for r in good.select(messages.problems(F.col("message"))).collect()) == [0, 3]
    row = env.select(messages.node_of_execution(F.lit("wf-node-1-123"), F.lit("wf")), messages.blob_path(F.lit("a/b"), F.lit(" "), F.lit("e"))).first()
    assert list(row) == ["node-1", "results/a-b/unknown-run/e.json"]


def test_payload_from_blob(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a":\n1}')
    blobs = messages.read_blobs(spark, str(tmp_path / "x.json"))
    url = blobs.first().path
    env = spark.createDataFrame([('{"payload":{"inlineData":"in"}}',), (json.dumps({"payload": {"blobReference": {"url": url}}}),), ('{"payload":{}}',)], "value string")
    got = {r.data: r.payload_error for r in messages.resolve_payload(messages.decode(env), blobs).collect()}
    assert got["in"] is None and got['{"a":\n1}'] is None and got[None]


def test_http(spark):
    df = spark.createDataFrame([("aGk=",), ("plain",)], "p string").select(http.request({"method": "post", "url": "/y", "headers": {"A": "1"}, "bearer_token": "t"}, payload=F.col("p"), base_url="http://x").alias("q"))
    import base64

    got = http.call(df, "q", lambda m, u, h, b: (404, f"{m} {u} {h['Authorization']} ".encode() + b)).collect()
    assert sorted(base64.b64decode(r.body) for r in got) == [b"POST http://x/y Bearer t hi", b"POST http://x/y Bearer t plain"] and {r.status for r in got} == {404}

    def broken(*_):
        raise OSError("down")

    assert "down" in http.call(df, "q", broken).first().http_error


def test_stream(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as string) execution_id", "id").write.parquet(f"{tmp_path}/in")

    def fail(df):
        return df.withColumn("failure", F.when(F.col("id") % 3 == 0, F.lit("bad"))).withColumn("error_type", F.when(F.col("id") == 3, F.lit("Internal")).otherwise(F.lit("BadRequest")))

    runner = Runner(chain(lambda df: df.withColumn("output", F.create_map(F.lit("v"), F.col("id"))), fail), f"{tmp_path}/out")
    stream = lambda: spark.readStream.schema("execution_id string, id long").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        runner.start(stream(), f"{tmp_path}/checkpoint").awaitTermination()
    assert {t: runner.read(spark, t).count() for t in ("results", "retries", "dead_letters", "events")} == {"results": 6, "retries": 1, "dead_letters": 3, "events": 10}
    again = runner.read(spark, "retries").drop("batch")
    assert again.first().attempt == 2
    Runner(runner.process, f"{tmp_path}/last", most=2).write(again, 7)
    assert runner.current(spark).count() == 6 and spark.read.parquet(f"{tmp_path}/last/dead_letters").count() == 1
