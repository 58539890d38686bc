from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weft import paths as P
from weft.operators import csv_rows, hl7, rules
from weft.operators import documents as D
from weft.operators import issues as I  # noqa: E741
from weft.operators import json_schema as J

SCHEMA = {
    "type": "OBJECT",
    "properties": {
        "name": {"type": "STRING", "required": True, "validation": {"minLength": 3, "maxLength": 10, "pattern": "^[a-z]+$"}},
        "country": {"type": "STRING", "default": "USA"},
        "tags": {"type": "ARRAY", "items": {"type": "STRING"}, "validation": {"uniqueItems": True}},
        "addr": {"type": "OBJECT", "properties": {"zip": {"type": "STRING", "default": "0"}}},
        "id": {"type": "UUID", "prefix": "urn:"},
    },
}


def processed(spark, texts, options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    return J.process(df, "j", SCHEMA, options).orderBy("i").collect()


def test_findings(spark):
    uuid = "550e8400-e29b-41d4-a716-446655440000"
    texts = [f'{{"name":"bob","id":"urn:{uuid}"}}', '{"name":null,"tags":["a","b","a"],"id":"x"}', '{"addr":5}', "[1]", "bad", '{"name":"ÄÄ"}']
    got = [[(e.path, e.code) for e in r.errors] for r in processed(spark, texts, J.Options(True))]
    assert got[0] == [] and got[1] == [("root.name", "REQUIRED"), ("root.tags[2]", "DUPLICATE_ITEM"), ("root.id", "INVALID_UUID")]
    assert got[2] == [("root.name", "REQUIRED"), ("root.addr", "TYPE_MISMATCH")] and got[3] == [("root", "TYPE_MISMATCH")] and got[4] == []
    assert got[5] == [("root.name", "PATTERN_MISMATCH")]  # lengths are bytes, so two letters are four


def test_defaults_and_structure(spark):
    rows = processed(spark, ['{"name":"bob","extra":1,"country":null}', "null", "[1]"], J.Options(False, None, True, True))
    first = json.loads(rows[0].data)
    assert first.pop("id").startswith("urn:") and first == {"name": "bob", "country": None, "tags": [], "addr": {"zip": "0"}}
    assert rows[2].failure and not rows[2].valid and rows[1].errors[0].code == "REQUIRED"


def test_severities_and_first(spark):
    (r,) = processed(spark, ['{"tags":["a","a"],"id":"x"}'], J.Options(True, {"REQUIRED": "WARNING", "INVALID_UUID": "DROP"}))
    assert [e.code for e in r.errors] == ["DUPLICATE_ITEM"] and [e.code for e in r.warnings] == ["REQUIRED"]
    (r,) = processed(spark, ['{"tags":["a","a"],"id":"x"}'], J.Options(False))
    assert [e.code for e in r.errors] == ["REQUIRED"]


def test_schema_is_checked():
    for bad in ({"type": "X"}, {"type": "OBJECT", "properties": {"a": {"type": "NUMBER", "validation": {"minLength": 1}}}}, {"type": "OBJECT", "properties": {"a": {"type": "UUID", "validation": {"pattern": "x"}}}}):
        with pytest.raises(ValueError):
            J.compile_schema(bad)


def test_formats_and_bytes(spark):
    names = ["user@example.com", "not-an-email", "@example.com", "550e8400-e29b-41d4-a716-446655440000", "2024-02-30", "ws://x", "2025-01-09T10:30:00Z\n"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = [[bool(x) for x in r] for r in df.select(*[J.FORMATS[k](F.col("s")) for k in ("email", "uuid", "date", "uri", "datetime")]).collect()]
    assert [[i for i, r in enumerate(got) if r[k]] for k in range(5)] == [[0], [3], [4], [5], []]


def test_summary(spark):
    issues = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: I.issue(F.concat(F.lit("p"), i.cast("string")), "m", "C"))
    text = spark.range(1).select(I.summary(issues)).first()[0]
    assert text.startswith("p1: m; p2: m") and text.endswith("p10: m ... and 2 more")


def test_rows(spark):
    text = '[{"Name":"a","Age":"invalid"},{"Name":"b","Age":3},{"Age":"x"}]'
    schema = {"columnHeaders": {"Name": {"type": "STRING", "required": True, "position": 1}, "Age": {"type": "NUMBER", "position": 0}}}
    assert list(csv_rows.compile_schema(schema).columns) == ["Age", "Name"]
    df = spark.createDataFrame([(text,)], "j string")
    assert [(e.path, e.code) for e in csv_rows.process(df, "j", schema).first().errors] == [("rows[0].Age", "TYPE_MISMATCH")]
    assert len(csv_rows.process(df, "j", schema, J.Options(True)).first().errors) == 3


DOC = '{"data":[{"name":"alice","as":[{"t":"alg","ch":[1,2]},{"t":"phy","ch":[3]}]},{"name":"bob","as":[]},5],"k":{"x":1,"y":{"z":null}},"e":[]}'


def test_paths(spark):
    v = F.parse_json(F.lit(DOC))
    show = lambda x: F.to_json(F.struct(x.alias("r")))
    want = {"/data//name": ["alice", "bob", None], "/data//as//t": [["alg", "phy"], [], None], "/e//q": [], "/k/x": 1}
    got = spark.range(1).select(*[show(P.get(v, p)) for p in want], show(P.first(v, "/data//as//t")), P.get(v, "/k//q").isNull(), F.is_variant_null(P.get(v, "/k/y/z")), P.get(v, "/nope").isNull()).first()
    assert [json.loads(x)["r"] for x in got[:4]] == list(want.values()) and json.loads(got[4])["r"] == "alg" and list(got[5:]) == [True, True, True]
    assert P.parse("//f") == P.parse("/$items//f") and P.parse("/a//b/").each and P.parse("/").whole


def test_put_flatten_truncate(spark):
    v = F.parse_json(F.lit('{"k":{"x":1},"s":5}'))
    seven = F.parse_json(F.lit("7"))
    got = spark.range(1).select(
        F.to_json(P.put(v, ("k", "a", "b"), seven)), F.to_json(P.put(v, ("s", "a"), seven)), F.to_json(D.flatten(v, "n")), F.to_json(J.truncate(v, 1)), F.to_json(D.unwrapped(F.parse_json(F.lit('[{"d":1},{"a":1,"b":2}]')))),
    ).first()
    want = [{"k": {"x": 1, "a": {"b": 7}}, "s": 5}, {"k": {"x": 1}, "s": 5}, {"n-/": {"k": {"x": 1}, "s": 5}, "n-/k/x": 1, "n-/s": 5}, {"k": {"__truncated": True}, "s": 5}, [1, {"a": 1, "b": 2}]]
    assert [json.loads(x) for x in got] == want


def test_flat_keys(spark):
    assert P.parse_flat_key(P.flat_key("n", "/a/b", (1, 2))) == ("n", "/a/b", (1, 2))
    flat = F.parse_json(F.lit('{"n-/d[0]/f[0]":1,"n-/d[0]/f[1]":2,"n-/d[1]/f[0]":3,"n-/s":9,"m-/":{"q":1},"m-/q":2}')).cast("map<string,variant>")
    got = spark.range(1).select(F.to_json(D.documents_of(flat)), D.node_ids(flat), D.item_count(flat), P.is_flat(flat)).first()
    assert json.loads(got[0]) == {"n": {"d": [{"f": [1, 2]}, {"f": [3]}], "s": 9}, "m": {"q": 1}} and list(got[1:]) == [["m", "n"], 2, True]


def test_collected_keeps_holes(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 3, "y"), ("b", 1, "z")], "k string, i int, v string")
    assert {r.k: r["items"] for r in D.collected(df, ["k"], "i", "v").collect()} == {"a": ["x", None, None, "y"], "b": [None, "z"]}


HL7 = "MSH|^~\\&|SEND|FAC|RECV|FAC|20250305120000||ADT^A01^ADT_A01|MSG001|P|2.8\rPID|||12345^^^NHS^NH~x\\T\\y|EXTRA\rOBX|1|NM|a||5\rOBX|2|NM|b||x\rZZZ|1"
HL7_SCHEMA = {
    "messageType": "ADT_A01", "version": "v2.8.0",
    "segments": [
        {"name": "MSH", "usage": "R", "rpt": "1", "fields": [{"position": "MSH.12", "usage": "R"}]},
        {"name": "PID", "usage": "R", "rpt": "1", "fields": [{"position": "PID.3", "usage": "R", "rpt": "1", "length": 5}]},
        {"name": "PV1", "usage": "R"},
        {"name": "G", "isGroup": True, "usage": "R", "rpt": "*", "segments": [{"name": "OBX", "usage": "R", "rpt": "1", "fields": [{"position": "OBX.1", "dataType": "SI"}, {"position": "OBX.5", "dataType": "NM"}]}]},
    ],
    "rules": [
        {"id": "a", "name": "A", "when": "valued('OBX-1')", "assert": "toNumber('OBX-5') > 3", "errorPath": "OBX-5"}, {"id": "b", "name": "B", "forbid": "PID-4", "severity": "WARNING"},
        {"id": "c", "name": "C", "assert": "matchesPattern('OBX-3','^[a]$') || msg('OBX-2') in ['X','Y']"}, {"id": "d", "name": "D", "assert": "toDTM('MSH-7') > timestamp('2025-01-01T00:00:00Z') && size(msg('MSH-10')) == 6"},
    ],
}


def test_hl7_findings(spark):
    df = spark.createDataFrame([(0, HL7), (1, ""), (2, "PID|x"), (3, "MSH|^~\\^|A|B"), (4, None)], "i int, raw string")
    rows = {r.i: r for r in hl7.process(df, "raw", HL7_SCHEMA).collect()}
    assert [(e.path, e.code) for e in rows[0].errors] == [
        ("PV1", "HL7_MISSING_REQUIRED"), ("PID-3", "HL7_REPETITION_VIOLATION"), ("PID-3(1)", "HL7_LENGTH"), ("PID-4", "HL7_EXTRA_FIELD"), ("OBX[2]-5", "HL7_DATATYPE"), ("OBX[2]", "HL7_CUSTOM_RULE_VIOLATION"),
    ]
    assert [(e.path, e.code) for e in rows[0].warnings] == [("PID[1]", "HL7_CUSTOM_RULE_VIOLATION"), ("OBX[2]-5", "HL7_CUSTOM_RULE_RUNTIME_ERROR")]
    assert [rows[i].errors[0].code for i in (1, 2, 3, 4)] == ["HL7_EMPTY_MESSAGE", "HL7_INVALID_MSH", "HL7_INVALID_MSH", "HL7_EMPTY_MESSAGE"]


def test_hl7_locations_and_escapes(spark):
    m = hl7.parse_message(HL7)
    places = ("PID-3(2)", "PID-3.4", "MSH-2", "MSH-9", "OBX-5", "XXX-1", "PID-99")
    assert [m.get(p) for p in places] == ["x&y", "NHS", "^~\\&", "ADT^A01^ADT_A01", "5", "", ""] and m.get("OBX-5", "OBX", 2) == "x"
    row = hl7.parse(spark.createDataFrame([(HL7,)], "raw string"), "raw").select(*[hl7.location(F.col("message"), p) for p in places]).first()
    assert list(row) == [m.get(p) for p in places]
    assert hl7.unescape(r"a\X41\b\.br\c\Zq\d\H\e\?\f", m) == "aAb\nc\\Zq\\de\\?\\f"


def test_hl7_registry():
    reg = hl7.Registry.of({"v2": {"CE": [(1, "ID"), (2, "ST")]}})
    assert reg.composite("2.5", "ce") and reg.composite("3.1", "CE") is None
    m = hl7.parse_message("MSH|^~\\&|A\rOBX|1^2^3&4")
    schema = hl7.compile_schema({"segments": [{"name": "MSH"}, {"name": "OBX", "fields": [{"position": "OBX.1", "dataType": "CE"}]}]})
    codes = [x[2] for x in hl7.field_findings(hl7.Matcher(m, schema).match(), reg, "2.5") if not x[0].startswith("MSH")]
    assert codes == ["HL7_EXTRA_COMPONENT"]


def test_scalars_native_and_python_agree(spark):
    texts = ["2024", "202402", "20240230", "20240229", "20230229", "2024022924", "202402292359", "20240229235960", "2024+1500", "2024-1300", "2024+1400", "1015", "2460", "12a", "-1.5", "", '""']
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for kind in ("DT", "DTM", "TM", "NM", "SI", "ST"):
        assert [r.k for r in df.select("v", hl7.is_scalar(F.col("v"), kind).alias("k")).collect()] == [hl7.scalar_error(kind, t) is None for t in texts], kind


def test_rule_language():
    m = hl7.parse_message(HL7)
    run = rules._Run(m, "", 1, None)
    truths = ["1 + 2 * 3 == 7", "-7 / 2 == -3", "'a' + 'b' == 'ab'", "true || toNumber('PID-9') > 1.0", "!(false && toNumber('PID-9') > 1.0)", "size('abc') > 2 ? true : false", "'x'.startsWith('x') && 'abc'.matches('b.')", "validateAs('MSH-7', 'DTM')", "int('5') in [4, 5]", "timestamp('2025-01-01T00:00:00Z') + duration('24h') < toDTM('MSH-7')"]
    assert [t for t in truths if run.truth(rules.parse(t)) is not True] == []
    for bad in ("1 +", "nope('x')", "msg(1)", "1 && true", "'a' < 3", "foo"):
        with pytest.raises(ValueError):
            rules.parse(bad)
    with pytest.raises(rules.RuleError):
        run.truth(rules.parse("toNumber('PID-9') > 1.0"))
    for bad in ([{"id": "", "name": "x", "assert": "true"}], [{"id": "a", "name": "x"}], [{"id": "a", "name": "x", "require": "bad"}], [{"id": "a", "name": "x", "assert": "1 + 1"}]):
        with pytest.raises(ValueError):
            rules.compile_rules(bad)


def test_native_rules_agree(spark):
    compiled = rules.compile_rules(HL7_SCHEMA["rules"])
    tree = hl7.parse(spark.createDataFrame([(HL7,)], "raw string"), "raw")
    want = rules.evaluate(compiled, hl7.parse_message(HL7))
    got = []
    for r in compiled[:3]:
        got += [(i.path, i.code) for i in tree.select(rules.rule_issues(r, F.col("message")).alias("x")).first().x]
    assert sorted(got) == sorted((p, c) for p, _, c, _ in want)


def test_engine_formats(spark):
    from weft.operators import engine

    df = spark.createDataFrame([('{"name":"bob"}', '[{"Age":"x"}]', HL7)], "j string, c string, h string")
    assert engine.process(df, "j", SCHEMA, "json").first().valid
    assert not engine.process(df, "c", {"columnHeaders": {"Age": {"type": "NUMBER"}}}, "CSV").first().valid
    assert engine.validate_only(df, "h", HL7_SCHEMA, "hl7", J.Options(True)).first().errors
    with pytest.raises(ValueError):
        engine.process(df, "j", SCHEMA, "xml")


def test_fewest_brackets(spark):
    flat = F.parse_json(F.lit('{"n-/a[0]/f[1]":1,"n-/a/f[1]":2,"n-/b":3}')).cast("map<string,variant>")
    got = D.fewest_brackets(spark.range(1).select("id", flat.alias("m")), "m", "id").select("path", F.to_json(F.struct("value")).alias("v")).collect()
    assert {r.path: json.loads(r.v)["value"] for r in got} == {"/a/f": 2, "/b": 3}
