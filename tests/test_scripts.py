from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.functions import nodes as N
from weft.functions import scripts as S

CASES = [
    ("({a: input.x + 1})", {"a": 3}), ("input.x * 2", 4), ("return null", None), ("return undefined", None), ("return [1,2].concat(3)", [1, 2, 3]), ("let t = 0; for (const v of input.xs) { t += v; } return {t};", {"t": 6}),
    ("return input.xs.map(v => v * 2).filter(v => v > 2).reduce((a, b) => a + b, 0)", 10), ("const [a, ...rest] = input.xs; const {x, y = 9} = input; return {a, rest, x, y}", {"a": 1, "rest": [2, 3], "x": 2, "y": 9}),
    ("return `v=${input.x > 1 ? 'big' : 'small'} ${`n${1}`}`", "v=big n1"), ("return 'a-b-c'.split('-').join('+').toUpperCase().padStart(7, '*')", "**A+B+C"), ("return 'x1y22'.replace(/\\d+/g, m => `<${m}>`)", "x<1>y<22>"),
    ("return 'John Smith'.replace(/(\\w+)\\s(\\w+)/, '$2, $1')", "Smith, John"), ("return {...input, x: 5, ['k' + 1]: true}", {"x": 5, "xs": [1, 2, 3], "k1": True}), ("function f(n, m = 2) { return n <= 1 ? 1 : n * f(n - 1); } return f(5)", 120),
    ("try { throw new Error('bad'); } catch (e) { return e.message; } finally { let z = 1; }", "bad"), ("try { null.x } catch (e) { return e instanceof TypeError }", True), ("return [3,1,2].sort((a,b) => a - b).slice(-2)", [2, 3]),
    ("const a = [1,2,3,4]; const cut = a.splice(1, 2, 9); return {a, cut}", {"a": [1, 9, 4], "cut": [2, 3]}), ("return input.no?.deep?.er ?? 'none'", "none"), ("return '5' * '2' + 1", 11), ("return '5' + 1", "51"), ("return [1 == '1', 1 === '1', null == undefined, !!'', !!'0']", [True, False, True, False, True]),
    ("return Math.max(...input.xs) + Math.round(2.5) + Math.floor(-1.5)", 4), ("return JSON.parse(JSON.stringify({a:[1,{b:null}]}))", {"a": [1, {"b": None}]}), ("return Object.entries({a:1,b:2}).map(([k, v]) => k + v)", ["a1", "b2"]),
    ("return new Date('2024-01-05T10:00:00Z').toISOString()", "2024-01-05T10:00:00.000Z"), ("let i = 0; while (true) { if (++i > 4) break; if (i % 2) continue; } return i", 5), ("switch (input.x) { case 1: return 'one'; case 2: return 'two'; default: return '?' }", "two"),
    ("return typeof nope + typeof input.x + typeof [] ", "undefinednumberobject"), ("return Object.assign({}, {a: 1}, {b: 2})", {"a": 1, "b": 2}), ("const fs = []; for (let i = 0; i < 3; i++) { fs.push(() => i); } return fs.map(f => f())", [0, 1, 2]),
    ("return (0.1 + 0.2).toFixed(2)", "0.30"), ("return Array.from(new Set([1,1,2]))", [1, 2]), ("return 'a1b2'.match(/[a-z]\\d/g)", ["a1", "b2"]), ("const o = {n: 1, inc() { return 2; }}; o.n += 4; delete o.x; return o.n + o.inc()", 7), ("return [[1,[2]],3].flat()", [1, [2], 3]),
    ("var x = 1; { let x = 2; } return x", 1), ("return (a => b => a + b)(1)(2)", 3), ("return ((a, ...r) => r.length)(1, 2, 3)", 2), ("for (const k in {a:1,b:2}) { if (k === 'b') return k; }", "b"), ("do { var z = 3 } while (false); return z", 3),
]


@pytest.mark.parametrize(("code", "want"), CASES)
def test_language(code, want):
    assert S.run_script(code, {"x": 2, "xs": [1, 2, 3]}) == want


@pytest.mark.parametrize(("code", "kind"), [("return nope", "not defined"), ("return input.a.b", "cannot read"), ("while (true) {}", "too many steps"), ("function f() { return f(); } return f()", "call stack"), ("throw new Error('own')", "own"), ("return input.x()", "not a function")])
def test_errors(code, kind, monkeypatch):
    monkeypatch.setattr(S, "MOST_STEPS", 20000)
    with pytest.raises(S.ScriptError, match=kind):
        S.run_script(code, {"x": 2})


def test_bad_scripts_are_found_early():
    for code in ("return (1", "let = 5", "a b c", "`x"):
        with pytest.raises(S.ScriptError):
            S.compile_script(code)


def test_node(spark):
    df = spark.createDataFrame([('{"a":2}',), ('{"a":null}',), ('{"input":{"a":4}}',)], "j string")
    node = N.NODES["plugin-js"](F.parse_json("j"), {"script": "if (input.a === null) throw new Error('no a'); return input.a * 2"})
    rows = df.select(node.alias("r")).select(F.to_json("r.data").alias("d"), "r.error", "r.errorDescription").collect()
    assert [r.d for r in rows] == ['{"result":4}', None, '{"result":8}'] and rows[1].error and "no a" in rows[1].errorDescription


def test_python_runs_once_a_row(spark, tmp_path):
    """However often the output is read."""
    place = str(tmp_path / "calls")

    def f(d):
        with open(place, "a") as out:
            out.write("x")
        return {"a": d["a"], "b": 1}

    node = N.python_node(f)(F.parse_json(F.concat(F.lit('{"a":'), F.col("id").cast("string"), F.lit("}"))), {})
    rows = spark.range(5).select(node.alias("o")).select(F.try_variant_get("o.data", "$.a", "int").alias("a"), F.try_variant_get("o.data", "$.b", "int").alias("b"), "o.error").collect()
    assert sorted(r.a for r in rows) == [0, 1, 2, 3, 4] and len(open(place).read()) == 5


def test_answers_are_kept_where_they_always_hold(monkeypatch):
    made = []
    monkeypatch.setattr(S.Interpreter, "run", lambda self, *a, run=S.Interpreter.run: (made.append(1), run(self, *a))[1])
    for code, runs in (("return input.x", 1), ("return Math.random()", 3), ("return Date.now() > 0", 3), ("return new Date('2024-01-05').getTime()", 1), ("throw new Error('e')", 1)):
        made.clear()
        run = N.run_python(S.script_function({"script": code}), 0).func
        out = run(pa.array(['{"x":1}', '{"x":1}', None, '{"x":1}'])).to_pylist()
        assert len(made) == runs and out[2] is None and out[0][0] in "+-"


def test_scripts_do_not_change_each_other():
    with pytest.raises(S.ScriptError):
        S.run_script("Math.PI = 3; return 1", {})
    assert S.run_script("Math = 3; NaN = 1; return Math + NaN", {}) == 4
    assert S.run_script("return Math.floor(2.5) + ':' + NaN", {}) == "2:NaN"


def test_arrays_of_documents(spark):
    """Nulls and empty arrays at each level stay what they are, in a part of a batch, too."""
    run = N.run_python(S.script_function({"script": "return input.x"}), 2)
    xs = [[['{"x":1}', None], [], None, ['{"x":2}']], None, [], [None, ['{"x":3}']]]
    want = [[['+{"result": 1}', None], [], None, ['+{"result": 2}']], None, [], [None, ['+{"result": 3}']]]
    assert run.func(pa.array(xs)).to_pylist() == want and run.func(pa.array([[["no"]], *xs]).slice(1)).to_pylist() == want
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x array<array<string>>").select("k", run("x").alias("r")).collect()
    assert [r.r for r in sorted(rows)] == want
