"""Node types: from an input document and settings to an output document or an error.

A node is a function of (input VARIANT, settings) that gives a struct (data, error,
errorDescription). ``register`` adds one's own under a plug-in type; a Python function
over documents can be wrapped with ``python_node``. A ``shaped`` node reads the members
it needs from an ``Input`` and gives members of known types, so that values pass from
node to node without a VARIANT in between.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft import paths
from weft.functions import bind, conditions, dates, strings
from weft.functions.inputs import Input, Made, Value, null
from weft.operators import issues as I  # noqa: E741
from weft.operators import json_schema as J

Node = Callable[[Column, dict], Column]
MOST_KEPT, LONGEST_KEPT = 10_000, 1000
NODES: dict[str, Node] = {}


def register(kind: str) -> Callable[[Node], Node]:
    def put(f: Node) -> Node:
        NODES[kind] = f
        return f

    return put


def shaped(kind: str, prepare: Callable[[Input, dict], Column] | None = None) -> Callable[[Callable], Node]:
    """Registers a function of (Input, settings, prepared) to ``Made``; ``prepare`` makes what it uses more than once.

    As a node it can be used on a VARIANT column, too.
    """

    def put(make: Callable[[Input, dict, Column | None], Made]) -> Node:
        def node(v: Column, settings: dict) -> Column:
            given = Input(v)
            whole = lambda p: result(*_document_of(make(given, settings, p)))
            return whole(None) if prepare is None else bind(prepare(given, settings), whole)

        node.make, node.prepare = make, prepare
        NODES[kind] = node
        return node

    return put


def _document_of(made: Made) -> tuple[Column, Column | None]:
    pairs = [F.when(x.col.isNotNull() if k in made.optional else F.lit(True), F.struct(F.lit(k).alias("key"), F.coalesce(x.variant(), null()).alias("value"))) for k, x in made.members.items()]
    return J._to_object(F.map_from_entries(F.filter(F.array(*pairs), lambda e: e.isNotNull()))), made.error


def result(data: Column, error: Column | None = None) -> Column:
    """``error`` is a text, null where all went well."""
    error = F.lit(None).cast("string") if error is None else error
    return F.struct(F.when(error.isNull(), data).alias("data"), error.isNotNull().alias("error"), F.coalesce(error, F.lit("")).alias("errorDescription"))


def document(**members: Column) -> Column:
    """An object of VARIANT members; a null one is a JSON null."""
    if not members:
        return J._to_object(J._empty_map())
    return J._to_object(F.map_from_arrays(F.array(*[F.lit(k) for k in members]), F.array(*[F.coalesce(v, null()) for v in members.values()])))


def variant(x: Column) -> Column:
    """A scalar Column, or an array of them, as VARIANT; a null is a JSON null."""
    return F.coalesce(x.cast("variant"), null())


def normalized_settings(raw: dict) -> dict:
    """Flat settings, with ``nodeSchema`` entries over them; empty values don't overwrite."""
    out = {k: v for k, v in raw.items() if k != "nodeSchema"}
    for e in raw.get("nodeSchema") or ():
        if e.get("key") and e.get("value") not in (None, "", [], {}):
            out[e["key"]] = e["value"]
    return out


#: Types of the results of string actions other than text.
_KINDS = {"split": "array<string>", "contains": "boolean", "length": "int", "regex_extract": "array<array<string>>"}


def _texts(v: Input) -> Column:
    """All texts among the members, by name."""
    known = v.values()
    if known is None:
        each = F.transform(F.map_values(J.members(v.whole)), lambda x: Value(x).text())
        return F.filter(each, lambda x: x.isNotNull())
    return F.filter(F.array(*[x.text() for _, x in known]).cast("array<string>"), lambda x: x.isNotNull())


def _formatted(v: Input, template: str) -> Column:
    known = v.values()
    put = lambda acc, k, x: F.replace(F.replace(acc, F.concat(F.lit("${"), k, F.lit("}")), F.coalesce(x, F.lit(""))), F.concat(F.lit("{"), k, F.lit("}")), F.coalesce(x, F.lit("")))
    if known is None:
        return F.aggregate(F.map_entries(J.members(v.whole)), F.lit(template), lambda acc, e: put(acc, e["key"], J.text_of(e["value"])))
    out = F.lit(template)
    for k, x in known:
        out = put(out, F.lit(k), x.printed()) if x.kind != "variant" else F.when(x.col.isNull(), out).otherwise(put(out, F.lit(k), x.printed()))
    return out


@shaped("plugin-strings")
def strings_node(v: Input, settings: dict, _: Column | None = None) -> Made:
    action = settings.get("action")
    if action not in strings.ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    params = {k: x for k, x in settings.items() if k not in ("action", "manual_inputs", "label", "params")} | (settings.get("params") or {})
    inputs = {"value": v.at("value").text(), "string": v.at("string").text()}
    if action == "concatenate" and "parts" not in params or action == "join" and "items" not in params:
        # All text members, by name; an array of texts under "items" comes first for join.
        every = _texts(v)
        if action == "join":
            every = F.coalesce(F.filter(F.transform(J.elements(v.at("items").variant()), J.text_of), lambda x: x.isNotNull()), every)
        out = F.array_join(every, params.get("separator", ""))
    elif action == "format" and not params.get("data"):
        out = _formatted(v, params.get("template", ""))
    else:
        out = strings.ACTIONS[action](params, inputs)
    failed = F.when(out.isNull(), F.lit(f"{action}: input can't be decoded")) if action in ("base64_decode", "uri_decode") else None
    return Made({"result": Value(out, _KINDS.get(action, "string"))}, failed)


def _reformatted(v: Input, settings: dict) -> Column:
    names = ("in_format", "out_format", "in_timezone", "out_timezone", "date_style", "time_style")
    return dates.reformat(J.text_of(v.at("date").variant()), dates.DateFormat(*[settings.get(k) or "" for k in names]))


@shaped("plugin-date-formatter", _reformatted)
def date_node(v: Input, settings: dict, r: Column | None) -> Made:
    kind = F.coalesce(J.kind_of(v.at("date").variant()), F.lit("null"))
    wrong = F.when(~kind.isin("string", "null"), F.concat(F.lit("date: expected string, got "), kind))
    return Made({"result": Value(r["result"], "string")}, F.coalesce(wrong, r["error"]))


def _condition(c: conditions.Condition, x: Column) -> Column:
    """The struct (met, warning, error) of a condition on a VARIANT value."""
    if c.operator in ("greater_than", "less_than", "greater_than_or_equal", "less_than_or_equal"):
        a = F.when(F.schema_of_variant(x) != "BOOLEAN", F.try_variant_get(x, "$", "double"))
        return conditions.evaluate(c, a, T.DoubleType(), x.isNotNull())
    kind = F.coalesce(J.kind_of(x), F.lit("null"))
    if c.operator in ("is_empty", "is_not_empty"):
        empty = (
            F.when(kind == "null", F.lit(True)).when(kind == "string", J.text_of(x) == "").when(kind == "number", F.try_variant_get(x, "$", "double") == 0)
            .when(kind == "boolean", ~F.try_variant_get(x, "$", "boolean")).when(kind == "array", F.size(J.elements(x)) == 0).otherwise(F.lit(False))
        )
        return conditions._out(empty if c.operator == "is_empty" else ~empty)

    def text(k: Column) -> Column:
        said = F.when(k.isin("object", "array"), F.to_json(x)).when(k == "number", conditions._plain(J.text_of(x))).otherwise(F.coalesce(J.text_of(x), F.lit("")))
        return conditions.evaluate(c, F.when(k != "null", said), T.StringType(), x.isNotNull())

    return bind(kind, text)


def _routed(v: Input, settings: dict) -> Column:
    raw = settings.get("manual_inputs") or []
    parts = [conditions.Condition(r["name"], r["operator"], r.get("value", ""), r.get("type") or "string") for r in raw]
    return conditions.combine([_condition(c, v.at(*c.path).variant()) for c in parts], settings.get("logic_operator") or "AND")


@shaped("plugin-simple-condition", _routed)
def condition_node(v: Input, settings: dict, r: Column | None) -> Made:
    whole = v.column()
    to = lambda side: Value(F.when(F.coalesce(side, F.lit(False)), whole).otherwise(null()))
    return Made({"false": to(~r["route"]), "true": to(r["route"]), "warning": Value(r["warning"], "string")}, r["error"], ("warning",))


def _schema_of(settings: dict) -> J.Property | None:
    raw = settings.get("schema")
    return J.compile_schema(raw) if raw else None


@register("plugin-json-parse")
def json_parse_node(v: Column, settings: dict) -> Column:
    """``data``: base64 of JSON, or an object; filled from the schema and checked."""
    schema = _schema_of(settings)
    strict = settings.get("strict", True)
    x = paths.member(v, "data")
    decoded = F.try_parse_json(strings.base64_decode(J.text_of(x)))

    def checked(d: Column) -> Column:
        if schema is None:
            return result(d, F.when(d.isNull(), F.lit("data is no JSON document")))
        filled = J.apply_defaults(d, schema)
        return bind(filled, lambda f: _checked(f, schema, strict, F.when(d.isNull(), F.lit("data is no JSON document"))))

    return bind(F.when(J.kind_of(x) == "string", decoded).otherwise(x), checked)


def _checked(v: Column, schema: J.Property, strict: bool, failed: Column) -> Column:
    if not strict:
        return result(v, failed)
    found = J.validate(v, schema)
    return bind(found, lambda xs: result(v, F.coalesce(failed, F.when(F.size(xs) > 0, I.summary(xs)))))


@register("plugin-json-produce")
def json_produce_node(v: Column, settings: dict) -> Column:
    """The input, or its only array if the schema's root is one; checked, structured, as base64 under ``encoded``."""
    schema = _schema_of(settings)
    source = v
    if schema is not None and schema.type == "ARRAY":
        source = bind(F.filter(F.map_values(J.members(v)), lambda x: J.elements(x).isNotNull()), lambda xs: F.when(F.size(xs) == 1, F.get(xs, F.lit(0))).otherwise(v))

    def written(x: Column) -> Column:
        text = F.to_json(x, {"pretty": "true"}) if settings.get("pretty") else F.to_json(x)
        return document(encoded=variant(strings.base64_encode(text)))

    if schema is None:
        return bind(source, lambda x: result(written(x)))
    return bind(source, lambda x: bind(J.validate(x, schema), lambda xs: result(written(F.coalesce(J.structure(x, schema), x)), F.when(F.size(xs) > 0, I.summary(xs)) if settings.get("strict", True) else None)))


@register("plugin-error")
def error_node(v: Column, settings: dict) -> Column:
    said = F.coalesce(F.nullif(J.text_of(paths.member(v, "message")), F.lit("")), F.nullif(F.lit(settings.get("message") or settings.get("default_message") or ""), F.lit("")), F.lit("error node reached"))
    return result(document(), said)


def python_node(f: Callable[[dict], object]) -> Node:
    """A node from a Python function over documents, in Arrow batches.

    A result that is no object is wrapped as ``result``; None is the empty object; an exception is the node's error.
    An input whose only member is ``input`` is handed over as that member. In a unit such a node can stand inside
    iterations: it is then run on arrays of documents, item by item.
    """

    def node(v: Column, settings: dict) -> Column:
        return bind(run_python(f, 0)(F.to_json(v)), answered)  # once: every mention of the call would run it again

    node.function = f
    return node


def answered(said: Column) -> Column:
    """What a Python function said as (data, error, errorDescription)."""
    return result(F.parse_json(F.when(said.startswith("+"), said.substr(F.lit(2), F.length(said)))), F.when(said.startswith("-"), said.substr(F.lit(2), F.length(said))))


def run_python(f: Callable[[dict], object], levels: int):
    """A function from texts of JSON, in arrays of so many levels, to ``+`` and JSON or ``-`` and an error; a null stays one.

    Where the function says that its run was ``steady``, the answer to a short text is kept for the same text.
    """
    kept: dict[str, str] = {}

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        if (said := kept.get(text)) is not None:
            return said
        said = run_one(text)
        if getattr(f, "steady", False) and len(kept) < MOST_KEPT and len(text) + len(said) < LONGEST_KEPT:
            kept[text] = said
        return said

    def run_one(text: str) -> str:
        doc = json.loads(text)
        if isinstance(doc, dict) and list(doc) == ["input"]:
            doc = doc["input"]
        try:
            out = f(doc)
            return "+" + json.dumps({} if out is None else out if isinstance(out, dict) else {"result": out})
        except Exception as e:  # noqa: BLE001  any failure of a user's code is data here
            return f"-{type(e).__name__}: {e}"

    def each(x: pa.Array, depth: int) -> pa.Array:
        if not depth:
            return pa.array([one(y) for y in x.to_pylist()], pa.string())
        ends = np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        starts = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pa.ListArray.from_arrays(starts, each(x.flatten(), depth - 1), mask=x.is_null())

    kind = "array<" * levels + "string" + ">" * levels

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return each(texts, levels)

    return run.asNondeterministic()  # so it stays in a projection of its own, and user code need not repeat itself
