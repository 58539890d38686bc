"""Documents against dynamic schemas: defaults, structure and findings, on one VARIANT column.

A schema is compiled on the driver into Column expressions; nothing is collected. A
missing field and a null one differ: only missing ones are filled, and they are reported
with different messages. Findings come in the order in which the schema declares its
properties.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import bind
from weft.functions.strings import checked
from weft.operators import issues as I  # noqa: E741

TYPES = ("STRING", "NUMBER", "BOOLEAN", "OBJECT", "ARRAY", "DATE", "DATETIME", "BYTE", "ANY", "UUID")
CODES = (
    "REQUIRED", "TYPE_MISMATCH", "MIN_ITEMS", "MAX_ITEMS", "DUPLICATE_ITEM", "MIN_VALUE", "MAX_VALUE", "MIN_LENGTH", "MAX_LENGTH", "INVALID_PATTERN",
    "PATTERN_MISMATCH", "FORMAT_MISMATCH", "UNKNOWN_FORMAT", "ENUM_MISMATCH", "INVALID_UUID", "MIN_DATE", "MAX_DATE", "INVALID_BASE64",
)
#: The patterns of the named formats.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$"
URI_PREFIXES = ("http://", "https://", "ftp://", "ws://", "wss://")


def _whole(pattern: str) -> str:
    """``$`` in Java also stands before a last newline; here it is the very end."""
    return pattern[:-1] + r"\z" if pattern.endswith("$") else pattern


FORMATS: dict[str, Callable[[Column], Column]] = {
    "email": lambda s: s.rlike(_whole(EMAIL)),
    "uri": lambda s: s.rlike("^(" + "|".join(re.escape(p) for p in URI_PREFIXES) + ")"),
    "uuid": lambda s: F.lower(s).rlike(_whole(UUID)),
    "date": lambda s: s.rlike(_whole(DATE)),
    "datetime": lambda s: s.rlike(_whole(DATETIME)),
}


def register_format(name: str, check: Callable[[Column], Column]) -> None:
    """A format of one's own: a function from a text Column to a boolean one."""
    FORMATS[name] = check


@dataclass(frozen=True)
class Property:
    type: str
    required: bool = False
    default: object = None
    prefix: str = ""
    postfix: str = ""
    rules: dict = field(default_factory=dict)
    properties: dict[str, Property] | None = None
    items: Property | None = None


_TEXTUAL = ("STRING", "DATE", "DATETIME")
_RULES = {
    "minLength": (*_TEXTUAL, "BYTE"), "maxLength": (*_TEXTUAL, "BYTE"), "pattern": _TEXTUAL, "format": _TEXTUAL, "enum": _TEXTUAL,
    "minimum": ("NUMBER",), "maximum": ("NUMBER",), "minItems": ("ARRAY",), "maxItems": ("ARRAY",), "uniqueItems": ("ARRAY",), "minDate": ("DATE",), "maxDate": ("DATE",),
}
_UNSET_IF_EMPTY = ("pattern", "format", "enum", "uniqueItems")


def check_rules(rules: dict, kind: str, name: str) -> dict:
    """The rules that are set, if all go with the type."""
    out = {k: v for k, v in (rules or {}).items() if k in _RULES and v is not None and not (k in _UNSET_IF_EMPTY and not v)}
    for k, v in out.items():
        if kind not in _RULES[k]:
            raise ValueError(f"property '{name}': rule {k} does not go with type {kind}")
        if k in ("minDate", "maxDate") and v and not re.match(DATE, v):
            raise ValueError(f"property '{name}': {k} must be a date like 2024-01-31")
    if out.get("minDate") and out.get("maxDate") and out["minDate"] > out["maxDate"]:
        raise ValueError(f"property '{name}': minDate must not be after maxDate")
    return out


def _property(raw: dict, name: str) -> Property:
    kind = raw.get("type")
    if kind not in TYPES:
        raise ValueError(f"property '{name}': unknown type {kind!r}")
    props, items = raw.get("properties"), raw.get("items")
    return Property(
        kind, bool(raw.get("required")), raw.get("default"), raw.get("prefix") or "", raw.get("postfix") or "", check_rules(raw.get("validation"), kind, name),
        {k: _property(v, f"{name}.{k}") for k, v in props.items()} if props is not None else None, _property(items, f"{name}[]") if items is not None else None,
    )


def compile_schema(schema: str | dict) -> Property:
    """The root of a schema, given as JSON text or as a dict. Raises ValueError where it is no schema."""
    raw = json.loads(schema) if isinstance(schema, str) else schema
    if not isinstance(raw, dict) or raw.get("type") not in TYPES:
        raise ValueError("a schema needs a known type")
    return _property({k: raw[k] for k in ("type", "properties", "items") if k in raw}, "root")


# ---- values of a VARIANT


def kind_of(v: Column) -> Column:
    """object, array, string, number, boolean, null or other."""
    name = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    return F.when(name.isin("BIGINT", "TINYINT", "SMALLINT", "INT", "DOUBLE", "FLOAT", "DECIMAL"), F.lit("number")).when(name == "VOID", F.lit("null")).otherwise(F.lower(name))


def members(v: Column) -> Column:
    """An object's members as a map of VARIANT; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def child(v: Column, name: str) -> Column:
    """A member of an object; null for anything else, and where it is missing."""
    return F.try_variant_get(v, f"$['{name}']", "variant") if name and "'" not in name else F.element_at(members(v), F.lit(name))


def elements(v: Column) -> Column:
    """An array's elements as VARIANT; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


# ---- findings


def _string_issues(s: Column, rules: dict, path: Column) -> list[Column]:
    n = F.octet_length(s)
    pairs = []
    if "minLength" in rules:
        k = int(rules["minLength"])
        pairs.append((n < k, I.issue(path, F.concat(n.cast("string"), F.lit(f" bytes long; at least {k} are wanted")), "MIN_LENGTH")))
    if "maxLength" in rules:
        k = int(rules["maxLength"])
        pairs.append((n > k, I.issue(path, F.concat(n.cast("string"), F.lit(f" bytes long; {k} are the most")), "MAX_LENGTH")))
    if "pattern" in rules:
        try:
            ok = s.rlike(_whole(checked(rules["pattern"])))
            pairs.append((~ok, I.issue(path, f"not of the pattern {rules['pattern']}", "PATTERN_MISMATCH")))
        except ValueError as e:
            pairs.append((F.lit(True), I.issue(path, f"the schema's pattern can't be used: {e}", "INVALID_PATTERN")))
    if "format" in rules:
        name = rules["format"]
        if name in FORMATS:
            pairs.append((~FORMATS[name](s), I.issue(path, f"not of the format {name}", "FORMAT_MISMATCH")))
        else:
            pairs.append((F.lit(True), I.issue(path, f"the schema names a format that is not registered: {name}", "UNKNOWN_FORMAT")))
    if "enum" in rules:
        pairs.append((~s.isin(*rules["enum"]), I.issue(path, F.concat(s, F.lit(f" is none of {', '.join(map(str, rules['enum']))}")), "ENUM_MISMATCH")))
    return pairs


def _byte_issues(s: Column, rules: dict, path: Column) -> list:
    if not rules:
        return []
    raw = lambda x: F.when(x.rlike(r"^[A-Za-z0-9+/\r\n]*={0,2}[\r\n]*$") & (F.length(F.translate(x, "\r\n", "")) % 4 == 0), F.try_to_binary(x, F.lit("base64")))
    n = F.octet_length(F.coalesce(raw(s), raw(F.translate(s, "-_", "+/"))))
    pairs = [(n.isNull(), I.issue(path, "the text is no base64", "INVALID_BASE64"))]
    if "minLength" in rules:
        k = int(rules["minLength"])
        pairs.append((n < k, I.issue(path, F.concat(n.cast("string"), F.lit(f" bytes decoded; at least {k} are wanted")), "MIN_LENGTH")))
    if "maxLength" in rules:
        k = int(rules["maxLength"])
        pairs.append((n > k, I.issue(path, F.concat(n.cast("string"), F.lit(f" bytes decoded; {k} are the most")), "MAX_LENGTH")))
    return pairs


def _uuid_ok(s: Column, p: Property) -> Column:
    n, a, b = F.char_length(s), len(p.prefix), len(p.postfix)
    middle = s.substr(F.lit(a + 1), n - a - b)
    return s.startswith(p.prefix) & s.endswith(p.postfix) & (n >= a + b) & F.lower(middle).rlike(_whole(UUID))


def _array_issues(xs: Column, p: Property, path: Column) -> Column:
    n, pairs = F.size(xs), []
    if "minItems" in p.rules:
        k = int(p.rules["minItems"])
        pairs.append((n < k, I.issue(path, F.concat(n.cast("string"), F.lit(f" items; at least {k} are wanted")), "MIN_ITEMS")))
    if "maxItems" in p.rules:
        k = int(p.rules["maxItems"])
        pairs.append((n > k, I.issue(path, F.concat(n.cast("string"), F.lit(f" items; {k} are the most")), "MAX_ITEMS")))
    parts = [I.issues_if(*pairs)] if pairs else []
    if p.rules.get("uniqueItems"):
        printed = F.transform(xs, lambda x: F.coalesce(text_of(x), F.to_json(x), F.lit("null")))
        again = bind(printed, lambda t: F.array_min(F.filter(F.transform(t, lambda x, i: F.when(F.array_position(t, x) < i + 1, i)), lambda i: i.isNotNull())))
        parts.append(bind(again, lambda i: I.issues_if((i.isNotNull(), I.issue(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), "an item before is the same", "DUPLICATE_ITEM")))))
    if p.items is not None:
        parts.append(F.flatten(F.transform(xs, lambda x, i: value_issues(x, p.items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    return I.gathered(*parts)


def _object_issues(v: Column, p: Property, path: Column) -> Column:
    parts = []
    for name, q in (p.properties or {}).items():
        at = F.concat(path, F.lit(f".{name}"))
        missing = I.issues_if((F.lit(q.required), I.issue(at, "there is no such member, but it is required", "REQUIRED")))
        parts.append(bind(child(v, name), _member_issues(q, at, missing)))
    return I.gathered(*parts)


def _member_issues(q: Property, at: Column, missing: Column) -> Callable[[Column], Column]:
    return lambda x: F.when(x.isNull(), missing).otherwise(value_issues(x, q, at))


def value_issues(v: Column, p: Property, path: Column) -> Column:
    """Findings of a value that is there."""
    wrong = lambda want, kind: I.issues_if((F.lit(True), I.issue(path, F.concat(kind, F.lit(f" in the place of {want}")), "TYPE_MISMATCH")))
    null = I.issues_if((F.lit(p.required), I.issue(path, "null, but required", "REQUIRED")))
    if p.type == "ANY":
        return F.when(F.coalesce(F.is_variant_null(v), F.lit(True)), null).otherwise(I.none())
    if p.type in _TEXTUAL:
        want, kind = "string" if p.type == "STRING" else "string for date/datetime", "string"

        def ok(x):
            pairs = _string_issues(x, p.rules, path)
            if p.type == "DATE":
                if p.rules.get("minDate"):
                    pairs.append((x < p.rules["minDate"], I.issue(path, F.concat(x, F.lit(f" is earlier than {p.rules['minDate']}")), "MIN_DATE")))
                if p.rules.get("maxDate"):
                    pairs.append((x > p.rules["maxDate"], I.issue(path, F.concat(x, F.lit(f" is later than {p.rules['maxDate']}")), "MAX_DATE")))
            return I.issues_if(*pairs)

        inner = bind(text_of(v), ok)
    elif p.type == "NUMBER":
        want, kind = "number", "number"

        def ok(x):
            pairs = []
            show = lambda y: F.format_string("%.6f", y)
            if "minimum" in p.rules:
                k = float(p.rules["minimum"])
                pairs.append((x < k, I.issue(path, F.concat(show(x), F.lit(f" is below {k:.6f}")), "MIN_VALUE")))
            if "maximum" in p.rules:
                k = float(p.rules["maximum"])
                pairs.append((x > k, I.issue(path, F.concat(show(x), F.lit(f" is above {k:.6f}")), "MAX_VALUE")))
            return I.issues_if(*pairs)

        inner = bind(F.try_variant_get(v, "$", "double"), ok)
    elif p.type == "BOOLEAN":
        want, kind, inner = "boolean", "boolean", I.none()
    elif p.type == "BYTE":
        want, kind = "string or bytes", "string"
        inner = bind(text_of(v), lambda x: I.issues_if(*_byte_issues(x, p.rules, path)))
    elif p.type == "UUID":
        want, kind = "string for UUID", "string"
        inner = bind(text_of(v), lambda x: I.issues_if((~_uuid_ok(x, p), I.issue(path, "value is no valid UUID", "INVALID_UUID"))))
    elif p.type == "ARRAY":
        want, kind = "array", "array"
        inner = bind(elements(v), lambda x: _array_issues(x, p, path))
    else:
        want, kind = "object", "object"
        inner = _object_issues(v, p, path)
    return bind(
        F.when(F.coalesce(F.is_variant_null(v), F.lit(True)), F.lit("null")).otherwise(kind_of(v)),
        lambda k: F.when(k == "null", null).when(k == kind, inner).otherwise(wrong(want, k)),
    )


def validate(v: Column, schema: Property, collect_all: bool = True, root: str = "root") -> Column:
    """The findings of a document; without ``collect_all`` the first only."""
    out = value_issues(v, schema, F.lit(root))
    return out if collect_all else I.first_only(out)


# ---- defaults and structure


def _variant(value: object) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def _put(m: Column, name: str, value: Column) -> Column:
    """The map with the member set: not twice, whatever the session says about equal keys."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != name), F.create_map(F.lit(name), value))


def _empty_map() -> Column:
    return F.create_map().cast("map<string,variant>")


def _to_object(m: Column) -> Column:
    return F.call_function("to_variant_object", m)


def _to_array(xs: Column) -> Column:
    return F.call_function("to_variant_object", xs)


def _has_default(p: Property) -> bool:
    return p.type == "OBJECT" and any(q.default is not None or q.type == "UUID" or _has_default(q) for q in (p.properties or {}).values())


def _filler(name: str, p: Property, new: Column | None, nested: bool) -> Callable[[Column], Column]:
    """A step over an object's members: a nested value is filled, a missing one gets ``new``."""

    def step(m: Column) -> Column:
        has, out = F.map_contains_key(m, F.lit(name)), m
        if nested:
            out = F.when(has, _put(m, name, bind(F.element_at(m, F.lit(name)), lambda v: apply_defaults(v, p)))).otherwise(out)
        if new is not None:
            out = F.when(~has, _put(m, name, new)).otherwise(out)
        return out

    return step


def _filled(m: Column, p: Property) -> Column:
    for name, q in (p.properties or {}).items():
        nested = (q.type == "OBJECT" and q.properties is not None) or (q.type == "ARRAY" and q.items is not None)
        if q.default is not None:
            new = _variant(q.default)
        elif q.type == "UUID":
            new = F.call_function("to_variant_object", F.array(F.concat(F.lit(q.prefix), F.uuid(), F.lit(q.postfix))))
            new = F.get(elements(new), F.lit(0))
        elif _has_default(q):
            new = _to_object(_filled(_empty_map(), q))
        else:
            new = None
        if new is not None or nested:
            m = bind(m, _filler(name, q, new, nested))
    return m


def apply_defaults(v: Column, p: Property) -> Column:
    """Missing members filled from the schema, in objects and arrays at any depth; nulls stay."""
    if p.type == "OBJECT":
        return bind(F.coalesce(members(v), _empty_map()), lambda m: _to_object(_filled(m, p)))
    if p.type == "ARRAY" and p.items is not None and p.items.type in ("OBJECT", "ARRAY"):
        return bind(elements(v), lambda xs: F.when(xs.isNull(), v).otherwise(_to_array(F.transform(xs, lambda x: apply_defaults(x, p.items)))))
    return v


def _structurer(p: Property) -> Callable[[Column], Column]:
    return lambda v: structure(v, p)


def _structured(m: Column, p: Property) -> Column:
    parts = []
    for name, q in p.properties.items():
        value = F.element_at(m, F.lit(name))
        nested = (q.type == "OBJECT" and q.properties is not None) or (q.type == "ARRAY" and q.items is not None)
        there = bind(value, _structurer(q)) if nested else value
        if q.type == "ARRAY" and q.items is not None:
            absent = _variant([])
        elif q.type == "OBJECT" and q.properties is not None:
            absent = bind(_structured(_empty_map(), q), lambda x: F.when(F.size(x) > 0, _to_object(x)))
        else:
            absent = F.lit(None).cast("variant")
        parts.append(F.struct(F.lit(name).alias("key"), F.when(F.map_contains_key(m, F.lit(name)), there).otherwise(absent).alias("value")))
    if not parts:
        return _empty_map()
    return F.map_from_entries(F.filter(F.array(*parts), lambda e: e["value"].isNotNull()))


def structure(v: Column, p: Property) -> Column:
    """Only what the schema names, with empty objects and arrays made; null if the value is of the wrong shape."""
    if p.type == "OBJECT":
        if p.properties is None:
            return F.when(members(v).isNotNull(), v)
        return bind(members(v), lambda m: F.when(m.isNotNull(), _to_object(_structured(m, p))))
    if p.type == "ARRAY":
        if p.items is None:
            return F.when(elements(v).isNotNull(), v)
        return bind(elements(v), lambda xs: F.when(xs.isNotNull(), _to_array(F.transform(xs, lambda x: F.coalesce(structure(x, p.items), x)))))
    return v


def truncate(v: Column, level: int) -> Column:
    """Below ``level`` objects become {"__truncated": true} and arrays ["__truncated"]; 0 and less change nothing."""
    from weft.operators.documents import truncate_udf

    return v if level <= 0 else F.parse_json(truncate_udf(level)(F.to_json(v)))


@dataclass(frozen=True)
class Options:
    collect_all: bool = False
    severity: dict[str, str] | None = None
    apply_defaults: bool = False
    structure: bool = False


def process(df: DataFrame, column: str, schema: str | dict | Property, options: Options = Options(), hard: bool = False) -> DataFrame:
    """Adds ``data`` (JSON text), ``errors``, ``warnings``, ``infos``, ``valid`` and ``failure``.

    ``failure`` is a text where the document is no JSON or not of the root's shape; with ``hard`` a bad text ends the job.
    """
    p = schema if isinstance(schema, Property) else compile_schema(schema)
    read = F.parse_json(column) if hard else F.try_parse_json(column)
    out = df.withColumn("__v", read)
    shape = {"OBJECT": "object", "ARRAY": "array"}.get(p.type)
    kind = F.when(F.col("__v").isNull(), F.lit(None).cast("string")).when(F.is_variant_null("__v"), F.lit("null")).otherwise(kind_of(F.col("__v")))
    out = out.withColumn("__k", kind)
    failure = F.when(F.col("__k").isNull(), F.lit("invalid JSON"))
    v = F.col("__v")
    if options.apply_defaults or options.structure:
        if shape:
            failure = F.coalesce(failure, F.when(~F.col("__k").isin(shape, "null"), F.concat(F.lit(f"schema type is {p.type} but data is "), F.col("__k"))))
            v = F.when(F.col("__k") == "null", _variant([] if shape == "array" else {})).otherwise(v)
    out = out.withColumn("failure", failure).withColumn("__v", F.when(failure.isNull(), v))
    if options.apply_defaults:
        out = out.withColumn("__v", F.when(F.col("__v").isNotNull(), apply_defaults(F.col("__v"), p)))
    if options.structure:
        out = out.withColumn("__v", F.when(F.col("__v").isNotNull(), structure(F.col("__v"), p)))
    found = F.when(F.col("__v").isNotNull(), validate(F.col("__v"), p, options.collect_all)).otherwise(I.none())
    out = out.withColumn("__b", I.bucketed(found, options.severity))
    return out.select(
        *df.columns, F.to_json("__v").alias("data"), F.col("__b.errors").alias("errors"), F.col("__b.warnings").alias("warnings"), F.col("__b.infos").alias("infos"),
        (F.col("__b.valid") & F.col("failure").isNull()).alias("valid"), "failure",
    )


def validate_only(df: DataFrame, column: str, schema, options: Options = Options()) -> DataFrame:
    return process(df, column, schema, Options(options.collect_all, options.severity)).drop("data")


def transform_only(df: DataFrame, column: str, schema) -> DataFrame:
    """Defaults and structure; findings don't matter."""
    return process(df, column, schema, Options(True, None, True, True)).drop("errors", "warnings", "infos", "valid")
