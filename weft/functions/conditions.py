"""Comparisons of a document's fields, with three outcomes: met, not met, or a warning, and errors as values.

A condition node does not drop rows: it routes them. The result is a struct of
``route`` (true, false, or null with a warning or an error), ``warning`` and ``error``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.strings import checked

_ALL = frozenset("string number boolean event".split())
_ORDERED = frozenset("string number".split())
_TEXT = frozenset(["string"])
OPERATORS = {
    "equals": _ALL, "not_equals": _ALL, "is_empty": _ALL, "is_not_empty": _ALL,
    "greater_than": _ORDERED, "less_than": _ORDERED, "greater_than_or_equal": _ORDERED, "less_than_or_equal": _ORDERED,
    "contains": _TEXT, "not_contains": _TEXT, "starts_with": _TEXT, "ends_with": _TEXT, "regex": _TEXT,
}
TRUE_TEXTS, FALSE_TEXTS = ("true", "True", "TRUE", "1"), ("false", "False", "FALSE", "0")


def canonical(x: Column, kind: T.DataType | None = None) -> Column:
    """The text form of a value: numbers without exponent and with the fewest digits, booleans as true and false,
    a null empty, structures as JSON."""
    if kind is None or isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(_plain(x.cast("string")), F.lit(""))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.to_json(x), F.lit(""))
    return F.coalesce(x.cast("string"), F.lit(""))


def _plain(s: Column) -> Column:
    """A printed double without exponent or trailing zeros; other texts stay."""
    exact = F.coalesce(F.regexp_replace(s.try_cast("decimal(38,17)").cast("string"), r"\.?0+$", ""), s.try_cast("decimal(38,0)").cast("string"))
    return F.when(s.rlike(r"^-?\d+(\.\d+)?E-?\d+$"), F.coalesce(exact, s)).when(s.rlike(r"^-?\d+\.0+$"), F.regexp_replace(s, r"\.0+$", "")).otherwise(s)


@dataclass(frozen=True)
class Condition:
    """One input of a condition node; ``name`` is a path in dots or slashes."""

    name: str
    operator: str
    value: object = ""
    kind: str = "string"

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}")
        if self.kind not in _ALL:
            raise ValueError(f"unknown type {self.kind!r}")
        if self.kind not in OPERATORS[self.operator]:
            raise ValueError(f"operator {self.operator!r} does not go with type {self.kind!r}")
        if self.operator == "regex":
            checked(self.text)
        if self.operator not in ("is_empty", "is_not_empty"):
            self.expected  # noqa: B018  raises for a value that is not of the type

    @property
    def text(self) -> str:
        """The value as text; earlier settings may hold a boolean, a number or nothing."""
        v = self.value
        if v is None:
            return ""
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float) and v.is_integer():
            return str(int(v))
        return str(v)

    @property
    def expected(self) -> str | float | bool:
        if self.kind == "number":
            return float(self.text)
        if self.kind in ("boolean", "event"):
            if self.text in TRUE_TEXTS:
                return True
            if self.text in FALSE_TEXTS:
                return False
            raise ValueError(f"{self.text!r} is no boolean")
        return self.text

    @property
    def path(self) -> tuple[str, ...]:
        return tuple(x for x in self.name.removeprefix("/").replace("/", ".").split(".") if x)


def _out(met: Column, warning: Column | None = None, error: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(met.cast("boolean").alias("met"), (none if warning is None else warning).alias("warning"), (none if error is None else error).alias("error"))


def _number_text(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e21 else format(x, ".17g") if "e" in repr(x) else repr(x)


def is_empty(x: Column, kind: T.DataType) -> Column:
    """Null, the empty text, zero, false and the empty array are empty; structures are not."""
    if isinstance(kind, T.StringType):
        return x.isNull() | (x == "")
    if isinstance(kind, T.BooleanType):
        return x.isNull() | ~x
    if isinstance(kind, T.ArrayType):
        return x.isNull() | (F.size(x) == 0)
    if isinstance(kind, T.NumericType):
        return x.isNull() | (x == 0)
    return x.isNull()


def evaluate(c: Condition, actual: Column, kind: T.DataType, present: Column | None = None) -> Column:
    """The struct (met, warning, error) of one condition. ``present`` tells a missing field from a null one."""
    present = F.lit(True) if present is None else present
    if c.operator in ("is_empty", "is_not_empty"):
        empty = F.when(present, is_empty(actual, kind)).otherwise(F.lit(True))
        return _out(empty if c.operator == "is_empty" else ~empty)
    missing_met = F.lit(c.operator == "equals" and c.text == "")
    warning = F.when(~present & ~missing_met, F.lit(f"field '{'.'.join(c.path)}' not found in input"))
    text = canonical(actual, kind)
    want = c.expected
    want_text = _number_text(want) if isinstance(want, float) else ("true" if want else "false") if isinstance(want, bool) else want
    error = F.lit(None).cast("string")
    if c.operator in ("equals", "not_equals"):
        same = actual.isNotNull() & (text == want_text)
        met = same if c.operator == "equals" else ~same
    elif c.operator in ("contains", "not_contains"):
        met = text.contains(want_text)
        met = met if c.operator == "contains" else ~met
    elif c.operator == "starts_with":
        met = text.startswith(want_text)
    elif c.operator == "ends_with":
        met = text.endswith(want_text)
    elif c.operator == "regex":
        met = text.rlike(checked(want_text))
    else:
        a = actual.try_cast("double") if isinstance(kind, (T.StringType, T.NumericType)) else F.lit(None).cast("double")
        try:
            b = float(want)
        except ValueError:
            b = None
        met = {"greater_than": a > b, "less_than": a < b, "greater_than_or_equal": a >= b, "less_than_or_equal": a <= b}[c.operator] if b is not None else F.lit(None)
        bad = a.isNull() if b is not None else F.lit(True)
        error = F.when(present & bad, F.lit(f"'{'.'.join(c.path)}' can't be compared as a number"))
        met = F.when(~bad, met)
    return _out(F.when(present, met).otherwise(F.when(missing_met, F.lit(True))), warning, error)


def combine(results: list[Column], logic: str = "AND") -> Column:
    """Struct (route, warning, error): warnings null the route, an error stands before all; no condition is not met."""
    if logic not in ("AND", "OR"):
        raise ValueError(f"unknown logic {logic!r}")
    if not results:
        return F.struct(F.lit(False).alias("route"), F.lit(None).cast("string").alias("warning"), F.lit(None).cast("string").alias("error"))
    met = results[0]["met"]
    for r in results[1:]:
        met = (met & r["met"]) if logic == "AND" else (met | r["met"])
    warning = F.nullif(F.concat_ws(" ", *[r["warning"] for r in results]), F.lit(""))
    error = F.coalesce(*[r["error"] for r in results])
    return F.struct(F.when(warning.isNull() & error.isNull(), met).alias("route"), F.when(error.isNull(), warning).alias("warning"), error.alias("error"))


def node(schema: T.StructType, conditions: list[Condition], logic: str = "AND") -> Column:
    """The route struct of a row with this schema; a path that the schema lacks is a missing field."""
    out = []
    for c in conditions:
        kind, col, at = schema, None, 0
        for name in c.path:
            if not isinstance(kind, T.StructType) or name not in kind.names:
                break
            kind, col, at = kind[name].dataType, F.col(f"`{name}`") if col is None else col.getField(name), at + 1
        found = at == len(c.path) and at > 0
        out.append(evaluate(c, col if found else F.lit(None).cast("string"), kind if found else T.StringType(), F.lit(found)))
    return combine(out, logic)
