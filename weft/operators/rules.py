"""Boolean rules over HL7 messages: a small expression language, compiled once and run per segment instance.

Supported: literals, lists, ``! - * / % + < <= > >= == != in && || ?:``, member calls
(``size startsWith endsWith contains matches``), ``string int double bool timestamp
duration size`` and the message functions ``msg valued validateAs matchesPattern toDTM
toNumber``. As in the language's definition, ``&&`` and ``||`` don't mind an error on one
side if the other decides.

``native`` turns an expression into a Column over a parsed tree; ``evaluate`` runs rules
inside the batch function that parses messages anyway. Patterns have no time limit.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.operators import hl7

VIOLATION, RUNTIME_ERROR = "HL7_CUSTOM_RULE_VIOLATION", "HL7_CUSTOM_RULE_RUNTIME_ERROR"
_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[uU]?|0x[0-9a-fA-F]+)|(?P<str>[rR]?(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'))|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||[<>=!]=|[-+*/%<>!?:.,()\[\]]))"""
)
_BINARY = {"?": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "in": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
#: Function name to the types of its result; None where it depends on the arguments.
FUNCTIONS = {
    "msg": "string", "valued": "bool", "validateAs": "bool", "matchesPattern": "bool", "toDTM": "timestamp", "toNumber": "double", "size": "int", "startsWith": "bool",
    "endsWith": "bool", "contains": "bool", "matches": "bool", "string": "string", "int": "int", "double": "double", "bool": "bool", "timestamp": "timestamp", "duration": "duration",
}
_ARITY = {"msg": 1, "valued": 1, "validateAs": 2, "matchesPattern": 2, "toDTM": 1, "toNumber": 1}


class RuleError(Exception):
    """A rule can't be evaluated on this message."""


# ---- reading


class _Reader:
    def __init__(self, text: str):
        self.items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:at + 10]!r} in {text!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.items.append(("end", ""))
        self.at, self.text = 0, text

    def peek(self) -> str:
        kind, value = self.items[self.at]
        return value if kind in ("op", "name") else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        kind, value = self.items[self.at]
        if want is not None and value != want:
            raise ValueError(f"expected {want!r} but found {value or 'the end'!r} in {self.text!r}")
        self.at += 1
        return kind, value

    def expression(self, least: int = 1):
        left = self.unary()
        while (op := self.peek()) in _BINARY and _BINARY[op] >= least and self.items[self.at][0] in ("op", "name"):
            self.take()
            if op == "?":
                yes = self.expression(1)
                self.take(":")
                left = ("if", left, yes, self.expression(1))
            else:
                left = (op, left, self.expression(_BINARY[op] + 1))
        return left

    def unary(self):
        if self.peek() in ("!", "-"):
            op = self.take()[1]
            return ("not" if op == "!" else "neg", self.unary())
        return self.postfix(self.primary())

    def postfix(self, value):
        while self.peek() in (".", "["):
            if self.take()[1] == "[":
                value = ("index", value, self.expression())
                self.take("]")
            else:
                name = self.take()[1]
                value = ("call", name, (value, *self.arguments()))
        return value

    def arguments(self) -> list:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.expression())
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        return out

    def primary(self):
        kind, value = self.take()
        if kind == "num":
            return ("lit", float(value) if re.search(r"[.eE]", value) and not value.startswith("0x") else int(value.rstrip("uU"), 0))
        if kind == "str":
            raw = value[0] in "rR"
            body = value[2:-1] if raw else value[1:-1]
            return ("lit", body if raw else re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)", _unescape, body))
        if value == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if value == "[":
            out = []
            while self.peek() != "]":
                out.append(self.expression())
                if self.peek() != "]":
                    self.take(",")
            self.take("]")
            return ("list", tuple(out))
        if kind == "name":
            if value in ("true", "false"):
                return ("lit", value == "true")
            if value == "null":
                return ("lit", None)
            if self.peek() == "(":
                return ("call", value, tuple(self.arguments()))
            raise ValueError(f"unknown name {value!r} in {self.text!r}")
        raise ValueError(f"unexpected {value or 'end'!r} in {self.text!r}")


def _unescape(m: re.Match) -> str:
    c = m[1]
    return chr(int(c[1:], 16)) if c[0] in "xu" and len(c) > 1 else {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}.get(c, c)


def _kind(x) -> str | None:
    """The type of an expression where it can be told; raises ValueError for what can't be."""
    op = x[0]
    if op == "lit":
        return {bool: "bool", int: "int", float: "double", str: "string", type(None): "null"}[type(x[1])]
    if op == "list":
        for y in x[1]:
            _kind(y)
        return "list"
    if op == "call":
        if x[1] not in FUNCTIONS:
            raise ValueError(f"unknown function {x[1]!r}")
        if x[1] in _ARITY and len(x[2]) != _ARITY[x[1]]:
            raise ValueError(f"{x[1]} takes {_ARITY[x[1]]} argument(s)")
        kinds = [_kind(y) for y in x[2]]
        if x[1] in _ARITY and any(k not in ("string", None) for k in kinds):
            raise ValueError(f"{x[1]} takes text")
        return FUNCTIONS[x[1]]
    kinds = [_kind(y) for y in x[1:]]
    if op in ("&&", "||", "not"):
        if any(k not in ("bool", None) for k in kinds):
            raise ValueError(f"{op} takes booleans")
        return "bool"
    if op == "if":
        return kinds[1] if kinds[1] == kinds[2] else None
    if op in ("==", "!=", "<", "<=", ">", ">="):
        a, b = kinds
        if None not in (a, b) and a != b and not {a, b} <= {"int", "double"} and "null" not in (a, b):
            raise ValueError(f"{a} and {b} can't be compared")
        return "bool"
    if op == "in":
        return "bool"
    if op == "index":
        return None
    return kinds[0] if len(set(kinds)) == 1 else None


def parse(text: str):
    """The tree of an expression. Raises ValueError."""
    r = _Reader(text)
    out = r.expression()
    if r.items[r.at][0] != "end":
        raise ValueError(f"unexpected {r.items[r.at][1]!r} in {text!r}")
    _kind(out)
    return out


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    when: str
    assertion: str
    severity: str
    message: str
    path: str
    when_tree: tuple | None
    tree: tuple


def compile_rules(rules) -> list[Rule]:
    """Checks and compiles rule dicts: id, name, one of assert, require, forbid, and when, severity, message, errorPath."""
    out, seen = [], set()
    for k, r in enumerate(rules):
        text = {x: str(r.get(x) or "").strip() for x in ("id", "name", "when", "assert", "require", "forbid", "severity", "message", "errorPath")}
        where = f"rules[{k}]"
        if not text["id"] or text["id"] in seen:
            raise ValueError(f"{where}: rule id is missing or not unique")
        seen.add(text["id"])
        if not text["name"]:
            raise ValueError(f"{where}: rule name is required")
        said = [x for x in ("assert", "require", "forbid") if text[x]]
        if len(said) != 1:
            raise ValueError(f"{where}: exactly one of assert, require, forbid must be set")
        if said[0] != "assert":
            hl7.parse_location(text[said[0]])
        if text["severity"].upper() not in ("", *("ERROR", "WARNING", "INFO")):
            raise ValueError(f"{where}: severity must be ERROR, WARNING or INFO")
        assertion = {"assert": text["assert"], "require": f"valued('{text['require']}')", "forbid": f"!valued('{text['forbid']}')"}[said[0]]
        trees = [parse(x) if x else None for x in (text["when"], assertion)]
        for t in trees:
            if t is not None and _kind(t) not in ("bool", None):
                raise ValueError(f"{where}: when and assert must be boolean")
        out.append(Rule(text["id"], text["name"], text["when"], assertion, text["severity"].upper(), text["message"], text["errorPath"], trees[0], trees[1]))
    return out


# ---- scope

_QUOTED = re.compile(r"""['"]([A-Z][A-Z0-9]{2})(?:-[0-9][^'"]*)?['"]""")


def scope(rule: Rule) -> list[str]:
    """The segment a rule runs over; several if only a message can tell (the one with most instances); none for the message."""
    for text in (rule.assertion, rule.when):
        names = set(_QUOTED.findall(text))
        if len(names) == 1:
            return list(names)
    count = Counter(_QUOTED.findall(f"{rule.when} {rule.assertion}"))
    return sorted(n for n, c in count.items() if c == max(count.values())) if count else []


def chosen_scope(rule: Rule, m: hl7.Message) -> str:
    names = scope(rule)
    return max(sorted(names, reverse=True), key=m.count) if names else ""


def error_path(rule: Rule, segment: str, n: int) -> str:
    if not segment:
        return rule.path or f"rule[{rule.id}]"
    if not rule.path:
        return f"{segment}[{n}]"
    head, dash, tail = rule.path.partition("-")
    return f"{head}[{n}]{dash}{tail}"


def default_message(rule: Rule, path: str) -> str:
    name = f'"{rule.name}"' + f" (id: {rule.id})" * bool(rule.id) if rule.name else f"(id: {rule.id})" if rule.id else "(unknown rule)"
    return f"Assertion failed for validation rule {name}" + f" at {path}" * bool(path) + "."


# ---- evaluation in Python

_SCALARS = ("ST", "TX", "FT", "NM", "SI", "DT", "TM", "DTM", "TS", "ID", "IS", "GTS", "VARIES")


def to_moment(text: str) -> datetime:
    """A date-time text of any precision as a moment in UTC; its fraction is left out."""
    m = re.fullmatch(r"(\d*)(?:\.[^+-]*)?([+-]\d{4})?", text.strip(), re.ASCII)
    digits = m[1][:14] if m else ""
    try:
        if not digits:
            raise ValueError
        digits = (digits.ljust(4, "0") if len(digits) < 4 else digits)
        parts = [int(digits[:4]), 1, 1, 0, 0, 0]
        for k in range(1, 6):
            at = 2 + 2 * k
            if len(digits) >= at + 2:
                parts[k] = int(digits[at : at + 2])
            elif k >= 3 and len(digits) == at + 1:
                parts[k] = 10 * int(digits[at])
        zone = m[2] or "+0000"
        shift = timedelta(hours=int(zone[1:3]), minutes=int(zone[3:]))
        return datetime(*parts, tzinfo=timezone(-shift if zone[0] == "-" else shift)).astimezone(UTC)
    except (ValueError, OverflowError) as e:
        raise RuleError(f"invalid HL7 DTM value: {text!r}") from e


@dataclass
class _Run:
    message: hl7.Message
    segment: str
    n: int
    registry: hl7.Registry | None

    def get(self, location: str) -> str:
        try:
            return self.message.get(location, self.segment, self.n)
        except ValueError:
            return ""

    def truth(self, x) -> bool:
        v = self.value(x)
        if not isinstance(v, bool):
            raise RuleError("no boolean")
        return v

    def value(self, x):
        op = x[0]
        if op == "lit":
            return x[1]
        if op == "list":
            return [self.value(y) for y in x[1]]
        if op in ("&&", "||"):
            decides = op == "||"
            failed = None
            for y in x[1:]:
                try:
                    if self.truth(y) == decides:
                        return decides
                except RuleError as e:
                    failed = failed or e
            if failed:
                raise failed
            return not decides
        if op == "if":
            return self.value(x[2] if self.truth(x[1]) else x[3])
        if op == "not":
            return not self.truth(x[1])
        if op == "call":
            return self.call(x[1], [self.value(y) for y in x[2]])
        args = [self.value(y) for y in x[1:]]
        try:
            return self.operate(op, *args)
        except (TypeError, ZeroDivisionError, OverflowError, IndexError, KeyError) as e:
            raise RuleError(f"{op} can't be applied: {e}") from e

    def operate(self, op: str, a, b=None):
        if op == "neg":
            return -a
        if op in ("==", "!="):
            same = a == b and isinstance(a, bool) == isinstance(b, bool)
            return same if op == "==" else not same
        if op == "in":
            return a in b
        if op == "index":
            return a[b]
        if isinstance(a, bool) != isinstance(b, bool):
            raise TypeError("types differ")
        if op in "<=>=":
            return {"<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()
        if op == "/":
            return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1) if isinstance(a, int) and isinstance(b, int) else a / b
        if op == "%":
            return (abs(a) % abs(b)) * (-1 if a < 0 else 1)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[op]()

    def call(self, name: str, args: list):
        try:
            return self.function(name, *args)
        except (TypeError, ValueError, OverflowError, re.error) as e:
            raise RuleError(f"{name}: {e}") from e

    def function(self, name: str, *a):
        if name == "msg":
            return self.get(a[0])
        if name == "valued":
            return self.get(a[0]).strip() not in ("", '""')
        if name == "validateAs":
            return self.valid_as(*a)
        if name in ("matchesPattern", "toDTM", "toNumber"):
            value = self.get(a[0])
            if not value.strip():
                raise RuleError(f"{name}({a[0]!r}): field is empty — guard with valued()")
            if name == "toDTM":
                return to_moment(value)
            if name == "toNumber":
                return float(value.strip())
            return re.search(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", a[1]), value.strip()) is not None
        if name == "size":
            return len(a[0])
        if name in ("startsWith", "endsWith"):
            return a[0].startswith(a[1]) if name == "startsWith" else a[0].endswith(a[1])
        if name == "contains":
            return a[1] in a[0]
        if name == "matches":
            return re.search(a[1], a[0]) is not None
        if name == "string":
            v = a[0]
            if isinstance(v, bool):
                return str(v).lower()
            return v.isoformat().replace("+00:00", "Z") if isinstance(v, datetime) else f"{v:g}" if isinstance(v, float) else str(v)
        if name == "int":
            return int(a[0].timestamp()) if isinstance(a[0], datetime) else int(a[0])
        if name == "double":
            return float(a[0])
        if name == "bool":
            return {"true": True, "false": False, "1": True, "0": False, True: True, False: False}[a[0]]
        if name == "timestamp":
            return datetime.fromisoformat(a[0].replace("Z", "+00:00")).astimezone(UTC)
        parts = re.findall(r"(-?\d+(?:\.\d+)?)(h|m|s|ms|us)(?![a-z])", a[0])
        if "".join(x + y for x, y in parts) != a[0] or not parts:
            raise ValueError(f"no duration: {a[0]!r}")
        return timedelta(seconds=sum(float(x) * {"h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6}[y] for x, y in parts))

    def valid_as(self, location: str, kind: str) -> bool:
        try:
            hl7.parse_location(location.strip().upper())
        except ValueError as e:
            raise RuleError(f"validateAs: first argument must be a location, got {location!r}") from e
        kind = kind.strip().upper()
        if not kind:
            raise RuleError("validateAs: second argument must not be empty")
        version = self.message.get("MSH-12").strip()
        composite = self.registry.composite(version, kind) if self.registry else None
        if composite is None and kind not in _SCALARS:
            return False
        return composite is not None or kind == "VARIES" or hl7.scalar_error(kind, self.get(location.strip().upper())) is None


def evaluate(rules: list[Rule], m: hl7.Message, registry: hl7.Registry | None = None) -> list[tuple[str, str, str, str | None]]:
    """Findings of all rules on one message: violations first, then what could not be evaluated."""
    violations, failures = [], []
    for rule in rules:
        segment = chosen_scope(rule, m)
        for n in range(1, (m.count(segment) if segment else 1) + 1):
            run, path = _Run(m, segment, n, registry), error_path(rule, segment, n)
            try:
                if (rule.when_tree is None or run.truth(rule.when_tree)) and not run.truth(rule.tree):
                    violations.append((path, rule.message or default_message(rule, path), VIOLATION, rule.severity or "ERROR"))
            except RuleError as e:
                failures.append((path, f"{rule.name}: {e}", RUNTIME_ERROR, rule.severity or None))
    return violations + failures


# ---- evaluation as a Column


def native(x, tree: Column, segment: str = "", n: Column | int = 1) -> tuple[Column, Column]:
    """(value, failed) of an expression over a parsed tree. Lists, durations and indexing have no native form."""
    yes, no = F.lit(True), F.lit(False)
    at = lambda loc: hl7.location(tree, loc, n if hl7.parse_location(loc).segment == segment else 1)
    op = x[0]
    if op == "lit":
        return F.lit(x[1]), no
    if op in ("&&", "||"):
        (a, fa), (b, fb) = (native(y, tree, segment, n) for y in x[1:])
        stop = (lambda v, f: ~f & v) if op == "||" else (lambda v, f: ~f & ~v)
        decided = F.coalesce(stop(a, fa), no) | F.coalesce(stop(b, fb), no)
        return F.when(decided, F.lit(op == "||")).otherwise(F.lit(op != "||")), ~decided & (fa | fb)
    if op in ("not", "neg"):
        a, f = native(x[1], tree, segment, n)
        return (~a if op == "not" else -a), f
    if op == "if":
        (c, fc), (a, fa), (b, fb) = (native(y, tree, segment, n) for y in x[1:])
        return F.when(c, a).otherwise(b), fc | F.when(c, fa).otherwise(fb)
    if op == "in" and x[2][0] == "list":
        a, f = native(x[1], tree, segment, n)
        return a.isin(*[y[1] for y in x[2][1]]), f
    if op == "call":
        name, args = x[1], x[2]
        if name in _ARITY:
            if args[0][0] != "lit":
                raise ValueError(f"{name} needs a literal location to be native")
            value = at(args[0][1])
            blank = F.trim(value) == ""
            if name == "msg":
                return value, no
            if name == "valued":
                return ~F.trim(value).isin("", '""'), no
            if name == "validateAs":
                if args[1][0] != "lit":
                    raise ValueError("validateAs needs a literal type to be native")
                kind = args[1][1].strip().upper()
                return (F.lit(False) if kind not in _SCALARS else hl7.is_scalar(value, kind)), no
            if name == "matchesPattern":
                return F.trim(value).rlike(args[1][1]), blank
            if name == "toNumber":
                number = F.trim(value).try_cast("double")
                return number, number.isNull()
            return _moment(value)
        (a, f), rest = native(args[0], tree, segment, n), [native(y, tree, segment, n) for y in args[1:]]
        for _, g in rest:
            f = f | g
        if name == "size":
            return F.char_length(a), f
        if name in ("startsWith", "endsWith", "contains"):
            return {"startsWith": a.startswith, "endsWith": a.endswith, "contains": a.contains}[name](rest[0][0]), f
        if name == "matches":
            return F.rlike(a, rest[0][0]), f
        if name in ("string", "int", "double", "bool"):
            kind = {"string": "string", "int": "bigint", "double": "double", "bool": "boolean"}[name]
            out = a.try_cast(kind)
            return out, f | out.isNull()
        raise ValueError(f"{name} has no native form")
    (a, fa), (b, fb) = (native(y, tree, segment, n) for y in x[1:])
    failed = fa | fb
    if op in ("/", "%"):
        failed = failed | F.coalesce(b == 0, yes)
        b = F.nullif(b, F.lit(0))
    out = {
        "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
        "+": lambda: F.concat(a, b) if "string" in (_kind(x[1]), _kind(x[2])) else a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b,
    }[op]()
    return out, failed


def _moment(value: Column) -> tuple[Column, Column]:
    """A date-time text of any precision as a timestamp in UTC."""
    s = F.trim(value)
    digits, zone = F.regexp_extract(s, r"^(\d{4,14})(?:\.[^+-]*)?(?:[+-]\d{4})?\z", 1), F.regexp_extract(s, r"[+-]\d{4}\z", 0)
    full = F.concat(digits, F.lit("0101000000").substr(F.char_length(digits) - 3, F.lit(14)))
    local = F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss"))
    seconds = F.coalesce(F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60, F.lit(0))
    seconds = F.when(zone.startswith("-"), -seconds).otherwise(seconds)
    out = F.timestamp_seconds(F.unix_seconds(local) - seconds)
    return out, out.isNull()


def rule_issues(rule: Rule, tree: Column) -> Column:
    """Findings of one rule as a Column; the rule's segment must be known without a message."""
    from weft.operators import issues as I  # noqa: E741

    names = scope(rule)
    if len(names) > 1:
        raise ValueError("a tie between segments is settled by the message; use evaluate")
    segment = names[0] if names else ""

    def one(n: Column) -> Column:
        value, failed = native(rule.tree, tree, segment, n)
        guard, bad = native(rule.when_tree, tree, segment, n) if rule.when_tree else (F.lit(True), F.lit(False))
        head, dash, tail = rule.path.partition("-")
        path = F.lit(error_path(rule, "", 1)) if not segment else F.concat(F.lit(f"{head or segment}["), n.cast("string"), F.lit(f"]{dash}{tail}"))
        said = F.lit(rule.message) if rule.message else F.concat(F.lit(default_message(rule, "").removesuffix(".") + " at "), path, F.lit("."))
        broken = bad | (F.coalesce(guard, F.lit(False)) & failed)
        return (
            F.when(broken, I.issue(path, f"{rule.name}: can't be evaluated", RUNTIME_ERROR, rule.severity or None))
            .when(guard & ~value, I.issue(path, said, VIOLATION, rule.severity or "ERROR"))
        )

    count = hl7.instances(tree, segment) if segment else F.lit(1)
    each = F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), one)
    return F.filter(each, lambda i: i.isNotNull()).cast(I.KIND)
