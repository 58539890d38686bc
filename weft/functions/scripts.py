"""User scripts: a subset of JavaScript, run over documents in Arrow batches.

A script sees ``input``, ``inputSchema``, ``outputSchema`` and ``manualInputs``. It may be
a body with ``return``, an object literal in parentheses or one expression. Supported:
let/const/var with destructuring, functions and arrow functions with defaults and rest,
if, for, for-of, for-in, while, switch, try/throw, spread, templates, optional chaining,
regular expressions, and the usual methods of strings, arrays, numbers, Object, Math,
JSON, Date (ISO text in and out), Set and Map. There is no access to files, modules or
the network. Instead of a time limit a script ends after ``MOST_STEPS`` steps.
"""

from __future__ import annotations

import functools
import json
import math
import re
from datetime import UTC, datetime

from weft.functions import nodes as N

MOST_STEPS = 2_000_000
MOST_DEPTH = 120


class _Undefined:
    def __repr__(self) -> str:
        return "undefined"

    def __bool__(self) -> bool:
        return False


UNDEFINED = _Undefined()


class ScriptError(Exception):
    """An error thrown by a script or by its evaluation; ``value`` is what was thrown."""

    def __init__(self, value):
        self.value = value
        super().__init__(text(value.get("message", value)) if isinstance(value, dict) else text(value))


def fail(kind: str, message: str):
    raise ScriptError({"name": kind, "message": message, "__error": True})


class _Return(Exception):
    def __init__(self, value):
        self.value = value


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class Regex:
    def __init__(self, source: str, flags: str = ""):
        self.source, self.flags = source, flags
        body = re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", source)
        try:
            self.re = re.compile(body, (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0) | (re.S if "s" in flags else 0))
        except re.error as e:
            fail("SyntaxError", f"invalid regular expression: {e}")


class Moment:
    def __init__(self, at: datetime):
        self.at = at

    @property
    def ms(self) -> float:
        return self.at.timestamp() * 1000


# ---- tokens and trees

_TOKENS = re.compile(
    r"""(?P<space>(?:\s|//[^\n]*|/\*.*?\*/)+)|(?P<num>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<name>[A-Za-z_$][\w$]*)
    |(?P<op>=>|\.\.\.|\?\.(?!\d)|\?\?=?|===|!==|==|!=|<=|>=|&&=?|\|\|=?|\*\*=?|\+\+|--|[-+*/%]=|[-+*/%<>=!?:;,.(){}\[\]~&|^])""",
    re.X | re.S,
)
_WORDS = frozenset("let const var function return if else for of in while do break continue throw try catch finally new typeof void delete true false null undefined switch case default instanceof".split())
_LEVELS = [("??",), ("||",), ("&&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">=", "in", "instanceof"), ("+", "-"), ("*", "/", "%")]


def _tokens(code: str) -> list[tuple[str, object, bool]]:
    """(kind, value, whether a line break stands before)"""
    out, at, fresh = [], 0, False
    while at < len(code):
        if code[at] == "`":
            end, parts, chunk = at + 1, [], ""
            while end < len(code) and code[end] != "`":
                if code[end] == "\\":
                    chunk += _escape(code[end : end + 2])
                    end += 2
                elif code.startswith("${", end):
                    depth, stop = 1, end + 2
                    while stop < len(code) and depth:
                        depth += {"{": 1, "}": -1}.get(code[stop], 0)
                        stop += 1
                    parts += [("text", chunk), ("code", code[end + 2 : stop - 1])]
                    chunk, end = "", stop
                else:
                    chunk += code[end]
                    end += 1
            if end >= len(code):
                fail("SyntaxError", "template is not closed")
            out.append(("template", [*parts, ("text", chunk)], fresh))
            at, fresh = end + 1, False
            continue
        last = out[-1] if out else None
        operand = last is not None and (last[0] in ("num", "str", "template", "regex") or (last[0] == "name" and last[1] not in ("return", "typeof", "case", "in", "of")) or last[1] in (")", "]", "}"))
        if code[at] == "/" and not operand and not code.startswith(("//", "/*"), at):
            m = re.compile(r"/((?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+)/([a-z]*)").match(code, at)
            if m:
                out.append(("regex", (m[1], m[2]), fresh))
                at, fresh = m.end(), False
                continue
        m = _TOKENS.match(code, at)
        if not m:
            fail("SyntaxError", f"unexpected {code[at:at + 8]!r}")
        kind, at = m.lastgroup, m.end()
        if kind == "space":
            fresh = fresh or "\n" in m[0]
            continue
        value = m[0]
        if kind == "num":
            value = float(int(value, 16)) if value[:2] in ("0x", "0X") else float(value)
        elif kind == "str":
            value = re.sub(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\n|.)", lambda x: _escape(x[0]), value[1:-1], flags=re.S)
        out.append((kind, value, fresh))
        fresh = False
    return [*out, ("end", "", True)]


def _escape(s: str) -> str:
    c = s[1:]
    if c[:1] in "ux" and len(c) > 1:
        return chr(int(c[1:].strip("{}"), 16))
    return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}.get(c, c)


class Parser:
    def __init__(self, code: str):
        self.t, self.i = _tokens(code), 0

    def at(self, *values: str) -> bool:
        kind, v, _ = self.t[self.i]
        return kind in ("op", "name") and v in values

    def take(self, *values: str):
        kind, v, _ = self.t[self.i]
        if values and not self.at(*values):
            fail("SyntaxError", f"expected {values[0]!r} but found {v if kind != 'end' else 'the end'!r}")
        self.i += 1
        return v

    def maybe(self, *values: str) -> bool:
        if self.at(*values):
            self.i += 1
            return True
        return False

    def program(self) -> list:
        out = []
        while self.t[self.i][0] != "end":
            out.append(self.statement())
        return out

    def block(self) -> list:
        self.take("{")
        out = []
        while not self.at("}"):
            out.append(self.statement())
        self.take("}")
        return out

    def body(self) -> list:
        return self.block() if self.at("{") else [self.statement()]

    def done(self) -> None:
        """The end of a statement: a semicolon, a line break, or the end of what is around it."""
        kind, v, fresh = self.t[self.i]
        if not self.maybe(";") and not (kind == "end" or fresh or v == "}"):
            fail("SyntaxError", f"unexpected {v!r}")

    def statement(self):
        if self.at("{"):
            return ("block", self.block())
        if self.maybe(";"):
            return ("block", [])
        kind, word, _ = self.t[self.i]
        if kind == "name" and word in ("let", "const", "var"):
            out = self.declaration()
            self.done()
            return out
        if kind == "name" and hasattr(self, f"_{word}") and word in _WORDS:
            self.i += 1
            return getattr(self, f"_{word}")()
        value = self.expression()
        self.done()
        return ("do", value)

    def declaration(self):
        word = self.take("let", "const", "var")
        pairs = []
        while True:
            target = self.pattern()
            pairs.append((target, self.assignment() if self.maybe("=") else ("lit", UNDEFINED)))
            if not self.maybe(","):
                return ("var" if word == "var" else "let", pairs)

    def pattern(self):
        if self.maybe("["):
            items = []
            while not self.at("]"):
                if self.maybe(","):
                    items.append(None)
                    continue
                rest = self.maybe("...")
                p = self.pattern()
                items.append(("rest", p) if rest else ("item", p, self.assignment() if self.maybe("=") else None))
                if not self.at("]"):
                    self.take(",")
            self.take("]")
            return ("array", items)
        if self.maybe("{"):
            items = []
            while not self.at("}"):
                if self.maybe("..."):
                    items.append(("rest", self.pattern()))
                else:
                    key = self.t[self.i][1]
                    self.i += 1
                    p = self.pattern() if self.maybe(":") else ("id", key)
                    items.append(("key", key, p, self.assignment() if self.maybe("=") else None))
                if not self.at("}"):
                    self.take(",")
            self.take("}")
            return ("object", items)
        kind, name, _ = self.t[self.i]
        if kind != "name" or name in _WORDS:
            fail("SyntaxError", f"expected a name but found {name!r}")
        return ("id", self.take())

    def _return(self):
        value = ("lit", UNDEFINED)
        if not self.at(";", "}") and self.t[self.i][0] != "end" and not self.t[self.i][2]:
            value = self.expression()
        self.done()
        return ("return", value)

    def _throw(self):
        value = self.expression()
        self.done()
        return ("throw", value)

    def _break(self):
        self.done()
        return ("break",)

    def _continue(self):
        self.done()
        return ("continue",)

    def _if(self):
        self.take("(")
        test = self.expression()
        self.take(")")
        yes = self.body()
        return ("if", test, yes, self.body() if self.maybe("else") else [])

    def _while(self):
        self.take("(")
        test = self.expression()
        self.take(")")
        return ("for", None, test, None, self.body(), False)

    def _do(self):
        body = self.body()
        self.take("while")
        self.take("(")
        test = self.expression()
        self.take(")")
        self.done()
        return ("for", None, test, None, body, True)

    def _for(self):
        self.take("(")
        start = None
        if self.at("let", "const", "var"):
            mark = self.i
            self.take()
            p = self.pattern()
            if self.at("of", "in"):
                kind = self.take()
                over = self.expression()
                self.take(")")
                return ("each", kind, p, over, self.body())
            self.i = mark
            start = self.declaration()
        elif not self.at(";"):
            start = ("do", self.expression())
        self.take(";")
        test = None if self.at(";") else self.expression()
        self.take(";")
        step = None if self.at(")") else self.expression()
        self.take(")")
        return ("for", start, test, step, self.body(), False)

    def _try(self):
        body, name, caught, last = self.block(), None, None, None
        if self.maybe("catch"):
            if self.maybe("("):
                name = self.pattern()
                self.take(")")
            caught = self.block()
        if self.maybe("finally"):
            last = self.block()
        return ("try", body, name, caught, last)

    def _switch(self):
        self.take("(")
        over = self.expression()
        self.take(")")
        self.take("{")
        cases = []
        while not self.maybe("}"):
            test = None if self.maybe("default") else (self.take("case"), self.expression())[1]
            self.take(":")
            body = []
            while not self.at("case", "default", "}"):
                body.append(self.statement())
            cases.append((test, body))
        return ("switch", over, cases)

    def _function(self):
        name = self.take()
        return ("let", [(("id", name), self.function())])

    def function(self):
        self.take("(")
        params = self.params()
        return ("fn", params, self.block(), False)

    def params(self) -> list:
        out = []
        while not self.at(")"):
            rest = self.maybe("...")
            p = self.pattern()
            out.append(("rest", p) if rest else ("item", p, self.assignment() if self.maybe("=") else None))
            if not self.at(")"):
                self.take(",")
        self.take(")")
        return out

    def expression(self):
        out = self.assignment()
        while self.maybe(","):
            out = ("seq", out, self.assignment())
        return out

    def arrow(self):
        """An arrow function at this place, or None."""
        mark = self.i
        try:
            if self.t[mark][0] == "name" and self.t[mark][1] not in _WORDS and self.t[mark + 1][1] == "=>":
                params = [("item", ("id", self.take()), None)]
            elif self.at("("):
                depth, k = 0, mark
                while True:
                    v = self.t[k][1] if self.t[k][0] == "op" else ""
                    depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(v, 0)
                    k += 1
                    if not depth or self.t[k][0] == "end":
                        break
                if self.t[k][1] != "=>":
                    return None
                self.take("(")
                params = self.params()
            else:
                return None
        except ScriptError:
            self.i = mark
            return None
        self.take("=>")
        if self.at("{"):
            return ("fn", params, self.block(), True)
        return ("fn", params, [("return", self.assignment())], True)

    def assignment(self):
        fn = self.arrow()
        if fn:
            return fn
        left = self.conditional()
        if self.at("=", "+=", "-=", "*=", "/=", "%=", "**=", "??=", "||=", "&&="):
            op = self.take()
            if left[0] not in ("id", "get", "arr", "obj"):
                fail("SyntaxError", "bad assignment")
            return ("set", op[:-1], left, self.assignment())
        return left

    def conditional(self):
        test = self.binary(0)
        if self.maybe("?"):
            yes = self.assignment()
            self.take(":")
            return ("cond", test, yes, self.assignment())
        return test

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.power()
        left = self.binary(level + 1)
        while self.at(*_LEVELS[level]) and self.t[self.i][0] in ("op", "name"):
            left = ("bin", self.take(), left, self.binary(level + 1))
        return left

    def power(self):
        left = self.unary()
        return ("bin", self.take(), left, self.power()) if self.at("**") else left

    def unary(self):
        if self.at("!", "-", "+", "typeof", "void", "delete"):
            return ("un", self.take(), self.unary())
        if self.at("++", "--"):
            op = self.take()
            return ("step", op, self.unary(), True)
        value = self.postfix(self.primary())
        if self.at("++", "--") and not self.t[self.i][2]:
            return ("step", self.take(), value, False)
        return value

    def arguments(self) -> list:
        out = []
        while not self.at(")"):
            out.append(("spread", self.assignment()) if self.maybe("...") else self.assignment())
            if not self.at(")"):
                self.take(",")
        self.take(")")
        return out

    def postfix(self, value):
        while True:
            if self.maybe("."):
                value = ("get", value, ("lit", self.take()), False)
            elif self.maybe("?."):
                if self.maybe("("):
                    value = ("call", value, self.arguments(), True)
                elif self.maybe("["):
                    value = ("get", value, self.expression(), True)
                    self.take("]")
                else:
                    value = ("get", value, ("lit", self.take()), True)
            elif self.maybe("["):
                value = ("get", value, self.expression(), False)
                self.take("]")
            elif self.maybe("("):
                value = ("call", value, self.arguments(), False)
            else:
                return value

    def primary(self):
        kind, v, _ = self.t[self.i]
        self.i += 1
        if kind in ("num", "str"):
            return ("lit", v)
        if kind == "regex":
            return ("regex", *v)
        if kind == "template":
            return ("template", [("lit", p) if k == "text" else Parser(p).expression() for k, p in v])
        if v == "(":
            out = self.expression()
            self.take(")")
            return out
        if v == "[":
            items = []
            while not self.at("]"):
                items.append(("spread", self.assignment()) if self.maybe("...") else self.assignment())
                if not self.at("]"):
                    self.take(",")
            self.take("]")
            return ("arr", items)
        if v == "{":
            return self.object()
        if kind == "name":
            if v in ("true", "false"):
                return ("lit", v == "true")
            if v in ("null", "undefined"):
                return ("lit", None if v == "null" else UNDEFINED)
            if v == "function":
                if not self.at("("):
                    self.take()
                return self.function()
            if v == "new":
                made = self.primary()
                while self.maybe("."):
                    made = ("get", made, ("lit", self.take()), False)
                return ("new", made, self.arguments() if self.maybe("(") else [])
            if v not in _WORDS:
                return ("id", v)
        fail("SyntaxError", f"unexpected {v if kind != 'end' else 'end of script'!r}")

    def object(self):
        items = []
        while not self.at("}"):
            if self.maybe("..."):
                items.append(("spread", self.assignment()))
            else:
                kind, key, _ = self.t[self.i]
                self.i += 1
                if key == "[" and kind == "op":
                    name = self.assignment()
                    self.take("]")
                else:
                    name = ("lit", text(key) if kind == "num" else key)
                if self.at("("):
                    items.append(("pair", name, self.function()))
                elif self.maybe(":"):
                    items.append(("pair", name, self.assignment()))
                else:
                    items.append(("pair", name, ("id", key)))
            if not self.at("}"):
                self.take(",")
        self.take("}")
        return ("obj", items)


# ---- values


def text(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return number_text(v)
    if isinstance(v, list):
        return ",".join("" if x is None or x is UNDEFINED else text(x) for x in v)
    if isinstance(v, dict):
        return f"{v['name']}: {v['message']}" if v.get("__error") else "[object Object]"
    if isinstance(v, Moment):
        return v.at.isoformat()
    if isinstance(v, Regex):
        return f"/{v.source}/{v.flags}"
    return "function" if callable(v) else str(v) if isinstance(v, str) else repr(v)


def number_text(v: float) -> str:
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    if float(v).is_integer() and abs(v) < 1e21:
        return str(int(v))
    out = repr(float(v))
    return re.sub(r"e([+-])0*", r"e\1", out)


def number(v) -> float:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return float(v)
    if v is None:
        return 0.0
    if isinstance(v, str):
        s = v.strip()
        if not s:
            return 0.0
        try:
            return float(int(s, 16)) if s[:2] in ("0x", "0X") else float(s) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?Infinity", s) else math.nan
        except ValueError:
            return math.nan
    if isinstance(v, Moment):
        return v.ms
    if isinstance(v, list):
        return number(text(v))
    return math.nan


def truth(v) -> bool:
    if isinstance(v, float):
        return v != 0 and not math.isnan(v)
    return not (v is None or v is UNDEFINED or v is False or v == "") if not isinstance(v, (list, dict)) and not (isinstance(v, int) and not isinstance(v, bool)) else (v != 0 if isinstance(v, int) else True)


def same(a, b) -> bool:
    """Strict equality."""
    if isinstance(a, (list, dict, set)) or isinstance(b, (list, dict, set)) or callable(a) or callable(b):
        return a is b
    if isinstance(a, bool) != isinstance(b, bool) or (a is None) != (b is None) or (a is UNDEFINED) != (b is UNDEFINED) or isinstance(a, str) != isinstance(b, str):
        return False
    return a == b


def alike(a, b) -> bool:
    """Loose equality."""
    if (a is None or a is UNDEFINED) or (b is None or b is UNDEFINED):
        return (a is None or a is UNDEFINED) and (b is None or b is UNDEFINED)
    if isinstance(a, (list, dict)) and isinstance(b, (list, dict)):
        return a is b
    if isinstance(a, str) and isinstance(b, str):
        return a == b
    if isinstance(a, (list, dict)) or isinstance(b, (list, dict)):
        return text(a) == text(b)
    return number(a) == number(b)


def from_json(v):
    """Numbers as floats, as scripts have them."""
    if isinstance(v, dict):
        return {k: from_json(x) for k, x in v.items()}
    if isinstance(v, list):
        return [from_json(x) for x in v]
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def to_json(v):
    if isinstance(v, dict):
        return {k: to_json(x) for k, x in v.items() if x is not UNDEFINED and not callable(x) and k != "__error"}
    if isinstance(v, (list, set)):
        return [None if x is UNDEFINED or callable(x) else to_json(x) for x in v]
    if isinstance(v, float):
        return None if math.isnan(v) or math.isinf(v) else int(v) if v.is_integer() and abs(v) < 2**53 else v
    if isinstance(v, Moment):
        return iso(v)
    return None if v is UNDEFINED or callable(v) else v if not isinstance(v, Regex) else {}


def iso(m: Moment) -> str:
    return m.at.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{m.at.microsecond // 1000:03d}Z"


_CHANCES = [0]


def _chance() -> None:
    """Counts what comes out differently from run to run: the time and random numbers."""
    _CHANCES[0] += 1


def moment(*args) -> Moment:
    if not args:
        _chance()
        return Moment(datetime.now(UTC))
    if len(args) == 1:
        v = args[0]
        if isinstance(v, str):
            try:
                at = datetime.fromisoformat(v.strip().replace("Z", "+00:00"))
            except ValueError:
                fail("RangeError", "Invalid time value")
            return Moment(at if at.tzinfo else at.replace(tzinfo=UTC))
        return Moment(datetime.fromtimestamp(number(v) / 1000, UTC))
    parts = [int(number(a)) for a in args] + [1, 0, 0, 0, 0][len(args) - 2 :]
    months = parts[0] * 12 + parts[1]
    base = datetime(months // 12, months % 12 + 1, 1, tzinfo=UTC).timestamp()
    return Moment(datetime.fromtimestamp(base + (parts[2] - 1) * 86400 + parts[3] * 3600 + parts[4] * 60 + parts[5], UTC))


def stringify(v, _=None, space=UNDEFINED) -> object:
    if v is UNDEFINED or callable(v):
        return UNDEFINED
    n = int(space) if isinstance(space, float) and space else None
    return json.dumps(to_json(v), ensure_ascii=False, indent=n, separators=None if n else (",", ":"))


def parse_json(s):
    try:
        return from_json(json.loads(text(s)))
    except ValueError as e:
        fail("SyntaxError", f"JSON: {e}")


def index(v, n: int, default: float) -> int:
    """A relative index into something of length n."""
    x = default if v is UNDEFINED else number(v)
    x = 0 if math.isnan(x) else x
    return int(max(n + x, 0) if x < 0 else min(x, n))


def to_fixed(v, digits=0.0) -> str:
    from decimal import ROUND_HALF_UP, Decimal

    return str(Decimal(v).quantize(Decimal(1).scaleb(-int(digits)), rounding=ROUND_HALF_UP))


def rounded(v: float) -> float:
    return math.floor(v + 0.5) if math.isfinite(v) else v


class Interpreter:
    def __init__(self, globals_: dict):
        self.steps = self.depth = 0
        self.globals = {**_library(), **globals_}

    # -- running

    def tick(self) -> None:
        self.steps += 1
        if self.steps > MOST_STEPS:
            fail("RangeError", "script takes too many steps")

    def run(self, body: list, scope: dict) -> None:
        for s in body:  # functions can be called before they are written
            if s[0] == "let" and len(s[1]) == 1 and s[1][0][1][0] == "fn" and not s[1][0][1][3]:
                self.bind(s[1][0][0], self.value(s[1][0][1], scope), scope)
        for s in body:
            self.execute(s, scope)

    def inner(self, scope: dict) -> dict:
        return {"__up": scope}

    def execute(self, s, scope: dict) -> None:
        self.tick()
        kind = s[0]
        if kind == "do":
            self.value(s[1], scope)
        elif kind == "let":
            for p, e in s[1]:
                self.bind(p, self.value(e, scope), scope)
        elif kind == "var":  # belongs to the function around it
            holder = scope
            while "__up" in holder and not holder.get("__fn"):
                holder = holder["__up"]
            for p, e in s[1]:
                self.bind(p, self.value(e, scope), holder)
        elif kind == "return":
            raise _Return(self.value(s[1], scope))
        elif kind == "block":
            self.run(s[1], self.inner(scope))
        elif kind == "if":
            self.run(s[2] if truth(self.value(s[1], scope)) else s[3], self.inner(scope))
        elif kind == "for":
            self.loop(s, scope)
        elif kind == "each":
            over = self.value(s[3], scope)
            items = self.iterate(over) if s[1] == "of" else self.keys(over)
            for x in items:
                own = self.inner(scope)
                self.bind(s[2], x, own)
                try:
                    self.run(s[4], own)
                except _Continue:
                    continue
                except _Break:
                    break
        elif kind == "throw":
            raise ScriptError(self.value(s[1], scope))
        elif kind == "try":
            self.attempt(s, scope)
        elif kind == "switch":
            self.switch(s, scope)
        else:
            raise _Break if kind == "break" else _Continue

    def loop(self, s, scope: dict) -> None:
        own = self.inner(scope)
        if s[1]:
            self.execute(s[1], own)
        first = s[5]
        while first or s[2] is None or truth(self.value(s[2], own)):
            first = False
            self.tick()
            turn = self.inner({**own}) if any(True for k in own if k != "__up") else self.inner(own)
            try:
                self.run(s[4], turn)
            except _Break:
                break
            except _Continue:
                pass
            up = turn["__up"]
            if up is not own:  # each turn has its own loop variables, carried on
                own.update({k: v for k, v in up.items() if k != "__up"})
            if s[3]:
                self.value(s[3], own)

    def attempt(self, s, scope: dict) -> None:
        try:
            self.run(s[1], self.inner(scope))
        except ScriptError as e:
            if s[3] is None:
                raise
            own = self.inner(scope)
            if s[2]:
                self.bind(s[2], e.value, own)
            self.run(s[3], own)
        finally:
            if s[4]:
                self.run(s[4], self.inner(scope))

    def switch(self, s, scope: dict) -> None:
        v, own = self.value(s[1], scope), self.inner(scope)
        start = next((k for k, (t, _) in enumerate(s[2]) if t is not None and same(v, self.value(t, own))), None)
        if start is None:
            start = next((k for k, (t, _) in enumerate(s[2]) if t is None), len(s[2]))
        try:
            for _, body in s[2][start:]:
                self.run(body, own)
        except _Break:
            pass

    def bind(self, p, v, scope: dict) -> None:
        if p[0] == "id":
            scope[p[1]] = v
        elif p[0] == "array":
            items = list(self.iterate(v))
            for k, x in enumerate(p[1]):
                if x is None:
                    continue
                if x[0] == "rest":
                    self.bind(x[1], items[k:], scope)
                else:
                    got = items[k] if k < len(items) else UNDEFINED
                    self.bind(x[1], self.value(x[2], scope) if got is UNDEFINED and x[2] else got, scope)
        else:
            if v is None or v is UNDEFINED:
                fail("TypeError", f"cannot destructure {text(v)}")
            used = [x[1] for x in p[1] if x[0] == "key"]
            for x in p[1]:
                if x[0] == "rest":
                    self.bind(x[1], {k: y for k, y in v.items() if k not in used}, scope)
                else:
                    got = self.member(v, x[1])
                    self.bind(x[2], self.value(x[3], scope) if got is UNDEFINED and x[3] else got, scope)

    def lookup(self, name: str, scope: dict):
        while scope is not None:
            if name in scope:
                return scope
            scope = scope.get("__up")
        if name in self.globals:
            return self.globals
        fail("ReferenceError", f"{name} is not defined")

    # -- expressions

    def value(self, x, scope: dict):
        self.steps += 1  # as tick does
        if self.steps > MOST_STEPS:
            fail("RangeError", "script takes too many steps")
        return _EXPRESSIONS[x[0]](self, x, scope)

    def x_lit(self, x, scope):
        return x[1]

    def x_id(self, x, scope):
        return self.lookup(x[1], scope)[x[1]]

    def x_regex(self, x, scope):
        return Regex(x[1], x[2])

    def x_template(self, x, scope):
        return "".join(text(self.value(p, scope)) for p in x[1])

    def x_seq(self, x, scope):
        self.value(x[1], scope)
        return self.value(x[2], scope)

    def x_cond(self, x, scope):
        return self.value(x[2] if truth(self.value(x[1], scope)) else x[3], scope)

    def x_arr(self, x, scope):
        return self.spread(x[1], scope)

    def spread(self, items, scope) -> list:
        out = []
        for i in items:
            if i[0] == "spread":
                out += self.iterate(self.value(i[1], scope))
            else:
                out.append(self.value(i, scope))
        return out

    def x_obj(self, x, scope):
        out: dict = {}
        for i in x[1]:
            if i[0] == "spread":
                v = self.value(i[1], scope)
                out.update(v if isinstance(v, dict) else {text(float(k)): y for k, y in enumerate(v)} if isinstance(v, (list, str)) else {})
            else:
                out[text(self.value(i[1], scope))] = self.value(i[2], scope)
        return out

    def x_fn(self, x, scope):
        _, params, body, _ = x

        def call(*args):
            self.depth += 1
            if self.depth > MOST_DEPTH:
                self.depth = 0
                fail("RangeError", "maximum call stack size exceeded")
            own = {"__up": scope, "__fn": True}
            try:
                for k, p in enumerate(params):
                    if p[0] == "rest":
                        self.bind(p[1], list(args[k:]), own)
                    else:
                        got = args[k] if k < len(args) else UNDEFINED
                        self.bind(p[1], self.value(p[2], own) if got is UNDEFINED and p[2] else got, own)
                self.run(body, own)
                return UNDEFINED
            except _Return as r:
                return r.value
            finally:
                self.depth = max(0, self.depth - 1)

        call.arity = len(params)
        return call

    def x_un(self, x, scope):
        op = x[1]
        if op == "typeof":
            if x[2][0] == "id":
                try:
                    v = self.value(x[2], scope)
                except ScriptError:
                    return "undefined"
            else:
                v = self.value(x[2], scope)
            if v is UNDEFINED:
                return "undefined"
            return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "function" if callable(v) else "object"
        if op == "delete" and x[2][0] == "get":
            holder, key = self.value(x[2][1], scope), self.value(x[2][2], scope)
            if isinstance(holder, dict):
                holder.pop(text(key), None)
            return True
        v = self.value(x[2], scope)
        return not truth(v) if op == "!" else -number(v) if op == "-" else number(v) if op == "+" else UNDEFINED

    def x_step(self, x, scope):
        old = number(self.value(x[2], scope))
        new = old + (1 if x[1] == "++" else -1)
        self.assign(x[2], new, scope)
        return new if x[3] else old

    def x_set(self, x, scope):
        _, op, target, e = x
        if op in ("??", "||", "&&"):
            old = self.value(target, scope)
            keep = (old is not None and old is not UNDEFINED) if op == "??" else truth(old) if op == "||" else not truth(old)
            if keep:
                return old
            new = self.value(e, scope)
        else:
            new = self.value(e, scope) if not op else self.operate(op, self.value(target, scope), self.value(e, scope))
        self.assign(target, new, scope)
        return new

    def assign(self, target, v, scope) -> None:
        if target[0] == "id":
            self.lookup(target[1], scope)[target[1]] = v
        elif target[0] == "get":
            holder, key = self.value(target[1], scope), self.value(target[2], scope)
            if isinstance(holder, list):
                if key == "length":
                    del holder[int(v) :]
                    return
                k = int(number(key))
                holder += [UNDEFINED] * (k + 1 - len(holder))
                holder[k] = v
            elif isinstance(holder, dict):
                holder[text(key)] = v
            else:
                fail("TypeError", f"cannot set property of {text(holder)}")
        elif target[0] == "arr":
            for k, t in enumerate(target[1]):
                self.assign(t, v[k] if k < len(v) else UNDEFINED, scope)
        else:
            for _, k, t in target[1]:
                self.assign(t, self.member(v, k[1]), scope)

    def x_bin(self, x, scope):
        op = x[1]
        if op in ("&&", "||", "??"):
            a = self.value(x[2], scope)
            stop = not truth(a) if op == "&&" else truth(a) if op == "||" else a is not None and a is not UNDEFINED
            return a if stop else self.value(x[3], scope)
        return self.operate(op, self.value(x[2], scope), self.value(x[3], scope))

    def operate(self, op: str, a, b):
        if op == "+":
            if isinstance(a, (int, float)) and isinstance(b, (int, float)) or not any(isinstance(y, (str, list, dict, Moment)) for y in (a, b)):
                return number(a) + number(b)
            return text(a) + text(b)
        if op in ("===", "!=="):
            return same(a, b) == (op == "===")
        if op in ("==", "!="):
            return alike(a, b) == (op == "==")
        if op in ("<", ">", "<=", ">="):
            if not (isinstance(a, str) and isinstance(b, str)):
                a, b = number(a), number(b)
            return {"<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b}[op]()
        if op == "in":
            return text(a) in b if isinstance(b, dict) else 0 <= number(a) < len(b)
        if op == "instanceof":
            made = getattr(b, "makes", ())
            return isinstance(a, made) and (made is not dict or not getattr(b, "error", False) or (bool(a.get("__error")) and b.error in (True, a.get("name"))))
        p, q = number(a), number(b)
        if op == "/":
            return p / q if q else (math.nan if p == 0 or math.isnan(p) else math.copysign(math.inf, p) * math.copysign(1, q))
        if op == "%":
            return math.fmod(p, q) if q and math.isfinite(p) else math.nan
        if op == "**":
            return p**q
        return p - q if op == "-" else p * q

    def x_get(self, x, scope):
        holder = self.value(x[1], scope)
        if holder is None or holder is UNDEFINED:
            if x[3] or (x[1][0] in ("get", "call") and self.optional(x[1])):
                return UNDEFINED
            fail("TypeError", f"cannot read properties of {text(holder)}")
        return self.member(holder, self.value(x[2], scope))

    def optional(self, x) -> bool:
        """Whether an optional link stands further up the chain, which then ends it."""
        while x[0] in ("get", "call"):
            if x[3]:
                return True
            x = x[1]
        return False

    def x_call(self, x, scope):
        f = self.value(x[1], scope)
        if f is None or f is UNDEFINED:
            if x[3] or self.optional(x[1]):
                return UNDEFINED
            name = x[1][2][1] if x[1][0] == "get" and x[1][2][0] == "lit" else x[1][1] if x[1][0] == "id" else "value"
            fail("TypeError", f"{name} is not a function")
        if not callable(f):
            fail("TypeError", f"{text(f)} is not a function")
        return self.invoke(f, self.spread(x[2], scope))

    def invoke(self, f, args: list):
        try:
            return f(*args)
        except (TypeError, ValueError, IndexError, KeyError, AttributeError, OverflowError, RecursionError) as e:
            fail("RangeError" if isinstance(e, (RecursionError, OverflowError)) else "TypeError", str(e))

    def x_new(self, x, scope):
        f = self.value(x[1], scope)
        make = getattr(f, "make", None)
        if make is None:
            fail("TypeError", "not a constructor")
        return self.invoke(make, self.spread(x[2], scope))

    def iterate(self, v):
        if isinstance(v, (list, str, set)):
            return list(v)
        if isinstance(v, dict) and v.get("__map"):
            return [[k, y] for k, y in v["__map"].items()]
        fail("TypeError", f"{text(v)} is not iterable")

    def keys(self, v) -> list:
        return [k for k in v if k != "__error"] if isinstance(v, dict) else [text(float(k)) for k in range(len(v))] if isinstance(v, (list, str)) else []

    # -- members

    def member(self, v, key):
        if isinstance(v, list):
            return self.array(v, key)
        if isinstance(v, str):
            return self.string(v, key)
        if isinstance(v, bool):
            return {"toString": lambda: text(v)}.get(key, UNDEFINED)
        if isinstance(v, (int, float)):
            own = {"toFixed": lambda d=0.0: to_fixed(v, d), "toString": lambda base=10.0: text(v) if base == 10 else _base(int(v), int(base)), "toLocaleString": lambda *_: f"{v:,.3f}".rstrip("0").rstrip(".")}
            return own.get(key, UNDEFINED)
        if isinstance(v, Moment):
            return self.date(v, key)
        if isinstance(v, Regex):
            own = {"test": lambda s=UNDEFINED: v.re.search(text(s)) is not None, "exec": lambda s=UNDEFINED: _groups(v.re.search(text(s))), "source": v.source, "flags": v.flags}
            return own.get(key, UNDEFINED)
        if isinstance(v, set):
            return self.sets(v, key)
        if isinstance(v, dict):
            if "__map" in v:
                return self.maps(v["__map"], key)
            if "__set" in v:
                return self.sets(v["__set"], key)
            k = text(key)
            if k in v:
                return v[k]
            own = {"hasOwnProperty": lambda n: text(n) in v, "toString": lambda: text(v)}
            return own.get(k, UNDEFINED)
        return getattr(v, "members", {}).get(key, UNDEFINED) if callable(v) or hasattr(v, "members") else UNDEFINED

    def sets(self, s, key):
        own = {"has": lambda x: x in s, "add": lambda x: (s.setdefault(x, x), {"__set": s})[1], "delete": lambda x: s.pop(x, None) is not None, "forEach": lambda f: [f(x) for x in list(s)] and UNDEFINED}
        return float(len(s)) if key == "size" else own.get(key, UNDEFINED)

    def maps(self, m: dict, key):
        own = {
            "get": lambda k: m.get(k, UNDEFINED), "has": lambda k: k in m, "set": lambda k, v: (m.__setitem__(k, v), {"__map": m})[1], "delete": lambda k: m.pop(k, None) is not None,
            "keys": lambda: list(m), "values": lambda: list(m.values()), "entries": lambda: [[k, v] for k, v in m.items()], "forEach": lambda f: [f(v, k) for k, v in list(m.items())] and UNDEFINED,
        }
        return float(len(m)) if key == "size" else own.get(key, UNDEFINED)

    def array(self, v: list, key):
        if isinstance(key, (int, float)) and not isinstance(key, bool):
            return v[int(key)] if float(key).is_integer() and 0 <= key < len(v) else UNDEFINED
        if key == "length":
            return float(len(v))
        if isinstance(key, str) and key.isdigit():
            return v[int(key)] if int(key) < len(v) else UNDEFINED
        own = _ARRAYS.get(key)
        return UNDEFINED if own is None else own(self, v)

    def each(self, v: list, f) -> list:
        return [self.apply(f, x, float(k), v) for k, x in enumerate(list(v))]

    def pick(self, v: list, f):
        """Places of the items that a function takes."""
        return (k for k, x in enumerate(list(v)) if truth(self.apply(f, x, float(k), v)))

    def apply(self, f, *args):
        if not callable(f):
            fail("TypeError", f"{text(f)} is not a function")
        n = getattr(f, "arity", None)
        return f(*args) if n is not None else f(args[0])

    def reduce(self, v: list, f, start):
        if not start and not v:
            fail("TypeError", "reduce of empty array with no initial value")
        out, items = (start[0], list(enumerate(v))) if start else (v[0], list(enumerate(v))[1:])
        for k, x in items:
            out = f(out, x, float(k), v)
        return out

    def sort(self, v: list, f):
        if f is None or f is UNDEFINED:
            v.sort(key=text)
        else:
            v.sort(key=functools.cmp_to_key(lambda a, b: (lambda n: -1 if n < 0 else 1 if n > 0 else 0)(number(f(a, b)))))
        return v

    def splice(self, v: list, a, n, new) -> list:
        at = index(a, len(v), 0)
        count = len(v) - at if n is UNDEFINED else max(0, min(int(number(n)), len(v) - at))
        out = v[at : at + count]
        v[at : at + count] = new
        return out

    def string(self, v: str, key):
        if isinstance(key, (int, float)) and not isinstance(key, bool):
            return v[int(key)] if 0 <= key < len(v) else UNDEFINED
        if key == "length":
            return float(len(v))
        own = _STRINGS.get(key)
        return UNDEFINED if own is None else own(self, v)

    def substitute(self, v: str, a, b, count: int) -> str:
        def new(m: re.Match) -> str:
            if callable(b):
                return text(b(m[0], *(UNDEFINED if g is None else g for g in m.groups()), float(m.start()), v))
            named = m.groupdict()
            return re.sub(r"\$(\$|&|\d{1,2}|<\w+>)", lambda r: "$" if r[1] == "$" else m[0] if r[1] == "&" else (named.get(r[1][1:-1]) or "") if r[1][0] == "<" else (m[int(r[1])] or "") if int(r[1]) <= len(m.groups()) else r[0], text(b))

        if isinstance(a, Regex):
            return a.re.sub(new, v, count=0 if "g" in a.flags else 1)
        return re.sub(re.escape(text(a)), new, v, count=count)

    def date(self, v: Moment, key):
        at = v.at.astimezone(UTC)
        parts = {"FullYear": at.year, "Month": at.month - 1, "Date": at.day, "Day": (at.weekday() + 1) % 7, "Hours": at.hour, "Minutes": at.minute, "Seconds": at.second, "Milliseconds": at.microsecond // 1000}
        own = {f"get{u}{k}": (lambda n=n: float(n)) for k, n in parts.items() for u in ("", "UTC")}
        own |= {"getTime": lambda: v.ms, "valueOf": lambda: v.ms, "toISOString": lambda: iso(v), "toJSON": lambda: iso(v), "toString": lambda: text(v)}
        return own.get(key, UNDEFINED)

    # -- library

    def library(self) -> dict:
        class Space:
            def __init__(self, call=None, make=None, makes=(), error=False, **members):
                self.call, self.make, self.makes, self.error, self.members = call, make, makes, error, members

            def __call__(self, *a):
                if self.call is None:
                    fail("TypeError", "not a function")
                return self.call(*a)

        def error(kind: str, base=False):
            make = lambda m="", *_: {"name": kind, "message": text(m), "__error": True}
            return Space(make, make, dict, True if base else kind)

        one = lambda f: lambda v=UNDEFINED: f(number(v))
        guard = lambda f: lambda x: float(f(x)) if math.isfinite(x) else x
        maths = {k: one(guard(getattr(math, k))) for k in ("floor", "ceil", "trunc")} | {k: one(lambda x, f=getattr(math, k): f(x)) for k in ("sin", "cos", "tan", "exp", "atan")}
        maths |= {
            "round": one(lambda x: float(rounded(x))), "abs": one(abs), "sqrt": one(lambda x: math.sqrt(x) if x >= 0 else math.nan), "log": one(lambda x: math.log(x) if x > 0 else -math.inf if x == 0 else math.nan),
            "log10": one(lambda x: math.log10(x) if x > 0 else math.nan), "log2": one(lambda x: math.log2(x) if x > 0 else math.nan), "sign": one(lambda x: float((x > 0) - (x < 0))), "cbrt": one(lambda x: math.copysign(abs(x) ** (1 / 3), x)),
            "pow": lambda a, b: number(a) ** number(b), "max": lambda *a: max(map(number, a), default=-math.inf), "min": lambda *a: min(map(number, a), default=math.inf), "hypot": lambda *a: math.hypot(*map(number, a)),
            "random": lambda: (_chance(), __import__("random").random())[1], "PI": math.pi, "E": math.e,
        }
        to_int = lambda s=UNDEFINED, base=10.0: (lambda m: float(int(m[0], int(base))) if m else math.nan)(re.match(r"[+-]?\d+" if base == 10 else r"[+-]?[0-9a-zA-Z]+", text(s).strip()))
        to_float = lambda s=UNDEFINED: (lambda m: float(m[0]) if m else math.nan)(re.match(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text(s).strip()))
        is_int = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and float(v).is_integer()
        objects = {
            "keys": lambda v: self.keys(v), "values": lambda v: [v[k] for k in self.keys(v)] if isinstance(v, dict) else list(v), "entries": lambda v: [[k, self.member(v, k)] for k in self.keys(v)],
            "assign": lambda t, *s: ([t.update(x) for x in s if isinstance(x, dict)], t)[1], "fromEntries": lambda v: {text(k): x for k, x in self.iterate(v)}, "freeze": lambda v: v, "is": same,
        }
        arrays = {"isArray": lambda v=UNDEFINED: isinstance(v, list), "of": lambda *a: list(a), "from": self.array_from}
        numbers = {"isInteger": is_int, "isFinite": lambda v: isinstance(v, (int, float)) and math.isfinite(v), "isNaN": lambda v: isinstance(v, float) and math.isnan(v), "parseFloat": to_float, "parseInt": to_int, "MAX_SAFE_INTEGER": 2.0**53 - 1, "MIN_SAFE_INTEGER": 1 - 2.0**53, "EPSILON": 2.0**-52}
        quiet = {k: (lambda *_: UNDEFINED) for k in ("log", "warn", "error", "info", "debug")}
        dates = Space(lambda *_: text(moment()), moment, Moment, now=lambda: moment().ms, parse=lambda s: moment(s).ms, UTC=lambda *a: moment(*a).ms)
        make_set = lambda v=(): {"__set": {x: x for x in (self.iterate(v) if v else ())}}
        make_map = lambda v=(): {"__map": {k: x for k, x in (self.iterate(v) if v else ())}}
        from urllib.parse import quote, unquote

        return {
            "Math": Space(**maths), "JSON": Space(stringify=stringify, parse=parse_json), "Object": Space(lambda v=None: v or {}, lambda *_: {}, dict, **objects),
            "Array": Space(lambda *a: list(a), lambda *a: [UNDEFINED] * int(a[0]) if len(a) == 1 and isinstance(a[0], float) else list(a), list, **arrays), "Number": Space(lambda v=0.0: number(v), makes=(int, float), **numbers),
            "String": Space(lambda v="": text(v), makes=str, fromCharCode=lambda *a: "".join(chr(int(x)) for x in a)), "Boolean": Space(lambda v=False: truth(v), makes=bool), "Date": dates,
            "RegExp": Space(lambda p, f="": Regex(p, f), lambda p, f="": Regex(p.source if isinstance(p, Regex) else p, f), Regex), "Set": Space(None, make_set, dict), "Map": Space(None, make_map, dict),
            "Error": error("Error", True), **{k: error(k) for k in ("TypeError", "RangeError", "SyntaxError", "ReferenceError")}, "console": Space(**quiet), "parseInt": to_int, "parseFloat": to_float,
            "isNaN": lambda v=UNDEFINED: math.isnan(number(v)), "isFinite": lambda v=UNDEFINED: math.isfinite(number(v)), "NaN": math.nan, "Infinity": math.inf, "encodeURIComponent": lambda s: quote(text(s), safe="!'()*-._~"),
            "decodeURIComponent": lambda s: unquote(text(s)), "btoa": lambda s: __import__("base64").b64encode(text(s).encode("latin-1")).decode(), "atob": lambda s: __import__("base64").b64decode(text(s)).decode("latin-1"),
        }

    def array_from(self, v, f=None):
        if isinstance(v, dict) and "length" in v:
            items = [v.get(text(float(k)), UNDEFINED) for k in range(int(v["length"]))]
        elif isinstance(v, dict) and "__set" in v:
            items = list(v["__set"])
        else:
            items = self.iterate(v)
        return [self.apply(f, x, float(k)) for k, x in enumerate(items)] if f else items


def _between(v: str, a, b) -> str:
    x, y = [max(0, min(len(v), int(number(z)) if z is not UNDEFINED and not math.isnan(number(z)) else d)) for z, d in ((a, 0), (b, len(v)))]
    return v[min(x, y) : max(x, y)]


def _padded(v: str, n, c: str, left: bool) -> str:
    k = max(0, int(n) - len(v))
    return (c * k)[:k] + v if left else v + (c * k)[:k]


@functools.cache
def _library() -> dict:
    """What every script knows; scripts can't change its members, and have names of their own."""
    return Interpreter.__new__(Interpreter).library()


_EXPRESSIONS = {k[2:]: f for k, f in vars(Interpreter).items() if k.startswith("x_")}

#: Members of arrays and of texts: functions of (interpreter, value), so that only the member that is asked for is made.
_ARRAYS = {
    "map": lambda me, v: lambda f: me.each(v, f),
    "forEach": lambda me, v: lambda f: (me.each(v, f), UNDEFINED)[1],
    "filter": lambda me, v: lambda f: [v[k] for k in list(me.pick(v, f))],
    "find": lambda me, v: lambda f: next((v[k] for k in me.pick(v, f)), UNDEFINED),
    "findIndex": lambda me, v: lambda f: float(next(me.pick(v, f), -1)),
    "some": lambda me, v: lambda f: next(me.pick(v, f), None) is not None,
    "every": lambda me, v: lambda f: all(truth(me.apply(f, x, float(k), v)) for k, x in enumerate(list(v))),
    "findLast": lambda me, v: lambda f: next((v[k] for k in reversed(list(me.pick(v, f)))), UNDEFINED),
    "includes": lambda me, v: lambda x=UNDEFINED: any(same(x, y) for y in v),
    "indexOf": lambda me, v: lambda x: float(next((k for k, y in enumerate(v) if same(x, y)), -1)),
    "lastIndexOf": lambda me, v: lambda x: float(next((k for k in range(len(v) - 1, -1, -1) if same(x, v[k])), -1)),
    "join": lambda me, v: lambda s=",": text(s).join("" if x is None or x is UNDEFINED else text(x) for x in v),
    "concat": lambda me, v: lambda *a: [*v, *(y for x in a for y in (x if isinstance(x, list) else [x]))],
    "slice": lambda me, v: lambda a=UNDEFINED, b=UNDEFINED: v[index(a, len(v), 0) : index(b, len(v), len(v))],
    "reverse": lambda me, v: lambda: (v.reverse(), v)[1],
    "push": lambda me, v: lambda *a: (v.extend(a), float(len(v)))[1],
    "pop": lambda me, v: lambda: v.pop() if v else UNDEFINED,
    "shift": lambda me, v: lambda: v.pop(0) if v else UNDEFINED,
    "unshift": lambda me, v: lambda *a: (v.__setitem__(slice(0, 0), a), float(len(v)))[1],
    "flat": lambda me, v: lambda d=1.0: _flat(v, d),
    "flatMap": lambda me, v: lambda f: _flat(me.each(v, f), 1),
    "keys": lambda me, v: lambda: [float(k) for k in range(len(v))],
    "entries": lambda me, v: lambda: [[float(k), x] for k, x in enumerate(v)],
    "values": lambda me, v: lambda: list(v),
    "at": lambda me, v: lambda k: v[int(k)] if -len(v) <= k < len(v) else UNDEFINED,
    "fill": lambda me, v: lambda x, a=UNDEFINED, b=UNDEFINED: (v.__setitem__(slice(index(a, len(v), 0), index(b, len(v), len(v))), [x] * max(0, index(b, len(v), len(v)) - index(a, len(v), 0))), v)[1],
    "toString": lambda me, v: lambda: text(v),
    "reduce": lambda me, v: lambda f, *start: me.reduce(v, f, start),
    "reduceRight": lambda me, v: lambda f, *start: me.reduce(v[::-1], f, start),
    "sort": lambda me, v: lambda f=None: me.sort(v, f),
    "splice": lambda me, v: lambda a=0.0, n=UNDEFINED, *new: me.splice(v, a, n, new),
}
_STRINGS = {
    "toUpperCase": lambda me, v: v.upper,
    "toLowerCase": lambda me, v: v.lower,
    "trim": lambda me, v: v.strip,
    "trimStart": lambda me, v: v.lstrip,
    "trimEnd": lambda me, v: v.rstrip,
    "includes": lambda me, v: lambda s: text(s) in v,
    "startsWith": lambda me, v: lambda s, p=0.0: v.startswith(text(s), int(p)),
    "endsWith": lambda me, v: lambda s: v.endswith(text(s)),
    "indexOf": lambda me, v: lambda s, p=0.0: float(v.find(text(s), int(p))),
    "lastIndexOf": lambda me, v: lambda s: float(v.rfind(text(s))),
    "charAt": lambda me, v: lambda k=0.0: v[int(k) : int(k) + 1],
    "charCodeAt": lambda me, v: lambda k=0.0: float(ord(v[int(k)])) if int(k) < len(v) else math.nan,
    "slice": lambda me, v: lambda a=UNDEFINED, b=UNDEFINED: v[index(a, len(v), 0) : index(b, len(v), len(v))],
    "substring": lambda me, v: lambda a=UNDEFINED, b=UNDEFINED: _between(v, a, b),
    "substr": lambda me, v: lambda a, n=UNDEFINED: v[index(a, len(v), 0) :][: len(v) if n is UNDEFINED else int(n)],
    "repeat": lambda me, v: lambda n: v * int(n),
    "padStart": lambda me, v: lambda n, c=" ": _padded(v, n, c, True),
    "padEnd": lambda me, v: lambda n, c=" ": _padded(v, n, c, False),
    "concat": lambda me, v: lambda *a: v + "".join(map(text, a)),
    "replace": lambda me, v: lambda a, b: me.substitute(v, a, b, 1),
    "replaceAll": lambda me, v: lambda a, b: me.substitute(v, a, b, 0),
    "split": lambda me, v: lambda s=UNDEFINED, n=UNDEFINED: _split(v, s)[: None if n is UNDEFINED else int(n)],
    "match": lambda me, v: lambda r: _match(v, r),
    "matchAll": lambda me, v: lambda r: [_groups(m) for m in r.re.finditer(v)],
    "search": lambda me, v: lambda r: float(m.start()) if (m := r.re.search(v)) else -1.0,
    "localeCompare": lambda me, v: lambda s: float((v > s) - (v < s)),
    "toString": lambda me, v: lambda: v,
    "at": lambda me, v: lambda k: v[int(k)] if -len(v) <= k < len(v) else UNDEFINED,
    "codePointAt": lambda me, v: lambda k=0.0: float(ord(v[int(k)])),
    "normalize": lambda me, v: lambda form="NFC": __import__("unicodedata").normalize(form, v),
}


def _base(n: int, base: int) -> str:
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    m = abs(n)
    while m or not out:
        out = digits[m % base] + out
        m //= base
    return "-" * (n < 0) + out


def _flat(v: list, depth: float) -> list:
    return [y for x in v for y in (_flat(x, depth - 1) if isinstance(x, list) and depth >= 1 else [x])]


def _groups(m: re.Match | None):
    return None if m is None else [UNDEFINED if g is None else g for g in (m[0], *m.groups())]


def _match(v: str, r):
    r = r if isinstance(r, Regex) else Regex(text(r))
    if "g" in r.flags:
        return [m[0] for m in r.re.finditer(v)] or None
    return _groups(r.re.search(v))


def _split(v: str, s) -> list:
    if s is UNDEFINED:
        return [v]
    if isinstance(s, Regex):
        return [UNDEFINED if x is None else x for x in s.re.split(v)]
    return list(v) if s == "" else v.split(text(s))


@functools.lru_cache(256)
def compile_script(code: str) -> tuple:
    """The body of a script. One without ``return`` gives the value of its expression."""
    stripped = code.strip().removesuffix(";").strip()
    if not re.search(r"\breturn\b", re.sub(r"""(["'`]).*?\1""", "", stripped)):
        try:
            p = Parser(f"({stripped})")
            out = p.expression()
            if p.t[p.i][0] == "end":
                return (("return", out),)
        except ScriptError:
            pass
    return tuple(Parser(code).program())


def run_script(code: str, document: dict, settings: dict | None = None):
    """The script's result, as JSON values; None for undefined and null."""
    settings = settings or {}
    names = {"input": from_json(document), "inputSchema": from_json(settings.get("inputSchema")), "outputSchema": from_json(settings.get("outputSchema")), "manualInputs": from_json(settings.get("manual_inputs") or [])}
    machine = Interpreter(names)
    try:
        machine.run(list(compile_script(code)), {})
    except _Return as r:
        return to_json(r.value)
    return None


@N.register("plugin-js")
def script_node(v, settings: dict):
    """Runs ``script``; an object is the output, another value is its ``result``, nothing is the empty object."""
    return N.python_node(script_function(settings))(v, settings)


def script_function(settings: dict):
    """The script as a function of the input document."""
    code = settings.get("script") or ""
    if not code.strip():
        raise ValueError("a script node needs a script")
    compile_script(code)  # a script that can't be read is found where the plan is built
    return Script(code, {k: x for k, x in settings.items() if k != "script"})


script_node.function_of = script_function


class Script:
    """A script as a function of the input document; ``steady`` is whether the last run would always end as it did."""

    def __init__(self, code: str, settings: dict):
        self.code, self.settings, self.steady = code, settings, False

    def __call__(self, document):
        before = _CHANCES[0]
        try:
            return run_script(self.code, document, self.settings)
        finally:
            self.steady = _CHANCES[0] == before
