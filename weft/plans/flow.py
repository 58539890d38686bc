"""Workflow units compiled to projections.

A unit is a parent document and embedded nodes, joined by mappings. What a node's mappings
lead to is one column, its output the next; values keep their types from node to node, and
a document is put together only where one is asked for. A node inside iterations over
arrays has columns of arrays, as deep as the iteration. Each array has a frame, with the
item and what nodes made of it; what a node reads at an outer level is handed down to the
items. Columns stand only as arguments of ``transform`` and ``zip_with``, never inside of
their functions, where the optimizer would let them be computed again for every item. So a
unit needs no shuffle, whatever it iterates over, and nodes that run Python in Arrow
batches stand anywhere in it.

A node's output is a struct of data, ran, error and errorDescription. Errors are values:
with a listener the flow goes on, without one the row is marked as failed. A row whose
iterations have more than ``MOST_COMBINATIONS`` items is failed before any node runs on
them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft import paths
from weft.functions import bind
from weft.functions import nodes as N
from weft.functions import scripts  # noqa: F401  its node type is registered
from weft.functions.inputs import VARIANT, Input, Made, Value, null
from weft.operators import documents as D
from weft.operators import json_schema as J

MOST_LEVELS = 10
MOST_COMBINATIONS = 100_000
ERROR_SECTION = "pluginError"

Context = tuple[tuple[str, tuple[str, ...]], ...]


@dataclass(frozen=True)
class Mapping:
    """An edge. An EVENT mapping that is a trigger gates the node; one that is none passes its value as data."""

    source: str
    path: str = ""
    targets: tuple[str, ...] = ("",)
    kind: str = "FIELD"
    iterate: bool = False
    trigger: bool = False
    section: str = "default"

    @property
    def is_data(self) -> bool:
        return not (self.kind == "EVENT" and self.trigger)


@dataclass(frozen=True)
class NodeDef:
    id: str
    type: str
    settings: dict = field(default_factory=dict)
    mappings: tuple[Mapping, ...] = ()
    depth: int = 0
    order: int = 0


@dataclass(frozen=True)
class Unit:
    parent: str
    nodes: tuple[NodeDef, ...]

    def ordered(self) -> list[NodeDef]:
        return sorted(self.nodes, key=lambda n: (n.depth, n.order))

    def problems(self, prior: tuple[str, ...] = ()) -> list[str]:
        """What is wrong with the plan: missing or equal ids, unknown types and sources, equal places in the order."""
        out, seen = [], {self.parent, *prior}
        ids = [n.id for n in self.nodes]
        out += [f"node id {i!r} is missing or not unique" for i in dict.fromkeys(ids) if not i or ids.count(i) > 1]
        out += [f"node {n.id}: unknown type {n.type!r}" for n in self.nodes if n.type not in N.NODES]
        at = [(n.depth, n.order) for n in self.nodes]
        out += [f"node {n.id}: another node has the same depth and order" for n in self.nodes if at.count((n.depth, n.order)) > 1]
        for n in self.ordered():
            out += [f"node {n.id}: source {m.source!r} is not known before it" for m in n.mappings if m.source not in seen]
            seen.add(n.id)
        return out

    def listeners(self, node: str) -> bool:
        """Whether some mapping takes the node's error."""
        return any(m.source == node and (m.section == ERROR_SECTION or (m.kind == "EVENT" and m.path.strip("/") == "error")) for n in self.nodes for m in n.mappings)


def contexts(unit: Unit) -> dict[str, Context]:
    """The arrays around each node, outermost first; a node without iteration runs where its sources run."""
    out: dict[str, Context] = {}
    for n in unit.ordered():
        best: Context = ()
        for m in n.mappings:
            base = out.get(m.source, ())
            p = paths.parse(m.path)
            if m.iterate and p.arrays:
                base = base + tuple((m.source, names) for names in p.parts[: p.arrays])
                if out.get(m.source) and base[: len(out[m.source])] != out[m.source]:
                    raise ValueError(f"node {n.id}: can't iterate {m.path!r}")
            if len(base) > len(best):
                best = base
        if len(best) > MOST_LEVELS:
            raise ValueError(f"node {n.id}: more than {MOST_LEVELS} nested arrays")
        out[n.id] = best
    return out


_FLAGS = "ran:boolean,error:boolean,errorDescription:string"


@dataclass(frozen=True)
class Shape:
    """What is known of a node's output: its members with their types, or nothing (then its data is a VARIANT)."""

    members: tuple[tuple[str, str], ...] | None = None
    optional: tuple[str, ...] = ()

    @property
    def ddl(self) -> str:
        if self.members is None:
            return f"struct<data:variant,{_FLAGS}>"
        return "struct<" + "".join(f"`m{k}`:{kind}," for k, (_, kind) in enumerate(self.members)) + _FLAGS + ">"


@dataclass(frozen=True)
class Out:
    """A node's output at one place: a struct Column."""

    col: Column
    shape: Shape

    @property
    def ok(self) -> Column:
        return self.col["ran"] & ~self.col["error"]

    def members(self) -> list[tuple[str, Value]]:
        """Members, those of a known type where the node went well; the others are null."""
        return [(name, Value(self.col[f"m{k}"], kind)) for k, (name, kind) in enumerate(self.shape.members)]

    def data(self) -> Column:
        if self.shape.members is None:
            return self.col["data"]
        return F.when(self.ok, N._document_of(Made(dict(self.members()), optional=self.shape.optional))[0])

    def value(self, names: tuple[str, ...]) -> Value:
        if self.shape.members is None or not names:
            return Value(paths._down(self.data(), names))
        for name, x in self.members():
            if name == names[0]:
                there = self.ok & x.col.isNotNull() if name in self.shape.optional else self.ok
                return Value(paths._down(F.when(there, x.variant()), names[1:]))
        return Value(F.lit(None).cast(VARIANT))

    def text(self, names: tuple[str, ...]) -> Column | None:
        """A text member as such; null where the node did not go well. None if it is not known to be one."""
        for name, x in self.members() if self.shape.members is not None else ():
            if (name,) == names and x.kind == "string":
                return x.col
        return None


@dataclass(frozen=True)
class _Text(Value):
    """A VARIANT whose text is at hand."""

    said: Column | None = None

    def text(self) -> Column:
        return self.said


@dataclass(frozen=True)
class _Known:
    """Where a node's output is: its column, its name in frames, its shape and the arrays around it."""

    column: str
    name: str
    shape: Shape
    context: Context


def _common(a: Context, b: Context) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@dataclass(frozen=True)
class _Reader:
    """How a mapping is read by a node in a context, and at which level: that of the innermost array that its value depends on."""

    m: Mapping
    at: Context
    known: dict[str, _Known]
    docs: dict[str, str]

    @property
    def path(self) -> paths.Path:
        return paths.parse(self.m.path)

    def _item_level(self) -> int:
        p = self.path
        for k in range(len(self.at), 0, -1):
            own = [names for s, names in self.at[:k] if s == self.m.source]
            if self.at[k - 1][0] != self.m.source or not own or len(p.parts) < len(own) or list(p.parts[: len(own)]) != own:
                continue
            return k if p.parts[len(own) :] or p.each else 0
        return 0

    @property
    def level(self) -> int:
        if k := self._item_level():
            return k
        return self.out_level if self.m.source in self.known else 0

    @property
    def out_level(self) -> int:
        return _common(self.known[self.m.source].context, self.at)

    @property
    def around(self) -> int:
        """Arrays that are still around the source's output where it is read."""
        return len(self.known[self.m.source].context) - self.out_level

    def out(self, frame: Column | None) -> Out:
        """The source's output, from a frame of its level."""
        k = self.known[self.m.source]
        return Out(F.col(k.column) if not self.out_level else frame[k.name], k.shape)

    def value(self, frame: Column | None) -> Value:
        m, p = self.m, self.path
        if k := self._item_level():
            own = [names for s, names in self.at[:k] if s == m.source]
            rest = p.parts[len(own) :]
            return Value(paths._get(frame["item"], rest) if rest else frame["item"])
        if m.source not in self.known:
            return Value(self._read(F.col(self.docs[m.source])))
        out = self.out(frame)
        if self.around:
            read = lambda o: _event(Out(o, out.shape), m) if m.kind == "EVENT" else paths.get(Out(o, out.shape).data(), p)
            return Value(_gathered(out.col, self.around, read))
        if m.kind == "EVENT" or m.section == ERROR_SECTION:
            return Value(_event(out, m))
        if p.arrays:
            return Value(self._read(out.data()))
        whole, said = out.value(p.parts[0]), out.text(p.parts[0])
        return whole if said is None else _Text(whole.col, VARIANT, said)

    def _read(self, doc: Column) -> Column:
        # Beside an iteration an array's first element stands for it.
        return paths.first(doc, self.path) if self.at and self.path.arrays else paths.get(doc, self.path)


def _gathered(xs: Column, levels: int, read: Callable[[Column], Column]) -> Column:
    inner = read if levels == 1 else (lambda x: _gathered(x, levels - 1, read))
    return J._to_array(F.transform(xs, inner))


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast(VARIANT), null())


def _event(out: Out, m: Mapping) -> Column:
    name = m.path.strip("/")
    if not name:
        return out.data()
    own = out.value((name,)).variant()
    if name == "error":
        return F.coalesce(own, _flag(out.col["error"]))
    if name == "errorDescription":
        return F.coalesce(own, _flag(out.col["errorDescription"]))
    if name == "success":
        return F.coalesce(own, _flag(out.ok))
    return own


def _passes(v: Column) -> Column:
    """A trigger's value is there, not null and not false."""
    no = F.coalesce((F.try_variant_get(v, "$", "boolean") == F.lit(False)) & (F.schema_of_variant(v) == "BOOLEAN"), F.lit(False))
    return F.coalesce(v.isNotNull() & ~F.is_variant_null(v) & ~no, F.lit(False))


def is_batch(n: NodeDef) -> bool:
    """Whether the node runs Python."""
    return hasattr(N.NODES[n.type], "function") or hasattr(N.NODES[n.type], "function_of")


def _function(n: NodeDef) -> Callable[[dict], object]:
    node = N.NODES[n.type]
    return node.function_of(N.normalized_settings(n.settings)) if hasattr(node, "function_of") else node.function


def _targets(n: NodeDef) -> list[tuple[tuple[str, ...], Mapping]]:
    return [(tuple(x for x in t.strip("/").replace("//", "/").split("/") if x), m) for m in n.mappings if m.is_data for t in m.targets or ("",)]


def _apart(targets: list[tuple[tuple[str, ...], Mapping]]) -> bool:
    """Whether no target is the root, or stands at or above another."""
    all_ = [t for t, _ in targets]
    return all(all_) and not any(i != j and b[: len(a)] == a for i, a in enumerate(all_) for j, b in enumerate(all_))


@dataclass(frozen=True)
class _Plan:
    """What a node reads: fields by level, and how its gate and input are put together from them."""

    n: NodeDef
    readers: tuple[_Reader, ...]

    def fields(self, level: int, frame: Column | None) -> list[Column]:
        out = []
        for k, r in enumerate(self.readers):
            if self._may_fail and r.m.is_data and r.out_level == level:
                out.append(r.out(frame).col["error"].alias(f"e{k}"))
            if r.level != level:
                continue
            if r.m.kind == "EVENT" and r.m.trigger:
                out.append(_passes(r.value(frame).variant()).alias(f"g{k}"))
                continue
            x = r.value(frame)
            out.append(x.variant().alias(f"v{k}"))
            if isinstance(x, _Text):
                out.append(x.said.alias(f"t{k}"))
        return out

    @property
    def _data(self) -> list[tuple[int, _Reader]]:
        return [(k, r) for k, r in enumerate(self.readers) if r.m.is_data]

    @property
    def _may_fail(self) -> bool:
        """A node whose every source failed, and that did not ask for errors, is skipped."""
        return bool(self._data) and all(r.m.section == "default" and r.m.source in r.known and not r.around for _, r in self._data)

    def gate(self, d: Column) -> Column:
        gates = [d[f"g{k}"] for k, r in enumerate(self.readers) if r.m.kind == "EVENT" and r.m.trigger]
        if self._may_fail:
            gates.append(~reduce(lambda a, b: a & b, [d[f"e{k}"] for k, _ in self._data]))
        return reduce(lambda a, b: a & b, gates) if gates else F.lit(True)

    def input(self, d: Column) -> Input:
        numbers = {id(r.m): k for k, r in self._data}
        targets = _targets(self.n)
        if not _apart(targets):
            doc = J._to_object(J._empty_map())
            for names, m in targets:
                v = d[f"v{numbers[id(m)]}"]
                doc = F.when(v.isNull(), doc).otherwise(paths.put(doc, names, v))
            return Input(doc)
        top: dict = {}
        for names, m in targets:
            k, here = numbers[id(m)], top
            for x in names[:-1]:
                here = here.setdefault(x, {})
            here[names[-1]] = _Text(d[f"v{k}"], VARIANT, d[f"t{k}"]) if self._has_text(k) else Value(d[f"v{k}"])
        made = lambda t: Input(members={k: made(x) if isinstance(x, dict) else x for k, x in t.items()})
        return made(top)

    def _has_text(self, k: int) -> bool:
        r = self.readers[k]
        return isinstance(r.value(F.col("frame") if r.level else None), _Text)


def _shaped(n: NodeDef, doc: Input, p: Column | None, gate: Column) -> tuple[Column, Shape]:
    made = N.NODES[n.type].make(doc, N.normalized_settings(n.settings), p)
    shape = Shape(tuple((k, x.kind) for k, x in made.members.items()), made.optional)
    failed = F.lit(False) if made.error is None else made.error.isNotNull()
    said = F.lit("") if made.error is None else F.coalesce(made.error, F.lit(""))
    ok = gate & ~failed
    members = [F.when(ok, x.col).alias(f"m{k}") for k, x in enumerate(made.members.values())]
    return F.struct(*members, gate.alias("ran"), (gate & failed).alias("error"), F.when(gate, said).otherwise(F.lit("")).alias("errorDescription")).cast(shape.ddl), shape


def _plain(made: Column, gate: Column) -> Column:
    skipped = F.struct(F.lit(None).cast(VARIANT).alias("data"), F.lit(False).alias("ran"), F.lit(False).alias("error"), F.lit("").alias("errorDescription"))
    out = F.struct(made["data"].alias("data"), F.lit(True).alias("ran"), made["error"].alias("error"), made["errorDescription"].alias("errorDescription"))
    return F.when(gate, out.cast(Shape().ddl)).otherwise(skipped.cast(Shape().ddl))


def _each(col: Column, levels: int, f: Callable[[Column], Column]) -> Column:
    """``f`` of every element of arrays of so many levels."""
    return F.transform(col, lambda x: _each(x, levels - 1, f)) if levels else f(col)


def _both(a: Column, b: Column, levels: int, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of the elements of two arrays of so many levels and the same lengths."""
    return F.zip_with(a, b, lambda x, y: _both(x, y, levels - 1, f)) if levels else f(a, b)


def _members_of(xs: Column) -> Column:
    """Frames of the objects among elements; scalars alone are wrapped as ``$value``."""
    framed = lambda v: F.struct(v.alias("item"))
    whole = F.transform(F.filter(xs, lambda x: J.members(x).isNotNull()), framed)
    wrapped = F.transform(xs, lambda x: framed(J._to_object(F.create_map(F.lit("$value"), x))))
    return F.coalesce(F.when(F.exists(xs, lambda x: J.members(x).isNotNull()) | (F.size(xs) == 0), whole).otherwise(wrapped), F.array().cast("array<struct<item:variant>>"))


def _names(struct: Column, names: list[str]) -> list[Column]:
    return [struct[x].alias(x) for x in names]


def _handed_down(plan: _Plan, level: int, have: list[str]) -> Callable[[Column, Column], Column]:
    """From a struct of fields and an array of frames: of each frame the same fields and those of its level."""
    return lambda w, xs: F.transform(xs, lambda f: F.struct(*_names(w, have), *plan.fields(level, f)))


def run_nodes(df: DataFrame, unit: Unit, parent: str, prior: dict[str, str]) -> tuple[DataFrame, dict[str, _Known]]:
    """Adds columns whose names begin with two underscores; where the nodes' outputs are, and ``__most``, the number of items if it is too large."""
    if problems := unit.problems(tuple(prior)):
        raise ValueError("; ".join(problems))
    where, docs = contexts(unit), {unit.parent: parent, **prior}
    known: dict[str, _Known] = {}
    frames: dict[Context, tuple[str, list[str]]] = {}
    df = df.withColumn("__most", F.lit(None).cast("long"))

    def framed(df: DataFrame, c: Context) -> DataFrame:
        """With the frame of an array: its items."""
        (source, names), levels, name = c[-1], len(c) - 1, f"__f{len(frames)}"
        if not levels:
            holder = Out(F.col(known[source].column), known[source].shape).data() if source in known else F.col(docs[source])
            found = J.elements(paths._down(holder, names))
        else:
            inside = (lambda f: f["item"]) if c[-2][0] == source else (lambda f: Out(f[known[source].name], known[source].shape).data())
            found = _each(F.col(frames[c[:-1]][0]), levels, lambda f: J.elements(paths._down(inside(f), names)))
        df = df.withColumn(f"{name}_", found)
        count = F.col(f"{name}_")
        for _ in range(levels):
            count = F.flatten(F.filter(count, lambda x: x.isNotNull()))
        most = F.coalesce(F.size(count), F.lit(0)).cast("long")
        df = df.withColumn("__most", F.greatest("__most", F.when(most > MOST_COMBINATIONS, most)))
        none = F.array().cast("array<" * (levels + 1) + "struct<item:variant>" + ">" * (levels + 1))
        frames[c] = (name, ["item"])
        return df.withColumn(name, F.when(F.col("__most").isNull(), _each(F.col(f"{name}_"), levels, _members_of)).otherwise(none)).drop(f"{name}_")

    def read(df: DataFrame, plan: _Plan, c: Context, name: str) -> DataFrame:
        """With what a node reads: the fields of each level, handed down to the items of the next."""
        df = df.withColumn(name, F.struct(F.lit(0).alias("_"), *plan.fields(0, None)))
        for level in range(1, len(c) + 1):
            names = df.schema[name].dataType
            for _ in range(level - 1):
                names = names.elementType
            frame = F.col(frames[c[:level]][0])
            down = _handed_down(plan, level, names.names)
            if level == 1:  # in an array of one, so that it stands as an argument
                df = df.withColumn(name, F.flatten(F.zip_with(F.array(F.col(name)), F.array(frame), down)))
            else:
                df = df.withColumn(name, _both(F.col(name), frame, level - 1, down))
        return df

    for k, n in enumerate(unit.ordered()):
        c = where[n.id]
        for depth in range(1, len(c) + 1):
            if c[:depth] not in frames:
                df = framed(df, c[:depth])
        plan = _Plan(n, tuple(_Reader(m, c, dict(known), docs) for m in n.mappings))
        df = read(df, plan, c, f"__d{k}")
        d, node, settings, levels, shape = F.col(f"__d{k}"), N.NODES[n.type], N.normalized_settings(n.settings), len(c), Shape()
        if is_batch(n):
            texts = _each(d, levels, lambda x, plan=plan: F.when(plan.gate(x), F.to_json(plan.input(x).column())))
            # From an array of one, so that the optimizer does not put the texts' expressions back into the Python call, where it can't run them.
            df = df.select("*", F.explode(F.array(texts)).alias(f"__s{k}"))
            df = df.withColumn(f"__t{k}", N.run_python(_function(n), levels)(F.col(f"__s{k}")))
            made = _each(F.col(f"__t{k}"), levels, lambda x: _plain(N.answered(x), x.isNotNull()))
        elif hasattr(node, "make"):
            prepare, shapes = getattr(node, "prepare", None), []
            if prepare is not None:
                df = df.withColumn(f"__d{k}", _each(d, levels, lambda x, plan=plan, f=prepare, s=settings: F.struct(x.alias("d"), f(plan.input(x), s).alias("p"))))

            def build(x: Column, plan: _Plan = plan, prepared: bool = prepare is not None, shapes: list = shapes) -> Column:
                given = x["d"] if prepared else x
                col, shape = _shaped(plan.n, plan.input(given), x["p"] if prepared else None, plan.gate(given))
                shapes.append(shape)
                return col

            made = _each(d, levels, build)
            shape = shapes[0]
        else:
            made = _each(d, levels, lambda x, plan=plan, node=node, s=settings: _plain(node(plan.input(x).column(), s), plan.gate(x)))
        df = df.withColumn(f"__o{k}", made)
        known[n.id] = _Known(f"__o{k}", f"o{k}", shape, c)
        if c and any(m.source == n.id for x in unit.nodes for m in x.mappings):
            name, have = frames[c]
            df = df.withColumn(name, _both(F.col(name), F.col(f"__o{k}"), levels, lambda f, o, have=tuple(have), k=k: F.struct(*_names(f, have), o.alias(f"o{k}"))))
            have.append(f"o{k}")
        df = df.drop(f"__d{k}", f"__s{k}", f"__t{k}")
    return df, known


# ---- outputs by flat key


def _flat(node: str, col: Column, shape: Shape, levels: int, index: tuple[Column, ...] = ()) -> Column:
    """Entries of a node's output with its item numbers as suffix."""
    if levels:
        return F.flatten(F.transform(col, lambda x, i: _flat(node, x, shape, levels - 1, (*index, i))))
    out, none = Out(col, shape), F.array().cast(D.ENTRIES)
    entry = lambda key, v: F.struct(F.lit(f"{node}-/{key}").alias("key"), v.alias("value"))
    flags = [entry(k, _flag(col[k])) for k in ("error", "errorDescription")]
    if shape.members is None:
        own = D.flat_entries(out.data(), F.lit(f"{node}-"))
        has = lambda es: F.exists(es, lambda e: e["key"] == f"{node}-/error")
        whole = bind(own, lambda es: F.concat(es, F.when(has(es), none).otherwise(F.array(*flags))))
    else:
        parts = []
        for name, x in out.members():
            leaf = F.array(entry(name, F.coalesce(x.variant(), null())))
            if x.kind == VARIANT:
                leaf = F.when(D._is_open(x.col), D.flat_entries(x.col, F.lit(f"{node}-/{name}"))).otherwise(leaf)
            parts.append(F.when(out.ok & (x.col.isNotNull() if name in shape.optional else F.lit(True)), leaf).otherwise(none))
        whole = F.concat(*parts, F.array(*flags))
    keyed = F.transform(whole, lambda e: F.struct(paths.with_index(e["key"], *index).alias("key"), e["value"].alias("value"))) if index else whole
    return F.when(col["ran"], keyed).otherwise(none)


def run_unit(df: DataFrame, unit: Unit, parent: str = "parent", prior: dict[str, str] | None = None) -> DataFrame:
    """Adds ``output`` (flat keys to VARIANT), ``events`` (those of nodes, and the parent's error) and ``failure``.

    ``failure`` is the first error that no mapping listens to; such a row belongs to the failed sink.
    """
    keep = [c for c in df.columns if c not in ("output", "events", "failure")]
    df, known = run_nodes(df, unit, parent, prior or {})
    entries, failures = [], [F.when(F.col("__most").isNotNull(), F.concat(F.lit("iterations over "), F.col("__most").cast("string"), F.lit(f" items; {MOST_COMBINATIONS} are the most")))]
    for n in unit.ordered():
        c, col = known[n.id].context, F.col(known[n.id].column)
        entries.append(_flat(n.id, col, known[n.id].shape, len(c)))
        if not unit.listeners(n.id):
            flat = col
            for _ in range(len(c) - 1):
                flat = F.flatten(flat)
            failures.append(F.get(F.filter(flat, lambda o: o["error"]), F.lit(0))["errorDescription"] if c else F.when(flat["error"], flat["errorDescription"]))
    own, none = D.flat_entries(F.col(parent), F.lit(f"{unit.parent}-")), F.array().cast(D.ENTRIES)
    said = [(f"{unit.parent}-/error", F.parse_json(F.lit("false"))), (f"{unit.parent}-/errorDescription", F.parse_json(F.lit('""')))]
    flags = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in said])
    df = df.withColumns({"__own": own, "__nodes": F.when(F.col("__most").isNull(), F.concat(*entries)).otherwise(none) if entries else none})
    has = [F.array_contains(F.transform("__own", lambda e: e["key"]), k) for k, _ in said]
    added = F.when(has[0], none).when(has[1], F.slice(flags, 1, 1)).otherwise(flags)
    df = df.withColumn("__own", F.concat("__own", added))
    shown = F.filter("__own", lambda e: e["key"].isin(*[k for k, _ in said]))
    return df.select(*keep, F.map_from_entries(F.concat("__own", "__nodes")).alias("output"), F.map_from_entries(F.concat(shown, F.col("__nodes"))).alias("events"), F.coalesce(*failures).alias("failure"))
