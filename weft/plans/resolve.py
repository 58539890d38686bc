"""Input of a unit from the results of earlier units of the same run.

Results are rows (workflow_id, run_id, node_id, status, data). They are joined to runs by
key, one map of documents per run; mappings are then Column expressions on that map.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft import paths
from weft.functions import bind
from weft.operators import documents as D
from weft.operators import json_schema as J
from weft.plans.flow import Mapping

RUN = ("workflow_id", "run_id")


def successful(results: DataFrame) -> DataFrame:
    return results.where(F.lower("status") == "success")


def latest(results: DataFrame, order: str, keys: tuple[str, ...] = (*RUN, "node_id")) -> DataFrame:
    """The last result of each node, as an upsert would leave it."""
    others = [c for c in results.columns if c not in keys]
    # A VARIANT can't be compared, so the order alone goes into the maximum.
    return results.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__r")).select(*keys, "__r.*")


def documents_by_run(results: DataFrame, needed: list[str] | None = None, flat: bool = False) -> DataFrame:
    """(workflow_id, run_id, sources): a map of node to document. ``needed`` prunes nodes before the shuffle.

    ``flat`` says that ``data`` is one unit's flat output; then its keys are made documents again, by node.
    """
    rows = successful(results)
    if flat:
        docs = D.documents_of(F.variant_get("data", "$", "map<string,variant>"))
        rows = rows.select(*RUN, F.explode(docs).alias("node_id", "data"))
    if needed is not None:
        rows = rows.where(F.col("node_id").isin(needed))
    return rows.groupBy(*RUN).agg(F.map_from_entries(F.collect_list(F.struct("node_id", "data"))).alias("sources"))


def seeded(runs: DataFrame, results: DataFrame, needed: list[str] | None = None) -> DataFrame:
    """The runs with ``sources``; a run without results has an empty map."""
    docs = documents_by_run(results, needed)
    return runs.join(docs, list(RUN), "left").withColumn("sources", F.coalesce("sources", J._empty_map()))


@dataclass(frozen=True)
class _Field:
    mapping: Mapping
    names: tuple[str, ...]


def _found(sources: Column, m: Mapping) -> Column:
    """The value of a mapping: at its path, at a flat key, or below ``data`` or ``result``."""
    doc = F.element_at(sources, F.lit(m.source))
    p = paths.parse(m.path)
    tries = [paths.get(doc, p)]
    if p.parts != ((),) and len(p.parts) == 1:
        flat = J.members(doc)
        key = "/" + "/".join(p.parts[0])
        tries.append(F.element_at(flat, F.lit(paths.flat_key(m.source, key))))
        tries.append(_indexed(flat, paths.flat_key(m.source, key)))
    if p.parts != ((),) and p.parts[0][:1] not in (("data",), ("result",)):
        tries += [paths.get(paths.member(doc, k), p) for k in ("data", "result")]
    present = lambda v: F.when(v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False)), v)
    return F.coalesce(*[present(t) for t in tries])


def _indexed(flat: Column, key: str) -> Column:
    """An array from ``key[0]``, ``key[1]``, ...; objects at one place are merged, of other values the first stays."""
    own = F.filter(F.map_entries(flat), lambda e: e["key"].startswith(f"{key}[") & (F.size(paths.key_index(e["key"])) == 1))
    rows = F.transform(own, lambda e: F.struct(F.get(paths.key_index(e["key"]), F.lit(0)).alias("i"), e["value"].alias("v")))

    def placed(es: Column) -> Column:
        most = F.array_max(F.transform(es, lambda e: e["i"]))
        there = lambda i: F.transform(F.filter(es, lambda e: e["i"] == i), lambda e: e["v"])
        merged = lambda vs: F.aggregate(F.transform(vs, J.members), J._empty_map(), lambda acc, m: paths._merged(acc, m))
        at = lambda i: bind(there(i), lambda vs: F.when((F.size(vs) > 1) & F.forall(vs, lambda v: J.members(v).isNotNull()), J._to_object(merged(vs))).otherwise(F.get(vs, F.lit(0))))
        return F.when(F.size(es) > 0, J._to_array(F.transform(F.sequence(F.lit(0), most), at)))

    return bind(rows, placed)


def primary_source(mappings: list[Mapping]) -> str:
    """The source most mapped into a collection; of equals the least id."""
    count = Counter(m.source for m in mappings)
    return min(count, key=lambda s: (-count[s], s))


def _collection(sources: Column, fields: list[_Field]) -> tuple[Column, Column]:
    """(array, error): the fields' arrays merged element by element, scalars repeated."""
    first = primary_source([f.mapping for f in fields])
    ordered = sorted(fields, key=lambda f: (f.mapping.source != first,))
    values = F.struct(*[D.unwrapped(_found(sources, f.mapping)).alias(f"v{k}") for k, f in enumerate(ordered)])

    def build(s: Column) -> Column:
        arrays = [J.elements(s[f"v{k}"]) for k in range(len(ordered))]
        sizes = [F.when(a.isNotNull(), F.size(a)) for a in arrays]
        n = F.coalesce(*sizes)  # of the primary source, which iterated arrays must agree with
        wrong = F.lit(None).cast("string")
        for k, f in enumerate(ordered):
            if f.mapping.iterate:
                said = F.concat(F.lit(f"length of {f.mapping.source}{f.mapping.path} is "), sizes[k].cast("string"), F.lit(" but the collection has "), n.cast("string"))
                wrong = F.coalesce(wrong, F.when(sizes[k] != n, said))

        def item(i: Column) -> Column:
            doc = J._to_object(J._empty_map())
            for k, f in enumerate(ordered):
                v = F.when(arrays[k].isNotNull(), F.get(arrays[k], i)).otherwise(s[f"v{k}"])
                doc = bind(F.struct(doc.alias("d"), v.alias("v")), _put(f.names))
            return doc

        most = F.array_max(F.array(*sizes))  # an array that is not iterated may be longer, and keeps its tail
        rows = J._to_array(F.transform(F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>")), item))
        return F.struct(F.when(n.isNotNull() & wrong.isNull(), rows).alias("rows"), wrong.alias("error"))

    made = bind(values, build)
    return made["rows"], made["error"]


def _put(names: tuple[str, ...]):
    return lambda s: F.when(s["v"].isNull(), s["d"]).otherwise(paths.put(s["d"], names, s["v"]))


def resolve(sources: Column, mappings: list[Mapping], trigger: Column | None = None) -> Column:
    """Struct (data, error) of a unit's input.

    Targets like ``/items//name`` fill a collection of objects; others take a value each, and missing ones are
    left out. If nothing at all is found, the error names every mapping. Without mappings the input is
    ``trigger``, or else the empty object.
    """
    empty = J._to_object(J._empty_map())
    data = [m for m in mappings if m.is_data]
    none = F.lit(None).cast("string")
    if not data:
        return F.struct((F.coalesce(trigger, empty) if trigger is not None else empty).alias("data"), none.alias("error"))
    groups: dict[tuple[str, ...], list[_Field]] = {}
    plain: list[tuple[tuple[str, ...], Mapping]] = []
    for m in data:
        for target in m.targets or ("",):
            p = paths.parse(target)
            if len(p.parts) > 1:
                groups.setdefault(p.parts[0], []).append(_Field(m, tuple(x for part in p.parts[1:] for x in part)))
            else:
                plain.append((p.parts[0], m))
    parts: list[tuple[tuple[str, ...], Column, Column]] = []
    for names, fields in groups.items():
        rows, error = _collection(sources, fields)
        parts.append((names, rows, error))
    parts += [(names, _found(sources, m), none) for names, m in plain]
    values = F.struct(*[F.struct(v.alias("v"), e.alias("e")).alias(f"p{k}") for k, (_, v, e) in enumerate(parts)])

    def build(s: Column) -> Column:
        doc = empty
        for k, (names, _, _) in enumerate(parts):
            doc = bind(F.struct(doc.alias("d"), s[f"p{k}"]["v"].alias("v")), _put(names))
        error = F.coalesce(*[s[f"p{k}"]["e"] for k in range(len(parts))])
        missing = "no field could be resolved: " + "; ".join(f"{m.source}{m.path} -> {','.join(m.targets)}" for m in data)
        nothing = F.size(F.filter(F.array(*[s[f"p{k}"]["v"] for k in range(len(parts))]), lambda v: v.isNotNull())) == 0
        error = F.coalesce(error, F.when(nothing, F.lit(missing)))
        return F.struct(F.when(error.isNull(), doc).alias("data"), error.alias("error"))

    return bind(values, build)


def set_through(doc: Column, collection: tuple[str, ...], names: tuple[str, ...], value: Column) -> Column:
    """Deals a value out over a collection's objects: an array by place, up to the shorter length; anything else to each.

    A collection that is not there is made as long as the value.
    """
    xs = J.elements(paths._down(doc, collection))

    def deal(s: Column) -> Column:
        vs = J.elements(s["v"])
        have = F.coalesce(s["xs"], F.transform(F.when(F.size(vs) > 0, F.sequence(F.lit(1), F.size(vs))).otherwise(F.array().cast("array<int>")), lambda _: J._to_object(J._empty_map())))
        at = lambda i: F.when(vs.isNotNull(), F.get(vs, i)).otherwise(s["v"])
        new = F.transform(have, lambda x, i: F.when(at(i).isNull(), x).otherwise(paths.put(x, names, at(i))))
        return paths.put(s["d"], collection, J._to_array(new))

    return bind(F.struct(doc.alias("d"), xs.alias("xs"), value.alias("v")), deal)


def needed_sources(mappings: list[Mapping]) -> list[str]:
    """Node ids to read; everything else can be pruned at the scan."""
    return sorted({m.source for m in mappings})


def pruned_files(files: dict[str, list[str]], mappings: list[Mapping]) -> list[str]:
    """Of result files and the nodes they hold, those with a mapped node."""
    want = set(needed_sources(mappings))
    return sorted(f for f, nodes in files.items() if want & set(nodes))
