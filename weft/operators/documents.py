"""Shaping of documents: flat keys and back, items by index, arrays to rows and rows to arrays."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft import paths
from weft.functions import bind
from weft.operators.json_schema import _to_array, _to_object, elements, members

ENTRIES = "array<struct<key:string,value:variant>>"


def _is_open(v: Column) -> Column:
    """Whether a value is an object with members."""
    return F.coalesce(F.size(members(v)) > 0, F.lit(False))


def _inner(v: Column, prefix: Column) -> Column:
    return F.transform(F.map_entries(members(v)), lambda e: F.struct(F.concat(prefix, F.lit("/"), e["key"]).alias("key"), e["value"].alias("value")))


def flat_entries(v: Column, prefix: Column) -> Column:
    """Entries (key, value) of an object's leaves at any depth, arrays and empty objects being leaves; none for anything else.

    Objects are opened level by level until none is left. There are no more levels than objects in the value's schema.
    """
    first = F.coalesce(_inner(v, prefix), F.array().cast(ENTRIES))
    more = lambda es: F.exists(es, lambda e: _is_open(e["value"]))
    opened = lambda es: F.flatten(F.transform(es, lambda e: F.when(_is_open(e["value"]), _inner(e["value"], e["key"])).otherwise(F.array(e))))
    levels = F.array_repeat(F.lit(0), F.size(F.split(F.schema_of_variant(v), "OBJECT<")))
    step = lambda s, _: F.when(s["on"] & more(s["es"]), F.struct(opened(s["es"]).cast(ENTRIES).alias("es"), F.lit(True).alias("on"))).otherwise(F.struct(s["es"].cast(ENTRIES).alias("es"), F.lit(False).alias("on")))
    return bind(first.cast(ENTRIES), lambda es: F.when(more(es), F.aggregate(levels, F.struct(es.alias("es"), F.lit(True).alias("on")), step)["es"]).otherwise(es))


def flatten(v: Column, node: str, root: bool = True) -> Column:
    """A document as a map of ``node-/a/b`` to VARIANT, at any depth; arrays stay whole. ``root`` adds the document itself under ``node-/``."""
    inner = flat_entries(v, F.lit(f"{node}-"))
    return F.map_from_entries(F.concat(F.array(F.struct(F.lit(f"{node}-/").alias("key"), v.alias("value"))), inner) if root else inner)


def flatten_struct(node: str, schema: T.StructType, prefix: str = "") -> Column:
    """Typed rows as a map of flat keys to text, walked on the driver."""
    pairs: list[Column] = []

    def walk(kind: T.StructType, col: Callable[[str], Column], path: str) -> None:
        for f in kind.fields:
            x = col(f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, x.getField, f"{path}/{f.name}")
            else:
                text = F.to_json(x) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else x.cast("string")
                pairs.extend((F.lit(f"{node}-{path}/{f.name}"), text))

    walk(schema, lambda n: F.col(f"`{prefix}{n}`"), "")
    return F.create_map(*pairs)


def flatten_items(v: Column, node: str) -> Column:
    """Entries of a document's members, with the objects of its arrays opened by their place: ``node-/xs/0/name``."""

    def one(e: Column) -> Column:
        xs = elements(e["value"])
        item = lambda x, i: F.when(_is_open(x), flat_entries(x, F.concat(e["key"], F.lit("/"), i.cast("string")))).otherwise(F.array(F.struct(F.concat(e["key"], F.lit("/"), i.cast("string")).alias("key"), x.alias("value"))))
        return F.when(F.size(xs) > 0, F.flatten(F.transform(xs, item))).otherwise(F.array(e))

    return F.flatten(F.transform(flat_entries(v, F.lit(f"{node}-")), one))


def reindexed(m: Column) -> Column:
    """The map with ``key[i]`` beside every key whose value is an array."""
    each = F.transform(F.map_entries(m), lambda e: F.transform(F.coalesce(elements(e["value"]), F.array().cast("array<variant>")), lambda x, i: F.struct(paths.with_index(e["key"], i).alias("key"), x.alias("value"))))
    return merge(m, F.map_from_entries(F.flatten(each)))


def without_roots(m: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~k.endswith("-/"))


def of_node(m: Column, node: str) -> Column:
    return F.map_filter(m, lambda k, _: k.startswith(f"{node}-/"))


def node_ids(m: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.map_keys(m), paths.key_node)))


def merge(*maps: Column) -> Column:
    """Maps one after another; a later one's members stand."""
    return reduce(paths._merged, maps)


def value_at(m: Column, key: str, i: Column | int) -> Column:
    """The indexed value, or the one without index."""
    return F.coalesce(F.element_at(m, paths.with_index(F.lit(key), F.lit(i) if isinstance(i, int) else i)), F.element_at(m, F.lit(key)))


def item(m: Column, i: int) -> Column:
    """Members whose first index is ``i``."""
    return F.map_filter(m, lambda k, _: F.get(paths.key_index(k), F.lit(0)) == i)


def item_count(m: Column) -> Column:
    """One more than the largest first index; 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.map_keys(m), lambda k: F.get(paths.key_index(k), F.lit(0)))) + 1, F.lit(0))


def no_error_defaults(m: Column) -> Column:
    """``error`` false and an empty ``errorDescription``, unless ``error`` is there."""
    extra = F.map_from_arrays(F.array(F.lit("error"), F.lit("errorDescription")), F.array(F.parse_json(F.lit("false")), F.parse_json(F.lit('""'))))
    return F.when(F.map_contains_key(m, F.lit("error")), m).otherwise(merge(extra, m))


def drop_member(v: Column, name: str) -> Column:
    return bind(members(v), lambda m: _to_object(F.map_filter(m, lambda k, _: k != name)))


def transposed(v: Column) -> Column:
    """An object of arrays of one length as an array of objects; null for anything else."""

    def rows(m: Column) -> Column:
        cols = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), elements(e["value"]).alias("xs")))

        def build(cs: Column) -> Column:
            sizes = F.transform(cs, lambda c: F.size(c["xs"]))
            ok = (F.size(cs) > 0) & (F.array_min(sizes) == F.array_max(sizes)) & ~F.exists(cs, lambda c: c["xs"].isNull()) & (F.array_max(sizes) > 0)
            each = F.transform(
                F.when(ok, F.sequence(F.lit(0), F.array_max(sizes) - 1)),
                lambda i: _to_object(F.map_from_entries(F.transform(cs, lambda c: F.struct(c["key"].alias("key"), F.get(c["xs"], i).alias("value"))))),
            )
            return F.when(ok, _to_array(each))

        return bind(cols, build)

    return bind(members(v), rows)


def unwrapped(v: Column) -> Column:
    """An object with one member is that member; of an array, each of its elements."""
    one = lambda x: bind(members(x), lambda m: F.when(F.size(m) == 1, F.get(F.map_values(m), F.lit(0))).otherwise(x))
    return bind(elements(v), lambda xs: F.when(xs.isNotNull(), _to_array(F.transform(xs, one))).otherwise(one(v)))


def truncate_udf(level: int):
    """Text of JSON to text of JSON, cut below the level. Depth has no bound in a VARIANT, so this is a batch function."""

    def cut(x, left: int):
        if isinstance(x, dict):
            return {"__truncated": True} if left <= 0 else {k: cut(v, left - 1) for k, v in x.items()}
        if isinstance(x, list):
            return ["__truncated"] if left <= 0 else [cut(v, left - 1) for v in x]
        return x

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(cut(json.loads(t), level)))

    return run


# ---- the long form: (key columns, node, path, idx, value)


def long_form(df: DataFrame, flat: str, *keep: str) -> DataFrame:
    """One row per flat key."""
    each = df.select(*keep, F.explode_outer(flat).alias("key", "value")).where("key IS NOT NULL")  # see issues.exploded
    return each.select(*keep, paths.key_node(F.col("key")).alias("node_id"), paths.key_path(F.col("key")).alias("path"), paths.key_index(F.col("key")).alias("idx"), "value")


def collected(df: DataFrame, keys: list[str], position: str, value: str, out: str = "items") -> DataFrame:
    """Values of each key as an array in order of their positions, which need not be dense: a hole is null."""
    got = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(position), F.col(value)))).alias("__m"))
    most = F.array_max(F.map_keys("__m"))
    return got.select(*keys, F.transform(F.sequence(F.lit(0), most), lambda i: F.element_at("__m", i)).alias(out))


def documents_of(flat: Column) -> Column:
    """A flat map as a map of node to document: the root key if there is one, else nested members and arrays by index."""

    def build(entries: dict) -> dict:
        out: dict = {}
        roots = {k[:-2]: v for k, v in entries.items() if k.endswith("-/")}
        rest: dict[str, list] = {}
        for k, v in entries.items():
            if "-/" in k and not k.endswith("-/"):
                node, path = k.split("-/", 1)
                rest.setdefault(node, []).append((path, v))
        for node, pairs in rest.items():
            doc: dict = {}
            for path, v in sorted(pairs):
                _place(doc, path, v)
            out[node] = _arrays(doc)
        return out | roots

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(build(json.loads(t))))

    return F.variant_get(F.parse_json(run(F.to_json(flat))), "$", "map<string,variant>")


def _place(doc: dict, path: str, value) -> None:
    """Sets a value at ``a/b[0]/c[1]``; arrays are dicts by number until they are closed."""
    steps: list = []
    for part in path.split("/"):
        name, *index = part.replace("]", "").split("[")
        steps += [name, *(int(i) for i in index)]
    here = doc
    for s in steps[:-1]:
        here = here.setdefault(s, {})
        if not isinstance(here, dict):  # a value stands in the way
            return
    here.setdefault(steps[-1], value)


def _arrays(x):
    if not isinstance(x, dict):
        return x
    if x and all(isinstance(k, int) for k in x):
        return [_arrays(x.get(i)) for i in range(max(x) + 1)]
    return {str(k): _arrays(v) for k, v in x.items()}


def fewest_brackets(df: DataFrame, flat: str, *keys: str) -> DataFrame:
    """Of keys that differ only in numbers inside the path, the one with the fewest; (keys, node_id, path, idx, value)."""
    from pyspark.sql import Window

    rows = df.select(*keys, F.explode_outer(flat).alias("key", "value")).where("key IS NOT NULL")  # see issues.exploded
    plain = F.regexp_replace(paths.key_path(F.col("key")), r"\[\d+\]", "")
    rows = rows.select(*keys, "key", paths.key_node(F.col("key")).alias("node_id"), plain.alias("path"), paths.key_index(F.col("key")).alias("idx"), "value")
    last = F.coalesce(F.get(F.reverse("idx"), F.lit(0)), F.lit(-1))
    w = Window.partitionBy(*keys, "node_id", "path", "__last").orderBy(F.size("idx"), "key")
    best = rows.withColumn("__last", last).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return best.select(*keys, "node_id", "path", "idx", "value")
