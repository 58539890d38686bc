"""Paths into documents: ``/a/b``, ``/arr//f`` (of every element), ``//f``, a trailing slash, ``a.b``, and flat keys."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions import bind
from weft.operators.json_schema import elements, members

ROOT_ITEMS = "$items"


@dataclass(frozen=True)
class Path:
    """Parts between double slashes; ``each`` says that the last part's elements are meant."""

    parts: tuple[tuple[str, ...], ...]
    each: bool = False

    @property
    def whole(self) -> bool:
        return self.parts == ((),) and not self.each

    @property
    def arrays(self) -> int:
        return len(self.parts) - 1 + self.each

    def __str__(self) -> str:
        return "/" + "//".join("/".join(p) for p in self.parts) + "/" * self.each


def parse(text: str) -> Path:
    """``""`` and ``/`` are the whole document; ``//f`` is ``/$items//f``."""
    text = text.strip()
    if text in ("", "/"):
        return Path(((),))
    if text.startswith("//"):
        text = f"/{ROOT_ITEMS}{text}"
    each = text.endswith("/") and len(text) > 1
    parts = tuple(tuple(x for x in p.split("/") if x) for p in text.strip("/").split("//"))
    return Path(parts, each)


def parse_dotted(text: str) -> Path:
    return Path((tuple(x for x in text.removeprefix("/").split(".") if x),))


def member(v: Column, name: str) -> Column:
    return _down(v, (name,))


def get(v: Column, path: Path | str) -> Column:
    """The value at a path as VARIANT; null if it is missing.

    Below a ``//`` the values of all elements, in order, with nulls kept: ``[]`` for an empty array, and null
    if the array is none or none of its elements is an object.
    """
    p = parse(path) if isinstance(path, str) else path
    return _get(v, p.parts)


def _down(v: Column, names: tuple[str, ...]) -> Column:
    """The member at the end of names, in one step; a name that the path of a VARIANT can't have takes a step of its own."""
    for plain, run in itertools.groupby(names, key=lambda n: bool(n) and "'" not in n):
        if plain:
            v = F.try_variant_get(v, "$" + "".join(f"['{n}']" for n in run), "variant")
        else:
            for n in run:
                v = F.element_at(members(v), F.lit(n))
    return v


def _get(v: Column, parts: tuple[tuple[str, ...], ...]) -> Column:
    here = _down(v, parts[0])
    if len(parts) == 1:
        return here

    def inside(xs: Column) -> Column:
        found = F.transform(xs, lambda x: _get(x, parts[1:]))
        some = (F.size(xs) == 0) | F.exists(xs, lambda x: members(x).isNotNull())
        return F.when(some, F.call_function("to_variant_object", found))

    return bind(elements(here), inside)


def first(v: Column, path: Path | str) -> Column:
    """As ``get``, but of each array before the last part the first element only."""
    p = parse(path) if isinstance(path, str) else path
    for k, names in enumerate(p.parts):
        v = _down(v, names)
        if k + 1 < len(p.parts):
            v = F.get(elements(v), F.lit(0))
    return v


def put(doc: Column, names: tuple[str, ...], value: Column) -> Column:
    """The object with the value at a path; objects on the way are made, and a value that is none there blocks the way."""
    from weft.operators.json_schema import _empty_map, _put, _to_object

    if not names:  # at the root an object's members are merged in
        return bind(members(value), lambda m: F.when(m.isNull(), doc).otherwise(_to_object(_merged(F.coalesce(members(doc), _empty_map()), m))))

    def step(m: Column) -> Column:
        if len(names) == 1:
            return _to_object(_put(m, names[0], value))
        inner = F.element_at(m, F.lit(names[0]))
        blocked = inner.isNotNull() & members(inner).isNull() & ~F.coalesce(F.is_variant_null(inner), F.lit(True))
        new = put(F.coalesce(F.when(members(inner).isNotNull(), inner), _to_object(_empty_map())), names[1:], value)
        return F.when(blocked, _to_object(m)).otherwise(_to_object(_put(m, names[0], new)))

    return bind(F.coalesce(members(doc), _empty_map()), step)


def _merged(a: Column, b: Column) -> Column:
    """Two maps; the second's members stand."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


# ---- flat keys: nodeId-/path[i][j]

_KEY = re.compile(r"^(.*?)-(/.*?)((?:\[\d+\])*)$", re.S)


def flat_key(node: str, path: str, index: tuple[int, ...] = ()) -> str:
    return f"{node}-{path if path.startswith('/') else '/' + path}" + "".join(f"[{i}]" for i in index)


def parse_flat_key(key: str) -> tuple[str, str, tuple[int, ...]]:
    m = _KEY.match(key)
    if not m:
        raise ValueError(f"no flat key: {key!r}")
    return m[1], m[2], tuple(int(x) for x in re.findall(r"\d+", m[3]))


def key_node(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^(.*?)-/", 1)


def key_path(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^.*?-(/.*?)(?:\[\d+\])*\z", 1)


def key_index(key: Column) -> Column:
    """All numbers in brackets, also those inside the path."""
    return F.transform(F.regexp_extract_all(key, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def with_index(key: Column, *index: Column) -> Column:
    return F.concat(key, *[x for i in index for x in (F.lit("["), i.cast("string"), F.lit("]"))])


def is_flat(m: Column) -> Column:
    """Whether a map has flat keys."""
    return F.exists(F.map_keys(m), lambda k: k.contains("-/"))
