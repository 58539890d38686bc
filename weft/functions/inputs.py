"""Values that pass between nodes: with their type where the plan knows it, as VARIANT where it does not.

A node's input is known by its members while the plan is built, so that a node reads the
columns it needs; the document itself is put together only for a node that takes it whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft import paths
from weft.operators import json_schema as J

VARIANT = "variant"


def null() -> Column:
    """A JSON null."""
    return F.parse_json(F.lit("null"))


@dataclass(frozen=True)
class Value:
    """A Column and its type. A null VARIANT is a missing value; a null of another type is a JSON null."""

    col: Column
    kind: str = VARIANT

    def variant(self) -> Column:
        return self.col if self.kind == VARIANT else F.coalesce(self.col.cast("variant"), null())

    def text(self) -> Column:
        """The value if it is a text, else null."""
        if self.kind != VARIANT:
            return self.col if self.kind == "string" else F.lit(None).cast("string")
        return F.when(F.schema_of_variant(self.col) == "STRING", J.text_of(self.col))

    def printed(self) -> Column:
        """Any scalar as text."""
        return J.text_of(self.variant())

    def below(self, names: tuple[str, ...]) -> Value:
        return Value(paths._down(self.variant(), names)) if names else self


class Input:
    """A node's input: its members if the plan knows them, else a VARIANT."""

    def __init__(self, whole: Column | None = None, members: dict[str, Input | Value] | None = None):
        self.whole, self.members = whole, members

    def at(self, *names: str) -> Value:
        if not names:
            return Value(self.column())
        if self.members is None:
            return Value(paths._down(self.whole, names))
        got = self.members.get(names[0])
        if got is None:
            return Value(F.lit(None).cast("variant"))
        return got.at(*names[1:]) if isinstance(got, Input) else got.below(names[1:])

    def column(self) -> Column:
        """The document; members that are missing are left out, and an object without any is none."""
        if self.members is None:
            return self.whole
        pairs = []
        for k, x in sorted(self.members.items()):
            inner = isinstance(x, Input)
            v = x.column() if inner else x.variant()
            there = x.there() if inner else F.lit(True) if x.kind != VARIANT else v.isNotNull()
            pairs.append(F.when(there, F.struct(F.lit(k).alias("key"), v.alias("value"))))
        if not pairs:
            return J._to_object(J._empty_map())
        return J._to_object(F.map_from_entries(F.filter(F.array(*pairs), lambda e: e.isNotNull())))

    def there(self) -> Column:
        """Whether any member is there."""
        out = F.lit(False)
        for x in self.members.values():
            out = out | (x.there() if isinstance(x, Input) else F.lit(True) if x.kind != VARIANT else x.col.isNotNull())
        return out

    def values(self) -> list[tuple[str, Value]] | None:
        """Members by name, if the plan knows them."""
        if self.members is None:
            return None
        return [(k, Value(F.when(x.there(), x.column())) if isinstance(x, Input) else x) for k, x in sorted(self.members.items())]


@dataclass(frozen=True)
class Made:
    """A node's output with members of known types; ``optional`` ones are left out where they are null. ``error`` is a text, null where all went well."""

    members: dict[str, Value]
    error: Column | None = None
    optional: tuple[str, ...] = ()
