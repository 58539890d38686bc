"""Column functions: strings, dates, conditions and the canonical text of values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it; it keeps expressions small."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
