from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounding with halves toward plus infinity; Spark's own round takes them away from zero."""
    scale = 10**digits
    return F.floor(value * scale + 0.5) / F.lit(float(scale))


def half_up_int(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


def any_of(test, items) -> Column:
    """Whether test(item) holds for one of the items."""
    out = F.lit(False)
    for x in items:
        out = out | test(x)
    return out


def blank(value: Column) -> Column:
    """Null or empty."""
    return value.isNull() | (value == "")


def bounded(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def let(value: Column, body) -> Column:
    """body(value), with value computed once: an expression named within a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
