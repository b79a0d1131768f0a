"""Aggregates with the result types of stream SQL: sums and averages of integers keep the type of their input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions.scalar import wrap


def sum_as(value: Column, kind: str) -> Column:
    """SUM that keeps an integer type and wraps; decimals get 38 digits."""
    if kind.startswith("decimal"):
        scale = int(kind.rstrip(")").split(",")[1])
        return F.sum(value.cast(f"decimal(38,{scale})")).cast(f"decimal(38,{scale})")
    if kind in ("float", "double"):
        return F.sum(value.cast("double")).cast(kind)
    return wrap(F.sum(value.cast("decimal(38,0)" if kind == "bigint" else "bigint")), kind)


def avg_as(value: Column, kind: str, distinct: bool = False) -> Column:
    """AVG that truncates toward zero to an integer type, after a sum that wraps at 64 bits; of decimals with max(6, scale) digits, half up."""
    add, count = (F.sum_distinct, F.count_distinct) if distinct else (F.sum, F.count)
    if kind.startswith("decimal"):
        scale = int(kind.rstrip(")").split(",")[1])
        return (add(value.cast(f"decimal(38,{scale})")) / count(value)).cast(f"decimal(38,{max(6, scale)})")
    if kind in ("float", "double"):
        return (add(value.cast("double")) / F.nullif(count(value), F.lit(0))).cast(kind)
    # Only bigint can leave 64 bits; the other kinds add up in a long.
    total = wrap(add(value.cast("decimal(38,0)")), "bigint") if kind == "bigint" else add(value.cast("bigint"))
    return F.call_function("div", total, F.nullif(count(value), F.lit(0))).cast(kind)
