"""Scalar functions whose stream-SQL rules differ from Spark's defaults."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDTH = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def wrap(value: Column, kind: str) -> Column:
    """value, an exact integer, wrapped to the width of an integer type; bigint goes through decimals."""
    if kind == "bigint":
        v = value.cast("decimal(38,0)")
        shift, size = F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
        return (F.pmod(v + shift, size) - shift).cast("bigint")
    half = 1 << (_WIDTH[kind] - 1)
    return (F.pmod(value.cast("bigint") + half, F.lit(2 * half)) - half).cast(kind)


def saturate(value: Column, kind: str) -> Column:
    """A float or double as an integer type: cut toward zero, held at the type's ends, 0 for NaN."""
    half = 1 << (_WIDTH[kind] - 1)
    d = value.cast("double")
    # The ends of bigint are not doubles; what reaches them is told apart first.
    inside = F.when((d < float(half)) & (d >= -float(half)), d).otherwise(F.lit(0.0)).cast("bigint").cast(kind)
    return F.when(F.isnan(d), F.lit(0).cast(kind)).when(d >= float(half), F.lit(half - 1).cast(kind)).when(d < -float(half), F.lit(-half).cast(kind)).when(d.isNotNull(), inside)


def parse(text: Column, kind: str, lenient: bool = False) -> Column:
    """A string as a number, boolean or time, spaces around it apart; what can't be read fails the query, or is NULL where lenient."""
    return F.trim(text).try_cast(kind) if lenient else F.trim(text).cast(kind)


def char(text: Column, length: int) -> Column:
    """CHAR(n): cut, or filled up with spaces."""
    return F.rpad(text, length, " ")


def varchar(text: Column, length: int) -> Column:
    """VARCHAR(n): cut."""
    return F.left(text, F.lit(length))


def to_timestamp_ltz(value: Column, precision: int = 3) -> Column:
    """An instant from epoch seconds (precision 0) or milliseconds (3)."""
    if precision not in (0, 3):
        raise ValueError("precision is 0 for seconds or 3 for milliseconds")
    return F.timestamp_seconds(value) if precision == 0 else F.timestamp_millis(value)


def round_half_up(value: Column, digits: int = 0) -> Column:
    """ROUND of a float or double, away from zero at the half."""
    return F.round(value, digits)


def split_index(s: Column, separator: str, index: int) -> Column:
    """The part of s at a 0-based index; NULL out of range or for an empty string."""
    if index < 0:
        return F.lit(None).cast("string")
    return F.get(F.split(F.nullif(s, F.lit("")), re.escape(separator), -1), index)


def regexp_extract(s: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; NULL without one, and where the group takes no part in it.

    An empty result is told from a group without part by matching on: the first match, held fast, must be followed by a reference
    back to the group, which holds for an empty group and fails for one without part.
    """
    found = F.regexp_extract(s, pattern, group)
    took_part = s.rlike(f"^(?>(?s:.*?)(?:{pattern}))\\{group}") if group else F.lit(True)
    return F.when(s.rlike(pattern) & ((found != "") | took_part), found)


def count_char(s: Column, c: Column) -> Column:
    """Occurrences of c's first character; 0 where either is NULL or c is empty."""
    n = F.length(s) - F.length(F.replace(s, F.left(c, F.lit(1)), F.lit("")))
    return F.when(s.isNull() | c.isNull() | (c == ""), 0).otherwise(n).cast("bigint")


def item(collection: Column, key) -> Column:
    """array[i], 1-based, or map[k]; NULL where there is none."""
    return F.try_element_at(collection, F.lit(key))


def _divisor(b: Column) -> Column:
    return F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(b)


def decimal_divide(a: Column, b: Column, precision: int, scale: int) -> Column:
    """a / b of decimals, to 38 significant digits and then half up to the result's scale; NULL where that is too narrow, an error where b is 0."""
    return F.try_divide(a, _divisor(b)).try_cast(f"decimal({precision},{scale})")


def decimal_modulo(a: Column, b: Column, precision: int, scale: int) -> Column:
    """The rest of a / b, with the sign of a; NULL where the result is too narrow, an error where b is 0."""
    return F.try_mod(a, _divisor(b)).try_cast(f"decimal({precision},{scale})")
