"""UNNEST of arrays, arrays of rows, maps and multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, column: str, names: list[str], outer: bool = False, ordinality: str | None = None) -> DataFrame:
    """df with a row for each element; null row elements go, null scalars stay. `names` are those of the element's fields."""
    kind = df.schema[column].dataType
    value = F.col(column)
    rows = kind.typeName() == "array" and kind.elementType.typeName() == "struct"
    if rows:
        value = F.filter(value, lambda x: x.isNotNull())
    elif kind.typeName() == "map":
        value = F.map_entries(value)
    else:
        value = F.transform(value, lambda x: F.struct(x.alias(names[0])))
    out = df.select("*", (F.posexplode_outer if outer else F.posexplode)(value).alias("_pos", "_item"))
    fields = out.schema["_item"].dataType.fieldNames()
    out = out.select(*(c for c in df.columns if c != column), *(F.col(f"_item.{f}").alias(n) for f, n in zip(fields, names, strict=True)), *([(F.col("_pos") + 1).alias(ordinality)] if ordinality else []))
    return out


def unnest_multiset(df: DataFrame, column: str, name: str) -> DataFrame:
    """A multiset is a map from an element to its count; each element comes back as often."""
    repeated = F.flatten(F.transform(F.map_entries(column), lambda e: F.array_repeat(e["key"], e["value"].cast("int"))))
    return df.select(*(c for c in df.columns if c != column), F.explode(repeated).alias(name))
