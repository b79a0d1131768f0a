"""Top-N, dedup and changelog normalisation over bounded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: list[str], order: list[Column], limit: int, offset: int = 0, rank: str = "rank_num") -> DataFrame:
    """The rows ranked offset + 1 to limit in each partition; `order` should be total. Spark turns the filter into a group limit before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    return ranked.where(F.col(rank).between(offset + 1, limit))


def _one(df: DataFrame, by: list[str], pick, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    out = df.groupBy(*by).agg(pick(F.struct(*rest), F.struct(*order)).alias("r"))
    return out.select(*by, "r.*").select(*df.columns)


def keep_first(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """One row a key, with the least of `order`; a partial aggregate, so no key's rows meet in one task."""
    return _one(df, by, F.min_by, list(order))


def keep_last(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    return _one(df, by, F.max_by, list(order))


def normalized(changes: DataFrame, by: list[str], order: str, kind: str = "row_kind") -> DataFrame:
    """The rows that an upsert stream leaves: each key's last one, unless that deletes it."""
    return keep_last(changes, by, order).where(F.col(kind) != "-D").drop(kind)


def top_rank(df: DataFrame, by: list[str], order: list[Column], limit: int, dense: bool = False, rank: str = "rank_num") -> DataFrame:
    """The rows of RANK, or DENSE_RANK, up to limit in each partition; ties all stay."""
    over = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, (F.dense_rank() if dense else F.rank()).over(over).cast("bigint")).where(F.col(rank) <= limit)


def drop_update_before(changes: DataFrame, kind: str = "row_kind") -> DataFrame:
    return changes.where(F.col(kind) != "-U")


def sorted_by_time(df: DataFrame, time: str, *ties: str, name: str | None = None) -> DataFrame:
    """df sorted by time over ranges; with `name`, a column of each row's place from 1 on.

    Places are those of the sort: each range's rows are numbered in its own task, from the sum of the ranges before it, which is one number for each range.
    """
    out = df.orderBy(time, *ties)
    if name is None:
        return out
    part, own, base = f"_{name}_part", f"_{name}_own", f"_{name}_base"
    numbered = out.withColumn(own, F.monotonically_increasing_id()).withColumn(part, F.shiftright(F.col(own), 33)).withColumn(own, F.col(own).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = numbered.groupBy(part).agg(F.count("*").alias("n"))
    bases = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(base))
    # One row for each range of the sort.
    return numbered.join(F.broadcast(bases), part).withColumn(name, F.col(base) + F.col(own) + 1).drop(part, own, base)
