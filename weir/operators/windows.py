"""Window table functions: rows with window_start, window_end and window_time (the end less a millisecond)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bounds(df: DataFrame, window: str = "window") -> DataFrame:
    out = df.withColumn("window_start", F.col(f"{window}.start")).withColumn("window_end", F.col(f"{window}.end")).drop(window)
    return out.withColumn("window_time", F.col("window_end") - F.expr("INTERVAL 1 MILLISECOND"))


def tumble(df: DataFrame, time: str, size: str, offset: str | None = None) -> DataFrame:
    return _bounds(df.withColumn("window", F.window(time, size, startTime=offset)))


def hop(df: DataFrame, time: str, size: str, slide: str) -> DataFrame:
    """A row for each window that a row is in. For aggregates alone, hop_aggregate moves fewer rows."""
    return _bounds(df.withColumn("window", F.window(time, size, slide)))


def cumulate(df: DataFrame, time: str, size: str, step: str) -> DataFrame:
    """Windows that share a start and end step by step: one row for each end after the row's time."""
    based = df.withColumn("window_start", F.window(time, size)["start"])
    ends = F.expr(f"filter(sequence(window_start + INTERVAL {step}, window_start + INTERVAL {size}, INTERVAL {step}), e -> e > {time})")
    return based.withColumn("window_end", F.explode(ends)).withColumn("window_time", F.col("window_end") - F.expr("INTERVAL 1 MILLISECOND"))


def session(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates) -> DataFrame:
    """Aggregates by key and session; events exactly a gap apart are one session."""
    return _bounds(df.groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*aggregates))


def hop_aggregate(df: DataFrame, time: str, size: str, slide: str, keys: list[str], parts: dict[str, tuple[Column, str]]) -> DataFrame:
    """Aggregates by window and key over hopping windows, by slices.

    Rows are first aggregated by slices of the slide, which must divide the size; a slice's row then goes to each window that it is part of. parts gives for each
    result column its aggregate of a slice, and how slices add up: sum, min or max. So rows are copied after the partial aggregate, not before.
    """
    slices = df.groupBy(F.window(time, slide).alias("slice"), *keys).agg(*(a.alias(n) for n, (a, _) in parts.items()))
    starts = F.expr(f"sequence(slice.end - INTERVAL {size}, slice.start, INTERVAL {slide})")
    spread = slices.withColumn("window_start", F.explode(starts)).withColumn("window_end", F.expr(f"window_start + INTERVAL {size}"))
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    return spread.groupBy("window_start", "window_end", *keys).agg(*(how[h](n).alias(n) for n, (_, h) in parts.items()))


# Group windows of the older syntax: the window is a grouping key, and its start and end are functions of it.


def group_tumble(df: DataFrame, time: str, size: str, keys: list[str], *aggregates) -> DataFrame:
    """TUMBLE(time, size) as a grouping key, with TUMBLE_START, TUMBLE_END and TUMBLE_ROWTIME."""
    return _bounds(df.groupBy(F.window(time, size).alias("window"), *keys).agg(*aggregates))


def group_hop(df: DataFrame, time: str, size: str, slide: str, keys: list[str], *aggregates) -> DataFrame:
    """HOP(time, slide, size) as a grouping key."""
    return _bounds(df.groupBy(F.window(time, size, slide).alias("window"), *keys).agg(*aggregates))


group_session = session


def arrival(df: DataFrame, name: str = "proctime") -> DataFrame:
    """df with the clock's time as a column, the same for a batch: windows over it are windows of processing time."""
    return df.withColumn(name, F.current_timestamp())
