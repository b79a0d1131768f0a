"""Joins on time over bounded tables, and lookups. Regular joins are DataFrame.join."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def interval_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], time: tuple[str, str], lower: str, upper: str, how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Rows with equal keys and lower <= left time - right time <= upper, both ends included. how is inner, left, right, full, semi or anti.

    Time is cut in buckets as wide as the interval; a right row goes to the two that its interval reaches, and the bucket is a key of the join. So a hot key's rows are
    spread over time, and a row meets those of two buckets and not the whole history of its key. Both sides' columns must have names of their own.
    """
    names = {c.lower() for c in (*left.columns, *right.columns)}
    b, lo, hi = (next(f"_{n}{i}" for i in range(99) if f"_{n}{i}" not in names) for n in ("bucket", "least", "most"))
    lt, rt = time
    micros = lambda t: F.unix_micros(F.col(t).cast("timestamp_ltz"))
    # The interval's width in microseconds, from constants.
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ltz")
    width = F.unix_micros(zero + F.expr(f"INTERVAL {upper}")) - F.unix_micros(zero + F.expr(f"INTERVAL {lower}")) + 1
    width = F.greatest(width, F.lit(1))
    bucket = lambda m: F.floor(m / 1).cast("bigint") if m is None else F.call_function("div", m - F.pmod(m, width), width)
    least, most = micros(rt) + (F.unix_micros(zero + F.expr(f"INTERVAL {lower}")) - F.unix_micros(zero)), micros(rt) + (F.unix_micros(zero + F.expr(f"INTERVAL {upper}")) - F.unix_micros(zero))
    one = left.withColumn(b, bucket(micros(lt)))
    if how in ("right", "full"):
        # An unmatched right row must come once: match it in both buckets first, then add what is left.
        matched = interval_join(left, right, keys, time, lower, upper, "left" if how == "full" else "inner", residual)
        flipped = [(r, x) for x, r in keys]
        lonely = _unmatched(right, left, flipped, (rt, lt), lower, upper, residual)
        return matched.unionByName(lonely, allowMissingColumns=True).select(*left.columns, *right.columns)
    two = right.withColumn(lo, least).withColumn(hi, most).withColumn(b, F.explode(F.array_distinct(F.array(bucket(F.col(lo)), bucket(F.col(hi))))))
    on = F.col(f"l.{b}") == F.col(f"r.{b}")
    for x, y in keys:
        on = on & (F.col(f"l.{x}") == F.col(f"r.{y}"))
    on = on & micros(f"l.{lt}").between(F.col(f"r.{lo}"), F.col(f"r.{hi}"))
    if residual is not None:
        on = on & residual
    kinds = {"semi": "left_semi", "anti": "left_anti"}
    out = one.alias("l").join(two.alias("r"), on, kinds.get(how, how))
    return out.select(*(F.col(f"l.{c}") for c in left.columns), *((F.col(f"r.{c}") for c in right.columns) if how not in kinds else ()))


def _unmatched(right: DataFrame, left: DataFrame, keys: list[tuple[str, str]], time: tuple[str, str], lower: str, upper: str, residual: Column | None) -> DataFrame:
    """Right rows without a left row in their interval. Seen from the right, the interval is that of right time - left time, -upper to -lower."""
    negative = lambda s: s[1:] if s.startswith("-") else f"-{s}"
    return interval_join(right, left, keys, time, negative(upper), negative(lower), "anti", residual)


def window_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of two windowed tables with equal keys and the same window; other columns must have names of their own."""
    return left.join(right, [*keys, "window_start", "window_end"], {"semi": "left_semi", "anti": "left_anti"}.get(how, how))


def temporal_join(probe: DataFrame, versions: DataFrame, key: str, probe_time: str, version_time: str, how: str = "inner", kind: str | None = None, residual: Column | None = None) -> DataFrame:
    """Each probe row with the version of its key that holds at its time: the latest one that isn't later.

    Both sides are one stream ordered by time in each key, versions before probes; the last version so far is carried to the
    probe. So a key's versions and probes are sorted once and never paired with each other. Where `kind` names a column of change kinds, a version that is
    a -D or -U ends the one before it. A version that fails `residual`, on columns version_*, is no match. A probe with a null key has none.
    """
    body = [c for c in versions.columns if c != key]
    ends = F.col(kind).isin("-D", "-U") if kind else F.lit(False)
    row_kind = probe.select(F.struct(*probe.columns)).schema[0].dataType
    held = F.struct(ends.alias("ended"), F.struct(*body).alias("row"))
    v = versions.where(F.col(key).isNotNull()).select(key, F.col(version_time).alias("at"), F.lit(0).alias("side"), held.alias("version"), F.lit(None).cast(row_kind).alias("row"))
    p = probe.select(key, F.col(probe_time).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(v.schema["version"].dataType).alias("version"), F.struct(*probe.columns).alias("row"))
    # Of changes at one time those that end a version come first, so that an update's new row holds.
    order = Window.partitionBy(key).orderBy("at", "side", F.desc("version.ended")).rowsBetween(Window.unboundedPreceding, 0)
    out = v.unionByName(p).withColumn("version", F.last("version", ignorenulls=True).over(order)).where("side = 1")
    out = out.withColumn("version", F.when(~F.col("version.ended"), F.col("version.row")))
    named = [F.col(f"version.{c}").alias(f"version_{c}") for c in body if c != kind]
    if residual is not None:
        fits = out.select("row", "version", *named).withColumn("version", F.when(residual, F.col("version")))
        out = fits.select("row", "version")
    if how == "inner":
        out = out.where("version is not null")
    return out.select("row.*", *named)


def lookup_join(probe: DataFrame, dimension: DataFrame, on: Column, how: str = "inner", most_bytes: int = 16 << 20) -> DataFrame:
    """A join with a dimension table, broadcast where Spark's estimate of its bytes says that it is small; else a shuffled join."""
    size = int(str(dimension._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return probe.join(F.broadcast(dimension) if size <= most_bytes else dimension, on, how)


def lookup_join_async(probe: DataFrame, key: str, fetch: Callable[[object], dict | None], fields: T.StructType, how: str = "inner", capacity: int = 100) -> DataFrame:
    """Each probe row with what `fetch` finds for its key, as a call to an outside store: up to `capacity` calls of a batch run at a time, one for each distinct key.

    Rows keep their order in a batch. A null key finds nothing. fetch must be safe to call from several threads.
    """
    schema = T.StructType([*probe.schema, *(T.StructField(f.name, f.dataType) for f in fields)])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(capacity) as pool:
            for b in batches:
                keys = b.column(key).to_pylist()
                wanted = [k for k in dict.fromkeys(keys) if k is not None]
                found = dict(zip(wanted, pool.map(fetch, wanted), strict=True))
                rows = [found.get(k) for k in keys]
                new = [pa.array([None if r is None else r.get(f.name) for r in rows], f.type) for f in arrow]
                out = pa.RecordBatch.from_arrays([*b.columns, *new], schema=pa.schema([*b.schema, *arrow]))
                yield out if how == "left" else out.filter(pa.array([r is not None for r in rows], pa.bool_()))

    return probe.mapInArrow(run, schema)


def lateral(df: DataFrame, function: Callable[[Column], Column], column: str, names: list[str], outer: bool = False) -> DataFrame:
    """Each row with the rows of a table function of one of its columns: function gives an array of structs, whose fields become `names`."""
    found = function(F.col(column))
    out = df.withColumn("_rows", F.explode_outer(found) if outer else F.explode(found))
    return out.select(*df.columns, *(F.col("_rows").getField(f).alias(n) for f, n in zip(out.schema["_rows"].dataType.fieldNames(), names, strict=True)))
