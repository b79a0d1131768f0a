"""Registered queries that run as streams: a table in several files, one file a batch, and a last row that moves the watermark past all others.

A changelog is collapsed to the rows that it leaves, so the other engine's answer over the whole table is the right one.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.plans.registry import query
from weir.plans.sinks import changes, folder
from weir.sources.messages import watermarked
from weir.streaming import keyed
from weir.streaming.changelog import collapse

_STORE = "spark.sql.streaming.stateStore.providerClass"
_PARTS = "spark.sql.shuffle.partitions"


@contextmanager
def rocks(spark: SparkSession):
    """Keyed state needs the RocksDB store; few partitions of state are enough for a table of some megabytes."""
    before = {k: spark.conf.get(k, None) for k in (_STORE, _PARTS)}
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(_PARTS, str(min(8, int(before[_PARTS] or 200))))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_order(df: DataFrame, order: str, path: str, batches: int = 3) -> None:
    """Writes df in files of the order of a column, one after the other, as a stream reads files in the order of their times."""
    value = F.col(order).cast("timestamp").cast("double") if df.schema[order].dataType.typeName().startswith("timestamp") else F.col(order).cast("double")
    cuts = df.agg(F.percentile_approx(value, [k / batches for k in range(1, batches)])).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = df if low is None else df.where(value > low)
        (part if high is None else part.where(value <= high)).coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(path)


def streamed(spark: SparkSession, df: DataFrame, time: str | None = None, batches: int = 3, key: str | None = None) -> DataFrame:
    """df as a stream of files, one a batch; with time they are in its order, and two rows of nulls follow, a year and two years later than all: the last batch goes by the watermark of the one before. Their key is -1, as joins
    leave out null keys before they look at times."""
    path = folder(spark)
    if time is None:
        df.repartition(batches).write.parquet(path)
    else:
        in_order(df, time, path, batches)
        for days in (365, 730):
            last = df.agg((F.max(time) + F.expr(f"INTERVAL {days} DAYS")).alias(time)).select(*(F.col(time) if f.name == time else F.lit(-1 if f.name == key else None).cast(f.dataType).alias(f.name) for f in df.schema))
            last.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream if time is None else watermarked(stream, time)


def relayed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A changelog as the next query's stream: each batch is one file, written after a shuffle so that its state is worked on in more than one task."""
    path = folder(spark)
    with rocks(spark):
        df.writeStream.outputMode("update").foreachBatch(lambda b, _: b.repartition(1).write.mode("append").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/out")


def finished(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream gives, from a table that its batches are written to."""
    path = folder(spark)
    put = lambda b, n: b.withColumn("_batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(f"{path}/out")
    with rocks(spark):
        df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = df.schema
    return spark.read.schema(schema).parquet(f"{path}/out").select(*schema.fieldNames())


def _events(load, *columns: str) -> DataFrame:
    return load("events").select(*columns, F.col("ts").cast("timestamp_ltz").alias("ts"))


_NTZ = "CAST(ts AS TIMESTAMP_NTZ) AS ts"

# Aggregates, joins and Top-N that follow changes ---------------------------------------------------------------------


@query("stream_group", "SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS total, (sum(event_id) // count(event_id))::BIGINT AS mean, min(event_id) AS lo, max(event_type) AS hi, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def _(spark, load):
    f = {"n": ("count", None), "total": ("sum", "event_id"), "mean": ("avg", "event_id"), "lo": ("min", "event_id"), "hi": ("max", "event_type"), "kinds": ("count", "event_type", True)}
    return collapse(finished(spark, keyed.group(streamed(spark, load("events").select("user_id", "event_id", "event_type")), ["user_id"], f), "update"))


@query("stream_group_of_changes", "SELECT event_type, count(*) AS users, max(n) AS top FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def _(spark, load):
    inner = keyed.group(streamed(spark, load("events").select("user_id", "event_type")), ["event_type", "user_id"], {"n": ("count", None)})
    return collapse(finished(spark, keyed.group(relayed(spark, inner), ["event_type"], {"users": ("count", None), "top": ("max", "n")}), "update"))


for _how in ("inner", "left", "right", "full", "semi", "anti"):
    _shown = "l.k, l.a" if _how in ("semi", "anti") else "l.k, l.a, r.rk, r.b"
    _l = "(SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS k, event_id AS a FROM events WHERE event_type = 'click' AND event_id % 5 < 2)"
    _r = "(SELECT CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS rk, event_id AS b FROM events WHERE event_type = 'purchase' AND user_id % 3 > 0)"

    @query(f"stream_join_{_how}", f"SELECT {_shown} FROM {_l} l {_how} JOIN {_r} r ON k = rk AND a % 7 <> b % 7")
    def _(spark, load, how=_how):
        e = load("events")
        left = e.where("event_type = 'click' AND event_id % 5 < 2").select(F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END").alias("k"), F.col("event_id").alias("a"))
        right = e.where("event_type = 'purchase' AND user_id % 3 > 0").select(F.expr("CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END").alias("rk"), F.col("event_id").alias("b"))
        out = keyed.join(streamed(spark, left), streamed(spark, right), [("k", "rk")], how, lambda x, y: x["a"] % 7 != y["b"] % 7)
        return collapse(finished(spark, out, "update"))


@query("stream_last_by_time", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1")
def _(spark, load):
    return collapse(finished(spark, keyed.last_by_time(streamed(spark, _events(load, "user_id", "event_id", "event_type")), ["user_id"], "ts"), "update")).drop("ts")


@query("stream_first_by_arrival", "SELECT user_id, event_type FROM events GROUP BY ALL")
def _(spark, load):
    return collapse(finished(spark, keyed.by_arrival(streamed(spark, load("events").select("user_id", "event_type")), ["user_id", "event_type"]), "update"))


@query("stream_last_by_arrival", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def _(spark, load):
    out = collapse(finished(spark, keyed.by_arrival(streamed(spark, load("events").select("user_id", "event_id")), ["user_id"], "last"), "update"))
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query("stream_normalize", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 7 <> 6")
def _(spark, load):
    path = folder(spark)
    rows = changes(load)
    in_order(rows, "event_id", path)
    out = keyed.normalized(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), ["user_id"])
    return collapse(finished(spark, out, "update")).drop("event_id")


# Operators of event time ---------------------------------------------------------------------------------------------


@query("stream_over_running", "SELECT event_id, user_id, ts, (sum(event_id) OVER w)::BIGINT AS s, count(value) OVER w AS n, min(event_id) OVER w AS lo, row_number() OVER w AS rn, rank() OVER w AS rk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(spark, load):
    f = {"s": ("sum", "event_id"), "n": ("count", "value"), "lo": ("min", "event_id"), "rn": ("row_number", None), "rk": ("rank", None)}
    out = finished(spark, keyed.over(streamed(spark, _events(load, "event_id", "user_id", "value"), "ts"), ["user_id"], "ts", f))
    return out.where("event_id is not null").select("event_id", "user_id", F.expr(_NTZ), "s", "n", "lo", "rn", "rk")


@query("stream_over_rows", "SELECT event_id, (sum(event_id) OVER w)::BIGINT AS s, (sum(event_id) OVER w // count(event_id) OVER w)::BIGINT AS mean, first_value(event_id) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def _(spark, load):
    f = {"s": ("sum", "event_id"), "mean": ("avg", "event_id"), "f": ("first_value", "event_id")}
    return finished(spark, keyed.over(streamed(spark, _events(load, "event_id", "user_id"), "ts"), ["user_id"], "ts", f, ("rows", 3))).where("event_id is not null").select("event_id", "s", "mean", "f")


@query("stream_over_interval", "SELECT event_id, count(*) OVER w AS n, max(event_id) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW)")
def _(spark, load):
    f = {"n": ("count", "event_id"), "hi": ("max", "event_id")}
    return finished(spark, keyed.over(streamed(spark, _events(load, "event_id", "user_id"), "ts"), ["user_id"], "ts", f, ("range", 6 * 3_600_000))).where("event_id is not null").select("event_id", "n", "hi")


@query("stream_over_arrival", "SELECT user_id, max(n) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY user_id")
def _(spark, load):
    out = finished(spark, keyed.over(streamed(spark, _events(load, "event_id", "user_id")), ["user_id"], "ts", {"n": ("count", "event_id")}, ("rows", None), by_arrival=True))
    return out.groupBy("user_id").agg(F.max("n").alias("n"))


@query("stream_first_by_time", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events) WHERE r = 1")
def _(spark, load):
    return finished(spark, keyed.first_by_time(streamed(spark, _events(load, "user_id", "event_id"), "ts"), ["user_id"], "ts")).where("event_id is not null").select("user_id", "event_id")


@query("stream_window_top", "SELECT window_end, event_type, event_id, rank_num FROM (SELECT *, row_number() OVER (PARTITION BY window_end, event_type ORDER BY value DESC, event_id) AS rank_num FROM (SELECT *, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS window_end FROM events)) WHERE rank_num <= 2")
def _(spark, load):
    w = streamed(spark, _events(load, "event_id", "event_type", "value"), "ts").withColumn("window_end", F.window("ts", "6 hours")["end"])
    out = finished(spark, keyed.window_top(w, ["event_type"], "window_end", [("value", False), ("event_id", True)], 2))
    return out.where("event_id is not null").select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "event_id", "rank_num")


@query("stream_temporal_join", "SELECT p.event_id, v.event_id AS version_event_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def _(spark, load):
    e = _events(load, "user_id", "event_id", "event_type")
    probe = streamed(spark, e.where("event_type <> 'purchase'").drop("event_type"), "ts")
    versions = streamed(spark, e.where("event_type = 'purchase'").drop("event_type"), "ts")
    return finished(spark, keyed.temporal_join(probe, versions, "user_id", "ts", "left")).where("event_id is not null").select("event_id", "version_event_id")


for _how in ("inner", "left"):

    @query(f"stream_interval_join_{_how}", f"SELECT a.event_id AS a, b.event_id AS b FROM (SELECT * FROM events WHERE event_type = 'click') a {_how} JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts BETWEEN b.ts - INTERVAL '1 hour' AND b.ts + INTERVAL '2 hours'")
    def _(spark, load, how=_how):
        side = lambda t, n: streamed(spark, load("events").where(F.col("event_type") == t).select(F.col("event_id").alias(n), F.col("user_id").alias(f"k{n}"), F.col("ts").cast("timestamp_ltz").alias(f"t{n}")), f"t{n}", key=f"k{n}")
        return finished(spark, keyed.interval_join(side("click", "a"), side("purchase", "b"), F.expr("ka = kb"), ("ta", "tb"), "-1 HOUR", "2 HOURS", how)).select("a", "b").where("a is not null")


@query("stream_window_join", "SELECT a.event_id AS a, b.event_id AS b FROM (SELECT *, time_bucket(INTERVAL '2 hours', ts) AS w FROM events WHERE event_type = 'click') a JOIN (SELECT *, time_bucket(INTERVAL '2 hours', ts) AS w FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.w = b.w")
def _(spark, load):
    side = lambda t, n, w: streamed(spark, load("events").where(F.col("event_type") == t).select(F.col("event_id").alias(n), F.col("user_id").alias(f"k{n}"), F.col("ts").cast("timestamp_ltz").alias(f"t{n}")), f"t{n}").withColumn(w, F.window(f"t{n}", "2 hours")).drop(f"t{n}")
    return finished(spark, keyed.window_join(side("click", "a", "l_window"), side("view", "b", "r_window"), F.expr("ka = kb"))).select("a", "b")


@query("stream_window_aggregate", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY ALL")
def _(spark, load):
    e = streamed(spark, _events(load, "event_type", "user_id"), "ts")
    out = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))
    return finished(spark, out).where("event_type is not null").select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "users")


@query("stream_session", "SELECT user_id, min(ts) AS window_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def _(spark, load):
    e = streamed(spark, _events(load, "user_id"), "ts")
    out = e.groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return finished(spark, out).where("user_id is not null").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


@query("stream_sort", "SELECT event_id, row_number() OVER (ORDER BY ts) AS place FROM events")
def _(spark, load):
    path = folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("own", F.monotonically_increasing_id()).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/out")

    with rocks(spark):
        keyed.sorted_by_time(streamed(spark, _events(load, "event_id"), "ts"), "ts", put, f"{path}/checkpoint", 4, ties=("event_id",)).awaitTermination()
    from pyspark.sql import Window

    # A place is that in the range of its sort, from the number of rows of the ranges before.
    own, part = F.col("own").bitwiseAND(F.lit((1 << 33) - 1)).alias("own"), F.shiftright("own", 33).alias("part")
    rows = spark.read.schema("event_id long, ts timestamp, own long, batch int").parquet(f"{path}/out").where("event_id is not null").select("event_id", "batch", part, own)
    sizes = rows.groupBy("batch", "part").agg(F.count("*").alias("n"))
    bases = sizes.select("batch", "part", (F.sum("n").over(Window.orderBy("batch", "part")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(bases), ["batch", "part"]).select("event_id", (F.col("base") + F.col("own") + 1).alias("place"))


@query("stream_late_rows", "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def _(spark, load):
    """Rows of the first hour come again in the last batch: they are late and change nothing."""
    e = _events(load, "event_id")
    path = folder(spark)
    in_order(e, "ts", path, 2)
    far = e.agg((F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts")).select(F.lit(None).cast("bigint").alias("event_id"), "ts")
    far.coalesce(1).write.mode("append").parquet(path)
    late = e.where(F.col("ts") < e.agg(F.min("ts") + F.expr("INTERVAL 1 HOUR")).first()[0])
    late.coalesce(1).write.mode("append").parquet(path)
    stream = watermarked(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path), "ts")
    out = finished(spark, stream.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.max("event_id").alias("any")))
    return out.where("any is not null").select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")
