"""Registered queries that write a table and read it back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.plans.registry import query
from weir.sinks.files import ParquetSink, UpsertTable, blackhole, merged


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="weir")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/weir-{uuid.uuid4().hex}"


_EVENTS = ("event_id", "user_id", "event_type", "ts", "value")


@query("sink_parquet", "SELECT event_id, ts, value FROM events")
def _(spark, load):
    sink = ParquetSink(folder(spark), compression="zstd", rolling_rows=1000)
    sink.write(load("events").select("event_id", "ts", "value"))
    return spark.read.parquet(sink.path)


@query("sink_partitioned", "SELECT event_type, user_id % 3 AS part, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL")
def _(spark, load):
    sink = ParquetSink(folder(spark), partition_by=("event_type", "part"), compact=True)
    sink.write(load("events").select("event_id", "event_type", (F.col("user_id") % 3).alias("part")))
    return spark.read.parquet(sink.path).groupBy("event_type", F.col("part").cast("bigint").alias("part")).agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("sink_overwrite_partitions", "SELECT event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS round, event_type FROM events")
def _(spark, load):
    sink = ParquetSink(folder(spark), partition_by=("event_type",))
    sink.write(load("events").select("event_id", "event_type", F.lit(0).alias("round")))
    sink.write(load("events").where("event_type = 'click'").select("event_id", "event_type", F.lit(1).alias("round")), "overwrite_partitions")
    return spark.read.parquet(sink.path).select("event_id", "round", "event_type")


@query("sink_commit", "SELECT count(DISTINCT event_type) AS n, count(DISTINCT event_type) + 1 AS marks FROM events")
def _(spark, load):
    sink = ParquetSink(folder(spark), partition_by=("event_type",), success=True)
    sink.write(load("events").select("event_id", "event_type"))
    # The writer's own mark is in the table's folder.
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sink.path}/*/_SUCCESS")
    found = len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)) + 1
    return spark.read.parquet(sink.path).agg(F.count_distinct("event_type").alias("n"), F.lit(found).cast("bigint").alias("marks"))


@query("sink_timestamp_millis", "SELECT event_id, date_trunc('milliseconds', ts) AS at FROM events")
def _(spark, load):
    sink = ParquetSink(folder(spark), times="millis", compression="gzip")
    sink.write(load("events").select("event_id", F.col("ts").cast("timestamp_ltz").alias("at")))
    return spark.read.parquet(sink.path).select("event_id", F.col("at").cast("timestamp_ntz").alias("at"))


@query("sink_nested", "SELECT o_orderkey, o_custkey AS a, o_orderstatus AS b FROM orders")
def _(spark, load):
    sink = ParquetSink(folder(spark))
    sink.write(load("orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("a"), F.array("o_orderstatus").alias("b")).alias("r")), "overwrite")
    return spark.read.parquet(sink.path).select("o_orderkey", "r.a", F.get("r.b", F.lit(0)).alias("b"))


@query("sink_blackhole", "SELECT 0::BIGINT AS kept")
def _(spark, load):
    blackhole(load("events"))
    return spark.range(1).select(F.lit(0).cast("bigint").alias("kept"))


#: A changelog over the events: +I at first, then -U and +U, and a -D for every seventh.
def changes(load) -> DataFrame:
    kind = F.when(F.col("event_id") % 7 == 6, "-D").when(F.col("event_id") % 3 == 0, "+U").otherwise("+I")
    return load("events").select("user_id", "event_type", "value", "event_id", kind.alias("row_kind"))


_LAST = "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 7 <> 6"


@query("sink_changelog_merge", _LAST)
def _(spark, load):
    table = None
    for k in range(3):
        table = merged(table, changes(load).where(f"event_id >= {k} * 3000 and (event_id < {k + 1} * 3000 or {k} = 2)"), ["user_id"], "event_id")
    return table


@query("sink_upsert_stream", _LAST)
def _(spark, load):
    root = folder(spark)
    for k in range(3):
        changes(load).where(f"event_id >= {k} * 3000 and (event_id < {k + 1} * 3000 or {k} = 2)").coalesce(1).write.mode("append").parquet(f"{root}/in")
    table = UpsertTable(spark, f"{root}/table", ["user_id"], "event_id")
    schema = spark.read.parquet(f"{root}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read().select("user_id", "event_type", "value")
