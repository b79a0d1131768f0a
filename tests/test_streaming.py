"""Streams against the batch answer: the collapsed changelog equals it."""

import pytest
from pyspark.sql import functions as F

from weir.operators import windows
from weir.streaming import changelog

SCHEMA = "k bigint, v bigint, side string, w bigint"


def batches(spark, tmp_path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def collected(spark, df, tmp_path, mode="update"):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = []

    def sink(batch, _):
        rows.extend(batch.collect())

    q = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.createDataFrame(rows, df.schema)


ROWS = [[(1, 5, "l", None), (1, 3, "l", None), (2, 9, "l", None)], [(1, None, "r", 7), (2, 4, "l", None)], [(3, None, "r", 8), (1, 8, "l", None)]]
ALL = [r for part in ROWS for r in part]


def plain(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def test_group_changelog(spark, tmp_path):
    left = [[r for r in part if r[2] == "l"] for part in ROWS]
    got = changelog.changes(batches(spark, tmp_path, [p for p in left if p]), ["k"], changelog.group_view(["k"], "v"), "k bigint, n bigint, total bigint, lo bigint, hi bigint, mean bigint")
    want = spark.createDataFrame([r for r in ALL if r[2] == "l"], SCHEMA).groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.expr("sum(v) DIV count(v)").alias("mean"))
    assert plain(changelog.collapse(collected(spark, got, tmp_path))) == plain(want)


def test_top_n_changelog(spark, tmp_path):
    got = changelog.changes(batches(spark, tmp_path, ROWS), ["side"], changelog.top_view(lambda r: (-(r["v"] or 0), r["k"]), 2), SCHEMA)
    out = changelog.collapse(collected(spark, got, tmp_path))
    assert sorted(r["v"] for r in out.where("side = 'l'").collect()) == [8, 9]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
def test_join_changelog(spark, tmp_path, how):
    schema = "k bigint, v bigint" + ("" if how in ("semi", "anti") else ", w bigint, rk bigint")
    stream = batches(spark, tmp_path, ROWS).withColumn("rk", F.col("k"))
    got = changelog.changes(stream, ["k"], changelog.join_view(how, ["k", "v"], ["w", "rk"]), schema)
    df = spark.createDataFrame(ALL, SCHEMA)
    a, b = df.where("side = 'l'").select("k", "v"), df.where("side = 'r'").select(F.col("k").alias("rk"), "w")
    want = a.join(b, F.col("k") == F.col("rk"), {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    assert plain(changelog.collapse(collected(spark, got, tmp_path))) == plain(want)


def test_windowed_append(spark, tmp_path):
    schema = "ts timestamp, v bigint"
    rows = spark.sql("SELECT timestamp_millis(x) AS ts, v FROM VALUES (0, 1L), (1500, 2L), (700, 4L), (5000, 9L), (9000000, 0L) AS t(x, v)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    agg = lambda df: windows.tumble(df, "ts", "1 second").groupBy("window_start", "window_end").agg(F.sum("v").alias("v"))
    stream_agg = stream.groupBy(F.window("ts", "1 second")).agg(F.sum("v").alias("v")).select("window.start", "window.end", "v")
    got = collected(spark, stream_agg, tmp_path, "append")
    want = agg(spark.read.parquet(str(tmp_path / "in"))).where("v > 0").toDF("start", "end", "v")
    assert plain(got) == plain(want)
