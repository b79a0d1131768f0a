"""Stateful operators over batches that come one after the other: restarts, deletions, null keys, late rows, time to live."""

import time

import pytest
from pyspark.sql import functions as F

from weir import plans
from weir.plans.streams import rocks
from weir.sinks.files import ParquetSink, UpsertTable
from weir.streaming import keyed
from weir.streaming.changelog import collapse


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    time.sleep(0.02)  # files are read in the order of their times


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(spark, df, checkpoint, mode="update"):
    got = []
    with rocks(spark):
        df.writeStream.outputMode(mode).foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return got


CHANGES = "row_kind string, k long, v double, s string"


def test_group_goes_on_after_a_restart(spark, tmp_path):
    functions = {"n": ("count", None), "total": ("sum", "v"), "mean": ("avg", "v"), "lo": ("min", "v"), "hi": ("max", "s"), "kinds": ("count", "s", True)}
    put(spark, tmp_path / "in", [("+I", 1, 1.5, "a"), ("+I", 1, 2.0, "b"), ("+I", 2, 9.0, "z")], CHANGES)
    df = keyed.group(source(spark, tmp_path / "in", CHANGES), ["k"], functions)
    first = run(spark, df, tmp_path / "cp")
    assert {(r.row_kind, r.k, r.n, r.total, r.mean, r.lo, r.hi, r.kinds) for r in first} == {("+I", 1, 2, 3.5, 1.75, 1.5, "b", 2), ("+I", 2, 1, 9.0, 9.0, 9.0, "z", 1)}
    put(spark, tmp_path / "in", [("-D", 1, 1.5, "a"), ("-D", 2, 9.0, "z"), ("-D", 3, 1.0, "never"), ("+I", 1, 2.0, "b")], CHANGES)
    put(spark, tmp_path / "in", [("+I", 1, None, None)], CHANGES)
    later = run(spark, df, tmp_path / "cp")
    assert [(r.row_kind, r.n, r.total, r.lo, r.hi, r.kinds) for r in later if r.k == 1] == [("-U", 2, 3.5, 1.5, "b", 2), ("+U", 2, 4.0, 2.0, "b", 1), ("-U", 2, 4.0, 2.0, "b", 1), ("+U", 3, 4.0, 2.0, "b", 1)]
    assert [(r.row_kind, r.n) for r in later if r.k == 2] == [("-D", 1)]


def test_updates_without_their_before(spark, tmp_path):
    put(spark, tmp_path / "in", [("+I", 1, 1.0, "a")], CHANGES)
    put(spark, tmp_path / "in", [("+I", 1, 2.0, "a")], CHANGES)
    got = run(spark, keyed.group(source(spark, tmp_path / "in", CHANGES), ["k"], {"n": ("count", None)}, update_before=False), tmp_path / "cp")
    assert [(r.row_kind, r.n) for r in got] == [("+I", 1), ("+U", 2)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
def test_join_of_changes(spark, tmp_path, how):
    """Rows come, go and come again on both sides, some with null keys, timestamps and decimals."""
    left, right = "row_kind string, k long, a decimal(10,2), t timestamp_ntz", "row_kind string, rk long, b string"
    rows_l = [[("+I", 1, "1.50", 0), ("+I", None, "2.00", 1), ("+I", 2, "3.00", 2)], [("-U", 1, "1.50", 0), ("+U", 1, "1.75", 3), ("+I", 1, "1.75", 3)], [("-D", 2, "3.00", 2)]]
    rows_r = [[("+I", 1, "x"), ("+I", None, "y")], [("+I", 2, "z"), ("+I", 1, "w")], [("-D", 1, "x"), ("+I", 3, "q")]]
    for part in rows_l:
        df = spark.createDataFrame(part, "row_kind string, k long, a string, m long").select("row_kind", "k", F.col("a").cast("decimal(10,2)").alias("a"), F.timestamp_millis("m").cast("timestamp_ntz").alias("t"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        time.sleep(0.02)
    for part in rows_r:
        put(spark, tmp_path / "r", part, right)
    out = keyed.join(source(spark, tmp_path / "l", left), source(spark, tmp_path / "r", right), [("k", "rk")], how)
    got = collapse(spark.createDataFrame(run(spark, out, tmp_path / "cp"), out.schema))
    now_l = collapse(spark.read.schema(left).parquet(str(tmp_path / "l")))
    now_r = collapse(spark.read.schema(right).parquet(str(tmp_path / "r")))
    want = now_l.join(now_r, F.col("k") == F.col("rk"), {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    plain = lambda df: sorted(str([r[c] for c in got.columns]) for r in df.collect())
    assert plain(got) == plain(want)


def test_normalize_and_latest(spark, tmp_path):
    schema = "row_kind string, f0 long, f1 long"
    put(spark, tmp_path / "in", [("+I", 1, 10), ("+U", 1, 20), ("+I", 2, 5), ("+U", 2, 5), ("-D", 1, 99), ("+I", 3, 7), ("-D", 4, 0)], schema)
    got = run(spark, keyed.normalized(source(spark, tmp_path / "in", schema), ["f0"]), tmp_path / "cp")
    assert sorted((r.f0, r.row_kind, r.f1) for r in got) == [(1, "+I", 10), (1, "+U", 20), (1, "-D", 20), (1, "-U", 10), (2, "+I", 5), (3, "+I", 7)]
    last = run(spark, keyed.by_arrival(source(spark, tmp_path / "in", schema).drop("row_kind"), ["f0"], "last"), tmp_path / "cp2")
    assert sorted((r.row_kind, r.f1) for r in last if r.f0 == 1) == [("+I", 10), ("+U", 20), ("+U", 99), ("-U", 10), ("-U", 20)]


def test_first_by_time_waits_and_drops_late_rows(spark, tmp_path):
    schema = "k long, v long, ts timestamp"
    at = lambda rows: [(k, v, __import__("datetime").datetime(2024, 1, 1, 0, 0, s)) for k, v, s in rows]
    put(spark, tmp_path / "in", at([(1, 30, 20), (2, 50, 15)]), schema)
    put(spark, tmp_path / "in", at([(1, 25, 18), (2, 40, 16), (9, 0, 50)]), schema)
    put(spark, tmp_path / "in", at([(1, 5, 1), (9, 1, 55)]), schema)
    df = keyed.first_by_time(source(spark, tmp_path / "in", schema).withWatermark("ts", "5 seconds"), ["k"], "ts")
    got = run(spark, df, tmp_path / "cp", "append")
    assert sorted((r.k, r.v) for r in got if r.k < 9) == [(1, 25), (2, 50)]


def test_state_lives_for_a_time(spark, tmp_path):
    """Time to live goes by the clock, for which Spark would run batches without rows for ever."""
    schema = "k long, v long"
    put(spark, tmp_path / "in", [(1, 1)], schema)
    df = keyed.by_arrival(source(spark, tmp_path / "in", schema), ["k"], ttl_millis=500)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        assert len(run(spark, df, tmp_path / "cp")) == 1
        time.sleep(1)
        put(spark, tmp_path / "in", [(1, 2)], schema)
        assert [(r.row_kind, r.v) for r in run(spark, df, tmp_path / "cp")] == [("+I", 2)]
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_parquet_sink_of_a_stream(spark, tmp_path):
    schema = "k long, part string"
    put(spark, tmp_path / "in", [(1, "a"), (2, "b/c")], schema)
    put(spark, tmp_path / "in", [(3, "a"), (4, None)], schema)
    for success in (False, True):
        sink = ParquetSink(str(tmp_path / f"out{success}"), partition_by=("part",), success=success)
        for _ in range(2):  # the second run finds nothing new
            sink.stream(source(spark, tmp_path / "in", schema), str(tmp_path / f"cp{success}")).awaitTermination()
        assert sorted((r.k, r.part) for r in spark.read.parquet(sink.path).collect()) == [(1, "a"), (2, "b/c"), (3, "a"), (4, None)]
    assert len(list((tmp_path / "outTrue").glob("part=*/batch=*/_SUCCESS"))) == 4


def test_upsert_table_keeps_versions(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], "at")
    schema = "row_kind string, k long, v long, at long"
    for n, rows in enumerate([[("+I", 1, 1, 0), ("+I", 2, 2, 1)], [("-U", 1, 1, 2), ("+U", 1, 5, 2)], [("-D", 2, 2, 3)], [("+I", 3, 3, 4)]]):
        batch = spark.createDataFrame(rows, schema)
        table.merge(batch, n)
        table.merge(batch, n)  # a batch that runs again
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, 5), (3, 3)]
    assert len(list((tmp_path / "t").glob("v=*"))) == 2


def test_sort_hands_rows_once_in_the_order_of_time(spark, tmp_path):
    """Rows of one time are in the order of ties; a row is late when a batch before has handed later ones."""
    for rows in ([(10, 1), (20, 9), (20, 8)], [(15, 3), (30, 4)], [(12, 5), (20, 7), (40, 6)]):
        put(spark, tmp_path / "in", [(float(s), n) for s, n in rows], "s double, n long")
    df = source(spark, tmp_path / "in", "s double, n long").select(F.timestamp_seconds("s").alias("ts"), "n").withWatermark("ts", "0 seconds")
    got = []
    with rocks(spark):
        keyed.sorted_by_time(df, "ts", lambda b, _: got.append([r.n for r in b.collect()]), str(tmp_path / "cp"), 2, ties=("n",)).awaitTermination()
    assert [b for b in got if b] == [[1, 3], [7, 8, 9], [4]]


def test_places_of_rows_of_one_time(spark, tmp_path):
    spark.range(600).selectExpr("599 - id AS event_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id % 10) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(plans.QUERIES["stream_sort"](spark, str(tmp_path)).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1, 601))
    assert [r.event_id for r in got] == sorted(range(600), key=lambda e: ((599 - e) % 10, e))
