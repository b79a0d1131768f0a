"""Operators and functions on small rows with results that are written out."""

from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weir.functions import aggregates as A
from weir.functions import scalar as S
from weir.operators import joins, ranking, windows


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_rounding(spark):
    df = spark.createDataFrame([(0.5,), (2.5,), (-2.5,), (2.675,), (-1.4,)], "d double")
    got = df.select(F.abs("d"), F.floor("d"), F.ceil("d"), F.sign("d"), S.round_half_up(F.col("d")), S.round_half_up(F.col("d"), 2)).collect()
    assert [tuple(r) for r in got] == [(0.5, 0, 1, 1.0, 1.0, 0.5), (2.5, 2, 3, 1.0, 3.0, 2.5), (2.5, -3, -2, -1.0, -3.0, -2.5), (2.675, 2, 3, 1.0, 3.0, 2.68), (1.4, -2, -1, -1.0, -1.0, -1.4)]


def test_wrapping(spark):
    df = spark.createDataFrame([(100, 100, 300), (1, 2, 3)], "a tinyint, b tinyint, c smallint")
    add, mul = F.col("a").cast("int") + F.col("b"), F.col("c").cast("int") * F.col("c").cast("int")
    assert [tuple(r) for r in df.select(S.wrap(add, "tinyint"), S.wrap(mul, "smallint")).collect()] == [(-56, 24464), (3, 9)]
    big = F.lit((1 << 63) - 1).cast("decimal(38,0)") + 1
    assert one(spark, S.wrap(big, "bigint")) == -(1 << 63)


def test_regexp_extract(spark):
    rows = [("Apple", "https://site/x?channel_id=apple_1&foo=1"), ("Google", "https://site/y?a=1&channel_id=goog_2"), ("Retail", "channel_id=retail_7&z=9"), ("Retail", "https://site/z?no_channel=here"), ("Baidu", "https://site/q"), ("Vendor", "channel_id=")]
    df = spark.createDataFrame(rows, "channel string, url string")
    got = [r[0] for r in df.select(S.regexp_extract(F.col("url"), "(&|^|[?])channel_id=([^&]*)", 2)).collect()]
    assert got == ["apple_1", "goog_2", "retail_7", None, None, ""]
    parts = [tuple(r) for r in spark.createDataFrame([("ab",), ("b",), ("c",), ("",), (None,)], "s string").select(S.regexp_extract(F.col("s"), "(a)?(b)", 1), S.regexp_extract(F.col("s"), "(a?)(b)?", 2), S.regexp_extract(F.col("s"), "(x)|(c)|()", 3)).collect()]
    assert parts == [("a", "b", ""), (None, "b", ""), (None, None, None), (None, None, ""), (None, None, None)]


def test_split_index(spark):
    rows = [("https://www.nexmark.com/path/to/item.html",), ("http://x.com/a",), ("noscheme",), (None,), ("",)]
    df = spark.createDataFrame(rows, "url string")
    assert [r[0] for r in df.select(S.split_index(F.col("url"), "/", 3)).collect()] == ["path", "a", None, None, None]


def test_decimal_division(spark):
    d = lambda v, t: F.lit(v).cast(t)
    assert one(spark, S.decimal_divide(d("0.00000012", "decimal(10,8)"), d("2", "decimal(3,0)"), 20, 9)) == Decimal("0.000000060")
    assert one(spark, S.decimal_divide(d("10.00", "decimal(10,2)"), d("3.00", "decimal(10,2)"), 23, 13)) == Decimal("3.3333333333333")
    assert one(spark, S.decimal_divide(d("2", "decimal(1,0)"), d("3", "decimal(1,0)"), 8, 6)) == Decimal("0.666667")
    assert one(spark, S.decimal_divide(d("100", "decimal(3,0)"), d("1", "decimal(1,0)"), 3, 1)) is None
    assert one(spark, S.decimal_modulo(d("-7.50", "decimal(4,2)"), d("2", "decimal(1,0)"), 3, 2)) == Decimal("-1.50")
    with pytest.raises(PySparkException):
        one(spark, S.decimal_divide(d("1", "decimal(1,0)"), d("0", "decimal(1,0)"), 8, 6))


def test_casts(spark):
    values = [("3.99", "int", 3), ("-3.99", "int", -3), ("1e10", "int", (1 << 31) - 1), ("-1e10", "smallint", -(1 << 15)), ("nan", "bigint", 0), ("inf", "bigint", (1 << 63) - 1), ("9007199254740993", "bigint", 9007199254740992)]
    for text, kind, want in values:
        assert one(spark, S.saturate(F.lit(float(text)), kind)) == want
    assert one(spark, S.parse(F.lit(" 12 "), "int")) == 12 and one(spark, S.parse(F.lit("1.2.3"), "double", lenient=True)) is None
    assert one(spark, S.char(F.lit("ab"), 4)) == "ab  " and one(spark, S.varchar(F.lit("abcdef"), 3)) == "abc"
    with pytest.raises(PySparkException):
        one(spark, S.parse(F.lit("x"), "int"))


def test_aggregates_by_type(spark):
    rows = [(7, "a", 1, 10, 1.5, 100, 3, 1.25), (7, "a", 2, 20, 2.5, -7, -2, 2.5), (9, "b", 3, 30, 3.0, 250, 9, -0.75), (7, "a", 4, 40, 4.5, 42, 5, 4.5), (9, "b", 5, 50, 5.5, -11, -4, 5.125)]
    df = spark.createDataFrame(rows, "k long, s string, value long, qty int, price double, vs smallint, vt tinyint, vf float")
    got = df.groupBy("k").agg(A.sum_as(F.col("value"), "bigint"), A.avg_as(F.col("qty"), "int"), A.avg_as(F.col("price"), "double"), A.avg_as(F.col("vs"), "smallint"), A.avg_as(F.col("vt"), "tinyint"), A.sum_as(F.col("vf"), "float"), A.avg_as(F.col("vf"), "float")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(7, 7, 23, pytest.approx(8.5 / 3), 45, 2, 8.25, 2.75), (9, 8, 40, 4.25, 119, 2, 4.375, 2.1875)]
    top = spark.createDataFrame([(1, Decimal(10**38 - 1)), (1, Decimal(10**38 - 1)), (2, Decimal(5))], "k long, v decimal(38,0)")
    assert top.groupBy("k").agg(F.try_sum("v").alias("v")).orderBy("k").collect()[1].v == Decimal(5)


def test_top_n_and_dedup(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (1, 8), (1, 1), (2, 9), (2, 4)], "k long, v long")
    assert [tuple(r) for r in ranking.top_n(df, ["k"], [F.desc("v")], 2).orderBy("k", "rank_num").collect()] == [(1, 8, 1), (1, 5, 2), (2, 9, 1), (2, 4, 2)]
    d = spark.createDataFrame([(1, 30, 2000), (2, 50, 1500), (1, 20, 0), (2, 40, 1000), (1, 25, 800)], "k long, v long, ts long")
    assert sorted(map(tuple, ranking.keep_first(d, ["k"], "ts").collect())) == [(1, 20, 0), (2, 40, 1000)]
    assert sorted(map(tuple, ranking.keep_last(d, ["k"], "ts").collect())) == [(1, 30, 2000), (2, 50, 1500)]
    upserts = spark.createDataFrame([("+I", 1, 10, 0), ("+U", 1, 20, 1), ("+I", 2, 5, 2), ("+U", 2, 5, 3), ("-D", 1, 20, 4), ("+I", 3, 7, 5)], "row_kind string, f0 long, f1 long, seq long")
    assert sorted(map(tuple, ranking.normalized(upserts, ["f0"], "seq").select("f0", "f1").collect())) == [(2, 5), (3, 7)]


def test_temporal_join(spark):
    orders = spark.createDataFrame([("USD", 1, 150), ("EUR", 2, 250), ("GBP", 4, 260), ("USD", 3, 450)], "currency string, amount long, ts long")
    rates = spark.createDataFrame([("USD", 10, 100, "+I"), ("EUR", 99, 100, "+I"), ("USD", 20, 300, "+U"), ("EUR", 99, 200, "-D")], "currency string, rate long, ts long, kind string")
    inner = joins.temporal_join(orders, rates.drop("kind").where("currency <> 'EUR' or ts = 100"), "currency", "ts", "ts")
    assert sorted((r.amount, r.version_rate) for r in inner.collect()) == [(1, 10), (2, 99), (3, 20)]
    left = joins.temporal_join(orders, rates, "currency", "ts", "ts", "left", "kind", F.col("version_rate") < 20)
    assert sorted((r.amount, r.version_rate) for r in left.collect()) == [(1, 10), (2, None), (3, None), (4, None)]


def test_interval_join_ends_are_inside(spark):
    rows = [(1, 10, 1000), (1, 20, 3000), (2, 30, 1000), (1, 40, 1500), (2, 50, 1500), (3, 60, 2000), (None, 70, 1000)]
    at = F.timestamp_millis("ts").cast("timestamp_ntz")
    a = spark.createDataFrame(rows, "ka long, va long, ts long").select("ka", "va", at.alias("ta"))
    b = spark.createDataFrame(rows, "kb long, vb long, ts long").select("kb", "vb", at.alias("tb"))
    for how in ("inner", "left", "right", "full", "semi", "anti"):
        got = joins.interval_join(a, b, [("ka", "kb")], ("ta", "tb"), "-500 MILLISECONDS", "1 SECOND", how)
        on = (F.col("ka") == F.col("kb")) & F.col("ta").between(F.col("tb") - F.expr("INTERVAL 500 MILLISECONDS"), F.col("tb") + F.expr("INTERVAL 1 SECOND"))
        want = a.join(b, on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())), how


def test_windows(spark):
    df = spark.createDataFrame([(1, 0), (2, 1500), (4, 700), (9, 5000)], "value long, ts long").select("value", F.timestamp_millis("ts").alias("rt"))
    seconds = lambda c: F.unix_millis(c) / 1000
    tumble = windows.tumble(df, "rt", "1 second").groupBy("window_start").agg(F.sum("value").alias("v")).select(seconds(F.col("window_start")), "v")
    assert sorted(map(tuple, tumble.collect())) == [(0.0, 5), (1.0, 2), (5.0, 9)]
    slices = windows.hop_aggregate(df, "rt", "2 SECONDS", "1 SECOND", [], {"v": (F.sum("value"), "sum")}).select(seconds(F.col("window_start")), "v")
    assert sorted(map(tuple, slices.collect())) == [(-1.0, 5), (0.0, 7), (1.0, 2), (4.0, 9), (5.0, 9)]


def test_sorted_places(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("ts"))
    got = ranking.sorted_by_time(df, "ts", name="place").collect()
    assert all(r.place == r.ts + 1 for r in got) and len(got) == 5000


def test_async_lookup(spark):
    from pyspark.sql import types as T

    dim = {0: "apple", 1: "google", 2: "facebook", 3: "baidu", 4: "amazon"}
    probe = spark.createDataFrame([(1, 100), (2, 200), (6, 300), (9, 400), (5, 500), (None, 600)], "auction long, price long").coalesce(1)
    fields = T.StructType([T.StructField("val", T.StringType())])
    fetch = lambda k: {"val": dim[k]} if k in dim else None
    assert [r.val for r in joins.lookup_join_async(probe, "auction", fetch, fields, "left", 3).collect()] == ["google", "facebook", None, None, None, None]
    assert [r.price for r in joins.lookup_join_async(probe, "auction", fetch, fields, "inner", 3).collect()] == [100, 200]
