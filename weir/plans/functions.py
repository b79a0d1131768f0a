"""Registered queries of functions, casts, aggregates of all types, and functions of the user."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import aggregates as A
from weir.functions import scalar as S
from weir.functions import udf
from weir.plans.registry import query, sql

# Arithmetic and casts ------------------------------------------------------------------------------------------------

#: Half up, in whole numbers: 2 a / b with two more digits than the result keeps.
_QUOTIENT = "((2 * {a}::HUGEINT * 1000000 + {b}::HUGEINT) // (2 * {b}::HUGEINT))"


@query(
    "functions_decimal_divide",
    f"SELECT l_orderkey, l_linenumber, ({_QUOTIENT.format(a='round(l_extendedprice * 100)', b='round(l_quantity * 100)')}::DECIMAL(38,0) * 0.000001::DECIMAL(7,6))::DECIMAL(20,6) AS q, (round(l_extendedprice * 100)::BIGINT % round(l_quantity * 100)::BIGINT)::DECIMAL(15,0) * 0.01::DECIMAL(3,2) AS r, 0.00000006::DECIMAL(10,8) AS tiny FROM lineitem",
)
def _(spark, load):
    a, b = F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_quantity").cast("decimal(15,2)")
    tiny = S.decimal_divide(F.lit("0.00000012").cast("decimal(10,8)"), F.lit("2").cast("decimal(3,0)"), 10, 8)
    return load("lineitem").select("l_orderkey", "l_linenumber", S.decimal_divide(a, b, 20, 6).alias("q"), S.decimal_modulo(a, b, 18, 2).alias("r"), tiny.alias("tiny"))


sql("functions_literals", "SELECT o_orderkey, TRUE AS yes, CAST(1.50 AS DECIMAL(5,2)) AS dec, CAST(NULL AS BIGINT) AS nothing, 'it''s' AS text, o_orderdate + INTERVAL '1' DAY AS tomorrow, o_orderdate - INTERVAL '90' MINUTE AS before, DATE '2024-02-29' AS leap FROM orders")
sql("functions_cast_widening", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_linenumber AS TINYINT) AS SMALLINT) AS s, CAST(CAST(l_linenumber AS SMALLINT) AS BIGINT) AS b, CAST(l_linenumber AS DOUBLE) AS d, CAST(l_linenumber AS FLOAT) AS f, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS fd, CAST(l_linenumber AS DECIMAL(12,2)) AS dec FROM lineitem")


@query(
    "functions_cast_saturating",
    "SELECT event_id, greatest(least(trunc(value * 1e8), 2147483647), -2147483648)::INT AS i, greatest(least(trunc(value), 127), -128)::TINYINT AS t, 9223372036854775807 AS most, 0 AS nan FROM events",
)
def _(spark, load):
    v = F.col("value")
    return load("events").select("event_id", S.saturate(v * 1e8, "int").alias("i"), S.saturate(v, "tinyint").alias("t"), S.saturate(F.lit(1e30), "bigint").alias("most"), S.saturate(F.lit(float("nan")), "int").alias("nan"))


@query(
    "functions_cast_strings",
    "SELECT o_orderkey, o_custkey::VARCHAR AS text, o_custkey AS back, o_orderkey::DOUBLE + 0.5 AS d, (o_orderkey % 1000)::DECIMAL(10,2) + 0.25::DECIMAL(3,2) AS dec, o_orderkey % 2 = 0 AS flag, NULL::INT AS bad, left(o_orderpriority, 3) AS short, rpad(o_orderstatus, 3, ' ') AS padded, round(o_totalprice, 1)::DECIMAL(12,1) AS money FROM orders",
)
def _(spark, load):
    k = F.col("o_orderkey")
    return load("orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("text"), S.parse(F.concat(F.lit("  "), F.col("o_custkey").cast("string"), F.lit(" ")), "bigint").alias("back"),
        S.parse(F.concat(k.cast("string"), F.lit(".5")), "double").alias("d"), S.parse(F.concat((k % 1000).cast("string"), F.lit(".25")), "decimal(10,2)").cast("decimal(11,2)").alias("dec"),
        S.parse(F.when(k % 2 == 0, "TRUE").otherwise("false"), "boolean").alias("flag"), S.parse(F.lit("12x"), "int", lenient=True).alias("bad"), S.varchar(F.col("o_orderpriority"), 3).alias("short"),
        S.char(F.col("o_orderstatus"), 3).alias("padded"), F.col("o_totalprice").cast("decimal(12,1)").alias("money"),
    )


sql(
    "functions_math",
    "SELECT event_id, sign(value - 50) AS sg, round(exp(value / 100), 9) AS e, round(ln(value + 1), 9) AS l, round(sin(value), 9) AS s, round(cos(value), 9) AS c, round(tan(value / 100), 9) AS t, round(asin(value / 1000000), 9) AS asn, round(acos(value / 1000000), 9) AS acs, round(atan(value), 9) AS atn, round(log10(value + 1), 9) AS lg, round(power(value, 2), 4) AS p FROM events",
    "SELECT event_id, sign(value - 50)::DOUBLE AS sg, round(exp(value / 100), 9) AS e, round(ln(value + 1), 9) AS l, round(sin(value), 9) AS s, round(cos(value), 9) AS c, round(tan(value / 100), 9) AS t, round(asin(value / 1000000), 9) AS asn, round(acos(value / 1000000), 9) AS acs, round(atan(value), 9) AS atn, round(log10(value + 1), 9) AS lg, round(power(value, 2), 4) AS p FROM events",
)


@query("functions_round", "SELECT o_orderkey, round(o_orderkey + 0.5)::DOUBLE AS up, round(-(o_orderkey + 0.5))::DOUBLE AS down, (round(o_totalprice * 100) / 100)::DOUBLE AS cents FROM orders")
def _(spark, load):
    half = F.col("o_orderkey") + F.lit(0.5)
    return load("orders").select("o_orderkey", S.round_half_up(half).alias("up"), S.round_half_up(-half).alias("down"), S.round_half_up(F.col("o_totalprice"), 2).alias("cents"))


# Strings and times ---------------------------------------------------------------------------------------------------

sql("functions_trim", "SELECT o_orderkey, ltrim(concat('  ', o_orderstatus, ' ')) AS l, rtrim(concat('  ', o_orderstatus, ' ')) AS r, trim(concat('  ', o_orderstatus, ' ')) AS b, trim(BOTH 'x' FROM concat('xx', o_orderstatus, 'x')) AS x, chr(CAST(65 + o_orderkey % 26 AS INT)) AS letter, concat(o_orderstatus, NULL) AS nothing FROM orders", "SELECT o_orderkey, ltrim(concat('  ', o_orderstatus, ' ')) AS l, rtrim(concat('  ', o_orderstatus, ' ')) AS r, trim(concat('  ', o_orderstatus, ' ')) AS b, trim(concat('xx', o_orderstatus, 'x'), 'x') AS x, chr((65 + o_orderkey % 26)::INT) AS letter, o_orderstatus || NULL AS nothing FROM orders")


@query(
    "functions_regexp_groups",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' END AS took_part, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderkey::VARCHAR END AS empty, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS other FROM orders",
)
def _(spark, load):
    s = F.col("o_orderstatus")
    tail = F.concat(F.lit("id="), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderkey").cast("string")))
    return load("orders").select("o_orderkey", S.regexp_extract(s, "(F)|([A-Z])", 1).alias("took_part"), S.regexp_extract(tail, "id=([0-9]*)", 1).alias("empty"), S.regexp_extract(s, "(F)|([A-Z])", 2).alias("other"))


@query("functions_timestamp_ltz", "SELECT event_id, epoch_ms(event_id * 1000)::TIMESTAMP AS ms, epoch_ms(event_id * 1000)::TIMESTAMP AS s FROM events")
def _(spark, load):
    k = F.col("event_id")
    return load("events").select("event_id", S.to_timestamp_ltz(k * 1000, 3).cast("timestamp_ntz").alias("ms"), S.to_timestamp_ltz(k, 0).cast("timestamp_ntz").alias("s"))


sql("functions_others", "SELECT o_orderkey, md5(o_orderstatus) AS digest, get_json_object(concat('{\"a\": {\"b\": ', o_orderkey, '}}'), '$.a.b') AS field, size(array(1, 2, o_custkey)) AS n, array_contains(array('F', 'O'), o_orderstatus) AS known, element_at(map('k', o_custkey), 'k') AS v FROM orders", "SELECT o_orderkey, md5(o_orderstatus) AS digest, o_orderkey::VARCHAR AS field, 3 AS n, o_orderstatus IN ('F', 'O') AS known, o_custkey AS v FROM orders")

# Aggregates ----------------------------------------------------------------------------------------------------------


@query(
    "aggregates_average_types",
    "SELECT l_returnflag, round(avg(l_quantity), 6) AS of_double, round(avg(l_quantity::FLOAT), 3) AS of_float, (((2 * sum(round(l_extendedprice * 100)::HUGEINT) * 10000 + count(*)) // (2 * count(*)))::DECIMAL(38,0) * 0.000001::DECIMAL(7,6))::DECIMAL(38,6) AS of_decimal, (sum(l_linenumber) // count(*))::SMALLINT AS of_smallint, (sum(DISTINCT l_linenumber) // count(DISTINCT l_linenumber))::INT AS of_distinct, min(DISTINCT l_linenumber) AS lo, max(DISTINCT l_linenumber) AS hi, min(l_extendedprice::DECIMAL(15,2)) AS dec_lo, max(l_shipdate) AS last, min(l_linestatus) AS status FROM lineitem GROUP BY l_returnflag",
)
def _(spark, load):
    n, price, q = F.col("l_linenumber"), F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_quantity")
    return load("lineitem").groupBy("l_returnflag").agg(
        F.round(A.avg_as(q, "double"), 6).alias("of_double"), F.round(A.avg_as(q.cast("float"), "double"), 3).alias("of_float"), A.avg_as(price, "decimal(15,2)").alias("of_decimal"), A.avg_as(n.cast("smallint"), "smallint").alias("of_smallint"),
        A.avg_as(n, "int", distinct=True).alias("of_distinct"), F.expr("min(DISTINCT l_linenumber)").alias("lo"), F.expr("max(DISTINCT l_linenumber)").alias("hi"), F.min(price).alias("dec_lo"), F.max("l_shipdate").alias("last"), F.min("l_linestatus").alias("status"),
    )


@query("aggregates_wrapping", "SELECT user_id, ((sum(4611686018427387904::HUGEINT + event_id) + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT AS total, (((sum(4611686018427387904::HUGEINT + event_id) + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT) // count(*))::BIGINT AS mean FROM events GROUP BY user_id")
def _(spark, load):
    big = F.col("event_id") + F.lit(1 << 62)
    return load("events").groupBy("user_id").agg(A.sum_as(big, "bigint").alias("total"), A.avg_as(big, "bigint").alias("mean"))


@query("window_several_columns", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n, sum(user_id)::BIGINT AS users, min(event_id) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean, (sum(user_id) // count(user_id))::BIGINT AS user_mean FROM events GROUP BY ALL")
def _(spark, load):
    from weir.operators import windows

    w = windows.tumble(load("events"), "ts", "1 hour")
    return w.groupBy("window_start").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"), F.min("event_id").alias("lo"), F.round(F.max("value"), 6).alias("hi"), F.round(F.avg("value"), 6).alias("mean"), A.avg_as(F.col("user_id"), "bigint").alias("user_mean"))


sql("approximate_count", "SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS close FROM events GROUP BY event_type", "SELECT DISTINCT event_type, TRUE AS close FROM events")

# Functions of the user -----------------------------------------------------------------------------------------------


@query("udf_scalar", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE (length(event_type) - length(replace(event_type, 'c', '')) + user_id)::BIGINT END AS n FROM events")
def _(spark, load):
    f = udf.scalar(spark, "count_and_add", lambda s, k: None if k % 7 == 0 else s.count("c") + k, "bigint")
    return load("events").select("event_id", f("event_type", "user_id").alias("n"))


@query("udf_vectorized", "SELECT event_id, upper(event_type) AS up FROM events")
def _(spark, load):
    f = udf.vectorized(spark, "all_upper", lambda s: s.str.upper(), "string")
    return load("events").select("event_id", f("event_type").alias("up"))


@query("udf_aggregate", "SELECT event_type, max(event_id) - min(event_id) AS width FROM events GROUP BY event_type")
def _(spark, load):
    import pandas as pd

    def width(v: pd.Series) -> int:
        return int(v.max() - v.min())

    f = udf.aggregate(spark, "width_of", width, "bigint")
    return load("events").groupBy("event_type").agg(f("event_id").alias("width"))


class _Parts:
    def eval(self, text: str, n: int):
        for i, x in enumerate(text.split("-")[:n]):
            yield i, x


@query("udf_table_lateral", "SELECT o_orderkey, i::INT AS i, string_split(o_orderpriority, '-')[i + 1] AS part FROM orders, range(2) t(i) WHERE o_orderkey < 500 AND i < len(string_split(o_orderpriority, '-'))")
def _(spark, load):
    udf.table(spark, "parts_of", _Parts, "i int, part string")
    load("orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey, t.i, t.part FROM orders, LATERAL parts_of(o_orderpriority, 2) t WHERE o_orderkey < 500")
