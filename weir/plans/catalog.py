"""The registered queries: a Spark form and the SQL that another engine runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.functions import aggregates as A
from weir.functions import scalar as S
from weir.operators import joins, ranking, unnest, windows
from weir.plans.registry import ORACLES, QUERIES, query, sql, table
from weir.sources import formats, nexmark

# Windows -------------------------------------------------------------------------------------------------------------

_TUMBLE = "time_bucket(INTERVAL '{0}', ts) AS window_start, time_bucket(INTERVAL '{0}', ts) + INTERVAL '{0}' AS window_end"


@query("window_tumble_count", f"SELECT {_TUMBLE.format('10 minutes')}, time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' - INTERVAL '1 millisecond' AS window_time, event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY ALL")
def _(spark, load):
    w = windows.tumble(load("events"), "ts", "10 minutes")
    return w.groupBy("window_start", "window_end", "window_time", "event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


_HOPS = "(SELECT event_id, user_id, event_type, ts, value, time_bucket(INTERVAL '{slide} minutes', ts) - to_minutes({slide} * k) AS window_start FROM events, range({n}) t(k))"


@query("window_hop_aggregates", f"SELECT window_start, window_start + INTERVAL '60 minutes' AS window_end, event_type, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi, (sum(event_id) // count(*))::BIGINT AS mean FROM {_HOPS.format(slide=15, n=4)} GROUP BY ALL")
def _(spark, load):
    parts = {"n": (F.count("*"), "sum"), "lo": (F.min("event_id"), "min"), "hi": (F.max("event_id"), "max"), "total": (F.sum("event_id"), "sum")}
    w = windows.hop_aggregate(load("events"), "ts", "60 MINUTES", "15 MINUTES", ["event_type"], parts)
    return w.withColumn("mean", F.expr("total DIV n")).drop("total")


@query("window_cumulate_count", "SELECT s AS window_start, s + to_minutes(15 * k) AS window_end, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL '60 minutes', ts) AS s, * FROM events), range(1, 5) t(k) WHERE s + to_minutes(15 * k) > ts GROUP BY ALL")
def _(spark, load):
    return windows.cumulate(load("events"), "ts", "60 MINUTES", "15 MINUTES").groupBy("window_start", "window_end", "event_type").agg(F.count("*").alias("n"))


_SESSIONS = "SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '2 hours' AS window_end, count(*) AS n, max(event_id) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"


@query("window_session_count", _SESSIONS)
def _(spark, load):
    return windows.session(load("events"), "ts", "2 hours", ["user_id"], F.count("*").alias("n"), F.max("event_id").alias("last")).drop("window_time")


@query("window_reaggregate_hot", f"WITH c AS (SELECT window_start, user_id, count(*) AS num FROM {_HOPS.format(slide=15, n=4)} GROUP BY ALL), m AS (SELECT window_start, max(num) AS top FROM c GROUP BY ALL) SELECT c.window_start, user_id, num FROM c JOIN m ON c.window_start = m.window_start AND num >= top")
def _(spark, load):
    c = windows.hop_aggregate(load("events"), "ts", "60 MINUTES", "15 MINUTES", ["user_id"], {"num": (F.count("*"), "sum")})
    # A row for each user and window is left here; the window's maximum is taken over them in one sort.
    return c.withColumn("top", F.max("num").over(Window.partitionBy("window_start"))).where("num >= top").select("window_start", "user_id", "num")


@query("window_distinct_users", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS clickers FROM events GROUP BY ALL")
def _(spark, load):
    w = windows.tumble(load("events"), "ts", "1 hour")
    return w.groupBy("window_start").agg(F.count_distinct("user_id").alias("users"), F.expr("count(DISTINCT user_id) FILTER (WHERE event_type = 'click')").alias("clickers"))


@query("window_grouping_only", "SELECT DISTINCT time_bucket(INTERVAL '1 hour', ts) AS window_start, user_id FROM events")
def _(spark, load):
    return windows.tumble(load("events"), "ts", "1 hour").select("window_start", "user_id").distinct()


@query("window_top_n", "SELECT window_start, event_type, event_id, rank_num FROM (SELECT *, row_number() OVER (PARTITION BY window_start, event_type ORDER BY value DESC, event_id) AS rank_num FROM (SELECT *, time_bucket(INTERVAL '6 hours', ts) AS window_start FROM events)) WHERE rank_num <= 2")
def _(spark, load):
    w = windows.tumble(load("events"), "ts", "6 hours")
    return ranking.top_n(w, ["window_start", "event_type"], [F.desc("value"), F.asc("event_id")], 2).select("window_start", "event_type", "event_id", "rank_num")


for _name, _order, _f in (("first", "ASC", ranking.keep_first), ("last", "DESC", ranking.keep_last)):

    @query(f"window_dedup_{_name}", f"SELECT window_start, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY window_start, user_id ORDER BY ts {_order}, event_id {_order}) AS r FROM (SELECT *, time_bucket(INTERVAL '6 hours', ts) AS window_start FROM events)) WHERE r = 1")
    def _(spark, load, f=_f):
        return f(windows.tumble(load("events"), "ts", "6 hours").select("window_start", "user_id", "event_id", "ts"), ["window_start", "user_id"], "ts", "event_id").drop("ts")

    @query(f"dedup_keep_{_name}", f"SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {_order}, event_id {_order}) AS r FROM events) WHERE r = 1")
    def _(spark, load, f=_f):
        return f(load("events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id").drop("ts")


# Aggregates ----------------------------------------------------------------------------------------------------------


@query("group_typed_aggregates", "SELECT l_returnflag, sum(l_linenumber)::INT AS total, (sum(l_linenumber) // count(l_linenumber))::INT AS mean, min(l_partkey) AS lo, max(l_shipdate) AS hi, count(*) AS n, count(DISTINCT l_suppkey) AS supps, sum(DISTINCT l_linenumber)::BIGINT AS dsum, sum(CAST(l_extendedprice AS DECIMAL(15,2)))::DECIMAL(38,2) AS dec_sum FROM lineitem GROUP BY l_returnflag")
def _(spark, load):
    n, price = F.col("l_linenumber"), F.col("l_extendedprice").cast("decimal(15,2)")
    return load("lineitem").groupBy("l_returnflag").agg(
        A.sum_as(n, "int").alias("total"), A.avg_as(n, "int").alias("mean"), F.min("l_partkey").alias("lo"), F.max("l_shipdate").alias("hi"), F.count("*").alias("n"),
        F.count_distinct("l_suppkey").alias("supps"), F.sum_distinct("l_linenumber").alias("dsum"), A.sum_as(price, "decimal(15,2)").alias("dec_sum"),
    )


sql("global_aggregate", "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(DISTINCT o_custkey) AS custs FROM orders")
sql("group_filter_distinct", "SELECT l_shipdate, count(*) AS n, count(*) FILTER (WHERE l_quantity < 10) AS small, count(DISTINCT l_partkey) FILTER (WHERE l_discount > 0.05) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_shipdate")
sql("group_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
sql("group_nested_key", "SELECT k[1] AS status, count(*) AS n FROM (SELECT array(o_orderstatus, o_orderpriority) AS k FROM orders) GROUP BY k", "SELECT o_orderpriority AS status, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
for _n, _g in (("sets", "GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"), ("cube", "CUBE (o_orderstatus, o_orderpriority)"), ("rollup", "ROLLUP (o_orderstatus, o_orderpriority)")):
    sql(f"grouping_{_n}", f"SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g, count(*) AS n FROM orders GROUP BY {_g}")

# OVER ----------------------------------------------------------------------------------------------------------------

_KEYED = "PARTITION BY user_id ORDER BY ts"
sql("over_range_running", f"SELECT event_id, sum(event_id) OVER w AS s, min(event_id) OVER w AS lo, max(event_id) OVER w AS hi, count(value) OVER w AS n FROM events WINDOW w AS ({_KEYED} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"SELECT event_id, (sum(event_id) OVER w)::BIGINT AS s, min(event_id) OVER w AS lo, max(event_id) OVER w AS hi, count(value) OVER w AS n FROM events WINDOW w AS ({_KEYED} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
_ROWS = f"WINDOW w AS ({_KEYED}, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)"
sql("over_rows_bounded", f"SELECT event_id, sum(event_id) OVER w AS s, sum(event_id) OVER w DIV count(event_id) OVER w AS mean, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l FROM events {_ROWS}", f"SELECT event_id, (sum(event_id) OVER w)::BIGINT AS s, (sum(event_id) OVER w // count(event_id) OVER w)::BIGINT AS mean, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l FROM events {_ROWS}")
sql("over_range_interval", f"SELECT event_id, count(*) OVER w AS n, max(event_id) OVER w AS hi FROM events WINDOW w AS ({_KEYED} RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW)")
sql("over_ranks", f"SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn, CAST(rank() OVER ({_KEYED}) AS BIGINT) AS rk, CAST(dense_rank() OVER ({_KEYED}) AS BIGINT) AS dr FROM events")
sql("over_lag_lead", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")

# Rank, sort, limit ---------------------------------------------------------------------------------------------------


@query("top_n_offset", "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank_num FROM orders) WHERE rank_num BETWEEN 2 AND 3")
def _(spark, load):
    return ranking.top_n(load("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 1).select("o_custkey", "o_orderkey", "rank_num")


sql("top_n_null_order", "SELECT event_id, r FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY nullif(user_id, 3) DESC NULLS LAST, event_id) AS BIGINT) AS r FROM events) WHERE r <= 5")
sql("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")


@query("changelog_normalize", "SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def _(spark, load):
    changes = load("events").select("user_id", "value", "event_id", F.when(F.col("event_type") == "error", "-D").otherwise("+U").alias("row_kind"))
    return ranking.normalized(changes, ["user_id"], "event_id").select("user_id", "value")


# Joins ---------------------------------------------------------------------------------------------------------------

for _how in ("INNER", "LEFT", "RIGHT", "FULL"):
    _on = f"FROM customer c {_how} JOIN orders o ON c_custkey = o_custkey"
    sql(f"join_{_how.lower()}", f"SELECT c_custkey, o_orderkey {_on} AND c_nationkey < 15 AND o_orderstatus <> 'F'")
    sql(f"join_{_how.lower()}_residual", f"SELECT c_custkey, o_orderkey {_on} AND o_totalprice > c_acctbal * 20")
for _n, _not in (("semi", ""), ("anti", "NOT ")):
    sql(f"join_{_n}", f"SELECT c_custkey, c_name FROM customer WHERE {_not}EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("join_of_aggregates", "SELECT a.o_custkey, a.n, b.top FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) a JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) b ON a.o_custkey = b.o_custkey")
sql("join_multiway", "SELECT n_name, count(*) AS n, count(DISTINCT l_suppkey) AS supps FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
sql("join_self", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey")
for _how in ("inner", "left", "right", "full"):

    @query(f"interval_join_{_how}", f"SELECT a.event_id AS a, b.event_id AS b FROM (SELECT * FROM events WHERE event_type = 'click') a {_how} JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts BETWEEN b.ts - INTERVAL '1 hour' AND b.ts + INTERVAL '2 hours'")
    def _(spark, load, how=_how):
        a = load("events").where("event_type = 'click'").select(F.col("event_id").alias("a"), F.col("user_id").alias("ka"), F.col("ts").alias("ta"))
        b = load("events").where("event_type = 'purchase'").select(F.col("event_id").alias("b"), F.col("user_id").alias("kb"), F.col("ts").alias("tb"))
        return joins.interval_join(a, b, [("ka", "kb")], ("ta", "tb"), "-1 HOUR", "2 HOURS", how).select("a", "b")

    @query(f"window_join_{_how}", f"SELECT a.event_id AS a, b.event_id AS b FROM (SELECT *, time_bucket(INTERVAL '2 hours', ts) AS w FROM events WHERE event_type = 'click') a {_how} JOIN (SELECT *, time_bucket(INTERVAL '2 hours', ts) AS w FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.w = b.w")
    def _(spark, load, how=_how):
        side = lambda t, n: windows.tumble(load("events").where(F.col("event_type") == t), "ts", "2 hours").select("user_id", "window_start", F.col("event_id").alias(n))
        return side("click", "a").join(side("view", "b"), ["user_id", "window_start"], how).select("a", "b")


for _how, _asof in (("inner", "ASOF JOIN"), ("left", "ASOF LEFT JOIN")):

    @query(f"temporal_join_{_how}", f"SELECT p.event_id, v.event_id AS version_event_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') p {_asof} (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'purchase') WHERE r = 1) v ON p.user_id = v.user_id AND p.ts >= v.ts")
    def _(spark, load, how=_how):
        e = load("events").select("user_id", "event_id", "ts", "event_type")
        v = ranking.keep_last(e.where("event_type = 'purchase'"), ["user_id", "ts"], "event_id").drop("event_type")
        return joins.temporal_join(e.where("event_type <> 'purchase'").drop("event_type"), v, "user_id", "ts", "ts", how).select("event_id", "version_event_id")

    @query(f"lookup_join_{_how}", f"SELECT event_id, p_name FROM events {_how} JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = user_id % 40")
    def _(spark, load, how=_how):
        return joins.lookup_join(load("events"), load("part").where("p_size > 10"), F.expr("p_partkey = user_id % 40"), how).select("event_id", "p_name")


# Set operations, unnest ----------------------------------------------------------------------------------------------

for _n, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT")):
    sql(f"set_{_n}", f"SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 {_op} SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0")
sql("filter_project", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q FROM lineitem WHERE l_discount > 0.05 AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'")

_ARRAY = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN CAST(array() AS array<bigint>) ELSE array(o_custkey, NULL, o_orderkey) END"
_ORDINAL = "SELECT o_orderkey, {} FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <= 1 THEN [] ELSE [o_custkey, NULL, o_orderkey] END AS vs FROM orders) {} (SELECT unnest(vs) AS v, generate_subscripts(vs, 1) AS pos) u {}"


@query("unnest_array", _ORDINAL.format("v", ", LATERAL", ""))
def _(spark, load):
    return unnest.unnest(load("orders").select("o_orderkey", F.expr(_ARRAY).alias("vs")), "vs", ["v"])


@query("unnest_left_ordinality", _ORDINAL.format("v, pos::INT AS pos", "LEFT JOIN LATERAL", "ON true"))
def _(spark, load):
    return unnest.unnest(load("orders").select("o_orderkey", F.expr(_ARRAY).alias("vs")), "vs", ["v"], outer=True, ordinality="pos")


@query("unnest_filter", _ORDINAL.format("v", ", LATERAL", "WHERE v > 100"))
def _(spark, load):
    return unnest.unnest(load("orders").select("o_orderkey", F.expr(_ARRAY).alias("vs")), "vs", ["v"]).where("v > 100")


@query("unnest_rows", "SELECT o_orderkey, o_custkey AS a, o_orderstatus AS b FROM orders")
def _(spark, load):
    rows = F.array(F.struct(F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b")), F.lit(None))
    return unnest.unnest(load("orders").select("o_orderkey", rows.alias("rs")), "rs", ["a", "b"])


@query("unnest_map", "SELECT o_orderkey, 'a' AS k, o_custkey AS v FROM orders UNION ALL SELECT o_orderkey, 'b', o_orderkey FROM orders")
def _(spark, load):
    return unnest.unnest(load("orders").select("o_orderkey", F.create_map(F.lit("a"), "o_custkey", F.lit("b"), "o_orderkey").alias("m")), "m", ["k", "v"])


@query("unnest_multiset", "SELECT o_orderkey, e FROM orders, LATERAL (SELECT unnest(['x', 'x', o_orderstatus]) AS e)")
def _(spark, load):
    counted = F.create_map(F.lit("x"), F.lit(2), F.col("o_orderstatus"), F.lit(1))
    return unnest.unnest_multiset(load("orders").select("o_orderkey", counted.alias("ms")), "ms", "e")


# Functions -----------------------------------------------------------------------------------------------------------

_URL = "concat('https://x.com/', o_orderkey, '/', o_orderstatus, '?channel_id=', lower(o_orderstatus), '&z')"


@query("functions_strings", f"SELECT o_orderkey, string_split({_URL}, '/')[4] AS part3, CASE WHEN regexp_matches({_URL}, 'channel_id=([fo])&') THEN regexp_extract({_URL}, 'channel_id=([fo])&', 1) END AS channel, upper(o_orderpriority) AS up, length(o_orderpriority)::INT AS n, substring(o_orderpriority, 3, 4) AS sub, replace(o_orderpriority, '-', '+') AS rep, reverse(o_orderpriority) AS rev, left(o_orderpriority, 2) AS lef, right(o_orderpriority, 2) AS rig, lpad(o_orderstatus, 4, '*') AS lp, rpad(o_orderstatus, 4, '*') AS rp, position('E' IN o_orderpriority)::INT AS pos, ascii(o_orderstatus) AS asc_, repeat(o_orderstatus, 3) AS rpt, trim(concat(' ', o_orderstatus, ' ')) AS tr, (length(o_orderpriority) - length(replace(o_orderpriority, 'E', '')))::BIGINT AS es, o_orderpriority LIKE '%HIGH%' AS high FROM orders")
def _(spark, load):
    url, p, s = F.expr(_URL), F.col("o_orderpriority"), F.col("o_orderstatus")
    return load("orders").select(
        "o_orderkey", S.split_index(url, "/", 3).alias("part3"), S.regexp_extract(url, "channel_id=([fo])&", 1).alias("channel"), F.upper(p).alias("up"), F.length(p).alias("n"), F.substring(p, 3, 4).alias("sub"),
        F.replace(p, F.lit("-"), F.lit("+")).alias("rep"), F.reverse(p).alias("rev"), F.left(p, F.lit(2)).alias("lef"), F.right(p, F.lit(2)).alias("rig"), F.lpad(s, 4, "*").alias("lp"), F.rpad(s, 4, "*").alias("rp"),
        F.instr(p, "E").alias("pos"), F.ascii(s).alias("asc_"), F.repeat(s, 3).alias("rpt"), F.trim(F.concat(F.lit(" "), s, F.lit(" "))).alias("tr"), S.count_char(p, F.lit("E")).alias("es"), p.like("%HIGH%").alias("high"),
    )


sql("functions_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'F'), 'none') AS st, o_orderstatus IN ('F', 'O') AS done, (o_totalprice > 100000) IS NOT TRUE AS low FROM orders")
sql("functions_time", "SELECT event_id, date_format(ts, 'yyyy-MM-dd HH:mm') AS day, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS s, ts + INTERVAL '4' SECOND AS later FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS day, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, ts + INTERVAL '4' SECOND AS later FROM events")


@query("functions_numbers", "SELECT l_orderkey, l_linenumber, (CASE WHEN l_orderkey * 1000003 % 4294967296 >= 2147483648 THEN l_orderkey * 1000003 % 4294967296 - 4294967296 ELSE l_orderkey * 1000003 % 4294967296 END)::INT AS wrapped, (l_partkey // 7)::BIGINT AS q, l_partkey % 7 AS r, abs(l_discount - 0.05) AS a, floor(l_extendedprice)::BIGINT AS f, ceil(l_extendedprice)::BIGINT AS c, (CAST(0.908 AS DECIMAL(4,3)) * l_partkey)::DECIMAL(23,3) AS price, sqrt(l_quantity) AS sq FROM lineitem")
def _(spark, load):
    return load("lineitem").select(
        "l_orderkey", "l_linenumber", S.wrap(F.col("l_orderkey") * 1000003, "int").alias("wrapped"), F.expr("l_partkey DIV 7").alias("q"), F.expr("l_partkey % 7").alias("r"), F.abs(F.col("l_discount") - 0.05).alias("a"),
        F.floor("l_extendedprice").alias("f"), F.ceil("l_extendedprice").alias("c"), F.expr("CAST(0.908 * CAST(l_partkey AS DECIMAL(19,0)) AS DECIMAL(23,3))").alias("price"), F.sqrt("l_quantity").alias("sq"),
    )


@query("functions_items", "SELECT o_orderkey, o_custkey AS first, NULL::BIGINT AS beyond, o_orderkey AS b, NULL::BIGINT AS none, o_orderstatus AS field FROM orders")
def _(spark, load):
    arr, m = F.array("o_custkey", "o_orderkey"), F.create_map(F.lit("b"), "o_orderkey")
    return load("orders").select("o_orderkey", S.item(arr, 1).alias("first"), S.item(arr, 9).alias("beyond"), S.item(m, "b").alias("b"), S.item(m, "z").alias("none"), F.struct("o_orderstatus")["o_orderstatus"].alias("field"))


# Formats -------------------------------------------------------------------------------------------------------------

_ROW = "event_id BIGINT, event_type STRING, value DOUBLE"


def _schema(spark):
    return spark.createDataFrame([], _ROW).schema


_BODY = "struct(event_id, event_type, value)"
_PLAIN = "SELECT event_id, event_type, value FROM events"
_CHANGES = "SELECT '+I' AS row_kind, event_id, event_type, value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT '-U', event_id, 'old', value FROM events WHERE event_id % 3 = 1 UNION ALL SELECT '+U', event_id, event_type, value FROM events WHERE event_id % 3 = 1 UNION ALL SELECT '-D', event_id, event_type, value FROM events WHERE event_id % 3 = 2"


def _messages(load, body: str) -> DataFrame:
    return load("events").select(F.expr(body).alias("value"))


def _op(a: str, b: str, c: str) -> str:
    return f"CASE event_id % 3 WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' ELSE '{c}' END"


@query("format_json", _PLAIN)
def _(spark, load):
    return formats.decode_json(_messages(load, "to_json(struct(string(event_id) AS event_id, event_type, value))"), _schema(spark))


@query("format_csv", _PLAIN)
def _(spark, load):
    return formats.decode_csv(_messages(load, f"to_csv({_BODY}, map('sep', ';'))"), _schema(spark), sep=";")


@query("format_raw", "SELECT event_type AS body FROM events")
def _(spark, load):
    return formats.decode_raw(_messages(load, "binary(event_type)"), "body")


_BEFORE = f"CASE event_id % 3 WHEN 1 THEN struct(event_id, 'old' AS event_type, value) WHEN 2 THEN {_BODY} END AS before"
_AFTER = f"CASE WHEN event_id % 3 < 2 THEN {_BODY} END AS after"
_CHANGED = "CASE event_id % 3 WHEN 1 THEN struct('old' AS event_type) END"


@query("format_debezium", _CHANGES)
def _(spark, load):
    return formats.decode_debezium(_messages(load, f"to_json(struct({_BEFORE}, {_AFTER}, {_op('c', 'u', 'd')} AS op))"), _schema(spark))


@query("format_ogg", _CHANGES)
def _(spark, load):
    return formats.decode_ogg(_messages(load, f"to_json(struct({_BEFORE}, {_AFTER}, {_op('I', 'U', 'D')} AS op_type))"), _schema(spark))


@query("format_maxwell", _CHANGES)
def _(spark, load):
    return formats.decode_maxwell(_messages(load, f"to_json(struct({_BODY} AS data, {_CHANGED} AS old, {_op('insert', 'update', 'delete')} AS type))"), _schema(spark))


@query("format_canal", _CHANGES)
def _(spark, load):
    return formats.decode_canal(_messages(load, f"to_json(struct(array({_BODY}) AS data, array({_CHANGED}) AS old, {_op('INSERT', 'UPDATE', 'DELETE')} AS type))"), _schema(spark))


# The auction stream --------------------------------------------------------------------------------------------------


def auction(name: str, text: str, oracle: str | None = None) -> None:
    """A query over the stream, with nexmark.PER_EVENT events for each row of the table of events."""

    def run(spark, sf_dir):
        n = nexmark.PER_EVENT * table(spark, sf_dir, "events").count()
        return spark.sql(f"WITH {nexmark.EVENTS.format(n=n)}{text}")

    QUERIES[name] = run
    ORACLES[name] = f"WITH {nexmark.DUCK}{oracle or nexmark.duck(text)}"


auction("nexmark_q0", "SELECT auction, bidder, price, date_time, extra FROM bid")
auction("nexmark_q1", "SELECT auction, bidder, CAST(0.908 * price AS DECIMAL(23,3)) AS price, date_time, extra FROM bid")
auction("nexmark_q2", "SELECT auction, price FROM bid WHERE auction % 123 = 0")
auction("nexmark_q3", "SELECT p.name, p.city, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id WHERE a.category = 10 AND p.state IN ('OR', 'ID', 'CA')")
_Q4 = "SELECT category, {} AS price FROM (SELECT max(b.price) AS top, a.category FROM auction a JOIN bid b ON a.id = b.auction AND b.date_time BETWEEN a.date_time AND a.expires GROUP BY a.id, a.category) q GROUP BY category"
auction("nexmark_q4", _Q4.format("sum(top) DIV count(top)"), _Q4.format("(sum(top) // count(top))::BIGINT"))
auction(
    "nexmark_q5", ", s AS (SELECT auction, window.start AS slice, count(*) AS n FROM bid GROUP BY auction, window(date_time, '2 seconds')), c AS (SELECT auction, window_start, sum(n) AS num FROM (SELECT *, explode(sequence(slice - INTERVAL 8 SECOND, slice, INTERVAL 2 SECOND)) AS window_start FROM s) GROUP BY auction, window_start) SELECT auction, num, window_start FROM (SELECT *, max(num) OVER (PARTITION BY window_start) AS top FROM c) WHERE num >= top",
    ", c AS (SELECT auction, time_bucket(INTERVAL '2 seconds', date_time) - to_seconds(2 * k) AS window_start, count(*) AS num FROM bid, range(5) t(k) GROUP BY ALL) SELECT c.auction, c.num, c.window_start FROM c JOIN (SELECT window_start, max(num) AS top FROM c GROUP BY window_start) m ON c.window_start = m.window_start WHERE num >= top",
)
_Q7 = "SELECT b.auction, b.price, b.bidder, b.date_time FROM bid b JOIN ({}) m ON b.price = m.top AND b.date_time >= m.e - INTERVAL '10' SECOND AND b.date_time < m.e"
auction("nexmark_q7", "SELECT b.auction, b.price, b.bidder, b.date_time FROM (SELECT *, window(date_time, '10 seconds').end AS e FROM bid) b JOIN (SELECT max(price) AS top, window.end AS e FROM bid GROUP BY window(date_time, '10 seconds')) m ON b.e = m.e AND b.price = m.top", _Q7.format("SELECT max(price) AS top, time_bucket(INTERVAL '10 seconds', date_time) + INTERVAL '10 seconds' AS e FROM bid GROUP BY ALL"))
_Q8 = "SELECT p.id, p.name, p.w FROM (SELECT DISTINCT id, name, {w} AS w FROM person) p JOIN (SELECT DISTINCT seller, {w} AS w FROM auction) a ON p.id = a.seller AND p.w = a.w"
auction("nexmark_q8", _Q8.format(w="window(date_time, '10 seconds').start"), _Q8.format(w="time_bucket(INTERVAL '10 seconds', date_time)"))
auction("nexmark_q9", "SELECT id, bidder, price FROM (SELECT a.id, b.bidder, b.price, row_number() OVER (PARTITION BY a.id ORDER BY b.price DESC, b.date_time, b.bidder) AS r FROM auction a JOIN bid b ON a.id = b.auction AND b.date_time BETWEEN a.date_time AND a.expires) q WHERE r <= 1")
auction("nexmark_q10", "SELECT auction, bidder, price, date_format(date_time, 'yyyy-MM-dd') AS dt, date_format(date_time, 'HH:mm') AS hm FROM bid", "SELECT auction, bidder, price, strftime(date_time, '%Y-%m-%d') AS dt, strftime(date_time, '%H:%M') AS hm FROM bid")
auction(
    "nexmark_q11", "SELECT bidder, count(*) AS bids, session_window.start AS start_time, session_window.end AS end_time FROM bid GROUP BY bidder, session_window(date_time, '10 seconds')",
    "SELECT bidder, count(*) AS bids, min(date_time) AS start_time, max(date_time) + INTERVAL '10 seconds' AS end_time FROM (SELECT *, sum(new) OVER (PARTITION BY bidder ORDER BY date_time) AS s FROM (SELECT *, CASE WHEN date_time - lag(date_time) OVER (PARTITION BY bidder ORDER BY date_time) <= INTERVAL '10 seconds' THEN 0 ELSE 1 END AS new FROM bid)) GROUP BY bidder, s",
)
auction("nexmark_q12", "SELECT bidder, count(*) AS bids, window.start AS s FROM bid GROUP BY bidder, window(date_time, '10 seconds')", "SELECT bidder, count(*) AS bids, time_bucket(INTERVAL '10 seconds', date_time) AS s FROM bid GROUP BY ALL")
auction("nexmark_q13", "SELECT b.auction, b.bidder, b.price, d.v FROM bid b JOIN (SELECT * FROM (VALUES (0, 'apple'), (1, 'google'), (2, 'facebook'), (3, 'baidu'), (4, 'amazon')) AS t(k, v)) d ON b.auction % 5 = d.k")
auction("nexmark_q14", "SELECT auction, bidder, CAST(0.908 * price AS DECIMAL(23,3)) AS price, CASE WHEN hour(date_time) BETWEEN 8 AND 18 THEN 'dayTime' WHEN hour(date_time) <= 6 OR hour(date_time) >= 20 THEN 'nightTime' ELSE 'otherTime' END AS kind, CAST(length(extra) - length(replace(extra, 'c', '')) AS BIGINT) AS c_counts FROM bid WHERE 0.908 * price > 500")
_COUNTS = ", ".join(["count(*) AS total"] + [f"{what} FILTER (WHERE {c}) AS {n}{i}" for what, n in (("count(*)", "bids"), ("count(DISTINCT bidder)", "bidders"), ("count(DISTINCT auction)", "auctions")) for i, c in enumerate(("price < 200", "price BETWEEN 200 AND 700", "price > 700"))])
auction("nexmark_q15", f"SELECT date_format(date_time, 'yyyy-MM-dd') AS day, {_COUNTS} FROM bid GROUP BY date_format(date_time, 'yyyy-MM-dd')", f"SELECT strftime(date_time, '%Y-%m-%d') AS day, {_COUNTS} FROM bid GROUP BY 1")
auction("nexmark_q16", f"SELECT channel, date_format(date_time, 'yyyy-MM-dd') AS day, max(date_format(date_time, 'HH:mm')) AS m, {_COUNTS} FROM bid GROUP BY channel, date_format(date_time, 'yyyy-MM-dd')", f"SELECT channel, strftime(date_time, '%Y-%m-%d') AS day, max(strftime(date_time, '%H:%M')) AS m, {_COUNTS} FROM bid GROUP BY ALL")
_Q17 = "SELECT auction, {} AS day, count(*) AS n, count(*) FILTER (WHERE price < 200) AS low, min(price) AS lo, max(price) AS hi, {} AS mean, CAST(sum(price) AS BIGINT) AS total FROM bid GROUP BY auction, {}"
auction("nexmark_q17", _Q17.format("date_format(date_time, 'yyyy-MM-dd')", "sum(price) DIV count(price)", "date_format(date_time, 'yyyy-MM-dd')"), _Q17.format("strftime(date_time, '%Y-%m-%d')", "(sum(price) // count(price))::BIGINT", "strftime(date_time, '%Y-%m-%d')"))
auction("nexmark_q18", "SELECT auction, bidder, price, date_time FROM (SELECT *, row_number() OVER (PARTITION BY bidder, auction ORDER BY date_time DESC) AS r FROM bid) q WHERE r <= 1")
auction("nexmark_q19", "SELECT auction, bidder, price, CAST(r AS BIGINT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY price DESC, date_time) AS r FROM bid) q WHERE r <= 10")
auction("nexmark_q20", "SELECT b.auction, b.bidder, b.price, a.item_name, a.category FROM bid b JOIN auction a ON b.auction = a.id WHERE a.category = 10")
_Q21 = "SELECT auction, bidder, channel, CASE WHEN lower(channel) = 'channel-0' THEN '0' WHEN lower(channel) = 'channel-1' THEN '1' ELSE {} END AS channel_id FROM (SELECT *, CASE WHEN bidder % 3 = 0 THEN concat(url, '?channel_id=', bidder, '&x') ELSE url END AS u FROM bid) q WHERE lower(channel) IN ('channel-0', 'channel-1') OR {}"
auction("nexmark_q21", _Q21.format("regexp_extract(u, '(&|^|[?])channel_id=([^&]*)', 2)", "u RLIKE '(&|^|[?])channel_id=([^&]*)'"), _Q21.format("regexp_extract(u, '(&|^|[?])channel_id=([^&]*)', 2)", "regexp_matches(u, '(&|^|[?])channel_id=([^&]*)')"))
auction("nexmark_q22", "SELECT auction, bidder, price, " + ", ".join(f"get(split(url, '/', -1), {i}) AS dir{i}" for i in (2, 3, 4)) + " FROM bid", "SELECT auction, bidder, price, " + ", ".join(f"string_split(url, '/')[{i + 1}] AS dir{i}" for i in (2, 3, 4)) + " FROM bid")
auction("nexmark_q23", "SELECT b.auction, b.bidder, b.price, p.name, a.item_name FROM bid b JOIN person p ON b.bidder = p.id JOIN auction a ON b.auction = a.id")
