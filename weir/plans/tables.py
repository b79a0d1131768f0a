"""Registered queries of the remaining operators over bounded tables, and of formats by their messages."""

from __future__ import annotations

import json
import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.operators import joins, ranking, windows
from weir.plans.registry import query, sql
from weir.sources import binary, formats, messages

# Windows -------------------------------------------------------------------------------------------------------------


@query("window_hop_slices", "SELECT window_start, window_start + INTERVAL '60 minutes' AS window_end, event_type, count(*) AS n, sum(event_id)::BIGINT AS total, min(event_id) AS lo, max(event_id) AS hi FROM (SELECT event_id, event_type, time_bucket(INTERVAL '15 minutes', ts) - to_minutes(15 * k) AS window_start FROM events, range(4) t(k)) GROUP BY ALL")
def _(spark, load):
    parts = {"n": (F.count("*"), "sum"), "total": (F.sum("event_id"), "sum"), "lo": (F.min("event_id"), "min"), "hi": (F.max("event_id"), "max")}
    return windows.hop_aggregate(load("events"), "ts", "60 MINUTES", "15 MINUTES", ["event_type"], parts)


@query("group_window_tumble", "SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, count(*) AS n FROM events GROUP BY ALL")
def _(spark, load):
    return windows.group_tumble(load("events"), "ts", "1 hour", ["user_id"], F.count("*").alias("n")).drop("window_time")


@query("group_window_hop", "SELECT event_type, window_start, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) - to_minutes(30 * k) AS window_start FROM events, range(2) t(k)) GROUP BY ALL")
def _(spark, load):
    return windows.group_hop(load("events"), "ts", "1 hour", "30 minutes", ["event_type"], F.count("*").alias("n")).drop("window_time", "window_end")


@query("group_window_session", "SELECT event_type, min(ts) AS window_start, max(ts) + INTERVAL '1 minute' AS window_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) <= INTERVAL '1 minute' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY event_type, s")
def _(spark, load):
    return windows.group_session(load("events"), "ts", "1 minute", ["event_type"], F.count("*").alias("n")).drop("window_time")


@query("window_proctime", "SELECT event_type, count(*) AS n, TRUE AS of_now FROM events GROUP BY event_type")
def _(spark, load):
    w = windows.tumble(windows.arrival(load("events")), "proctime", "1 day")
    return w.groupBy("event_type", "window_start", "window_end").agg(F.count("*").alias("n")).select("event_type", "n", (F.current_timestamp().between(F.col("window_start"), F.col("window_end"))).alias("of_now"))


# OVER ----------------------------------------------------------------------------------------------------------------

_W = "PARTITION BY user_id ORDER BY ts, event_id"
sql(
    "over_frames",
    f"SELECT event_id, count(*) OVER w AS n, max(CAST(value AS DECIMAL(12,2))) OVER w AS top, min(event_type) OVER w AS kind, round(sum(value) OVER w, 4) AS s, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS ahead, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back FROM events WINDOW w AS ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
    f"SELECT event_id, count(*) OVER w AS n, max(CAST(value AS DECIMAL(12,2))) OVER w AS top, min(event_type) OVER w AS kind, round(sum(value) OVER w, 4) AS s, (sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING))::BIGINT AS ahead, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back FROM events WINDOW w AS ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
)

# Rank, sort, dedup ---------------------------------------------------------------------------------------------------

for _name, _dense in (("rank", False), ("dense_rank", True)):

    @query(f"top_n_{_name}", f"SELECT o_custkey, o_orderkey, r AS rank_num FROM (SELECT o_custkey, o_orderkey, {_name}() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r <= 2")
    def _(spark, load, dense=_dense):
        return ranking.top_rank(load("orders"), ["o_custkey"], [F.desc("o_orderdate")], 2, dense).select("o_custkey", "o_orderkey", "rank_num")


@query("event_time_sort_places", "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS place FROM events")
def _(spark, load):
    return ranking.sorted_by_time(load("events"), "ts", "event_id", name="place").select("event_id", "ts", "place")


@query("dedup_arrival_first", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, load):
    return load("events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])


_KINDS = "CASE event_id % 4 WHEN 0 THEN '+I' WHEN 1 THEN '-U' WHEN 2 THEN '+U' ELSE '-D' END"


@query("drop_update_before", f"SELECT event_id, {_KINDS} AS row_kind FROM events WHERE event_id % 4 <> 1")
def _(spark, load):
    return ranking.drop_update_before(load("events").select("event_id", F.expr(_KINDS).alias("row_kind")))


# Joins ---------------------------------------------------------------------------------------------------------------

sql("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
sql("join_non_equi", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
for _n, _not in (("in", ""), ("not_in", "NOT ")):
    sql(f"join_{_n}", f"SELECT c_custkey FROM customer WHERE c_custkey {_not}IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")

_RATES = "(SELECT user_id, ts, event_id, value, CASE WHEN event_id % 5 = 0 THEN '-D' ELSE '+I' END AS kind FROM events WHERE event_type = 'purchase')"


@query("temporal_join_deletes", f"SELECT p.event_id, CASE WHEN v.kind <> '-D' AND v.value > 20 THEN v.event_id END AS version_event_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') p ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS r FROM {_RATES}) WHERE r = 1) v ON p.user_id = v.user_id AND p.ts >= v.ts")
def _(spark, load):
    e = load("events")
    v = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value", F.expr("CASE WHEN event_id % 5 = 0 THEN '-D' ELSE '+I' END").alias("kind"))
    v = ranking.keep_last(v, ["user_id", "ts"], "event_id")
    probe = e.where("event_type <> 'purchase'").select("user_id", "ts", "event_id")
    return joins.temporal_join(probe, v, "user_id", "ts", "ts", "left", "kind", F.col("version_value") > 20).select("event_id", "version_event_id")


@query("interval_join_residual", "SELECT a.event_id AS a, b.event_id AS b FROM (SELECT * FROM events WHERE event_type = 'click') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts BETWEEN b.ts AND b.ts + INTERVAL '3 hours' AND a.value < b.value")
def _(spark, load):
    side = lambda t, n: load("events").where(F.col("event_type") == t).select(F.col("event_id").alias(n), F.col("user_id").alias(f"k{n}"), F.col("ts").alias(f"t{n}"), F.col("value").alias(f"v{n}"))
    return joins.interval_join(side("click", "a"), side("purchase", "b"), [("ka", "kb")], ("ta", "tb"), "0 HOURS", "3 HOURS", "left", F.col("va") < F.col("vb")).select("a", "b")


@query("lookup_join_async", "SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'apple' WHEN 1 THEN 'google' WHEN 2 THEN 'facebook' END AS name FROM events")
def _(spark, load):
    names = {0: "apple", 1: "google", 2: "facebook"}
    probe = load("events").select("event_id", (F.col("user_id") % 5).alias("k"))
    fields = T.StructType([T.StructField("name", T.StringType())])
    return joins.lookup_join_async(probe, "k", lambda k: {"name": names[k]} if k in names else None, fields, "left", 8).select("event_id", "name")


@query("lateral_function", "SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]) AS v, unnest([0, 1])::INT AS i FROM orders")
def _(spark, load):
    rows = lambda c: F.array(F.struct(c.alias("a"), F.lit(0).alias("b")), F.struct((c + 1).alias("a"), F.lit(1).alias("b")))
    return joins.lateral(load("orders").select("o_orderkey", "o_custkey"), rows, "o_custkey", ["v", "i"]).select("o_orderkey", "v", "i")


# Formats and message logs --------------------------------------------------------------------------------------------

_ROW = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
_PLAIN = "SELECT event_id, event_type, value FROM events"


def _zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes((*out, n))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes((*out, n))


AVRO = json.dumps({"type": "record", "name": "event", "fields": [{"name": "event_id", "type": "long"}, {"name": "event_type", "type": ["null", "string"]}, {"name": "value", "type": "double"}]})


def _avro(event_id: int, event_type: str, value: float) -> bytes:
    text = event_type.encode()
    return _zigzag(event_id) + b"\x02" + _zigzag(len(text)) + text + struct.pack("<d", value)


def _protobuf(event_id: int, event_type: str, value: float) -> bytes:
    text = event_type.encode()
    return b"\x08" + _varint(event_id) + b"\x12" + _varint(len(text)) + text + b"\x19" + struct.pack("<d", value)


def _bodies(load, f):
    made = F.udf(f, "binary", useArrow=True)
    return load("events").select(made("event_id", "event_type", "value").alias("value"))


@query("format_avro", _PLAIN)
def _(spark, load):
    return binary.decode_avro(_bodies(load, _avro), _ROW, AVRO)


@query("format_avro_confluent", _PLAIN)
def _(spark, load):
    return binary.decode_avro_confluent(_bodies(load, lambda *v: b"\0\0\0\0\x07" + _avro(*v)), _ROW, {7: AVRO})


@query("format_protobuf", _PLAIN)
def _(spark, load):
    return binary.decode_protobuf(_bodies(load, _protobuf), _ROW, [("event_id", 1, "int64"), ("event_type", 2, "string"), ("value", 3, "double")])


@query("format_json_nested", "SELECT event_id, event_type AS kind, user_id AS n, [user_id::INT, 7] AS list, value > 50 AS flag, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS bad FROM events WHERE event_id % 10 <> 9")
def _(spark, load):
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("o", T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("n", T.LongType())])), T.StructField("list", T.ArrayType(T.IntegerType())), T.StructField("flag", T.BooleanType()), T.StructField("bad", T.LongType())])
    good = "concat('{\"event_id\": 1, \"event_id\": \" ', event_id, ' \", \"o\": {\"kind\": \"', event_type, '\", \"n\": \"', user_id, '\"}, \"list\": [\"', user_id, '\", 7.9], \"flag\": \"', if(value > 50, 'TRUE', 'no'), '\", \"bad\": ', if(event_id % 3 = 0, '\"x\"', string(event_id)), '}')"
    body = load("events").select(F.expr(f"if(event_id % 10 = 9, '{{\"event_id\": ', {good})").alias("value"))
    return formats.decode_json(body, schema).select("event_id", "o.kind", "o.n", "list", "flag", "bad")


_LOG = "(SELECT event_id, (event_id % 3)::INT AS part, (row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) - 1)::BIGINT AS off, ts, event_type FROM events)"


def _log(load):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.col("event_id") % 3).orderBy("event_id")) - 1
    return load("events").select(F.lit("events").alias("topic"), (F.col("event_id") % 3).cast("int").alias("partition"), place.cast("bigint").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit(None).cast("binary").alias("key"), F.col("event_type").cast("binary").alias("value"), "event_id")


@query("log_offsets", f"SELECT event_id FROM {_LOG} WHERE NOT (part = 1 AND off < 100) AND NOT (part = 2 AND off < 5)")
def _(spark, load):
    return messages.Log(topics=("events",), start="offsets", offsets={"events": {1: 100, 2: 5}}, end="latest").select(_log(load)).select("event_id")


@query("log_timestamp", f"SELECT l.event_id FROM {_LOG} l JOIN (SELECT part, min(off) AS first FROM {_LOG} WHERE ts >= (SELECT min(ts) + INTERVAL '5 days' FROM events) GROUP BY part) f ON l.part = f.part AND off >= first")
def _(spark, load):
    start = load("events").agg(F.unix_millis((F.min("ts") + F.expr("INTERVAL 5 DAYS")).cast("timestamp"))).first()[0]
    return messages.Log(pattern="ev.*", start="timestamp", start_millis=start, end="latest").select(_log(load)).select("event_id")


@query("log_group", f"SELECT event_id FROM {_LOG} WHERE NOT (part = 0 AND off < 50)")
def _(spark, load):
    return messages.Log(topics=("events",), committed={"events": {0: 50}}).select(_log(load)).select("event_id")
