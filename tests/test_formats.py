"""Message decoders on single bodies: what is lenient, what fails, and what each envelope gives."""

import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from weir.sources import binary, formats, messages

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())])


def bodies(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string" if all(isinstance(v, str | None) for v in values) else "value binary")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_json_coercion(spark):
    got = formats.decode_json(bodies(spark, '{"id": " 7 ", "name": 5, "score": "1.5"}', '{"id": 1, "id": 2, "score": 3}', '{"id": 7.9, "name": {"a": 1}}', '{"id": "x", "score": null}', "{", None, '{"other": 1}'), ROW)
    assert rows(got) == [(7, "5", 1.5), (2, None, 3.0), (7, '{"a":1}', None), (None, None, None), (None, None, None)]


def test_json_nested_fields_that_must_not_be_null(spark):
    schema = T.StructType([T.StructField("r", T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.ArrayType(T.IntegerType(), False), False)]), False), T.StructField("m", T.MapType(T.StringType(), T.LongType(), False))])
    got = formats.decode_json(bodies(spark, '{"r": {"a": "3", "b": ["1", 2.9]}, "m": {"x": "4"}}', '{"r": null}'), schema).collect()
    assert (got[0].r.a, got[0].r.b, got[0].m) == (3, [1, 2], {"x": 4})
    assert got[1].r is None


@pytest.mark.parametrize("body", ["{", '{"id": "x"}', "[1]x"])
def test_json_strict(spark, body):
    with pytest.raises(PySparkException):
        formats.decode_json(bodies(spark, body), ROW, ignore_errors=False).collect()


def test_json_numbers_at_the_ends(spark):
    schema = T.StructType([T.StructField("t", T.ByteType()), T.StructField("l", T.LongType()), T.StructField("d", T.DecimalType(5, 2)), T.StructField("b", T.BooleanType())])
    got = formats.decode_json(bodies(spark, '{"t": 127, "l": 9223372036854775807, "d": "2.675", "b": "True"}', '{"t": 128, "l": 9223372036854775808, "d": 123456, "b": "maybe"}'), schema)
    assert [[str(v) for v in r] for r in rows(got)] == [["127", "9223372036854775807", "2.68", "True"], ["None", "None", "None", "False"]]


def test_json_time_standards(spark):
    schema = T.StructType([T.StructField("t", T.TimestampNTZType())])
    both = ('{"t": "2024-01-02 03:04:05.678"}', '{"t": "2024-01-02T03:04:05"}')
    for times, want in (("SQL", [True, False]), ("ISO-8601", [False, True]), (None, [True, True])):
        assert [r[0] is not None for r in rows(formats.decode_json(bodies(spark, *both), schema, times=times))] == want
    with pytest.raises(PySparkException):
        formats.decode_json(bodies(spark, both[1]), schema, ignore_errors=False, times="SQL").collect()


def test_csv_options(spark):
    got = formats.decode_csv(bodies(spark, "1;'a;b'; 2.5 ", "#no row", "2;NIL", "x;y;z"), ROW, sep=";", quote="'", comment="#", nullValue="NIL")
    assert rows(got) == [(1, "a;b", 2.5), (2, None, None), (None, "y", None)]
    with pytest.raises(PySparkException):
        formats.decode_csv(bodies(spark, "x;y;z"), ROW, ignore_errors=False, sep=";").collect()


def test_raw(spark):
    df = bodies(spark, b"\xff\xff\xff\xfe", b"\x00\x00\x01\x00", b"\x01")
    assert rows(formats.decode_raw(df, "n", kind="int")) == [(-2,), (256,), (None,)]
    assert rows(formats.decode_raw(df, "n", kind="int", big_endian=False)) == [(-16777217,), (65536,), (None,)]


A, B = '{"id": 1, "name": "a", "score": 1.5}', '{"id": 1, "name": "b", "score": 2}'


def test_debezium(spark):
    got = formats.decode_debezium(bodies(spark, f'{{"before": null, "after": {A}, "op": "r"}}', f'{{"before": {A}, "after": {B}, "op": "u"}}', f'{{"before": {B}, "after": null, "op": "d"}}'), ROW)
    assert rows(got) == [("+I", 1, "a", 1.5), ("-U", 1, "a", 1.5), ("+U", 1, "b", 2.0), ("-D", 1, "b", 2.0)]


BROKEN = {
    formats.decode_debezium: ['{"op": "x"}', f'{{"after": {A}, "op": "u"}}', '{"op": "d"}', f'{{"after": {A}}}', "{"],
    formats.decode_ogg: ['{"op_type": "T"}', f'{{"after": {A}, "op_type": "U"}}'],
    formats.decode_maxwell: [f'{{"data": {A}, "type": "bootstrap-start"}}', f'{{"data": {A}, "type": "update"}}'],
    formats.decode_canal: [f'{{"data": [{A}], "type": "ALTER"}}', f'{{"data": [{A}, {B}], "old": [{{"name": "z"}}], "type": "UPDATE"}}', '{"type": "ALTER"}'],
}


@pytest.mark.parametrize("decode,body", [(f, b) for f, bs in BROKEN.items() for b in bs])
def test_changes_that_fail(spark, decode, body):
    with pytest.raises(PySparkException):
        decode(bodies(spark, body), ROW).collect()
    left = rows(decode(bodies(spark, body), ROW, ignore_errors=True))
    # Of a message of several rows those that are whole come out.
    assert left == ([("-U", 1, "z", 1.5), ("+U", 1, "a", 1.5)] if "old" in body else [])


def test_maxwell_old_fields(spark):
    got = formats.decode_maxwell(bodies(spark, f'{{"data": {B}, "old": {{"name": null}}, "type": "update"}}', f'{{"data": {B}, "old": {{"score": 9}}, "type": "update"}}', f'{{"data": {A}, "type": "insert"}}', f'{{"data": {A}, "type": "delete"}}'), ROW)
    assert rows(got) == [("-U", 1, None, 2.0), ("+U", 1, "b", 2.0), ("-U", 1, "b", 9.0), ("+U", 1, "b", 2.0), ("+I", 1, "a", 1.5), ("-D", 1, "a", 1.5)]


def test_canal_arrays(spark):
    got = formats.decode_canal(bodies(spark, f'{{"data": [{A}, {B}], "old": null, "type": "INSERT"}}', f'{{"data": [{A}, {B}], "old": [{{"name": "x"}}, {{"score": 0}}], "type": "UPDATE"}}', '{"data": null, "type": "CREATE"}'), ROW)
    assert rows(got) == [("+I", 1, "a", 1.5), ("+I", 1, "b", 2.0), ("-U", 1, "x", 1.5), ("+U", 1, "a", 1.5), ("-U", 1, "b", 0.0), ("+U", 1, "b", 2.0)]


def test_avro_of_all_kinds(spark):
    writer = '{"type": "record", "name": "r", "fields": [{"name": "id", "type": ["null", "long"]}, {"name": "nums", "type": {"type": "array", "items": "int"}}, {"name": "tags", "type": {"type": "map", "values": "string"}}, {"name": "skipped", "type": "bytes"}, {"name": "next", "type": ["null", "r"]}, {"name": "day", "type": {"type": "int", "logicalType": "date"}}]}'
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("nums", T.ArrayType(T.IntegerType())), T.StructField("tags", T.MapType(T.StringType(), T.StringType())), T.StructField("day", T.DateType())])
    body = b"\x02\x0d" + b"\x04\x02\x03\x00" + b"\x02\x02k\x02v\x00" + b"\x04xy" + b"\x00" + b"\x02"
    (got,) = binary.decode_avro(bodies(spark, body), schema, writer).collect()
    assert (got.id, got.nums, got.tags, str(got.day)) == (-7, [1, -2], {"k": "v"}, "1970-01-02")
    with pytest.raises(PySparkException):
        binary.decode_avro(bodies(spark, body[:5]), schema, writer).collect()
    assert binary.decode_avro(bodies(spark, body[:5]), schema, writer, ignore_errors=True).count() == 0


def test_protobuf_of_all_kinds(spark):
    fields = [("id", 1, "int64"), ("nums", 2, ("repeated", "sint64")), ("tags", 3, ("map", "string", "int64")), ("nested", 4, [("id", 1, "int64"), ("name", 2, "string"), ("score", 3, "double")]), ("flag", 5, "bool"), ("f", 6, "float")]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("nums", T.ArrayType(T.LongType())), T.StructField("tags", T.MapType(T.StringType(), T.LongType())), T.StructField("nested", ROW), T.StructField("flag", T.BooleanType()), T.StructField("f", T.FloatType())])
    body = b"\x08" + b"\xff" * 9 + b"\x01" + b"\x12\x02\x01\x04" + b"\x1a\x05\x0a\x01k\x10\x09" + b"\x22\x04\x08\x05\x12\x00" + b"\x28\x01" + b"\x35" + struct.pack("<f", 1.5) + b"\x7a\x01z"
    got = binary.decode_protobuf(bodies(spark, body, b""), schema, fields).collect()
    assert (got[0].id, got[0].nums, got[0].tags, tuple(got[0].nested), got[0].flag, got[0].f) == (-1, [-1, 2], {"k": 9}, (5, "", 0.0), True, 1.5)
    assert (got[1].id, got[1].nums, got[1].nested, got[1].flag) == (0, [], None, False)


def test_log_options():
    log = messages.Log(topics=("a", "b"), start="offsets", offsets={"a": {0: 5}}, end="latest")
    assert log.kafka_options("h:9092") == {"kafka.bootstrap.servers": "h:9092", "subscribe": "a,b", "startingOffsets": '{"a": {"0": 5}}', "endingOffsets": "latest"}
    assert messages.Log(pattern="x.*", start="timestamp", start_millis=7).kafka_options("h")["startingTimestamp"] == "7"
    assert messages.Log(topics=("a",), reset="latest").kafka_options("h")["startingOffsets"] == "latest"
    with pytest.raises(ValueError):
        messages.Log(topics=("a",), pattern="b")


def test_log_as_a_stream(spark, tmp_path):
    log = [("t", 0, i, None, None, str(i).encode()) for i in range(6)] + [("u", 0, 0, None, None, b"no")]
    spark.createDataFrame(log, "topic string, partition int, offset long, timestamp timestamp, key binary, value binary").write.parquet(str(tmp_path / "log"))
    got = []
    stream = messages.stream_table(spark, str(tmp_path / "log"), messages.Log(topics=("t",), start="offsets", offsets={"t": {0: 4}}))
    stream.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(bytes(r.value) for r in got) == [b"4", b"5"]
