"""Decoders of message bodies in a `value` column (string or binary), by declared schemas.

They work on any source with such a column: Kafka where its connector is there, files, or tables. Change envelopes come out as
rows with row_kind: +I, -U, +U or -D. With ignore_errors a field that can't be read is NULL and a body that can't be parsed gives no row; without, both
fail the query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions.scalar import saturate

#: How times are written, by the name of the standard.
TIMESTAMPS = {"SQL": r"^\d{4,}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,9})?Z?$", "ISO-8601": r"^\d{4,}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?Z?$"}
_INTEGERS = {T.ByteType: "tinyint", T.ShortType: "smallint", T.IntegerType: "int", T.LongType: "bigint"}


def _text(kind: T.DataType) -> T.DataType:
    """The type with all its scalars as strings, so that numbers in quotes are read too."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _text(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_text(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), _text(kind.valueType))
    return T.StringType()


def _typed(value: Column, kind: T.DataType, lenient: bool, times: str | None) -> Column:
    """A value of the textual type as its declared type."""
    again = lambda v, k: _typed(v, k, lenient, times)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(again(value[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: again(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(value, lambda k, _: again(k, kind.keyType)), lambda _, v: again(v, kind.valueType))
    if isinstance(kind, T.StringType):
        return value
    text = F.trim(value)
    if isinstance(kind, T.BooleanType):
        return F.lower(text) == "true"
    if isinstance(kind, T.BinaryType):
        return F.try_to_binary(text, F.lit("base64")) if lenient else F.to_binary(text, F.lit("base64"))
    if type(kind) in _INTEGERS:
        name = _INTEGERS[type(kind)]
        # Whole numbers are read exactly; a fraction is cut.
        part = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(kind) if lenient else text.cast(kind))
        return F.when(text.isNull() | text.rlike(r"^[+-]?\d+$"), part).otherwise(saturate(text.try_cast("double") if lenient else text.cast("double"), name))
    out = text.try_cast(kind) if lenient or isinstance(kind, T.DecimalType) else text.cast(kind)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType) and times:
        wrong = F.lit(None).cast(kind) if lenient else F.raise_error(F.concat(F.lit(f"not a time by {times}: "), text)).cast(kind)
        return F.when(text.isNull() | text.rlike(TIMESTAMPS[times]), out).otherwise(wrong)
    return out


def _fields(row: Column, schema: T.StructType, lenient: bool, times: str | None) -> list[Column]:
    return [_typed(row[f.name], f.dataType, lenient, times).alias(f.name) for f in schema]


_CORRUPT = "__corrupt"


def _parsed(df: DataFrame, body: T.StructType, value: str, lenient: bool) -> DataFrame:
    """(r): each body as a row of strings, parsed once. Of a key that comes twice the last value counts."""
    schema = T.StructType([*body, T.StructField(_CORRUPT, T.StringType())])
    text = F.col(value).cast("string")
    out = df.select(F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("r"), text.alias("text"))
    bad = F.col("r").isNull() | F.col(f"r.{_CORRUPT}").isNotNull()
    if lenient:
        return out.where(~bad).select("r")
    # A null body is no message.
    return out.where("text is not null").select(F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object: "), F.left("text", F.lit(200)))).cast(schema)).otherwise(F.col("r")).alias("r"))


def decode_json(df: DataFrame, schema: T.StructType, value: str = "value", ignore_errors: bool = True, times: str | None = None) -> DataFrame:
    """The fields of each JSON object; `times` is the standard of timestamps, SQL or ISO-8601, or None for either."""
    return _parsed(df, _text(schema), value, ignore_errors).select(*_fields(F.col("r"), schema, ignore_errors, times))


def decode_csv(df: DataFrame, schema: T.StructType, value: str = "value", ignore_errors: bool = True, times: str | None = None, **options: str) -> DataFrame:
    """The fields of each delimited line; numbers are trimmed, short lines are padded with NULL. Options are those of from_csv: sep, quote, escape, comment, nullValue.

    A line that begins with the comment character gives no row.
    """
    text = F.col(value).cast("string")
    row = F.from_csv(text, ", ".join(f"`{f.name}` string" for f in schema), {"mode": "PERMISSIVE", **options})
    if comment := options.get("comment"):
        df = df.where(~F.coalesce(text.startswith(comment), F.lit(False)))
    return df.select(row.alias("r")).select(*_fields(F.col("r"), schema, ignore_errors, times))


def decode_raw(df: DataFrame, name: str, value: str = "value", kind: str = "string", big_endian: bool = True) -> DataFrame:
    """The body as one column: a string, bytes, or a number of fixed width, which is NULL where the body has another length."""
    body = F.col(value).cast("binary")
    width = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}.get(kind)
    if width is None:
        return df.select(body.cast(kind).alias(name))
    digits = F.hex(body) if big_endian else F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.substring(F.hex(body), 2 * i + 1, F.lit(2)))), "")
    number = F.conv(digits, 16, 10).cast("decimal(20,0)")
    signed = number - F.when(number >= F.lit(str(1 << (8 * width - 1))).cast("decimal(20,0)"), F.lit(str(1 << (8 * width))).cast("decimal(20,0)")).otherwise(F.lit(0))
    return df.select(F.when(F.length(body) == width, signed.cast(kind)).alias(name))


def _kind(kind: str, row: Column) -> Column:
    return F.struct(F.lit(kind).alias("row_kind"), row.alias("row"))


def _emitted(e: DataFrame, op: Column, cases: dict[str, tuple[list[str], list[tuple[str, Column]], list[Column]]], skip: list[str], schema: T.StructType, lenient: bool, times: str | None) -> DataFrame:
    """Rows of envelopes: by the operation's names the kinds and images to emit, and what must not be null for that."""
    none = F.array().cast(f"array<struct<row_kind:string,row:{_text(schema).simpleString()}>>")

    def failed(what: Column) -> Column:
        return none if lenient else F.raise_error(what).cast(none_type)

    none_type = T.ArrayType(T.StructType([T.StructField("row_kind", T.StringType()), T.StructField("row", _text(schema))]))
    out = F.when(op.isin(skip), none) if skip else F.when(F.lit(False), none)
    for names, images, needed in cases.values():
        there = reduce(lambda a, b: a & b, (c.isNotNull() for c in needed))
        out = out.when(op.isin(names), F.when(there, F.array(*(_kind(k, row) for k, row in images)).cast(none_type)).otherwise(failed(F.concat(F.lit("an image is missing for "), op))))
    rows = out.otherwise(failed(F.concat(F.lit("unknown operation "), F.coalesce(op, F.lit("NULL")))))
    return e.select(F.explode(rows).alias("c")).select("c.row_kind", *_fields(F.col("c.row"), schema, lenient, times))


def _by_operation(df: DataFrame, schema: T.StructType, value: str, field: str, names: tuple[list[str], str, str], lenient: bool, times: str | None) -> DataFrame:
    body = T.StructType([T.StructField("before", _text(schema)), T.StructField("after", _text(schema)), T.StructField(field, T.StringType())])
    e = _parsed(df, body, value, lenient)
    op, before, after = F.col(f"r.{field}"), F.col("r.before"), F.col("r.after")
    create, update, delete = names
    cases = {"insert": (create, [("+I", after)], [after]), "update": ([update], [("-U", before), ("+U", after)], [before, after]), "delete": ([delete], [("-D", before)], [before])}
    return _emitted(e, op, cases, [], schema, lenient, times)


def decode_debezium(df: DataFrame, schema: T.StructType, value: str = "value", ignore_errors: bool = False, times: str | None = None) -> DataFrame:
    return _by_operation(df, schema, value, "op", (["c", "r"], "u", "d"), ignore_errors, times)


def decode_ogg(df: DataFrame, schema: T.StructType, value: str = "value", ignore_errors: bool = False, times: str | None = None) -> DataFrame:
    return _by_operation(df, schema, value, "op_type", (["I"], "U", "D"), ignore_errors, times)


def _older(old: Column, data: Column, schema: T.StructType) -> Column:
    """The row before an update: `old` holds the changed fields, explicit NULLs included; nested ones as JSON text."""
    def field(f: T.StructField) -> Column:
        kind = _text(f.dataType)
        was = old[f.name] if isinstance(kind, T.StringType) else F.from_json(old[f.name], kind)
        return F.when(F.map_contains_key(old, f.name), was).otherwise(data[f.name]).alias(f.name)

    return F.struct(*map(field, schema))


def _by_data(e: DataFrame, names: tuple[str, str, str], skip: list[str], schema: T.StructType, lenient: bool, times: str | None) -> DataFrame:
    """Rows of (op, data, old)."""
    op, data, old = F.col("op"), F.col("data"), F.col("old")
    insert, update, delete = names
    cases = {"insert": ([insert], [("+I", data)], [data]), "update": ([update], [("-U", _older(old, data, schema)), ("+U", data)], [data, old]), "delete": ([delete], [("-D", data)], [data])}
    return _emitted(e, op, cases, skip, schema, lenient, times)


_OLD = T.MapType(T.StringType(), T.StringType())


def decode_maxwell(df: DataFrame, schema: T.StructType, value: str = "value", ignore_errors: bool = False, times: str | None = None) -> DataFrame:
    body = T.StructType([T.StructField("data", _text(schema)), T.StructField("old", _OLD), T.StructField("type", T.StringType())])
    e = _parsed(df, body, value, ignore_errors).select(F.col("r.type").alias("op"), "r.data", "r.old")
    return _by_data(e, ("insert", "update", "delete"), [], schema, ignore_errors, times)


def decode_canal(df: DataFrame, schema: T.StructType, value: str = "value", ignore_errors: bool = False, times: str | None = None) -> DataFrame:
    """A message has arrays of rows, paired by place; CREATE gives none. An operation that isn't known counts even where there are no rows."""
    body = T.StructType([T.StructField("data", T.ArrayType(_text(schema))), T.StructField("old", T.ArrayType(_OLD)), T.StructField("type", T.StringType())])
    e = _parsed(df, body, value, ignore_errors)
    known = F.col("r.type").isin("INSERT", "UPDATE", "DELETE")
    # Rows are those of data; an `old` that is shorter leaves null ones.
    pairs = F.transform(F.col("r.data"), lambda d, i: F.struct(d.alias("data"), F.get(F.col("r.old"), i).alias("old")))
    pairs = F.when(known & F.col("r.data").isNotNull(), pairs).otherwise(F.array(F.struct(F.lit(None).cast(_text(schema)).alias("data"), F.lit(None).cast(_OLD).alias("old"))))
    e = e.select(F.col("r.type").alias("op"), F.explode(pairs).alias("x")).select("op", "x.data", "x.old")
    return _by_data(e, ("INSERT", "UPDATE", "DELETE"), ["CREATE"], schema, ignore_errors, times)
