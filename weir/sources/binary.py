"""Avro and Protobuf bodies, decoded from a binary `value` column in Arrow batches.

No connector jar is needed. An Avro schema is its JSON; a registry is a mapping from the ids of Confluent's framing to such schemas. A Protobuf message is
described by its fields: name, number and type.
"""

from __future__ import annotations

import decimal
import json
import struct
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class _Bytes:
    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("the body ends too early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.take(1)[0]
            out |= (b & 127) << shift
            if b < 128:
                return out
            if (shift := shift + 7) > 63:
                raise ValueError("a number of more than ten bytes")

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def number(self, kind: str) -> float:
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]


_EPOCH = datetime(1970, 1, 1)
_LOGICAL: dict[str, Callable] = {
    "date": lambda v: date(1970, 1, 1) + timedelta(days=v), "timestamp-millis": lambda v: (_EPOCH + timedelta(milliseconds=v)).replace(tzinfo=timezone.utc),
    "timestamp-micros": lambda v: (_EPOCH + timedelta(microseconds=v)).replace(tzinfo=timezone.utc), "local-timestamp-millis": lambda v: _EPOCH + timedelta(milliseconds=v), "local-timestamp-micros": lambda v: _EPOCH + timedelta(microseconds=v),
}


def _blocks(b: _Bytes, one: Callable[[], None]) -> None:
    while n := b.zigzag():
        if n < 0:
            b.zigzag()  # the block's bytes
        for _ in range(abs(n)):
            one()


def avro_reader(schema: str | dict | list, names: dict | None = None) -> Callable[[_Bytes], object]:
    """A function that reads one value of the schema."""
    names = {} if names is None else names
    if isinstance(schema, list):
        branches = [avro_reader(s, names) for s in schema]

        def union(b: _Bytes):
            k = b.zigzag()
            if not 0 <= k < len(branches):
                raise ValueError(f"no branch {k}")
            return branches[k](b)

        return union
    if isinstance(schema, str):
        if schema in names:
            return lambda b: names[schema](b)
        schema = {"type": schema}
    kind = schema["type"]
    if isinstance(kind, dict | list):
        return avro_reader(kind, names)
    simple = {
        "null": lambda b: None, "boolean": lambda b: b.take(1) != b"\0", "int": _Bytes.zigzag, "long": _Bytes.zigzag, "float": lambda b: b.number("<f"), "double": lambda b: b.number("<d"),
        "bytes": lambda b: b.take(b.zigzag()), "string": lambda b: b.take(b.zigzag()).decode(), "fixed": lambda b: b.take(schema["size"]), "enum": lambda b: schema["symbols"][b.zigzag()],
    }
    if kind in simple:
        read, logical = simple[kind], schema.get("logicalType")
        if logical == "decimal":
            scale = schema.get("scale", 0)
            own = lambda b: decimal.Decimal(int.from_bytes(read(b), "big", signed=True)).scaleb(-scale, decimal.Context(prec=40))
        else:
            own = (lambda b: _LOGICAL[logical](read(b))) if logical in _LOGICAL else read
        if "name" in schema:
            names[schema["name"]] = own
        return own
    if kind == "array":
        item = avro_reader(schema["items"], names)

        def array(b: _Bytes) -> list:
            out: list = []
            _blocks(b, lambda: out.append(item(b)))
            return out

        return array
    if kind == "map":
        value = avro_reader(schema["values"], names)

        def mapping(b: _Bytes) -> dict:
            out: dict = {}

            def one() -> None:
                key = b.take(b.zigzag()).decode()
                out[key] = value(b)

            _blocks(b, one)
            return out

        return mapping
    if kind == "record":
        fields: list = []
        names[schema["name"]] = lambda b: {n: f(b) for n, f in fields}
        fields += [(f["name"], avro_reader(f["type"], names)) for f in schema["fields"]]
        return names[schema["name"]]
    if kind in names:
        return names[kind]
    raise ValueError(f"unknown type {kind}")


#: Protobuf: how a scalar is read of its wire form, 0 varint, 1 eight bytes, 5 four bytes, 2 a length and bytes.
def _signed(n: int, bits: int) -> int:
    n &= (1 << bits) - 1
    return n - (1 << bits) if n >> (bits - 1) else n


_VARINT = {"int32": lambda n: _signed(n, 32), "int64": lambda n: _signed(n, 64), "uint32": lambda n: n & 0xFFFFFFFF, "uint64": lambda n: n, "bool": bool, "sint32": lambda n: (n >> 1) ^ -(n & 1), "sint64": lambda n: (n >> 1) ^ -(n & 1), "enum": lambda n: _signed(n, 32)}
_FIXED = {"fixed32": "<I", "sfixed32": "<i", "float": "<f", "fixed64": "<Q", "sfixed64": "<q", "double": "<d"}
_ZERO = {"string": "", "bytes": b"", "bool": False, "float": 0.0, "double": 0.0}


def protobuf_reader(fields: list[tuple]) -> Callable[[bytes], dict]:
    """A function that reads a message. A field is (name, number, type): a scalar's name, a list of fields for a message, ("repeated", type) or ("map", key, value).

    Absent scalars have their zero, absent messages are None, unknown numbers are left out, the last of several values counts.
    """
    by_number = {number: (name, kind) for name, number, kind in fields}
    entry = {number: protobuf_reader([("key", 1, kind[1]), ("value", 2, kind[2])]) for _, number, kind in fields if isinstance(kind, tuple) and kind[0] == "map"}
    nested = {number: protobuf_reader(kind[1] if isinstance(kind, tuple) else kind) for _, number, kind in fields if isinstance(kind, list) or isinstance(kind, tuple) and isinstance(kind[1], list) and kind[0] == "repeated"}

    def scalar(b: _Bytes, wire: int, kind: str):
        if wire == 0:
            return _VARINT[kind](b.varint())
        if wire in (1, 5):
            return b.number(_FIXED[kind])
        raw = b.take(b.varint())
        return raw.decode() if kind == "string" else raw

    def read(raw: bytes) -> dict:
        b, out = _Bytes(raw), {}
        for name, kind in by_number.values():
            out[name] = {} if isinstance(kind, tuple) and kind[0] == "map" else [] if isinstance(kind, tuple) else None if isinstance(kind, list) else _ZERO.get(kind, 0)
        while b.at < len(raw):
            tag = b.varint()
            number, wire = tag >> 3, tag & 7
            if number not in by_number:
                if wire not in (0, 1, 2, 5):
                    raise ValueError(f"wire form {wire}")
                b.varint() if wire == 0 else b.take(8 if wire == 1 else 4 if wire == 5 else b.varint())
                continue
            name, kind = by_number[number]
            if number in entry:
                got = entry[number](b.take(b.varint()))
                out[name][got["key"]] = got["value"]
            elif number in nested:
                got = nested[number](b.take(b.varint()))
                out[name].append(got) if isinstance(kind, tuple) else out.update({name: got})
            elif isinstance(kind, tuple):
                if wire == 2 and kind[1] not in ("string", "bytes"):  # packed
                    part = _Bytes(b.take(b.varint()))
                    while part.at < len(part.raw):
                        out[name].append(scalar(part, 0 if kind[1] in _VARINT else 1, kind[1]))
                else:
                    out[name].append(scalar(b, wire, kind[1]))
            else:
                out[name] = scalar(b, wire, kind)
        return out

    return read


def _decoded(df: DataFrame, schema: T.StructType, value: str, read: Callable[[bytes], dict], ignore_errors: bool) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(0).to_pylist():
                if raw is None:
                    continue
                try:
                    rows.append(read(raw))
                except (ValueError, IndexError, KeyError, struct.error):
                    if not ignore_errors:
                        raise
            yield pa.RecordBatch.from_arrays([pa.array([_plain(r.get(f.name), f.type) for r in rows], f.type) for f in arrow], schema=arrow)

    return df.select(df[value].cast("binary").alias("value")).mapInArrow(run, schema)


def _plain(v, kind: pa.DataType):
    """Maps as pairs, where the column is a map."""
    if v is None:
        return None
    if pa.types.is_map(kind):
        return [(k, _plain(x, kind.item_type)) for k, x in v.items()]
    if pa.types.is_struct(kind):
        return {f.name: _plain(v.get(f.name), f.type) for f in kind}
    if pa.types.is_list(kind):
        return [_plain(x, kind.value_type) for x in v]
    return v


def decode_avro(df: DataFrame, schema: T.StructType, writer: str, value: str = "value", ignore_errors: bool = False) -> DataFrame:
    """The declared fields of bare Avro records; `writer` is the schema that they were written by."""
    read = avro_reader(json.loads(writer))
    return _decoded(df, schema, value, lambda raw: read(_Bytes(raw)), ignore_errors)


def decode_avro_confluent(df: DataFrame, schema: T.StructType, registry: dict[int, str], value: str = "value", ignore_errors: bool = False) -> DataFrame:
    """As decode_avro, of bodies that begin with a zero byte and the four bytes of their schema's id."""
    readers = {k: avro_reader(json.loads(v)) for k, v in registry.items()}

    def read(raw: bytes) -> dict:
        if raw[:1] != b"\0" or len(raw) < 5:
            raise ValueError("no frame")
        return readers[int.from_bytes(raw[1:5], "big")](_Bytes(raw, 5))

    return _decoded(df, schema, value, read, ignore_errors)


def decode_protobuf(df: DataFrame, schema: T.StructType, fields: list[tuple], value: str = "value", ignore_errors: bool = False) -> DataFrame:
    """The declared fields of messages; see protobuf_reader for `fields`."""
    return _decoded(df, schema, value, protobuf_reader(fields), ignore_errors)
