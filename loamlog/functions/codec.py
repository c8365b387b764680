"""Canonical CBOR: one encoding for each value.

Values: None, bool, int (64 bits), bytes, str, list, dict with any of these as keys. Floats have no encoding.
Columns are encoded by built-in functions (encode_as); decoding bytes of any shape is Python, run by Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, ByteType, DataType, IntegerType, LongType, MapType, ShortType, StringType, StructType,
)

#: Limits of what is decoded.
MAX_BYTES, MAX_ITEMS, MAX_DEPTH = 256 << 20, 16 << 20, 128


class CodecError(ValueError):
    """Bytes that aren't a canonical encoding, or a value that has none."""


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for extra, (form, limit) in enumerate(((">B", 1 << 8), (">H", 1 << 16), (">I", 1 << 32), (">Q", 1 << 64))):
        if n < limit:
            return bytes([major << 5 | 24 + extra]) + struct.pack(form, n)
    raise CodecError("integer out of range")


def encode(value) -> bytes:
    match value:
        case None:
            return b"\xf6"
        case bool():
            return b"\xf5" if value else b"\xf4"
        case int():
            if not -(1 << 63) <= value < 1 << 63:
                raise CodecError("integer out of range")
            return _head(0, value) if value >= 0 else _head(1, -1 - value)
        case bytes() | bytearray():
            return _head(2, len(value)) + bytes(value)
        case str():
            raw = value.encode()
            return _head(3, len(raw)) + raw
        case list() | tuple():
            return _head(4, len(value)) + b"".join(map(encode, value))
        case dict():
            pairs = sorted(((encode(k), encode(v)) for k, v in value.items()), key=lambda p: (len(p[0]), p[0]))
            return _head(5, len(pairs)) + b"".join(k + v for k, v in pairs)
    raise CodecError(f"no encoding of {type(value).__name__}")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n > MAX_BYTES or self.at + n > len(self.data):
            raise CodecError("too long, or cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def argument(self, info: int) -> int:
        if info < 24:
            return info
        if info > 27:
            raise CodecError("indefinite length or reserved")
        n = int.from_bytes(self.take(1 << (info - 24)), "big")
        if n < (24 if info == 24 else 1 << (8 << (info - 25))):
            raise CodecError("not the shortest form")
        return n

    def value(self, depth: int = 0):
        if depth > MAX_DEPTH:
            raise CodecError("nested too deep")
        first = self.take(1)[0]
        major, info = first >> 5, first & 31
        if major == 7:
            if first in (0xF4, 0xF5):
                return first == 0xF5
            if first in (0xF6, 0xF7):  # undefined reads as null
                return None
            raise CodecError("float or unknown simple value")
        n = self.argument(info)
        if major in (0, 1):
            if n >= 1 << 63:
                raise CodecError("integer out of range")
            return n if major == 0 else -1 - n
        if major == 2:
            return self.take(n)
        if major == 3:
            try:
                return self.take(n).decode()
            except UnicodeDecodeError as e:
                raise CodecError("text isn't UTF-8") from e
        if major == 6:
            raise CodecError("tags have no meaning here")
        if n > MAX_ITEMS:
            raise CodecError("too many items")
        if major == 4:
            return [self.value(depth + 1) for _ in range(n)]
        out, last = {}, None
        for _ in range(n):
            start = self.at
            key = self.value(depth + 1)
            raw = self.data[start : self.at]
            if last is not None and (len(raw), raw) <= (len(last), last):
                raise CodecError("keys out of order, or twice")
            last = raw
            if isinstance(key, list | dict):
                raise CodecError("a list or map as a key")
            out[key] = self.value(depth + 1)
        return out


def decode(data: bytes):
    """The first value of data; what follows it isn't read."""
    return _Reader(bytes(data)).value()


def canonical_key(value) -> tuple[int, int, bytes]:
    """Orders values as canonical encodings do: by kind, then length, then bytes."""
    raw = encode(value)
    return raw[0] >> 5, len(raw), raw


def encoded_length(c: Column) -> Column:
    """Bytes that an integer takes."""
    n = F.when(c < 0, -1 - c).otherwise(c)
    return F.when(n < 24, 1).when(n < 1 << 8, 2).when(n < 1 << 16, 3).when(n < 1 << 32, 5).otherwise(9)


def _byte(n: int) -> Column:
    return F.unhex(F.lit(f"{n:02x}"))


def _head_of(major: int, n: Column) -> Column:
    """The head of a value: its kind and a number from 0 up, in the shortest form."""
    form = lambda info, digits: F.concat(F.lit(f"{major << 5 | info:02x}"), F.lpad(F.hex(n), digits, "0"))
    return F.unhex(
        F.when(n < 24, F.lpad(F.hex(n + (major << 5)), 2, "0")).when(n < 1 << 8, form(24, 2)).when(n < 1 << 16, form(25, 4))
        .when(n < 1 << 32, form(26, 8)).otherwise(form(27, 16))
    )


def encode_integers(c: Column) -> Column:
    """By built-in functions alone; null as null."""
    c = c.cast("long")
    return F.when(c.isNull(), _byte(0xF6)).when(c < 0, _head_of(1, -1 - c)).otherwise(_head_of(0, c))


def encode_texts(c: Column) -> Column:
    raw = c.cast("binary")
    return F.when(c.isNull(), _byte(0xF6)).otherwise(F.concat(_head_of(3, F.octet_length(raw).cast("long")), raw))


def _joined(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(bytearray()), lambda a, x: F.concat(a, x))


def encode_as(c: Column, kind: DataType) -> Column:
    """A column of a type as canonical CBOR, by built-in functions alone: structs and maps as maps, null as null.

    A struct's keys are in order of their encodings; a map's are sorted by row. Floats and times have no encoding.
    """
    null = _byte(0xF6)
    match kind:
        case BooleanType():
            made = F.when(c, _byte(0xF5)).otherwise(_byte(0xF4))
        case ByteType() | ShortType() | IntegerType() | LongType():
            return encode_integers(c)
        case StringType():
            return encode_texts(c)
        case BinaryType():
            made = F.concat(_head_of(2, F.octet_length(c).cast("long")), c)
        case ArrayType():
            each = F.transform(c, lambda x: encode_as(x, kind.elementType))
            made = F.concat(_head_of(4, F.size(c).cast("long")), _joined(each))
        case MapType():
            pair = lambda e: F.struct(encode_as(e["key"], kind.keyType).alias("k"), encode_as(e["value"], kind.valueType).alias("v"))
            sized = F.transform(F.map_entries(c), lambda e: F.struct(F.octet_length(pair(e)["k"]).alias("n"), pair(e).alias("p")))
            each = F.transform(F.array_sort(sized), lambda x: F.concat(x["p"]["k"], x["p"]["v"]))
            made = F.concat(_head_of(5, F.size(c).cast("long")), _joined(each))
        case StructType():
            fields = sorted(kind.fields, key=lambda f: canonical_key(f.name))
            keys = [F.lit(bytearray(encode(f.name))) for f in fields]
            values = [encode_as(c.getField(f.name), f.dataType) for f in fields]
            made = F.concat(F.lit(bytearray(_head(5, len(fields)))), *[x for kv in zip(keys, values, strict=True) for x in kv])
        case _:
            raise CodecError(f"no encoding of {kind.simpleString()}")
    return F.when(c.isNull(), null).otherwise(made)


@F.pandas_udf(StringType())
def decode_to_json(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Decoded values as JSON text, bytes as hex; null where a payload isn't canonical."""
    import json

    def one(data) -> str | None:
        try:
            return None if data is None else json.dumps(_plain(decode(data)), ensure_ascii=False, separators=(",", ":"))
        except CodecError:
            return None

    for part in parts:
        yield part.map(one)


def _plain(v):
    if isinstance(v, bytes):
        return v.hex()
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k if isinstance(k, str) else str(_plain(k)): _plain(x) for k, x in v.items()}
    return v
