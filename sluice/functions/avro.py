"""Avro's binary form of values, as a stream of bare data and as container files, by a schema in JSON."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

from sluice.functions.coding import decode_varint, encode_varint

# The mark at the start of container files, and the names of their metadata.
MAGIC, SCHEMA_KEY, CODEC_KEY = b"Obj\x01", "avro.schema", "avro.codec"
_FLOATS = {"float": "<f", "double": "<d"}
_META = {"type": "map", "values": "bytes"}


def _long(n: int) -> bytes:
    """A signed number, small ones of either sign in few bytes."""
    return encode_varint(n << 1 if n >= 0 else (-n << 1) - 1)


def _kind(schema) -> str:
    return "union" if isinstance(schema, list) else schema if isinstance(schema, str) else schema["type"]


def _branch(schemas: list, value) -> int:
    """The union's branch of a value: null for None, else the first that isn't null and takes the value's type."""
    fits = {"boolean": bool, "int": int, "long": int, "float": (int, float), "double": (int, float), "string": str, "bytes": (bytes, bytearray), "array": (list, tuple), "map": dict, "record": (dict, tuple)}
    for i, s in enumerate(schemas):
        if _kind(s) == "null" and value is None or _kind(s) != "null" and value is not None and isinstance(value, fits.get(_kind(s), object)):
            return i
    raise ValueError(f"no branch of {schemas} takes {value!r}")


def encode(schema, value) -> bytes:
    """The bytes of one value. Records are dicts, or tuples in the order of the fields."""
    kind = _kind(schema)
    if kind == "union":
        i = _branch(schema, value)
        return _long(i) + encode(schema[i], value)
    if kind == "null":
        return b""
    if kind == "boolean":
        return b"\x01" if value else b"\x00"
    if kind in ("int", "long"):
        return _long(value)
    if kind in _FLOATS:
        return struct.pack(_FLOATS[kind], value)
    if kind in ("string", "bytes"):
        data = value.encode() if kind == "string" else bytes(value)
        return _long(len(data)) + data
    if kind == "enum":
        return _long(schema["symbols"].index(value))
    if kind == "record":
        values = [value[f["name"]] for f in schema["fields"]] if isinstance(value, dict) else value
        return b"".join(encode(f["type"], v) for f, v in zip(schema["fields"], values, strict=True))
    if kind == "array":
        return (_long(len(value)) + b"".join(encode(schema["items"], v) for v in value) if value else b"") + b"\x00"
    if kind == "map":
        return (_long(len(value)) + b"".join(encode("string", k) + encode(schema["values"], v) for k, v in value.items()) if value else b"") + b"\x00"
    raise ValueError(f"no form for {kind}")


def _read_long(data: bytes, at: int) -> tuple[int, int]:
    n, at = decode_varint(data, at)
    return (n >> 1) ^ -(n & 1), at


def _take(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if n < 0 or at + n > len(data):
        raise EOFError("a value ends early")
    return data[at : at + n], at + n


def _items(data: bytes, at: int, read) -> tuple[list, int]:
    """The items of an array or map, which come in blocks; a negative count has the block's size behind it."""
    out: list = []
    while True:
        n, at = _read_long(data, at)
        if not n:
            return out, at
        if n < 0:
            n, (_, at) = -n, _read_long(data, at)
        for _ in range(n):
            item, at = read(at)
            out.append(item)


def decode(schema, data: bytes, at: int = 0) -> tuple[object, int]:
    """One value, records as tuples, and where the next one is."""
    kind = _kind(schema)
    if kind == "union":
        i, at = _read_long(data, at)
        return decode(schema[i], data, at)
    if kind == "null":
        return None, at
    if kind == "boolean":
        byte, at = _take(data, at, 1)
        return byte != b"\x00", at
    if kind in ("int", "long"):
        return _read_long(data, at)
    if kind in _FLOATS:
        part, at = _take(data, at, struct.calcsize(_FLOATS[kind]))
        return struct.unpack(_FLOATS[kind], part)[0], at
    if kind in ("string", "bytes"):
        n, at = _read_long(data, at)
        part, at = _take(data, at, n)
        return (part.decode() if kind == "string" else part), at
    if kind == "enum":
        i, at = _read_long(data, at)
        return schema["symbols"][i], at
    if kind == "record":
        values = []
        for f in schema["fields"]:
            v, at = decode(f["type"], data, at)
            values.append(v)
        return tuple(values), at
    if kind == "array":
        return _items(data, at, lambda i: decode(schema["items"], data, i))
    if kind == "map":

        def pair(i: int) -> tuple[tuple, int]:
            key, i = decode("string", data, i)
            value, i = decode(schema["values"], data, i)
            return (key, value), i

        pairs, at = _items(data, at, pair)
        return dict(pairs), at
    raise ValueError(f"no form for {kind}")


def encode_stream(schema, values: Iterable) -> bytes:
    """Bare data one after the other, without a header."""
    return b"".join(encode(schema, v) for v in values)


def decode_stream(schema, data: bytes) -> Iterator:
    at = 0
    while at < len(data):
        value, at = decode(schema, data, at)
        yield value


def encode_container(schema, values: Iterable, codec: str = "deflate", block: int = 4_000) -> bytes:
    """A container file: header with the schema, then blocks of `block` values; codec: null or deflate."""
    mark, values = os.urandom(16), list(values)
    out = [MAGIC, encode(_META, {SCHEMA_KEY: json.dumps(schema).encode(), CODEC_KEY: codec.encode()}), mark]
    for i in range(0, len(values), block):
        data = encode_stream(schema, values[i : i + block])
        if codec == "deflate":
            press = zlib.compressobj(wbits=-15)
            data = press.compress(data) + press.flush()
        out += [_long(len(values[i : i + block])), _long(len(data)), data, mark]
    return b"".join(out)


def decode_container(data: bytes) -> Iterator:
    """Values of a container file by the schema in it."""
    if data[:4] != MAGIC:
        raise ValueError("not a container file")
    meta, at = decode(_META, data, 4)
    schema, codec = json.loads(meta[SCHEMA_KEY]), meta.get(CODEC_KEY, b"null").decode()
    if codec not in ("null", "deflate"):
        raise ValueError(f"no codec {codec}")
    mark, at = _take(data, at, 16)
    while at < len(data):
        n, at = _read_long(data, at)
        size, at = _read_long(data, at)
        part, at = _take(data, at, size)
        part = zlib.decompress(part, -15) if codec == "deflate" else part
        where = 0
        for _ in range(n):
            value, where = decode(schema, part, where)
            yield value
        end, at = _take(data, at, 16)
        if end != mark:
            raise ValueError("a block's end mark is wrong")
