"""Binary coding of numbers and texts: fixed-width integers, varints, length-prefixed bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Names of fixed-width integers and their numpy types.
INTEGERS = {f"int{8 * n}_{order}": f"{mark}i{n}" for n in (2, 4, 8) for order, mark in (("le", "<"), ("be", ">"))}


def encode_integers(values, kind: str) -> bytes:
    return np.asarray(list(values), dtype=INTEGERS[kind]).tobytes()


def decode_integers(data: bytes, kind: str) -> list[int]:
    width = np.dtype(INTEGERS[kind]).itemsize
    if len(data) % width:
        raise ValueError(f"{len(data)} bytes aren't whole {kind} numbers")
    return np.frombuffer(data, INTEGERS[kind]).tolist()


def encode_varint(value: int) -> bytes:
    """Groups of 7 bits, the lowest first; the high bit says that more follow."""
    if not 0 <= value < 1 << 64:
        raise ValueError("a varint is an unsigned 64-bit number")
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number, and where the next byte is."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise EOFError("a varint ends early")
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 0x80:
            return value, at


def delimited(messages) -> bytes:
    """Messages with their lengths as varints before them."""
    return b"".join(encode_varint(len(m)) + m for m in messages)


def undelimited(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        size, at = decode_varint(data, at)
        if at + size > len(data):
            raise EOFError("a message ends early")
        yield data[at : at + size]
        at += size
