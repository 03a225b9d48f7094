"""BSON of plain trees: documents, arrays, doubles, strings, booleans, null, 32- and 64-bit integers."""

from __future__ import annotations

import struct
from typing import Any


def _element(name: str, v: Any) -> bytes:
    key = name.encode() + b"\0"
    if v is None:
        return b"\x0a" + key
    if isinstance(v, bool):
        return b"\x08" + key + bytes([v])
    if isinstance(v, int):
        if -(1 << 31) <= v < 1 << 31:
            return b"\x10" + key + struct.pack("<i", v)
        return b"\x12" + key + struct.pack("<q", v)
    if isinstance(v, float):
        return b"\x01" + key + struct.pack("<d", v)
    if isinstance(v, str):
        raw = v.encode() + b"\0"
        return b"\x02" + key + struct.pack("<i", len(raw)) + raw
    if isinstance(v, dict):
        return b"\x03" + key + encode(v)
    if isinstance(v, (list, tuple)):
        return b"\x04" + key + encode({str(i): x for i, x in enumerate(v)}, ordered=False)
    raise TypeError(f"{type(v).__name__} has no BSON")


def encode(document: dict[str, Any], ordered: bool = True) -> bytes:
    """Keys in alphabetical order; elements of arrays in theirs."""
    keys = sorted(document) if ordered else list(document)
    body = b"".join(_element(k, document[k]) for k in keys)
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def _read(data: bytes, at: int) -> tuple[dict[str, Any], int]:
    (size,) = struct.unpack_from("<i", data, at)
    end, at = at + size - 1, at + 4
    out: dict[str, Any] = {}
    while at < end:
        kind = data[at]
        stop = data.index(0, at + 1)
        key, at = data[at + 1 : stop].decode(), stop + 1
        if kind == 0x0A:
            out[key] = None
        elif kind == 0x08:
            out[key], at = bool(data[at]), at + 1
        elif kind == 0x10:
            out[key], at = struct.unpack_from("<i", data, at)[0], at + 4
        elif kind == 0x12:
            out[key], at = struct.unpack_from("<q", data, at)[0], at + 8
        elif kind == 0x01:
            out[key], at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 0x02:
            (n,) = struct.unpack_from("<i", data, at)
            out[key], at = data[at + 4 : at + 3 + n].decode(), at + 4 + n
        elif kind in (0x03, 0x04):
            inner, at = _read(data, at)
            out[key] = list(inner.values()) if kind == 0x04 else inner
        else:
            raise ValueError(f"BSON type {kind} isn't supported")
    return out, end + 1


def decode(data: bytes) -> dict[str, Any]:
    return _read(data, 0)[0]
