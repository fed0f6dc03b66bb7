"""MessagePack for JSON-like values, after the public specification."""

from __future__ import annotations

import struct
from typing import Any


def packb(value: Any) -> bytes:
    out = bytearray()
    _pack(value, out)
    return bytes(out)


def _sized(out: bytearray, n: int, small: int | None, limit: int, codes: tuple[int | None, int, int]) -> None:
    if small is not None and n < limit:
        out.append(small | n)
    elif codes[0] is not None and n < 1 << 8:
        out += struct.pack(">BB", codes[0], n)
    elif n < 1 << 16:
        out += struct.pack(">BH", codes[1], n)
    else:
        out += struct.pack(">BI", codes[2], n)


def _pack(v: Any, out: bytearray) -> None:
    if v is None:
        out.append(0xC0)
    elif v is True or v is False:
        out.append(0xC3 if v else 0xC2)
    elif isinstance(v, int):
        if 0 <= v < 128:
            out.append(v)
        elif -32 <= v < 0:
            out += struct.pack("b", v)
        elif v >= 0:
            out += next(struct.pack(f">B{f}", c, v) for f, c, m in (("B", 0xCC, 8), ("H", 0xCD, 16), ("I", 0xCE, 32), ("Q", 0xCF, 64)) if v < 1 << m)
        else:
            out += next(struct.pack(f">B{f}", c, v) for f, c, m in (("b", 0xD0, 7), ("h", 0xD1, 15), ("i", 0xD2, 31), ("q", 0xD3, 63)) if v >= -(1 << m))
    elif isinstance(v, float):
        out += struct.pack(">Bd", 0xCB, v)
    elif isinstance(v, str):
        data = v.encode()
        _sized(out, len(data), 0xA0, 32, (0xD9, 0xDA, 0xDB))
        out += data
    elif isinstance(v, bytes):
        _sized(out, len(v), None, 0, (0xC4, 0xC5, 0xC6))
        out += v
    elif isinstance(v, (list, tuple)):
        _sized(out, len(v), 0x90, 16, (None, 0xDC, 0xDD))
        for x in v:
            _pack(x, out)
    elif isinstance(v, dict):
        _sized(out, len(v), 0x80, 16, (None, 0xDE, 0xDF))
        for k, x in v.items():
            _pack(k, out)
            _pack(x, out)
    else:
        raise TypeError(f"no form for {type(v).__name__}")


def unpackb(data: bytes) -> Any:
    value, at = _unpack(memoryview(data), 0)
    if at != len(data):
        raise ValueError("bytes after the value")
    return value


_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_LENGTHS = {0xD9: (">B", str), 0xDA: (">H", str), 0xDB: (">I", str), 0xC4: (">B", bytes), 0xC5: (">H", bytes), 0xC6: (">I", bytes), 0xDC: (">H", list), 0xDD: (">I", list), 0xDE: (">H", dict), 0xDF: (">I", dict)}


def _unpack(data: memoryview, at: int) -> tuple[Any, int]:
    if at >= len(data):
        raise ValueError("the value is cut off")
    code = data[at]
    at += 1
    if code < 0x80:
        return code, at
    if code >= 0xE0:
        return code - 256, at
    if code in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[code], at
    if code in _NUMBERS:
        form = _NUMBERS[code]
        _enough(data, at, struct.calcsize(form))
        return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
    if code < 0x90:
        kind, n = dict, code & 15
    elif code < 0xA0:
        kind, n = list, code & 15
    elif code < 0xC0:
        kind, n = str, code & 31
    elif code in _LENGTHS:
        form, kind = _LENGTHS[code]
        _enough(data, at, struct.calcsize(form))
        n = struct.unpack_from(form, data, at)[0]
        at += struct.calcsize(form)
    else:
        raise ValueError(f"unknown code {code:#x}")
    if kind in (str, bytes):
        _enough(data, at, n)
        raw = bytes(data[at : at + n])
        return (raw.decode() if kind is str else raw), at + n
    if kind is list:
        items = []
        for _ in range(n):
            item, at = _unpack(data, at)
            items.append(item)
        return items, at
    pairs = {}
    for _ in range(n):
        k, at = _unpack(data, at)
        pairs[k], at = _unpack(data, at)
    return pairs, at


def _enough(data: memoryview, at: int, n: int) -> None:
    if at + n > len(data):
        raise ValueError("the value is cut off")
