"""Bencode: dictionaries, lists, integers and byte strings, read and written
without recursion, and the columns made of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from driftnet.schemas import INFO, MESSAGE


def encode(value: object) -> bytes:
    """Bytes of a value; dictionary keys are written in byte order."""
    out: list[bytes] = []
    todo: list[object] = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Raw):
            out.append(v.data)
        elif isinstance(v, bool):
            raise TypeError("bencode has no booleans")
        elif isinstance(v, int):
            out.append(b"i%de" % v)
        elif isinstance(v, (bytes, bytearray, str)):
            b = v.encode() if isinstance(v, str) else bytes(v)
            out.append(b"%d:" % len(b) + b)
        elif isinstance(v, (list, tuple)):
            out.append(b"l")
            todo.append(_Raw(b"e"))
            todo.extend(reversed(v))
        elif isinstance(v, dict):
            out.append(b"d")
            todo.append(_Raw(b"e"))
            items = sorted((k.encode() if isinstance(k, str) else bytes(k), x) for k, x in v.items())
            for k, x in reversed(items):
                todo += [x, k]
        else:
            raise TypeError(type(v).__name__)
    return b"".join(out)


class _Raw:
    def __init__(self, data: bytes):
        self.data = data


def decode(data: bytes) -> object:
    """The value of a whole byte string; ValueError if it is not exactly one."""
    at, stack, result = 0, [], None
    while True:
        if at >= len(data):
            raise ValueError("end")
        ch = data[at : at + 1]
        if ch in (b"d", b"l"):
            stack.append(({} if ch == b"d" else [], []))
            at += 1
            continue
        if ch == b"e":
            if not stack:
                raise ValueError("end mark")
            box, key = stack.pop()
            if key:
                raise ValueError("key without value")
            result, at = box, at + 1
        elif ch == b"i":
            end = data.index(b"e", at)
            digits = data[at + 1 : end]
            if not digits.lstrip(b"-").isdigit() or digits.count(b"-") > 1:
                raise ValueError("integer")
            result, at = int(digits), end + 1
        elif ch.isdigit():
            colon = data.index(b":", at)
            if not data[at:colon].isdigit():
                raise ValueError("length")
            n = int(data[at:colon])
            if colon + 1 + n > len(data):
                raise ValueError("short")
            result, at = data[colon + 1 : colon + 1 + n], colon + 1 + n
        else:
            raise ValueError("type")
        if not stack:
            if at != len(data):
                raise ValueError("trailing bytes")
            return result
        box, key = stack[-1]
        if isinstance(box, list):
            box.append(result)
        elif key:
            box[key.pop()] = result
        elif isinstance(result, bytes):
            key.append(result)
        else:
            raise ValueError("key")


def _bytes(d: dict, key: bytes) -> bytes | None:
    v = d.get(key)
    if v is not None and not isinstance(v, bytes):
        raise ValueError(key)
    return v


def _number(d: dict, key: bytes, most: int) -> int | None:
    v = d.get(key)
    if v is not None and not (isinstance(v, int) and 0 <= v <= most):
        raise ValueError(key)
    return v


def read_message(data: bytes | None) -> dict | None:
    """A wire message, or None if it does not decode: unknown keys are ignored,
    t and y are required, a number out of range spoils the whole message."""
    try:
        d = decode(bytes(data))
        t, y = _bytes(d, b"t"), _bytes(d, b"y")
        if t is None or y is None:
            return None
        q, a, r = _bytes(d, b"q"), d.get(b"a"), d.get(b"r")
        out = {"t": t, "y": y.decode(), "q": None if q is None else q.decode(), "a": None, "r": None}
        if a is not None:
            out["a"] = {k: _bytes(a, k.encode()) for k in ("id", "target", "info_hash", "token")}
            out["a"] |= {"port": _number(a, b"port", 65535), "implied_port": _number(a, b"implied_port", 255)}
        if r is not None:
            out["r"] = {k: _bytes(r, k.encode()) for k in ("id", "nodes", "nodes6")}
        return out
    except (ValueError, TypeError, AttributeError, UnicodeDecodeError):
        return None


def _utf8(data: object) -> str | None:
    try:
        return data.decode() if isinstance(data, bytes) else None
    except UnicodeDecodeError:
        return None


def read_info(data: bytes | None) -> dict | None:
    """An info dictionary with its defaults, or None: a missing name is
    'Unknown', as is one that is not UTF-8, a missing piece length 0; a files list wins over a single length,
    even if empty; entries without a length are skipped, negative ones spoil the
    record; path parts that are no text are skipped."""
    try:
        d = decode(bytes(data))
        name = _utf8(d.get(b"name"))
        name = "Unknown" if name is None else name
        files = d.get(b"files")
        if isinstance(files, list):
            out = []
            for f in files:
                if isinstance(f, dict) and isinstance(f.get(b"length"), int):
                    parts = f.get(b"path") if isinstance(f.get(b"path"), list) else []
                    out.append({"path": "/".join(t for p in parts if (t := _utf8(p)) is not None), "size": f[b"length"]})
        else:
            n = d.get(b"length")
            out = [{"path": name, "size": n}] if isinstance(n, int) else []
        if any(f["size"] < 0 for f in out):
            return None
        piece = d.get(b"piece length")
        total = sum(f["size"] for f in out)
        if total <= 0 or total >= 1 << 63:
            return None
        return {"name": name, "piece_length": piece if isinstance(piece, int) else 0, "total_size": total, "files": out}
    except (ValueError, TypeError, AttributeError, UnicodeDecodeError):
        return None


def _parsed(read, schema: str, data: Column | str) -> Column:
    kind = T.StructType.fromDDL(f"ok boolean, value struct<{schema}>")
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def parse(s: pa.Array) -> pa.Array:
        got = [read(x) if x is not None else None for x in s.to_pylist()]
        value = pa.array(got, arrow.field("value").type)
        return pa.StructArray.from_arrays([pa.array([g is not None for g in got], pa.bool_()), value], fields=list(arrow))

    return parse(data)


def decode_message(data: Column | str) -> Column:
    """struct<ok, value<message>>; ok is false and value null for what does not decode."""
    return _parsed(read_message, MESSAGE, data)


def decode_info(data: Column | str) -> Column:
    """struct<ok, value<name, piece_length, total_size, files>>."""
    return _parsed(read_info, INFO, data)
