"""Flat tables from deeply nested capture records.

Method: structural-variant tables. A bottom-up tree automaton classifies every
element by its shape: the state of an element is its place in the record together
with the set of its fields and the type of each (a scalar's own type, of a list or an
object that it is one). The states are numbered by their rule and so are the same on
every executor and in every batch. Each state is a variant with a table of its own,
whose columns are the typed fields of the shape; all variants share the supertype
keys (record, node, parent, kind, variant). A payload is parsed once: its elements
are emitted in one pass by an iterative walk, so depth is not limited, and are routed to
their tables by the variant, which is the partition of the written table. Fields that
no variant knows by a typed column are kept as JSON in ``more``.

Defined results
- a payload that is null or no JSON gives no rows; one that is an object
  without ``torrents`` gives none either;
- a null element makes no row but keeps its position; a lone value in the place
  of a list counts as a list of one; a string that holds JSON counts as the
  value it holds, a string that does not stays what it is;
- of a field that occurs twice in an object the last counts;
- numbers may be strings; what is not a whole number in the bigint range gives null
  (whatever its length), and stays as it was in ``more``.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.session import cut_lineage

# -- the automaton: what stands in a list, and the fields a shape is told by, each
# with the column that holds its value if it has the right type
SORTS = {
    "torrent": {"name": "name", "info_hash": "info_hash", "total_size": "size", "timestamp": "ts", "piece_length": "piece_length", "files": None, "peers": None},
    "node": {"dir": "name", "path": "name", "size": "size", "children": None},
    "peer": {"ip": "ip", "port": "port", "have": None},
    "have": {"piece_from": "piece_from", "piece_to": "piece_to"},
}
#: (sort, list field) -> letter and sort of the elements in it
CHILD_LISTS = {
    "torrent": (("files", "f", "node"), ("peers", "p", "peer")),
    "node": (("children", "f", "node"),),
    "peer": (("have", "h", "have"),),
    "have": (),
}
_TYPES = {"name": str, "info_hash": str, "ip": str}  # the other columns are whole numbers
COLUMNS = {"name": "string", "info_hash": "string", "size": "long", "ts": "long", "piece_length": "long", "ip": "string", "port": "int", "piece_from": "long", "piece_to": "long"}
KEYS = {"raw_id": "long", "node": "string", "parent": "string", "kind": "string", "variant": "string"}
ELEMENT_SCHEMA = ", ".join(f"{n} {t}" for n, t in {**KEYS, **COLUMNS, "more": "string"}.items())
_FIELDS = [f.split()[0] for f in ELEMENT_SCHEMA.split(", ")]
_ARROW = pa.schema([
    (n, {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[t])
    for n, t in (f.split() for f in ELEMENT_SCHEMA.split(", "))
])
_MISSING = object()


def _refuse(token: str) -> None:
    raise ValueError(token)


def _number(digits: str) -> int | Decimal:
    return int(digits) if len(digits) < 40 else Decimal(digits)  # no bigint, but a number


#: What can be JSON: most strings are told apart by their beginning, without an error being raised.
_MAYBE_JSON = re.compile(r"[ \t\n\r]*(?:[\[{\"]|-?[0-9][0-9.eE+-]*[ \t\n\r]*$|true|false|null)")


def _parse(text: str) -> object:
    """The JSON value of a text; _MISSING if it holds none."""
    if not _MAYBE_JSON.match(text):
        return _MISSING
    try:
        return json.loads(text, parse_constant=_refuse, parse_int=_number)
    except RecursionError:
        return _deep_parse(text)
    except ValueError:
        return _MISSING


def _deep_parse(text: str) -> object:
    """For texts nested too deeply for the recursive parser: the same grammar,
    read with a stack. Scalars and strings are left to the json module."""
    decoder = json.JSONDecoder(parse_constant=_refuse, parse_int=_number)
    blank = " \t\n\r"
    stack: list[tuple[object, str | None]] = []
    at, end, done, want_value = 0, len(text), _MISSING, True

    def skip(i: int) -> int:
        while i < end and text[i] in blank:
            i += 1
        return i

    def key(i: int) -> tuple[str, int]:
        i = skip(i)
        if i >= end or text[i] != '"':
            raise ValueError("key")
        name, i = decoder.raw_decode(text, i)
        i = skip(i)
        if i >= end or text[i] != ":":
            raise ValueError("colon")
        return name, i + 1

    try:
        while True:
            at = skip(at)
            if want_value:
                if at >= end:
                    return _MISSING
                ch = text[at]
                if ch in "[{":
                    box: object = [] if ch == "[" else {}
                    at = skip(at + 1)
                    if at < end and text[at] == ("]" if ch == "[" else "}"):
                        at, done, want_value = at + 1, box, False
                    elif ch == "[":
                        stack.append((box, None))
                    else:
                        name, at = key(at)
                        stack.append((box, name))
                else:
                    done, at = decoder.raw_decode(text, at)
                    want_value = False
                continue
            if not stack:
                return done if at >= end else _MISSING
            box, name = stack.pop()
            if isinstance(box, list):
                box.append(done)
            else:
                box[name] = done
            if at >= end:
                return _MISSING
            if text[at] == ",":
                if isinstance(box, list):
                    stack.append((box, None))
                    at += 1
                else:
                    name, at = key(at + 1)
                    stack.append((box, name))
                want_value = True
            elif text[at] == ("]" if isinstance(box, list) else "}"):
                at, done = at + 1, box
            else:
                return _MISSING
    except (ValueError, IndexError):
        return _MISSING


def _held(value: object) -> object:
    """The value that a JSON text in a string holds, else the value itself."""
    seen = value
    while isinstance(seen, str):
        inner = _parse(seen)
        if inner is _MISSING:
            return seen
        seen = inner
    return seen


def _listed(value: object) -> list:
    value = _held(value)
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def _whole(value: object) -> int | None:
    value = _held(value)
    if isinstance(value, bool) or not isinstance(value, int):
        return None
    return value if -(1 << 63) <= value < 1 << 63 else None


def _text(value: object) -> str | None:
    if isinstance(value, list):
        return "/".join(x for x in value if isinstance(x, str))
    return value if isinstance(value, str) else None


def _dump(value: object) -> str:
    """JSON text of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False, default=str)
    except RecursionError:
        out, todo = [], [(value, "")]
        while todo:
            v, after = todo.pop()
            if isinstance(v, (list, dict)) and v:
                pairs = [(json.dumps(k, ensure_ascii=False) + ": ", x) for k, x in v.items()] if isinstance(v, dict) else [("", x) for x in v]
                out.append("{" if isinstance(v, dict) else "[")
                todo.append((_Text("}" if isinstance(v, dict) else "]"), after))
                for n, (name, x) in enumerate(reversed(pairs)):
                    todo += [(x, ", " if n else ""), (_Text(name), "")]
            else:
                out.append(v.text if isinstance(v, _Text) else json.dumps(v, ensure_ascii=False, default=str))
                out.append(after)
        return "".join(out)


class _Text:
    def __init__(self, text: str):
        self.text = text


@functools.lru_cache(65536)
def state(sort: str, shape: tuple[tuple[str, bool], ...] | str) -> tuple[str, str]:
    """The automaton's transition: (kind, variant) of an element of a sort. The shape of an
    object is its known fields, each with whether the value has the right type; that of another
    value is what it is."""
    fields = shape if isinstance(shape, tuple) else ()
    kind = ("dir" if any(f == "dir" for f, _ in fields) else "file") if sort == "node" else sort
    if isinstance(shape, str):
        return kind, f"{kind}_{shape}"
    return kind, f"{kind}_object" + "".join(f"_{f}" if typed else f"_odd_{f}" for f, typed in fields)


def _socket(text: str) -> tuple[str | None, int | None]:
    ip, _, port = text.rpartition(":")
    return (ip.strip("[]"), int(port)) if port.isdigit() and len(port) < 6 and ip else (None, None)


def _root(payload: str | None) -> dict | None:
    root = None if payload is None else _held(payload)
    return root if isinstance(root, dict) else None


def _columns(sort: str, item: object) -> tuple[tuple | str, dict, object]:
    """(shape, columns, what no column holds) of an element."""
    if not isinstance(item, dict):
        if not isinstance(item, str):
            return "scalar", {}, item
        if sort == "peer":
            ip, port = _socket(item)
            return "text", {"ip": ip, "port": port}, item if ip is None else None
        return "text", {"name": item} if sort == "node" else {}, None if sort == "node" else item
    shape, values, rest = [], {}, {}
    for field, v in item.items():
        if field not in SORTS[sort]:
            rest[field] = v
    for field, column in SORTS[sort].items():
        if field not in item:
            continue
        if column is None:
            shape.append((field, True))
            continue
        v = _text(item[field]) if column in _TYPES else _whole(item[field])
        if column == "port" and v is not None and not 0 <= v < 65536:
            v = None
        shape.append((field, v is not None))
        if v is None and item[field] is not None or column in values or isinstance(item[field], list):
            rest[field] = item[field]
        values.setdefault(column, v)
    return tuple(shape), values, rest or None


def _walk(root: dict) -> Iterator[tuple]:
    todo = [("t", "torrent", "", "", root.get("torrents"))]
    while todo:
        letter, sort, parent, prefix, value = todo.pop()
        for at, item in enumerate(_listed(value)):
            item = _held(item)
            if item is None:
                continue
            node = f"{prefix}{letter}{at}"
            shape, values, rest = _columns(sort, item)
            kind, variant = state(sort, shape)
            yield node, parent, kind, variant, *map(values.get, COLUMNS), None if rest is None else _dump(rest)
            if isinstance(item, dict):
                for field, child, child_sort in CHILD_LISTS[sort]:
                    if field in item:
                        todo.append((child, child_sort, node, node + ".", item[field]))


def elements_of(payload: str | None) -> Iterator[tuple]:
    """The rows of one payload, without its record key."""
    root = _root(payload)
    if root is not None:
        yield from _walk(root)


def flatten(raw: DataFrame) -> DataFrame:
    """All elements of all payloads with the columns of ELEMENT_SCHEMA, and of each payload that is an
    object a row of kind ``record`` with its own fields. Rows with a null raw_id keep it; a record that
    is repeated gives its rows again."""

    def rows(payload: str | None) -> Iterator[tuple]:
        root = _root(payload)
        if root is not None:
            rest = {k: v for k, v in root.items() if k != "torrents"}
            yield "", None, "record", "record_object", *[None] * len(COLUMNS), _dump(rest) if rest else None
            yield from _walk(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in _FIELDS]
        for batch in batches:
            for raw_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in rows(payload):
                    cols[0].append(raw_id)
                    for c, v in zip(cols[1:], row):
                        c.append(v.encode("utf-8", "replace").decode() if isinstance(v, str) else v)
                    if len(cols[0]) >= 8192:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(cols, _ARROW)], schema=_ARROW)
                        cols = [[] for _ in _FIELDS]
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(cols, _ARROW)], schema=_ARROW)

    return raw.select(F.col("raw_id").cast("long"), F.col("payload").cast("string")).mapInArrow(run, ELEMENT_SCHEMA)


def _columns_of(variant: str) -> list[str]:
    """The typed columns of a variant's table."""
    kind, _, shape = variant.partition("_")
    sort = "node" if kind in ("dir", "file") else kind
    if shape == "text":
        return {"peer": ["ip", "port"], "node": ["name"]}.get(sort, [])
    return list(dict.fromkeys(c for f, c in SORTS.get(sort, {}).items() if c and f"{shape}_".find(f"_{f}_") >= 0 and f"{shape}_".find(f"_odd_{f}_") < 0))


def subtype_tables(elements: DataFrame) -> dict[str, DataFrame]:
    """A table per variant, of the supertype keys, the typed columns of its shape and ``more``.
    The elements are made once and routed by variant to folders of the shared folder; there
    are as many variants as the automaton has states that occur."""
    routed = cut_lineage(elements, "variant")
    found = sorted(r[0] for r in routed.select("variant").distinct().collect())
    return {v: routed.where(F.col("variant") == v).select(*KEYS, *_columns_of(v), "more") for v in found}


def supertype_tables(subtypes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """torrents, dirs, files, peers, ranges and records: the union of the variants of each kind,
    with the columns of the kind; what a variant lacks is null."""
    plural = {"torrent": "torrents", "dir": "dirs", "file": "files", "peer": "peers", "have": "ranges", "record": "records"}
    out: dict[str, DataFrame] = {}
    for variant, df in subtypes.items():
        name = plural[variant.partition("_")[0]]
        out[name] = df if name not in out else out[name].unionByName(df, allowMissingColumns=True)
    return out
