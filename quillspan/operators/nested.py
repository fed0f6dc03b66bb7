"""Deeply nested semi-structured records as related flat tables.

A record is read in one direction into (path, ordinals, value) triples; paths are grouped by their repeated ancestor,
and each group is pivoted into the rows of one table. The reader goes down the lists that are tables and holds one
member of one object at a time, never the record: a first reading finds out whether the record is whole and readable,
a second one emits. A record is one row of the input, so its triples are grouped and pivoted where it is read.
Redelivered records are dropped before that by key and payload, so objects are never compared with each other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A repeated ancestor of each table: the list's path from the parent's object; "**" is any depth below a member.
TABLES = {
    "set": (None, ()),
    "sheet": ("set", ("sheets",)),
    "view": ("sheet", ("views",)),
    "entity": ("view", ("entities",)),
    "connection": ("view", ("connections",)),
    "port": ("entity", ("attributes", "**", "ports")),
    "text_span": ("entity", ("text_spans",)),
    "issue": ("set", ("metadata", "**", "issues")),
}
_CHILDREN = {t: [(c, path) for c, (p, path) in TABLES.items() if p == t] for t in TABLES}
_SLOT = {"sheet": 0, "view": 1, "entity": 2, "connection": 2, "port": 3, "text_span": 3, "issue": 2}
#: Members that are tables of their own only; those of other tables are also members of their parents.
_OWN = {"sheets", "views", "entities", "connections"}
_FLAT = "set_key bigint, node_kind string, sheet_ord int, view_ord int, item_ord int, sub_ord int, fields map<string,string>, record string, list_ord int"
_HELD = 16_000_000  # characters of rows that are handed on at once
_PARENT = {t: p for t, (p, _) in TABLES.items()}
#: Of each table the members that are tables of their own, and those searched for lists at any depth.
_LISTS = {t: {path[0]: c for c, path in below if path[0] in _OWN} for t, below in _CHILDREN.items()}
_SEARCHED = {t: {path[0]: (c, path[-1] if len(path) > 1 else None) for c, path in below if path[0] not in _OWN} for t, below in _CHILDREN.items()}

_blank = re.compile(r"[ \t\n\r]*").match
_number = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?").match
_spaced = re.compile(r'("(?:[^"\\]|\\.)*")|[ \t\n\r]+', re.S)
_after = re.compile(r"[ \t\n\r]*([,\]}])[ \t\n\r]*").match
_name = re.compile(r'"([^"\\\x00-\x1f]*)"[ \t\n\r]*:[ \t\n\r]*').match
_gap = re.compile(r"[ \t\n\r]").search
_scan = json.JSONDecoder().scan_once
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def _deep(text: str, at: int) -> tuple[Any, int]:
    """One value of any depth and its end; the library's own reader gives up some thousands of levels down."""
    found: list = []
    stack: list[tuple[Any, str | None]] = []
    while True:
        here = text[at : at + 1]
        if here == '"':
            value, at = scanstring(text, at + 1)
        elif here in ("{", "["):
            value, at, key = ({} if here == "{" else []), _blank(text, at + 1).end(), None
            if text[at : at + 1] != ("}" if here == "{" else "]"):
                if here == "{":
                    key, at = _key(text, at)
                stack.append((value, key))
                continue
            at += 1
        elif (word := next((w for w in _WORDS if text.startswith(w, at)), None)) is not None:
            value, at = _WORDS[word], at + len(word)
        elif m := _number(text, at):
            value, at = json.loads(m[0]), m.end()
        else:
            raise ValueError(f"no value at {at}")
        while stack:
            holder, key = stack.pop()
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            at = _blank(text, at).end()
            here = text[at : at + 1]
            if here == ",":
                at, key = _blank(text, at + 1).end(), None
                if isinstance(holder, dict):
                    key, at = _key(text, at)
                stack.append((holder, key))
                break
            if here != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"no end at {at}")
            value, at = holder, at + 1
        else:
            found.append(value)
            return found[0], at


def _key(text: str, at: int) -> tuple[str, int]:
    """A member's name and where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    key, at = scanstring(text, at + 1)
    at = _blank(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return key, _blank(text, at + 1).end()


def _value(text: str, at: int) -> tuple[Any, int]:
    try:
        return _scan(text, at)
    except StopIteration:
        raise ValueError(f"no value at {at}") from None
    except RecursionError:
        return _deep(text, at)


def _trimmed(text: str) -> str:
    return text.strip().lstrip("\ufeff").strip()


def _decoded(value: Any) -> Any:
    """A member that was encoded once more, or several times, is read out of its string; any other string is itself."""
    while isinstance(value, str):
        text = _trimmed(value)
        if text[:1] not in ("{", "[", '"'):
            break
        try:
            inner, end = _value(text, 0)
        except ValueError:
            break
        if end < len(text):
            break
        value = inner
    return value


def _unwrapped(text: str) -> str:
    """The text that is encoded in a text, as often as it was encoded; it begins with what it holds."""
    text = _trimmed(text)
    while text[:1] == '"':
        try:
            inner, end = scanstring(text, 1)
        except ValueError:
            return text
        if end < len(text):
            return text
        text = _trimmed(inner)
    return text


def _lists(value: Any, name: str) -> Iterator[Any]:
    """Every member called ``name`` at any depth, in document order; lists within a found list are found as well."""
    stack = [(False, value)]
    while stack:
        hit, value = stack.pop()
        value = _decoded(value)
        if hit:
            yield value
        if isinstance(value, dict):
            stack.extend((k == name, v) for k, v in reversed(value.items()))
        elif isinstance(value, list):
            stack.extend((False, v) for v in reversed(value))


def _items(value: Any) -> Iterator[tuple[int, dict]]:
    """Objects of a list with their positions; a lone object is a list of one; null items keep their position."""
    value = _decoded(value)
    for k, item in enumerate(value if isinstance(value, list) else [value]):
        item = _decoded(item)
        if isinstance(item, dict):
            yield k, item


def _walk(text: str, kind: str, ords: tuple[int, ...], dropped: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple]:
    """Events of a text that is an object or a list of objects of ``kind``, in the order of the text.

    ("open", kind, ordinals): an object begins. ("member", kind, ordinals, name, value, text): a member that is no
    table. ("encoded", kind, ordinals, text, is_item): objects in a string. ("again", offset): the member at that
    offset is given once more later, and the last one holds; offsets in ``dropped`` are passed over. A text that isn't
    whole raises ValueError where that shows.
    """
    at, first = 0, True
    stack: list[list] = []  # [is object, kind, ordinals, next position, offsets of the members by name]

    def opened(kind: str, ords: tuple[int, ...], position: int) -> list:
        own = list(ords)
        if kind in _SLOT:
            own[_SLOT[kind]] = position
        return [True, kind, tuple(own), 0, {}]

    if text[:1] == "{":
        stack.append(opened(kind, ords, 0))
        yield "open", kind, stack[-1][2]
    elif text[:1] == "[" and kind != "set":
        stack.append([False, kind, ords, 0, None])
    else:
        raise ValueError("no object")
    at = _blank(text, 1).end()
    while stack:
        frame = stack[-1]
        is_object, kind, ords, position, names = frame
        if first:
            first = False
            if text[at : at + 1] == ("}" if is_object else "]"):
                stack.pop()
                at += 1
                continue
        else:
            m = _after(text, at)
            if m is None:
                raise ValueError(f"no end at {at}")
            at = m.end()
            if m[1] != ",":
                if (m[1] == "}") is not is_object:
                    raise ValueError(f"another end at {at}")
                stack.pop()
                continue
        if is_object:
            begin, m = at, _name(text, at)
            key, at = (m[1], m.end()) if m else _key(text, at)
            if key in names:
                yield "again", names[key]
            names[key] = begin
            child = _LISTS[kind].get(key)
            if child is None and begin not in dropped:
                end = (found := _value(text, at))[1]
                yield "member", kind, ords, key, found[0], text[at:end]
                at = end
                continue
            position = 0
        else:
            begin, child = -1, kind
            frame[3] += 1
        here = text[at : at + 1]
        if begin in dropped:
            at = _value(text, at)[1]
        elif here == "{":
            stack.append(opened(child, ords, position))
            yield "open", child, stack[-1][2]
            at, first = _blank(text, at + 1).end(), True
        elif here == "[" and is_object:
            stack.append([False, child, ords, 0, None])
            at, first = _blank(text, at + 1).end(), True
        else:
            value, at = _value(text, at)
            if isinstance(value, str):
                yield "encoded", child, ords, value, None if is_object else position
    at = _blank(text, at).end()
    if at < len(text):
        raise ValueError(f"more than one value at {at}")


def _surveyed(text: str, kind: str) -> tuple[set[int], Any] | None:
    """First reading: offsets of members that are given again, and the version; None if the text isn't whole."""
    dropped: set[int] = set()
    version = None
    try:
        for event in _walk(text, kind, (-1, -1, -1, -1)):
            if event[0] == "again":
                dropped.add(event[1])
            elif event[0] == "member" and event[1] == "set" and event[3] == "schema_version":
                version = event[4]
    except ValueError:
        return None
    return dropped, version


def _is_readable(version: Any) -> bool:
    """Whether a version, as a value or as its text, has the major number 0."""
    major = str(version).strip().split(".")[0] if isinstance(version, (str, int, float)) and not isinstance(version, bool) else ""
    return major.isdecimal() and int(major) == 0


def _as_text(value: Any, source: str) -> str | None:
    """A member as the text of a field: strings as they are, anything else as it was written, without blanks."""
    if isinstance(value, str) or value is None:
        return value
    return _spaced.sub(r"\1", source) if isinstance(value, (dict, list)) and _gap(source) else source


class _Again(Exception):
    """A member was given once more, so what was emitted of it doesn't hold."""


def _emitted(text: str, kind: str, ords: tuple[int, ...], dropped: set[int] | None) -> Iterator[tuple[str, tuple[int, ...], str | None]]:
    """Second reading: the triples of a whole text; without a first one (None) members given again are an error."""
    for event in _walk(text, kind, ords, dropped or frozenset()):
        what, kind, *rest = event
        if what == "again" and dropped is None:
            raise _Again
        if what == "open":
            yield f"{kind}:", rest[0], None
        elif what == "member":
            ords, key, value, source = rest
            yield f"{kind}:{key}", ords, _as_text(value, source)
            if key in _SEARCHED[kind]:
                child, name = _SEARCHED[kind][key]
                for number, found in enumerate(_lists(value, name) if name else [value]):
                    for k, item in _items(found):
                        slot = list(ords)
                        slot[_SLOT[child]] = k
                        place = (*slot, number) if name else tuple(slot)
                        yield f"{child}:", place, None
                        for member, v in item.items():
                            yield f"{child}:{member}", place, v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        elif what == "encoded":
            ords, source, position = rest
            inner = _unwrapped(source)
            if inner[:1] == "{" or (inner[:1] == "[" and position is None):
                known = _surveyed(inner, kind)
                if known:
                    yield from _placed(_emitted(inner, kind, ords, known[0]), kind, position)


def _placed(rows: Iterator[tuple], kind: str, position: int | None) -> Iterator[tuple]:
    """An item that was encoded on its own has its place from the list it is in."""
    if not position:
        yield from rows
        return
    for path, ords, value in rows:
        slot = list(ords)
        slot[_SLOT[kind]] = position
        yield path, tuple(slot), value


def triples(payload: str | None) -> Iterator[tuple[str, tuple[int, ...], str | None]]:
    """(path, ordinals, value) of a readable payload in the order of its text; none of any other.

    A path names the repeated ancestor and, after a colon, the member: ``entity:`` is an entity itself,
    ``entity:geometry`` one of its members. Members that are tables of their own are walked, not repeated; of members
    of one name the last holds. Ordinals are those of sheet, view, item and sub-item. A parent may have several lists
    of one name at different depths, each numbered from 0: the objects of such lists have the list's number below the
    parent as a fifth one.
    """
    text = _unwrapped(payload) if payload is not None else ""
    if text[:1] != "{":
        return
    if len(text) <= _HELD:  # the triples wait for the end of the text, which saves the first reading
        held, version = [], None
        try:
            for triple in _emitted(text, "set", (-1, -1, -1, -1), None):
                held.append(triple)
                if triple[0] == "set:schema_version":
                    version = triple[2]
        except ValueError:
            return
        except _Again:
            pass
        else:
            if _is_readable(version):
                yield from held
            return
    known = _surveyed(text, "set")
    if known and _is_readable(known[1]):
        yield from _emitted(text, "set", (-1, -1, -1, -1), known[0])


def pivoted(payload: str | None) -> Iterator[tuple[str, tuple[int, ...], list]]:
    """The rows of all tables of one record: the triples of one ancestor make one row, given when it is left."""
    open_rows: list[tuple[str, tuple[int, ...], list]] = []
    for path, ords, value in triples(payload):
        kind, _, member = path.partition(":")
        above = kind if member else _PARENT[kind]
        while open_rows and open_rows[-1][0] != above:
            yield open_rows.pop()
        if member:
            open_rows[-1][2].append((member, value))
        else:
            open_rows.append((kind, ords, []))
    yield from reversed(open_rows)


def flatten(df: DataFrame, *, key: str = "set_key", payload: str = "payload", kinds: tuple[str, ...] = tuple(TABLES), with_origin: bool = False, distinct: bool = True) -> DataFrame:
    """Rows (set_key, node_kind, sheet_ord, view_ord, item_ord, sub_ord, fields) of every object of readable payloads.

    Ordinals are the links to the parents: they count positions from 0, null items included, and are -1 where they
    don't apply. ``fields`` maps each member to its text (JSON for numbers, lists and objects). Payloads that are
    null, empty, broken, no object, or of a foreign schema version give no rows (``unreadable`` lists them). A row
    delivered twice (equal key and payload) counts once, unless ``distinct`` is off. Objects of a null key are kept
    under the null key.

    ``with_origin`` adds what tells apart objects of equal key and ordinals: ``record`` (SHA-256 of the payload, for
    different payloads of one key or of none) and ``list_ord`` (the list's number below its parent in document order,
    -1 for kinds with one list only).
    """
    names = [f.split()[0] for f in _FLAT.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, origins = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            out: list[list] = [[] for _ in names]
            held = 0
            for k, text, origin in zip(keys, texts, origins):
                for kind, ords, fields in pivoted(text.as_py()):
                    if kind not in kinds:
                        continue
                    for column, v in zip(out, (k, kind, *ords[:4], fields, origin, ords[4] if len(ords) > 4 else -1)):
                        column.append(v)
                    held += 200 + sum(len(v) for _, v in fields if v)
                    if held > _HELD:
                        yield _batch(out)
                        out, held = [[] for _ in names], 0
            if out[0]:
                yield _batch(out)

    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("set_key"), F.col(f"`{payload}`").cast("string").alias("payload"))
    rows = rows.distinct() if distinct else rows
    origin = F.sha2("payload", 256) if with_origin else F.lit(None).cast("string")
    flat = rows.withColumn("record", origin).mapInArrow(parse, _FLAT)
    return flat.select(*names[:7], *(["record", "list_ord"] if with_origin else []))


def positions(df: DataFrame, *, key: str = "set_key", payload: str = "payload", kinds: tuple[str, ...] = tuple(TABLES)) -> DataFrame:
    """Distinct (set_key, node_kind, sheet_ord, view_ord, item_ord, sub_ord) of the rows of all tables.

    Objects of several lists of one name below one parent, and of several payloads of one key, may share a position.
    """
    # Redelivered payloads have equal positions, so what is compared are these and not the payloads.
    return flatten(df, key=key, payload=payload, kinds=kinds, distinct=False).drop("fields").distinct()


def write_tables(df: DataFrame, folder: str, *, key: str = "set_key", payload: str = "payload") -> None:
    """All tables in one reading: Parquet files in ``folder``, partitioned by ``node_kind``; ``flat_table`` of what is
    read back from there gives any of them."""
    flatten(df, key=key, payload=payload, with_origin=True).write.mode("overwrite").partitionBy("node_kind").parquet(folder)


def _batch(columns: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32()]
    names = [f.split()[0] for f in _FLAT.split(", ")]
    try:
        fields = pa.array(columns[6], type=types[6])
    except UnicodeEncodeError:  # half of a pair of code units, which no text can hold
        sound = lambda v: v if v is None else v.encode("utf-8", "replace").decode()
        fields = pa.array([[(sound(k), sound(v)) for k, v in f] for f in columns[6]], type=types[6])
    arrays = [fields if k == 6 else pa.array(c, type=t) for k, (c, t) in enumerate(zip(columns, types))]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def flat_table(flat: DataFrame, kind: str, columns: list[str], *, rest: str | None = None) -> DataFrame:
    """One related table: the parents' ordinals, the own ones, and ``columns`` out of the pivoted members.

    ``rest`` names a further column with all other members as a JSON object of their texts, null if there are none.

    Of a ``flat`` with origins, ``record`` is part of every key, and ``list_ord`` of those in lists at any depth.
    """
    own = {"set": [], "sheet": ["sheet_ord"], "view": ["sheet_ord", "view_ord"], "issue": ["item_ord"], **dict.fromkeys(("port", "text_span"), ["sheet_ord", "view_ord", "item_ord", "sub_ord"])}
    ordinals = own.get(kind, ["sheet_ord", "view_ord", "item_ord"])
    origin = ["record"] if "record" in flat.columns else []
    if origin and len(TABLES[kind][1]) > 1:
        ordinals = [*ordinals[:-1], "list_ord", ordinals[-1]]
    others = F.map_filter("fields", lambda k, _: ~k.isin(*columns))
    more = [F.when(F.size(others) > 0, F.to_json(others)).alias(rest)] if rest else []
    return flat.where(F.col("node_kind") == kind).select("set_key", *origin, *ordinals, *[F.col("fields")[c].alias(c) for c in columns], *more)


def _fault(payload: str | None) -> str | None:
    if payload is None or not payload.strip():
        return "empty"
    text = _unwrapped(payload)
    if text[:1] != "{":
        try:
            return "no object" if _value(whole := _trimmed(payload), 0)[1] == len(whole) else "broken"
        except ValueError:
            return "broken"
    known = _surveyed(text, "set")
    return "broken" if known is None else None if _is_readable(known[1]) else "foreign version"


def unreadable(df: DataFrame, *, key: str = "set_key", payload: str = "payload") -> DataFrame:
    """Keys and a reason of the payloads that ``flatten`` can't read."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1)):
                reason = _fault(p.as_py())
                if reason:
                    out.append((k, reason))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([r for _, r in out], pa.string())], names=["set_key", "reason"])

    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("set_key"), F.col(f"`{payload}`").cast("string").alias("payload"))
    return rows.mapInArrow(judge, "set_key bigint, reason string").distinct()
