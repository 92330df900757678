"""JSON objects of any depth to maps of text, parsed once in Arrow batches."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value) -> str | None:
    """A leaf as text: numbers as they are written, lists joined by ', '."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return ", ".join(x for x in (v if isinstance(v, str) else _inner(v) for v in value) if x is not None)
    return _inner(value)


class _Number(str):
    """A number with the digits that the line has."""


def _inner(value) -> str | None:
    """JSON text of a value inside a list."""
    if value is None or isinstance(value, _Number):
        return value
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_inner(v) or 'null'}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(_inner(v) or "null" for v in value) + "]"
    return json.dumps(value, ensure_ascii=False)


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_Number)


def flattened(line: str | None) -> dict[str, str] | None:
    """Name -> text of all leaves, full names first; null for what is no object."""
    if line is None:
        return None
    try:
        top = _DECODER.decode(line)
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, dict):
        return None
    out: dict[str, str] = {}
    bare: list[tuple[str, str]] = []  # of inner leaves; names at the top are full
    todo = [("", iter(top.items()))]
    while todo:
        prefix, items = todo[-1]
        for key, value in items:
            if isinstance(value, str):
                leaves = ((prefix + key, key, value),)
            elif isinstance(value, dict):
                todo.append((f"{prefix}{key}_" if prefix or key else "", iter(value.items())))
                break
            elif isinstance(value, list) and value and isinstance(value[0], dict) and next(iter(value[0]), None) == "@Name":
                names = [(str(x.get("@Name")), x.get("#text")) for x in value if isinstance(x, dict) and not isinstance(x.get("#text"), dict)]
                leaves = [(name, name, _text(text)) for name, text in names]
            else:
                leaves = ((prefix + key, key, _text(value)),)
            for name, last, text in leaves:
                if text:
                    out.setdefault(name, text)
                    if last is not name:
                        bare.append((last, text))
        else:
            todo.pop()
    for name, text in bare:
        out.setdefault(name, text)
    return out


def json_fields(text: Column) -> Column:
    """Nested objects become a_b_c, a leaf also its bare name where that is free; lists are joined by ', '.

    `Data` lists of (@Name, #text) become one field per name.  Any depth that the JSON
    parser takes (about a thousand levels); what is no object has no fields (null).
    """

    @F.arrow_udf("map<string,string>")
    def fields(lines: pa.Array) -> pa.Array:
        bounds, keys, values = [], [], []
        for found in map(flattened, lines.to_pylist()):
            bounds.append(None if found is None else len(keys))
            if found:
                keys += found
                values += found.values()
        bounds.append(len(keys))
        return pa.MapArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))

    return fields(text)
