"""Type conversion by a small language: `field type default, ...`.

Types: l(ong), f(loat), s(tring), d(ate), b(oolean), j(sonmap text), a(elem) or array(elem), m{...} or map{...}.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import paths
from ..errors import with_error
from .dates import parsed

_SIMPLE = {
    "l": "bigint", "long": "bigint", "f": "double", "float": "double", "s": "string", "string": "string", "": "string",
    "d": "timestamp", "date": "timestamp", "b": "boolean", "bool": "boolean", "boolean": "boolean", "j": "string", "jsonmap": "string",
}
MAX_DEPTH = 5


def parse_dsl(text: str, depth: int = 1) -> list[tuple[str, str, str | None]]:
    """(name, Spark type, default) of each field."""
    if depth > MAX_DEPTH:
        raise ValueError("nested too deep")
    out, level, own = [], 0, ""
    for ch in text + ",":
        level += ch in "{(" and 1 or (ch in "})" and -1 or 0)
        if ch in ",\n" and level == 0:
            if own.strip():
                name, _, rest = own.strip().partition(" ")
                kind, default = _kind(rest.strip(), depth)
                out.append((name, kind, default))
            own = ""
        else:
            own += ch
    if level:
        raise ValueError(f"brackets do not match in {text!r}")
    return out


def _kind(text: str, depth: int) -> tuple[str, str | None]:
    if m := re.match(r"(?:m|map)\s*\{(.*)\}$", text, re.S):
        return "struct<" + ",".join(f"`{n}`:{k}" for n, k, _ in parse_dsl(m[1], depth + 1)) + ">", None
    if m := re.match(r"(?:a|array)\s*(?:\((.*)\))?$", text, re.S):
        return f"array<{_kind((m[1] or 's').strip(), depth + 1)[0]}>", None
    word, _, default = text.partition(" ")
    if word not in _SIMPLE:
        raise ValueError(f"unknown type {word!r}")
    return _SIMPLE[word], default.strip() or None


def as_type(c: Column, kind: str, from_text: bool) -> Column:
    if kind == "timestamp":
        return parsed(c)
    if kind.startswith(("array", "struct")):
        return F.from_json(c, kind) if from_text else c.try_cast(kind)
    if kind == "bigint":
        return F.coalesce(c.try_cast("bigint"), F.floor(c.try_cast("double")).cast("bigint"))
    return c.try_cast(kind)


def convert(df: DataFrame, dsl: str) -> DataFrame:
    """Fields of df in their declared types; a value that does not convert becomes the default. Without one it becomes null,
    and its text stays in `_errors`."""
    for name, kind, default in parse_dsl(dsl):
        here = paths.kind_of(df.schema, name)
        if here is None:
            if default is not None:
                df = paths.put(df, name, F.lit(default).try_cast(kind))
            continue
        old = paths.get(df, name)
        new = as_type(old, kind, here.typeName() == "string")
        if default is not None:
            new = F.coalesce(new, F.lit(default).try_cast(kind))
        nested = here.typeName() in ("array", "struct", "map")
        was = F.to_json(old) if nested else old.cast("string")
        blank = old.isNull() | (old.cast("string") == "") if not nested else old.isNull()
        df = with_error(df, new.isNull() & ~blank, "convert", name, F.concat(F.lit(f"not a {kind}: "), was))
        df = paths.put(df, name, new)
    return df
