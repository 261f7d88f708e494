"""Scalar text functions: columns in, columns out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def change_case(c: Column, mode: str) -> Column:
    return {"upper": F.upper, "lower": F.lower}[mode](c)


def concatenated(columns: list[Column], joiner: str = "") -> Column:
    """Null unless all inputs are there. The joiner follows a non-empty prefix only."""
    out, there = columns[0], columns[0].isNotNull()
    for c in columns[1:]:
        out = F.concat(out, F.when(out == "", F.lit("")).otherwise(F.lit(joiner)), c)
        there = there & c.isNotNull()
    return F.when(there, out)


def replaced(c: Column, old: str, to: str, regex: bool = False) -> Column:
    """Literal replacement, or a regular expression with ${1} or $1 for groups."""
    if not regex:
        return F.replace(c, F.lit(old), F.lit(to))
    return F.regexp_replace(c, old, re.sub(r"\$\{(\d+)\}", r"$\1", to))


def split_by(c: Column, sep: str) -> Column:
    """Array by a literal separator; an empty separator gives characters."""
    if sep == "":
        return F.filter(F.split(c, ""), lambda x: x != "")
    return F.split(c, re.escape(sep), -1)


def byte_slice(c: Column, start: int, end: int) -> Column:
    """Bytes start to end (end not included) of the UTF-8 form; empty beyond the end."""
    part = F.substring(F.encode(c, "UTF-8"), start + 1, max(0, end - start))
    return F.make_valid_utf8(part.cast("string"))  # a character that is cut becomes a replacement character


def char_slice(c: Column, start: int, end: int) -> Column:
    return F.substring(c, start + 1, max(0, end - start))


def trimmed(c: Column, characters: str, place: str = "both") -> Column:
    """Strip a set of characters at the front, the back or both."""
    if not characters:
        return c
    one = {"both": F.btrim, "prefix": F.ltrim, "suffix": F.rtrim}[place]
    return one(c, F.lit(characters))


def url_text(c: Column, mode: str) -> Column:
    """Percent encoding or decoding; a bad escape decodes to null."""
    return F.url_encode(c) if mode == "encode" else F.try_url_decode(c)


def url_params(c: Column, key: str) -> Column:
    """Map of `<key>_url_param_path`, `<key>_url_param_host` and one entry for each query parameter.

    Repeated parameters are joined by &, empty ones left out.
    """
    query = F.when(c.contains("?"), F.regexp_extract(c, r"(?s)\?(.*)$", 1)).otherwise(F.when(~c.contains("/") & c.contains("="), c))
    base = F.split(c, r"\?").getItem(0)
    path = F.when(c.contains("://"), F.regexp_extract(base, r"^[^:/]+://[^/]*(/.*)?$", 1)).otherwise(
        F.when(query == c, F.lit("")).otherwise(base)
    )
    host = F.regexp_extract(c, r"^[^:/?]+://([^/?]+)", 1)
    pairs = F.transform(
        F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p.contains("=")),
        lambda p: F.struct(
            F.concat(F.lit(f"{key}_"), F.try_url_decode(F.substring_index(p, "=", 1))).alias("k"),
            F.try_url_decode(F.regexp_replace(p, r"(?s)^[^=]*=", "")).alias("v"),
        ),
    )
    good = F.filter(pairs, lambda p: p["k"].isNotNull() & (F.length(p["v"]) > 0))
    names = F.array_distinct(F.transform(good, lambda p: p["k"]))
    joined = F.transform(
        names,
        lambda k: F.struct(k.alias("key"), F.array_join(F.transform(F.filter(good, lambda p: p["k"] == k), lambda p: p["v"]), "&").alias("value")),
    )
    head = F.filter(
        F.array(
            F.struct(F.lit(f"{key}_url_param_path").alias("key"), path.alias("value")),
            F.struct(F.lit(f"{key}_url_param_host").alias("key"), host.alias("value")),
        ),
        lambda e: (F.length(e["value"]) > 0)
        & ~F.exists(joined, lambda j: j["key"] == e["key"]),
    )
    return F.map_from_entries(F.concat(head, joined))


def key_values(c: Column, splitter: str = "=") -> Column:
    """Ordered array of (key, value) of key=value text, quotes taken off; null where a key is missing.

    One search marks the keys (a value in quotes is taken with its key), two splits part them. A value runs up to the
    next key and may hold blanks. The control characters U+0001 and U+0002 count as blanks.
    """
    text = F.trim(F.translate(c, "\r\n\u0001\u0002", "    "))
    stop, sep = re.escape(splitter[0]), re.escape(splitter)
    marked = F.regexp_replace(text, rf'(?:^|\s+)([^\s"{stop}]+)\s*{sep}\s*((?:"[^"]*")?)', "\u0001$1\u0002$2")
    items = F.slice(F.split(marked, "\u0001", -1), 2, 1 << 30)
    pairs = F.transform(
        items,
        lambda x: F.struct(
            F.substring_index(x, "\u0002", 1).alias("key"),
            F.btrim(F.trim(F.substring(x, F.instr(x, "\u0002") + 1, F.length(x))), F.lit('"')).alias("value"),
        ),
    )
    return F.when(marked.startswith("\u0001"), pairs)


def last_of_each(pairs: Column) -> Column:
    """Map of ordered (key, value) pairs; the last value of a repeated key stays."""

    def to_map(p: Column) -> Column:
        keys = p["key"]
        # Mostly no key repeats: then the pairs are the map.
        last = F.filter(p, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["key"]))
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), p).otherwise(last))

    return F.element_at(F.transform(F.array(pairs), to_map), 1)


#: Numbers that a repeated key tries.
FREE_NAMES = 5


def first_free(keys: Column, values: Column) -> Column:
    """Map of keys and values in order, where a key that is taken gets the first free one of key_1, key_2, ...; with none
    free the value replaces that of the key."""

    def put(have: Column, new: Column) -> Column:
        names = F.array(new["key"], *[F.concat(new["key"], F.lit(f"_{i + 1}")) for i in range(FREE_NAMES)])
        free = F.get(F.filter(names, lambda n: ~F.exists(have, lambda h: h["key"] == n)), F.lit(0))
        added = F.concat(have, F.array(F.struct(free.alias("key"), new["value"].alias("value"))))
        replaced = F.transform(have, lambda h: F.struct(h["key"].alias("key"), F.when(h["key"] == new["key"], new["value"]).otherwise(h["value"]).alias("value")))
        return F.when(free.isNotNull(), added).otherwise(replaced)

    pairs = F.transform(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    several = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.map_from_entries(F.when(several, F.aggregate(pairs, none, put)).otherwise(pairs))


def ipv4_text(c: Column) -> Column:
    """Dotted address of an integer or its text."""
    n = c.try_cast("bigint")
    part = lambda shift: F.shiftright(n, shift).bitwiseAND(F.lit(255)).cast("string")
    return F.when(n.between(0, (1 << 32) - 1), F.concat_ws(".", part(24), part(16), part(8), part(0)))


def ipv4_number(c: Column) -> Column:
    """Number of a dotted address, null for anything else."""
    parts = F.split(F.trim(c), r"\.")
    octet = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    good = F.regexp_like(F.trim(c), F.lit(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"))
    return F.when(good, octet(0) * (1 << 24) + octet(1) * (1 << 16) + octet(2) * 256 + octet(3))


def array_fields(c: Column, key: str) -> Column:
    """Map key0, key1, ... of an array of any length."""
    return F.map_from_entries(F.transform(c, lambda x, i: F.struct(F.concat(F.lit(key), i.cast("string")).alias("key"), x.alias("value"))))


def shortened(c: Column, n_bytes: int) -> Column:
    """Text of at most n_bytes, and how many bytes are shown and left."""
    rest = F.octet_length(c) - n_bytes
    shown = F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, n_bytes).cast("string"))
    return F.when(rest > 0, F.concat(shown, F.lit(f"......(only show {n_bytes} bytes, remain "), rest.cast("string"), F.lit(" bytes)"))).otherwise(c)


def chunks(c: Column, size: int) -> Column:
    """Array of pieces of at most size characters; their concatenation is the text."""
    n = F.greatest(F.ceil(F.char_length(c) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))


def byte_chunks(c: Column, size: int) -> Column:
    """Array of pieces of at most size UTF-8 bytes; their concatenation is the text.

    A piece runs to the last line break within reach, or to the last whole character where there is none.
    """
    if size < 4:
        raise ValueError("a piece must hold any character, of up to 4 bytes")
    # One character for each byte, so that the search counts bytes.
    raw = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    pattern = rf"(?s).{{1,{size}}}\z|.{{1,{size}}}(?<=\n)|.{{1,{size}}}(?![\x80-\xBF])"
    pieces = F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(0)), lambda x: F.decode(F.encode(x, "ISO-8859-1"), "UTF-8"))
    return F.when(F.length(c) == 0, F.array(F.lit(""))).otherwise(pieces)


def scaled(c: Column, digits: int) -> Column:
    """Number divided by ten to the digits."""
    return c.try_cast("double") / F.lit(float(10**digits))


def floored(epoch: Column, base: int) -> Column:
    """Epoch seconds at the start of their period (300: five minutes, 86400: a day)."""
    return epoch - F.pmod(epoch, F.lit(base))
