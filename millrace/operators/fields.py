"""Row filters and field operators: DataFrame in, DataFrame out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StringType, StructField, StructType

from .. import paths
from ..errors import COLUMN, with_error


def filter_rows(df: DataFrame, keys: list[str], pattern: str | None = None, mode: str = "keep") -> DataFrame:
    """Keep or remove rows where any of the paths matches (no pattern: exists). Missing fields never match."""
    tests = []
    for key in keys:
        c = paths.get(df, key)
        tests.append(c.isNotNull() if not pattern else F.regexp_like(c.cast("string"), F.lit(pattern)))
    hit = F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False))
    return df.where(hit if mode == "keep" else ~hit)


def filter_lines(df: DataFrame, text: str, mode: str = "pick", column: str = "value") -> DataFrame:
    """Lines that contain the text (pick) or do not (discard)."""
    hit = F.col(column).contains(text)
    return df.where(hit if mode == "pick" else ~hit)


def short_lines(df: DataFrame, max_bytes: int, column: str = "value") -> DataFrame:
    return df.where(F.octet_length(column) <= max_bytes)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """Move a path; a missing one is left alone."""
    if paths.kind_of(df.schema, old) is None:
        return df
    if len(paths.keys(old)) == 1 and len(paths.keys(new)) == 1:
        return df.withColumnRenamed(old, new)
    return paths.drop(paths.put(df, new, paths.get(df, old)), old)


def copy(df: DataFrame, old: str, new: str, override: bool = False, prune_empty: bool = False) -> DataFrame:
    """Copy a path; a target that is there stays (and is noted) unless overridden."""
    value = paths.get(df, old)
    if prune_empty:
        value = pruned(value, paths.kind_of(df.schema, old))
    if paths.kind_of(df.schema, new) is None or override:
        return paths.put(df, new, value)
    have = paths.get(df, new)
    df = with_error(df, have.isNotNull() & value.isNotNull(), "copy", new, "already there")
    return paths.put(df, new, F.coalesce(paths.get(df, new), value))


def pruned(c: Column, kind: DataType | None, depth: int = 5) -> Column:
    """Empty texts, arrays, maps and structs become null, within structs and text maps too; depth levels below, a struct
    or map becomes JSON text."""
    if isinstance(kind, StringType):
        return F.nullif(c, F.lit(""))
    if isinstance(kind, ArrayType):
        return F.when(F.size(c) > 0, c)
    if isinstance(kind, MapType):
        inner = kind.valueType
        if isinstance(inner, (StructType, MapType)) and depth == 0:
            c = F.transform_values(c, lambda _, v: F.to_json(v))
        elif isinstance(inner, (StringType, ArrayType, StructType, MapType)):
            c = F.map_filter(F.transform_values(c, lambda _, v: pruned(v, inner, depth - 1)), lambda _, v: v.isNotNull())
        return F.when(F.size(c) > 0, c)
    if isinstance(kind, StructType) and kind.fields:
        own = []
        for f in kind.fields:
            inner = c.getField(f.name)
            if isinstance(f.dataType, (StructType, MapType)) and depth == 0:
                own.append(F.to_json(inner).alias(f.name))
            else:
                own.append(pruned(inner, f.dataType, depth - 1).alias(f.name))
        return F.when(reduce(lambda a, b: a | b, [x.isNotNull() for x in own]), F.struct(*own))
    return c


def label(df: DataFrame, key: str, value, override: bool = False) -> DataFrame:
    """Add a constant; an existing value stays unless overridden."""
    if paths.kind_of(df.schema, key) is None or override:
        return paths.put(df, key, F.lit(value))
    return paths.put(df, key, F.coalesce(paths.get(df, key), F.lit(value)))


def normal_name(name: str) -> str:
    """Runs of other characters to one _, none in front, K before a digit."""
    name = re.sub(r"[^0-9A-Za-z]+", "_", name).lstrip("_")
    return f"K{name}" if name[:1].isdigit() else name


def _normal_type(kind: DataType) -> DataType:
    if isinstance(kind, StructType):
        return StructType([StructField(normal_name(f.name), _normal_type(f.dataType), f.nullable) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(_normal_type(kind.elementType), kind.containsNull)
    return kind


def normalise_names(df: DataFrame) -> DataFrame:
    """Field names in normal form at all levels; two that become one are an error."""
    new = [normal_name(c) for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError(f"names collide: {sorted(n for n in set(new) if new.count(n) > 1)}")
    return df.select(*[F.col(f"`{f.name}`").cast(_normal_type(f.dataType)).alias(n) for f, n in zip(df.schema, new, strict=True)])


def statistic_name(*parts: str) -> str:
    """Column name of a metric statistic in lower snake case."""
    snake = [re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", p) for p in parts]
    return re.sub(r"_+", "_", normal_name("_".join(snake)).lower())


def conform(df: DataFrame, spec: str, types: dict[str, str], defaults: dict | None = None, uuid_column: str | None = None, report: bool = False, required: list[str] = ()) -> DataFrame:
    """One select for a sink: `name alias, name, ...` (... is all other fields), typed, with required defaults.

    A value that its type does not take becomes null, or the default. report: the errors column names such values, and
    required fields that are null without a default.
    """
    defaults, out, named = defaults or {}, [], set()
    items = [x.split() for x in spec.split(",") if x.strip()]
    for name, *alias in [i for i in items if i[0] != "..."]:
        named.add(name)
        kind, c = types.get(name), paths.get(df, name)
        given = c
        if kind == "timestamp":
            from ..functions.dates import parsed

            c = parsed(c)
        elif kind == "jsonstring":
            c = F.to_json(c) if paths.kind_of(df.schema, name).typeName() in ("struct", "map", "array") else c.cast("string")
        elif kind:
            c = c.try_cast(kind)
        if name in defaults:
            value, c = c, F.coalesce(c, F.lit(defaults[name]).try_cast(kind or "string"))
        else:
            value = c
        if report and kind:
            df = with_error(df, given.isNotNull() & value.isNull(), "conform", name, f"not of type {kind}")
        if report and name in required:
            df = with_error(df, given.isNull() & c.isNull(), "conform", name, "required")
        out.append(c.alias(alias[0] if alias else name))
    if any(i[0] == "..." for i in items):
        out += [F.col(c) for c in df.columns if c not in named and c != COLUMN]
    if COLUMN in df.columns and (report or any(i[0] == "..." for i in items)):
        out.append(F.col(COLUMN))
    if uuid_column:
        out.append(F.uuid().alias(uuid_column))
    return df.select(*out)


def aliased(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def metric_rows(df: DataFrame, metric: str, dropped: list[str] = (), tags: dict | None = None, keep: list[str] = ()) -> DataFrame:
    """Metric samples: unselected attributes go, values get the metric's prefix, tags are added."""
    df = df.drop(*dropped)
    df = df.withColumnsRenamed({c: f"{metric}__{c}" for c in df.columns if c not in keep})
    for k, v in (tags or {}).items():
        df = label(df, k, v)
    return df


def expand_array(df: DataFrame, key: str, width: int) -> DataFrame:
    """Array to columns key0 .. key(width-1); a name that is taken gets a suffix _0 .. _5."""
    for i in range(width):
        name = f"{key}{i}"
        name = next(n for n in [name, *(f"{name}_{k}" for k in range(6))] if n not in df.columns)
        df = df.withColumn(name, F.get(F.col(key), F.lit(i)))
    return df


def explode_records(df: DataFrame, key: str = "Records") -> DataFrame:
    """One row for each nested record with the parent's other fields; the parent wins on a clash."""
    parents = [c for c in df.columns if c != key]
    kind = df.schema[key].dataType.elementType
    rows = df.withColumn("_rec", F.explode(key))
    return rows.select(*parents, *[F.col(f"_rec.`{f}`") for f in kind.fieldNames() if f not in parents])


def split_value(df: DataFrame, key: str, size: int, id_column: Column) -> DataFrame:
    """Rows with an oversized text become rows of chunks: part_id, part_no, part_count and the chunk."""
    from ..functions.text import chunks

    rows = df.withColumn("part_id", id_column).withColumn("_parts", chunks(F.col(key), size))
    others = [c for c in rows.columns if c not in (key, "_parts")]
    return rows.select(*others, F.size("_parts").alias("part_count"), F.posexplode("_parts").alias("part_no", key))


def split_oversized(df: DataFrame, keys: list[str], size: int, id_column: Column, part_id: str = "part_id") -> DataFrame:
    """A row with text fields of more than size bytes becomes one row of its other fields, then a row for each piece of an
    oversized field, with only the piece and its id `<id>_<field>_<n>`; other rows stay as they are, without an id."""
    from ..functions.text import byte_chunks

    big = {k: F.coalesce(F.octet_length(k) > size, F.lit(False)) for k in keys}

    def pieces_of(k: str) -> Column:
        name = lambda i: F.concat_ws("_", id_column.cast("string"), F.lit(k), i.cast("string"))
        found = F.transform(byte_chunks(F.col(k), size), lambda x, i: F.struct(name(i).alias("id"), F.lit(k).alias("key"), x.alias("piece")))
        return F.when(big[k], found)

    head = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("piece")))
    none = F.filter(head, lambda x: x["id"].isNotNull())
    row = "_" * (1 + max(map(len, df.columns))) + "row"
    rows = df.withColumn(row, F.explode(F.concat(head, *[F.coalesce(pieces_of(k), none) for k in keys])))
    is_head = F.col(row)["id"].isNull()

    def value(c: str) -> Column:
        if c not in big:
            return F.when(is_head, F.col(f"`{c}`"))
        return F.when(is_head & ~big[c], F.col(f"`{c}`")).when(F.col(row)["key"] == c, F.col(row)["piece"])

    return rows.select(*[value(c).alias(c) for c in df.columns], F.col(row)["id"].alias(part_id))


def rejoin_value(df: DataFrame, key: str) -> DataFrame:
    """Chunks of split_value back to whole texts, one row for each part_id."""
    parts = df.groupBy("part_id").agg(F.sort_array(F.collect_list(F.struct("part_no", key))).alias("_p"))
    return parts.select("part_id", F.array_join(F.col(f"_p.{key}"), "").alias(key))


def parse_json(df: DataFrame, key: str, schema: str, new: str | None = None, extract: bool = False, drop: bool = False) -> DataFrame:
    """JSON text to nested fields, or beside it; malformed text is noted."""
    value = F.from_json(paths.get(df, key), schema)
    bad = paths.get(df, key).isNotNull() & F.try_parse_json(paths.get(df, key)).isNull()
    df = with_error(df.withColumn("_json", value), bad, "json", key, "not JSON")
    if extract:
        df = df.select("*", *[F.col(f"_json.`{f}`") for f in df.schema["_json"].dataType.fieldNames() if f not in df.columns])
    else:
        df = paths.put(df, new or key, F.col("_json"))
    df = df.drop("_json")
    return paths.drop(df, key) if drop and (new or extract) else df


def parse_key_values(df: DataFrame, key: str, new: str | None = None, drop: bool = False, splitter: str = "=", typed: dict[str, str] | None = None,
                     keep_string: bool = False) -> DataFrame:
    """key=value text to a map; other text is noted and stays.

    typed: columns of requested keys and their Spark types; text that is none of it is null; keep_string leaves all text.
    """
    from ..functions.text import key_values, last_of_each

    out = new or f"{key}_map"
    pairs = key_values(paths.get(df, key), splitter)
    df = with_error(df, paths.get(df, key).isNotNull() & pairs.isNull(), "keyvalue", key, "no key=value")
    df = paths.put(df, out, last_of_each(pairs))
    for name, kind in (typed or {}).items():
        c = F.try_element_at(paths.get(df, out), F.lit(name))
        df = df.withColumn(name, c if keep_string else c.try_cast(kind))
    return paths.drop(df, key) if drop else df


def parse_xml(df: DataFrame, key: str, schema: str, new: str | None = None, expand: bool = False, no_attr: bool = False, drop: bool = False) -> DataFrame:
    """XML text by a declared schema; attributes are named with a leading -. expand: leaves as columns of their own."""
    value = F.from_xml(paths.get(df, key), schema, {"attributePrefix": "-", "valueTag": "#text"})
    df = df.withColumn("_xml", value)

    def leaves(kind: StructType, prefix: str):
        for f in kind:
            if no_attr and f.name.startswith("-"):
                continue
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, f"{prefix}.`{f.name}`")
            else:
                yield f"{prefix}.`{f.name}`", f.name

    if expand:
        taken = set(df.columns)
        for path, name in leaves(df.schema["_xml"].dataType, "_xml"):
            name = next(n for n in [name, *(f"{name}_{k}" for k in range(1, 6))] if n not in taken)
            taken.add(name)
            df = df.withColumn(name, F.col(path))
    else:
        df = paths.put(df, new or key, F.col("_xml"))
    df = df.drop("_xml")
    return paths.drop(df, key) if drop and (new or expand) else df


def script(df: DataFrame, command: str, args: list[str], new: str) -> DataFrame:
    """External program over whole partitions: one process each, a line of tab-separated fields in, a line out.

    The program must answer each line with one line; a numbering column goes through it and keeps rows aligned.
    """
    import subprocess

    columns = df.columns

    def run(batches):
        import pandas as pd

        for pdf in batches:
            lines = ["\t".join("" if pd.isna(v) else str(v).replace("\t", " ").replace("\n", " ") for v in row) for row in pdf[args].itertuples(index=False)]
            done = subprocess.run(command, shell=True, input="\n".join(lines) + "\n", capture_output=True, text=True)
            got = done.stdout.split("\n")[: len(lines)]
            failed = done.returncode != 0 or len(got) < len(lines)
            yield pdf.assign(**{new: [None] * len(lines) if failed else got, f"{new}_error": (done.stderr or "too few lines") if failed else None})

    schema = StructType(df.select(*columns).schema.fields).add(new, "string").add(f"{new}_error", "string")
    return df.mapInPandas(run, schema)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
