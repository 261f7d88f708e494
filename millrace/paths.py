"""Nested field paths, compiled to column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def keys(path: str) -> list[str]:
    """Levels of a path, divided by dots or white space."""
    return [k for k in re.split(r"[.\s]+", path.strip()) if k]


def kind_of(schema: StructType, path: str) -> DataType | None:
    """Type at a path, or None where a level is missing."""
    here: DataType | None = schema
    for k in keys(path):
        if not isinstance(here, StructType) or k not in here.fieldNames():
            return None
        here = here[k].dataType
    return here


def get(df: DataFrame, path: str) -> Column:
    """Value at a path; null where a level is missing."""
    if kind_of(df.schema, path) is None:
        return F.lit(None).cast("string")
    return F.col(".".join(f"`{k}`" for k in keys(path)))


def put(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Set a path, making missing levels; a level that is no struct is an error."""
    top, *rest = keys(path)
    if not rest:
        return df.withColumn(top, value)
    for i in range(1, len(rest) + 1):
        kind = kind_of(df.schema, ".".join([top, *rest][:i]))
        if kind is not None and not isinstance(kind, StructType):
            raise ValueError(f"{'.'.join([top, *rest][:i])} holds no fields")
    if kind_of(df.schema, top) is None:
        for k in reversed(rest):
            value = F.struct(value.alias(k))
        return df.withColumn(top, value)
    have = next(i for i in range(len(rest), 0, -1) if i == 1 or kind_of(df.schema, ".".join([top, *rest][:i])) is not None)
    for k in reversed(rest[have:]):
        value = F.struct(value.alias(k))
    whole = F.coalesce(F.col(f"`{top}`"), F.lit(None).cast(df.schema[top].dataType))
    return df.withColumn(top, whole.withField(".".join(f"`{k}`" for k in rest[:have]), value))


def drop(df: DataFrame, *paths: str) -> DataFrame:
    """Remove fields; a path that does not exist is no error."""
    for path in paths:
        if kind_of(df.schema, path) is None:
            continue
        top, *rest = keys(path)
        if not rest:
            df = df.drop(top)
            continue
        parent = kind_of(df.schema, ".".join([top, *rest][:-1]))
        if len(parent.fieldNames()) == 1:  # a struct can't be empty: its parent goes
            df = drop(df, ".".join([top, *rest][:-1]))
        else:
            df = df.withColumn(top, F.col(f"`{top}`").dropFields(".".join(f"`{k}`" for k in rest)))
    return df


def pick(df: DataFrame, *paths: str) -> DataFrame:
    """Keep only these fields; parents stay with what is kept of them."""
    tree: dict = {}
    for path in paths:
        if kind_of(df.schema, path) is not None:
            here = tree
            for k in keys(path):
                here = here.setdefault(k, {})

    def build(prefix: list[str], own: dict) -> Column:
        column = F.col(".".join(f"`{k}`" for k in prefix))
        if not own:
            return column.alias(prefix[-1])
        return F.when(column.isNotNull(), F.struct(*[build([*prefix, k], v) for k, v in own.items()])).alias(prefix[-1])

    return df.select(*[build([k], v) for k, v in tree.items()])


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it (names do not tell case apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
