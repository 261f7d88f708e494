"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import materialise, shared_dir

__all__ = ["components", "doc_text", "let", "materialise", "plus_double", "shared_dir", "spread_join", "table", "thrifty", "tokenizer_path", "unused"]

#: Where the public tokenizer files live; a parameter of every operator that reads one.
TOKENIZER_PACKAGE = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine (driver or executor)."""
    import importlib

    return importlib.import_module(TOKENIZER_PACKAGE).path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def plus_double(schema: StructType, name: str) -> StructType:
    return StructType([*schema.fields, StructField(name, DoubleType())])


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it (Spark's names do not tell case apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow that, at the end of a task, gives the memory back that Arrow's pool keeps but does not use:
    Spark's Python workers outlive the task and the operator, and what one keeps adds up with the next one's."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return own


#: Keys that spread_join broadcasts at most.
HEAVY_KEYS = 1000


def spread_join(left: DataFrame, right: DataFrame, on: str | list[str], weight: str, fits: Column | None = None) -> DataFrame:
    """left joined with right, which has one row for each key and in `weight` how many rows of left have it.

    The HEAVY_KEYS keys of the greatest weight are broadcast; of any other key left holds less than one row in
    HEAVY_KEYS, so a hot key never meets in one task. fits bounds the rows that may be broadcast, where rows of right
    have no fixed size. Both are read twice: they should be written tables.
    """
    keys = [on] if isinstance(on, str) else on
    top = right if fits is None else right.where(fits)
    top = F.broadcast(materialise(top.orderBy(F.desc(weight), *keys).limit(HEAVY_KEYS), "heavy"))
    names = top.select(*keys)
    rest = left.join(names, keys, "left_anti").join(right.join(names, keys, "left_anti"), keys)
    return left.join(top, keys).unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): connected components of an edge list, named by their smallest node.

    Alternating large-star and small-star rounds: every round hangs nodes below smaller ones with a pre-aggregated
    minimum and a join, never holding a whole component in one task. Each round is written to the shared folder.
    """
    e = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(large.where("u <> v").distinct(), "large")
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small, "small")
        state = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == seen:
            break
        seen = state
    named = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return named.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
