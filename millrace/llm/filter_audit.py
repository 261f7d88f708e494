"""Operator 12: how filters interact, over every order of applying them.

A document's failures are a mask. The mask matrix holds 0 where a mask fails a filter and infinity elsewhere, the
position matrix holds for every order the step of each filter (the order's inverse permutation); their min-plus product
is the step at which an order removes a mask. Counts of documents by part and mask, weighted by labels, are scattered to
(order, step) by that product. Only these counts, at most 2^filters rows a part, leave Spark's aggregation.

A document is redundant for a filter that it fails after another filter of the order has removed it; a filter's Shapley
sum is what it removes over all orders.

Defined cases: null texts are empty, null parts the empty string; a null doc_id is no copy of anything; rows that repeat
a doc_id count each, and none of them is a copy of another one; of several labels of a document any one with the value
counts; documents without labels weigh nothing; an empty table gives no rows; other columns are not read; texts of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import doc_text, let

_SPACE = r"[\x20\x09-\x0D]+"
_NEVER = np.int64(1) << 40
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT, MARKS = 200, 50, 3, "[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
OUT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_failures(text: Column) -> list[Column]:
    """Few words; few different words; many capitals; a mark."""
    bare = F.regexp_replace(text, f"^{_SPACE}|{_SPACE}$", "")
    counted = let(
        F.split(bare, _SPACE, -1),
        lambda w: F.struct(F.when(w[0] == "", 0).otherwise(F.size(w)).alias("n"), F.when(w[0] == "", 0).otherwise(F.size(F.array_distinct(w))).alias("d")),
    )
    return [
        let(counted, lambda w: F.struct((w["n"] < MIN_WORDS).alias("a"), (100 * w["d"] < MIN_DISTINCT_PCT * w["n"]).alias("b"))),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS_PCT * F.char_length(text),
        F.rlike(text, F.lit(MARKS)),
    ]


def document_masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits ABCDE from the lowest), n, good, toxic: counts of documents.

    A copy is a text that a smaller doc_id has. Texts travel as digests beside their ids; the smallest id of a digest
    comes from counts by (digest, part), so a text that a third of all rows share is summed before it is shuffled.
    """
    text = doc_text()
    words, capitals, marks = text_failures(text)
    rows = documents.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), words.alias("w"), capitals.alias("c"), marks.alias("d")
    )
    mask = F.col("w.a").cast("int") + 2 * F.col("w.b").cast("int") + 4 * F.col("c").cast("int") + 8 * F.col("d").cast("int")
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = rows.select("doc_id", "part", "digest", mask.alias("mask")).join(known, "doc_id", "left")
    one = rows.groupBy("doc_id", "part", "digest", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    sums = ["n", "good", "toxic"]
    texts = one.groupBy("digest", "part", "mask", F.isnull("doc_id").alias("unknown")).agg(
        *[F.sum(c).alias(c) for c in sums], F.min("doc_id").alias("id"), F.min_by(F.struct(*sums), "doc_id").alias("first")
    )
    leads = F.col("id") == F.min("id").over(Window.partitionBy("digest"))
    alone = lambda c: F.when(F.col("unknown"), F.col(c)).when(leads, F.col(f"first.{c}")).otherwise(0)
    split = texts.select("part", "mask", *sums, *[alone(c).alias(f"first_{c}") for c in sums])
    both = F.array(
        F.struct(F.col("mask"), *[F.col(f"first_{c}").alias(c) for c in sums]),
        F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(c) - F.col(f"first_{c}")).alias(c) for c in sums]),
    )
    return split.select("part", F.inline(both)).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in sums])


def removal_steps(n_filters: int, orders: np.ndarray) -> np.ndarray:
    """[mask, order]: the step (from 1) at which the order removes the mask, _NEVER or more if none does."""
    masks = np.where(np.arange(1 << n_filters)[:, None] >> np.arange(n_filters) & 1, 0, _NEVER)
    positions = np.argsort(orders, axis=1) + 1
    return reduce(np.minimum, (masks[:, f, None] + positions[None, :, f] for f in range(n_filters)))


def order_counts(weights: np.ndarray, orders: np.ndarray, steps: np.ndarray) -> list[np.ndarray]:
    """The COUNTS of one part as arrays [order, step]. weights: [mask, 3], all, good and toxic documents."""
    n_orders, n = orders.shape
    removed = np.zeros((3, n_orders, n), np.int64)
    mask, order = np.nonzero(steps < _NEVER)
    for k in range(3):
        np.add.at(removed[k], (order, steps[mask, order] - 1), weights[mask, k])
    bits = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(np.int64)
    fails, unique = weights[:, 0] @ bits, weights[1 << np.arange(n), 0]
    shapley = np.zeros(n, np.int64)
    np.add.at(shapley, orders.ravel(), removed[0].ravel())
    kept = weights[:, 0].sum() - removed[0].cumsum(axis=1)
    return [kept, removed[0], fails[orders] - removed[0], unique[orders], removed[1], removed[2], shapley[orders]]


def interaction_audit(counts: DataFrame, filters: str = "ABCDE", orders: Sequence[str] | None = None) -> DataFrame:
    """A row for each part, order and step. counts: part, mask, n, good, toxic, one row a part and mask."""
    names = list(orders or map("".join, permutations(filters)))
    table = np.array([[filters.index(c) for c in name] for name in names])
    if any(sorted(name) != sorted(filters) for name in names):
        raise ValueError("an order holds every filter once")
    n, steps = len(filters), removal_steps(len(filters), table)
    flat_names = pa.array(np.repeat(names, n))
    flat_steps = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(*(batch.column(c).to_pylist() for c in ("part", "cells"))):
                weights = np.zeros((1 << n, 3), np.int64)
                for c in cells:
                    weights[c["mask"]] += [c["n"], c["good"], c["toxic"]]
                values = [pa.array(v.ravel()) for v in order_counts(weights, table, steps)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(flat_steps)), flat_names, flat_steps, *values], names=["part", "filter_order", "step", *COUNTS])

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(run, OUT)


def audit_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return interaction_audit(document_masks(documents, labels))
