"""Totals by key that grow by micro-batches, each counted once.

A batch's sums by key are written to a folder of its own, named by the batch and committed as a whole; a batch that comes
again finds its folder and adds nothing. The totals are the last base plus the batches behind it. Now and then these are
merged to a new base, so that reading stays cheap; rows are kept in buckets of their keys, so that one key reads one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators.aggregates import accumulate


class Totals:
    """keys: columns; sums: field to the name of its total; schema: DDL of keys and totals, in this order."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: dict[str, str], buckets: int = 16):
        self.spark, self.path, self.keys, self.sums, self.buckets = spark, path.rstrip("/"), keys, sums, buckets

    def _numbers(self, part: str) -> list[int]:
        return [int(n) for n in storage.names(self.spark, f"{self.path}/{part}") if n.isdigit()]

    def _base(self) -> int:
        """Number of the last batch that the newest base holds, -1 without a base."""
        return max([-1, *self._numbers("base")])

    def _bucket(self):
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets)).alias("_bucket")

    def add(self, df: DataFrame, batch_id: int) -> bool:
        """Add a batch; False if it was there already."""
        if batch_id <= self._base():
            return False
        sums = accumulate(df, self.keys, self.sums).select("*", self._bucket())
        return storage.write_once(sums, f"{self.path}/batch/{batch_id:012d}", by=["_bucket"])

    def _parts(self) -> list[str]:
        base = self._base()
        bases = [f"{self.path}/base/{base:012d}"] if base >= 0 else []
        return bases + [f"{self.path}/batch/{n:012d}" for n in self._numbers("batch") if n > base]

    def read(self, **key) -> DataFrame:
        """The totals by now, of all keys or of one, of which only its bucket is read."""
        parts = self._parts()
        if not parts:
            raise ValueError("no batch was added")
        rows = None
        for p in parts:
            own = self.spark.read.parquet(p)
            rows = own if rows is None else rows.unionByName(own)
        if key:
            kinds = dict(rows.dtypes)
            bucket = self.spark.range(1).select(F.pmod(F.hash(*[F.lit(key[k]).cast(kinds[k]) for k in self.keys]), F.lit(self.buckets))).first()[0]
            rows = rows.where(F.col("_bucket") == bucket)
            for k in self.keys:
                rows = rows.where(F.col(k).eqNullSafe(F.lit(key[k])))
        return rows.groupBy(*self.keys).agg(*[F.sum(n).alias(n) for n in self.sums.values()])

    def merge(self) -> None:
        """Make a base of all batches by now; what the base before held is removed, the last one's batches stay for readers."""
        before, last = self._base(), max([-1, *self._numbers("batch")])
        if last <= before:
            return
        storage.write_once(self.read().select("*", self._bucket()).repartition("_bucket"), f"{self.path}/base/{last:012d}", by=["_bucket"])
        for part, numbers in (("base", [n for n in self._numbers("base") if n < before]), ("batch", [n for n in self._numbers("batch") if n <= before])):
            for n in numbers:
                storage.remove(self.spark, f"{self.path}/{part}/{n:012d}")

    def stream(self, rows: DataFrame, checkpoint: str, merge_every: int = 20, **trigger):
        """Add every micro-batch of a stream; a restart on the same checkpoint counts none twice."""

        def batch(df: DataFrame, batch_id: int) -> None:
            self.add(df, batch_id)
            if batch_id % merge_every == merge_every - 1:
                self.merge()

        return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
