"""Error channel: operators note what went wrong in `_errors`, rows are never lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMN = "_errors"
KIND = "array<struct<op:string,key:string,message:string>>"


def with_error(df: DataFrame, when: Column, op: str, key: str, message: str | Column) -> DataFrame:
    """Append an entry to the rows where the condition holds (null counts as no); the message may be made from the row."""
    message = F.lit(message) if isinstance(message, str) else message
    before = F.col(COLUMN) if COLUMN in df.columns else F.lit(None).cast(KIND)
    before = F.coalesce(before, F.array().cast(KIND))
    entry = F.array(F.struct(F.lit(op).alias("op"), F.lit(key).alias("key"), message.alias("message")))
    return df.withColumn(COLUMN, F.when(F.coalesce(when, F.lit(False)), F.concat(before, entry)).otherwise(before))


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without an entry (its column dropped) and rows with one."""
    if COLUMN not in df.columns:
        return df, df.limit(0)
    bad = F.coalesce(F.size(COLUMN) > 0, F.lit(False))
    return df.where(~bad).drop(COLUMN), df.where(bad)


def observed(df: DataFrame, name: str) -> DataFrame:
    """df with success and error counts and the greatest error text as observed metrics, for batch and streaming."""
    bad = F.coalesce(F.size(COLUMN) > 0, F.lit(False)) if COLUMN in df.columns else F.lit(False)
    said = F.when(bad, F.concat_ws(": ", F.col(COLUMN)[0]["key"], F.col(COLUMN)[0]["message"])) if COLUMN in df.columns else F.lit(None).cast("string")
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("errors"), F.max(said).alias("message"))
