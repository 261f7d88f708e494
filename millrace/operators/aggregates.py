"""Aggregations, pivots, windows, routing and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import with_error
from ..paths import unused
from ..storage import materialise
from .fields import statistic_name


def accumulate(df: DataFrame, keys: list[str], sums: dict[str, str], stored: DataFrame | None = None) -> DataFrame:
    """Totals of fields (name to output name) by keys, added to stored totals."""
    new = df.groupBy(*keys).agg(*[F.sum(F.col(c).try_cast("double")).alias(n) for c, n in sums.items()])
    if stored is None:
        return new
    both = stored.select(*keys, *sums.values()).unionByName(new)
    return both.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums.values()])


def period_statistics(df: DataFrame, time: str, value: str, metric: str, dims: list[str], period: str, delay: str | None = None) -> DataFrame:
    """Average, maximum, minimum, sum and number of samples by period and dimensions."""
    if delay:
        df = df.withWatermark(time, delay)
    stats = {"average": F.avg, "maximum": F.max, "minimum": F.min, "sum": F.sum, "sample_count": F.count}
    out = df.groupBy(F.window(time, period), *dims).agg(*[f(value).alias(statistic_name(metric, n)) for n, f in stats.items()])
    return out.select(F.col("window.start").alias("period_start"), *dims, *[statistic_name(metric, n) for n in stats])


def select_series(df: DataFrame, names: list[str], dims: dict[str, str]) -> DataFrame:
    """Series by metric name and dimensions; * or an empty pattern is any, all listed dimensions must match."""
    from fnmatch import translate

    out = df.where(F.col("name").isin(names)) if names else df
    for k, pattern in dims.items():
        out = out.where(F.col(f"dims.{k}").isNotNull() if pattern in ("", "*") else F.regexp_like(F.col(f"dims.{k}"), F.lit("^" + translate(pattern).replace(r"\Z", "$").replace(r"\z", "$"))))
    return out


def to_wide(df: DataFrame, by: list[str], field: str, value: str, fields: list[str]) -> DataFrame:
    """Long (by, field, value) to one row for each by."""
    return df.groupBy(*by).pivot(field, fields).agg(F.first(value, ignorenulls=True))


#: Kinds of virtual machine metrics, and the tag that names their endpoint.
ENDPOINT_TAGS = {"vm": "vmname", "host": "esxhostname", "datastore": "dsname", "cluster": "clustername", "datacenter": "dcname"}


def endpoint(metric: Column, tags: dict[str, Column], default: str, sep: str = ".") -> Column:
    """What a sample is of: its own endpoint tag, else the tag of its kind of machine (empty if missing), else the default."""
    known = F.lit(default)
    for kind, tag in reversed(ENDPOINT_TAGS.items()):
        named = F.coalesce(tags[tag].cast("string"), F.lit("")) if tag in tags else F.lit("")
        known = F.when(metric.startswith(f"vsphere{sep}{kind}{sep}"), named).otherwise(known)
    return F.coalesce(tags["endpoint"].cast("string"), known) if "endpoint" in tags else known


def to_samples(df: DataFrame, keep: list[str], values: list[str], tags: list[str], default: str, step: int, sep: str = ".") -> DataFrame:
    """Rows of to_long as gauge samples with their endpoint and step in seconds."""
    own = [t for t in tags if t == "endpoint" or t in ENDPOINT_TAGS.values()]
    carried = df.withColumns({f"_tag_{t}": F.col(t) for t in own})
    rows = to_long(carried, [*keep, *[f"_tag_{t}" for t in own]], values, tags)
    rows = rows.withColumn("endpoint", endpoint(F.col("metric"), {t: F.col(f"_tag_{t}") for t in own}, default, sep))
    return rows.withColumns({"step": F.lit(step), "counter_type": F.lit("GAUGE")}).drop(*[f"_tag_{t}" for t in own])


def to_long(df: DataFrame, keep: list[str], values: list[str], tags: list[str] = ()) -> DataFrame:
    """One row for each numeric field, with the tags as sorted k=v text."""
    tag_text = F.array_join(F.array(*[F.concat(F.lit(f"{t}="), F.col(t).cast("string")) for t in sorted(tags)]), ",") if tags else None
    rows = df.select(*keep, *([tag_text.alias("tags")] if tags else []), *[F.col(f"`{v}`").try_cast("double").alias(v) for v in values])
    ids = [*keep, *(["tags"] if tags else [])]
    return rows.unpivot(ids, [f"`{v}`" for v in values], "metric", "value").where("value is not null")


def health(status: DataFrame) -> DataFrame:
    """Success and error totals, and the last error, of each stage's batches (stage, ok, failed, message, at)."""
    return status.groupBy("stage").agg(
        F.sum("ok").alias("ok"), F.sum("failed").alias("failed"),
        F.max_by("message", F.when(F.col("message").isNotNull(), F.col("at"))).alias("last_error"), F.count("*").alias("batches"),
    )


def probe(df: DataFrame, key: str, after=None) -> DataFrame:
    """Number of rows and smallest key above a position."""
    df = df if after is None else df.where(F.col(key) > F.lit(after))
    return df.agg(F.count("*").alias("n_rows"), F.min(key).alias("first_key"))


def distinct_records(df: DataFrame) -> DataFrame:
    """Rows of different content; the content is compared by its hash and itself."""
    return df.dropDuplicates()


def record_hash(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def by_content(df: DataFrame) -> DataFrame:
    """Rows in the order of their JSON with sorted keys."""
    return df.orderBy(F.to_json(F.struct(*sorted(df.columns))))


def counter_share(df: DataFrame, by: list[str], time: str, value: str, total: str, out: str = "percent") -> DataFrame:
    """Counters to the percentage of the total's change since the sample before; first samples and no change give no row,
    a total that falls (a counter that began anew) gives a row without a percentage and an error."""
    dv, dt = unused(df.columns, "_dv", "_dt")
    w = Window.partitionBy(*by).orderBy(time)
    rows = df.withColumn(dv, F.col(value) - F.lag(value).over(w)).withColumn(dt, F.col(total) - F.lag(total).over(w)).where(F.col(dt) != 0)
    rows = with_error(rows, F.col(dt) < 0, "counter", total, "the total fell")
    return rows.withColumn(out, F.when(F.col(dt) > 0, 100.0 * F.col(dv) / F.col(dt))).drop(dv, dt)


def speed(df: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Change of a total by second, and whether it goes up, down or stays, against the speed before."""
    w = Window.partitionBy(*by).orderBy(time)
    seconds = F.unix_micros(F.col(time)) / 1e6
    rows = df.withColumn("speed", (F.col(value) - F.lag(value).over(w)) / F.nullif(seconds - F.lag(seconds).over(w), F.lit(0.0)))
    before = F.lag("speed").over(w)
    trend = F.when(F.col("speed") > before, "up").when(F.col("speed") < before, "down").when(F.col("speed").isNotNull(), "stable")
    return rows.withColumn("trend", trend)


def event_numbers(df: DataFrame, head: Column, by: str, order: list[str], column: str = "_event") -> DataFrame:
    """df with the running number of events of each source (by), where a head line begins a new one, and `_range`.

    Lines are numbered within ranges of the order, then the heads of a source's ranges before are added: a source with
    most of the lines is spread over many tasks.
    """
    ranges = df.withColumn("_head", F.when(head, 1).otherwise(0)).repartitionByRange(by, *order)
    # Written once: a range that is drawn again could have other bounds.
    ranges = materialise(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_by").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    heads = ranges.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_r")).agg(F.sum("_head").alias("_n"))
    heads = heads.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy(by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranges.withColumn("_own", F.sum("_head").over(inside))
    joined = rows.join(heads, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    return joined.select(*df.columns, (F.col("_base") + F.col("_own")).alias(column), "_range")


#: Predicates of routes, by name; more may be registered.
MATCHES = {
    "equal": lambda c, v: c.cast("string") == v,
    "contains": lambda c, v: c.cast("string").contains(v),
}


def register_match(name: str, predicate) -> None:
    MATCHES[name] = predicate


def route(df: DataFrame, key: str, routes: list[tuple[str, str, int]], default: int = 0, column: str = "_route") -> DataFrame:
    """Number of the one sink of each row: the first route (match, value, sink) that holds, else the default."""
    out = F.lit(default)
    for match, value, sink in reversed(routes):
        out = F.when(F.coalesce(MATCHES[match](F.col(key), value), F.lit(False)), F.lit(sink)).otherwise(out)
    return df.withColumn(column, out)


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of tables with differing columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def not_done(names: DataFrame, ledger: DataFrame, key: str = "name") -> DataFrame:
    return names.join(ledger.select(key).distinct(), key, "left_anti")


def first_at_or_after(df: DataFrame, key: str, position) -> DataFrame:
    return df.where(F.col(key) >= F.lit(position)).orderBy(key).limit(1)
