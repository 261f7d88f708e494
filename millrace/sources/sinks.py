"""Sinks: writers, and projections that render rows for them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegralType, MapType, NumericType, StringType, StructType

from ..paths import unused


def json_files(df: DataFrame, path: str, time: str | None = None, parts: dict[str, str] | None = None, n_folders: int | None = None, array_of: int | None = None) -> None:
    """JSON lines below folders by time (name to date pattern) or in n balanced folders.

    array_of: each line is an array of up to so many neighbouring records of one folder.
    """
    fields = df.columns
    at = F.col(time) if time else F.current_timestamp()
    df = df.withColumns({k: F.date_format(at, p) for k, p in (parts or {}).items()})
    by = list(parts or {})
    if n_folders:
        df, by = df.withColumn("partition", F.pmod(F.monotonically_increasing_id(), F.lit(n_folders))), [*by, "partition"]
    if array_of:
        rows = df.select(*by, F.monotonically_increasing_id().alias("_id"), F.to_json(F.struct(*fields)).alias("_row"))
        batch = rows.groupBy(*by, F.expr(f"_id div {int(array_of)}").alias("_batch")).agg(F.sort_array(F.collect_list(F.struct("_id", "_row"))).alias("_rows"))
        lines = batch.select(*by, F.concat(F.lit("["), F.array_join("_rows._row", ","), F.lit("]")).alias("value"))
        return (lines.write.partitionBy(*by) if by else lines.write).mode("append").text(path)
    return (df.write.partitionBy(*by) if by else df.write).mode("append").json(path)


def raw_files(df: DataFrame, path: str, column: str = "raw") -> None:
    df.select(F.regexp_replace(column, r"\n$", "").alias("value")).write.mode("append").text(path)


def flat_text(df: DataFrame, fields: list[str]) -> DataFrame:
    """Declared fields, nested ones as JSON text; a field that is missing is null."""
    nested = (StructType, ArrayType, MapType)
    return df.select(*[
        F.lit(None).cast("string").alias(f) if f not in df.columns else (F.to_json(f).alias(f) if isinstance(df.schema[f].dataType, nested) else F.col(f)) for f in fields
    ])


def csv_files(df: DataFrame, path: str, fields: list[str], sep: str = ",", max_records: int | None = None, max_bytes: int | None = None) -> None:
    """Files of at most so many records, or of at most so many bytes, reckoned by the longest row (one more pass)."""
    flat = flat_text(df, fields)
    if max_bytes:
        row = F.to_csv(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]), {"sep": sep})
        longest = flat.agg(F.max(F.octet_length(row))).first()[0]
        max_records = max(1, max_bytes // ((longest or 0) + 1))
    writer = flat.write.mode("append")
    (writer.option("maxRecordsPerFile", max_records) if max_records else writer).csv(path, sep=sep)


def sql_inserts(df: DataFrame, table: str) -> Column:
    """INSERT statement of each row: sorted columns, quoted text, nested values as JSON."""
    names = sorted(df.columns)
    flat = {f.name: f.dataType for f in df.schema}

    def value(n: str) -> Column:
        kind, c = flat[n], F.col(n)
        if isinstance(kind, (StructType, ArrayType, MapType)):
            c = F.to_json(c)
        if isinstance(kind, NumericType):
            return F.coalesce(c.cast("string"), F.lit("NULL"))
        return F.coalesce(F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))

    return F.concat(F.lit(f"INSERT INTO {table} ({', '.join(names)}) VALUES ("), F.concat_ws(", ", *[value(n) for n in names]), F.lit(");"))


def jdbc_append(df: DataFrame, url: str, table: str, **properties: str) -> None:
    flat_text(df, sorted(df.columns)).write.jdbc(url, table, "append", properties)


def kafka_rows(df: DataFrame, topic: str, topic_field: str | None = None) -> DataFrame:
    """(value, topic): the record as JSON, the topic from a field with a fallback."""
    to = F.coalesce(F.nullif(F.col(topic_field).cast("string"), F.lit("")), F.lit(topic)) if topic_field else F.lit(topic)
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"), to.alias("topic"))


def documents(df: DataFrame, index: str, time: str | None = None, pattern: str | None = None, id_field: str | None = None, aliases: dict | None = None) -> DataFrame:
    """(index, id, doc) of a search engine: dated index name, id from a field."""
    name = F.concat(F.lit(f"{index}-"), F.date_format(time, pattern)) if pattern else F.lit(index)
    key = F.col(id_field).cast("string") if id_field else F.lit(None).cast("string")
    body = F.to_json(F.struct(*[F.col(c).alias((aliases or {}).get(c, c)) for c in df.columns]))
    return df.select(name.alias("index"), key.alias("id"), body.alias("doc"))


def http_bodies(df: DataFrame, batch: str, order: str, mode: str = "body_json", header: bool = True, template: str | None = None) -> DataFrame:
    """One request body for each batch: json (lines), body_json (an array), csv (all columns) or raw (a template)."""
    fields = [c for c in df.columns if c != batch]
    if mode in ("json", "body_json"):
        row = F.to_json(F.struct(*fields))
    elif mode == "csv":
        text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit(""))
        quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        row = F.concat_ws(",", *[quoted(text(f)) for f in fields])
    else:
        row = F.lit(template)
        for f in fields:
            row = F.replace(row, F.lit("${" + f + "}"), F.coalesce(F.col(f).cast("string"), F.lit("")))
    grouped = df.select(batch, F.struct(F.col(order).alias("o"), row.alias("r")).alias("x")).groupBy(batch).agg(F.sort_array(F.collect_list("x")).alias("_x"))
    lines = F.array_join(F.col("_x.r"), "," if mode == "body_json" else "\n")
    if mode == "body_json":
        lines = F.concat(F.lit("["), lines, F.lit("]"))
    if mode == "csv" and header:
        lines = F.concat(F.lit(",".join(fields) + "\n"), lines)
    return grouped.select(batch, lines.alias("body"))


def post(bodies: DataFrame, url: str, send: Callable[[str, str], None] | None = None, zipped: bool = False, headers: dict[str, str] | None = None) -> None:
    """POST each body from the tasks, gzip-compressed if asked; a failure fails the task, which Spark retries."""

    def default(u: str, body: str) -> None:
        import gzip
        import urllib.request

        data, own = body.encode(), dict(headers or {})
        if zipped:
            data, own = gzip.compress(data), own | {"Content-Encoding": "gzip"}
        with urllib.request.urlopen(urllib.request.Request(u, data, own, method="POST"), timeout=60) as r:
            if r.status >= 300:
                raise OSError(f"status {r.status}")

    one = send or default
    bodies.select("body").foreach(lambda row: one(url, row["body"]))


def line_protocol(df: DataFrame, measurement: str, tags: list[str], fields: list[str], time: str | None = None) -> DataFrame:
    """Time-series text lines: sorted escaped tags, sorted fields, microsecond times in ns. Rows without a field go, as do
    fields that are no finite number; line breaks are written as backslash n in texts and blanks in tags."""
    esc = lambda c: F.regexp_replace(F.translate(c, "\r\n", "  "), r"([ ,=])", r"\\$1")
    name = lambda n, marks=" ,=": re.sub(f"([{marks}])", r"\\\1", n)
    kinds = {f.name: f.dataType for f in df.schema}

    def field(n: str) -> Column:
        c = F.col(n)
        if isinstance(kinds[n], IntegralType):
            v = F.concat(c.cast("string"), F.lit("i"))
        elif isinstance(kinds[n], StringType):
            v = F.concat(F.lit('"'), F.replace(F.replace(F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit('"'))
        elif isinstance(kinds[n], (DoubleType, FloatType)):
            v = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("string"))
        else:
            v = c.cast("string")
        return F.concat(F.lit(f"{name(n)}="), v)

    tag = [F.when(F.col(t).cast("string") != "", F.concat(F.lit(f",{name(t)}="), esc(F.col(t).cast("string")))) for t in sorted(tags)]
    head = F.concat(F.lit(name(measurement, " ,")), *[F.coalesce(t, F.lit("")) for t in tag])
    body = F.concat_ws(",", *[field(f) for f in sorted(fields)])
    (whole,) = unused(df.columns, "_body")
    out = F.concat(head, F.lit(" "), F.col(whole))
    if time:
        out = F.concat(out, F.lit(" "), (F.unix_micros(time) * 1000).cast("string"))
    return df.withColumn(whole, body).where(F.col(whole) != "").select(out.alias("value"))


def throw_away(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()
