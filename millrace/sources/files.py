"""Lines of files, archives, charsets, databases, topics and paged services."""

from __future__ import annotations

import codecs
import datetime
import functools
import json
import os
import platform
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fields, joins
from . import archives as archives_of
from .archives import archives

ORDER = ["_mtime", "_source", "_block", "_line"]


def lines(spark: SparkSession, path: str, glob: str | None = None, ignore: str | None = None, newest_only_after: str | None = None, recursive: bool = False,
          line_sep: str | None = None, skip_first: bool = False, hidden: bool = False, ignore_suffixes: list[str] = (), newest: bool = False) -> DataFrame:
    """Lines with their file and an order key: modification time, file, block, position.

    newest: start at the files of the latest modification time; only names and times are read to find it.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if newest_only_after:
        reader = reader.option("modifiedAfter", newest_only_after)
    df = reader.text(path, lineSep=line_sep) if line_sep else reader.text(path)
    meta = "_metadata"
    df = df.select("value", F.col(f"{meta}.file_path").alias("_source"), F.col(f"{meta}.file_modification_time").alias("_mtime"),
                   F.col(f"{meta}.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    if ignore:
        df = df.where(~F.col("_source").rlike(ignore))
    if not hidden:
        df = df.where(~F.col("_source").rlike(r"/\.[^/]*$"))
    for suffix in ignore_suffixes:
        df = df.where(~F.col("_source").endswith(suffix))
    if newest:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
        for suffix in ignore_suffixes:
            listed = listed.where(~F.col("path").endswith(suffix))
        df = df.where(F.col("_mtime") >= F.lit(listed.agg(F.max("modificationTime")).first()[0]))
    if skip_first:
        first = df.where("_block = 0").groupBy("_source").agg(F.min("_line").alias("_first"))
        df = df.join(first, "_source", "left").where("_first is null or _line <> _first").drop("_first")
    return df


def stream_lines(spark: SparkSession, glob: str, max_files: int | None = None, max_age: str | None = None) -> DataFrame:
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_age:
        reader = reader.option("maxFileAge", max_age)
    return reader.text(glob).select("value", F.col("_metadata.file_path").alias("_source"))


def decoded(spark: SparkSession, path: str, charset: str, tag: str | None = None) -> DataFrame:
    """Lines of files in another charset, (_source, _block, _line, value), which the tag column names if asked.

    Any charset that Python has. Where the line feed is a byte of its own (all of ISO 8859 and Windows, GBK, GB 18030, Big5,
    Shift JIS, EUC and others), a file is split between tasks as bytes and its lines are decoded afterwards; of the rest
    (UTF-16, UTF-32, HZ, ISO 2022) a file is read as one stream. (_block, _line) orders a file's lines. Invalid bytes become
    U+FFFD. No empty line follows the last line feed.
    """
    if not archives_of.keeps_line_feed(charset):
        files = spark.read.format("binaryFile").load(path)
        whole = archives_of.streamed(files, lambda name: True, charset, plain=True)
        df = whole.select(F.col("archive").alias("_source"), F.lit(0).cast("bigint").alias("_block"), F.col("line_no").alias("_line"), "value")
    else:
        raw, name = F.col("value").cast("binary"), codecs.lookup(charset).name

        @F.pandas_udf("string")
        def in_charset(lines: pd.Series) -> pd.Series:
            return lines.map(lambda line: bytes(line).decode(charset, "replace"))

        value = F.make_valid_utf8("value") if name == "utf-8" else F.decode(raw, "ISO-8859-1") if name == "iso8859-1" else in_charset(raw)
        df = spark.read.text(path).select(F.col("_metadata.file_path").alias("_source"), F.col("_metadata.file_block_start").alias("_block"),
                                          F.monotonically_increasing_id().alias("_line"), "value")
        df = df.withColumn("value", value)
    return tagged(df, {tag: charset}) if tag else df


def auto(spark: SparkSession, path: str) -> DataFrame:
    """The reader that fits the path: archive, glob, folder or file."""
    if path.endswith((".tar", ".tar.gz", ".tgz", ".zip")):
        return archives(spark, path)
    return lines(spark, path)


def tagged(df: DataFrame, tags: dict) -> DataFrame:
    """Constant tags; existing values stay."""
    for k, v in tags.items():
        df = df.withColumn(k, F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v))
    return df


def tags_from(file: str | None = None, environment: str | None = None, host: bool = False, prefix: str = "", read_time: str | None = None) -> dict:
    """Tags for `tagged`: of a JSON file, then of a JSON environment variable, which wins; then facts of the driver's host
    under a prefix and the time of reading, where no tag has the name. A file or variable that is missing or no JSON object
    gives none."""

    def of(text: str | None) -> dict:
        try:
            found = json.loads(text) if text else {}
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    tags = {}
    if file and os.path.isfile(file):
        with open(file, encoding="utf-8") as f:
            tags |= of(f.read())
    tags |= of(os.environ.get(environment)) if environment else {}
    facts = {"hostname": platform.node(), "os": platform.system(), "arch": platform.machine(), "kernel": platform.release()} if host else {}
    tags = {prefix + k: v for k, v in facts.items()} | tags
    return ({read_time: F.current_timestamp()} if read_time else {}) | tags


def source_tag(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(name), F.col("_source")) if name in df.columns else F.col("_source"))


def range_query(sql: str, key: str, low, high, cast: str | None = None) -> str:
    """A half-open range around any query, as a subquery; cast the key where the database needs it."""
    k = f"CAST(q.{key} AS {cast})" if cast else f"q.{key}"
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM ({sql.rstrip().rstrip(';')}) q WHERE {k} >= {quoted(low)} AND {k} < {quoted(high)}"


def jdbc(spark: SparkSession, url: str, query: str, hints: dict[str, str] | None = None, **options: str) -> DataFrame:
    """A query of a database (MySQL, PostgreSQL, SQL Server: the driver is the user's); hints: column types."""
    return _hinted(spark.read.format("jdbc").options(url=url, query=query, **options).load(), hints)


def _hinted(df: DataFrame, hints: dict[str, str] | None) -> DataFrame:
    kinds = {"string": "string", "float": "double", "long": "bigint"}
    return df.withColumns({c: F.col(c).try_cast(kinds[k]) for c, k in (hints or {}).items() if c in df.columns})


def jdbc_range(spark: SparkSession, url: str, query: str, key: str, low, high, partitions: int = 8, cast: str | None = None,
               hints: dict[str, str] | None = None, **options: str) -> DataFrame:
    """Rows of a query with the key in [low, high), by number or time; the tasks read parts of the range side by side.

    A key that is text in the database needs a cast, as needs one that should be compared as another type.
    """
    table = f"({range_query(query, key, low, high, cast)}) q"
    if cast is None and partitions > 1:
        options |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return _hinted(df, hints)


def jdbc_tables(spark: SparkSession, url: str, pattern: str, begin: str | None = None, end: str | None = None, hints: dict[str, str] | None = None,
                listing: str = "SELECT table_name FROM information_schema.tables", tag: str | None = None, **options: str) -> DataFrame:
    """Whole tables whose name fits a pattern with time variables, of a time range, or all of history without one.

    The names (one a table) come to the driver by the listing query; columns that a table lacks are null in its rows.
    """
    names = sorted(r[0] for r in spark.read.format("jdbc").options(url=url, query=listing, **options).load().collect())
    names = joins.names_between(names, pattern, begin or "", end or "9")
    if not names:
        raise ValueError(f"no table fits {pattern}")
    read = lambda n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load()
    parts = [read(n).withColumn(tag, F.lit(n)) if tag else read(n) for n in names]
    return _hinted(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), hints)


def uuid_text(df: DataFrame, column: str) -> DataFrame:
    """16 bytes as a hyphenated UUID."""
    return df.withColumn(column, F.regexp_replace(F.lower(F.hex(column)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def offset_scan(df: DataFrame, key: str, after=None, until=None, inclusive: bool = False, where: Column | str | None = None, delay: str | None = None) -> DataFrame:
    """Rows of any connector beyond an offset and up to an end, in order; without an offset from the first on.

    where: the user's own filter, which holds besides. delay: an interval ('5 minutes'), for a key that is a time; rows
    younger than that before the end, or before now without one, are left for later.
    """
    c = F.col(key)
    if where is not None:
        df = df.where(where)
    if after is not None:
        df = df.where((c >= F.lit(after)) if inclusive else (c > F.lit(after)))
    end = F.lit(until) if until is not None else None
    if delay:
        end = (end.cast("timestamp") if end is not None else F.current_timestamp()) - F.expr(f"INTERVAL {delay}")
    return (df.where(c <= end) if end is not None else df).orderBy(key)


def dated_index(pattern: str, shift_hours: int = 0, at: datetime.datetime | None = None) -> str:
    """Name of an index with time variables, of so many hours before a time (now)."""
    return joins.expand_names(pattern, (at or datetime.datetime.now()) - datetime.timedelta(hours=shift_hours))


def kafka(spark: SparkSession, servers: str, topics: str, oldest: bool = True, max_offsets: int | None = None, stream: bool = True) -> DataFrame:
    """Messages of Kafka topics (needs the connector package); empty messages are skipped."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    reader = reader.option("startingOffsets", "earliest" if oldest else "latest")
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    df = reader.load().select(F.col("value").cast("string").alias("value"), F.col("topic").alias("_source"), "partition", "offset")
    return df.where("length(value) > 0")


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP server (development only), trimmed, without empty ones."""
    df = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return df.select(F.trim("value").alias("value")).where("value <> ''")


def pages(spark: SparkSession, url: str, first: int, last: int, fetch: Callable[[str], str] | None = None, partitions: int = 8,
          method: str = "GET", headers: dict[str, str] | None = None, body: str | None = None) -> DataFrame:
    """Bodies of a paged service, url and request body with {page}; a status other than 200 fails the task, which Spark retries."""

    def get(u: str, page: int) -> str:
        import urllib.request

        data = body.replace("{page}", str(page)).encode() if body else None
        with urllib.request.urlopen(urllib.request.Request(u, data, headers or {}, method=method), timeout=60) as r:
            if r.status != 200:
                raise OSError(f"status {r.status} for {u}")
            return r.read().decode()

    one = (lambda u, page: fetch(u)) if fetch else get

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"page": pdf["id"], "value": [one(url.replace("{page}", str(p)), p) for p in pdf["id"]]})

    return spark.range(first, last + 1, numPartitions=partitions).mapInPandas(run, "page long, value string")


def audit_objects(spark: SparkSession, top: str, record: str, days: tuple[str, str] | None = None, key: str = "Records", layout: str = "%Y/%m/%d",
                  stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Records of audit objects, JSON documents {key: [records]} in folders by day below top, one row for each record.

    days: first and last day (ISO), of which only the folders are listed; without them, all. As a stream each object is read
    once, since the stream's checkpoint knows those it has read, and new ones come with the next batch. record: its DDL.
    """
    path = f"{top.rstrip('/')}/"
    if days:
        first, last = (datetime.date.fromisoformat(d) for d in days)
        own = [(first + datetime.timedelta(i)).strftime(layout) for i in range((last - first).days + 1)]
        path += "{" + ",".join(own) + "}"
    reader = (spark.readStream if stream else spark.read).option("multiLine", True).option("recursiveFileLookup", True)
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    whole = reader.schema(T.StructType([T.StructField(key, T.ArrayType(T.DataType.fromDDL(record)))])).json(path)
    return fields.explode_records(whole.withColumn("_source", F.col("_metadata.file_path")), key)


def ordered_files(df: DataFrame, newest_first: bool = False) -> DataFrame:
    """Files of a line table by modification time."""
    files = df.groupBy("_source").agg(F.max("_mtime").alias("_mtime"), F.count("*").alias("n_lines"))
    return files.orderBy(F.desc("_mtime") if newest_first else F.asc("_mtime"), "_source")


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("line_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
