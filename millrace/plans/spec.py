"""Pipeline spec: read, pre-parse filters, parse, tags, transforms, route, sinks as one DataFrame plan.

A spec is a dict: {"pre": [...], "parser": {...}, "tags": {...}, "transforms": [...], "route": {...}}, each step
{"type": name, **arguments}. The same function runs on a batch and on a stream.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import paths, storage
from ..errors import COLUMN, split_errors, with_error
from ..functions import convert, dates, text
from ..operators import aggregates, fields, joins
from ..sources import files, http, parse
from ..sources import sinks as sinks_
from ..streaming import delivery
from ..streaming.status import Status

PARSERS: dict[str, Callable[..., DataFrame]] = {
    "csv": parse.delimited, "json": parse.jsonl, "grok": parse.grok, "nginx": parse.access_log, "kv": parse.key_value, "logfmt": parse.key_value,
    "linuxaudit": parse.audit, "syslog": parse.syslog, "mysqllog": parse.slow_log, "headerlog": parse.header_log, "kafkarest": parse.rest_proxy,
    "raw": parse.raw, "empty": parse.empty,
}


def _on_field(fn):
    """A column function as a step: key, optional new name."""

    def step(df: DataFrame, key: str, new: str | None = None, **args) -> DataFrame:
        value = fn(paths.get(df, key), **args)
        df = with_error(df, paths.get(df, key).isNotNull() & value.isNull(), fn.__name__, key, "no value")
        return paths.put(df, new or key, value)

    return step


def _concat(df: DataFrame, keys: list[str], new: str, joiner: str = "") -> DataFrame:
    value = text.concatenated([paths.get(df, k) for k in keys], joiner)
    return paths.put(with_error(df, value.isNull(), "concat", ",".join(keys), "missing input"), new, value)


def _url_params(df: DataFrame, key: str, new: str | None = None, select_keys: list[str] = ()) -> DataFrame:
    """Parameters, path and host of an url as a map, or the selected ones as columns of their own."""
    found = text.url_params(paths.get(df, key), key)
    if not select_keys:
        return paths.put(df, new or f"{key}_params", found)
    (held,) = paths.unused(df.columns, "_params")
    df = df.withColumn(held, found)
    return df.withColumns({f"{key}_{k}": F.try_element_at(held, F.lit(f"{key}_{k}")) for k in select_keys}).drop(held)


TRANSFORMS: dict[str, Callable[..., DataFrame]] = {
    "filter": fields.filter_rows, "filter_lines": fields.filter_lines, "max_line": fields.short_lines, "discard": lambda df, keys: paths.drop(df, *keys),
    "pick": lambda df, keys: paths.pick(df, *keys), "rename": fields.rename, "copy": fields.copy, "label": fields.label,
    "normalise_names": fields.normalise_names, "json": fields.parse_json, "keyvalue": fields.parse_key_values, "xml": fields.parse_xml,
    "arrayexpand": fields.expand_array, "cloudtrail": fields.explode_records, "convert": convert.convert, "concat": _concat, "script": fields.script,
    "case": _on_field(text.change_case), "replace": _on_field(text.replaced), "split": _on_field(text.split_by), "substring": _on_field(text.byte_slice),
    "trim": _on_field(text.trimmed), "urlconvert": _on_field(text.url_text), "number2ip": _on_field(text.ipv4_text), "date": _on_field(dates.reformatted),
    "timestamp": _on_field(dates.epoch), "urlparam": _url_params, "mapreplace": joins.map_replace, "ip": joins.ip_ranges, "useragent": joins.user_agent,
    "redis": parse.redis_log, "tode": parse.tode_log, "k8stag": parse.container_path,
}


def register(kind: str, name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a parser, transform, source or sink of one's own."""
    {"parser": PARSERS, "transform": TRANSFORMS, "source": SOURCES, "sink": SINKS}[kind][name] = fn


def compose(df: DataFrame, spec: dict) -> DataFrame:
    """The plan of a spec over a table of lines or records."""
    known = {"pre", "parser", "tags", "transforms", "route"}
    if extra := set(spec) - known:
        raise ValueError(f"unknown parts {sorted(extra)}")
    for step in spec.get("pre", []):
        df = _apply(df, step, TRANSFORMS)
    if "parser" in spec:
        df = _apply(df, spec["parser"], PARSERS)
    df = files.tagged(df, spec.get("tags", {}))
    for step in spec.get("transforms", []):
        df = _apply(df, step, TRANSFORMS)
    if "route" in spec:
        df = aggregates.route(df, **spec["route"])
    return df


def _apply(df: DataFrame, step: dict, registry: dict) -> DataFrame:
    return _known(registry, step["type"])(df, **{k: v for k, v in step.items() if k != "type"})


def _known(registry: dict, name: str) -> Callable:
    if name not in registry:
        raise ValueError(f"unknown step {name}")
    return registry[name]


def preview(df: DataFrame, spec: dict, n: int = 10) -> DataFrame:
    """The same plan over a few rows (at most 100)."""
    return compose(df.limit(min(n, 100)), spec)


def write_routed(df: DataFrame, sinks: list[Callable[[DataFrame], None]], dead: Callable[[DataFrame], None] | None = None) -> None:
    """Each row to the sink of its route, in one cached pass; a route that no sink has goes to the first one, the default;
    rows with errors to dead, if given."""
    good, bad = split_errors(df) if dead else (df, None)
    good = good.persist()
    try:
        for i, sink in enumerate(sinks):
            own = F.col("_route") == i
            own = own | F.col("_route").isNull() | ~F.col("_route").between(0, len(sinks) - 1) if i == 0 else own
            sink(good.where(own).drop("_route"))
        if dead:
            dead(bad)
    finally:
        good.unpersist()


def _check_routes(spec: dict, n_sinks: int) -> None:
    """A spec's routes must lead to sinks that there are."""
    if route := spec.get("route"):
        if lost := {n for n in [route.get("default", 0), *(r[2] for r in route["routes"])] if not 0 <= n < n_sinks}:
            raise ValueError(f"routes to sinks {sorted(lost)} of {n_sinks}")


def run_stream(stream: DataFrame, spec: dict, sinks: list[Callable], checkpoint: str, dead: Callable[[DataFrame], None] | None = None,
               folder: str | None = None, query: str = "stream", status: Status | None = None, **trigger):
    """The spec on each micro-batch, rows with errors to dead, if given; offsets are committed after all sinks succeeded.

    folder: sinks are those of streaming.delivery, and every row comes once; the folder keeps the ledger of this query name
    and the letters of rows that a sink does not take. status: gets the good and bad rows of each batch.
    """

    _check_routes(spec, len(sinks))

    routed = "route" in spec

    def send(rows: DataFrame, batch_id: int) -> None:
        if folder is None:
            each = sinks if routed else [lambda d: [s(d) for s in sinks]]
            return write_routed(rows if routed else rows.withColumn("_route", F.lit(0)), each, dead)
        good, bad = split_errors(rows) if dead else (rows, None)
        if routed:
            delivery.deliver_routed(good, sinks, folder, query, batch_id)
        else:
            delivery.deliver(good, {f"sink{i}": s for i, s in enumerate(sinks)}, folder, query, batch_id)
        if dead:
            delivery.deliver(bad, {"errors": dead if hasattr(dead, "has") else delivery.plain(dead)}, folder, f"{query}-errors", batch_id)

    def counted(rows: DataFrame, batch_id: int, began: float) -> None:
        bad = F.coalesce(F.size(COLUMN) > 0, F.lit(False)) if COLUMN in rows.columns else F.lit(False)
        said = F.max(F.when(bad, F.col(COLUMN)[0]["message"])) if COLUMN in rows.columns else F.lit(None).cast("string")
        n, failed, message = rows.agg(F.count(F.lit(1)), F.count_if(bad), said).first()
        status.add(query, "spec", batch_id, n - failed, failed, message, seconds=time.time() - began)

    def batch(df: DataFrame, batch_id: int) -> None:
        spark, rows, began = df.sparkSession, compose(df, spec), time.time()
        held = f"{folder}/composed/{query}-{batch_id}"
        if folder is not None:
            # The rows of a batch that is tried again, whatever the plan makes of it then.
            storage.write_once(rows, held)
            rows = spark.read.schema(rows.schema).parquet(held)
        elif status is not None:
            rows = rows.persist()
        send(rows, batch_id)
        if status is not None:
            counted(rows, batch_id, began)
        if folder is not None:
            storage.remove(spark, held)
        elif status is not None:
            rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: Sources and sinks that a spec can name; more may be registered.
SOURCES: dict[str, Callable[..., DataFrame]] = {
    "dir": files.lines, "file": files.lines, "tailx": files.lines, "dirx": files.lines, "fileauto": files.auto, "archive": files.archives,
    "charset": files.decoded, "jdbc": files.jdbc, "jdbc_range": files.jdbc_range, "jdbc_tables": files.jdbc_tables,
    "cloudtrail": files.audit_objects, "kafka": files.kafka, "socket": files.socket, "httpfetch": files.pages, "paged": http.paged,
    "parquet": lambda spark, path: spark.read.parquet(path),
}
SINKS: dict[str, Callable[..., None]] = {
    "file": sinks_.json_files, "raw": sinks_.raw_files, "csv": sinks_.csv_files, "mysql": sinks_.jdbc_append, "discard": sinks_.throw_away,
    "sqlfile": lambda df, path, table: df.select(sinks_.sql_inserts(df, table).alias("value")).write.mode("append").text(path),
    "parquet": lambda df, path: df.write.mode("append").parquet(path),
    "http": lambda df, url, marks, delivery, batch, order, mode="body_json", **o: http.send_bodies(sinks_.http_bodies(df, batch, order, mode), url, marks, delivery, **o),
    "influxdb": lambda df, path, **o: sinks_.line_protocol(df, **o).write.mode("append").text(path),
    "kafka": lambda df, servers, topic, topic_field=None: sinks_.kafka_rows(df, topic, topic_field).write.format("kafka").option("kafka.bootstrap.servers", servers).save(),
    "elasticsearch": lambda df, format="es", options=None, **o: sinks_.documents(df, **o).write.format(format).options(**(options or {})).mode("append").save(),
}


def run(spark: SparkSession, config: dict) -> None:
    """A whole pipeline from its config: `source` (a type and its arguments), the parts of a spec, `sinks` (a list of types
    and arguments, routed by number if the spec has a route, else each gets all rows) and maybe `dead` (one sink for rows
    with errors)."""
    config = dict(config)
    source, sinks, dead = config.pop("source"), config.pop("sinks"), config.pop("dead", None)
    own = lambda registry, step: functools.partial(_known(registry, step["type"]), **{k: v for k, v in step.items() if k != "type"})
    writers = [own(SINKS, s) for s in sinks]
    _check_routes(config, len(sinks))
    df = compose(own(SOURCES, source)(spark), config)
    if "route" not in config:
        each = writers
        writers = [lambda d: [w(d) for w in each]]
        df = df.withColumn("_route", F.lit(0))
    write_routed(df, writers, own(SINKS, dead) if dead else None)
