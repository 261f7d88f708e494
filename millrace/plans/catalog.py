"""Registered queries of the library's own operators, each over whole tables, with its SQL."""

from __future__ import annotations

import datetime
import functools
import tempfile
import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors, paths, storage
from ..functions import convert, dates, text
from ..operators import aggregates as A
from ..operators import fields, joins
from ..sources import files, parse, sinks
from ..storage import shared_dir
from ..streaming import delivery, pull, status, totals
from . import spec

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def t(spark, sf_dir: str, name: str) -> DataFrame:
    """A table; its zone-less timestamps become instants of the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def access_lines(spark, sf_dir: str) -> DataFrame:
    """Access-log lines of the events; every 97th is broken."""
    e = t(spark, sf_dir, "events")
    line = F.concat(
        F.lit("10.0."), (F.col("user_id") % 250).cast("string"), F.lit(".7 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'),
        F.col("event_type"), F.lit(' HTTP/1.1" '), (F.col("event_id") % 3 * 100 + 200).cast("string"), F.lit(" "), F.col("event_id").cast("string"),
    )
    return e.select(F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("broken "), line)).otherwise(line).alias("value"))


ACCESS = {"ACCESS": r'%{IPORHOST:clientip} %{USER:ident} %{USER:auth} \[%{HTTPDATE:ts:date}\] "(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})" %{NUMBER:response:long} (?:%{NUMBER:bytes:long}|-)'}

SPEC = {
    "parser": {"type": "grok", "patterns": ["^%{ACCESS}$"], "custom": ACCESS},
    "tags": {"env": "test"},
    "transforms": [
        {"type": "filter", "keys": ["request"], "pattern": "^/"},
        {"type": "replace", "key": "request", "old": "/", "to": ""},
        {"type": "case", "key": "request", "mode": "upper", "new": "kind"},
    ],
    "route": {"key": "response", "routes": [("equal", "200", 1), ("contains", "3", 2)], "default": 0},
}

FLAGSHIP_SQL = """
SELECT CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS route, upper(event_type) AS kind, 'test' AS env, count(*) AS n,
       sum(event_id)::BIGINT AS bytes, min(date_trunc('second', ts)) AS first_ts
FROM events WHERE event_id % 97 <> 0 GROUP BY ALL"""


@query(FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    df = spec.compose(access_lines(spark, sf_dir), SPEC)
    return df.groupBy(F.col("_route").alias("route"), "kind", "env").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("ts").alias("first_ts")
    )


@query("SELECT (event_id % 97 = 0) AS bad, count(*) AS n FROM events GROUP BY ALL")
def error_channel(spark, sf_dir):
    df = parse.grok(access_lines(spark, sf_dir), ["^%{COMMONAPACHELOG}$"])
    return df.groupBy((F.size("_errors") > 0).alias("bad")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type AS kind, round(value, 6) AS value, date_trunc('second', ts) AS at, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def p1_delimited(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    line = F.concat_ws("\t", "event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "props")
    schema = [("event_id", "long"), ("user_id", "long"), ("kind", "string"), ("value", "float"), ("at", "date"), ("props", "jsonmap")]
    df = parse.delimited(e.select(line.alias("value")).withColumnRenamed("value", "value"), schema)
    return df.select("event_id", "user_id", "kind", F.round("value", 6).alias("value"), "at", F.col("props")["k"].alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def p2_json(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    line = F.to_json(F.struct("event_id", F.from_json("props", "k long").alias("props")))
    df = parse.jsonl(e.select(line.alias("value")), "event_id long, props struct<k:long>")
    return df.select("event_id", F.col("props.k").alias("k"))


@query("SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_custkey, o_orderkey FROM orders")
def p2_json_arrays(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    pair = F.to_json(F.array(F.create_map(F.lit("o_orderkey"), F.col("o_orderkey"), F.lit("o_custkey"), F.col("o_custkey")), F.create_map(F.lit("o_orderkey"), F.col("o_custkey"), F.lit("o_custkey"), F.col("o_orderkey"))))
    return parse.jsonl(o.select(pair.alias("value")), "o_orderkey long, o_custkey long").select("o_orderkey", "o_custkey")


@query("SELECT event_id AS num, event_type AS word FROM events")
def p3_grok(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    df = parse.grok(e.select(F.concat_ws(" ", "event_id", "event_type").alias("value")), ["%{WORD:word}=%{NUMBER:num:long}$", "^%{NUMBER:num:long} %{GREEDYDATA:word}$"])
    return df.select("num", "word")


@query("SELECT event_id AS bytes_sent, 200 + event_id % 3 * 100 AS status, event_type AS agent, date_trunc('second', ts) AS time_local FROM events")
def p4_access_log(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    line = F.concat(F.lit("1.2.3.4 - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET / HTTP/1.1" '), (F.col("event_id") % 3 * 100 + 200).cast("string"), F.lit(" "), F.col("event_id").cast("string"), F.lit(' "'), F.col("event_type"), F.lit('"'))
    df = parse.access_log(e.select(line.alias("value")), '$remote_addr - [$time_local] "$request" $status $bytes_sent "$agent"', {"status": "long", "bytes_sent": "long", "time_local": "date"})
    return df.select("bytes_sent", "status", "agent", "time_local")


@query("SELECT event_id, event_type || ' x' AS kind FROM events")
def p5_key_value(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    line = F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit("  kind="), F.col("event_type"), F.lit(' x lvl="7"'))
    df = parse.key_value(e.select(line.alias("value")))
    return df.select(F.col("fields")["id"].cast("bigint").alias("event_id"), F.col("fields")["kind"].alias("kind"))


@query("SELECT event_id::VARCHAR AS msg_id, event_type AS dev, user_id::VARCHAR AS dev_1, make_timestamp(epoch_us(date_trunc('second', ts)) + 243000) AS msg_timestamp FROM events")
def p6_audit(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    line = F.concat(F.lit("type=PATH msg=audit("), F.unix_seconds("ts").cast("string"), F.lit(".243:"), F.col("event_id").cast("string"), F.lit("): dev="), F.col("event_type"), F.lit(' dev="'), F.col("user_id").cast("string"), F.lit('"'))
    return parse.audit(e.select(line.alias("value"))).select("msg_id", F.col("fields")["dev"].alias("dev"), F.col("fields")["dev_1"].alias("dev_1"), "msg_timestamp")


@query("SELECT (event_id % 192)::INT AS priority, ((event_id % 192) // 8)::INT AS facility, ((event_id % 192) % 8)::INT AS severity, event_type AS message, user_id::VARCHAR AS proc_id, count(*) AS n FROM events GROUP BY ALL")
def p7_syslog(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    line = F.concat(F.lit("<"), (F.col("event_id") % 192).cast("string"), F.lit(">1 2003-10-11T22:14:15.003Z host app "), F.col("user_id").cast("string"), F.lit(' ID47 [x@1 a="b"] '), F.col("event_type"))
    df = parse.syslog(e.select(line.alias("value")))
    return df.groupBy("priority", "facility", "severity", "message", "proc_id").agg(F.count("*").alias("n"))


@query("SELECT event_id AS \"Rows_sent\", user_id AS \"Rows_examined\", 'SELECT ' || event_type AS \"Statement\", date_trunc('second', ts) AS \"Timestamp\" FROM events")
def p8_slow_log(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    body = F.concat(F.lit("# Time: x\n# User@Host: a[a] @ localhost [127.0.0.1]  Id: 3\n# Query_time: 0.5  Lock_time: 0.1 Rows_sent: "), F.col("event_id").cast("string"), F.lit("  Rows_examined: "), F.col("user_id").cast("string"),
                    F.lit("\nSET timestamp="), F.unix_seconds("ts").cast("string"), F.lit(";\nuse foo;\nSELECT "), F.col("event_type"), F.lit("\n#"))
    return parse.slow_log(e.select(body.alias("value"))).select("Rows_sent", "Rows_examined", "Statement", "Timestamp")


@query("SELECT event_type AS log, 'INFO' AS level, date_trunc('second', ts) AS time, count(*) AS n FROM events GROUP BY ALL")
def p9_header_log(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(" [Wm0AAPg-IUMW-68U][INFO] bdc.go:573: "), F.col("event_type"))
    df = parse.header_log(e.select(line.alias("value")), ["prefix", "date", "time", "reqid", "level", "file"])
    return df.groupBy("log", "level", "time").agg(F.count("*").alias("n"))


@query("SELECT event_id AS resp_len, user_id AS duration, event_type AS topic, 200::BIGINT AS code FROM events")
def p10_rest_proxy(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    # sixteen tokens: code, length and duration are the 13th to 15th
    line = F.concat(F.lit("[2016-12-05 03:35:20,682] INFO 172.16.16.191 - - [05/Dec/2016:03:35:20 +0000] \"POST /topics/"), F.col("event_type"), F.lit(" HTTP/1.1\" x 200 "), F.col("event_id").cast("string"), F.lit(" "), F.col("user_id").cast("string"), F.lit(" (end)"))
    return parse.rest_proxy(e.select(line.alias("value"))).select("resp_len", "duration", "topic", "code")


@query("SELECT user_id AS pid, 'slave' AS role, 'notice' AS level, event_type AS message, count(*) AS n FROM events GROUP BY ALL")
def p13_redis(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    line = F.concat(F.col("user_id").cast("string"), F.lit(":S 19 May 18:11:58.145 * "), F.col("event_type"))
    return parse.redis_log(e.select(line.alias("value"))).groupBy("pid", "role", "level", "message").agg(F.count("*").alias("n"))


@query("SELECT 'INFO' AS level, 'unknown' AS host, user_id::VARCHAR AS pid, event_type AS message, count(*) AS n FROM events GROUP BY ALL")
def p14_tode(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    line = F.concat(F.lit("[00:00:07 413]INFO::srv:"), F.col("user_id").cast("string"), F.lit(":[x.cpp:11]:  "), F.col("event_type"))
    return parse.tode_log(e.select(line.alias("value"))).groupBy("level", "host", "pid", "message").agg(F.count("*").alias("n"))


@query("SELECT 'pod-' || user_id AS pod, event_type AS namespace, 'admin' AS container_name, event_id::VARCHAR AS container_id FROM events WHERE event_type NOT LIKE '%\\_%' ESCAPE '\\'")
def p15_container_path(spark, sf_dir):
    e = t(spark, sf_dir, "events").where(~F.col("event_type").contains("_"))
    path = F.concat(F.lit("/var/logs/containers/pod-"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_type"), F.lit("_admin-"), F.col("event_id").cast("string"), F.lit(".log"))
    return parse.container_path(e.select(path.alias("path")), "path").select("pod", "namespace", "container_name", "container_id")


@query("SELECT c_custkey FROM customer WHERE coalesce(regexp_matches(c_mktsegment, '^A'), false) OR coalesce(regexp_matches(c_name, '7$'), false)")
def f1_filter(spark, sf_dir):
    return fields.filter_rows(t(spark, sf_dir, "customer"), ["c_mktsegment", "c_name", "none"], "^A|7$", "keep").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE contains(text, 'License') AND strlen(text) <= 4000")
def f2_f11_lines(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return fields.short_lines(fields.filter_lines(d, "License", "pick", "text"), 4000, "text").select("doc_id")


def _nested(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("bal")).alias("acct")).alias("multi"))


@query("SELECT c_custkey, c_name AS name FROM customer")
def f3_discard(spark, sf_dir):
    return paths.drop(_nested(spark, sf_dir), "multi.acct.bal").select("c_custkey", "multi.*")


@query("SELECT c_acctbal AS bal FROM customer")
def f4_pick(spark, sf_dir):
    return paths.pick(_nested(spark, sf_dir), "multi.acct").select("multi.acct.bal")


@query("SELECT c_custkey, 'name' AS inner_fields, 'c_custkey,multi' AS fields, c_name AS name FROM customer")
def f4_pick_leaves_the_rest(spark, sf_dir):
    """What was not picked is gone, also beside a picked field."""
    df = paths.pick(_nested(spark, sf_dir), "c_custkey", "multi.name", "multi.none", "none")
    return df.select("c_custkey", F.lit(",".join(df.schema["multi"].dataType.fieldNames())).alias("inner_fields"), F.lit(",".join(df.columns)).alias("fields"), "multi.name")


@query("SELECT c_custkey, c_name AS title FROM customer")
def f5_rename(spark, sf_dir):
    return fields.rename(_nested(spark, sf_dir), "multi.name", "multi.acct.title").select("c_custkey", "multi.acct.title")


@query("SELECT c_custkey, c_name AS copied, c_name AS kept, 'x' AS tag FROM customer")
def f6_f7_copy_label(spark, sf_dir):
    df = fields.copy(_nested(spark, sf_dir), "multi.name", "copied")
    df = df.withColumn("kept", F.col("multi.name"))
    df = fields.label(fields.label(df, "kept", "other"), "tag", "x")
    return df.select("c_custkey", "copied", "kept", "tag")


@query('SELECT n_nationkey AS "K1_key", n_name AS a_b FROM nation')
def f8_names(spark, sf_dir):
    return fields.normalise_names(t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("1-key"), F.col("n_name").alias("_a。b")))


@query("SELECT o_orderkey AS id, o_totalprice::BIGINT AS price, o_orderstatus FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice, o_orderstatus FROM orders)")
def f9_conform(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("string").alias("o_totalprice"), "o_orderstatus")
    return fields.conform(o, "o_orderkey id, o_totalprice price, ...", {"o_totalprice": "bigint", "o_orderkey": "bigint"})


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS customer, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status,
          CASE WHEN o_orderkey % 5 = 0 THEN 'o_custkey not of type bigint;' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'state required;' ELSE '' END AS notes FROM orders""")
def f9_conform_reports(spark, sf_dir):
    """Values that their type does not take and required fields that are missing are named in the errors column."""
    o, third = t(spark, sf_dir, "orders"), F.col("o_orderkey") % 3 > 0
    customer = F.when(F.col("o_orderkey") % 5 == 0, F.lit("none")).otherwise(F.col("o_custkey").cast("string"))
    o = o.select("o_orderkey", customer.alias("o_custkey"), F.when(third, F.col("o_orderstatus")).alias("state"))
    df = fields.conform(o, "o_orderkey id, o_custkey customer, state status", {"o_custkey": "bigint"}, report=True, required=["state"])
    notes = F.array_join(F.transform(errors.COLUMN, lambda e: F.concat(e["key"], F.lit(" "), e["message"], F.lit(";"))), "")
    return df.select("id", "customer", "status", notes.alias("notes"))


@query("SELECT user_id, 'web' AS host, round(sum(value), 4) AS cpu__value FROM events GROUP BY user_id")
def f12_metric_rows(spark, sf_dir):
    df = fields.metric_rows(t(spark, sf_dir, "events"), "cpu", ["props", "event_type", "event_id"], {"host": "web"}, ["user_id", "ts"])
    return df.groupBy("user_id", "host").agg(F.round(F.sum("cpu__value"), 4).alias("cpu__value"))


@query("""SELECT p_partkey, upper(p_name) AS up, p_name || '/' || p_brand AS joined, replace(p_type, ' ', '_') AS rep, string_split(p_name, ' ')[1] AS first,
          substr(p_brand, 2, 3) AS part, trim(p_brand, 'B#') AS trimmed FROM part""")
def x1_x6_text(spark, sf_dir):
    p, c = t(spark, sf_dir, "part"), F.col
    return p.select(
        "p_partkey", text.change_case(c("p_name"), "upper").alias("up"), text.concatenated([c("p_name"), c("p_brand")], "/").alias("joined"), text.replaced(c("p_type"), " ", "_").alias("rep"),
        F.get(text.split_by(c("p_name"), " "), F.lit(0)).alias("first"), text.byte_slice(c("p_brand"), 1, 4).alias("part"), text.trimmed(c("p_brand"), "B#").alias("trimmed"),
    )


@query("SELECT doc_id, text FROM documents")
def x7_url_round_trip(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", text.url_text(text.url_text(F.col("text"), "encode"), "decode").alias("text"))


@query("""SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/?]+)', 1), '') AS host, coalesce(regexp_extract(url, '^[a-z]+://[^/?]+(/[^?]*)', 1), '') AS path FROM pages""")
def x8_url_params(spark, sf_dir):
    p = t(spark, sf_dir, "pages").withColumn("m", text.url_params(F.col("url"), "u"))
    return p.select("page_id", F.coalesce(F.col("m")["u_url_param_host"], F.lit("")).alias("host"), F.coalesce(F.col("m")["u_url_param_path"], F.lit("")).alias("path"))


@query("""SELECT event_id, event_type || '&' || user_id AS a, CASE WHEN event_id % 2 = 0 THEN 'x y' END AS b, '/p/' || event_type AS path, NULL::VARCHAR AS gone FROM events""")
def x8_url_parameters(spark, sf_dir):
    """Repeated, escaped, empty and missing parameters."""
    c = F.col
    url = F.concat(F.lit("http://h.org/p/"), c("event_type"), F.lit("?a="), c("event_type"), F.lit("&gone=&a="), c("user_id").cast("string"), F.when(c("event_id") % 2 == 0, "&b=x%20y").otherwise("&c"))
    e = t(spark, sf_dir, "events").withColumn("m", text.url_params(url, "u"))
    of = lambda k: F.try_element_at(c("m"), F.lit(k))
    return e.select("event_id", of("u_a").alias("a"), of("u_b").alias("b"), of("u_url_param_path").alias("path"), of("u_gone").alias("gone"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x9_json_field(spark, sf_dir):
    return fields.parse_json(t(spark, sf_dir, "events"), "props", "k long", extract=True, drop=True).select("event_id", "k")


@query("SELECT event_id, user_id::VARCHAR AS u FROM events")
def x10_key_value_field(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("raw", F.concat(F.lit('u="'), F.col("user_id").cast("string"), F.lit('" z=1')))
    return fields.parse_key_values(e, "raw", "kv").select("event_id", F.col("kv")["u"].alias("u"))


@query("SELECT event_id, event_type AS to, user_id AS id FROM events")
def x11_xml_field(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("x", F.concat(F.lit("<note><to>"), F.col("event_type"), F.lit('</to><from attr="f"><id>'), F.col("user_id").cast("string"), F.lit("</id></from></note>")))
    return fields.parse_xml(e.select("event_id", "x"), "x", "to string, from struct<`-attr`:string, id:bigint>", expand=True, no_attr=True, drop=True).select("event_id", "to", "id")


@query("SELECT o_orderkey, o_custkey::DOUBLE AS cust, len(o_orderpriority) > 0 AS flag, o_custkey AS second FROM orders")
def x12_convert(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cust"), F.lit("true").alias("flag"), F.array(F.lit("1"), F.col("o_custkey").cast("string")).alias("arr"))
    return convert.convert(o, "cust float, flag bool, arr a(l)").select("o_orderkey", "cust", "flag", F.get("arr", F.lit(1)).alias("second"))


@query("SELECT o_orderkey, date_trunc('second', o_orderdate) AS at, epoch_ms(date_trunc('second', o_orderdate))::BIGINT AS ms, (epoch(o_orderdate)::BIGINT // 86400 * 86400)::BIGINT AS day, strftime(o_orderdate, '%Y/%m/%d') AS again FROM orders")
def x13_x16_dates(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss").alias("d"), F.unix_seconds("o_orderdate").alias("s"))
    return o.select("o_orderkey", dates.parsed(F.concat("d", F.lit(" -0000"))).alias("at"), dates.epoch(F.col("d"), "ms").alias("ms"), text.floored(F.col("s"), 86400).alias("day"), dates.reformatted(F.col("d"), after="yyyy/MM/dd").alias("again"))


@query("SELECT event_id, ((event_id * 65537) % 4294967296 // 16777216) || '.' || ((event_id * 65537) % 16777216 // 65536) || '.' || ((event_id * 65537) % 65536 // 256) || '.' || ((event_id * 65537) % 256) AS ip FROM events")
def x17_ip(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", text.ipv4_text(F.pmod(F.col("event_id") * 65537, F.lit(1 << 32))).alias("ip"))


@query("SELECT p_partkey, p_brand AS a0, p_type AS a1 FROM part")
def x18_array_expand(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", F.array("p_brand", "p_type").alias("a"))
    return fields.expand_array(p, "a", 2).select("p_partkey", "a0", "a1")


@query("SELECT doc_id, CASE WHEN strlen(text) > 4000 THEN strlen(text) - 4000 ELSE 0 END AS rest FROM documents")
def x20_shorten(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", text.shortened(F.col("text"), 4000).alias("s"))
    return d.select("doc_id", F.coalesce(F.nullif(F.regexp_extract("s", r"remain (\d+) bytes\)$", 1), F.lit("")).try_cast("bigint"), F.lit(0)).alias("rest"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders")
def x21_explode_records(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus", F.lit(-1).alias("o_custkey"))).alias("Records"))
    return fields.explode_records(o).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT doc_id, text, greatest(1, ceil(length(text) / 500.0))::BIGINT AS parts FROM documents WHERE text IS NOT NULL")
def x22_split_rejoin(spark, sf_dir):
    d = t(spark, sf_dir, "documents").where("text is not null")
    pieces = fields.split_value(d.select("doc_id", "text"), "text", 500, F.col("doc_id"))
    n = pieces.groupBy("part_id").agg(F.count("*").alias("parts"))
    return fields.rejoin_value(pieces, "text").join(n, "part_id").select(F.col("part_id").alias("doc_id"), "text", "parts")


@query("SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def j1_map_replace(spark, sf_dir):
    table = t(spark, sf_dir, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
    return joins.map_replace(t(spark, sf_dir, "customer").withColumn("nation", F.col("c_nationkey").cast("string")), "nation", table).select("c_custkey", "nation")


@query("SELECT event_id, n_name AS country FROM events LEFT JOIN nation ON n_nationkey = (user_id * 131) % 3276800 // 131072")
def j2_ip_ranges(spark, sf_dir):
    ranges = t(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("bigint") * 131072).alias("start"), (F.col("n_nationkey").cast("bigint") * 131072 + 131071).alias("end"), F.col("n_name").alias("country"))
    e = t(spark, sf_dir, "events").withColumn("ip", text.ipv4_text(F.col("user_id") * 131 % 3276800))
    return joins.ip_ranges(e, "ip", ranges).select("event_id", "country")


@query("SELECT event_id, CASE WHEN event_type LIKE 'c%' THEN 'C' WHEN event_type LIKE '%e%' THEN 'E' END AS \"UA_agent_family\" FROM events")
def j3_user_agent(spark, sf_dir):
    rules = spark.createDataFrame([(1, "agent", "^c", "C"), (2, "agent", "e", "E")], "rule_no int, kind string, regex string, family string")
    return joins.user_agent(t(spark, sf_dir, "events"), "event_type", rules).select("event_id", "UA_agent_family")


@query("SELECT s_suppkey, n_name AS tag FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j4_inherit_tags(spark, sf_dir):
    top = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("tag"))
    return joins.inherit_tags(t(spark, sf_dir, "supplier"), top, "s_nationkey", ["tag"]).select("s_suppkey", "tag")


@query("SELECT user_id, round(2 * sum(value), 4) AS total FROM events GROUP BY user_id")
def a1_accumulate(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    once = A.accumulate(e, ["user_id"], {"value": "total"})
    return A.accumulate(e, ["user_id"], {"value": "total"}, once).select("user_id", F.round("total", 4).alias("total"))


@query("SELECT date_trunc('hour', ts) AS period_start, event_type, round(avg(value), 6) AS load_average, max(value) AS load_maximum, min(value) AS load_minimum, round(sum(value), 4) AS load_sum, count(value) AS load_sample_count FROM events GROUP BY ALL")
def a2_period_statistics(spark, sf_dir):
    df = A.period_statistics(t(spark, sf_dir, "events"), "ts", "value", "Load", ["event_type"], "1 hour")
    return df.withColumn("load_average", F.round("load_average", 6)).withColumn("load_sum", F.round("load_sum", 4))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id::VARCHAR LIKE '1%'")
def a3_select_series(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("z"), F.lit("q")).alias("dims"))
    return A.select_series(e, ["click"], {"user": "1*", "z": "*"}).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def a4_a5_long_wide(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    long = A.to_long(li.withColumn("rid", F.monotonically_increasing_id()), ["rid", "l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])
    return A.to_wide(long, ["rid", "l_orderkey", "l_linenumber"], "metric", "value", ["l_quantity", "l_tax"]).drop("rid")


@query("SELECT event_type AS stage, count(*) AS batches, sum(user_id)::BIGINT AS ok, max(event_id)::VARCHAR AS last_error FROM events GROUP BY event_type")
def a6_health(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("ok"), F.lit(0).alias("failed"), F.col("event_id").cast("string").alias("message"), F.col("event_id").alias("at"))
    return A.health(e).select("stage", "batches", "ok", "last_error")


@query("SELECT count(*) AS n_rows, min(event_id) AS first_key FROM events WHERE event_id > 100")
def a7_probe(spark, sf_dir):
    return A.probe(t(spark, sf_dir, "events"), "event_id", 100)


@query("SELECT DISTINCT user_id, event_type FROM events")
def a8_distinct(spark, sf_dir):
    return A.distinct_records(t(spark, sf_dir, "events").select("user_id", "event_type"))


@query("""SELECT user_id, event_id, percent FROM (SELECT user_id, event_id, round(100.0 * (event_id - lag(event_id) OVER w) / (3 * (event_id - lag(event_id) OVER w)), 6) AS percent
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE percent IS NOT NULL""")
def w1_counter_share(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("total", F.col("event_id") * 3)
    return A.counter_share(e, ["user_id"], "event_id", "event_id", "total").select("user_id", "event_id", F.round("percent", 6).alias("percent"))


@query("""SELECT user_id, event_id, CASE WHEN s > p THEN 'up' WHEN s < p THEN 'down' WHEN s IS NOT NULL THEN 'stable' END AS trend FROM (
          SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY tm) AS p FROM (
          SELECT user_id, event_id, tm, (event_id * event_id % 1009 - lag(event_id * event_id % 1009) OVER w)::DOUBLE / (epoch_us(tm) / 1e6 - lag(epoch_us(tm) / 1e6) OVER w) AS s
          FROM (SELECT *, make_timestamp(event_id * 1000000) AS tm FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY tm)))""")
def w2_speed(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", F.timestamp_seconds("event_id").alias("at"), (F.col("event_id") * F.col("event_id") % 1009).alias("v"))
    return A.speed(e, ["user_id"], "at", "v").select("user_id", "event_id", "trend")


@query("""SELECT user_id, n AS event_no, string_agg(event_id::VARCHAR, chr(10) ORDER BY event_id) AS value FROM (
          SELECT user_id, event_id, sum((event_id % 5 = 0)::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS n FROM events) GROUP BY ALL""")
def r1_assemble(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("_source"), F.col("event_id").alias("_order"), F.col("event_id").cast("string").alias("value"))
    return pull.assemble(e, "[05]$").withColumnRenamed("_source", "user_id")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 2 WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS route FROM orders")
def u1_route(spark, sf_dir):
    df = A.route(t(spark, sf_dir, "orders"), "o_orderpriority", [("contains", "URGENT", 2), ("equal", "5-LOW", 1)])
    return df.select("o_orderkey", F.col("_route").alias("route"))


@query("SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def u2_union(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return A.union_all(c, t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")))


@query("SELECT DISTINCT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u3_not_done(spark, sf_dir):
    names = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name")).distinct()
    return A.not_done(names, t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name")))


@query("SELECT * FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 3000")
def r4_range(spark, sf_dir):
    return pull.in_range(t(spark, sf_dir, "orders"), "o_orderkey", 1000, 3000)


@query("SELECT event_id FROM events WHERE event_id >= 500 AND NOT (event_id = 500)")
def r5_unseen(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return pull.unseen(e, "event_id", 500, pull.boundary(e.where("event_id <= 500"), "event_id")).select("event_id")


@query("SELECT event_id FROM events WHERE strftime(ts, '%H:%M') >= '22:30' OR strftime(ts, '%H:%M') < '06:00'")
def r9_time_of_day(spark, sf_dir):
    return t(spark, sf_dir, "events").where(dates.in_time_of_day(F.col("ts"), "22:30", "06:00")).select("event_id")


@query("SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey >= 777")
def t2_first_after(spark, sf_dir):
    return A.first_at_or_after(t(spark, sf_dir, "orders"), "o_orderkey", 777).select("o_orderkey")


@query("SELECT 'INSERT INTO nation (n_name, n_nationkey) VALUES (''' || replace(n_name, '''', '''''') || ''', ' || n_nationkey || ');' AS value FROM nation")
def k5_sql_text(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.select(sinks.sql_inserts(n, "nation").alias("value"))


@query("SELECT user_id % 16 AS b, '[' || string_agg('{\"event_id\":' || event_id || '}', ',' ORDER BY event_id) || ']' AS body FROM events GROUP BY ALL")
def k9_http_bodies(spark, sf_dir):
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("b"), "event_id")
    return sinks.http_bodies(e, "b", "event_id")


@query("SELECT 'm,type=' || event_type || ' id=' || event_id || 'i,kind=\"' || event_type || '\" ' || (epoch_us(ts) * 1000) AS value FROM events")
def k10_line_protocol(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("event_type").alias("kind"), F.col("event_id").alias("id"), "ts")
    return sinks.line_protocol(e, "m", ["type"], ["kind", "id"], "ts")


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value, CASE WHEN n_regionkey = 1 THEN 'def' ELSE 'r' || n_regionkey END AS topic FROM nation")
def k7_kafka_rows(spark, sf_dir):
    n = t(spark, sf_dir, "nation").withColumn("topic", F.when(F.col("n_regionkey") != 1, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))))
    rows = sinks.kafka_rows(n.select("n_nationkey", "n_name", "topic"), "def", "topic")
    return rows.select(F.regexp_replace("value", r',"topic":"[^"]*"', "").alias("value"), "topic")


@query("SELECT DISTINCT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def u3_not_done_large(spark, sf_dir):
    names = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"))
    return A.not_done(names.distinct(), t(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("name")))


@query("""SELECT user_id, event_id, CASE WHEN dt > 0 THEN round(100.0 * dv / dt, 6) END AS percent, dt < 0 AS fell FROM (
          SELECT user_id, event_id, event_id % 7 - lag(event_id % 7) OVER w AS dv, event_id * 7919 % 1009 - lag(event_id * 7919 % 1009) OVER w AS dt
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE dt <> 0""")
def w1_counter_reset(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7).alias("used"), (F.col("event_id") * 7919 % 1009).alias("total"))
    rows = A.counter_share(e, ["user_id"], "event_id", "used", "total")
    return rows.select("user_id", "event_id", F.round("percent", 6).alias("percent"), (F.size("_errors") > 0).alias("fell"))


@query("SELECT event_id, event_type || '+%26' || user_id || '%3D%2F' AS encoded, event_type || ' &' || user_id || '=/' AS decoded FROM events")
def x7_url_texts(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    plain = F.concat("event_type", F.lit(" &"), F.col("user_id").cast("string"), F.lit("=/"))
    coded = F.concat("event_type", F.lit("%20%26"), F.col("user_id").cast("string"), F.lit("%3d/"))
    return e.select("event_id", text.url_text(plain, "encode").alias("encoded"), text.url_text(coded, "decode").alias("decoded"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN 7 WHEN 2 THEN 2 ELSE 7 END AS n, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS bad,
          o_orderstatus = 'F' AS flag, o_custkey + 1 AS a, o_custkey AS head, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS s
          FROM orders""")
def x12_convert_kinds(spark, sf_dir):
    """A number, a text, a fraction and an empty text in one field; texts of flags, maps and lists; a number that fails."""
    o = t(spark, sf_dir, "orders")
    c, kind = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    rows = o.select(
        "o_orderkey", F.when(kind == 0, c).when(kind == 1, F.lit("x1")).when(kind == 2, F.lit("2.9")).otherwise(F.lit("")).alias("n"),
        F.when(F.col("o_orderstatus") == "F", "true").otherwise("false").alias("flag"), F.concat(F.lit('{"a":'), (F.col("o_custkey") + 1).cast("string"), F.lit("}")).alias("m"),
        F.concat(F.lit("["), c, F.lit(",3]")).alias("arr"), F.when(F.col("o_orderkey") % 3 == 0, c).otherwise(F.lit("none")).alias("s"),
    )
    done = convert.convert(rows, "n long 7, flag bool, m map{a long}, arr a(l), s l")
    return done.select("o_orderkey", "n", F.size("_errors").alias("bad"), "flag", F.col("m.a").alias("a"), F.get("arr", F.lit(0)).alias("head"), "s")


@query("""SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'Silk' WHEN 1 THEN 'Mozilla' END AS "UA_agent_family", CASE user_id % 3 WHEN 0 THEN (user_id % 9)::VARCHAR END AS "UA_agent_version",
          CASE WHEN user_id % 2 = 0 AND user_id % 3 < 2 THEN 'Mac OS' END AS "UA_os_family", CASE WHEN user_id % 2 = 0 AND user_id % 3 < 2 THEN event_type END AS "UA_os_version" FROM events""")
def j3_user_agent_groups(spark, sf_dir):
    rules = spark.createDataFrame(
        [(3, "agent", "Mozilla", "Mozilla"), (1, "agent", r"(Silk)/(\d+)", None), (2, "agent", "Opera", "Opera"), (4, "os", r"\((Mac) (\w+)\)", "Mac OS")],
        "rule_no int, kind string, regex string, family string",
    )
    u = F.col("user_id")
    agent = F.when(u % 3 == 2, F.lit("curl/7")).otherwise(F.concat(
        F.lit("Mozilla/5.0 ("), F.when(u % 2 == 0, F.concat(F.lit("Mac "), "event_type")).otherwise(F.lit("X11")), F.lit(")"),
        F.when(u % 3 == 0, F.concat(F.lit(" Silk/"), (u % 9).cast("string"), F.lit(".1"))).otherwise(F.lit("")),
    ))
    e = t(spark, sf_dir, "events").withColumn("ua", agent)
    return joins.user_agent(e, "ua", rules).select("event_id", "UA_agent_family", "UA_agent_version", "UA_os_family", "UA_os_version")


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"' || CASE WHEN n_regionkey = 1 THEN '' ELSE ',"topic":"r' || n_regionkey || '"' END || '}' AS value,
          CASE WHEN n_regionkey = 1 THEN 'def' ELSE 'r' || n_regionkey END AS topic FROM nation""")
def k7_kafka_values(spark, sf_dir):
    n = t(spark, sf_dir, "nation").withColumn("topic", F.when(F.col("n_regionkey") != 1, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))))
    return sinks.kafka_rows(n.select("n_nationkey", "n_name", "topic"), "def", "topic")


def _batches(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.select(F.expr("event_id div 50").alias("b"), "event_id", F.concat("event_type", F.lit(',"'), F.col("user_id").cast("string")).alias("kind"))


@query("""SELECT event_id // 50 AS b, string_agg('{"event_id":' || event_id || ',"kind":"' || event_type || ',\\"' || user_id || '"}', chr(10) ORDER BY event_id) AS body FROM events GROUP BY ALL""")
def k9_http_json_lines(spark, sf_dir):
    return sinks.http_bodies(_batches(spark, sf_dir), "b", "event_id", "json")


@query("""SELECT event_id // 50 AS b, 'event_id,kind' || chr(10) || string_agg(event_id || ',"' || event_type || ',""' || user_id || '"', chr(10) ORDER BY event_id) AS body FROM events GROUP BY ALL""")
def k9_http_csv(spark, sf_dir):
    return sinks.http_bodies(_batches(spark, sf_dir), "b", "event_id", "csv")


@query("""SELECT event_id // 50 AS b, string_agg(event_id || ':' || event_type || ',"' || user_id || ';', chr(10) ORDER BY event_id) AS body FROM events GROUP BY ALL""")
def k9_http_template(spark, sf_dir):
    return sinks.http_bodies(_batches(spark, sf_dir), "b", "event_id", "raw", template="${event_id}:${kind};")


def _folder(spark) -> str:
    return shared_dir(spark)


@query("SELECT event_id, event_type, value FROM events")
def k1_s1_json_files(spark, sf_dir):
    """Records to JSON files below folders by day, and back through the spec's JSON parser from the folder's lines."""
    path = _folder(spark)
    sinks.json_files(t(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts"), path, "ts", {"day": "yyyyMMdd"})
    back = files.lines(spark, path, glob="*.json", recursive=True)
    return parse.jsonl(back, "event_id long, event_type string, value double").select("event_id", "event_type", "value")


@query("SELECT event_id % 4 AS k, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL")
def k2_balanced_folders(spark, sf_dir):
    path = _folder(spark)
    sinks.json_files(t(spark, sf_dir, "events").select("event_id"), path, n_folders=4)
    back = spark.read.schema("event_id long, partition int").json(path).where("partition between 0 and 3")
    return back.groupBy((F.col("event_id") % 4).alias("k")).agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("SELECT o_orderkey::VARCHAR AS value FROM orders UNION ALL SELECT o_orderpriority FROM orders")
def k3_s8_raw_delimited(spark, sf_dir):
    """Raw records of two lines, written as they are and read back by another delimiter than the line's end."""
    o, path = t(spark, sf_dir, "orders"), _folder(spark)
    sinks.raw_files(o.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("|"), "o_orderpriority", F.lit("|")).alias("raw")), path)
    back = files.lines(spark, path, line_sep="|").select(F.trim(F.translate("value", "\n", "")).alias("value"))
    return back.where("value <> ''")


@query("SELECT n_nationkey, n_name, '{\"r\":' || n_regionkey || '}' AS sub, NULL::VARCHAR AS gone FROM nation")
def k4_csv_files(spark, sf_dir):
    path = _folder(spark)
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.struct(F.col("n_regionkey").alias("r")).alias("sub"))
    sinks.csv_files(n, path, ["n_nationkey", "n_name", "sub", "gone"], "\t")
    return spark.read.schema("n_nationkey int, n_name string, sub string, gone string").csv(path, sep="\t")


@query("""SELECT 'orders-' || strftime(o_orderdate, '%Y.%m') AS index, o_orderkey::VARCHAR AS id, '{"key":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS doc FROM orders""")
def k8_documents(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    rows = sinks.documents(o, "orders", "o_orderdate", "yyyy.MM", "o_orderkey", {"o_orderkey": "key"})
    return rows.select("index", "id", F.regexp_replace("doc", r',"o_orderdate":"[^"]*"', "").alias("doc"))


@query("SELECT event_type AS value, event_type AS kind, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY ALL")
def s3_s9_globs_and_tags(spark, sf_dir):
    """Lines of one file for each kind of event; those of one kind are ignored by their path, which tags the rest."""
    path = _folder(spark)
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_type").alias("value"))
    e.write.partitionBy("kind").text(path)
    back = files.source_tag(files.lines(spark, path, recursive=True, ignore="kind=click"), "kind")
    return back.groupBy("value", F.regexp_extract("kind", "kind=([^/]+)", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS raw, 'x' AS env, count(*) AS n FROM events GROUP BY ALL")
def p11_p12_raw(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("value"))
    both = parse.raw(e, labels={"env": "x"}).where("timestamp <= current_timestamp()").select("raw", "env")
    return both.unionByName(parse.empty(e).select(F.col("value").alias("raw"), F.lit("none").alias("env"))).groupBy("raw", "env").agg(F.count("*").alias("n"))


@query('SELECT n_nationkey AS "key", n_name AS name, n_regionkey FROM nation')
def f10_alias(spark, sf_dir):
    return fields.aliased(t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), {"n_nationkey": "key", "n_name": "name", "none": "x"})


@query("""SELECT o_orderkey, CASE WHEN make_date(1998, month(o_orderdate), least(day(o_orderdate), 28)) > DATE '1998-06-15' THEN 1997 ELSE 1998 END AS y, month(o_orderdate) AS m FROM orders""")
def x15_year_of_dates_without(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    day = F.date_format(F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.least(F.dayofmonth("o_orderdate"), F.lit(28))), "MMM d")
    at = dates.with_year(F.concat(day, F.lit(" 10:00:00")), "MMM d HH:mm:ss", "1998-06-15")
    return o.select("o_orderkey", F.year(at).cast("bigint").alias("y"), F.month(at).cast("bigint").alias("m"))


@query("SELECT c_custkey, nullif(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, '') AS kept, round(c_acctbal / 1000, 9) AS kilo FROM customer")
def x19_x24_pruned_scaled(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumn("name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lit("")))
    return fields.copy(c, "name", "kept", prune_empty=True).select("c_custkey", "kept", F.round(text.scaled(F.col("c_acctbal"), 3), 9).alias("kilo"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
def r2_periods_with_late_rows(spark, sf_dir):
    df = pull.windowed(t(spark, sf_dir, "events"), "ts", "1 day", "2 hours", ["event_type"], F.count("*").alias("n"), F.max("value").alias("top"))
    return df.select(F.col("window.start").alias("day"), "event_type", "n", "top")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS times FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 1 FROM events WHERE event_id % 3 <> 0")
def r8_dead_letters(spark, sf_dir):
    """One sink gets all rows at once, another fails on a third of them first; they come from its dead letters, once."""
    e, path = t(spark, sf_dir, "events").select("event_id"), _folder(spark)

    def down(df, key):
        raise RuntimeError("down")

    down.has = lambda spark, key: False
    good = delivery.files_sink(f"{path}/out")
    delivery.deliver(e, {"good": good}, f"{path}/d", "all", sleep=0)
    delivery.deliver(e.where("event_id % 3 = 0"), {"bad": down}, f"{path}/d", "third", sleep=0)
    for _ in range(2):
        delivery.replay(spark, f"{path}/d", "bad", "event_id long", good)
    out = spark.read.schema("event_id long").parquet(f"{path}/out")
    return out.groupBy("event_id").agg(F.count("*").cast("int").alias("times"))


@query("SELECT sink, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events, (VALUES ('a'), ('b')) s(sink) GROUP BY ALL")
def k12_r6_batches_once(spark, sf_dir):
    """Three batches to two sinks, of which one fails behind its first write and one before it; each is delivered twice."""
    e, path = t(spark, sf_dir, "events").select("event_id", "event_type"), _folder(spark)
    own = {n: delivery.files_sink(f"{path}/out/sink={n}") for n in "ab"}
    failed = set()

    def once(name, behind):
        def sink(df, key):
            if behind:
                own[name](df, key)
            if (name, key) not in failed:
                failed.add((name, key))
                raise RuntimeError("failed once")
            own[name](df, key)

        sink.has = own[name].has
        return sink

    for k in (0, 1, 2, 1, 0):
        delivery.deliver(e.where(F.col("event_id") % 3 == k), {"a": once("a", True), "b": once("b", False)}, f"{path}/d", "q", k, sleep=0)
    out = spark.read.schema("event_id long, event_type string, sink string").parquet(f"{path}/out")
    return out.groupBy("sink", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""SELECT CASE WHEN event_id IN ((SELECT min(event_id) FROM events), (SELECT max(event_id) FROM events)) THEN 'letter' ELSE 'sent' END AS went,
          count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL""")
def r7_failing_rows(spark, sf_dir):
    """A sink that takes no batch with the first or the last event in it: they are the letters, all others arrive."""
    e, path = t(spark, sf_dir, "events").select("event_id"), _folder(spark)
    bad, out = list(e.agg(F.min("event_id"), F.max("event_id")).first()), delivery.files_sink(f"{path}/out")

    def picky(df, key):
        if not df.where(F.col("event_id").isin(bad)).isEmpty():
            raise ValueError("bad row")
        out(df, key)

    picky.has = out.has
    delivery.deliver(e, {"s": picky}, f"{path}/d", sleep=0)
    sent = spark.read.schema("event_id long").parquet(f"{path}/out").select("event_id", F.lit("sent").alias("went"))
    lost = delivery.letters(spark, f"{path}/d", "s").select(F.from_json("row", "event_id long")["event_id"].alias("event_id"), F.lit("letter").alias("went"))
    return sent.unionByName(lost).groupBy("went").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT event_id, 1 AS times FROM events")
def r4_r5_pulls_with_late_rows(spark, sf_dir):
    """Four pulls by day of a table that grows: a fifth of the newest day's rows come after a pull has seen that day."""
    e, path = t(spark, sf_dir, "events").select("event_id", F.date_trunc("day", "ts").alias("day")), _folder(spark)
    first, last = e.agg(F.min("day"), F.max("day")).first()
    ends = [first + (last - first) * k // 3 for k in (1, 2, 3)]
    ends = [x.replace(hour=0, minute=0, second=0, microsecond=0) for x in ends]
    out = f"{path}/out"
    got = delivery.files_sink(out)
    for end in [*ends, None]:
        seen = e if end is None else e.where((F.col("day") < F.lit(end)) | ((F.col("day") == F.lit(end)) & (F.col("event_id") % 5 != 0)))
        pull.incremental_pull(lambda seen=seen: seen, "day", f"{path}/state", got, first, late=True, keyed=True)
    return spark.read.schema("event_id long").parquet(out).groupBy("event_id").agg(F.count("*").cast("int").alias("times"))


@query("""SELECT event_id FROM events, (SELECT min(CAST(ts AS DATE)) + 1 AS d FROM events) WHERE CAST(ts AS DATE) > d OR (CAST(ts AS DATE) = d AND event_id % 2 = 1)""")
def r5_unseen_at_the_boundary(spark, sf_dir):
    """Half of the boundary day's rows were delivered."""
    e = t(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).select("event_id", "day")
    last = e.agg(F.date_add(F.min("day"), 1)).first()[0]
    return pull.unseen(e, "day", last, pull.boundary(e.where((F.col("day") < F.lit(last)) | ((F.col("day") == F.lit(last)) & (F.col("event_id") % 2 == 0))), "day")).select("event_id")


#: Rows of a file that a stream reads: a batch of a large table is many files, and so many tasks.
FILE_ROWS = 100_000


def _four_batches(df: DataFrame, path: str) -> DataFrame:
    """df as a stream of four batches, which are read by as many tasks as their rows call for."""
    df.repartition(4 * max(1, -(-df.count() // (4 * FILE_ROWS))), F.col(df.columns[0])).write.parquet(path)
    n_files = sum(n.endswith(".parquet") for n in storage.names(df.sparkSession, path))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-n_files // 4))).parquet(path)


@query("SELECT user_id, sum(event_id)::DOUBLE AS ids, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def a1_totals_of_a_stream(spark, sf_dir):
    """Totals added by micro-batches; the query is started again behind its second batch."""
    path = _folder(spark)
    stream = _four_batches(t(spark, sf_dir, "events").select("event_id", "user_id", "value"), f"{path}/in")
    sums = totals.Totals(spark, f"{path}/totals", ["user_id"], {"event_id": "ids", "value": "total"})
    left = [2]

    def add(df, batch_id):
        sums.add(df, batch_id)
        left[0] -= 1
        if left[0] == 0:
            raise RuntimeError("lost behind the write")

    began = lambda f: stream.writeStream.foreachBatch(f).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    try:
        began(add).awaitTermination()
    except StreamingQueryException:
        pass
    sums.stream(stream, f"{path}/cp", merge_every=3).awaitTermination()
    return sums.read().select("user_id", "ids", F.round("total", 4).alias("total"))


@query("SELECT 'parse' AS stage, count(*) FILTER (event_id % 97 <> 0) AS ok, count(*) FILTER (event_id % 97 = 0) AS failed, 'value: no pattern matches' AS last_error FROM events")
def a6_status_of_a_stream(spark, sf_dir):
    """Counts of a running query, as its listener has them."""
    path = _folder(spark)
    own = status.Status(spark, f"{path}/status")
    stream = _four_batches(access_lines(spark, sf_dir), f"{path}/in")
    spark.streams.addListener(own)
    try:
        rows = errors.observed(parse.grok(stream, ["^%{ACCESS}$"], ACCESS), "parse")
        rows.writeStream.queryName("access").format("noop").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        ended = time.time() + 30
        while own.table().where("stage = 'parse' and ok + failed > 0").count() < 4 and time.time() < ended:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(own)
    return A.health(own.table().where("stage = 'parse' and ok + failed > 0")).select("stage", "ok", "failed", "last_error")


@query("""SELECT day, count(*) AS n FROM (
              SELECT date_trunc('day', ts) AS day, date_trunc('day', ts) + INTERVAL 1 DAY > (SELECT date_trunc('milliseconds', max(ts)) FROM events WHERE event_id % 10 > 1) - INTERVAL 2 HOUR AS open, event_id FROM events)
          WHERE (event_id % 10 <> 0 OR open) AND day + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 2 HOUR GROUP BY day""")
def r10_late_rows_of_a_stream(spark, sf_dir):
    """A tenth of the rows comes in a third batch, too late for all periods that the first batch's newest row has closed (what
    the batch before has read moves the watermark of the next one)."""
    path, e = _folder(spark), t(spark, sf_dir, "events").select("event_id", "ts")
    rest = F.col("event_id") % 10
    for part in (rest > 1, rest == 1, rest == 0):
        e.where(part).repartition(4).write.mode("append").parquet(f"{path}/in")
        time.sleep(1.1)  # files are read in the order of their times, which may be whole seconds
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    days = pull.windowed(stream, "ts", "1 day", "2 hours", [], F.count("*").alias("n"))
    days.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(days.schema).parquet(f"{path}/out").select(F.col("window.start").alias("day"), "n")


@query("""WITH e AS (SELECT user_id % 16 AS log, event_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS head FROM events),
          p AS (SELECT *, (row_number() OVER (PARTITION BY log, head ORDER BY event_id) - 1) // 7 AS part FROM e),
          v AS (SELECT log, head, part, string_agg(event_type || ' ' || event_id, chr(10) ORDER BY event_id) AS value FROM p GROUP BY ALL)
          SELECT 'log-' || log AS log, value FROM v QUALIFY row_number() OVER (PARTITION BY log ORDER BY head DESC, part DESC) > 1""")
def r2_events_across_files(spark, sf_dir):
    """Events that begin at a head line and end with the next one or at seven lines, read from four rotated files in four
    batches; the last event of each log is still open."""
    path, e = _folder(spark), t(spark, sf_dir, "events")
    rows = e.select(F.concat(F.lit("log-"), F.col("user_id") % 16).alias("log"), F.col("event_id").alias("line_no"), F.concat_ws(" ", "event_type", "event_id").alias("value"))
    low, high = rows.agg(F.min("line_no"), F.max("line_no")).first()
    edges = [low + (high + 1 - low) * i // 4 for i in range(5)]
    for a, b in zip(edges, edges[1:], strict=False):
        rows.where(F.col("line_no").between(a, b - 1)).coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(1.1)  # files are read in the order of their times, which may be whole seconds
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    with pull.timed_state(spark, idle=False):
        events = pull.open_events(stream, "^purchase", max_lines=7, timeout="1 day")
        started = events.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
        started.awaitTermination()
    return spark.read.schema("log string, value string").parquet(f"{path}/out")


@query("SELECT event_id, event_type, 'eu' AS region FROM events WHERE CAST(ts AS DATE) BETWEEN (SELECT min(CAST(ts AS DATE)) FROM events) + 1 AND (SELECT min(CAST(ts AS DATE)) FROM events) + 3")
def s20_audit_objects(spark, sf_dir):
    """Audit objects in folders by day, each file a document of many records; those of three days are read."""
    e, path = t(spark, sf_dir, "events"), _folder(spark)
    first = e.agg(F.to_date(F.min("ts"))).first()[0]
    record = F.struct("event_id", "event_type", F.lit("eu").alias("region"))
    bodies = e.groupBy(F.to_date("ts").alias("day"), F.expr("event_id div 2000")).agg(F.to_json(F.struct(F.collect_list(record).alias("Records"))).alias("value"))
    bodies.select("day", "value").write.option("maxRecordsPerFile", 1).partitionBy("day").text(path)
    days = tuple(str(first + datetime.timedelta(n)) for n in (1, 3))
    back = files.audit_objects(spark, path, "event_id long, event_type string, region string", days, layout="day=%Y-%m-%d")
    return back.select("event_id", "event_type", "region")


@query("SELECT event_id, event_type, value FROM events")
def k1_array_lines(spark, sf_dir):
    """Files by day whose lines are arrays of records, back through the JSON parser, which gives one row for each record."""
    path = _folder(spark)
    sinks.json_files(t(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts"), path, "ts", {"day": "yyyyMMdd"}, array_of=100)
    lines = files.lines(spark, path, recursive=True).where("value like '[{%}]'")
    return parse.jsonl(lines, "event_id long, event_type string, value double").select("event_id", "event_type", "value")


@query("""SELECT c_custkey, metric, CASE WHEN c_custkey % 5 = 0 THEN 'own' WHEN metric LIKE 'vsphere.vm.%' THEN coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_name END, '') ELSE 'here' END AS endpoint, value, 60 AS step
          FROM (SELECT *, 'cpu' AS metric, c_acctbal::DOUBLE AS value FROM customer UNION ALL SELECT *, 'vsphere.vm.mem', c_nationkey::DOUBLE FROM customer)""")
def a5_endpoints(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.expr("c_custkey % 5 = 0"), F.lit("own")).alias("endpoint"), F.when(F.expr("c_custkey % 3 > 0"), F.col("c_name")).alias("vmname"),
        F.col("c_acctbal").alias("cpu"), F.col("c_nationkey").alias("vsphere.vm.mem"),
    )
    return A.to_samples(c, ["c_custkey"], ["cpu", "vsphere.vm.mem"], ["endpoint", "vmname"], "here", 60).select("c_custkey", "metric", "endpoint", "value", "step")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, 'file') AS prio, 'file' AS dc FROM orders")
def s10_tags(spark, sf_dir):
    """Constant tags of a JSON tag file; a field that is there stays."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.expr("o_orderkey % 2 = 0"), F.col("o_orderpriority")).alias("prio"))
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:  # read on the driver only, at once
        f.write('{"prio": "file", "dc": "file"}')
        f.flush()
        tags = files.tags_from(f.name, host=True, prefix="host_", read_time="lst")
    return files.tagged(o, tags).where("lst <= current_timestamp() and host_os <> ''").select("o_orderkey", "prio", "dc")


@query("SELECT n_nationkey, n_name || 'é' AS name, 'ISO-8859-1' AS charset FROM nation")
def s7_charset(spark, sf_dir):
    """Lines written in another charset and decoded."""
    path = _folder(spark)
    n = t(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("é")).alias("name"))
    n.write.option("encoding", "ISO-8859-1").csv(path)
    back = files.decoded(spark, f"{path}/*.csv", "ISO-8859-1", tag="charset").where("value <> ''")
    return back.select(F.split_part("value", F.lit(","), F.lit(1)).cast("int").alias("n_nationkey"), F.split_part("value", F.lit(","), F.lit(2)).alias("name"), "charset")


@query("SELECT event_id, event_type || ' é 日' AS value FROM events")
def s7_two_byte_charset(spark, sf_dir):
    """Lines in a charset whose line feed is no single byte: each file is read as one stream."""
    path, e = _folder(spark), t(spark, sf_dir, "events")
    e.select("event_id", F.concat("event_type", F.lit(" é 日"))).write.option("encoding", "UTF-16LE").csv(path)
    parts = F.split("value", ",", 2)
    return files.decoded(spark, f"{path}/*.csv", "UTF-16LE").select(parts[0].cast("long").alias("event_id"), parts[1].alias("value"))


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL")
def s5_s6_packed(spark, sf_dir):
    """Lines of gzip files, by the archive reader and by the reader that the path chooses: both give the same counts."""
    path = _folder(spark)
    t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value")).write.option("compression", "gzip").text(path)
    a = files.archives(spark, f"{path}/*.gz").select("value", F.lit(1).alias("side"))
    b = files.auto(spark, path).select("value", F.lit(2).alias("side"))
    n = a.unionByName(b).groupBy("value").agg(F.count_if(F.col("side") == 1).alias("n"), F.count_if(F.col("side") == 2).alias("m"))
    return n.where("n = m").select("value", "n")


@query("SELECT CAST(2016 + n_regionkey AS BIGINT) AS y, count(*) AS n FROM nation WHERE n_regionkey BETWEEN 1 AND 3 GROUP BY ALL")
def s14_dated_names(spark, sf_dir):
    """One table a year, of which those whose name lies in a time range are read."""
    path = _folder(spark)
    n = t(spark, sf_dir, "nation").withColumn("y", F.col("n_regionkey").cast("bigint") + 2016)
    n.write.partitionBy("y").parquet(path)
    names = joins.names_between([f"y={y}" for y in range(2010, 2030)], "y=@(YYYY)", "2017", "201912")
    parts = [spark.read.parquet(f"{path}/{name}").withColumn("y", F.lit(int(name[2:])).cast("bigint")) for name in names]
    return functools.reduce(lambda a, b: a.unionByName(b), parts).groupBy("y").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 'a' ELSE 'b' END AS sink, 'x' AS env FROM orders")
def d1_config_run(spark, sf_dir):
    """A pipeline from its config alone: source, tags, transform, route and two sinks, whose files are read back."""
    path = _folder(spark)
    spec.run(spark, {
        "source": {"type": "parquet", "path": f"{sf_dir}/orders.parquet"}, "tags": {"env": "x"}, "transforms": [{"type": "case", "key": "o_orderpriority", "mode": "lower"}],
        "route": {"key": "o_orderpriority", "routes": [("contains", "1-", 0)], "default": 1}, "sinks": [{"type": "parquet", "path": f"{path}/a"}, {"type": "parquet", "path": f"{path}/b"}],
    })
    sides = [spark.read.parquet(f"{path}/{s}").select("o_orderkey", "o_orderpriority", F.lit(s).alias("sink"), "env") for s in "ab"]
    return sides[0].unionByName(sides[1])


@query("SELECT o_orderstatus AS status, count(*) AS n_lines FROM orders GROUP BY ALL")
def t1_files_by_time(spark, sf_dir):
    """Lines of each file, files by modification time; suffixes are left out."""
    path = _folder(spark)
    o = t(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderkey").cast("string").alias("value"))
    o.repartition("o_orderstatus").write.partitionBy("o_orderstatus").text(f"{path}/log")
    o.select("value").write.text(f"{path}/log/o_orderstatus=Z.bak")
    lines = files.lines(spark, f"{path}/log", recursive=True, ignore_suffixes=[".crc"], ignore=r"\.bak/")
    return files.ordered_files(lines).groupBy(F.regexp_extract("_source", "o_orderstatus=([^/]+)", 1).alias("status")).agg(F.sum("n_lines").alias("n_lines"))


@query("SELECT doc_id, text, coalesce(strlen(text) > 256, false) AS oversized, true AS fits FROM documents")
def x22_oversized_texts(spark, sf_dir):
    """Texts over 256 bytes leave their row for rows of pieces; pieces joined again are the texts."""
    rows = fields.split_oversized(t(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], 256, F.col("doc_id"))
    place = F.split("part_id", "_")
    parts = rows.where("part_id is not null").select(place[0].cast("bigint").alias("doc_id"), place[2].cast("int").alias("no"), F.col("text").alias("piece"))
    whole = parts.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("no", "piece")))["piece"], "").alias("whole"), F.max(F.octet_length("piece")).alias("longest")
    )
    heads = rows.where("part_id is null").select("doc_id", "text").join(whole, "doc_id", "left")
    fits = F.coalesce(F.col("longest"), F.octet_length("text"), F.lit(0)) <= 256
    return heads.select("doc_id", F.coalesce("whole", "text").alias("text"), F.col("whole").isNotNull().alias("oversized"), fits.alias("fits"))


@query("SELECT event_id, user_id AS u, value AS v, event_type AS s FROM events")
def x10_splitter_and_types(spark, sf_dir):
    raw = F.concat(F.lit("u:"), F.col("user_id").cast("string"), F.lit(" v : "), F.col("value").cast("string"), F.lit(' s:"'), "event_type", F.lit('"'))
    e = t(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return fields.parse_key_values(e, "raw", "kv", splitter=":", typed={"u": "bigint", "v": "double", "s": "string"}).select("event_id", "u", "v", "s")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS inner_name, c_custkey % 2 <> 0 AS gone, CASE WHEN c_custkey % 2 = 0 THEN 1 END AS n FROM customer")
def x19_nested_pruned(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lit(""))
    inner = F.struct(name.alias("name"), F.create_map(F.lit("name"), name, F.lit("none"), F.lit("")).alias("names"))
    c = t(spark, sf_dir, "customer").select("c_custkey", F.struct(inner.alias("inner"), F.array().cast("array<string>").alias("none")).alias("v"))
    out = fields.copy(c, "v", "kept", prune_empty=True)
    n = F.when(F.col("kept.inner.names").isNotNull(), F.size("kept.inner.names"))
    return out.select("c_custkey", F.col("kept.inner.name").alias("inner_name"), F.col("kept").isNull().alias("gone"), n.alias("n"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
