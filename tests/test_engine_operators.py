"""Field, join, stream and sink operators on literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace import paths
from millrace.errors import split_errors
from millrace.functions import convert, dates, text
from millrace.operators import aggregates, fields, joins
from millrace.plans import catalog, spec
from millrace.sources import files, sinks
from millrace.streaming import pull


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_filter_removes_rows_with_the_field(spark):
    df = spark.createDataFrame([("hello", "x1 y2"), (None, "x1")], "myword string, abc string")
    assert [r.myword for r in fields.filter_rows(df, ["myword"], None, "remove").collect()] == [None]


def test_paths(spark):
    df = spark.range(1).select(F.struct(F.lit("a").alias("myword"), F.lit("b").alias("abc")).alias("multi"))
    assert paths.drop(df, "multi.myword").first().multi.asDict() == {"abc": "b"}
    assert paths.pick(df, "multi.myword").first().multi.asDict() == {"myword": "a"}
    assert paths.put(df, "multi.new.deep", F.lit(1)).first().multi.new.deep == 1
    with pytest.raises(ValueError):
        paths.put(df, "multi.abc.x", F.lit(1))


def test_copy_refuses_and_notes(spark):
    df = spark.createDataFrame([("v", None), ("v", "w")], "old string, new string")
    rows = fields.copy(df, "old", "new").collect()
    assert [r.new for r in rows] == ["v", "w"] and [len(r._errors) for r in rows] == [0, 1]


@pytest.mark.parametrize(("name", "normal"), [("ts。ts2", "ts_ts2"), ("ts-tes2/1.2", "ts_tes2_1_2"), ("_xs1_2s.xs.1", "xs1_2s_xs_1"), ("200", "K200"), ("ts- ", "ts_")])
def test_normal_names(name, normal):
    assert fields.normal_name(name) == normal


def test_text_functions(spark):
    assert one(spark, text.concatenated([F.lit("20110218"), F.lit("190102")])) == "20110218190102"
    assert one(spark, text.concatenated([F.lit(None).cast("string"), F.lit("a")])) is None
    assert one(spark, text.ipv4_text(F.lit(223556667))) == "13.83.52.59"
    assert one(spark, text.ipv4_text(F.lit("x"))) is None
    assert one(spark, text.ipv4_number(F.lit("13.83.52.59"))) == 223556667
    assert one(spark, text.url_text(F.lit("%zz"), "decode")) is None
    got = one(spark, text.url_params(F.lit("http://h.com/p/q?a=1&b=&a=2&c=%20x"), "k"))
    assert got == {"k_url_param_path": "/p/q", "k_url_param_host": "h.com", "k_a": "1&2", "k_c": " x"}
    assert one(spark, text.byte_slice(F.lit("héllo"), 0, 3)) == "hé"


def test_dates(spark):
    utc = datetime.datetime(2017, 3, 28, 15, 41, 53)
    assert one(spark, dates.parsed(F.lit("2017/03/28 15:41:53 -0000"))) == utc
    assert one(spark, dates.epoch(F.lit("2017/03/28 15:41:53 -0000"))) == 1490715713
    assert one(spark, dates.parsed(F.lit(1506049632))) == datetime.datetime(2017, 9, 22, 3, 7, 12)
    assert one(spark, dates.parsed(F.lit("no date"))) is None
    assert one(spark, dates.parsed(F.lit("Tue, 28 Mar 2017 15:41:53"))) == utc


@pytest.mark.parametrize(
    ("text_", "iso"),
    [
        ("2017-03-28T15:41:53Z", "2017-03-28T15:41:53"), ("2017-03-28T15:41:53.123456+08:00", "2017-03-28T07:41:53.123456"), ("28/Mar/2017:15:41:53 +0800", "2017-03-28T07:41:53"),
        ("2017/03/28 15:41:53", "2017-03-28T15:41:53"), ("20170328T154153+08", "2017-03-28T07:41:53"), ("2017-03-28 15:41:53 +0800 CST", "2017-03-28T07:41:53"),
        ("2017-03-28 15:41:53 -0700", "2017-03-28T22:41:53"), ("2017-03-28 15:41:53", "2017-03-28T15:41:53"), ("2017/03/28 15:41:53 +0800 CST", "2017-03-28T07:41:53"),
        ("2017/03/28 15:41:53 -0700", "2017-03-28T22:41:53"), ("2017-03-28 +0800 CST", "2017-03-27T16:00:00"), ("2017-03-28 -0700", "2017-03-28T07:00:00"), ("2017-03-28", "2017-03-28T00:00:00"),
        ("2017/03/28 +0800 CST", "2017-03-27T16:00:00"), ("2017/03/28 -0700", "2017-03-28T07:00:00"), ("2017/03/28", "2017-03-28T00:00:00"), ("28/03/2017--15:41:53", "2017-03-28T15:41:53"),
        ("28 Mar 17 15:41", "2017-03-28T15:41:00"), ("Tue Mar 28 15:41:53 2017", "2017-03-28T15:41:53"), ("Tue Mar  7 15:41:53 UTC 2017", "2017-03-07T15:41:53"),
        ("Tue Mar 28 15:41:53 -0700 2017", "2017-03-28T22:41:53"), ("28 Mar 17 15:41 MST", "2017-03-28T15:41:00"), ("28 Mar 99 15:41 -0700", "1999-03-28T22:41:00"),
        ("Tuesday, 28-Mar-17 15:41:53 UTC", "2017-03-28T15:41:53"), ("Tue, 28 Mar 2017 15:41:53 GMT", "2017-03-28T15:41:53"), ("Tue, 28 Mar 2017 15:41:53 -0700", "2017-03-28T22:41:53"),
        ("2017-03-28 15:41:53,678", "2017-03-28T15:41:53.678000"), ("2017/09/22/11/07/12", "2017-09-22T11:07:12"), ("28/03/2017", "2017-03-28T00:00:00"), ("20170328", "2017-03-28T00:00:00"),
        ("12:00", None), ("2017", None), ("2017-13-41", None), ("31/Feb/2017:99:00:00 +0000", None), ("", None),
    ],
)
def test_date_layouts(spark, text_, iso):
    got = one(spark, dates.parsed(F.lit(text_)))
    assert (got and got.isoformat()) == iso


def test_dates_without_a_year(spark):
    for given, shown in [("3:04PM", "01-01 15:04:00"), ("12:04AM", "01-01 00:04:00"), ("Jan 2 15:04:05", "01-02 15:04:05"), ("Mar 28 15:04:05.123456", "03-28 15:04:05")]:
        assert one(spark, F.date_format(dates.parsed(F.lit(given)), "MM-dd HH:mm:ss")) == shown


def test_convert(spark):
    df = spark.createDataFrame([(["123", "456"], "", "x")], "myword array<string>, abc string, n string")
    r = convert.convert(df, "myword array(long), abc long, n long 5, m map{a long}").first()
    assert (r.myword, r.abc, r.n) == ([123, 456], None, 5)
    assert convert.parse_dsl("a a(m{b l, c a(f)})")[0][1] == "array<struct<`b`:bigint,`c`:array<double>>>"


def test_joins(spark):
    df = spark.createDataFrame([("111.2.3.4",), ("x.x.x.x",)], "ip string")
    ranges = spark.createDataFrame([(text_number("111.0.0.0"), text_number("111.255.255.255"), "wide"), (text_number("111.2.3.0"), text_number("111.2.3.9"), "narrow")], "start long, end long, country string")
    rows = {r.ip: r for r in joins.ip_ranges(df, "ip", ranges).collect()}
    assert rows["111.2.3.4"].country == "narrow" and rows["x.x.x.x"].country is None and rows["x.x.x.x"]._errors
    assert joins.map_text("1 2,3,3,,4 aby") == {"1": "2", "4": "aby"}
    at = datetime.datetime(2017, 2, 1, 16, 6, 19)
    assert joins.expand_names("abcd@(YYYY)@(MM)efg*", at) == "abcd201702efg*"
    assert joins.names_between(["o_201701", "o_201702", "o_x"], "o_@(YYYY)@(MM)", "20170201", "20170301") == ["o_201702"]


def text_number(ip):
    a, b, c, d = map(int, ip.split("."))
    return a << 24 | b << 16 | c << 8 | d


def test_user_agent_first_rule_wins(spark):
    rules = spark.createDataFrame([(1, "agent", r"(Silk)/(\d+)", None), (2, "agent", "Mozilla", "Mozilla"), (3, "os", "Mac", "Mac OS")], "rule_no int, kind string, regex string, family string")
    df = spark.createDataFrame([("Mozilla/5.0 (Macintosh) Silk/1.1",), ("none",)], "ua string")
    rows = {r.ua: r for r in joins.user_agent(df, "ua", rules).collect()}
    r = rows["Mozilla/5.0 (Macintosh) Silk/1.1"]
    assert (r.UA_agent_family, r.UA_agent_version, r.UA_os_family) == ("Silk", "1", "Mac OS")
    assert rows["none"].UA_agent_family is None


def test_route(spark):
    df = spark.createDataFrame([("a",), ("A",), ("B",), (None,)], "a string")
    got = {r.a: r._route for r in aggregates.route(df, "a", [("equal", "a", 2), ("equal", "A", 1)]).collect()}
    assert got == {"a": 2, "A": 1, "B": 0, None: 0}


def test_events_assembled_from_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.log").write_text("test123\n12\n34\n56\ntest\nxtestx\n123\n")
    got = sorted(r.value for r in pull.assemble(files.lines(spark, str(tmp_path)), "^test*", order=files.ORDER).collect())
    assert got == ["test123\n12\n34\n56"] * 3 + ["test\nxtestx\n123"] * 3 or sorted(got) == sorted(["test123\n12\n34\n56"] * 3 + ["test\nxtestx\n123"] * 3)
    whole = pull.assemble_whole_files(spark, str(tmp_path), "test*").count()
    assert whole == 6


def test_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.log", "a\nb\n")
        z.writestr("x/two.txt", "c\n")
    rows = files.archives(spark, str(tmp_path / "a.zip"), "*.log").collect()
    assert [(r.member, r.line_no, r.value) for r in rows] == [("x/one.log", 0, "a"), ("x/one.log", 1, "b")]


def test_incremental_pull_and_late_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, "x") for i in [1, 2, 3, 50, 51]], "id long, v string")
    got = []
    for _ in range(3):
        pull.incremental_pull(lambda: df, "id", str(tmp_path / "state"), lambda b: got.extend(r.id for r in b.collect()), 0, 10)
    assert got == [1, 2, 3, 50, 51]
    first = spark.createDataFrame([(1, "a"), (2, "b")], "t long, v string")
    later = spark.createDataFrame([(2, "b"), (2, "late"), (3, "c"), (None, "n")], "t long, v string")
    assert sorted(r.v for r in pull.unseen(later, "t", 2, pull.boundary(first, "t")).collect()) == ["c", "late", "n"]


def test_rendered_sinks(spark):
    df = spark.createDataFrame([("a b", 1, "o'x")], "t string, n long, s string")
    assert sinks.line_protocol(df, "m", ["t"], ["n", "s"]).first().value == "m,t=a\\ b n=1i,s=\"o'x\""
    assert df.select(sinks.sql_inserts(df, "tab").alias("v")).first().v == "INSERT INTO tab (n, s, t) VALUES (1, 'o''x', 'a b');"


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("5 a\nbroken\n7 b\n")
    plan = {"parser": {"type": "grok", "patterns": ["^%{INT:n:long} %{WORD:w}$"]}, "route": {"key": "w", "routes": [("equal", "a", 1)]}}
    batch = spec.compose(files.lines(spark, str(tmp_path / "in")), plan).groupBy("_route").count().collect()
    out = [[], []]
    sinks_ = [lambda d, o=o: o.extend(r.value for r in d.collect()) for o in out]
    spec.run_stream(files.stream_lines(spark, str(tmp_path / "in")), plan, sinks_, str(tmp_path / "cp")).awaitTermination(60)
    assert {r["_route"]: r["count"] for r in batch} == {0: len(out[0]), 1: len(out[1])} == {0: 2, 1: 1}


def test_split_and_rejoin(spark):
    df = spark.createDataFrame([(1, "日本語abc" * 50), (2, "")], "k long, t string")
    pieces = fields.split_value(df, "t", 7, F.col("k"))
    assert {r.part_id: r.t for r in fields.rejoin_value(pieces, "t").collect()} == {1: "日本語abc" * 50, 2: ""}


def test_oversized_texts_split_at_line_breaks(spark):
    lines = "".join(f"line {i} é日\n" for i in range(40)) + "end"
    solid, short, wide = "日本語x" * 30, "short", "\n\n\n" + "a" * 64
    df = spark.createDataFrame([(1, lines, solid), (2, short, None), (3, "", wide), (4, None, "b" * 64)], "k long, t string, u string")
    out = fields.split_oversized(df, ["t", "u"], 64, F.col("k")).collect()
    heads = {r.k: (r.t, r.u) for r in out if r.part_id is None}
    assert heads == {1: (None, None), 2: (short, None), 3: ("", None), 4: (None, "b" * 64)}
    parts = {r.part_id: r.t if r.u is None else r.u for r in out if r.part_id is not None}
    assert all(r.k is None and (r.t is None) != (r.u is None) for r in out if r.part_id is not None)
    for name, whole in (("1_t", lines), ("1_u", solid), ("3_u", wide)):
        own = [parts[f"{name}_{i}"] for i in range(sum(p.rsplit("_", 1)[0] == name for p in parts))]
        assert "".join(own) == whole and all(0 < len(x.encode()) <= 64 for x in own)
        if name == "1_t":
            assert all(x.endswith("\n") for x in own[:-1])
            want, line_bytes = [[]], [x.encode() for x in lines.splitlines(keepends=True)]
            for x in line_bytes:
                if sum(map(len, want[-1])) + len(x) > 64:
                    want.append([])
                want[-1].append(x)
            assert own == [b"".join(w).decode() for w in want]
    with pytest.raises(ValueError):
        fields.split_oversized(df, ["t"], 3, F.col("k"))
    assert fields.split_oversized(df.limit(0), ["t"], 64, F.col("k")).count() == 0


def test_nested_values_are_pruned_when_copied(spark):
    deep = "struct<b:struct<c:struct<d:struct<e:struct<f:struct<g:struct<h:int>>>>>>>"
    schema = f"k long, v struct<s:string,a:array<int>,m:map<string,string>,n:int,o:struct<p:string>>, w {deep}"
    g = (((((((7,),),),),),),)
    df = spark.createDataFrame([(1, ("", [], {"x": "", "y": "z"}, 3, ("",)), g), (2, ("", [], {"x": ""}, None, (None,)), None)], schema)
    out = fields.copy(fields.copy(df, "v", "v2", prune_empty=True), "w", "w2", prune_empty=True).orderBy("k").collect()
    assert out[0].v2.asDict(True) == {"s": None, "a": None, "m": {"y": "z"}, "n": 3, "o": None}
    assert out[1].v2 is None and out[1].w2 is None
    assert out[0].w2.b.c.d.e.f.g == '{"h":7}'


def test_key_values_in_a_field_with_a_splitter_and_types(spark):
    df = spark.createDataFrame([("a:1 b:true c:some text",), ("a:x",), ("nothing",)], "v string")
    kinds = {"a": "double", "b": "boolean", "c": "string"}
    out = fields.parse_key_values(df, "v", splitter=":", typed=kinds).collect()
    assert [(r.a, r.b, r.c) for r in out] == [(1.0, True, "some text"), (None, None, None), (None, None, None)]
    kept = fields.parse_key_values(df, "v", splitter=":", typed=kinds, keep_string=True).collect()
    assert [(r.a, r.b) for r in kept] == [("1", "true"), ("x", None), (None, None)]
    assert out[2]._errors and not out[0]._errors


def test_offset_scans_with_filter_and_delay(spark):
    at = datetime.datetime(2024, 3, 1, 12)
    df = spark.createDataFrame([(i, at + datetime.timedelta(minutes=i), "ab"[i % 2]) for i in (3, 0, 5, 1, 4, 2)] + [(None, None, "a")], "k long, ts timestamp, s string")
    ids = lambda d: [r.k for r in d.collect()]
    assert ids(files.offset_scan(df, "k", 1)) == [2, 3, 4, 5]
    assert ids(files.offset_scan(df, "k", 1, 4, inclusive=True, where="s = 'b'")) == [1, 3]
    assert ids(files.offset_scan(df, "ts", at, at + datetime.timedelta(minutes=5), delay="2 minutes")) == [1, 2, 3]
    assert len(ids(files.offset_scan(df, "ts", delay="1 hour", where=F.col("s") == "a"))) == 3
    assert ids(files.offset_scan(df, "k", where="s = 'b'")) == [1, 3, 5]
    assert files.dated_index("logs-@(YYYY).@(MM).@(DD)-@(hh)", 24, at) == "logs-2024.02.29-12"
    assert files.dated_index("plain") == "plain"


def test_flagship_runs(spark):
    good = catalog.flagship(spark, "/root/testdata/sf0.001")
    assert good.count() > 0 and split_errors(good)[1].count() == 0


def test_events_of_one_source_are_numbered_in_ranges(spark):
    lines = [("a", i, f"{'H' if i % 7 == 3 else 'l'}{i}") for i in range(2000)] + [(None, i, f"{'H' if i % 5 == 0 else 'l'}{i}") for i in range(40)]
    df = spark.createDataFrame(lines, "_source string, _order long, value string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = aggregates.event_numbers(df, F.col("value").startswith("H"), "_source", ["_order"]).collect()
        events = pull.assemble(df, "^H").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r._range for r in rows if r._source == "a"}) > 1
    want, at = {}, {}
    for source, _, value in lines:
        at[source] = at.get(source, 0) + value.startswith("H")
        want.setdefault((source, at[source]), []).append(value)
    assert len(rows) == len(lines) and {r.value for r in rows if r._event == 1 and r._source == "a"} == set(want["a", 1])
    assert {(r._source, r.event_no): r.value for r in events} == {k: "\n".join(v) for k, v in want.items()}


def test_large_range_table_gives_the_same(spark, monkeypatch):
    import random

    r = random.Random(3)
    data = [(s := r.randrange(1 << 20), s + r.randrange(1, 1 << r.randrange(4, 19)), f"n{i}") for i in range(60)]
    ranges = spark.createDataFrame(data, "start long, end long, country string")
    df = spark.range(0, 1 << 20, 997).select(text.ipv4_text(F.col("id")).alias("ip"), F.lit(1).alias("_p"), "id")
    small = {x.id: x.country for x in joins.ip_ranges(df, "ip", ranges).collect()}
    monkeypatch.setattr(joins, "is_small", lambda *_: False)
    assert {x.id: x.country for x in joins.ip_ranges(df, "ip", ranges).collect()} == small
    for i, got in small.items():
        fits = sorted((e - s, n) for s, e, n in data if s <= i <= e)
        assert got == (fits[0][1] if fits else None) or fits[0][0] == fits[1][0]


def test_map_replace_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "b", "c")], "x int, _k string, _v string, _key string")
    table = spark.createDataFrame([(1, "one")], "k int, v string")
    assert joins.map_replace(df, "x", table).first().asDict() == {"x": "one", "_k": "a", "_v": "b", "_key": "c"}


def test_falling_total_is_an_error(spark):
    df = spark.createDataFrame([(1, 10, 100), (2, 20, 200), (3, 1, 5), (4, 2, 15), (5, 2, 15)], "t int, v int, total int")
    rows = aggregates.counter_share(df.withColumn("h", F.lit(1)), ["h"], "t", "v", "total").orderBy("t").collect()
    assert [(r.t, r.percent, len(r._errors)) for r in rows] == [(2, 10.0, 0), (3, None, 1), (4, 10.0, 0)]


def test_pipeline_from_a_config(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("5 a\nbroken\n7 b\n9 a\n")
    out = lambda n: {"type": "file", "path": f"{tmp_path}/{n}"}
    spec.run(spark, {
        "source": {"type": "dir", "path": str(tmp_path / "in")}, "parser": {"type": "grok", "patterns": ["^%{INT:n:long} %{WORD:w}$"]},
        "transforms": [{"type": "pick", "keys": ["n", "w", "_errors"]}], "route": {"key": "w", "routes": [("equal", "a", 1)]},
        "sinks": [out("zero"), out("one")], "dead": {"type": "parquet", "path": f"{tmp_path}/dead"},
    })
    assert [r.n for r in spark.read.json(f"{tmp_path}/one").orderBy("n").collect()] == [5, 9] and spark.read.json(f"{tmp_path}/zero").first().n == 7
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 1
    with pytest.raises(ValueError):
        spec.run(spark, {"source": {"type": "nowhere"}, "sinks": []})


def test_csv_bodies_are_quoted(spark):
    df = spark.createDataFrame([(1, 1, 'a,"b"'), (1, 2, None)], "b int, o int, t string")
    assert sinks.http_bodies(df, "b", "o", "csv").first().body == 'o,t\n1,"a,""b"""\n2,'
    raw = sinks.http_bodies(df, "b", "o", "raw", template="${o}=${t};").first().body
    assert raw == '1=a,"b";\n2=;'


@pytest.fixture(scope="module")
def database(spark):
    """A database in memory, of the driver that comes with Spark."""
    url, driver = "jdbc:derby:memory:pulls;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    year = lambda y: spark.range(20).select((F.col("id") + y * 100).alias("K"), F.concat(F.lit("v"), "id").alias("V"))
    for y in (2017, 2018, 2019):
        sinks.jdbc_append(year(y) if y != 2018 else year(y).withColumn("W", F.lit(1.5)), url, f"order_{y}", **driver)
    return url, driver


def test_database_ranges_are_half_open_and_read_in_parts(spark, database):
    url, driver = database
    df = files.jdbc_range(spark, url, "SELECT * FROM order_2017 WHERE 1 = 1;", "K", 201705, 201712, partitions=3, hints={"K": "string"}, **driver)
    assert df.rdd.getNumPartitions() == 3 and dict(df.dtypes)["K"] == "string"
    assert sorted(r.K for r in df.collect()) == [str(k) for k in range(201705, 201712)]
    whole = files.jdbc_range(spark, url, "SELECT K, V FROM order_2017", "K", 0, 201702, cast="BIGINT", **driver)
    assert whole.count() == 2


@pytest.mark.parametrize(("begin", "end", "years"), [("2018", "2019", {"ORDER_2018", "ORDER_2019"}), (None, None, {"ORDER_2017", "ORDER_2018", "ORDER_2019"})])
def test_database_tables_by_name(spark, database, begin, end, years):
    url, driver = database
    listing = "SELECT tablename FROM sys.systables WHERE tabletype = 'T'"
    df = files.jdbc_tables(spark, url, "ORDER_@(YYYY)", begin, end, listing=listing, tag="t", **driver)
    assert {r.t: (r.n, r.w) for r in df.groupBy("t").agg(F.count("*").alias("n"), F.count("W").alias("w")).collect()} == {y: (20, 20 if "2018" in y else 0) for y in years}
    with pytest.raises(ValueError):
        files.jdbc_tables(spark, url, "none_@(YYYY)", listing=listing, **driver)


def test_tags_of_file_environment_and_host(tmp_path, monkeypatch):
    (tmp_path / "t.json").write_text('{"a": "file", "b": "file"}')
    monkeypatch.setenv("OWN_TAGS", '{"b": "env", "h_os": "mine"}')
    monkeypatch.setenv("BAD_TAGS", "[1")
    tags = files.tags_from(str(tmp_path / "t.json"), "OWN_TAGS", host=True, prefix="h_")
    assert tags["a"] == "file" and tags["b"] == "env" and tags["h_os"] == "mine" and tags["h_hostname"]
    assert files.tags_from(str(tmp_path / "none"), "BAD_TAGS") == {}


def test_newest_files_and_suffixes(spark, tmp_path):
    import os

    for n, name in enumerate(["old.log", "mid.log", "new.log", "new.log.bak"]):
        (tmp_path / name).write_text(f"head\n{name}\n")
        os.utime(tmp_path / name, (1000 + n, 1000 + n))
    got = files.lines(spark, str(tmp_path), skip_first=True, ignore_suffixes=[".bak"])
    assert sorted(r.value for r in got.collect()) == ["mid.log", "new.log", "old.log"]
    got = files.lines(spark, str(tmp_path), newest=True, ignore_suffixes=[".bak"])
    assert [r.value for r in got.collect()] == ["head", "new.log"]


def test_audit_objects_of_a_stream_come_once(spark, tmp_path):
    import json

    def put(day, *ids):
        (tmp_path / "in" / day).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / day / f"{ids[0]}.json").write_text(json.dumps({"Records": [{"id": i, "own": {"x": str(i)}} for i in ids]}, indent=1))

    ddl = "id long, own struct<x: string>"
    put("2018/01/01", 1, 2)
    put("2018/01/02", 3)
    put("2018/01/03", 4)
    top = str(tmp_path / "in")
    assert sorted(r.id for r in files.audit_objects(spark, top, ddl, ("2018-01-01", "2018-01-02")).collect()) == [1, 2, 3]
    for n in range(2):
        own = files.audit_objects(spark, top, ddl, stream=True, max_files=2)
        own.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        put("2018/01/03", 5, 6)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.own.x) for r in out.collect()) == [(i, str(i)) for i in range(1, 7)]


def test_requests_with_method_headers_and_zipped_bodies(spark):
    import gzip
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            data = self.rfile.read(int(self.headers["Content-Length"]))
            data = gzip.decompress(data) if self.headers["Content-Encoding"] == "gzip" else data
            seen.append((self.path, self.headers["X-Own"], data.decode()))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data[::-1])

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    got = files.pages(spark, url + "/{page}?a={x}", 1, 3, partitions=2, method="POST", headers={"X-Own": "h"}, body="p{page}").collect()
    assert sorted((r.page, r.value) for r in got) == [(1, "1p"), (2, "2p"), (3, "3p")]
    assert sorted(seen) == [(f"/{n}?a={{x}}", "h", f"p{n}") for n in (1, 2, 3)]
    seen.clear()
    sinks.post(spark.createDataFrame([("é",), ("b",)], "body string"), url, zipped=True, headers={"X-Own": "z"})
    assert sorted(s[2] for s in seen) == ["b", "é"] and {s[1] for s in seen} == {"z"}
    server.shutdown()


def test_csv_files_keep_under_a_size(spark, tmp_path):
    sinks.csv_files(spark.range(1000).coalesce(1).select("id", F.lit("é,x").alias("t")), str(tmp_path / "o"), ["id", "t"], max_bytes=1000)
    parts = list((tmp_path / "o").glob("*.csv"))
    assert len(parts) > 5 and max(p.stat().st_size for p in parts) <= 1000
    assert spark.read.csv(str(tmp_path / "o")).count() == 1000


def test_line_protocol_escapes_names(spark):
    df = spark.createDataFrame([("x y", 1)], "`a b` string, `f=g` long")
    assert sinks.line_protocol(df, "m, n", ["a b"], ["f=g"]).first().value == "m\\,\\ n,a\\ b=x\\ y f\\=g=1i"


def test_endpoints(spark):
    df = spark.createDataFrame([(1, None, "v", 1.0), (2, "own", "v", 2.0), (3, None, None, 3.0)], "id long, endpoint string, vmname string, `vsphere.vm.cpu` double")
    df = df.withColumn("load", F.lit(5))
    rows = aggregates.to_samples(df, ["id"], ["vsphere.vm.cpu", "load"], ["endpoint", "vmname"], "here", 30).collect()
    assert {(r.id, r.metric): r.endpoint for r in rows} == {
        (1, "vsphere.vm.cpu"): "v", (2, "vsphere.vm.cpu"): "own", (3, "vsphere.vm.cpu"): "", (1, "load"): "here", (2, "load"): "own", (3, "load"): "here",
    }
    assert {r.tags for r in rows if r.id == 2} == {"endpoint=own,vmname=v"} and {r.step for r in rows} == {30}


def test_batches_of_a_stream_grow_by_files(spark, tmp_path, monkeypatch):
    """Four batches however large the table is; a batch of a larger one is more files."""
    monkeypatch.setattr(catalog, "FILE_ROWS", 50, raising=False)
    for rows, files_each in ((1000, 5), (40, 1)):
        top, got = f"{tmp_path}/{rows}", []
        stream = catalog._four_batches(spark.range(rows).select("id"), f"{top}/in")
        take = lambda df, k: got.append((df.count(), df.select(F.input_file_name()).distinct().count()))
        stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{top}/cp").trigger(availableNow=True).start().awaitTermination(120)
        assert sum(n for n, _ in got) == rows and [m for _, m in got] == [files_each] * 4
