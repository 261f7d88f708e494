"""Rows and values that must not get lost, and lines that must not end a job."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import convert, text
from millrace.operators import joins
from millrace.plans import spec
from millrace.sources import files, parse, sinks


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_audit_repeated_keys(spark):
    rows = parse.audit(
        lines(
            spark,
            "type=A dev=a dev_1=b dev=c",
            "type=A msg=audit(1.5:7): msg='op=x op=y addr=? res=ok op=z'",
            "k=1 k=2 k=3 k=4 k=5 k=6 k=7",
            "type=A x=1",
        )
    ).collect()
    assert rows[0].fields == {"type": "A", "dev": "a", "dev_1": "b", "dev_2": "c"}
    assert rows[1].msg == {"op": "x", "op_1": "y", "op_2": "z", "addr": "?", "res": "ok"} and rows[1].addr is None
    assert rows[2].fields == {"k": "7", "k_1": "2", "k_2": "3", "k_3": "4", "k_4": "5", "k_5": "6"}
    assert rows[3].fields == {"type": "A", "x": "1"}


def test_syslog_repeated_names(spark):
    head = "<34>1 2003-10-11T22:14:15.003Z host app 1 ID47 "
    rows = parse.syslog(lines(spark, head + '[x@1 a="1" a="2" b="3"] m', head + '[x@1 a="1"][y@1 c="1"][x@1 a="9"] m')).collect()
    assert rows[0].structured_data == {"x@1": {"a": "2", "b": "3"}}
    assert rows[1].structured_data == {"x@1": {"a": "9"}, "y@1": {"c": "1"}}


def test_captures_keep_the_separator_of_captures(spark):
    df = parse.grok(lines(spark, "1 a\u0001b", "\u00012 c", "\u0001\u0001 x", "3 d", "4 e\u0001"), [r"^%{NUMBER:n:long} %{GREEDYDATA:w}$", r"^\x01%{NUMBER:n:long} %{GREEDYDATA:w}$"])
    assert sorted(map(tuple, df.select("n", "w").where("n is not null").collect())) == [(1, "a\u0001b"), (2, "c"), (3, "d"), (4, "e\u0001")]
    assert df.where(F.size("_errors") > 0).select("raw_line").first().raw_line == "\u0001\u0001 x"


def test_failed_conversions_keep_the_old_value(spark):
    df = spark.createDataFrame([("x", ["1", "y"], "7"), ("3", None, "z")], "a string, b array<string>, c string")
    rows = convert.convert(df, "a long, b array(long), c long 5").collect()
    assert [(r.a, r.c) for r in rows] == [(None, 7), (3, 5)]
    assert [[(e.key, e.message) for e in r._errors] for r in rows][0][0] == ("a", "not a bigint: x")
    assert rows[1]._errors == []  # the default has taken the place of z


def test_routes_that_no_sink_has(spark):
    got = []
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 5), (4, None), (5, -1)], "x int, _route int")
    spec.write_routed(df, [lambda d: got.append(sorted(r.x for r in d.collect())) for _ in range(2)])
    assert got == [[1, 3, 4, 5], [2]]
    config = {"source": {"type": "parquet", "path": "none"}, "route": {"key": "x", "routes": [("equal", "1", 2)]}, "sinks": [{"type": "discard"}] * 2}
    with pytest.raises(ValueError, match=r"routes to sinks \[2\] of 2"):
        spec.run(spark, config)


def test_line_protocol_leaves_no_broken_line(spark):
    df = spark.createDataFrame([("a\nb", float("nan"), "x\r\ny", 1.5), ("c", float("inf"), None, None), ("d", 2.0, "", None)], "t string, v double, s string, w double")
    got = [r.value for r in sinks.line_protocol(df, "m", ["t"], ["v", "s", "w"]).collect()]
    assert got == [r'm,t=a\ b s="x\r\ny",w=1.5', 'm,t=d s="",v=2.0']


def test_quotes_in_bounds_are_doubled():
    assert files.range_query("SELECT 1", "k", "a'b", "c").endswith("q.k >= 'a''b' AND q.k < 'c'")


def test_aligned_blocks_make_up_a_range(spark):
    rng = random.Random(4)
    top = (1 << 32) - 1
    data = [(0, top), (0, 0), (top, top), (1, top), (0, top - 1), (5, 5), (7, 8)]
    data += [(a, min(top, a + rng.randrange(1 << rng.randrange(33)))) for a in (rng.randrange(1 << 32) for _ in range(200))]
    for r in spark.createDataFrame(data, "s long, e long").select("s", "e", joins.aligned_blocks(F.col("s"), F.col("e")).alias("b")).collect():
        own = sorted((b.prefix << b.bits, (b.prefix + 1) << b.bits) for b in r.b)
        assert own[0][0] == r.s and own[-1][1] == r.e + 1 and all(x[1] == y[0] for x, y in zip(own, own[1:])) and len(own) <= 62


@pytest.mark.parametrize("small", [True, False])
def test_ip_ranges_with_ties(spark, small, monkeypatch):
    """Both forms against brute force: narrowest, then smallest start, then least attributes."""
    rng = random.Random(8)
    top = (1 << 32) - 1
    data = [(0, top, "all", 1), (0, top, "Whole", None), (10, 19, "b", 1), (10, 19, "a", 2), (15, 24, "a", 0), (5, 3, "empty", 1), (-5, 30, "below", 1), (top - 3, top + 9, "above", 1)]
    data += [(s, s + rng.choice([1, 15, 255, 65535, 1 << 24]), f"n{i % 7}", i % 3) for i, s in enumerate(rng.randrange(1 << 32) & -(1 << rng.choice([0, 8, 16, 24])) for _ in range(150))]
    ranges = spark.createDataFrame(data, "start long, end long, name string, n int")
    ips = [*range(0, 40), top, top - 3, top - 4, *[s + d for s, *_ in data[8:] for d in (-1, 0, 1, 14)], *[rng.randrange(1 << 32) for _ in range(200)]]
    ips = [i for i in ips if 0 <= i <= top]
    df = spark.createDataFrame([(".".join(str(i >> k & 255) for k in (24, 16, 8, 0)), i) for i in ips] + [(None, -1), ("x", -2)], "ip string, id long")
    monkeypatch.setattr(joins, "is_small", lambda *_: small)

    def json(name, n):
        return f'{{"name":"{name}","n":{"null" if n is None else n}}}'

    for r in joins.ip_ranges(df, "ip", ranges).collect():
        fits = sorted((e - s, s, json(name, n), name, n) for s, e, name, n in data if s <= r.id <= e and r.id >= 0)
        assert (r.name, r.n) == (fits[0][3:] if fits else (None, None)), r


def test_map_replace_takes_the_least_value(spark):
    table = spark.createDataFrame([(1, "z"), (1, "b"), (2, "c")], "k int, v string")
    got = joins.map_replace(spark.createDataFrame([(1,), (2,), (3,)], "x int"), "x", table)
    assert sorted(r.x for r in got.collect()) == ["3", "b", "c"]


def test_first_free_names(spark):
    df = spark.createDataFrame([(["a", "a_1", "a"], ["1", "2", "3"]), ([], [])], "k array<string>, v array<string>")
    assert [r[0] for r in df.select(text.first_free(F.col("k"), F.col("v"))).collect()] == [{"a": "1", "a_1": "2", "a_2": "3"}, {}]
