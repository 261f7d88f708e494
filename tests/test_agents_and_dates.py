"""Long rule lists by required texts, replacement templates, and dates of the common shape."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.operators import joins


@pytest.mark.parametrize(
    ("regex", "text", "groups"),
    [
        (r"(Firefox)/(\d+)", "firefox", 1 + 1), (r"^Opera$", "opera", 0), (r"a|b", None, 0), (r"(?i)MSIE (\d)", "msie ", 1), (r"(foo)?barx+", "bar", 1), (r"(?:ab|cd)efg", "efg", 0),
        (r"[a[bc]]xyz", None, 0), (r"\p{L}+abc", None, 0), (r"\Qa(b\E(c)", None, 1), (r"(?<name>abc)\(", "abc", 1), (r"x[(](y)", "x(", 1), (r"(?=abc)d", None, 0), (r"(?:abc){0,2}d", None, 0), (r"abc&&d", None, 0),
    ],
)
def test_what_a_rule_requires(regex, text, groups):
    assert joins.groups_of(regex) == groups
    got = joins.required_text(regex)
    assert got == (text if text is None or len(text) >= 2 else None)


def rule_rows(rng, n):
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(n)]
    rows = [(i, rng.choice(["agent", "os", "device"]), rng.choice([rf"{w}/(\d+)\.(\d+)", rf"(?i)({w})", rf"(\w+) {w}", rf"{w}[ /](\d)?", r"\p{Lu}{3}(\d)" if i % 50 == 0 else rf"({w}|zz)x"]), rng.choice([None, w.upper(), "$1 of " + w]), rng.choice([None, "$2.$1"])) for i, w in enumerate(words)]
    agents = [" ".join(rng.choice([f"{w}/1.2", w.upper(), f"zz{w}x", f"{w} 7", "é", "ABC9"]) for w in rng.choices(words, k=3)) for _ in range(150)]
    return rows, agents + [None, "", "zzx"]


def test_index_of_rules_gives_what_the_rules_in_order_give(spark, monkeypatch):
    rows, agents = rule_rows(random.Random(2), 60)
    monkeypatch.setattr(joins, "INDEX_FROM", 10)
    rules = spark.createDataFrame(rows, "rule_no int, kind string, regex string, family string, version string")
    df = spark.createDataFrame([(a, i) for i, a in enumerate(agents * 2)], "ua string, agent int")
    columns = ["agent", *[f"UA_{k}_{p}" for k in ("agent", "device", "os") for p in ("family", "version")]]
    by_index = sorted(map(tuple, joins.user_agent(df, "ua", rules).select(columns).collect()))
    monkeypatch.setattr(joins, "INDEX_FROM", 1 << 30)
    in_order = sorted(map(tuple, joins.user_agent(df, "ua", rules).select(columns).collect()))
    assert by_index == in_order and sum(r[1] is not None for r in by_index) > 50


def test_templates_of_rules(spark):
    rules = spark.createDataFrame([(1, "agent", r"(Fire)(fox)/(\d+)\.(\d+)", "$1 and $2", "$3.$4"), (2, "agent", r"(Opera)(?:/(\d+))?", None, None)], "rule_no int, kind string, regex string, family string, version string")
    df = spark.createDataFrame([("Firefox/3.6",), ("Opera/9",), ("Opera",)], "ua string")
    got = [(r.UA_agent_family, r.UA_agent_version) for r in joins.user_agent(df, "ua", rules).collect()]
    assert got == [("Fire and fox", "3.6"), ("Opera", "9"), ("Opera", None)]


def test_dates_of_the_common_shape_by_both_ways(spark):
    rng = random.Random(4)
    texts = [f"{rng.randrange(1990, 2030)}{s}{rng.randrange(1, 14):02d}{s}{rng.randrange(1, 32):02d}{rng.choice(['', f'{t}10:11:12', f'{t}10:11:12.345', f'{t}23:59:59,9'])}{rng.choice(['', 'Z', ' +0800', '+08:00', '-0700'])}" for s, t in ((rng.choice("-/"), rng.choice("T ")) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    # With a layout of one's own that never fits, every text goes the long way.
    rows = df.select("t", dates.parsed(F.col("t")).alias("a"), dates.parsed(F.col("t"), ["'never'yyyy"]).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(r.a is not None for r in rows) > 300
    assert re.match(dates._ISO, texts[0])
