"""Commits by batch, failing batches split down, letters and replay, pulls that remember, totals and status of streams."""

import datetime
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from millrace import errors, storage
from millrace.operators import aggregates
from millrace.plans import spec
from millrace.sources import files
from millrace.streaming import delivery, pull
from millrace.streaming.status import SCHEMA, Status
from millrace.streaming.totals import Totals


def once(sink, fails, behind=True):
    """A sink that fails so many times, behind its write or before it."""
    left = [fails]

    def own(df, key):
        if behind:
            sink(df, key)
        if left[0]:
            left[0] -= 1
            raise RuntimeError("failed once")
        if not behind:
            sink(df, key)

    own.has = sink.has
    return own


def ids(spark, path, column="id"):
    return sorted(r[0] for r in spark.read.parquet(path).select(column).collect())


def test_a_sink_that_fails_behind_its_write_has_each_row_once(spark, tmp_path):
    df, top = spark.range(100), str(tmp_path)
    sinks = {"a": once(delivery.files_sink(f"{top}/a"), 1), "b": once(delivery.files_sink(f"{top}/b"), 2, behind=False), "c": delivery.files_sink(f"{top}/c")}
    assert delivery.deliver(df, sinks, f"{top}/d", "q", 7, sleep=0) == {}
    assert delivery.deliver(df, sinks, f"{top}/d", "q", 7, sleep=0) == {}
    for name in sinks:
        assert ids(spark, f"{top}/{name}") == list(range(100))
    assert delivery.letters(spark, f"{top}/d").count() == 0


def test_a_batch_that_is_cut_off_goes_on_with_the_same_rows(spark, tmp_path):
    """The plan gives other rows each time; the second sink stops the first try, the first one has the batch by then."""
    top, down = str(tmp_path), [True]

    def broken(df, key):
        if down[0]:
            raise KeyboardInterrupt

    broken.has = lambda spark, key: False
    good, late = delivery.files_sink(f"{top}/good"), delivery.files_sink(f"{top}/late")

    def second(df, key):
        broken(df, key)
        late(df, key)

    second.has = late.has
    rows = lambda: spark.range(50).select("id", F.rand().alias("r"))
    with pytest.raises(KeyboardInterrupt):
        delivery.deliver(rows(), {"good": good, "late": second}, f"{top}/d", "q", 0)
    down[0] = False
    assert delivery.deliver(rows(), {"good": good, "late": second}, f"{top}/d", "q", 0) == {}
    a, b = (sorted(map(tuple, spark.read.parquet(f"{top}/{n}").select("id", "r").collect())) for n in ("good", "late"))
    assert a == b and len(a) == 50


def picky(sink, bad):
    """A sink that takes no batch with a bad row in it."""

    def own(df, key):
        if not df.where(F.col("id").isin(bad)).isEmpty():
            raise ValueError("bad row")
        sink(df, key)

    own.has = sink.has
    return own


def test_one_bad_row_of_many_is_the_only_letter(spark, tmp_path):
    top, sink = str(tmp_path), delivery.files_sink(f"{tmp_path}/out")
    df = spark.range(10_000)
    failed = delivery.deliver(df, {"s": picky(sink, [4711])}, f"{top}/d", "q", 1, sleep=0)
    assert failed == {"s": "bad row"}
    (letter,) = delivery.letters(spark, f"{top}/d").collect()
    assert (letter.sink, letter.row, letter.error, letter.batch_id) == ("s", '{"id":4711}', "bad row", 1)
    assert ids(spark, f"{top}/out") == [i for i in range(10_000) if i != 4711]
    # Delivered again, nothing more comes.
    delivery.deliver(df, {"s": picky(sink, [4711])}, f"{top}/d", "q", 1, sleep=0)
    assert spark.read.parquet(f"{top}/out").count() == 9999 and delivery.letters(spark, f"{top}/d").count() == 1
    # A replay that fails keeps it; one that works gives it once; a letter that was stamped long ago counts as well.
    old = spark.createDataFrame([("x.1", "q", 0, "s", '{"id":-5}', "e", datetime.datetime(2001, 1, 1))], delivery.LETTERS)
    old.write.parquet(f"{top}/d/letters/delivery=old")
    assert delivery.replay(spark, f"{top}/d", "s", "id long", picky(sink, [4711])) == 1
    assert delivery.replay(spark, f"{top}/d", "s", "id long", sink) == 1
    assert delivery.replay(spark, f"{top}/d", "s", "id long", sink) == 0
    assert ids(spark, f"{top}/out") == [-5, *range(10_000)]


def test_what_still_fails_alone_goes_to_the_stash(spark, tmp_path):
    top, sink, stash = str(tmp_path), delivery.files_sink(f"{tmp_path}/out"), delivery.files_sink(f"{tmp_path}/stash")
    delivery.deliver(spark.range(40), {"s": picky(sink, [3, 17])}, f"{top}/d", "q", 1, sleep=0)
    assert delivery.replay(spark, f"{top}/d", "s", "id long", picky(sink, [3]), stash) == 1
    assert ids(spark, f"{top}/stash", "row") == ['{"id":3}'] and delivery.letters(spark, f"{top}/d").count() == 0
    assert ids(spark, f"{top}/out") == [i for i in range(40) if i != 3]


def test_a_sink_that_is_down_gets_its_letters_later(spark, tmp_path):
    top, tried = str(tmp_path), []

    def down(df, key):
        tried.append(key)
        raise RuntimeError("down")

    down.has = lambda spark, key: False
    assert delivery.deliver(spark.range(3000), {"s": down}, f"{top}/d", sleep=0) == {"s": "down"}
    assert len(tried) < 200 and delivery.letters(spark, f"{top}/d").count() == 3000
    sink = delivery.files_sink(f"{top}/out")
    assert delivery.replay(spark, f"{top}/d", "s", "id long", sink) == 3000 and ids(spark, f"{top}/out") == list(range(3000))
    with pytest.raises(RuntimeError, match="down"):
        delivery.deliver(spark.range(3), {"s": down}, f"{top}/d", "whole", sleep=0, splits=lambda error: False)
    ledger = delivery.Ledger(spark, f"{top}/d/ledger")
    ledger.add("s", "q-1")
    ledger.trim("s", "q", 2)
    assert "q-1" not in ledger.keys("s") and "batch-0.done" in ledger.keys("s")


def test_many_bad_rows_beside_good_ones(spark, tmp_path):
    """More failing parts than levels allow: a single good row shows that the sink is up."""
    top, bad = str(tmp_path), [i for i in range(42) if i % 3]
    sink = delivery.files_sink(f"{top}/out")
    delivery.deliver(spark.range(42), {"s": picky(sink, bad)}, f"{top}/d", sleep=0)
    assert ids(spark, f"{top}/out") == list(range(0, 42, 3)) and delivery.letters(spark, f"{top}/d").count() == 28


def test_rows_of_a_database_come_once(spark, tmp_path):
    url, driver = "jdbc:derby:memory:once;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    sink = delivery.jdbc_sink(url, "target", **driver)
    df = spark.range(30).select("id", F.concat(F.lit("v"), "id").alias("text"))
    assert delivery.deliver(df, {"db": once(sink, 1)}, f"{tmp_path}/d", "q", 0, sleep=0) == {}
    sink(df, "q-0")
    sink(df.where("id < 5"), "q-1")
    got = spark.read.jdbc(url, "target", properties=driver)
    assert sorted(r.id for r in got.collect()) == sorted([*range(30), *range(5)])
    assert sink.has(spark, "q-1") and not sink.has(spark, "q-2")


def test_a_stream_that_fails_and_starts_again_has_each_row_once(spark, tmp_path, monkeypatch):
    top = str(tmp_path)
    os.makedirs(f"{top}/in")
    plan = {"parser": {"type": "grok", "patterns": ["^%{INT:n:long} %{WORD:w}$"]}, "route": {"key": "w", "routes": [("equal", "a", 1)]}}
    for i in range(3):
        with open(f"{top}/in/{i}.log", "w") as f:
            f.write("".join(f"{k} {'ab'[k % 2]}\n" for k in range(i * 10, i * 10 + 10)) + "broken\n")
    zero, one, dead = (delivery.files_sink(f"{top}/{n}") for n in ("zero", "one", "dead"))
    real, left = delivery.Ledger.add, [3]

    def add(self, sink, key):
        left[0] -= 1
        if left[0] == 0:
            raise RuntimeError("the driver is lost behind a write")
        real(self, sink, key)

    monkeypatch.setattr(delivery.Ledger, "add", add)
    status = Status(spark, f"{top}/status")
    start = lambda: spec.run_stream(files.stream_lines(spark, f"{top}/in", max_files=1), plan, [zero, one], f"{top}/cp", dead, folder=f"{top}/d", query="s", status=status)
    with pytest.raises(Exception, match="lost behind"):
        start().awaitTermination(60)
    start().awaitTermination(60)
    assert sorted(r.n for r in spark.read.parquet(f"{top}/zero").collect()) == list(range(1, 30, 2))
    assert sorted(r.n for r in spark.read.parquet(f"{top}/one").collect()) == list(range(0, 30, 2))
    assert spark.read.parquet(f"{top}/dead").count() == 3
    got = status.table().where("stage = 'spec'").groupBy("batch_id").agg(F.max("ok").alias("ok"), F.max("failed").alias("failed"), F.max("message").alias("m")).orderBy("batch_id").collect()
    assert [(r.ok, r.failed, r.m) for r in got] == [(10, 1, "no pattern matches")] * 3


def test_status_of_a_running_query(spark, tmp_path):
    top = str(tmp_path)
    os.makedirs(f"{top}/in")
    for i in range(3):
        with open(f"{top}/in/{i}.txt", "w") as f:
            f.write("".join(f"{k}\n" for k in range(10)) + "x\n" * i)
    status = Status(spark, f"{top}/status", hold=2)
    spark.streams.addListener(status)
    try:
        rows = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{top}/in")
        rows = errors.with_error(rows, F.col("value").try_cast("int").isNull(), "cast", "value", "no number")
        query = errors.observed(rows, "parse").writeStream.queryName("numbers").format("noop").option("checkpointLocation", f"{top}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        deadline = datetime.datetime.now() + datetime.timedelta(seconds=20)
        while status.table().where("stage = 'parse'").count() < 3 and datetime.datetime.now() < deadline:
            pass
    finally:
        spark.streams.removeListener(status)
    table = status.table()
    parse = table.where("stage = 'parse' and ok + failed > 0")
    (health,) = aggregates.health(parse).collect()
    assert (health.ok, health.failed, health.last_error, health.batches) == (30, 3, "value: no number", 3)
    assert table.where("stage = 'batch'").agg(F.sum("ok")).first()[0] == 33
    assert {r.query for r in table.collect()} == {"numbers"}


def test_status_is_read_while_another_thread_writes_it(spark, tmp_path, monkeypatch):
    """What is being written is no part of the table, and a reader waits for it."""
    own, seen, got, real = Status(spark, f"{tmp_path}/status"), [], [], storage.commit
    own.add("q", "s", 0, 1)
    own.flush()

    def commit(spark, staged, path):
        seen.append(spark.read.schema(SCHEMA).parquet(own.path).count())
        reader.start()
        reader.join(2)
        return real(spark, staged, path)

    monkeypatch.setattr(storage, "commit", commit)
    reader = threading.Thread(target=lambda: got.append(own.table().count()))
    own.add("q", "s", 1, 1)
    own.flush()
    reader.join(60)
    assert (seen, got) == ([1], [2])


def test_totals_of_a_stream_equal_the_batch(spark, tmp_path):
    top, rng = str(tmp_path), random.Random(5)
    data = [(rng.choice("abcde"), rng.choice([None, 1.0, 2.5, 4.0])) for _ in range(300)]
    for i in range(6):
        spark.createDataFrame(data[i * 50 : i * 50 + 50], "k string, v double").coalesce(1).write.mode("append").parquet(f"{top}/in")
    own = lambda: Totals(spark, f"{top}/totals", ["k"], {"v": "total"}, buckets=3)
    stream = lambda: spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    broken, real = own(), Totals.add

    def add(self, df, batch_id):
        real(self, df, batch_id)
        if batch_id == 3:
            raise RuntimeError("lost behind the write")

    Totals.add = add
    try:
        with pytest.raises(Exception, match="lost behind"):
            broken.stream(stream(), f"{top}/cp", merge_every=2).awaitTermination(120)
    finally:
        Totals.add = real
    own().stream(stream(), f"{top}/cp", merge_every=2).awaitTermination(120)
    want = {r.k: r.total for r in aggregates.accumulate(spark.read.parquet(f"{top}/in"), ["k"], {"v": "total"}).collect()}
    assert {r.k: r.total for r in own().read().collect()} == want
    assert [tuple(r) for r in own().read(k="c").collect()] == [("c", want["c"])]
    own().merge()
    own().merge()
    assert {r.k: r.total for r in own().read().collect()} == want
    assert not own().add(spark.read.parquet(f"{top}/in"), 2)


def test_pulls_that_remember(spark, tmp_path):
    """Three pulls by time with rows that come late at the position, and rows that repeat; one pull is cut off."""
    state, got = str(tmp_path / "state"), []
    day = lambda d: datetime.datetime(2024, 1, d)
    first = [(day(1), "a"), (day(2), "b"), (day(2), "c")]
    second = [*first, (day(2), "late"), (day(3), "d"), (day(3), "e")]
    third = [*second, (day(3), "late too"), (day(9), "f"), (day(1), "too late")]
    frame = lambda rows: spark.createDataFrame(rows, "t timestamp, v string")
    take = lambda rows, **more: pull.incremental_pull(lambda: frame(rows), "t", state, lambda d: got.extend(r.v for r in d.collect()), day(1), late=True, **more)
    assert [take(first), take(first), take(second)] == [3, 0, 3]

    def cut(df):
        raise RuntimeError("cut off")

    with pytest.raises(RuntimeError):
        pull.incremental_pull(lambda: frame(third), "t", state, cut, day(1), late=True)
    assert [take(third + [(day(9), "later still")]), take(third + [(day(9), "later still")]), take(third)] == [2, 1, 0]
    assert sorted(got) == sorted(["a", "b", "c", "late", "d", "e", "late too", "f", "later still"])
    assert len([n for n in storage.names(spark, state) if n.isdigit()]) == 2


def test_pulls_with_a_look_back_and_a_step(spark, tmp_path):
    got, rows = [], []
    take = lambda path, **more: pull.incremental_pull(lambda: spark.createDataFrame(rows, "t long, v long"), "t", str(tmp_path / path), lambda d, key: got.extend(r.v for r in d.collect()), 0, late=True, keyed=True, **more)
    rng = random.Random(3)
    for k in range(5):  # each row comes up to 20 behind the newest
        rows += [(max(0, k * 100 + 100 - rng.randrange(20)), k * 10 + i) for i in range(10)] + [(k * 100 + 100, 1000 + k)]
        take("back", lookback=20)
    assert sorted(got) == sorted(v for _, v in rows)
    got.clear()
    for _ in range(40):
        if not take("step", step=50) and len(got) == len(rows):
            break
    assert sorted(got) == sorted(v for _, v in rows)


def test_pull_by_offset_jumps_gaps_and_is_taken_up(spark, tmp_path):
    df, got = spark.createDataFrame([(i, "x") for i in [1, 2, 3, 50, 51, 300]], "id long, v string"), []
    for _ in range(6):
        pull.incremental_pull(lambda: df, "id", str(tmp_path / "s"), lambda b: got.extend(r.id for r in b.collect()), 0, 10)
    assert got == [1, 2, 3, 50, 51, 300]
    with pytest.raises(ValueError):
        pull.incremental_pull(lambda: df, "id", str(tmp_path / "s"), print, 0)
