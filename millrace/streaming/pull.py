"""Incremental pulls, late rows and event assembly."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import storage
from ..operators.aggregates import event_numbers, record_hash


def in_range(df: DataFrame, key: str, low, high) -> DataFrame:
    """Half-open range of an offset or timestamp; pushed down to the source."""
    return df.where((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high)))


def next_position(df: DataFrame, key: str, low, high):
    """Position after a pull of [low, high): the end of the range, or the next existing key beyond a gap."""
    ahead = df.where(F.col(key) >= F.lit(high)).agg(F.min(key)).first()[0]
    return high if ahead is None or ahead <= high else ahead


def unseen(df: DataFrame, key: str, last, delivered: DataFrame) -> DataFrame:
    """Rows at or after the last timestamp that were not delivered at exactly that timestamp.

    delivered: column `hash` of the boundary's rows. Rows without a timestamp are kept: rather twice than lost.
    """
    new = df.where((F.col(key) >= F.lit(last)) | F.col(key).isNull()).withColumn("_hash", record_hash(df))
    at_last = F.col(key) == F.lit(last)
    rest = new.where(~F.coalesce(at_last, F.lit(False)))
    again = new.where(at_last).join(delivered.select(F.col("hash").alias("_hash")), "_hash", "left_anti")
    return rest.unionByName(again).drop("_hash")


def boundary(df: DataFrame, key: str) -> DataFrame:
    """Hashes of the rows at the largest timestamp: the state that unseen() needs next time."""
    top = df.agg(F.max(key).alias("_top"))
    return df.withColumn("hash", record_hash(df)).join(F.broadcast(top), F.col(key) == F.col("_top")).select("hash")


#: State of a pull: its position, and the digests of rows that were delivered at or near it.
_DIGESTS = "digest string, at string"


class PullState:
    """Versions of a pull's state in a folder, each committed as a whole: 000000007 says how the pulls before number 7 ended.

    A version holds the position (JSON text of the key's type) and digests; only the last two versions are kept.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def number(self) -> int:
        return max([0, *(int(n) for n in storage.names(self.spark, self.path) if n.isdigit())])

    def read(self, kind: str) -> tuple[object, DataFrame]:
        """Position (None before the first pull) and delivered rows (digest, at) of the last version."""
        rows = None
        if n := self.number():
            rows = self.spark.read.schema(f"position {kind}, {_DIGESTS}").parquet(f"{self.path}/{n:09d}")
        if rows is None:
            return None, self.spark.createDataFrame([], f"digest string, at {kind}")
        position = rows.where("digest is null").first()
        return position and position["position"], rows.where("digest is not null").select("digest", F.col("at").cast(kind).alias("at"))

    def write(self, number: int, position, kind: str, delivered: DataFrame | None) -> None:
        head = self.spark.createDataFrame([(position, None, None)], f"position {kind}, {_DIGESTS}")
        if delivered is not None:
            head = head.unionByName(delivered.select(F.lit(None).cast(kind).alias("position"), "digest", F.col("at").cast("string").alias("at")))
        storage.write_once(head, f"{self.path}/{number:09d}")
        for name in storage.names(self.spark, self.path):
            old = name.removeprefix("pending-")
            if old.isdigit() and (int(old) < number - 1 or name != old and int(old) < number):
                storage.remove(self.spark, f"{self.path}/{name}")


def incremental_pull(read: Callable[[], DataFrame], key: str, state_path: str, sink: Callable[..., None], start, step=None, late: bool = False, lookback=None, keyed: bool = False) -> int:
    """One pull; returns its number of rows. The next one begins where this one ended.

    Rows with the key in [position, position + step) come in the order of the key, without a step all from the position on.
    By offset (the default) the next position is the end of the range, or the next existing key behind a gap. late: by time;
    rows at the position may come later, so it stays at the largest time delivered, and what was delivered there is known by
    the digests of its rows; lookback (a number or timedelta) also takes rows that are late by so much. Rows without a time
    are given by every pull: rather twice than lost.

    A pull's rows are written before the sink gets them, under the pull's number, and the state is replaced in one step
    afterwards: a pull that was cut off is taken up with the same rows. keyed: the sink gets that number as a second
    argument, and so can write nothing twice (see delivery).
    """
    if step is None and not late:
        raise ValueError("a pull by offset has a step")
    spark = SparkSession.getActiveSession()
    state, source = PullState(spark, state_path), read()
    kind = source.schema[key].dataType.simpleString()
    position, delivered = state.read(kind)
    position = start if position is None else position
    number = state.number()
    pending = f"{state.path}/pending-{number:09d}"
    low = position - lookback if late and lookback is not None else position
    if not storage.exists(spark, pending):
        end = None if step is None else position + step
        rows = source.where(F.col(key) >= F.lit(low)) if end is None else in_range(source, key, low, end)
        if late:
            if end is not None and rows.where(F.col(key) >= F.lit(position)).isEmpty() or _all_known(rows, key, position, delivered):
                # Nothing new in the range: go on to the next existing time.
                ahead = source.where(F.col(key) > F.lit(position)).agg(F.min(key)).first()[0]
                rows = source.where(F.col(key) >= F.lit(low)) if end is None else in_range(source, key, low, (ahead if ahead is not None else position) + step)
            rows = rows.withColumn("_digest", record_hash(source))
            rows = rows.join(delivered.select(F.col("digest").alias("_digest")).distinct(), "_digest", "left_anti").drop("_digest")
            rows = rows.unionByName(source.where(F.col(key).isNull())).select(*source.columns)
        storage.write_once(rows, pending)
    batch = spark.read.schema(source.schema).parquet(pending)
    n = batch.count()
    sink(batch.orderBy(key), f"pull-{number:09d}") if keyed else sink(batch.orderBy(key))
    if not late:
        state.write(number + 1, next_position(source, key, position, position + step), kind, None)
        return n
    top = batch.agg(F.max(key)).first()[0]
    after = position if top is None else max(position, top)
    kept = F.col("at") >= F.lit(after - lookback if lookback is not None else after)
    new = batch.where(F.col(key).isNotNull()).select(record_hash(source).alias("digest"), F.col(key).alias("at"))
    state.write(number + 1, after, kind, delivered.unionByName(new).where(kept).distinct())
    return n


def _all_known(rows: DataFrame, key: str, position, delivered: DataFrame) -> bool:
    """Whether a range holds nothing beyond the rows that were delivered at or before the position."""
    if not rows.where(F.col(key) > F.lit(position)).isEmpty():
        return False
    own = rows.select(record_hash(rows).alias("digest"))
    return own.join(delivered, "digest", "left_anti").isEmpty()


def assemble(lines: DataFrame, head: str, source: str = "_source", order: list[str] = ("_order",), max_chars: int | None = None) -> DataFrame:
    """Multi-line events: lines up to the next one that matches the head pattern, in file order.

    max_chars ends an event early, as a full buffer would.
    """
    is_head = F.regexp_like("value", F.lit(head))
    rows = event_numbers(lines, is_head, source, list(order))
    keys = [source, "_event"]
    if max_chars:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_part", F.floor((F.sum(F.char_length("value") + 1).over(w) - 1) / max_chars))
        keys.append("_part")
    parts = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, "value"))).alias("_l"))
    return parts.select(source, F.col("_event").alias("event_no"), F.array_join(F.col("_l.value"), "\n").alias("value"))


def assemble_whole_files(spark: SparkSession, path: str, head: str, streaming: bool = False) -> DataFrame:
    """Events of rotated files, one file a row: no state, also in streams."""
    reader = spark.readStream if streaming else spark.read
    files = reader.text(path, wholetext=True)
    events = F.split("value", f"(?m)(?=^(?:{head}))")
    return files.select(F.explode(events).alias("value")).where("value <> ''")


def windowed(df: DataFrame, time: str, period: str, delay: str, by: list[str], *aggregates: Column) -> DataFrame:
    """Tumbling periods that wait `delay` for late rows."""
    return df.withWatermark(time, delay).groupBy(F.window(time, period), *by).agg(*aggregates)


def trigger_options(seconds: int = 60, max_files: int | None = None, max_bytes: int | None = None, max_offsets: int | None = None) -> tuple[dict, dict]:
    """Micro-batch limits: arguments of trigger(), and options of the source."""
    options = {"maxFilesPerTrigger": max_files, "maxBytesPerTrigger": max_bytes, "maxOffsetsPerTrigger": max_offsets}
    return {"processingTime": f"{seconds} seconds"}, {k: str(v) for k, v in options.items() if v}


def lag(progress: dict) -> int:
    """Records that a Kafka source has but the query has not taken, from a progress report."""
    total = 0
    for source in progress.get("sources", []):
        end, latest = source.get("endOffset") or {}, source.get("latestOffset") or {}
        for topic, parts in latest.items():
            total += sum(int(v) - int(end.get(topic, {}).get(p, 0)) for p, v in parts.items())
    return total


#: The state store that keeps lists and timers; a session names it before a query with open_events starts.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timed_state(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """Queries that start in this block keep their state in RocksDB, which holds lists and timers.

    idle: timers also end in batches without rows, so the query goes on for ever, with an availableNow trigger, too; without
    it timers wait for the next batch with rows, and an availableNow query ends with its last row.
    """
    own = {STATE_STORE: ROCKS_DB, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class _OpenEvents(StatefulProcessor):
    """The open event of a log: its lines in a list that grows at its end, their number and the timer beside it."""

    def __init__(self, head: str, max_lines: int, millis: int, max_chars: int | None):
        self.head, self.max_lines, self.millis, self.max_chars = head, max_lines, millis, max_chars

    def init(self, handle) -> None:
        self.pattern, self.handle = re.compile(self.head), handle
        self.lines = handle.getListState("lines", "value string")
        self.size = handle.getValueState("size", "lines long, chars long, timer long")

    def _taken(self, new: list[str]) -> str:
        stored = [row[0] for row in self.lines.get()]
        self.lines.clear()
        return "\n".join([*stored, *new])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        n, chars, timer = self.size.get() if self.size.exists() else (0, 0, None)
        new, out = [], []
        for value in batch["value"]:
            if value is None:
                continue
            full = n >= self.max_lines or self.max_chars is not None and chars + len(value) + 1 > self.max_chars
            if n and (full or self.pattern.search(value)):
                out.append(self._taken(new))
                new, n, chars = [], 0, 0
            new.append(value)
            n, chars = n + 1, chars + len(value) + 1
        if new:
            self.lines.appendList([(value,) for value in new])
        if n:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.millis
            self.handle.registerTimer(timer)
            self.size.update((n, chars, timer))
        if out:
            yield pd.DataFrame({"log": key[0], "value": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.size.exists():
            self.size.clear()
            yield pd.DataFrame({"log": [key[0]], "value": [self._taken([])]})

    def close(self) -> None:
        pass


def open_events(lines: DataFrame, head: str, max_lines: int = 100, timeout: str = "60 seconds", max_chars: int | None = None) -> DataFrame:
    """Events of a stream that may cross rotated files: (log, line_no, value) keyed by log, the open event kept as state.

    It ends with the next head line, at max_lines or max_chars, or when nothing came for the timeout. Lines of a log are put
    in order within a micro-batch, whose limits (see trigger_options) so bound what a task holds; of the open event only new
    lines are written. Null lines are left out. The query must start inside timed_state, or in a session that has RocksDB as
    its state store anyway.
    """
    spark = lines.sparkSession
    if "RocksDB" not in (spark.conf.get(STATE_STORE, None) or ""):
        raise ValueError(f"open_events needs {STATE_STORE}={ROCKS_DB}; see timed_state")
    own = _OpenEvents(head, max_lines, int(pd.Timedelta(timeout).total_seconds() * 1000), max_chars)
    return lines.groupBy("log").transformWithStateInPandas(own, "log string, value string", "append", "processingTime")
