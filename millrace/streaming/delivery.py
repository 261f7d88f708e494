"""Delivery of batches to sinks, each row once: commits by batch, failing batches split down, dead letters and replay.

A sink is a function of rows and a key; it writes the rows of a key at most once, however often it is called with that
key, be it that it failed behind its write or that the driver was lost. `files_sink` and `jdbc_sink` make such sinks;
`plain` wraps a function that only writes, whose rows may come twice if it fails half-way. A sink may have a function
`has` (of a session and a key), which is asked after a failure; one without it is called again instead.

A batch is first written to the delivery folder, so that a batch that is tried again has the same rows though its plan
may not be deterministic. A ledger of marker files, by sink and key, tells which sinks have it. A batch that a sink does
not take after some tries is halved, level by level, until only rows are left that fail alone: these are its dead
letters, with an id of their own. A sink that takes no single row either is down: all rows become letters.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..paths import unused

Sink = Callable[[DataFrame, str], None]

LETTERS = "letter string, query string, batch_id long, sink string, row string, error string, at timestamp"
#: Letters that one write holds, and levels of halves that fail one and all before single rows are tried.
_AT_ONCE, _LEVELS = 1000, 3


def plain(write: Callable[[DataFrame], None]) -> Sink:
    def sink(df: DataFrame, key: str) -> None:
        write(df)

    sink.has = lambda spark, key: False
    return sink


def files_sink(path: str, format: str = "parquet", **options: str) -> Sink:
    """Files in the folder path/delivery=key, which appears as a whole; hidden folders beside it hold what is being written."""
    place = lambda key: f"{path.rstrip('/')}/delivery={key}"

    def sink(df: DataFrame, key: str) -> None:
        storage.write_once(df, place(key), format, **options)

    sink.has = lambda spark, key: storage.exists(spark, place(key))
    return sink


def jdbc_sink(url: str, table: str, ledger: str = "deliveries", **properties: str) -> Sink:
    """Rows of a database table: written to a table beside it, then taken over in one transaction with the key's entry in
    the ledger table. What the target lacks, and the ledger, is created."""

    def sink(df: DataFrame, key: str) -> None:
        spark, staged = df.sparkSession, f"{table}_staged"
        with _connection(spark, url, properties) as run:
            if not run.has_table(ledger):
                run.update(f"CREATE TABLE {ledger} (delivery VARCHAR(500) NOT NULL PRIMARY KEY)")
            if run.count(f"SELECT COUNT(*) FROM {ledger} WHERE delivery = ?", key):
                return
            df.limit(0).write.jdbc(url, table, "append", properties)
            df.write.jdbc(url, staged, "overwrite", properties)
            columns = ", ".join(map(run.quoted, df.columns))
            run.together(
                (f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staged}", ()),
                (f"INSERT INTO {ledger} (delivery) VALUES (?)", (key,)),
            )
            run.update(f"DROP TABLE {staged}")

    def has(spark: SparkSession, key: str) -> bool:
        with _connection(spark, url, properties) as run:
            return run.has_table(ledger) and run.count(f"SELECT COUNT(*) FROM {ledger} WHERE delivery = ?", key) > 0

    sink.has = has
    return sink


class _connection:
    """A connection of the driver to a database, by the JDBC driver that Spark's writer uses."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str]):
        jvm = spark._jvm
        options = jvm.java.util.HashMap()
        for k, v in ({"url": url, "dbtable": "t"} | properties).items():
            options.put(k, v)
        self.dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
        parsed = jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions(jvm.PythonUtils.toScalaMap(options))
        self.open = lambda: self.dialect.createConnectionFactory(parsed).apply(-1)

    def __enter__(self):
        self.own = self.open()
        return self

    def __exit__(self, *_):
        self.own.close()

    def quoted(self, name: str) -> str:
        return self.dialect.quoteIdentifier(name)

    def has_table(self, name: str) -> bool:
        try:
            self.count(f"SELECT COUNT(*) FROM {name}")
        except Exception as e:  # noqa: BLE001
            if "SQLException" not in str(e) and "SQLSyntaxErrorException" not in str(e):
                raise
            return False
        return True

    def _prepared(self, sql: str, values: tuple):
        statement = self.own.prepareStatement(sql)
        for i, v in enumerate(values):
            statement.setString(i + 1, v)
        return statement

    def count(self, sql: str, *values: str) -> int:
        statement = self._prepared(sql, values)
        try:
            found = statement.executeQuery()
            found.next()
            return found.getLong(1)
        finally:
            statement.close()

    def update(self, sql: str, *values: str) -> None:
        statement = self._prepared(sql, values)
        try:
            statement.executeUpdate()
        finally:
            statement.close()

    def together(self, *steps: tuple[str, tuple]) -> None:
        self.own.setAutoCommit(False)
        try:
            for sql, values in steps:
                self.update(sql, *values)
            self.own.commit()
        except Exception:
            self.own.rollback()
            raise
        finally:
            self.own.setAutoCommit(True)


class Ledger:
    """Which sink has which key: marker files in folders by sink, made after the sink succeeded."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def has(self, sink: str, key: str) -> bool:
        return storage.exists(self.spark, f"{self.path}/{sink}/{key}")

    def add(self, sink: str, key: str) -> None:
        storage.mark(self.spark, f"{self.path}/{sink}/{key}")

    def keys(self, sink: str) -> list[str]:
        return storage.names(self.spark, f"{self.path}/{sink}")

    def trim(self, sink: str, query: str, below: int) -> None:
        """Forget a query's batches below a number, which its checkpoint does not ask for again."""
        for key in self.keys(sink):
            own, _, number = key.rpartition("-")
            if own == query and number.isdigit() and int(number) < below:
                storage.remove(self.spark, f"{self.path}/{sink}/{key}")


def _numbered(df: DataFrame, path: str) -> DataFrame:
    """df with the place of each row in a ring of 2^64, written in the order of places, so that a part is read alone."""
    (place,) = unused(df.columns, "_place")
    rows = df.withColumn(place, F.xxhash64(F.monotonically_increasing_id()))
    storage.write_once(rows.repartitionByRange(place).sortWithinPartitions(place), path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


class _Splitting:
    """One sink's delivery of one batch. What was tried as a whole and failed is marked before its halves are tried, so that
    a delivery that starts again goes on with the halves, of which some may have arrived."""

    def __init__(self, rows: DataFrame, place: str, sink: Sink, name: str, ledger: Ledger, key: str):
        self.rows, self.place, self.sink, self.name, self.ledger, self.key = rows, place, sink, name, ledger, key

    def error_of(self, rows: DataFrame, key: str, tries: int = 1, sleep: float = 0.0) -> str | None:
        """None if the sink has the rows, also if it failed behind its write."""
        if self.ledger.has(self.name, key):
            return None
        has = getattr(self.sink, "has", None)
        last = ""
        for k in range(tries if has else max(2, tries)):
            try:
                self.sink(rows.drop(self.place), key)
            except Exception as e:  # noqa: BLE001
                last = str(e)[:500] or type(e).__name__
                if not (has and has(rows.sparkSession, key)):
                    time.sleep(sleep * (k + 1))
                    continue
            self.ledger.add(self.name, key)
            return None
        return last

    def run(self, tries: int, sleep: float, splits: Callable[[str], bool]) -> tuple[str | None, list[tuple[int, str]] | None]:
        """The last error (None if all arrived) and (place, error) of the rows left over; None for these: all rows."""
        split = f"{self.key}.split"
        last = None
        if not self.ledger.has(self.name, split):
            last = self.error_of(self.rows, self.key, tries, sleep)
            if last is None:
                return None, []
            if not splits(last):
                return last, None
            self.ledger.add(self.name, split)
        alone, level, went, depth = [], [(-(1 << 63), (1 << 63) - 1)], False, 0
        while level:
            below = []
            for low, high in level:
                own = self.rows.where(F.col(self.place).between(F.lit(low), F.lit(high)))
                held, first = own.limit(2).agg(F.count("*"), F.min(self.place)).first()
                if not held:
                    continue
                part = f"{self.key}.{low & (1 << 64) - 1:016x}-{high & (1 << 64) - 1:016x}"
                if depth and not self.ledger.has(self.name, f"{part}.split"):
                    error = self.error_of(own, part)
                    if error is None:
                        went = True
                        continue
                    last = error
                    if held == 1 or low == high:
                        alone.append((first, error))
                        continue
                    self.ledger.add(self.name, f"{part}.split")
                elif held == 1 or low == high:
                    error = self.error_of(own, f"{part}.alone")
                    if error is not None:
                        alone.append((first, error))
                    continue
                middle = (low + high) >> 1
                below += [(low, middle), (middle + 1, high)]
            level, depth = below, depth + 1
            if depth == _LEVELS + 1 and level and not went:
                if not self._takes_any(level):
                    return last, None
                went = True
        return (last if alone else None), alone

    def _takes_any(self, level: list[tuple[int, int]]) -> bool:
        """Whether the sink takes the first row of any part; that row is then done."""
        for low, high in level:
            first = self.rows.where(F.col(self.place).between(F.lit(low), F.lit(high))).agg(F.min(self.place)).first()[0]
            if first is None:
                continue
            if self.error_of(self.rows.where(F.col(self.place) == F.lit(first)), f"{self.key}.{first & (1 << 64) - 1:016x}") is None:
                self.rows = self.rows.where(F.col(self.place) != F.lit(first))
                return True
        return False


def _letters(rows: DataFrame, place: str, query: str, batch_id: int, name: str, key: str, error: DataFrame | str) -> DataFrame:
    """Dead letters of rows; error: one text, or a table (place, error) of the rows that become letters."""
    if isinstance(error, str):
        rows = rows.withColumn("_said", F.lit(error))
    else:
        rows = rows.join(F.broadcast(error.toDF(place, "_said")), place)
    columns = [c for c in rows.columns if c not in (place, "_said")]
    return rows.select(
        F.concat(F.lit(f"{key}."), F.lower(F.hex(place))).alias("letter"), F.lit(query).alias("query"), F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(name).alias("sink"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row"), F.col("_said").alias("error"), F.current_timestamp().alias("at"),
    )


def deliver(
    df: DataFrame, sinks: dict[str, Sink], folder: str, query: str = "batch", batch_id: int = 0, tries: int = 3, sleep: float = 0.1,
    splits: Callable[[str], bool] = lambda error: True,
) -> dict[str, str]:
    """Give a batch to every sink; the last error of each sink that did not take all of it, whose rows are dead letters.

    folder holds the batch while it is delivered, the ledger and the letters (folder/letters). Called again with the same
    query and batch_id, after a failure or a restart, it delivers what is missing and nothing twice. splits: whether an
    error comes from rows, so that halves may do; otherwise the batch stays undelivered and the error is raised, for the
    caller to try the batch again.
    """
    spark, key = df.sparkSession, f"{query}-{batch_id}"
    ledger = Ledger(spark, f"{folder}/ledger")
    failed, open_ = {}, [name for name in sinks if not ledger.has(name, f"{key}.done")]
    if not open_:
        return failed
    held = f"{folder}/batches/{key}"
    rows = _numbered(df, held)
    (place,) = unused(df.columns, "_place")
    for name in open_:
        last, alone = _Splitting(rows, place, sinks[name], name, ledger, key).run(tries, sleep, splits)
        if last is not None and alone is None and not splits(last):
            raise RuntimeError(f"{name}: {last}")
        if last is not None:
            failed[name] = last
            parts = [alone[i : i + _AT_ONCE] for i in range(0, len(alone), _AT_ONCE)] if alone is not None else [None]
            for i, part in enumerate(parts):
                error = last if part is None else spark.createDataFrame(part, "place long, said string")
                storage.write_once(_letters(rows, place, query, batch_id, name, f"{key}-{name}", error), f"{folder}/letters/delivery={key}-{name}-{i}")
        ledger.add(name, f"{key}.done")
    storage.remove(spark, held)
    return failed


def deliver_routed(df: DataFrame, sinks: list[Sink], folder: str, query: str, batch_id: int, column: str = "_route", **options) -> dict[str, str]:
    """Each row of a routed batch to the sink of its number; a number that no sink has goes to the first one."""
    n = F.col(column)
    known = F.coalesce(n.between(0, len(sinks) - 1), F.lit(False))

    def own(i: int) -> Sink:
        def sink(rows: DataFrame, key: str) -> None:
            sinks[i](rows.where(F.when(known, n).otherwise(0) == i).drop(column), key)

        if has := getattr(sinks[i], "has", None):
            sink.has = has
        return sink

    return deliver(df, {f"sink{i}": own(i) for i in range(len(sinks))}, folder, query, batch_id, **options)


def letters(spark: SparkSession, folder: str, sink: str | None = None) -> DataFrame:
    """Dead letters that are not yet replayed."""
    path = f"{folder}/letters"
    found = spark.read.schema(LETTERS).parquet(path) if storage.names(spark, path) else spark.createDataFrame([], LETTERS)
    found = found.where(F.col("sink") == sink) if sink else found
    done = f"{folder}/replayed"
    if not storage.names(spark, done):
        return found
    return found.join(spark.read.schema("letter string").parquet(done), "letter", "left_anti").select(*[c.split()[0] for c in LETTERS.split(", ")])


def replay(spark: SparkSession, folder: str, name: str, schema: str, sink: Sink, stash: Sink | None = None, tries: int = 1, sleep: float = 0.0) -> int:
    """Give a sink its dead letters again; the number it took. Each is given until it arrives, and then never again.

    Letters that still fail alone stay; with a stash, that gets them, as letters with the row as JSON text, and they are
    done. A replay that was cut off is taken up with the letters it had.
    """
    begun = f"{folder}/replays/{name}"
    number = next((n for n in storage.names(spark, begun) if n.isdigit() and not storage.exists(spark, f"{begun}/{n}.done")), None)
    number = number or f"{sum(n.endswith('.done') for n in storage.names(spark, begun)):09d}"
    storage.write_once(letters(spark, folder, name), f"{begun}/{number}")
    todo = spark.read.schema(LETTERS).parquet(f"{begun}/{number}")
    key, place = f"replay-{name}-{number}", "_place"
    rows = _numbered(todo, f"{folder}/batches/{key}")
    ledger = Ledger(spark, f"{folder}/ledger")

    def give(d: DataFrame, k: str) -> None:
        sink(d.select(F.from_json("row", schema).alias("r")).select("r.*"), k)

    if has := getattr(sink, "has", None):
        give.has = has
    n = 0
    if not rows.isEmpty():
        last, alone = _Splitting(rows, place, give, name, ledger, key).run(tries, sleep, lambda error: True)
        left = rows.limit(0) if last is None else rows if alone is None else rows.join(F.broadcast(spark.createDataFrame([(p,) for p, _ in alone], "place long").toDF(place)), place)
        if stash is not None and last is not None:
            stash(left.drop(place), key)
            left, lost = rows.limit(0), left.count()
        else:
            lost = 0
        done = rows.join(left.select(place), place, "left_anti") if last is not None else rows
        storage.write_once(done.select("letter"), f"{folder}/replayed/delivery={key}")
        n = done.count() - lost
    storage.mark(spark, f"{begun}/{number}.done")
    storage.remove(spark, f"{folder}/batches/{key}")
    return n
