"""Paged services and request bodies as data sources of Spark: spark.read / readStream / write .format("paged_http").

Reading: options url and body with {page}, first, last (batch) or none (stream), method, headers (JSON), pages_per_task. A
partition is one page unless pages_per_task says more; columns page and value. A stream asks by HEAD which pages there are
beyond the last one, at most pages_per_batch of them; its offsets are page numbers, so a restart reads no page twice.

Writing: rows of (key, body), POSTed to url by the tasks. A body that was answered is marked in the folder `marks`, which
driver and executors share, by the name `delivery` and its key; a task that is tried again, or a delivery that is written
again after a failure, skips what is marked. Every request carries the mark's name as Idempotency-Key, for a service that
drops repetitions: only a task that dies between answer and mark sends a body twice. commit marks the delivery as a whole;
abort leaves the marks for the next try.
"""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "paged_http"
SCHEMA = "page long, value string"
TIMEOUT = 60


class Pages(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _Service:
    """The requests that the options describe."""

    def __init__(self, options: dict[str, str]):
        if "url" not in options:
            raise ValueError("paged_http needs an url")
        self.url, self.body = options["url"], options.get("body")
        self.method = options.get("method", "GET")
        self.headers = json.loads(options.get("headers", "{}"))

    def _open(self, page: int, method: str, data: bytes | None):
        return urllib.request.urlopen(urllib.request.Request(self.url.replace("{page}", str(page)), data, self.headers, method=method), timeout=TIMEOUT)

    def fetch(self, page: int) -> str:
        data = self.body.replace("{page}", str(page)).encode() if self.body else None
        with self._open(page, self.method, data) as r:
            if r.status != 200:
                raise OSError(f"status {r.status} for page {page}")
            return r.read().decode()

    def has(self, page: int) -> bool:
        try:
            with self._open(page, "HEAD", None) as r:
                return r.status == 200
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                return False
            raise

    def read(self, partition: Pages) -> Iterator[tuple[int, str]]:
        for page in range(partition.first, partition.end):
            yield page, self.fetch(page)


def _parts(first: int, end: int, size: int) -> list[Pages]:
    return [Pages(p, min(p + size, end)) for p in range(first, end, size)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.service, self.size = _Service(options), int(options.get("pages_per_task", 1))
        if "last" not in options:
            raise ValueError("reading a paged service as a table needs the last page")
        self.first, self.last = int(options.get("first", 1)), int(options["last"])

    def partitions(self) -> list[Pages]:
        return _parts(self.first, self.last + 1, self.size)

    def read(self, partition: Pages) -> Iterator[tuple[int, str]]:
        yield from self.service.read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.service, self.size = _Service(options), int(options.get("pages_per_task", 1))
        self.first, self.most = int(options.get("first", 1)), int(options.get("pages_per_batch", 100))
        self.next = None

    def initialOffset(self) -> dict:
        return {"page": self.first}

    def latestOffset(self) -> dict:
        begin = self.first if self.next is None else self.next
        end = begin
        while end < begin + self.most and self.service.has(end):
            end += 1
        self.next = end
        return {"page": end}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.next = max(self.next or 0, end["page"])
        return _parts(start["page"], end["page"], self.size)

    def commit(self, end: dict) -> None:
        self.next = max(self.next or 0, end["page"])

    def read(self, partition: Pages) -> Iterator[tuple[int, str]]:
        yield from self.service.read(partition)


@dataclass
class _Sent(WriterCommitMessage):
    sent: int
    skipped: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        for name in ("url", "marks", "delivery"):
            if name not in options:
                raise ValueError(f"writing to {NAME} needs {name}")
        self.url, self.marks, self.delivery = options["url"], options["marks"], options["delivery"]
        self.headers = json.loads(options.get("headers", "{}"))

    def _folder(self):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.marks)
        folder = f"{path.rstrip('/')}/{self.delivery}"
        files.create_dir(folder, recursive=True)
        return files, folder

    def write(self, iterator) -> _Sent:
        from pyarrow import fs

        files, folder = self._folder()
        there = lambda name: files.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound
        whole, sent, skipped = there("_SUCCESS"), 0, 0
        for row in iterator:
            name = hashlib.sha256(f"{self.delivery}\x1f{row['key']}".encode()).hexdigest()
            if whole or there(name):
                skipped += 1
                continue
            request = urllib.request.Request(self.url, row["body"].encode(), self.headers | {"Idempotency-Key": name}, method="POST")
            with urllib.request.urlopen(request, timeout=TIMEOUT) as r:
                if r.status >= 300:
                    raise OSError(f"status {r.status}")
            files.open_output_stream(f"{folder}/{name}").close()
            sent += 1
        return _Sent(sent, skipped)

    def commit(self, messages: list[_Sent | None]) -> None:
        files, folder = self._folder()
        files.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages: list[_Sent | None]) -> None:
        """The marks stay: the next try goes on behind them."""


class PagedHttp(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedHttp)


def paged(spark: SparkSession, stream: bool = False, **options) -> DataFrame:
    """Pages of a service, by the data source."""
    register(spark)
    return (spark.readStream if stream else spark.read).format(NAME).options(**{k: str(v) for k, v in options.items()}).load()


def send_bodies(bodies: DataFrame, url: str, marks: str, delivery: str, key: str | None = None, **options) -> None:
    """POST the bodies of http_bodies, each once for this delivery; key: the column that names a body (the first one)."""
    register(bodies.sparkSession)
    rows = bodies.selectExpr(f"cast(`{key or bodies.columns[0]}` as string) AS key", "body")
    rows.write.format(NAME).options(url=url, marks=marks, delivery=delivery, **{k: str(v) for k, v in options.items()}).mode("append").save()
