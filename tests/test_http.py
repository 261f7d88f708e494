"""The paged data source against a service of the test."""

import http.server
import json
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.plans import spec
from millrace.sources import http as own


class Service:
    """Pages below a number that the test sets; posts are counted by body, and fail as often as the test says."""

    def __init__(self):
        self.pages, self.gets, self.posts, self.keys, self.failing = 7, Counter(), Counter(), set(), Counter()
        outer = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_HEAD(self):
                self.send_response(200 if int(self.path.rsplit("=", 1)[1]) <= outer.pages else 404)
                self.end_headers()

            def do_GET(self):
                page = int(self.path.rsplit("=", 1)[1])
                outer.gets[page] += 1
                self.send_response(200 if page <= outer.pages else 404)
                self.end_headers()
                self.wfile.write(json.dumps({"page": page, "auth": self.headers.get("X-Auth")}).encode())

            def do_POST(self):
                body = self.rfile.read(int(self.headers["Content-Length"])).decode()
                if outer.failing[body] > 0:
                    outer.failing[body] -= 1
                    self.send_response(500)
                else:
                    outer.posts[body] += 1
                    outer.keys.add(self.headers["Idempotency-Key"])
                    self.send_response(200)
                self.end_headers()

            def log_message(self, *_): ...

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/?p={{page}}"


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def test_pages_as_a_table(spark, service):
    df = own.paged(spark, url=service.url, first=2, last=6, headers='{"X-Auth": "k"}')
    assert df.rdd.getNumPartitions() == 5
    assert sorted((r.page, json.loads(r.value)["auth"]) for r in df.collect()) == [(p, "k") for p in range(2, 7)]
    assert own.paged(spark, url=service.url, last=7, pages_per_task=3).rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="404"):
        own.paged(spark, url=service.url, last=8).collect()
    assert spec.SOURCES["paged"](spark, url=service.url, last=1).count() == 1


def test_a_stream_of_pages_goes_on_where_it_was(spark, service, tmp_path):
    out = str(tmp_path / "out")

    def run():
        df = own.paged(spark, stream=True, url=service.url, pages_per_batch=4)
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    assert sorted(r.page for r in spark.read.parquet(out).collect()) == list(range(1, 8))
    service.pages = 10
    run()
    assert sorted(r.page for r in spark.read.parquet(out).collect()) == list(range(1, 11))
    assert max(service.gets.values()) == 1


def test_no_body_is_posted_twice(spark, service, tmp_path):
    bodies = spark.range(20).select((F.col("id") % 10).alias("b"), "id").groupBy("b").agg(F.concat(F.lit("body "), F.col("b").cast("string")).alias("body"))
    url, marks = service.url.split("?")[0], f"file://{tmp_path}/marks"
    service.failing.update({"body 3": 2, "body 8": 1})
    for _ in range(4):  # a local session does not try tasks again: the delivery is
        try:
            own.send_bodies(bodies, url, marks, "d1")
            break
        except Exception as e:  # noqa: BLE001
            assert "500" in str(e)
    own.send_bodies(bodies, url, marks, "d1")
    assert service.posts == Counter({f"body {i}": 1 for i in range(10)}) and len(service.keys) == 10
    own.send_bodies(bodies, url, marks, "d2")
    assert set(service.posts.values()) == {2}
    with pytest.raises(Exception, match="needs marks"):
        bodies.write.format(own.NAME).options(url=url, delivery="x").mode("append").save()


def test_specs_name_urls_and_lines(spark, tmp_path):
    df = spark.createDataFrame([("http://h.org/p?a=1&b=x%20y&a=2", 1.5)], "url string, v double")
    step = {"transforms": [{"type": "urlparam", "key": "url", "select_keys": ["a", "b", "none"]}]}
    assert spec.compose(df, step).select("url_a", "url_b", "url_none").first()[:] == ("1&2", "x y", None)
    whole = spec.compose(df, {"transforms": [{"type": "urlparam", "key": "url"}]}).first().url_params
    assert whole["url_url_param_host"] == "h.org"
    spec.SINKS["influxdb"](df, str(tmp_path / "lines"), measurement="m", tags=[], fields=["v"])
    assert spark.read.text(str(tmp_path / "lines")).first().value == "m v=1.5"
