"""Archives by member, charsets split as bytes, open events of a stream."""

import gzip
import io
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import archives, files
from millrace.streaming import pull


def _lines(df):
    return sorted((r["member"], r["line_no"], r["value"]) for r in df.collect())


def test_zip_by_ranges_of_members(spark, tmp_path):
    bodies = {f"d/{i}.log": "\n".join(f"{i}-{k}" for k in range(i * 7)) for i in range(20)} | {"d/.hidden.log": "h", "skip.txt": "no", "old.bak.log": "o\r\nb"}
    with zipfile.ZipFile(tmp_path / "a b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("d")
        for name, body in bodies.items():
            z.writestr(name, body)
    want = sorted((n, i, v) for n, b in bodies.items() if n.endswith(".log") for i, v in enumerate(b.splitlines()))
    df = archives.archives(spark, str(tmp_path / "*.zip"), "*.log", range_bytes=100, tasks=8)
    assert _lines(df) == want
    with open(tmp_path / "a b.zip", "rb") as f:
        got = list(archives.ranges("a.zip", f, 100))
    assert len(got) > 3 and [a for a, _ in got[1:]] == [b + 1 for _, b in got[:-1]] and got[-1][1] == len(bodies)
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1, "a zip is read by several tasks"
    seen = {m for m, _, _ in _lines(archives.archives(spark, str(tmp_path / "*.zip"), hidden=False, ignore_suffixes=[".bak.log", ".txt"]))}
    assert seen == {f"d/{i}.log" for i in range(1, 20)}


def test_tar_gz_and_plain_files_are_streams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "FRAME_CHARS", 50)
    text = "".join(f"line {i}\n" for i in range(300))
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        for name in ("one.log", "two.log"):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    with gzip.open(tmp_path / "three.log.gz", "wb") as f:
        f.write(text.encode() + b"\xff")
    (tmp_path / "four.log").write_text(text)
    (tmp_path / "empty.log").write_text("")
    rows = _lines(archives.archives(spark, str(tmp_path / "*")))
    plain = [(i, f"line {i}") for i in range(300)]
    for name in ("one.log", "two.log", "four.log"):
        assert [(n, v) for m, n, v in rows if m == name] == plain
    assert [(n, v) for m, n, v in rows if m == "three.log"] == [*plain, (300, "�")]
    assert len(rows) == 1201


@pytest.mark.parametrize("charset", ["GBK", "gb18030", "big5", "shift_jis", "euc_kr", "koi8_r", "ISO-8859-1", "windows-1252", "utf-8", "utf-16", "utf-16-le", "hz", "iso2022_jp", "cp037"])
def test_charsets(spark, tmp_path, charset):
    texts = {"koi8_r": "Привет", "ISO-8859-1": "é", "windows-1252": "€", "utf-8": "日本 €", "shift_jis": "日本 表", "iso2022_jp": "日本", "euc_kr": "한국", "cp037": "abc"}
    own = [f"{texts.get(charset, '中文')} {i}" for i in range(2000)]
    (tmp_path / "f.txt").write_bytes("\n".join(own).encode(charset) + "\n".encode(charset).removeprefix(b"\xff\xfe"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = files.decoded(spark, str(tmp_path), charset, tag="cs")
        assert [r["value"] for r in df.orderBy("_block", "_line").collect()] == own
        assert {r["cs"] for r in df.select("cs").distinct().collect()} == {charset}
        if archives.keeps_line_feed(charset):
            assert df.select("_block").distinct().count() > 2, "one file is read by several tasks"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_invalid_bytes_of_a_charset(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes("中文".encode("gbk") + b"\n\xff\xff\nend")
    (tmp_path / "g.txt").write_bytes(b"ok\n\xc3\x28\n")
    assert [r["value"] for r in files.decoded(spark, str(tmp_path / "f.txt"), "gbk").orderBy("_block", "_line").collect()] == ["中文", "��", "end"]
    assert [r["value"] for r in files.decoded(spark, str(tmp_path / "g.txt"), "utf-8").orderBy("_block", "_line").collect()] == ["ok", "�("]


def _run(spark, tmp_path, events, name):
    return events.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp"))


def test_open_events_end_by_head_lines_and_timeout(spark, tmp_path):
    schema = "log string, line_no long, value string"

    def write(rows):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))

    def values(name):
        out = spark.read.schema("log string, value string").parquet(str(tmp_path / name)).collect()
        return sorted((r["log"], r["value"]) for r in out)

    write([("a", 0, "HEAD 1"), ("a", 1, "x"), ("b", 0, "no head"), ("a", 2, None), ("c", 0, "HEAD c")])
    def wait(done):
        ended = time.time() + 90
        while not done() and time.time() < ended:
            time.sleep(0.5)

    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="RocksDB"):
        pull.open_events(stream, "^HEAD")
    with pull.timed_state(spark):
        first = _run(spark, tmp_path, pull.open_events(stream, "^HEAD", max_lines=3, timeout="20 seconds"), "out").trigger(processingTime="1 second").start()
    try:
        wait(lambda: first.lastProgress is not None and first.lastProgress["batchId"] > 0)
        assert values("out") == []
        # Rows of a file come in any order.
        write([("a", 5, "HEAD 2"), ("a", 4, "z"), ("a", 3, "y"), ("b", 1, "1"), ("b", 2, "2"), ("b", 3, "3")])
        wait(lambda: len(values("out")) >= 3)
        assert values("out") == [("a", "HEAD 1\nx\ny"), ("a", "z"), ("b", "no head\n1\n2")]
    finally:
        first.stop()
    # Started again, what was open comes by its timer.
    with pull.timed_state(spark):
        again = _run(spark, tmp_path, pull.open_events(stream, "^HEAD", max_lines=3, timeout="20 seconds"), "out").trigger(processingTime="1 second").start()
    try:
        wait(lambda: len(values("out")) >= 6)
    finally:
        again.stop()
    assert values("out") == [("a", "HEAD 1\nx\ny"), ("a", "HEAD 2"), ("a", "z"), ("b", "3"), ("b", "no head\n1\n2"), ("c", "HEAD c")]
