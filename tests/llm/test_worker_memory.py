"""What operators leave in Spark's Python workers, which outlive them."""

from __future__ import annotations

import re
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc

import corpus_pipeline
from millrace.llm import packing, toxicity
from millrace.llm._common import thrifty


def held() -> float:
    """MB of this process without mapped files."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_the_pack_stage_holds_one_worker_a_task(spark):
    docs = spark.createDataFrame([(i, f"some words {i}, " * (i * 40 + 1)) for i in range(30)], "doc_id long, text string")
    packed = corpus_pipeline.pack_stage(spark, docs, "")
    assert packed._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    two = packing.with_crc(packing.pack(docs))
    assert packed.schema == two.schema
    assert sorted(packed.collect()) == sorted(two.collect())


def test_scored_rows_go_back_in_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = toxicity.with_scores(docs, toxicity.Model())
    whole = pa.RecordBatch.from_pydict({"doc_id": range(2000), "text": [f"word{i} and more" for i in range(2000)]})
    got = list(run(iter([whole])))
    assert max(b.num_rows for b in got) <= 512
    assert pa.Table.from_batches(got).column("doc_id").to_pylist() == list(range(2000))


def test_a_task_gives_unused_memory_back():
    def run(batches):
        for batch in batches:
            parts = [pc.ascii_upper(batch.column("text").slice(k, 64)) for k in range(0, batch.num_rows, 64)]
            yield pa.RecordBatch.from_arrays([pa.array([len(parts)])], ["n"])

    def batches():
        yield pa.RecordBatch.from_pydict({"text": ["word " * 400] * 60_000})

    before = held()
    assert sum(b.num_rows for b in run(batches())) == 1
    kept = held() - before
    assert sum(b.num_rows for b in thrifty(run)(batches())) == 1
    assert held() - before < max(40, kept / 2)
