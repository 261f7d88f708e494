"""Operator 2: token ids in a binary file format of patched frame-of-reference blocks.

Ids lie in blocks of 128. A block stores its minimum, packs the differences to it at the width that PERCENTILE of them
fit in, and keeps the rest ("patches") in an exception list of positions and full differences. An index of block starts
lets a reader go to any block.

File (little endian): magic `MPF1`, u32 documents, u64 ids, u32 blocks; then doc_id i64[documents], ids of each
document u32[documents], block start u32[blocks] counted from the end of this index; then the blocks: u16 minimum, u8
width, u8 exceptions, 16 * width bytes of packed differences, u8 position[exceptions], u16 difference[exceptions].

Documents are dealt out by ranges of doc_id and sorted, so the files in name order hold all documents in ascending
order. A task writes each file under a name of its own and renames it, so a repeated task leaves the same files.

Defined cases: null text counts as empty (only the end id); rows that repeat an id follow each other ordered by text;
rows without an id have no place in the order and are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import doc_text, materialise, shared_dir
from .encoding import VOCABULARY, encoded

BLOCK = 128
PERCENTILE = 90
IDS_PER_FILE = 1 << 21
_MAGIC = b"MPF1"
_HEAD = struct.Struct("<4sIQI")


def pack_ids(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Block starts (u32) and the blocks of an array of 16-bit ids."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(0, "<u4"), b""
    rows = np.full(n_blocks * BLOCK, ids[-1], np.uint16)
    rows[: len(ids)] = ids
    rows = rows.reshape(n_blocks, BLOCK)
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    at = BLOCK * PERCENTILE // 100
    fits = np.partition(diff, at, axis=1)[:, at].astype(np.uint32)
    width = np.zeros(n_blocks, np.int64)
    for k in range(16):
        width += fits >= (1 << k)
    over = diff.astype(np.uint32) >= (np.uint32(1) << width.astype(np.uint32))[:, None]
    n_over = over.sum(axis=1)
    size = 4 + 16 * width + 3 * n_over
    start = np.zeros(n_blocks, np.int64)
    np.cumsum(size[:-1], out=start[1:])
    out = np.zeros(int(size.sum()), np.uint8)
    out[start], out[start + 1], out[start + 2], out[start + 3] = low & 255, low >> 8, width, n_over
    for w in range(1, 17):
        own = np.flatnonzero(width == w)
        for some in np.array_split(own, max(1, len(own) // 4096)):
            if len(some):
                bits = (diff[some][:, :, None] >> np.arange(w, dtype=np.uint16)) & np.uint16(1)
                packed = np.packbits(bits.astype(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
                out[(start[some] + 4)[:, None] + np.arange(16 * w)] = packed
    block, position = np.nonzero(over)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    base = start[block] + 4 + 16 * width[block]
    out[base + nth] = position
    value, base = diff[block, position], base + n_over[block] + 2 * nth
    out[base], out[base + 1] = value & 255, value >> 8
    return start.astype("<u4"), out.tobytes()


def unpack_ids(start: np.ndarray, blocks: bytes, n_ids: int) -> np.ndarray:
    raw, start = np.frombuffer(blocks, np.uint8), start.astype(np.int64)
    if not len(start):
        return np.zeros(0, np.uint16)
    low = raw[start].astype(np.uint16) | (raw[start + 1].astype(np.uint16) << 8)
    width, n_over = raw[start + 2].astype(np.int64), raw[start + 3].astype(np.int64)
    diff = np.zeros((len(start), BLOCK), np.uint16)
    for w in range(1, 17):
        own = np.flatnonzero(width == w)
        for some in np.array_split(own, max(1, len(own) // 4096)):
            if len(some):
                packed = raw[(start[some] + 4)[:, None] + np.arange(16 * w)]
                bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(some), BLOCK, w)
                value = np.zeros((len(some), BLOCK), np.uint16)
                for k in range(w):
                    value |= bits[:, :, k].astype(np.uint16) << k
                diff[some] = value
    block = np.repeat(np.arange(len(start)), n_over)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    base = start[block] + 4 + 16 * width[block]
    position, base = raw[base + nth], base + n_over[block] + 2 * nth
    diff[block, position] = raw[base].astype(np.uint16) | (raw[base + 1].astype(np.uint16) << 8)
    return (diff + low[:, None]).reshape(-1)[:n_ids]


def file_bytes(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate([np.zeros(0, "<u2"), *ids])
    start, blocks = pack_ids(flat)
    return b"".join(
        [
            _HEAD.pack(_MAGIC, len(doc_ids), len(flat), len(start)),
            np.array(doc_ids, "<i8").tobytes(),
            np.array([len(x) for x in ids], "<u4").tobytes(),
            start.tobytes(),
            blocks,
        ]
    )


def read_file(data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """doc_ids and the ids of each document."""
    magic, n_docs, n_ids, n_blocks = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a file of packed ids")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u4", n_docs, at := at + 8 * n_docs)
    start = np.frombuffer(data, "<u4", n_blocks, at := at + 4 * n_docs)
    flat = unpack_ids(start, data[at + 4 * n_blocks :], n_ids)
    return doc_ids, np.split(flat, np.cumsum(lengths[:-1], dtype=np.int64)) if n_docs else []


def read_block(data: bytes, k: int) -> np.ndarray:
    """The ids of block k alone, through the index of block starts."""
    _, n_docs, n_ids, n_blocks = _HEAD.unpack_from(data)
    at = _HEAD.size + 12 * n_docs
    start = np.frombuffer(data, "<u4", n_blocks, at).astype(np.int64)
    end = start[k + 1] if k + 1 < n_blocks else None
    own = data[at + 4 * n_blocks :][start[k] : end]
    return unpack_ids(np.zeros(1, "<u4"), own, min(BLOCK, n_ids - k * BLOCK))


def _store(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def write_files(
    documents: DataFrame, path: str, end: int = 1, vocabulary: str = VOCABULARY, ids_per_file: int = IDS_PER_FILE
) -> DataFrame:
    """Write all documents below path; returns (file, part, first_doc, n_docs, n_ids), one row for each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, top = _store(path)
        doc_ids, ids, total, rows = [], [], 0, []

        def flush():
            nonlocal doc_ids, ids, total
            name = f"part-{part:08d}-{len(rows):06d}.mpf"
            # The folder is made once more by each task: one store has folders, another does not.
            store.create_dir(top, recursive=True)
            draft = f"{top}/_{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as f:
                f.write(file_bytes(doc_ids, ids))
            store.move(draft, f"{top}/{name}")
            rows.append((name, part, doc_ids[0], len(doc_ids), total))
            doc_ids, ids, total = [], [], 0

        for batch in batches:
            for doc_id, own in zip(batch[0].to_pylist(), encoded(batch[1], vocabulary, end)):
                doc_ids.append(doc_id)
                ids.append(own)
                total += len(own)
                if total >= ids_per_file:
                    flush()
        if doc_ids:
            flush()
        names = ["file", "part", "first_doc", "n_docs", "n_ids"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ordered = (
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), doc_text().alias("text"))
        .where("doc_id is not null")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return ordered.mapInArrow(write, "file string, part long, first_doc long, n_docs long, n_ids long")


def read_files(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) for each document, read from the files that manifest names."""
    spark = manifest.sparkSession
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as there were tasks
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.join(parts.select("part", before.alias("_before")), "part").select(
        "file", (F.col("_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch[0].to_pylist(), batch[1]):
                doc_ids, ids = read_file(content.as_py())
                lengths = np.array([len(x) for x in ids], np.int64)
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                begin = start + np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(begin, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mpf").load(path)
    files = files.select(F.substring_index("path", "/", -1).alias("file"), "content")
    # The starts are a few bytes for each file; the contents are only read by the tasks that decode them.
    joined = files.join(starts, "file").select("start", "content")
    return joined.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_round_trip(documents: DataFrame, end: int = 1) -> DataFrame:
    """Write all documents and return what is read back from the files."""
    spark = documents.sparkSession
    path = shared_dir(spark) + "-ids"
    manifest = materialise(write_files(documents, path, end), "manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_files(manifest, path)
