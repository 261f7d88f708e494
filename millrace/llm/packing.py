"""Operator 6: packing token sequences by minimum bin slack.

A document is cut into full pieces of the window size and one rest. The rests of a batch of documents are packed: the
longest open rest opens a window, and a subset-sum over the multiset of open lengths (one bit of a long integer for
each reachable sum, counts split into powers of two) finds the multiset that fills it closest to its capacity;
backtracking over the layers gives how many rests of each length it takes. Whatever is open when a task ends is packed
in the same way; a last window that is not full is cut at powers of two, so that it needs no padding at all.

Each task packs the documents that it reads, a bounded number at a time, so nothing is shuffled and a lost task is
simply run again. sequence_id is the task's number and a count: it is unique, not gapless.

Defined cases: null text counts as empty (only the end id); equal rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import doc_text, thrifty
from .encoding import VOCABULARY, encoded

WINDOW = 4096
#: Rests that a task keeps before it packs them; bounds its memory.
OPEN_RESTS = 1024

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_CRC_SCHEMA = SCHEMA.replace("ids binary", "ids_crc32 long")


def best_subset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take for the largest sum up to capacity; counts: how many there are of each."""
    reach, layers, full = 1, [], (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, power = min(counts[length], capacity // length) if length else 0, 1
        while left > 0:
            take = min(power, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            power *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            total -= length * take
            chosen[length] += take
    return dict(chosen)


def fill_windows(lengths: list[int], window: int = WINDOW) -> Iterator[list[int]]:
    """Indexes of lengths, window by window; each length is at most window."""
    where: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        where[lengths[i]].append(i)
    order = sorted(where, reverse=True)
    at = 0
    while at < len(order):
        seed = order[at]
        if not where[seed]:
            at += 1
            continue
        own = [where[seed].pop()]
        counts = {n: len(where[n]) for n in order[at:] if where[n] and n <= window - seed}
        for length, k in best_subset(counts, window - seed).items():
            own += [where[length].pop() for _ in range(k)]
        yield own


def _packer(end: int, window: int, vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    if window & (window - 1):
        raise ValueError("the window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        rests: list[tuple[int | None, int, np.ndarray, int]] = []
        rows: list[tuple] = []

        def piece(doc_id, start, ids, n, offset):
            rows.append((doc_id, start, len(ids), ids.tobytes(), n, sequence, offset))

        def settle(last: bool):
            nonlocal sequence, rests
            kept = []
            for own in fill_windows([len(r[2]) for r in rests], window):
                total = sum(len(rests[i][2]) for i in own)
                if total < window and not last and total & (total - 1):
                    kept += own  # waits for more documents
                    continue
                room = window if total == window else 1 << (total.bit_length() - 1)
                offset = 0
                for i in own:
                    doc_id, start, ids, n = rests[i]
                    while len(ids):
                        cut = ids[: room - offset]
                        piece(doc_id, start, cut, n, offset)
                        start, ids, offset = start + len(cut), ids[len(cut) :], offset + len(cut)
                        if offset == room:
                            total -= room
                            sequence, offset = sequence + 1, 0
                            room = 1 << (total.bit_length() - 1) if total else 0
            # What waits is bounded too: were nothing ever to fit, it would be closed here.
            if len(kept) > OPEN_RESTS // 2:
                rests = [rests[i] for i in kept]
                settle(True)
            else:
                rests = [rests[i] for i in kept]

        def out():
            nonlocal rows
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, ids in zip(batch[0].to_pylist(), encoded(batch[1], vocabulary, end)):
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    piece(doc_id, start, ids[start : start + window], len(ids), 0)
                    sequence += 1
                if whole < len(ids):
                    rests.append((doc_id, whole, ids[whole:], len(ids)))
                if len(rests) >= OPEN_RESTS:
                    settle(False)
                if len(rows) >= 2048:
                    yield out()
        settle(True)
        yield out()

    return run


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = [zlib.crc32(np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes()) for x in batch.column("ids")]
        at = batch.schema.get_field_index("ids")
        yield batch.set_column(at, "ids_crc32", pa.array(crc, pa.int64()))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), doc_text().alias("text"))


def pack(documents: DataFrame, end: int = 2, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece, with its ids (16 bit, little endian), its place in the document and in a sequence."""
    return _texts(documents).mapInArrow(thrifty(_packer(end, window, vocabulary)), SCHEMA)


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids as 32-bit integers instead of the ids."""
    return pieces.mapInArrow(thrifty(_crcs), _CRC_SCHEMA)


def pack_with_crc(documents: DataFrame, end: int = 2, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """with_crc of pack by one Python worker for each task: two functions in a row hold one each, and both stay idle behind it."""
    run = _packer(end, window, vocabulary)
    return _texts(documents).mapInArrow(thrifty(lambda batches: _crcs(run(batches))), _CRC_SCHEMA)
