"""Operator 10: document likelihood with a subword lattice.

A document is a line of words and an end. `score` is log10 of its marginal probability over all segmentations:
P = p_end * product of (1 - p_end) * L(w), where L(w) sums over the ways to write w as pieces of a public vocabulary, a
piece that begins a word and pieces that go on, with a stop probability behind each; no piece holds white space, so the
forward recursion, in log space along the bytes, runs word by word. Single bytes close every gap: each word has some
segmentation. The vocabulary's own scores (a piece's score is minus its rank; weight 1 / (rank + RANK_SHIFT)) are the
first weights; rounds of expectation-maximisation over the training words, each as often as it occurs, update them.

`mixed_score` interpolates word counts with the lattice: P(w) = max(c - D, 0) / N + D * V / N * L(w), D being
n1 / (n1 + 2 n2), from how many training words occur once and twice; the end is a token with its own count.

The vocabulary of a corpus is not bounded, so nothing of it is broadcast. A task numbers the words of a block of
documents and writes the documents as compressed word numbers, and the block's distinct words with their counts. The
words are dealt out by word once, where they get the corpus' count and the lattice's value (once for each distinct word
of a batch), and go back to their block, which is scored there. A word has one row for each block, however often it
occurs. Long texts make long blocks; a document is never cut.

Defined cases: null text counts as empty (its end alone); rows that repeat an id are scored each; without any training
document the weights are the vocabulary's own; null ids are held out by no fold, so they are training rows; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import copy
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import doc_text, materialise, spread_join, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
RANK_SHIFT = 30.0
STOP = 0.35
#: Words of the documents that are numbered together.
WORDS_PER_BLOCK = 4_000_000
#: Words' worth of weight that the vocabulary's own scores keep beside what the training words show.
PRIOR = 200.0
LEARNING_ROUNDS = 2
_P = 0x9E3779B97F4A7C15
END = b"\n"  # no word holds white space


class Pieces:
    """Pieces found by the polynomial hash of their bytes, with log weights."""

    def __init__(self, weights: dict[bytes, float]):
        names = [p for p in weights if p]
        keys = np.array([reduce(lambda h, b: (h * _P + b + 1) % (1 << 64), p, 0) for p in names], np.uint64)
        order = np.argsort(keys)
        self.keys, self.weight = keys[order], np.array([weights[p] for p in names])[order]
        self.longest = max(map(len, names))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or -1."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)


class Lattice:
    """Marginal log10 probability of words over all segmentations into pieces.

    weights: begin, inner, and of an empty beginning; stop: the probability that a word ends after a piece.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        begin: dict[bytes, float] = {}
        inner: dict[bytes, float] = {}
        for piece, score in pieces:
            if -1e8 < score < 0:
                weight = 1.0 / (RANK_SHIFT - score)
                if piece.startswith("▁"):
                    begin[piece[1:].encode()] = weight
                else:
                    inner[piece.encode()] = weight
        least = 1.0 / (RANK_SHIFT + 4 * (len(pieces) + 1))
        for b in range(256):
            inner[bytes([b])] = inner.get(bytes([b]), 0.0) + least
        self.begin, self.inner = Pieces(begin), Pieces(inner)
        self.set(self.begin.weight, self.inner.weight, begin.get(b"", 0.0) + 1.0 / RANK_SHIFT, STOP)

    def set(self, begin: np.ndarray, inner: np.ndarray, empty: float, stop: float) -> None:
        total = begin.sum() + empty
        self.log_begin = np.append(np.log(begin / total), -np.inf)  # number -1 is no piece
        self.log_inner = np.append(np.log(inner / inner.sum() * (1 - stop)), -np.inf)
        self.log_empty, self.log_stop, self.prior = math.log(empty / total), math.log(stop), (begin, inner, empty, stop)

    def learn(self, counts: np.ndarray, strength: float = PRIOR) -> None:
        """New weights: expected counts (begin, inner, empty, words) on top of the vocabulary's own weights."""
        begin, inner, empty, stop = self.prior
        nb, ni = len(begin), len(inner)
        got_b, got_i, (got_e, words) = counts[:nb], counts[nb : nb + ni], counts[nb + ni :]
        unit = strength / (begin.sum() + empty)
        new_stop = (words + strength * stop) / (words + got_i.sum() + strength)
        self.set(got_b + begin * unit, got_i + inner * strength / inner.sum(), got_e + empty * unit, new_stop)

    def run(self, words: list[bytes], counts: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
        """log10 of each word's probability; adds the expected number of each piece, each word counted so many times,
        to counts."""
        out = np.zeros(len(words))
        by_length = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for n, own in by_length.items():
            step = max(1, 400_000 // ((n + 1) * min(n + 1, self.inner.longest)))
            for i in range(0, len(own), step):
                some = own[i : i + step]
                text = np.frombuffer(b"".join([words[k] for k in some]), np.uint8).reshape(len(some), n)
                out[some] = self._forward(text, n, counts, None if times is None else times[some])
        return out / math.log(10)

    def _forward(self, text: np.ndarray, n: int, counts: np.ndarray | None, times: np.ndarray | None) -> np.ndarray:
        m, chars = len(text), text.astype(np.uint64) + np.uint64(1)
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = self.log_empty
        inner: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]  # by end: (begin, piece)
        first: list[np.ndarray | None] = [None] * (n + 1)
        h = np.zeros((m, n), np.uint64)
        with np.errstate(over="ignore"):
            for size in range(1, min(n, max(self.inner.longest, self.begin.longest)) + 1):
                h = h[:, : n - size + 1] * np.uint64(_P) + chars[:, size - 1 :]
                if size <= self.begin.longest:
                    first[size] = self.begin.find(h[:, 0])
                if size <= self.inner.longest:
                    found = self.inner.find(h)
                    for i in np.flatnonzero((found >= 0).any(axis=0)):
                        inner[i + size].append((int(i), found[:, i]))
        for j in range(1, n + 1):
            into = [] if first[j] is None else [self.log_begin[first[j]]]
            into += [alpha[i] + self.log_inner[piece] for i, piece in inner[j]]
            stack = np.array(into)
            high = stack.max(axis=0)
            alpha[j] = high + np.log(np.exp(stack - np.where(np.isfinite(high), high, 0)).sum(axis=0))
        total = alpha[n] + self.log_stop
        if counts is not None:
            times = np.ones(m) if times is None else times
            beta = np.full((n + 1, m), -np.inf)
            beta[n] = self.log_stop
            after: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
            for j in range(1, n + 1):
                for i, piece in inner[j]:
                    after[i].append((j, piece))
            nb, ni = len(self.begin.keys), len(self.inner.keys)
            for i in range(n - 1, -1, -1):
                terms = np.array([self.log_inner[piece] + beta[j] for j, piece in after[i]])
                high = terms.max(axis=0)
                beta[i] = high + np.log(np.exp(terms - high).sum(axis=0))
                for (_, piece), term in zip(after[i], terms, strict=True):
                    p = np.exp(alpha[i] + term - total) * times
                    counts[nb : nb + ni] += np.bincount(piece[piece >= 0], p[piece >= 0], ni)
            for j in range(1, n + 1):
                if first[j] is not None and (own := first[j] >= 0).any():
                    p = np.exp(self.log_begin[first[j]] + beta[j] - total) * times
                    counts[:nb] += np.bincount(first[j][own], p[own], nb)
            counts[nb + ni] += (np.exp(self.log_empty + beta[0] - total) * times).sum()
            counts[nb + ni + 1] += times.sum()
        return total

    def blank_counts(self) -> np.ndarray:
        return np.zeros(len(self.begin.keys) + len(self.inner.keys) + 2)


_lattices: dict[str, Lattice] = {}


def lattice(vocabulary: str = VOCABULARY) -> Lattice:
    if vocabulary not in _lattices:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(vocabulary))
        _lattices[vocabulary] = Lattice([(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())])
    return _lattices[vocabulary]


def packed(numbers: np.ndarray) -> bytes:
    """Word numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


_BLOCK_SCHEMA = "block long, ids binary, flags binary, lengths binary, numbers binary, word binary, number int, n long"


def _blocks(documents: DataFrame, words_per_block: int) -> DataFrame:
    """Rows of two kinds for each block of documents: some of its documents (ids, flags: held out 1, null id 2, lengths
    and word numbers), and a distinct word with its number and its count in training documents. Frequent words have
    small numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        number = defaultdict(count().__next__)
        docs, size = [], 0

        def out(**own):
            n = len(next(iter(own.values())))
            kinds = [pa.int64(), *[pa.binary()] * 5, pa.int32(), pa.int64()]
            names = ["block", "ids", "flags", "lengths", "numbers", "word", "number", "n"]
            own["block"] = np.full(n, (part << 24) + nth, np.int64)
            columns = [pa.array(own[c], k) if c in own else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        def flush():
            nonlocal number, docs, size, nth
            if docs:
                seen, taught = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
                for _, flag, nums in docs:
                    own, times = np.unique(nums, return_counts=True)
                    seen[own] += times
                    if not flag & 1:
                        taught[own] += times
                order = np.argsort(-seen, kind="stable")
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                for i in range(0, len(docs), 512):
                    ids, flags, nums = zip(*docs[i : i + 512], strict=True)
                    yield out(
                        ids=[np.array([0 if x is None else x for x in ids], "<i8").tobytes()], flags=[bytes(flags)],
                        lengths=[np.array([len(x) for x in nums], "<u4").tobytes()], numbers=[packed(place[np.concatenate(nums)])],
                    )
                words, taught = list(number), taught[order]
                for i in range(0, len(words), 50_000):
                    some = order[i : i + 50_000]
                    yield out(word=[words[k] for k in some.tolist()], number=np.arange(i, i + len(some), dtype=np.int32), n=taught[i : i + len(some)])
            number, docs, size, nth = defaultdict(count().__next__), [], 0, nth + 1

        for batch in batches:
            for doc_id, held, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2]):
                words = text.as_py().encode().lower().split()
                words.append(END)
                docs.append((doc_id, held + 2 * (doc_id is None), np.fromiter(map(number.__getitem__, words), np.uint32, len(words))))
                size += len(words)
                if size >= words_per_block:
                    yield from flush()
        yield from flush()

    return documents.mapInArrow(run, _BLOCK_SCHEMA)


def learned(words: DataFrame, rounds: int = LEARNING_ROUNDS) -> Lattice:
    """The lattice after rounds of expectation-maximisation over the training words (word, c: how often it occurs).

    Expected counts are added up by piece: the driver gets one number for each piece of the vocabulary.
    """
    own = lattice()
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            counts = own.blank_counts()
            for batch in batches:
                own.run(batch.column("word").to_pylist(), counts, batch.column("c").to_numpy(zero_copy_only=False).astype(np.float64))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["piece", "expected"])

        got = words.select("word", "c").mapInArrow(run, "piece long, expected double")
        rows = got.groupBy("piece").agg(F.sum("expected")).collect()
        if rows:
            counts = own.blank_counts()
            for piece, expected in rows:
                counts[piece] = expected
            own = copy.deepcopy(own)
            own.learn(counts)
    return own


def _valued(words: DataFrame, own: Lattice) -> DataFrame:
    """block, number, c and lattice (not a number for the end) of words in the order of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            values = own.run(distinct)
            values[[i for i, w in enumerate(distinct) if w == END]] = np.nan
            each = values[coded.indices.to_numpy()]
            yield batch.select(["block", "number", "c"]).append_column("lattice", pa.array(each, pa.float64(), from_pandas=False))

    return words.select("block", "number", "c", "word").mapInArrow(run, "block long, number int, c long, lattice double")


def word_scores(c: np.ndarray, lat: np.ndarray, totals: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of each word by the base's rule, by the lattice alone, and by counts mixed with the lattice."""
    n, v, n1, n2, ends = (totals[k] for k in ("n", "v", "n1", "n2", "ends"))
    end = np.isnan(lat)
    p_end = (ends + 1) / (n + 2)
    base = np.log10((c + 1) / (n + v + 1))
    pure = np.where(end, math.log10(p_end), lat + math.log10(1 - p_end))
    if not n:
        return base, pure, pure
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
    back = math.log10(d * v / n)
    share = np.where(end, 0.0, np.power(10.0, back + np.where(end, 0.0, lat)))
    with np.errstate(divide="ignore"):
        known = np.log10(np.maximum(c - d, 0) / n + share)
    unseen = np.where(end, math.log10(p_end), back + lat)
    return base, pure, np.where(c > 0, known, unseen)


def score_documents(documents: DataFrame, folds: int = 7, held_fold: int = 2, words_per_block: int = WORDS_PER_BLOCK) -> DataFrame:
    """Base, lattice and mixed log10 probability of each document; fold by the crc32 of the id's text."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), doc_text().alias("text")
    )
    blocks = materialise(_blocks(rows, words_per_block), "blocks")
    # Counts are summed before they are shuffled, and a word of many blocks meets its sum where it is.
    entries = blocks.where("word is not null")
    distinct = materialise(entries.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("times")), "words")
    words = spread_join(entries.select("word", "block", "number"), distinct, "word", "times", F.length("word") < 1000).select("word", "block", "number", "c")
    if_end = F.coalesce(F.max(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))
    c = F.col("c")
    row = distinct.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(c > 0), F.count_if(c == 1), F.count_if(c == 2), if_end).first()
    totals = dict(zip(("n", "v", "n1", "n2", "ends"), map(int, row), strict=True))
    own = learned(distinct.select("word", "c").where((F.col("c") > 0) & (F.col("word") != F.lit(END))))
    values = _valued(words, own)
    docs = blocks.where("numbers is not null").select(F.col("block").alias("own_block"), "ids", "flags", "lengths", "numbers")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        counts, lat, at = np.zeros(size, np.int64), np.zeros(size), right["number"].to_numpy()
        counts[at], lat[at] = right["c"].to_numpy(), right["lattice"].to_numpy()
        value = [*word_scores(counts, lat, totals), (counts > 0).astype(np.float64)]
        out = []
        for ids, flags, lengths, numbers in zip(*(left[k].to_pylist() for k in ("ids", "flags", "lengths", "numbers")), strict=True):
            ids, flags, lengths = np.frombuffer(ids, "<i8"), np.frombuffer(flags, np.uint8), np.frombuffer(lengths, "<u4").astype(np.int64)
            nums, start = unpacked(numbers, int(lengths.sum())), np.cumsum(lengths) - lengths
            base, pure, mixed, known = (np.add.reduceat(x[nums], start) for x in value)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(ids, pa.int64(), mask=(flags & 2) > 0), "held_out": pa.array((flags & 1) > 0), "n_tokens": lengths,
                        "n_known": np.round(known).astype(np.int64), "train_tokens": np.full(len(ids), totals["n"], np.int64),
                        "base_score": base, "score": pure, "mixed_score": mixed,
                    }
                )
            )
        return pa.concat_tables(out)

    return docs.groupBy("own_block").cogroup(values.groupBy("block")).applyInArrow(
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixed_score double",
    )
