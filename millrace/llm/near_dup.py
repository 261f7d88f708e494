"""Operator 3: near-duplicate documents by BagMinHash.

A document is the multiset of its runs of five words (white-space separated; all words of a shorter text). Weights are
counts, discretised at 1, 2, 3, ... For the weight interval (0, 1] and each dyadic interval (2^k, 2^(k+1)] an element has
a Poisson process of points, each with a signature component and, halving the interval again and again, a place in it;
a point counts if its place lies below the element's weight. A component's minimum over all points is equal in two
documents with the probability of their weighted Jaccard similarity. Points are made in ascending order and only up to
a bound that grows until every component has one, so a document costs about its length plus m log m.

Exact copies are collapsed first. Equal bands make candidates: in each bucket every document is paired with the one
that meets most others (a star, never all pairs), and the multiset overlap decides from the whole texts. After
connected components, pairs of a bucket that are still apart are checked too, if they can link at all: two documents
differ by what their differences to the bucket's leader do not share, so those that link share some of the rarest of
these differences (a prefix filter that loses no pair). Bands miss a pair of similarity 0.8 with a probability of 3e-5.

Defined cases: null text counts as empty; texts without a word link with nothing; rows that repeat an id count as one
document; rows without an id are left out; ties go to the smaller id; very long texts are taken whole, in slices of a
megabyte; other columns of the input are ignored by near_duplicates and kept by without_near_duplicates, whatever their
names and types.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, doc_text, materialise, spread_join, thrifty, unused

RUN = 5
THRESHOLD = 0.8
ROWS, BANDS = 5, 26
COMPONENTS = ROWS * BANDS
_SLICE = 1 << 20
_P = np.uint64(0x100000001B3)
_P_INV = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _C[1]
        x = (x ^ (x >> np.uint64(27))) * _C[2]
        return x ^ (x >> np.uint64(31))


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of a slice of bytes."""
    word = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(raw), _P, np.uint64))
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)])
        inverse = np.cumprod(np.full(len(raw), _P_INV, np.uint64))
        return _mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _C[0])


def word_hashes(text: bytes) -> np.ndarray:
    raw, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(raw):
        end = min(len(raw), at + _SLICE)
        while end < len(raw) and not _IS_SPACE[raw[end]]:
            end += 1
        out.append(_word_hashes(raw[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _runs(words: np.ndarray) -> np.ndarray:
    n = len(words) - RUN + 1
    k = RUN if n > 0 else len(words)
    with np.errstate(over="ignore"):
        total = np.zeros(max(n, min(1, len(words))), np.uint64)
        for i in range(k):
            total = (total + words[i : i + len(total)]) * _C[0] + np.uint64(i + 1)
    return _mixed(total)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of words, ascending, and how often each occurs."""
    return np.unique(_runs(word_hashes((text or "").encode())), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags: shared counts by all counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    every = int(a[1].sum() + b[1].sum()) - shared
    return shared / every if every else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = COMPONENTS) -> np.ndarray:
    """BagMinHash signatures (documents, m); infinite for an empty bag."""
    sig = np.full((len(bags), m), np.inf)
    left = np.array([i for i, (e, _) in enumerate(bags) if len(e)], np.int64)
    reach = np.array([(math.log(m) + 5) / max(1, int(w.sum())) for _, w in bags])
    while len(left):
        elements = np.concatenate([bags[i][0] for i in left])
        weights = np.concatenate([bags[i][1] for i in left])
        doc = np.repeat(left, [len(bags[i][0]) for i in left])
        flat, level = sig.reshape(-1), 0
        while len(elements):
            # Level 0 is the interval (0, 1]; level k > 0 is (2^(k-1), 2^k].
            width = 1 if level == 0 else 1 << (level - 1)
            with np.errstate(over="ignore"):
                key = _mixed(elements + np.uint64(level) * _C[0])
                at, bound, limit, d = np.zeros(len(elements)), reach[doc], weights, doc
                while len(at):
                    key = _mixed(key + _C[0])
                    at = at - np.log(((key >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width)
                    own = at < bound
                    at, key, bound, limit, d = at[own], key[own], bound[own], limit[own], d[own]
                    mark = _mixed(key ^ _C[2])
                    put = (mark % np.uint64(m)).astype(np.int64) + d * m
                    if level:
                        place = width + 1 + ((mark >> np.uint64(32)) % np.uint64(width)).astype(np.int64)
                        hit = place <= limit
                        np.minimum.at(flat, put[hit], at[hit])
                    else:
                        np.minimum.at(flat, put, at)
            level += 1
            more = weights > (1 << (level - 1))
            elements, weights, doc = elements[more], weights[more], doc[more]
        left = left[~np.isfinite(sig[left]).all(axis=1)]
        reach[left] *= 2
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band, made of ROWS components."""
    x = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    with np.errstate(over="ignore"):
        h = np.zeros(x.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            h = _mixed((h + x[:, :, r]) * _C[0])
    return h.view(np.int64)


def signed(documents: DataFrame) -> DataFrame:
    """doc_id, sha (of the text) and bands (null for a text without words) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = batch.column("text").to_pylist()
                bags = [bag(t) for t in texts]
                rows = [list(b) if len(x[0]) else None for b, x in zip(bands(signatures(bags)), bags, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts], pa.binary()),
                        pa.array(rows, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "sha", "bands"],
                )

    return documents.mapInArrow(thrifty(run), "doc_id long, sha binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) from whole texts; a document with many partners is split by Spark's skew join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            out = []
            for a, s, t in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a != last or own is None:
                    last, own = a, bag(s.as_py())
                out.append(overlap(own, bag(t.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    found = both.select("a", "b", "text_a", "text_b").mapInArrow(thrifty(run), "a long, b long, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def difference(base: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One hash for each count by which two bags differ: two bags differ from each other where these sets do."""
    elements = np.union1d(base[0], own[0])
    by = np.zeros(len(elements), np.int64)
    by[np.searchsorted(elements, own[0])] += own[1]
    by[np.searchsorted(elements, base[0])] -= base[1]
    elements, by = elements[by != 0], by[by != 0]
    n = np.abs(by)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        mark = (step.astype(np.uint64) * np.uint64(2) + np.repeat(by > 0, n).astype(np.uint64)) * _C[1]
        return _mixed(np.repeat(elements, n) + mark)


def prefix_length(n_differ: int, size: int, base_size: int, threshold: float = THRESHOLD) -> int:
    """How many of a document's differences to its leader must meet one of those of any document that it links with.

    Two documents x, y link if they differ by at most r (|x| + |y|), r = (1 - t) / (1 + t), and differ by what their
    differences to the leader do not share. Of two in different groups one at least does not link with the leader
    itself. If x does, y differs from the leader by more than r (|y| + |leader|), so x and y share more than half of
    n_differ + r (|leader| - |x|). If x does not, y may, and |y| <= |x| / t: they share n_differ - r (|x| + |y|) at least.
    """
    r = (1 - threshold) / (1 + threshold)
    if n_differ <= r * (size + base_size):
        shared = math.floor((n_differ + r * (base_size - size)) / 2 - 1e-9) + 1
    else:
        shared = math.ceil(n_differ - r * size * (1 + 1 / threshold) - 1e-9)
    return max(0, n_differ - max(1, shared) + 1)


def differences(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """leader, rep, size (of the rep's bag), keep (its prefix_length) and parts (its difference to the leader)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, base = None, None
        for batch in batches:
            size, keep, parts = [], [], []
            for leader, s, t in zip(batch.column("leader").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if leader != last or base is None:
                    last, base = leader, bag(s.as_py())
                own = bag(t.as_py())
                found = difference(base, own)
                size.append(int(own[1].sum()))
                keep.append(prefix_length(len(found), size[-1], int(base[1].sum()), threshold))
                parts.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("leader"), batch.column("rep"), pa.array(size, pa.int64()), pa.array(keep, pa.int64()),
                 pa.array(parts, pa.list_(pa.int64()))],
                ["leader", "rep", "size", "keep", "parts"],
            )

    with_b = pairs.join(texts.select(F.col("doc_id").alias("rep"), F.col("text").alias("text_b")), "rep")
    both = with_b.join(texts.select(F.col("doc_id").alias("leader"), F.col("text").alias("text_a")), "leader")
    return both.select("leader", "rep", "text_a", "text_b").mapInArrow(
        thrifty(run), "leader long, rep long, size long, keep long, parts array<long>"
    ).dropDuplicates(["leader", "rep"])


def apart_pairs(differ: DataFrame, placed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) of one leader and different groups that share one of the rarest of their differences.

    Whatever two documents that link must share meets in the first differences of both, rarest first. A pair is looked
    at further only if sizes, numbers of differences and the places of the shared one allow a link.
    """
    r = (1 - threshold) / (1 + threshold)
    part = differ.select("leader", "rep", F.explode("parts").alias("part"))
    often = part.groupBy("leader", "part").agg(F.count("*").alias("often")).where("often > 1")
    # Those of one document alone come first and meet nothing: only their number counts.
    ranked = part.join(often, ["leader", "part"]).groupBy("leader", "rep").agg(F.array_sort(F.collect_list(F.struct("often", "part"))).alias("common"))
    n_differ = F.size("parts").cast("bigint")
    first = (
        differ.join(ranked, ["leader", "rep"]).join(placed, ["leader", "rep"])
        .select("leader", "rep", "group", "size", n_differ.alias("n_differ"), F.size("common").alias("n_common"),
                F.posexplode(F.expr("slice(common, 1, greatest(0, int(keep - size(parts) + size(common))))")).alias("at", "one"))
        .select("leader", "rep", "group", "size", "n_differ", (F.col("n_common") - F.col("at")).alias("left"), F.col("one.part").alias("part"))
    )
    first = materialise(first, "first")
    # Differences that only one group has make no pair.
    several = first.groupBy("leader", "part").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi")
    first = materialise(first.join(several, ["leader", "part"], "left_semi"), "several")
    other = first.select("leader", "part", *[F.col(c).alias(f"{c}_2") for c in ("rep", "group", "size", "n_differ", "left")])
    # What a linked pair shares lies, from its first shared difference on, among what is left of both.
    shared = (F.col("n_differ") + F.col("n_differ_2") - r * (F.col("size") + F.col("size_2"))) / 2
    return (
        first.join(other, ["leader", "part"])
        .where(
            (F.col("rep") < F.col("rep_2"))
            & (F.col("group") != F.col("group_2"))
            & (F.least("size", "size_2") >= threshold * F.greatest("size", "size_2") - 1e-9)
            & (F.abs(F.col("n_differ") - F.col("n_differ_2")) <= r * (F.col("size") + F.col("size_2")) + 1e-9)
            & (F.least("left", "left_2") >= shared - 1e-9)
        )
        .select(F.col("rep").alias("a"), F.col("rep_2").alias("b"))
        .distinct()
    )


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest id of its group of near copies), group_size, kept (it is that id)."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), doc_text().alias("text")).where("doc_id is not null")
    rows = materialise(signed(docs), "signed")
    classes = rows.where("bands is not null").groupBy("sha").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    classes = materialise(classes, "classes")
    banded = classes.select("rep", F.posexplode("bands").alias("band", "value"))
    banded = banded.select("rep", F.xxhash64("band", "value").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(banded.join(shared, "key"), "met")
    degree = met.groupBy("rep").agg(F.sum("n").alias("degree"))
    ranked = met.join(degree, "rep")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("_neg"))).alias("_l"))
    leaders = leaders.select("key", (-F.col("_l._neg")).alias("leader"))
    starred = materialise(met.select("key", "rep").join(leaders, "key"), "stars")
    stars = starred.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    checked = materialise(verified(stars, docs), "checked")
    links = checked.where(F.col("similarity") >= threshold).select("a", "b")
    group = materialise(components(links), "group")
    # What is still apart within a bucket.
    placed = (
        starred.join(group.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "rep", "leader", F.coalesce("component", "rep").alias("group"))
    )
    open_keys = placed.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("key")
    placed = placed.join(open_keys, "key", "left_semi").where("rep <> leader")
    placed = materialise(placed.select("leader", "rep", "group").distinct(), "open")
    apart = apart_pairs(materialise(differences(placed.select("leader", "rep"), docs, threshold), "differences"), placed, threshold)
    done = checked.select("a", "b").unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    apart = materialise(apart.join(done, ["a", "b"], "left_anti"), "apart")
    if not apart.isEmpty():
        more = materialise(verified(apart, docs), "checked2").where(F.col("similarity") >= threshold).select("a", "b")
        group = materialise(components(links.unionByName(more)), "group2")
    reps = classes.select("sha", "rep", "copies").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    reps = materialise(reps.select("sha", "copies", F.coalesce("component", "rep").alias("class_id")), "reps")
    named = spread_join(rows.where("bands is not null").select("doc_id", "sha"), reps, "sha", "copies").select("doc_id", "class_id")
    blank = rows.where("bands is null").select("doc_id", F.col("doc_id").alias("class_id"))
    named = materialise(named.unionByName(blank).groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "named")
    sizes = materialise(named.groupBy("class_id").agg(F.count("*").alias("group_size")), "sizes")
    kept = (F.col("doc_id") == F.col("class_id")).alias("kept")
    return spread_join(named, sizes, "class_id", "group_size").select("doc_id", "class_id", "group_size", kept)


def without_near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group of near copies: its smallest id, of rows that repeat this id the one with the smallest text;
    rows without an id stay. Texts are dealt out only for ids that repeat."""
    gone_id, row = unused(documents.columns, "_gone", "_row")
    found = near_duplicates(documents, threshold).where("not kept").select(F.col("doc_id").alias(gone_id))
    same = F.col("doc_id").cast("bigint") == F.col(gone_id)
    stay = documents.join(found, same, "left_anti")
    ids = documents.select(F.col("doc_id").cast("bigint").alias(gone_id))
    repeated = materialise(ids.where(F.col(gone_id).isNotNull()).groupBy(gone_id).agg(F.count("*").alias("_n")).where("_n > 1").select(gone_id), "repeated")
    one = stay.join(repeated, same).groupBy(gone_id).agg(F.min_by(F.struct(*documents.columns), doc_text()).alias(row)).select(f"{row}.*")
    return stay.join(repeated, same, "left_anti").unionByName(one)
