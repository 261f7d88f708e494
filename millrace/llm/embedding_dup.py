"""Operator 5: near-duplicate embeddings with randomised-rotation binary codes.

A unit vector is turned by random rotations and kept as the signs of its coordinates, with the factor <x, code> that
corrects for what the signs lose: <code, q> / factor is an unbiased estimate of <x, q>, with an error bound that only
depends on the factor and the dimension. Where estimate plus bound stays below what a link needs, a pair is dropped;
the others are recomputed exactly, in double precision.

Candidates share a band of sign bits. Bands are as long as the logarithm of the number of vectors and as many as a
pair at the threshold needs to be met with probability RECALL. Dense groups are collapsed first, to balls: vectors
within half the threshold's angle of a centre, so that all vectors of a ball are linked. A vector's centre is found by
BALL_KEYS short keys: in each bucket the best centre is the one whose vector shares most buckets with others, and a second
round passes it on to those that only share a bucket with one of its members. Two balls are linked or apart as a whole by
the angle of their centres and their radii, and only balls at the threshold are compared vector by vector. So a group of
near copies costs its size, not its square.

Defined cases: null vectors, zero vectors and vectors with null or non-finite components link with nothing, nor do
vectors of different length; of rows that repeat an id the smallest vector counts; rows without an id are left out; other
columns are ignored, whatever their names; long vectors are taken whole, and beyond LONG components are turned by random
signs and Hadamard transforms instead of a matrix of the square of their length; vectors are divided by their largest
component first, so that no norm overflows or vanishes; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, materialise, spread_join

THRESHOLD = 0.9
RECALL = 0.999
BALL_BITS = 16
BALL_KEYS = 4
BALL_ROUNDS = 2
CODES = 4
BOUND = 4.0
SEED = 11
#: Longer vectors are padded to a power of two and turned by Hadamard transforms.
LONG = 1024
#: Components of vectors that a task turns at once.
AT_ONCE = 1 << 20


def rotations(dim: int, n: int, seed: int = SEED) -> np.ndarray:
    """n random orthogonal matrices side by side (dim, n * dim)."""
    r = np.random.default_rng([seed, dim])
    out = []
    for _ in range(n):
        q, t = np.linalg.qr(r.normal(size=(dim, dim)))
        out.append(q * np.sign(np.diag(t)))
    return np.concatenate(out, axis=1)


class Turn:
    """n random rotations of vectors, side by side; width is the length of a turned one."""

    def __init__(self, dim: int, n: int, seed: int = SEED):
        self.dim, self.n = dim, n
        if dim <= LONG:
            self.width, self.matrix = dim, rotations(dim, n, seed)
        else:
            self.width = 1 << (dim - 1).bit_length()
            self.signs = np.random.default_rng([seed, dim]).integers(0, 2, (n, 3, self.width), np.int8) * np.int8(2) - np.int8(1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.dim <= LONG:
            return x @ self.matrix
        out = np.zeros((len(x), self.n, self.width))
        out[:, :, : self.dim] = x[:, None]
        for k in range(3):
            out *= self.signs[:, k]
            half = 1
            while half < self.width:
                pair = out.reshape(len(x), self.n, -1, 2, half)
                low = pair[..., 0, :] + pair[..., 1, :]
                pair[..., 1, :] = pair[..., 0, :] - pair[..., 1, :]
                pair[..., 0, :] = low
                half *= 2
            out /= math.sqrt(self.width)
        return out.reshape(len(x), -1)


def band_shape(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band and number of bands for n vectors."""
    bits = min(30, max(8, math.ceil(math.log2(max(2, n)))))
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - met))


def _hashed(bits: np.ndarray, dim: int) -> np.ndarray:
    """(rows, groups, width) of 0 / 1 to one long for each group, apart for each group and dim (lengths beyond 16 bits may
    share keys; where vectors meet, their lengths are compared)."""
    dim = dim if dim < 1 << 16 else dim % 65_521
    value = (bits.astype(np.int64) << np.arange(bits.shape[2], dtype=np.int64)).sum(axis=2)
    return value | (np.arange(bits.shape[1], dtype=np.int64) << 31) | (np.int64(dim) << 46)


def coded(embeddings: DataFrame, bits: int, n_bands: int) -> DataFrame:
    """vec_id, dim, unit vector, codes, factors, ball keys and band keys of all usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, Turn] = {}
        for whole in batches:
            most = max(len(x) for x in whole.column("embedding")) if whole.num_rows else 1
            step = min(1024, max(1, AT_ONCE // most))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                by_dim: dict[int, list] = {}
                for vec_id, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                    by_dim.setdefault(len(x), []).append((vec_id, x))
                for dim, own in by_dim.items():
                    n_rot = max(CODES + 1, 1 + -(-bits * n_bands // dim))
                    if dim not in turned:
                        if dim > LONG:
                            turned.clear()
                        turned[dim] = Turn(dim, n_rot + -(-BALL_BITS * BALL_KEYS // dim))
                    width = turned[dim].width
                    x = np.array([v for _, v in own], np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    y = turned[dim](unit)
                    sign = (y > 0).astype(np.uint8)
                    head = sign[:, : CODES * width]
                    factor = np.abs(y[:, : CODES * width]).reshape(len(own), CODES, width).sum(axis=2) / math.sqrt(width)
                    keys = _hashed(sign[:, : bits * n_bands].reshape(len(own), n_bands, bits), dim)
                    balls = _hashed(sign[:, -BALL_BITS * BALL_KEYS :].reshape(len(own), BALL_KEYS, BALL_BITS), dim)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([i for i, _ in own], pa.int64()),
                            pa.array([dim] * len(own), pa.int32()),
                            pa.array([u.tobytes() for u in unit], pa.binary()),
                            pa.array([c.tobytes() for c in np.packbits(head, axis=1)], pa.binary()),
                            pa.array([f.tobytes() for f in factor], pa.binary()),
                            pa.array(list(balls), pa.list_(pa.int64())),
                            pa.array(list(keys), pa.list_(pa.int64())),
                        ],
                        ["vec_id", "dim", "unit", "code", "factor", "ball_keys", "keys"],
                    )

    return embeddings.mapInArrow(run, "vec_id long, dim int, unit binary, code binary, factor binary, ball_keys array<long>, keys array<long>")


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose vectors have one length, length by length."""
    sizes = np.array([len(x.as_buffer()) for x in batch.column(column)])
    for size in np.unique(sizes):
        yield batch.filter(pa.array(sizes == size))


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one length, those of long vectors in parts of AT_ONCE components."""
    for batch in batches:
        step = max(1, AT_ONCE // max(1, len(batch.column("unit")[0].as_buffer()) // 8)) if batch.num_rows else 1
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _cosines(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.float64).reshape(len(c), -1) for c in (a, b))
    return np.einsum("ij,ij->i", x, y)


def _with_cosine(df: DataFrame, a: str, b: str) -> DataFrame:
    """df without the two unit vectors, with their cosine."""
    keep = [c for c in df.columns if c not in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, a):
                columns = [batch.column(c) for c in keep]
                cos = pa.array(_cosines(batch.column(a), batch.column(b)), pa.float64())
                yield pa.RecordBatch.from_arrays([*columns, cos], [*keep, "cosine"])

    return df.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in df.dtypes if c in keep) + ", cosine double")


def plausible(pairs: DataFrame, theta: float) -> DataFrame:
    """Pairs (a, b, reach, code, factor, unit) whose estimated inner product, within its bound, allows a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, Turn] = {}
        for batch in _in_parts(part for whole in batches for part in _by_length(whole, "unit")):
            n = batch.num_rows
            unit = np.array([np.frombuffer(u.as_buffer(), np.float64) for u in batch.column("unit")])
            dim = unit.shape[1]
            if dim not in turned:
                if dim > LONG:
                    turned.clear()
                turned[dim] = Turn(dim, CODES)
            width = turned[dim].width
            raw = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, -1)
            sign = np.unpackbits(raw, axis=1)[:, : CODES * width].astype(np.float64) * 2 - 1
            factor = np.frombuffer(b"".join(batch.column("factor").to_pylist()), np.float64).reshape(n, CODES)
            q = turned[dim](unit).reshape(n, CODES, width)
            estimate = (np.einsum("ijk,ijk->ij", q, sign.reshape(n, CODES, width)) / math.sqrt(width) / factor).mean(axis=1)
            spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, width - 1))
            bound = BOUND * np.sqrt((spread**2).sum(axis=1)) / CODES
            need = np.cos(np.minimum(math.pi, theta + np.asarray(batch.column("reach"))))
            own = pa.array(estimate + bound >= need)
            yield batch.select(["a", "b", "reach"]).filter(own)

    return pairs.select("a", "b", "reach", "code", "factor", "unit").mapInArrow(run, "a long, b long, reach double")


def in_balls(vectors: DataFrame, theta: float) -> DataFrame:
    """vec_id, ball (the id of its centre, its own if it has none) and angle to the centre, at most theta / 2."""
    keyed = vectors.select("vec_id", F.explode("ball_keys").alias("key"))
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "ball_sizes")
    met = materialise(spread_join(keyed, shared, "key", "n"), "ball_keys")
    degree = met.groupBy("vec_id").agg(F.sum("n").alias("degree"))
    start = vectors.select("vec_id").join(degree, "vec_id", "left")
    members = start.select("vec_id", F.col("vec_id").alias("ball"), F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(0.0).alias("angle"))
    inside = F.col("cosine") >= math.cos(theta / 2 - 1e-6)
    for _ in range(BALL_ROUNDS):
        members = materialise(members, "members")
        centre = F.struct("degree", (-F.col("ball")).alias("ball"))
        best = met.select("vec_id", "key").join(members, "vec_id").groupBy("key").agg(F.max(centre).alias("_c"), F.count("*").alias("n"))
        best = materialise(best.select("key", (-F.col("_c.ball")).alias("to"), F.col("_c.degree").alias("to_degree"), "n"), "best")
        offers = spread_join(met.select("vec_id", "key"), best.where("n > 1"), "key", "n").select("vec_id", "to", "to_degree").distinct()
        better = (F.col("to_degree") > F.col("degree")) | ((F.col("to_degree") == F.col("degree")) & (F.col("to") < F.col("ball")))
        offers = materialise(offers.join(members.select("vec_id", "ball", "degree"), "vec_id").where(better).select("vec_id", "to", "to_degree"), "offers")
        asked = offers.groupBy("to").agg(F.count("*").alias("n"))
        asked = asked.join(vectors.select(F.col("vec_id").alias("to"), F.col("unit").alias("other")), "to")
        tried = offers.join(vectors.select("vec_id", "unit"), "vec_id").select("vec_id", "to", "to_degree", "unit")
        tried = spread_join(materialise(tried, "tried"), materialise(asked, "asked"), "to", "n", F.length("other") <= 1 << 16)
        tried = tried.where(F.length("unit") == F.length("other"))
        tried = _with_cosine(tried.select("vec_id", "to", "to_degree", "unit", "other"), "unit", "other").where(inside)
        angle = F.acos(F.least(F.col("cosine"), F.lit(1.0)))
        chosen = tried.groupBy("vec_id").agg(F.max(F.struct("to_degree", (-F.col("to")).alias("to"), angle.alias("angle"))).alias("_b"))
        new = lambda own, c: F.when(F.col("_b").isNull(), F.col(own)).otherwise(c).alias(own)
        members = members.join(chosen, "vec_id", "left").select(
            "vec_id", new("ball", -F.col("_b.to")), new("degree", F.col("_b.to_degree")), new("angle", F.col("_b.angle"))
        )
    return materialise(members.select("vec_id", "ball", "angle"), "members")


def linked_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector."""
    theta = math.acos(threshold)
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialise(rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    bits, n_bands = band_shape(usable.count(), threshold)
    vectors = materialise(coded(usable, bits, n_bands), "codes")
    members = in_balls(vectors, theta)
    # Angles near zero carry the rounding error of the arc cosine.
    alone = F.max((F.col("ball") != F.col("vec_id")).cast("int")) == 0
    radius = F.when(alone, 0.0).otherwise(F.max("angle") + 1e-6).alias("radius")
    balls = materialise(members.groupBy("ball").agg(F.count("*").alias("size"), F.min("vec_id").alias("lowest"), radius), "balls")
    keyed = vectors.select("vec_id", F.explode("keys").alias("key")).join(members.select("vec_id", "ball"), "vec_id")
    keyed = materialise(keyed.select("key", "ball").distinct(), "keys")
    pairs = keyed.select("key", F.col("ball").alias("a")).join(keyed.select("key", F.col("ball").alias("b")), "key")
    pairs = pairs.where("a < b").select("a", "b").distinct()
    for side in ("a", "b"):
        own = balls.select(F.col("ball").alias(side), F.col("radius").alias(f"r_{side}"))
        pairs = pairs.join(own, side)
    pairs = pairs.select("a", "b", (F.col("r_a") + F.col("r_b")).alias("reach"))
    pairs = pairs.join(vectors.select(F.col("vec_id").alias("b"), "code", "factor", F.col("dim").alias("dim_b")), "b")
    pairs = pairs.join(vectors.select(F.col("vec_id").alias("a"), "unit", "dim"), "a").where("dim = dim_b")
    close = materialise(plausible(pairs, theta), "plausible")
    unit = lambda i, u: vectors.select(F.col("vec_id").alias(i), F.col("unit").alias(u))
    exact = _with_cosine(close.join(unit("a", "u"), "a").join(unit("b", "v"), "b"), "u", "v")
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.col("cosine"), F.lit(1.0))))
    exact = materialise(
        exact.withColumn(
            "kind",
            F.when(F.col("reach") == 0, F.when(F.col("cosine") >= threshold, "all").otherwise("none"))
            .when(apart + F.col("reach") < theta - 1e-9, "all")
            .when(apart - F.col("reach") > theta + 1e-9, "none")
            .otherwise("some"),
        ).where("kind <> 'none'"),
        "exact",
    )
    whole, some = exact.where("kind = 'all'"), exact.where("kind = 'some'").select("a", "b")
    both = whole.select("a", "b").unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    from_balls = both.join(balls.select(F.col("ball").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("n"))
    one = lambda i, b: members.select(F.col("vec_id").alias(i), F.col("ball").alias(b))
    each = some.join(one("x", "a"), "a").join(one("y", "b"), "b")
    each = _with_cosine(each.join(unit("x", "u"), "x").join(unit("y", "v"), "y"), "u", "v").where(F.col("cosine") >= threshold)
    each = materialise(each.select("a", "b", "x", "y"), "each")
    singly = each.select("x").unionByName(each.select(F.col("y").alias("x"))).groupBy("x").agg(F.count("*").alias("n"))
    named = components(whole.select("a", "b").unionByName(each.select("a", "b").distinct()))
    # A component is named by its smallest vector.
    named = materialise(balls.join(named.withColumnRenamed("node", "ball"), "ball", "left").select("ball", "lowest", F.coalesce("component", "ball").alias("component")), "named")
    named = named.select("ball", "component").join(named.groupBy("component").agg(F.min("lowest").alias("lowest")), "component")
    by_ball = (
        balls.select("ball", "size")
        .join(from_balls.select(F.col("a").alias("ball"), F.col("n").alias("n_balls")), "ball", "left")
        .join(named.select("ball", F.col("lowest").alias("component")), "ball", "left")
    )
    by_ball = materialise(by_ball, "by_ball")
    links = (
        spread_join(members, by_ball, "ball", "size")
        .join(singly.select(F.col("x").alias("vec_id"), F.col("n").alias("n_each")), "vec_id", "left")
        .select("vec_id", (F.col("size") - 1 + F.coalesce("n_balls", F.lit(0)) + F.coalesce("n_each", F.lit(0))).alias("n_links"),
                F.col("component").alias("component_id"))
    )
    return rows.select("vec_id").join(links, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )
