"""Operator 1: document fingerprints (SimHash) with permuted block tables, DataFrame functions only.

A term is a run of three words (all words of a shorter text); every occurrence votes once, so a term weighs as often
as it occurs. Each of the 128 bits of a term's hash votes for or against that bit of the fingerprint; a tie gives 0.

Votes are counted two bits at a time: adding up `hash >>> k & 0x1_0000_0001` counts bits k and k + 32 in the two
halves of one long. The counts of a document are added up where its words are, before anything is shuffled.

Defined cases: null text counts as empty; an empty text has the all-zero fingerprint; rows that repeat both id and
text give one row; rows without an id have no place in the order and are left out; where one id has several texts, its
smallest text stands for it as the "next document". Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import doc_text, let, materialise, spread_join

BITS = 128
WORD_RUN = 3
#: By distances measured with changed words on 300 documents of sf0.1: at a five-word similarity of 0.9 half of the copies
#: lie within 10.5 bits and all within 22, just above 0.8 half within 13, 98% within 22 and 99% within 23, while 3 of
#: 44,850 pairs of documents as they are lie within 24 (median 64). 23 is also the most that eight tables reach exactly
#: with two differing bits of a block.
RADIUS = 23
#: Text that one bucket of neighbouring documents holds.
BUCKET_BYTES = 16 << 20
_HALF = 0x0000_0001_0000_0001
_SPACE = r"[\x20\x09-\x0D]+"


def term_hashes(text: Column) -> Column:
    """Array of the 64-bit hashes of all runs of WORD_RUN words, repeats included."""
    words = F.transform(F.filter(F.split(text, _SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")

    def runs(w: Column) -> Column:
        n = F.size(w)
        at = lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(WORD_RUN)])
        return (
            F.when(n >= WORD_RUN, F.transform(F.sequence(F.lit(1), n - (WORD_RUN - 1)), at))
            .when(n == 0, none)
            .otherwise(F.array(F.xxhash64(w)))
        )

    return let(words, runs)


def fingerprint(df: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """keys, f0, f1 (the two halves of the fingerprint) from a column with term hashes; one row for each key."""
    votes = df.select(*keys, F.explode_outer(hashes).alias("h0")).withColumn("h1", F.when(F.col("h0").isNotNull(), F.xxhash64("h0")))
    sums = [
        F.sum(F.shiftrightunsigned(F.col(f"h{w}"), k).bitwiseAND(F.lit(_HALF))).alias(f"v{w}_{k}")
        for w in range(BITS // 64)
        for k in range(32)
    ]
    counted = votes.groupBy(*keys).agg(F.count("h0").alias("n_terms"), *sums)

    def half(w: int) -> Column:
        def bit(k: int) -> Column:
            v = F.col(f"v{w}_{k % 32}")
            ones = v.bitwiseAND(F.lit(0xFFFFFFFF)) if k < 32 else F.shiftrightunsigned(v, 32)
            return F.when(ones * 2 > F.col("n_terms"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0))

        return reduce(lambda x, y: x.bitwiseOR(y), [bit(k) for k in range(64)])

    return counted.select(*keys, "n_terms", half(0).alias("f0"), half(1).alias("f1"))


def as_hex(*halves: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(h)), 16, "0") for h in halves]))


def hamming(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(p.bitwiseXOR(q)) for p, q in zip(a, b, strict=True)])


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal bits, 0 to 1; unrelated texts lie near 0.5."""
    return 1.0 - hamming(a, b) / F.lit(float(64 * len(a)))


def _blocks(f: list[Column], n_blocks: int) -> list[Column]:
    """n_blocks equal bit ranges of the fingerprint (each half is cut into n_blocks / 2)."""
    per, width = n_blocks // len(f), 64 * len(f) // n_blocks
    mask = F.lit((1 << width) - 1 if width < 64 else -1)
    return [F.shiftrightunsigned(h, k * width).bitwiseAND(mask) for h in f for k in range(per)]


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(f0, f1, n_within, near): for each distinct query fingerprint how many rows of prints lie within the Hamming
    radius, and their distinct fingerprints as sorted hex.

    One table for each of n blocks, asked with all keys of at most a differing bits. With a = radius div n, a pair
    within the radius differs in at most a bits in one of the first radius - a * n + 1 blocks, or in at most a - 1 bits
    in one of the others, so each such pair meets in a table; the first table where it meets counts it. Equal
    fingerprints are collapsed with their number first, so a group of copies is one row of each table.
    """
    n_blocks = 4
    while radius // n_blocks > 2:
        n_blocks *= 2
    most, width = radius // n_blocks, BITS // n_blocks
    differ = [most if i <= radius - most * n_blocks else most - 1 for i in range(n_blocks)]
    differ = [d for d in differ if d >= 0]  # of small radii: fewer tables than blocks
    place = lambda i, key: key.bitwiseOR(F.lit(i << width))

    def probes(i: int, key: Column) -> Column:
        masks = [sum(1 << k for k in bits) for d in range(differ[i] + 1) for bits in combinations(range(width), d)]
        return F.transform(F.array(*map(F.lit, masks)).cast("array<bigint>"), lambda m: place(i, key.bitwiseXOR(m)))

    f, q = [F.col("f0"), F.col("f1")], [F.col("q0"), F.col("q1")]
    kept = [place(i, key) for i, key in enumerate(_blocks(f, n_blocks)[: len(differ)])]
    data = prints.groupBy("f0", "f1").agg(F.count("*").alias("n")).select("f0", "f1", "n", F.explode(F.array(*kept)).alias("at"))
    asked = queries.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")).distinct()
    sought = [probes(i, key) for i, key in enumerate(_blocks(q, n_blocks)[: len(differ)])]
    asked = asked.select("q0", "q1", F.explode(F.flatten(F.array(*sought))).alias("at"))
    apart = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_blocks(f, n_blocks), _blocks(q, n_blocks), strict=True)]
    first = reduce(lambda rest, i: F.when(apart[i] <= differ[i], F.lit(i)).otherwise(rest), reversed(range(len(differ))), F.lit(-1))
    own = F.shiftrightunsigned("at", width) == first
    # The planner sees the size of asked before it is exploded and would broadcast it.
    pairs = data.join(asked.hint("merge"), "at").where((hamming(f, q) <= radius) & own)
    found = pairs.groupBy("q0", "q1").agg(F.sum("n").alias("n_within"), F.sort_array(F.collect_list(as_hex("f0", "f1"))).alias("near"))
    return found.select(F.col("q0").alias("f0"), F.col("q1").alias("f1"), "n_within", "near")


def found_pairs(result: DataFrame) -> DataFrame:
    """(doc_id, found_id): the documents that each asked document of fingerprint_documents found within the radius."""
    asked = result.select("doc_id", F.explode("near_fingerprints").alias("fingerprint"))
    members = result.select(F.col("doc_id").alias("found_id"), "fingerprint")
    return asked.join(members, "fingerprint").where("doc_id <> found_id").select("doc_id", "found_id").distinct()


#: Buckets at most: beyond MAX_BUCKETS times their size they grow, so that the plan and what the driver holds do not.
MAX_BUCKETS = 1 << 14


def bucket_starts(lengths: DataFrame, bucket_bytes: int = BUCKET_BYTES, most: int = MAX_BUCKETS) -> list[int]:
    """First doc_id of each bucket of neighbouring documents (doc_id, n bytes), ascending: one number for bucket_bytes of
    text, or for the larger share that makes about `most` buckets, comes to the driver."""
    total = lengths.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bucket_bytes = max(bucket_bytes, -(-total // most))
    parts = lengths.groupBy("doc_id").agg(F.sum("n").alias("n")).repartitionByRange("doc_id")
    parts = materialise(parts.withColumn("_part", F.spark_partition_id()), "ids")
    by_part = Window.partitionBy("_part").orderBy("doc_id")
    before = F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = parts.select("_part", "doc_id", F.floor(before / F.lit(bucket_bytes)).alias("_cell"))
    return sorted(r[0] for r in cells.groupBy("_part", "_cell").agg(F.min("doc_id")).select("min(doc_id)").collect())


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit(f"[{','.join(map(str, values))}]"), "array<bigint>")


def last_at_most(values: list[int], x: Column) -> Column:
    """Place (from 1) of the last of the ascending values that is at most x: a binary search."""
    held = _longs(values)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(values).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.try_element_at(held, at + step) <= x, at + step).otherwise(at))


def edited_texts(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """_bucket, doc_id, text, edited, next_id: the last floor(n/2) code points replaced by the start of the next document.

    Texts are dealt out once, to buckets of neighbouring ids; the first document of a bucket also goes to the bucket
    before it (that of the first bucket to the last one), where it only serves as the next document.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), doc_text().alias("text")).where("doc_id is not null")
    starts = bucket_starts(docs.select("doc_id", F.octet_length("text").alias("n")), bucket_bytes) or [0]
    own = last_at_most(starts, F.col("doc_id"))
    place = lambda bucket, guest: F.struct(bucket.alias("bucket"), F.lit(guest).alias("guest"))
    before = F.pmod(F.col("_own") - 2, F.lit(len(starts))) + 1
    first = F.try_element_at(_longs(starts), F.col("_own")) == F.col("doc_id")
    places = F.when(first, F.array(place(F.col("_own"), 0), place(before, 1))).otherwise(F.array(place(F.col("_own"), 0)))
    rows = docs.withColumn("_own", own).select("doc_id", "text", F.explode(places).alias("_at"))
    rows = rows.select("doc_id", "text", F.col("_at.bucket").alias("_bucket"), F.col("_at.guest").alias("_guest"))
    rows = rows.withColumn("_order", F.when(F.col("_guest") == 1, F.lit((1 << 63) - 1)).otherwise(F.col("doc_id")))
    # Backwards, so that what follows a document has been seen when its turn comes.
    w = Window.partitionBy("_bucket").orderBy(F.desc("_order"), F.desc("_guest"), F.desc("text"))
    smaller = F.lead(F.struct("doc_id", "_guest")).over(w)
    smallest = F.coalesce(smaller != F.struct("doc_id", "_guest"), F.lit(True))
    rows = rows.withColumn("_head", F.when(smallest, F.struct("doc_id", "text")))
    following = F.last("_head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("_next.text", F.lit(1), half))
    return rows.withColumn("_next", following).where("_guest = 0").select(
        "_bucket", "doc_id", "text", edited.alias("edited"), F.col("_next.doc_id").alias("next_id")
    )


def fingerprint_documents(documents: DataFrame, radius: int = RADIUS, query_every: int = 50) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and for every query_every-th id the number of other
    documents within the Hamming radius and the fingerprints there, its own included (null for the rest): the found
    documents are the rows with one of these, see found_pairs."""
    texts = edited_texts(documents)
    sha = lambda c: F.unhex(F.sha2(F.col(c), 256))
    kinds = texts.select(
        "_bucket",
        "doc_id",
        "next_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        sha("text").alias("text_sha"),
        sha("edited").alias("edited_sha"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")),
                F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")),
            )
        ).alias("_k"),
    )
    # The bucket is part of the key: what the texts are dealt out by serves the sums too.
    keys = ["_bucket", "doc_id", "next_id", "n_chars", "text_sha", "edited_sha"]
    hashed = kinds.select(*keys, "_k.kind", term_hashes(F.col("_k.t")).alias("hashes"))
    prints = fingerprint(hashed, [*keys, "kind"], "hashes")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = prints.groupBy(*keys).agg(
        of(0, "f0").alias("f0"), of(0, "f1").alias("f1"), of(1, "f0").alias("e0"), of(1, "f1").alias("e1")
    )
    wide = materialise(wide.drop("_bucket"), "prints")
    following = (
        wide.groupBy("doc_id")
        .agg(F.min(F.struct("f0", "f1")).alias("_n"))
        .select(F.col("doc_id").alias("next_id"), F.col("_n.f0").alias("n0"), F.col("_n.f1").alias("n1"))
    )
    asked = F.col("doc_id") % query_every == 0
    near = within_radius(wide.select("f0", "f1"), wide.where(asked), radius)
    named = wide.where(asked).select("doc_id", "f0", "f1", "text_sha").distinct()
    copies = named.groupBy("f0", "f1").agg(F.count("*").alias("copies"))
    near = materialise(near.join(copies, ["f0", "f1"]), "near")
    short = F.size("near") <= 1000
    near = spread_join(named, near, ["f0", "f1"], "copies", short).select("doc_id", "text_sha", "n_within", "near")
    f = [F.col("f0"), F.col("f1")]
    return (
        wide.join(following, "next_id", "left")
        .join(near, ["doc_id", "text_sha"], "left")
        .select(
            "doc_id",
            "n_chars",
            F.lower(F.hex("edited_sha")).alias("edited_sha256"),
            as_hex("f0", "f1").alias("fingerprint"),
            as_hex("e0", "e1").alias("edited_fingerprint"),
            likeness(f, [F.col("e0"), F.col("e1")]).alias("near_edited"),
            likeness(f, [F.col("n0"), F.col("n1")]).alias("near_next"),
            (F.col("n_within") - 1).alias("n_within_radius"),
            F.col("near").alias("near_fingerprints"),
        )
    )
