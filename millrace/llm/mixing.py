"""Operator 8: mixing sources to target weights, DataFrame functions only.

Each source's words stand in one line (its documents one after another) and are cut into blocks of BLOCK_WORDS. The
mix is a list of slots, cut into output shards. Every slot draws its source with the probability of that source's
share, so each shard's source counts are a multinomial draw; draws beyond a source's quota go to sources that are
short, so the whole mix meets the targets to the word. The k-th slot of a source takes block perm(k): a pseudorandom
permutation of the source's block numbers for each pass over it (swap-or-not shuffle, any length). Slots and documents
then meet by an equi-join on source and block number.

Targets: all words are shared by weight; a target stops at `cap` times its source's size and the excess is shared
again by weight (found directly: sources ordered by cap per weight, the first ones are full).

Running totals are taken in three steps (cells of buckets, buckets of a cell, documents of a bucket; the same with
shards and their slots), so no task holds a whole source.

mixed_blocks gives the drawn blocks as texts in slot order. mixed_documents gives whole documents instead: a source's
documents in the order of the slots that take their first words, again and again, until its target is met; the last one
is taken if that brings the source nearer to its target, so it is off by half a document at most.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source without words has
target 0; equal rows are taken each on its own (mixed_documents shares their copies among them by a hash); documents
without words are taken never by the mix and once by mixed_documents; very long texts are cut into blocks like others; an
empty table gives no rows; other columns are ignored by mix and kept by mixed_documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import doc_text, materialise, unused

BLOCK_WORDS = 128
SHARD_SLOTS = 1024
DOCS_PER_BUCKET = 2_000
#: Buckets or shards whose sums one task adds up.
FAN = 2_000
#: Slots of a source whose whole documents are added up together.
SLOTS_PER_CELL = 64
WEIGHTS = (5.0, 2.0, 1.0)
ROUNDS = 12
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def permuted(index: Column, length: Column, *seed: Column, inverse: bool = False) -> Column:
    """Place of index in a pseudorandom permutation of 0 .. length - 1."""
    rounds = [F.lit(i) for i in range(ROUNDS)]

    def step(x: Column, i: Column) -> Column:
        key = F.pmod(F.xxhash64(*seed, i), length)
        other = F.pmod(key - x, length)
        return F.when(F.xxhash64(*seed, i, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.array(*(rounds[::-1] if inverse else rounds)), index.cast("bigint"), step)


def located(df: DataFrame, position: str, ranges: DataFrame, total: int) -> DataFrame:
    """df with the one row of ranges (_from, _len, ...) that holds its position; ranges tile 0 .. total - 1.

    Ranges are cut at a grid of some thousand cells, so it is an equi-join on the cell, however long one range is.
    """
    grid = max(1, total // 4096)
    cells = ranges.where("_len > 0").withColumn(
        "_cell", F.explode(F.sequence(F.expr(f"_from div {grid}"), F.expr(f"(_from + _len - 1) div {grid}")))
    )
    inside = (F.col(position) >= F.col("_from")) & (F.col(position) < F.col("_from") + F.col("_len"))
    return df.withColumn("_cell", F.expr(f"{position} div {grid}")).join(cells, "_cell").where(inside).drop("_cell")


def running(df: DataFrame, value: str, order: list[str], by: list[str] | None = None) -> Column:
    """Sum of value over the rows before, in order."""
    w = Window.partitionBy(*by) if by else Window
    return F.coalesce(F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def with_base(sums: DataFrame, by: str, place: str, value: str) -> DataFrame:
    """sums (one row for each by and place) with `_base`, the sum of value over smaller places, instead of value."""
    cells = sums.withColumn("_cell", F.expr(f"{place} div {FAN}"))
    tops = cells.groupBy(by, "_cell").agg(F.sum(value).alias("_n"))
    tops = tops.withColumn("_top", running(tops, "_n", ["_cell"], [by])).drop("_n")
    inside = cells.withColumn("_inside", running(cells, value, [place], [by, "_cell"]))
    return inside.join(tops, [by, "_cell"]).select(by, place, (F.col("_top") + F.col("_inside")).alias("_base"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """One row for each source: source, source_size, target (words, double)."""
    # From here on: as many rows as there are sources.
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int")))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    per = per.withColumn("all", F.sum("source_size").over(every)).withColumn("w_all", F.sum("weight").over(every))
    level = F.col("limit") / F.col("weight")
    tight = Window.orderBy(level, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("limit").over(tight), F.lit(0.0))
    gone = F.coalesce(F.sum("weight").over(tight), F.lit(0.0))
    per = per.withColumn("full", (F.col("all") - full) / (F.col("w_all") - gone) >= level)
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0.0))
    w_left = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return per.select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * left / w_left).alias("target"),
    )


def _mixed(documents: DataFrame, seed: int, weights: tuple[float, ...], cap: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """plan (one row for each source), line (one row for each document: its place in its source's words) and slots (slot,
    sid, block, upto: how many of the block's words it takes)."""
    spark = documents.sparkSession
    sized = materialise(
        documents.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            n_words(doc_text()).alias("size"),
            F.xxhash64(doc_text()).alias("_row"),
        ),
        "sized",
    )
    n_docs = sized.count()
    b = F.lit(BLOCK_WORDS)
    targets = source_targets(sized, weights, cap)
    # Passes over the source, blocks of the last pass, and how far its last block is used.
    plan = (
        targets.withColumn("sid", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("bigint"))
        .withColumn("words", F.least(F.round("target").cast("bigint"), F.floor(F.col("source_size") * cap)))
        .withColumn("n_blocks", F.ceil(F.col("source_size") / b))
        .withColumn("short", b - F.pmod(-F.col("source_size"), b))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
        .withColumn(
            "short_at",
            F.when(
                F.col("n_blocks") > 0,
                permuted(F.col("n_blocks") - 1, F.col("n_blocks"), F.lit(seed), F.col("sid"), F.col("passes"), inverse=True),
            ).otherwise(F.lit(0)),
        )
        .withColumn("k", F.ceil(F.col("rest") / b))
        .withColumn("k_words", F.col("k") * b - F.when(F.col("short_at") < F.col("k"), b - F.col("short")).otherwise(0))
        .withColumn("k", F.when(F.col("k_words") < F.col("rest"), F.col("k") + 1).otherwise(F.col("k")))
        .withColumn("k_words", F.col("k") * b - F.when(F.col("short_at") < F.col("k"), b - F.col("short")).otherwise(0))
        .withColumn("unused", F.col("k_words") - F.col("rest"))
        .withColumn("_len", F.col("passes") * F.col("n_blocks") + F.col("k"))
    )
    plan = plan.withColumn("_from", running(plan, "_len", ["sid"]))
    plan = materialise(plan, "plan")
    total = plan.agg(F.coalesce(F.sum("_len"), F.lit(0))).first()[0]
    taken = spark.createDataFrame([], "slot bigint, sid bigint, block bigint, upto bigint")
    if total:
        quota = plan.select("sid", "_from", "_len")
        slots = spark.range(total).select(
            F.col("id").alias("slot"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("draw")
        )
        drawn = located(slots, "draw", quota, total).select(
            "slot", F.expr(f"slot div {SHARD_SLOTS}").alias("shard"), "sid", F.col("_len").alias("quota")
        )
        drawn = materialise(drawn, "drawn")
        counts = drawn.groupBy("sid", "shard").agg(F.count("*").alias("n"))
        counts = with_base(counts, "sid", "shard", "n")
        nth = F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot")) - 1
        ranked = drawn.withColumn("nth", nth).join(counts, ["sid", "shard"])
        ranked = ranked.select("slot", "sid", "quota", (F.col("_base") + F.col("nth")).alias("rank"))
        # Draws over quota, numbered in one line, against the places that other sources still have free.
        per = drawn.groupBy("sid").agg(F.count("*").alias("got")).withColumnRenamed("sid", "_s")
        per = plan.select("sid", "_len").join(per, F.col("sid") == F.col("_s"), "left").fillna(0, ["got"])
        per = per.select(
            "sid",
            F.least("got", "_len").alias("kept"),
            F.greatest(F.col("got") - F.col("_len"), F.lit(0)).alias("over"),
            F.greatest(F.col("_len") - F.col("got"), F.lit(0)).alias("free"),
        )
        per = materialise(
            per.withColumn("over_from", running(per, "over", ["sid"])).withColumn("free_from", running(per, "free", ["sid"])),
            "free",
        )
        n_over = per.agg(F.sum("over")).first()[0]
        kept = ranked.where("rank < quota").select("slot", "sid", "rank")
        if n_over:
            over = ranked.where("rank >= quota").join(per.select("sid", "over_from"), "sid")
            over = over.select("slot", (F.col("over_from") + F.col("rank") - F.col("quota")).alias("place"))
            free = per.select("sid", F.col("kept"), F.col("free_from").alias("_from"), F.col("free").alias("_len"))
            moved = located(over, "place", free, n_over)
            kept = kept.unionByName(moved.select("slot", "sid", (F.col("kept") + F.col("place") - F.col("_from")).alias("rank")))
        taken = kept.join(plan.select("sid", "n_blocks", "short", "unused", F.col("_len").alias("quota")), "sid")
        taken = taken.withColumn("pass", F.expr("rank div n_blocks")).withColumn(
            "block", permuted(F.expr("rank % n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("sid"), F.col("pass"))
        )
        filled = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("short").cast("bigint")).otherwise(b.cast("bigint"))
        upto = filled - F.when(F.col("rank") == F.col("quota") - 1, F.col("unused")).otherwise(F.lit(0))
        taken = taken.select("slot", "sid", "block", upto.alias("upto"))
    # The documents of each source in one line: buckets of documents first, then the documents of a bucket.
    n_buckets = max(1, n_docs // DOCS_PER_BUCKET)
    ids = plan.select("sid", F.struct("source").alias("_src"), "source_size", "target")
    line = sized.withColumn("_src", F.struct("source")).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)))
    line = line.join(ids, "_src").drop("_src")
    by = ["sid", "bucket"]
    sums = line.groupBy(*by).agg(F.sum("size").alias("n"))
    sums = with_base(sums, "sid", "bucket", "n")
    line = line.withColumn("_start", running(line, "size", ["doc_id", "size", "_row"], by)).join(sums, by)
    line = line.withColumn("start", F.col("_base") + F.col("_start")).withColumn("_uid", F.monotonically_increasing_id())
    line = materialise(line.select("_uid", "sid", "doc_id", "_row", "size", "source_size", "target", "start"), "line")
    return plan, line, taken


def word_ranges(line: DataFrame, slots: DataFrame) -> DataFrame:
    """slot, shard, _uid, doc_id, _row, at (place in the block), from_word (place in the document) and n_words of every part
    of a document that a slot takes."""
    b = F.lit(BLOCK_WORDS)
    first, last = F.expr(f"start div {BLOCK_WORDS}"), F.expr(f"(start + size - 1) div {BLOCK_WORDS}")
    pieces = line.where("size > 0").select("_uid", "doc_id", "_row", "sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    at = F.greatest(F.col("start") - F.col("block") * b, F.lit(0))
    n_words = F.least(F.col("start") + F.col("size") - F.col("block") * b, F.col("upto")) - at
    return pieces.join(slots, ["sid", "block"]).select(
        "slot", F.expr(f"slot div {SHARD_SLOTS}").alias("shard"), "_uid", "doc_id", "_row", at.alias("at"),
        (F.col("block") * b + at - F.col("start")).alias("from_word"), n_words.alias("n_words"),
    ).where("n_words > 0")


def mix(documents: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the slots take) for each row of documents."""
    _, line, slots = _mixed(documents, seed, weights, cap)
    got = word_ranges(line, slots).groupBy("_uid").agg(F.sum("n_words").alias("taken"))
    taken = F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    return line.join(got, "_uid", "left").select("doc_id", "size", "source_size", "target", taken)


def mixed_blocks(documents: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """shard, slot, doc_ids, text: the words that each slot takes, by single spaces, and the documents they come from."""
    _, line, slots = _mixed(documents, seed, weights, cap)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(doc_text()).alias("_h"), doc_text().alias("_text"))
    texts = texts.groupBy("_id", "_h").agg(F.first("_text").alias("_text"))
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_h"))
    words = F.slice(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), (F.col("from_word") + 1).cast("int"), F.col("n_words").cast("int"))
    parts = word_ranges(line, slots).join(texts, own).select("shard", "slot", F.struct("at", "doc_id", F.array_join(words, " ").alias("text")).alias("_p"))
    blocks = parts.groupBy("shard", "slot").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    return blocks.select("shard", "slot", F.col("_p.doc_id").alias("doc_ids"), F.array_join("_p.text", " ").alias("text"))


def mixed_documents(documents: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """The rows of documents as often as the mix takes them, whole."""
    plan, line, _ = _mixed(documents, seed, weights, cap)
    # A copy of a document stands at the slot that takes its first word in one of the passes over its source.
    ends = plan.select("sid", "passes", "n_blocks", "words")
    copies = line.where("size > 0").join(F.broadcast(ends), "sid")  # as many rows as there are sources
    copies = copies.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int"))))
    place = permuted(F.expr(f"start div {BLOCK_WORDS}"), F.col("n_blocks"), F.lit(seed), F.col("sid"), F.col("pass").cast("bigint"), inverse=True)
    copies = copies.withColumn("rank", F.col("pass") * F.col("n_blocks") + place).withColumn("cell", F.expr(f"rank div {SLOTS_PER_CELL}"))
    copies = materialise(copies.select("_uid", "sid", "words", "size", "start", "rank", "cell"), "copies")
    sums = with_base(copies.groupBy("sid", "cell").agg(F.sum("size").alias("n")), "sid", "cell", "n")
    inside = running(copies, "size", ["rank", "start", "_uid"], ["sid", "cell"])
    before = copies.withColumn("_inside", inside).join(sums, ["sid", "cell"]).withColumn("before", F.col("_base") + F.col("_inside"))
    times = before.where("2 * before + size <= 2 * words").groupBy("_uid").agg(F.count("*").alias("times"))
    rated = line.join(times, "_uid", "left").withColumn("times", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.coalesce("times", F.lit(0))))
    row_id, row_hash, rate, nth = unused(documents.columns, "_id", "_h", "_rate", "_n")
    rates = rated.groupBy(F.col("doc_id").alias(row_id), F.col("_row").alias(row_hash)).agg(F.avg("times").alias(rate)).where(F.col(rate) > 0)
    part = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(1_000_000)) / 1e6
    columns = [F.col(f"`{c}`") for c in documents.columns]
    keyed = documents.select("*", F.xxhash64(doc_text()).alias(f"{row_hash}2"), part.alias(f"{nth}2"))
    joined = keyed.join(rates, F.col("doc_id").cast("bigint").eqNullSafe(F.col(row_id)) & (F.col(f"{row_hash}2") == F.col(row_hash)))
    whole = F.floor(F.col(rate) + F.col(f"{nth}2")).cast("int")
    return joined.where(whole > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), whole))).select(*columns)
