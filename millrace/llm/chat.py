"""Operator 7: chat formatting of reply trees.

Every message names its parent. Depth, root and path score of every message come from self-joins whose reach doubles
in each round (after k rounds a message knows its ancestor 2^k steps up), so a conversation of n turns takes log n
rounds. The leaves of a tree are ranked by the mean score of their path (ties: longer path, then smaller leaf), and
the chosen leaves' paths are spread upwards by the same doubled links. Only ids travel in these rounds.

Format: for each turn `<|im_start|>role`, a line break, the text, `<|im_end|>`, a line break. Control strings inside
roles and texts are written as ESC number ; and ESC itself as ESC 0 ; so the text comes back exactly. The loss mask is
the list of spans (code points) that hold the assistant's texts.

Defined cases: null roles and texts count as empty; a message whose parent is missing or null is a root, and messages
on a parent cycle belong to no path; equal messages are kept (they are told apart by their number); an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

#: The control strings that are escaped inside texts, by number.
ESCAPE = "␛"
CONTROLS = [
    ESCAPE, "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<|startoftext|>",
]
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column, line: bool = False) -> Column:
    """text without control strings (and, for a single line, without line breaks)."""
    for i, c in enumerate(CONTROLS):
        text = F.replace(text, F.lit(c), F.lit(f"{ESCAPE}{i};"))
    return F.replace(text, F.lit("\n"), F.lit(f"{ESCAPE}n;")) if line else text


def unescaped(text: Column) -> Column:
    text = F.replace(text, F.lit(f"{ESCAPE}n;"), F.lit("\n"))
    for i, c in reversed(list(enumerate(CONTROLS))):
        text = F.replace(text, F.lit(f"{ESCAPE}{i};"), F.lit(c))
    return text


def chosen_paths(messages: DataFrame, paths_per_tree: int = 1) -> DataFrame:
    """(tree, leaf, path_rank, msg, pos): the messages of the best root-to-leaf paths, pos counted from the root.

    messages: tree, msg, parent (longs, msg unique within its tree) and score.
    """
    m = messages.select("tree", "msg", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = m.select("tree", F.col("msg").alias("parent"), F.lit(True).alias("_known"))
    m = m.join(known, ["tree", "parent"], "left")
    # up: the ancestor 2^k steps up or null; steps, total: length and score of the path below it.
    links = m.select(
        "tree", "msg", F.when(F.col("_known"), F.col("parent")).alias("up"), F.lit(1).alias("steps"), F.col("score").alias("total")
    )
    # Messages that know their root leave the rounds; the longest path alone stays for all of them.
    n_messages, rounds, settled = None, [materialise(links, "links")], []
    while not rounds[-1].where("up is not null").isEmpty():
        n_messages = n_messages or rounds[0].count()
        if 1 << (len(rounds) - 1) > n_messages:  # only cycles are left
            break
        every = reduce(DataFrame.unionByName, settled, rounds[-1])
        above = every.select(
            "tree", F.col("msg").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_s"), F.col("total").alias("_t")
        )
        doubled = rounds[-1].where("up is not null").join(above, ["tree", "up"], "left").select(
            "tree", "msg", F.col("_up").alias("up"),
            (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"),
            (F.col("total") + F.coalesce("_t", F.lit(0.0))).alias("total"),
        )
        settled.append(rounds[-1].where("up is null"))
        rounds.append(materialise(doubled, "links"))
    rooted = reduce(DataFrame.unionByName, settled, rounds[-1].where("up is null"))
    parents = rounds[0].where("up is not null").select("tree", F.col("up").alias("msg"))
    leaves = rooted.join(parents, ["tree", "msg"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("steps"), "msg")
    picked = leaves.withColumn("path_rank", F.row_number().over(best)).where(F.col("path_rank") <= paths_per_tree)
    on_path = materialise(picked.select("tree", F.col("msg").alias("leaf"), "path_rank", "msg"), "path")
    for step in rounds:
        ups = step.where("up is not null").select("tree", "msg", "up")
        more = on_path.join(ups, ["tree", "msg"]).select("tree", "leaf", "path_rank", F.col("up").alias("msg"))
        on_path = materialise(on_path.unionByName(more), "path")
    depth = rooted.select("tree", "msg", (F.col("steps") - 1).alias("pos"))
    return on_path.join(depth, ["tree", "msg"]).select("tree", "leaf", "path_rank", "msg", "pos")


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """tree, leaf, path_rank, formatted, loss_spans (start, length): one row for each chosen path."""
    role = escaped(F.coalesce("role", F.lit("")), line=True)
    body = escaped(F.coalesce("text", F.lit("")))
    turns = (
        paths.join(messages.select("tree", "msg", "role", "text"), ["tree", "msg"])
        .select("tree", "leaf", "path_rank", "pos", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), body.alias("body"),
                F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"))
        .withColumn("turn", F.concat("head", "body", F.lit(END)))
    )
    before = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)) + F.char_length("head")
    span = F.struct(begin.alias("start"), F.char_length("body").cast("bigint").alias("length"))
    rows = turns.select("tree", "leaf", "path_rank", "pos", "turn", F.when(F.col("learn"), span).alias("span"))
    grouped = rows.groupBy("tree", "leaf", "path_rank").agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn", "span"))).alias("t")
    )
    return grouped.select(
        "tree",
        "leaf",
        "path_rank",
        F.array_join(F.col("t.turn"), "").alias("formatted"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parsed(formatted: Column) -> Column:
    """Array of (role, text) from a formatted conversation."""

    def turn(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        skip = F.char_length(role) + 1
        text = F.substring(t, skip + 1, F.char_length(t) - skip - len(END))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    parts = F.split(formatted, START.replace("|", "\\|"), -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    cut = F.transform(spans, lambda s: F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))
    return unescaped(F.array_join(cut, ""))


def linear_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations whose turns follow each other, as reply trees: tree, msg, parent, score, role, text."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return (
        conversations.select(F.col("conv_id").cast("bigint").alias("tree"), "turn", "role", "text")
        .where("tree is not null")
        .withColumn("msg", F.row_number().over(order).cast("bigint"))
        .select("tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
    )


def chat_digests(written: DataFrame) -> DataFrame:
    """Figures of formatted conversations as read back from their table."""
    turns = F.col("turns")
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        written.withColumn("turns", parsed(F.col("formatted")))
        .withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_spans")))
        .select(
            F.col("tree").alias("conv_id"),
            F.size(turns).cast("bigint").alias("n_turns"),
            F.sha2(text, 256).alias("turns_sha256"),
            F.char_length("_loss").cast("bigint").alias("loss_chars"),
            F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
            F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        )
    )


def chat_round_trip(conversations: DataFrame) -> DataFrame:
    messages = materialise(linear_conversations(conversations), "messages")
    return chat_digests(materialise(format_paths(chosen_paths(messages), messages), "chat"))
