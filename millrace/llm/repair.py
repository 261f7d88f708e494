"""Operator 13: repair of conversations whose turns were damaged.

A conversation's rows are symbols: the class of the role's initial and the row's first fault. Edits that give a sequence
of roles `(s?(ua)+)?` at the least cost are a path through four states (nothing yet, after system, user, assistant).
Hirschberg's divide and conquer finds it in linear space: forward costs of the first half and backward costs of the second
meet in the middle, the least crossing is taken, and both halves are solved in turn.

Ties go to the ASCII-least string of edits. Forward vectors therefore carry, besides the cost, the rank of each state's
least string: strings up to a row end with that row's edit and hold one edit that is no insertion for each row, so none
is a prefix of another, and ranks alone decide which of two longer strings is less.

Two streams meet in each conversation: symbols, one character a row, summed up by stretches of turns, and the texts,
which are read in order and go straight into a digest. A task holds no more of a conversation than its symbols and edits.

Defined cases: nulls count as one space (a null conv_id is a conversation of its own, with its rows); a null turn comes
first; rows of one turn go by role, then by the SHA-256 of their text; repeated rows are duplicates; conversations that
lose all rows have zeros, no edits and the digest of the empty string; an empty table gives no rows; other columns are
not read; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States; the role each of them asks for next; what follows it; insertions that end a conversation in it.
START, SYSTEM, USER, ASSISTANT = range(4)
NEEDS = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"u": USER, "a": ASSISTANT}
ENDING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
ROLES = {"u": "user", "a": "assistant"}
#: A symbol is a hexadecimal digit: 4 * class of the initial (s, u, a, other) + first fault.
INITIALS = "sua"
SOUND, CUT, BLANK, SEEN = range(4)
_FAR = 1 << 60
#: Rows that are solved at once, with all their choices in memory.
TOGETHER = 256
#: Turns of a stretch whose symbols are put together first.
STRETCH = 1024


def _choices() -> list[list[list[tuple[str, int, int]]]]:
    """[symbol][state]: (edits, cost, next state) of a row, insertions before it included, in ASCII order of the edits."""
    out = []
    for symbol in range(16):
        initial, fault = (INITIALS + "?")[symbol >> 2], symbol & 3
        rows = []
        for state in range(4):
            found = [("D", DELETE, state)]
            if fault in (SOUND, CUT):
                more = TRUNCATED if fault == CUT else 0
                if state == START and initial == "s":
                    found.append(("K", KEEP + more, SYSTEM))
                inserted = AFTER[NEEDS[state]]
                for edits, cost, at in (("", 0, state), ("I", INSERT, inserted)):
                    same = NEEDS[at] == initial
                    found.append((edits + ("K" if same else "R"), cost + (KEEP if same else REROLE) + more, AFTER[NEEDS[at]]))
            rows.append(sorted(found))
        out.append(rows)
    return out


CHOICES = _choices()
Vector = tuple[list[int], list[int]]


def forward(symbols: bytes, state: int) -> Vector:
    """Costs of reaching each state from `state` over the symbols, and the rank of each one's least string."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[state] = 0
    for symbol in symbols:
        cost, rank, _ = _step(symbol, cost, rank)
    return cost, rank


def _step(symbol: int, cost: list[int], rank: list[int]) -> tuple[list[int], list[int], list[tuple]]:
    best: list[tuple] = [(_FAR, 0, "", 0)] * 4
    for state, options in enumerate(CHOICES[symbol]):
        if cost[state] < _FAR:
            for edits, price, to in options:
                found = (cost[state] + price, rank[state], edits, state)
                if found < best[to]:
                    best[to] = found
    order = sorted(range(4), key=lambda s: best[s][1:3])
    new = [0] * 4
    for k, s in enumerate(order):
        new[s] = k
    return [b[0] for b in best], new, best


def backward(symbols: bytes, state: int) -> list[int]:
    """Cost from each state to `state` over the symbols."""
    cost = [_FAR] * 4
    cost[state] = 0
    for symbol in reversed(symbols):
        cost = [min(price + cost[to] for _, price, to in options) for options in CHOICES[symbol]]
    return cost


def _direct(symbols: bytes, begin: int, end: int) -> list[str]:
    cost, rank, back = [_FAR] * 4, [0] * 4, []
    cost[begin] = 0
    for symbol in symbols:
        cost, rank, best = _step(symbol, cost, rank)
        back.append(best)
    out, state = [], end
    for best in reversed(back):
        out.append(best[state][2])
        state = best[state][3]
    return out[::-1]


def between(symbols: bytes, begin: int, end: int, together: int = TOGETHER) -> list[str]:
    """Edits of each row on the cheapest, then ASCII-least way from state to state."""
    if len(symbols) <= together:
        return _direct(symbols, begin, end)
    middle = len(symbols) // 2
    (to, rank), rest = forward(symbols[:middle], begin), backward(symbols[middle:], end)
    cross = min(range(4), key=lambda s: (to[s] + rest[s], rank[s]))
    return between(symbols[:middle], begin, cross, together) + between(symbols[middle:], cross, end, together)


def edits_of(symbols: bytes, together: int = TOGETHER) -> tuple[int, list[str], int]:
    """Cost, edits by row, insertions behind the last row."""
    cost, rank = forward(symbols, START)
    end = min(range(4), key=lambda s: (cost[s] + INSERT * ENDING[s], rank[s]))
    return cost[end] + INSERT * ENDING[end], between(symbols, START, end, together), ENDING[end]


def figures(symbols: str) -> tuple[int, int, int, int, int, str]:
    """blank, duplicate, truncated, illegal neighbours, cost, edits of a conversation's symbols."""
    own = bytes(int(c, 16) for c in symbols)
    count = [sum(1 for s in own if s & 3 == fault) for fault in (BLANK, SEEN, CUT)]
    roles = [s >> 2 for s in own]
    illegal = sum(1 for pair in zip(roles, roles[1:]) if pair not in ((0, 1), (1, 2), (2, 1)))
    cost, edits, more = edits_of(own)
    return *count, illegal, cost, "".join(edits) + "I" * more


_remembered = lru_cache(1 << 14)(figures)


def figures_of(symbols: str) -> tuple[int, int, int, int, int, str]:
    """figures, remembered for short conversations, which repeat each other."""
    return _remembered(symbols) if len(symbols) <= 40 else figures(symbols)


def repaired_digest(edits: str, rows: Iterator[tuple[str, str]]) -> str:
    """SHA-256 of the repaired `role:text`, one a line."""
    digest, state, first = hashlib.sha256(), START, True
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = AFTER.get(role[:1], SYSTEM)
        else:
            state = AFTER[(need := NEEDS[state])]
            role = ROLES[need]
        digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: a twentieth of the rows each is dropped, emptied, loses its stops, is repeated, or gets the role user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _digest(text: str) -> Column:
    return F.sha2(F.col(text), 256)


def symbols(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """conv_id, symbols (a hexadecimal digit a row, in order), gaps. rows: as damaged gives them; equal rows are added up first."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT)
    there = F.col("copies") > 0
    slim = rows.select("conv_id", "turn", F.when(there, F.col("role")).alias("role"), F.when(there, _digest("text")).alias("text"), F.when(there, fault).alias("fault"), "copies")
    slim = slim.groupBy("conv_id", "turn", "role", "text", "fault").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = slim.where("copies > 0").groupBy("conv_id", "role", "text").agg(F.min(place).alias("place")).select("conv_id", "role", "text", "place.turn", F.lit(True).alias("lead"))
    a, b = slim.alias("a"), first.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.turn").eqNullSafe(F.col("b.turn")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.text") == F.col("b.text"))
    letter = F.substring("a.role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    digit = lambda kind: F.lower(F.hex(4 * initial + kind))
    head = F.when(F.col("a.fault") == BLANK, BLANK).when(F.col("b.lead"), F.col("a.fault")).otherwise(SEEN)
    rest = F.when(F.col("a.fault") == BLANK, BLANK).otherwise(SEEN)
    own = F.when(F.col("a.copies") > 0, F.concat(digit(head), F.repeat(digit(rest), F.col("a.copies").cast("int") - 1))).otherwise("")
    units = a.join(b, same, "left").select("a.conv_id", "a.turn", "a.role", "a.text", own.alias("own"))
    part = units.groupBy("conv_id", F.floor(F.col("turn") / stretch).alias("stretch")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "own"))).alias("u"))
    turns = F.array_distinct(F.transform(F.filter("u", lambda x: (x["own"] != "") & x["turn"].isNotNull()), lambda x: x["turn"]))
    part = part.select("conv_id", "stretch", F.array_join(F.transform("u", lambda x: x["own"]), "").alias("own"), turns.alias("turns")).select(
        "conv_id", "stretch", "own", F.array_min("turns").alias("low"), F.array_max("turns").alias("high"), F.size("turns").alias("n")
    )
    whole = part.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("stretch", "own"))).alias("p"), F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("n"), F.lit(0)).cast("bigint").alias("gaps")
    )
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["own"]), "").alias("symbols"), "gaps")


FIGURES = ["blank", "duplicate", "truncated", "illegal", "cost"]


def edit_scripts(marked: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit from symbols()."""
    kind = marked.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [figures_of(s) for s in batch.column("symbols").to_pylist()]
            columns = list(zip(*found)) if found else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("gaps"), *[pa.array(list(c), pa.int64()) for c in columns[:5]], pa.array(list(columns[5]), pa.string())],
                names=["conv_id", "gaps", *FIGURES, "audit"],
            )

    return marked.mapInArrow(run, f"conv_id {kind}, gaps long, {', '.join(f'{f} long' for f in FIGURES)}, audit string")


def repair_conversations(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """A row a conversation: gaps, faults, cost and edits, and the digest of the repaired rows. rows: as damaged gives them."""
    scripts = edit_scripts(symbols(rows, stretch))
    plan = F.struct(*[c for c in scripts.columns if c != "conv_id"])
    nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    turn = rows.schema["turn"].dataType.simpleString()
    heads = scripts.select("conv_id", F.lit(0).alias("side"), nothing("turn", turn), nothing("role", "string"), nothing("text", "string"), F.lit(0).alias("copies"), plan.alias("plan"))
    lines = rows.where("copies > 0").select("conv_id", F.lit(1).alias("side"), "turn", "role", "text", "copies", F.lit(None).cast(heads.schema["plan"].dataType).alias("plan"))
    met = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "side", "turn", "role", _digest("text"))
    return met.select("conv_id", "side", "role", "text", "copies", "plan.*").mapInArrow(_digests, f"{_plain(scripts)}, repaired_sha256 string")


def _plain(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by conversation, its plan first: the plan with the digest."""
    names = ["conv_id", "gaps", *FIGURES, "audit"]
    ahead: list = []  # the plan that ended the last conversation's rows
    kinds: list = []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            kinds[:] = [batch.schema.field(n).type for n in names]
            yield from zip(*(batch.column(c).to_pylist() for c in ["side", "role", "text", "copies", *names]))

    stream = rows()

    def lines() -> Iterator[tuple[str, str]]:
        for side, role, text, copies, *plan in stream:
            if side == 0:
                ahead.append(plan)
                return
            for _ in range(copies):
                yield role, text

    def packed(done: list) -> pa.RecordBatch:
        columns = list(zip(*done))
        arrays = [pa.array(list(c), kind) for c, kind in zip(columns, [*kinds, pa.string()])]
        return pa.RecordBatch.from_arrays(arrays, names=[*names, "repaired_sha256"])

    for _ in lines():
        raise ValueError("rows without a plan")
    done: list = []
    while ahead:
        plan = ahead.pop()
        own = lines()
        done.append((*plan, repaired_digest(plan[-1], own)))
        for _ in own:
            pass
        if len(done) == 5000:
            yield packed(done)
            done = []
    if done:
        yield packed(done)
