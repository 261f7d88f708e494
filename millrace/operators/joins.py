"""Lookup enrichment: map, IP-range and user-agent joins."""

from __future__ import annotations

import heapq
import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import paths
from ..errors import with_error
from ..functions.text import ipv4_number
from ..storage import materialise

#: A lookup table is broadcast up to so many rows and bytes of text; beyond either it is joined by a shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, n_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table holds at most so many rows and bytes, as JSON text; reads no more rows than that."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    n, held = df.limit(rows + 1).agg(F.count("*"), size).first()
    return n <= rows and held <= n_bytes


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is known to be small."""
    return F.broadcast(df) if is_small(df, rows) else df


def map_text(text: str) -> dict[str, str]:
    """Inline map `k v,k v`; entries without a value are skipped."""
    pairs = [e.split() for e in text.split(",")]
    return {p[0]: p[1] for p in pairs if len(p) == 2}


def map_replace(df: DataFrame, key: str, table: DataFrame, new: str | None = None) -> DataFrame:
    """Values looked up by their text in table (key, value); unmatched ones stay (or are null in a new field). Of several
    values of a key the least counts."""
    k, v, own = paths.unused(df.columns, "_k", "_v", "_key")
    lookup = table.select(F.col(table.columns[0]).cast("string").alias(k), F.col(table.columns[1]).alias(v))
    lookup = lookup.groupBy(k).agg(F.min(v).alias(v))
    joined = df.withColumn(own, paths.get(df, key).cast("string")).join(sized(lookup), F.col(own) == F.col(k), "left")
    value = F.coalesce(v, own) if not new or new == key else F.col(v)
    return paths.put(joined, new or key, value).drop(own, k, v)


def narrowest_segments(ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint (start, end, index of the range) where overlapping ranges give way to the narrowest one that holds a point;
    of equally narrow ones the first."""
    edges = sorted({s for s, _ in ranges} | {e + 1 for _, e in ranges})
    order = sorted(range(len(ranges)), key=lambda i: ranges[i][0])
    out, waiting, at = [], [], 0
    for low, high in zip(edges, edges[1:], strict=False):
        while at < len(order) and ranges[order[at]][0] <= low:
            i = order[at]
            heapq.heappush(waiting, (ranges[i][1] - ranges[i][0], i))
            at += 1
        while waiting and ranges[waiting[0][1]][1] < low:
            heapq.heappop(waiting)
        if waiting:
            i = waiting[0][1]
            if out and out[-1][1] == low - 1 and out[-1][2] == i:
                out[-1] = (out[-1][0], high - 1, i)
            else:
                out.append((low, high - 1, i))
    return out


#: Bits of an address that a prefix leaves open, from which on prefixes are few enough (2^12 and less) to be broadcast.
WIDE_BITS = 20


def aligned_blocks(start: Column, end: Column) -> Column:
    """Array of (bits, prefix): the fewest blocks of 2^bits addresses, each at a multiple of its size, that make up a range
    of IPv4 addresses, at most 62.

    From the smallest size up: a block of a size is cut off at either end where that end is no multiple of the next size.
    """
    none = F.array().cast("array<struct<bits:int,prefix:bigint>>")

    def step(have: Column, bits: Column) -> Column:
        # low and high count blocks of this size; high is the first one behind the range.
        low, high = have["low"], have["high"]
        odd_low = (low < high) & (low % 2 == 1)
        odd_high = (low < high) & (high % 2 == 1) & ((high - 1 > low) | ~odd_low)
        block = lambda at: F.array(F.struct(bits.cast("int").alias("bits"), at.cast("bigint").alias("prefix")))
        blocks = F.concat(have["blocks"], F.when(odd_low, block(low)).otherwise(none), F.when(odd_high, block(high - 1)).otherwise(none))
        up = F.floor((low + F.when(odd_low, 1).otherwise(0)) / 2).cast("bigint")
        down = F.floor((high - F.when(odd_high, 1).otherwise(0)) / 2).cast("bigint")
        return F.struct(up.alias("low"), F.greatest(down, up).alias("high"), blocks.alias("blocks"))

    first = F.struct(start.cast("bigint").alias("low"), (end.cast("bigint") + 1).alias("high"), none.alias("blocks"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(32)), first, step, lambda have: have["blocks"])


def ip_ranges(df: DataFrame, key: str, ranges: DataFrame, prefix: bool = False) -> DataFrame:
    """Attributes of the narrowest range (start, end, ...) that holds an IPv4 address; of equally narrow ones that with the
    smallest start, then with the least attributes as JSON text.

    A small table is turned to disjoint segments, cut at their /16 prefixes and looked up in place. A large one is cut to
    aligned blocks, of which each keeps its narrowest range; each distinct address then asks the block of every size that
    holds it, by a shuffle, those of the few widest blocks by a broadcast.
    """
    attrs = [c for c in ranges.columns if c not in ("start", "end")]
    number = ipv4_number(paths.get(df, key).cast("string"))
    df = with_error(df, paths.get(df, key).isNotNull() & number.isNull(), "ip", key, "not an IPv4 address")
    ip, at, low, high, found = paths.unused([*df.columns, *ranges.columns], "_ip", "_p", "_low", "_high", "_a")
    names = {a: f"{key.replace('.', '_')}_{a}" if prefix or a in df.columns else a for a in attrs}
    columns = df.columns
    df = df.withColumn(ip, number)
    ordered = ranges.where("start <= end").select("start", "end", F.struct(*attrs).alias(found), F.to_json(F.struct(*attrs), {"ignoreNullFields": "false"}).alias("least"))
    if is_small(ranges):
        rows = sorted(ordered.collect(), key=lambda r: (r["start"], r["least"]))  # bounded by is_small
        parts = [(s, e, rows[i][found]) for s, e, i in narrowest_segments([(r["start"], r["end"]) for r in rows])]
        schema = StructType().add(low, "long").add(high, "long").add(found, ordered.schema[found].dataType)
        cells = F.explode(F.sequence(F.shiftright(F.col(low), 16), F.shiftright(F.col(high), 16))).alias(at)
        cut = df.sparkSession.createDataFrame(parts, schema).select(low, high, found, cells)
        inside = (F.shiftright(F.col(ip), 16) == F.col(at)) & F.col(ip).between(F.col(low), F.col(high))
        joined = df.join(F.broadcast(cut), inside, "left")
    else:
        rank = F.struct((F.col("end") - F.col("start")).alias("width"), F.col("start").alias("start"), F.col("least").alias("least"))
        begin, stop = F.greatest(F.col("start"), F.lit(0)), F.least(F.col("end"), F.lit((1 << 32) - 1))
        blocks = ordered.where(begin <= stop).select(rank.alias("rank"), found, F.inline(aligned_blocks(begin, stop)))
        blocks = materialise(blocks.groupBy("bits", "prefix").agg(F.min("rank").alias("rank"), F.min_by(found, "rank").alias(found)), "blocks")
        asked = df.select(ip).where(F.col(ip).isNotNull()).distinct()
        asked = asked.select(ip, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(32)), lambda b: F.call_function("shiftright", F.col(ip), b))).alias("bits", "prefix"))
        wide = F.col("bits") >= WIDE_BITS
        met = asked.where(wide).join(F.broadcast(blocks.where(wide)), ["bits", "prefix"]).unionByName(asked.where(~wide).join(blocks.where(~wide), ["bits", "prefix"]))
        best = met.groupBy(F.col(ip).alias(at)).agg(F.min_by(found, "rank").alias(found))
        joined = df.join(best, F.col(ip) == F.col(at), "left")
    return joined.select(*[F.col(f"`{c}`") for c in columns], *[F.col(f"{found}.`{a}`").alias(n) for a, n in names.items()])


#: Rules of a kind in one expression; lists of more rules in all than INDEX_FROM are looked up by the texts they require.
RULES_IN_PLACE = 1_000
INDEX_FROM = 200


def groups_of(regex: str) -> int:
    """Number of capturing groups of a Java regex."""
    bare = re.sub(r"\\Q.*?(?:\\E|$)", "", regex, flags=re.S)
    bare = re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]", "", re.sub(r"\\.", "", bare))
    return len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", bare))


def required_text(regex: str) -> str | None:
    """A text in lower case that whatever matches the regex holds, in any case; None if none is known.

    What only Java understands is not looked into: such a rule is tried on every agent.
    """
    if "&&" in regex or re.search(r"\[[^\]]*\[", re.sub(r"\\.", "", regex)):  # sets of sets
        return None
    found: list[str] = []

    def walk(tree) -> None:
        own = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL" and arg < 128:
                own += chr(arg).lower()
                continue
            if name == "AT":
                continue
            found.append(own)
            own = ""
            if name == "SUBPATTERN":
                walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                walk(arg[2])
            elif name == "ATOMIC_GROUP":
                walk(arg)
        found.append(own)

    with warnings.catch_warnings():
        warnings.simplefilter("error")
        try:
            walk(re._parser.parse(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", regex)))
        except (re.error, FutureWarning, DeprecationWarning, OverflowError, RecursionError):
            return None
    best = max(found, key=len, default="")
    return best if len(best) >= 2 else None


def _filled(template: str | None, group, default: int) -> Column:
    """A template with $1 ... $9, or a group where there is none; blank is null."""
    if template is None:
        return F.nullif(group(default), F.lit(""))
    parts = re.split(r"\$(\d)", template)
    whole = F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(group(int(p)), F.lit("")) for i, p in enumerate(parts)])
    return F.nullif(F.trim(whole), F.lit(""))


def _rule_list(rules: DataFrame) -> list:
    version = F.col("version") if "version" in rules.columns else F.lit(None).cast("string").alias("version")
    listed = rules.select("rule_no", "kind", "regex", "family", version).orderBy("rule_no").limit(BROADCAST_ROWS + 1).collect()
    if len(listed) > BROADCAST_ROWS:
        raise ValueError("a rule list is matched as a whole and must be small")
    return listed


def user_agent(df: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """First matching rule for each kind of a user agent: rules (rule_no, kind, regex, family, maybe version).

    family and version may be templates with $1 to $9; null means group 1 and group 2. Rules are a bounded list. A short one
    is tried in place, in its order, each a constant pattern. Of a long one, each distinct agent only tries the rules whose
    required text it holds, found by one automaton in one pass (a stream always goes the first way). Output columns
    UA_<kind>_family and UA_<kind>_version for the kinds of the list.
    """
    listed = _rule_list(rules)
    if len(listed) > INDEX_FROM and not df.isStreaming:
        return _by_required_text(df, key, listed)
    by_kind: dict[str, list] = {}
    for r in listed:
        by_kind.setdefault(r.kind, []).append(r)
    agent = paths.get(df, key)
    (hit,) = paths.unused(df.columns, "_hit")
    for kind, own in sorted(by_kind.items()):
        out = F.lit(None).cast("struct<family:string,version:string>")
        for chunk in reversed([own[i : i + RULES_IN_PLACE] for i in range(0, len(own), RULES_IN_PLACE)]):
            tried = F
            for r in chunk:
                groups = groups_of(r.regex)
                group = lambda i, r=r, groups=groups: F.regexp_extract(agent, r.regex, i) if groups >= i else F.lit(None).cast("string")
                found = F.struct(_filled(r.family, group, 1).alias("family"), _filled(r.version, group, 2).alias("version"))
                tried = tried.when(F.regexp_like(agent, F.lit(r.regex)), found)
            out = tried.otherwise(out)
        df = df.withColumn(hit, out).withColumns({f"UA_{kind}_family": F.col(f"{hit}.family"), f"UA_{kind}_version": F.col(f"{hit}.version")}).drop(hit)
    return df


def _by_required_text(df: DataFrame, key: str, listed: list) -> DataFrame:
    """user_agent by an index of the rules; every distinct agent is looked up once."""
    texts: dict[str, list[int]] = {}
    always = []
    for i, r in enumerate(listed):
        text = required_text(r.regex)
        texts.setdefault(text, []).append(i) if text else always.append(i)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for text, own in texts.items():
            automaton.add_word(text, own)
        automaton.make_automaton()
        for batch in batches:
            agents = batch.column("agent").to_pylist()
            held = [sorted({*always, *(i for _, own in automaton.iter(a.lower()) for i in own)} if texts else always) for a in agents]
            yield pa.RecordBatch.from_arrays([batch.column("agent"), pa.array(held, pa.list_(pa.int32()))], names=["agent", "rules"])

    spark = df.sparkSession
    table = spark.createDataFrame([(i, r.kind, r.regex, r.family, r.version, groups_of(r.regex)) for i, r in enumerate(listed)], "i int, kind string, regex string, family string, version string, groups int")
    agents = df.select(paths.get(df, key).alias("agent")).where("agent is not null").distinct()
    tried = agents.mapInArrow(run, "agent string, rules array<int>").select("agent", F.explode("rules").alias("i")).join(F.broadcast(table), "i")
    group = lambda n: F.when(F.col("groups") >= n, F.call_function("regexp_extract", F.col("agent"), F.col("regex"), F.lit(n)))

    def filled(template: str, default: int) -> Column:
        out = F.col(template)
        for n in range(1, 10):
            out = F.replace(out, F.lit(f"${n}"), F.coalesce(group(n), F.lit("")))
        return F.nullif(F.when(F.col(template).isNull(), group(default)).otherwise(F.trim(out)), F.lit(""))

    hits = tried.where(F.regexp_like("agent", F.col("regex")))
    first = hits.groupBy("agent", "kind").agg(F.min_by(F.struct("regex", "family", "version", "groups"), "i").alias("r")).select("agent", "kind", "r.*")
    found = first.select("agent", "kind", F.struct(filled("family", 1).alias("family"), filled("version", 2).alias("version")).alias("found"))
    agent, = paths.unused(df.columns, "_agent")
    kinds = sorted({r.kind for r in listed})
    wide = found.groupBy(F.col("agent").alias(agent)).pivot("kind", kinds).agg(F.first("found"))
    hit = dict(zip(kinds, paths.unused(df.columns, *[f"_hit{i}" for i in range(len(kinds))]), strict=True))
    wide = materialise(wide.select(agent, *[F.col(f"`{k}`").alias(h) for k, h in hit.items()]), "agents")
    new = {f"UA_{k}_{part}": F.col(f"{h}.{part}") for k, h in hit.items() for part in ("family", "version")}
    return df.join(sized(wide), paths.get(df, key) == F.col(agent), "left").withColumns(new).drop(agent, *hit.values())


def inherit_tags(rows: DataFrame, top: DataFrame, key: str, tags: list[str]) -> DataFrame:
    """Tags of a row's agent where the row has none of its own."""
    own = [t for t in tags if t in rows.columns]
    joined = rows.join(sized(top.select(key, *[F.col(t).alias(f"_{t}") for t in tags]).dropDuplicates([key])), key, "left")
    for t in tags:
        joined = joined.withColumn(t, F.coalesce(F.col(t), F.col(f"_{t}")) if t in own else F.col(f"_{t}"))
    return joined.drop(*[f"_{t}" for t in tags])


def expand_names(pattern: str, at) -> str:
    """@(YYYY) and the like filled from a datetime."""
    parts = {"YYYY": "%Y", "YY": "%y", "MM": "%m", "DD": "%d", "hh": "%H", "mm": "%M", "ss": "%S"}
    return re.sub(r"@\((\w+)\)", lambda m: at.strftime(parts[m[1]]) if m[1] in parts else m[0], pattern)


def names_between(names: list[str], pattern: str, begin: str, end: str) -> list[str]:
    """Names that fit the pattern and whose time lies in begin .. end (yyyyMMddHHmmss prefixes)."""
    order = ["YYYY", "YY", "MM", "DD", "hh", "mm", "ss"]
    fields, regex = [], ""
    for literal, var in re.findall(r"(.*?)(?:@\((\w+)\)|$)", pattern):
        regex += "".join(".*" if c == "*" else re.escape(c) for c in literal)
        if var:
            regex += r"(\d{4})" if var == "YYYY" else r"(\d{2})"
            fields.append(var)
    out = []
    for name in names:
        if m := re.fullmatch(regex, name):
            got = dict(zip(fields, m.groups(), strict=True))
            stamp = "".join(("20" + got[f] if f == "YY" else got[f]) for f in order if f in got)
            if begin[: len(stamp)] <= stamp <= end[: len(stamp)]:
                out.append(name)
    return sorted(out)
