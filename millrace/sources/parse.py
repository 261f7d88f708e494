"""Parse jobs: a table of lines (`value`, other columns kept) to typed columns; bad lines carry an entry in `_errors`.

Blank lines are dropped. A line that fails keeps its text in `raw_line`; `split_errors` parts good rows and quarantine.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import with_error
from ..functions import dates, text
from . import grok_library

LINE = "value"


def _lines(df: DataFrame) -> DataFrame:
    return df.where(F.trim(LINE) != "")


def _failed(df: DataFrame, bad: Column, op: str, message: str, keep_raw: bool = False) -> DataFrame:
    df = with_error(df, bad, op, LINE, message)
    raw = F.col(LINE) if keep_raw else F.when(F.coalesce(bad, F.lit(False)), F.col(LINE))
    return df.withColumn("raw_line", raw)


def _labels(df: DataFrame, labels: dict | None, override: bool) -> DataFrame:
    for k, v in (labels or {}).items():
        df = df.withColumn(k, F.lit(v) if override or k not in df.columns else F.coalesce(F.col(k), F.lit(v)))
    return df


def _typed(c: Column, kind: str, offset_hours: int = 0) -> Column:
    return {
        "long": lambda: c.try_cast("bigint"), "float": lambda: c.try_cast("double"), "string": lambda: c,
        "date": lambda: dates.parsed(c, None, offset_hours),
    }[kind]()


def delimited(df: DataFrame, schema: list[tuple[str, str]], sep: str = "\t", allow_fewer: bool = False, allow_more: str | None = None,
              ignore_invalid: bool = False, contain_sep: str | None = None, labels: dict | None = None, offset_hours: int = 0,
              rename_dashes: bool = False) -> DataFrame:
    """Delimited lines with declared types (long, float, string, date, jsonmap).

    allow_more: surplus parts become a map column of that name. contain_sep: the column that may hold the separator and
    takes surplus parts back. A bad field fails the row, or is left out with ignore_invalid. A jsonmap becomes a map.
    """
    n = len(schema)
    parts = F.split(F.col(LINE), re.escape(sep), -1)
    df = _lines(df).withColumn("_p", parts)
    if contain_sep:
        at = [c for c, _ in schema].index(contain_sep)
        extra = F.greatest(F.size("_p") - n, F.lit(0))
        middle = F.array_join(F.slice("_p", at + 1, extra + 1), sep)
        rest = F.slice("_p", extra + at + 2, F.greatest(F.size("_p") - extra - at - 1, F.lit(0)))
        df = df.withColumn("_p", F.concat(F.slice("_p", 1, at), F.array(middle), rest))
    size = F.size("_p")
    bad = F.lit(False)
    if not allow_fewer:
        bad = bad | (size < n)
    if allow_more is None:
        bad = bad | (size > n)
    out, wrong = [], F.lit(False)
    for i, (name, kind) in enumerate(schema):
        c = F.trim(F.get("_p", F.lit(i)))
        if kind == "jsonmap":
            value = F.when(c != "", F.from_json(c, "map<string,string>"))
            fails = (c != "") & F.coalesce(~c.startswith("{") | F.try_parse_json(c).isNull(), F.lit(False))
        elif kind in ("long", "float"):
            value = F.when(c == "", F.lit(0)).otherwise(_typed(c, kind))
            fails = (c != "") & _typed(c, kind).isNull()
        else:
            value = _typed(c, kind, offset_hours)
            fails = (c != "") & value.isNull()
        wrong = wrong | F.coalesce(fails, F.lit(False))
        out.append(value.cast({"long": "bigint", "float": "double"}[kind]).alias(name) if kind in ("long", "float") else value.alias(name))
    if allow_more is not None:
        extra = F.slice("_p", n + 1, F.greatest(size - n, F.lit(0)))
        out.append(text.array_fields(extra, allow_more).alias(allow_more))
    names = [c.replace("-", "_") if rename_dashes else c for c, _ in schema] + ([allow_more] if allow_more is not None else [])
    others = [c for c in df.columns if c not in ("_p", *names)]
    fails = bad if ignore_invalid else bad | wrong
    df = df.select(*others, *[c.alias(m) for c, m in zip(out, names, strict=True)], fails.alias("_bad"))
    df = _failed(df, F.col("_bad"), "csv", "columns or types do not match").drop("_bad")
    return _labels(df, labels, False)


def jsonl(df: DataFrame, schema: str, labels: dict | None = None) -> DataFrame:
    """JSON objects, or arrays of objects that become a row each, with a declared schema."""
    is_list = F.ltrim(LINE).startswith("[")
    one = F.array(F.from_json(LINE, schema))
    df = _lines(df).withColumn("_r", F.explode_outer(F.when(is_list, F.from_json(LINE, f"array<struct<{schema}>>" if ":" in schema else f"array<struct<{_colons(schema)}>>")).otherwise(one)))
    df = _failed(df, F.try_parse_json(LINE).isNull(), "json", "not JSON")
    names = df.schema["_r"].dataType.fieldNames()
    # A field of the record wins over a column of its name, the line's too.
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("_r", *names)], *[F.col(f"_r.`{c}`") for c in names])
    return _labels(df, labels, False)


def _colons(ddl: str) -> str:
    """`a long, b string` as the fields of a struct type."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


#: Separates the captures of one match; a line that holds it gets a longer mark of its own.
_MARK = "\u0001"


def without_captures(pattern: str) -> str:
    """The pattern with all its groups made non-capturing. In character classes and escapes brackets stay; a [ in a class
    is itself, where Java would open another one."""
    out, at, opened = [], 0, -1
    while at < len(pattern):
        ch, step = pattern[at], 1
        piece = ch
        if ch == "\\":
            piece, step = pattern[at : at + 2], 2
        elif opened >= 0:
            first = at == opened + 1 or (at == opened + 2 and pattern[at - 1] == "^")
            if ch == "[":
                piece = "\\["
            elif ch == "]" and first:
                piece = "\\]"
            elif ch == "]":
                opened = -1
        elif ch == "[":
            opened = at
        elif ch == "(":
            named = re.match(r"\(\?P?<\w+>", pattern[at:])
            if named or pattern[at + 1 : at + 2] != "?":
                piece, step = "(?:", len(named[0]) if named else 1
        out.append(piece)
        at += step
    return "".join(out)


def compile_grok(pattern: str, custom: dict[str, str] | None = None, files: list[str] = ()) -> tuple[str, list[tuple[str, str]]]:
    """One Java regex, and (field, modifier) of each of its groups in order."""
    known, fields = grok_library.library(files) | (custom or {}), []

    def expand(p: str, depth: int = 0) -> str:
        if depth > 30:
            raise ValueError("patterns refer to each other without end")

        def one(m: re.Match) -> str:
            name, field, modifier = (m[1].split(":") + ["", ""])[:3]
            if name not in known:
                raise ValueError(f"unknown pattern {name}")
            if field and modifier != "drop":
                fields.append((field, {"int": "long"}.get(modifier, modifier) or "string"))
                return f"({expand(known[name], depth + 1)})"
            return f"(?:{expand(known[name], depth + 1)})"

        return re.sub(r"%\{([^}]+)\}", one, without_captures(p))

    return expand(pattern), fields


def _top_level(pattern: str) -> str:
    """The pattern without what stands in brackets and escapes."""
    out, depth, in_class, at = [], 0, False, 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == "\\":
            at += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif not depth:
            out.append(ch)
        at += 1
    return "".join(out)


def with_captures(df: DataFrame, patterns: list[str], n_groups: list[int], line: Column, out: str = "_cap") -> DataFrame:
    """df with `out`: (which pattern matched first, its captures), null if none did. Each pattern is matched once a line."""
    # A run of marks that is longer than the line cannot be in it.
    own = F.concat(F.lit("\u0002"), F.repeat(F.lit(_MARK), F.char_length("_clean") + 1), F.lit("\u0002"))
    df = df.withColumn("_clean", line).withColumn("_mark", F.when(F.col("_clean").contains(_MARK), own).otherwise(F.lit(_MARK)))
    common = F.col("_mark") == _MARK
    for k, (rx, n) in enumerate(zip(patterns, n_groups, strict=True)):
        whole = rx if rx.startswith("^") and rx.endswith("$") and not rx.endswith("\\$") and "|" not in _top_level(rx) else rf"^[\s\S]*?(?:{rx})[\s\S]*\z"
        shape = _MARK + str(k) + "".join(f"{_MARK}${i + 1}" for i in range(n))
        marked = F.when(common, F.regexp_replace("_clean", F.lit(whole), F.lit(shape))).otherwise(
            F.regexp_replace("_clean", F.lit(whole), F.replace(F.lit(shape), F.lit(_MARK), F.col("_mark")))
        )
        # A line that one pattern marked begins with the mark: no other is tried.
        df = df.withColumn("_clean", marked if k == 0 else F.when(F.col("_clean").startswith(F.col("_mark")), F.col("_clean")).otherwise(marked))
    parts = F.when(common, F.split("_clean", _MARK, -1)).otherwise(F.split("_clean", F.col("_mark"), -1))
    cap = F.when(F.col("_clean").startswith(F.col("_mark")), parts)
    # A generated column: a filter on a capture stays above it and does not match the line once more.
    return df.withColumn(out, F.explode(F.array(cap))).drop("_clean", "_mark")


def _captured(df: DataFrame, compiled: list[tuple[str, list[tuple[str, str]]]], op: str, labels, override: bool, keep_raw: bool, offset_hours: int, numbers_dash: bool = False) -> DataFrame:
    """Columns of the first regex that matches; empty captures and failed casts are null."""
    kinds: dict[str, str] = {}
    for _, fields in compiled:
        for name, kind in fields:
            kinds.setdefault(name, kind)
    df = with_captures(df, [rx for rx, _ in compiled], [len(fields) for _, fields in compiled], F.col(LINE))
    columns = []
    for name, kind in kinds.items():
        value = None
        for k, (_, fields) in reversed(list(enumerate(compiled))):
            places = [i + 2 for i, (n, _) in enumerate(fields) if n == name]
            own = F.coalesce(*[F.nullif(F.btrim(F.get("_cap", F.lit(i)), F.lit(' "')), F.lit("")) for i in places]) if places else F.lit(None).cast("string")
            value = own if len(compiled) == 1 else F.when(F.get("_cap", F.lit(1)) == str(k), own).otherwise(value if value is not None else F.lit(None).cast("string"))
        if numbers_dash and kind in ("long", "float"):
            value = F.when(value == "-", F.lit("0")).otherwise(value)
        columns.append((name, kind, value))
    others = [c for c in df.columns if c not in ("_cap", *kinds)]
    df = df.select(*others, *[v.alias(n) for n, _, v in columns], F.col("_cap").isNotNull().alias("_hit"))
    df = df.withColumns({n: _typed(F.col(f"`{n}`"), kind, offset_hours) for n, kind, _ in columns if kind != "string"})
    df = _failed(df, ~F.col("_hit"), op, "no pattern matches", keep_raw).drop("_hit")
    return _labels(df, labels, override)


def grok(df: DataFrame, patterns: list[str], custom: dict[str, str] | None = None, multi: bool = False, labels: dict | None = None, keep_raw: bool = False,
         offset_hours: int = 0, pattern_files: list[str] = ()) -> DataFrame:
    """First matching pattern wins; modifiers long (or int), float, string, date, drop. pattern_files: libraries beside the
    core, on the driver."""
    df = _lines(df)
    if multi:
        df = df.withColumn(LINE, F.regexp_replace(LINE, r"[\r\n]+", " "))
    return _captured(df, [compile_grok(p, custom, pattern_files) for p in patterns], "grok", labels, False, keep_raw, offset_hours)


def log_format_regex(log_format: str) -> tuple[str, list[str]]:
    """Regex and variables of an access-log format with $variables."""
    names = re.findall(r"\$(\w+)", log_format)
    parts = re.split(r"\$\w+", log_format)
    out = re.escape(parts[0]).replace(r"\ ", " +")
    for after in parts[1:]:
        stop = after[:1]
        body = "(.*?)" if stop else "(.*)"
        if stop == '"':
            body = '([^"]*)'
        elif stop == "]":
            body = r"([^\]]*)"
        elif stop == " ":
            body = r"(\S*)" if not re.search(r'["\[]$', out) else "(.*?)"
        out += body + re.escape(after).replace(r"\ ", " +")
    return f"^{out}$", names


def format_of(config: str, name: str) -> str:
    """The format that a server's configuration text declares under a name: its quoted parts as one; comments do not count."""
    part = r"""(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^\s;'"]+)"""
    bare = re.sub(r"(?m)^\s*#.*$", "", config)
    found = re.search(rf"(?m)(?:^|[;{{}}])\s*log_format\s+{re.escape(name)}\s+(?:escape=\w+\s+)?({part}(?:\s*{part})*)\s*;", bare)
    if not found:
        raise ValueError(f"no log_format {name}")
    own = [p[1:-1] if p[0] in "\"'" else p for p in re.findall(part, found.group(1))]
    return re.sub(r"\\(.)", r"\1", "".join(own))


def access_log(df: DataFrame, log_format: str, types: dict[str, str] | None = None, labels: dict | None = None, offset_hours: int = 0, config: str | None = None) -> DataFrame:
    """Access log by its format line, or with a configuration's text by the name of a format in it; - is 0 for numbers;
    undeclared variables are text."""
    rx, names = log_format_regex(format_of(config, log_format) if config is not None else log_format)
    fields = [(n, (types or {}).get(n, "string")) for n in names]
    return _captured(_lines(df), [(rx, fields)], "nginx", labels, True, False, offset_hours, True)


def key_value(df: DataFrame, out: str = "fields", labels: dict | None = None, splitter: str = "=", typed: dict[str, str] | None = None, keep_string: bool = False) -> DataFrame:
    """key=value lines to a map column; a missing key is an error.

    typed: columns of requested keys, as long, float, bool, date or string; keep_string leaves all of them text.
    """
    pairs = text.key_values(F.col(LINE), splitter)
    df = _failed(_lines(df).withColumn(out, text.last_of_each(pairs)), F.col(out).isNull(), "kv", "no key=value")
    for name, kind in (typed or {}).items():
        c = F.try_element_at(F.col(out), F.lit(name))
        if not keep_string:
            c = c.try_cast("boolean") if kind == "bool" else _typed(c, kind)
        df = df.withColumn(name, c)
    return _labels(df, labels, True)


def audit(df: DataFrame) -> DataFrame:
    """Linux audit lines: fields (map), msg_timestamp, msg_id, msg (nested map) and addr.

    A repeated key takes the first free name of dev, dev_1, ... dev_5, in fields as in msg; with none free it replaces dev.
    """
    body = F.regexp_replace(F.regexp_replace(LINE, r"[\r\n]+", " "), r"msg='([^']*)'", "")
    stamp = r"msg=audit\((\d+\.\d+):(\d+)\):?"
    rest = F.regexp_replace(body, stamp, "")
    pattern = r'([^\s="]+)=("[^"]*"|\S*)'
    ks, vs = (F.regexp_extract_all(rest, F.lit(pattern), F.lit(i)) for i in (1, 2))
    df = _lines(df).withColumn("_k", ks).withColumn("_v", vs)
    values = F.transform("_v", lambda v: F.btrim(v, F.lit('"')))
    inner = F.regexp_extract(F.regexp_replace(LINE, r"[\r\n]+", " "), r"msg='([^']*)'", 1)
    nested = text.first_free(F.regexp_extract_all(inner, F.lit(pattern), F.lit(1)), F.transform(F.regexp_extract_all(inner, F.lit(pattern), F.lit(2)), lambda v: F.btrim(v, F.lit('"'))))
    seconds = F.nullif(F.regexp_extract(LINE, stamp, 1), F.lit(""))
    df = df.withColumn("fields", text.first_free(F.col("_k"), values))
    df = df.withColumn("msg_timestamp", F.timestamp_micros((seconds.try_cast("decimal(20,6)") * 1_000_000).cast("bigint")))
    df = df.withColumn("msg_id", F.nullif(F.regexp_extract(LINE, stamp, 2), F.lit("")))
    df = df.withColumn("msg", F.when(inner != "", nested))
    df = df.withColumn("addr", F.nullif(F.try_element_at(F.col("msg"), F.lit("addr")), F.lit("?")))
    return _failed(df, F.size("_k") == 0, "linuxaudit", "no key=value").drop("_k", "_v")


#: Names by number.
FACILITIES = ["kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "security", "console", "solaris-cron", *[f"local{i}" for i in range(8)]]
SEVERITIES = ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"]


def syslog(df: DataFrame, year: int | None = None, names: bool = False, offset_hours: int = 0) -> DataFrame:
    """RFC 5424, RFC 3164 and length-framed (RFC 6587) lines, told apart by their head.

    RFC 3164 has no year: `year`, or the current one. Of elements and parameters that repeat a name the last stays.
    """
    df = _lines(df).withColumn("_l", F.regexp_replace(LINE, r"^\d+ (?=<\d{1,3}>)", ""))
    # Structured data is what stands in brackets; anything else there is the message's beginning.
    new = r"^<(\d{1,3})>(\d{1,2}) (\S+) (\S+) (\S+) (\S+) (?:(\S+) (-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: ([\s\S]*))?|(\S+) ([\s\S]*))$"
    old = r"^<(\d{1,3})>([A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d) (\S+) (?:([^\s:\[]+)(?:\[(\d+)\])?: ?)?([\s\S]*)$"
    df = with_captures(df, [new, old], [11, 6], F.col("_l"))
    which = F.get("_cap", F.lit(1))
    is_new, is_old = which == "0", which == "1"
    group = lambda i: F.nullif(F.get("_cap", F.lit(i + 1)), F.lit(""))

    def pick(i_new: list[int], i_old: int | None) -> Column:
        a = F.coalesce(*map(group, i_new)) if i_new else F.lit(None).cast("string")
        b = group(i_old) if i_old else F.lit(None).cast("string")
        return F.nullif(F.when(is_new, a).when(is_old, b), F.lit("-"))

    the_year = F.lit(str(year)) if year else F.year(F.current_date()).cast("string")
    then = F.try_to_timestamp(F.concat(the_year, F.lit(" "), F.regexp_replace(F.when(is_old, group(2)), r" +", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    if offset_hours:
        then = then + F.make_dt_interval(hours=F.lit(offset_hours))
    priority = pick([1], 1).try_cast("int")
    df = df.select(
        "*", priority.alias("priority"), F.shiftright(priority, 3).alias("facility"), (priority % 8).alias("severity"),
        pick([2], None).try_cast("int").alias("version"), F.when(is_new, dates.parsed(group(3))).when(is_old, then).alias("timestamp"),
        pick([4], 3).alias("hostname"), pick([5], 4).alias("app_name"), pick([6], 5).alias("proc_id"), pick([7, 10], None).alias("msg_id"), pick([9, 11], 6).alias("message"),
        (F.coalesce(is_new | is_old, F.lit(False))).alias("_ok"), F.when(is_new, group(8)).alias("_sd"),
    )
    elements = F.regexp_extract_all("_sd", F.lit(r"\[((?:[^\]\\]|\\.)*)\]"), F.lit(1))
    param = r'(\S+?)="((?:[^"\\]|\\.)*)"'
    params = lambda e: F.arrays_zip(F.regexp_extract_all(e, F.lit(param), F.lit(1)).alias("key"), F.regexp_extract_all(e, F.lit(param), F.lit(2)).alias("value"))
    data = text.last_of_each(F.transform(elements, lambda e: F.struct(F.substring_index(e, " ", 1).alias("key"), text.last_of_each(params(e)).alias("value"))))
    df = df.withColumn("structured_data", F.when(F.size(elements) > 0, data))
    if names:
        df = df.withColumn("facility_name", F.get(F.array(*map(F.lit, FACILITIES)), F.col("facility")))
        df = df.withColumn("severity_name", F.get(F.array(*map(F.lit, SEVERITIES)), F.col("severity")))
    return _failed(df, ~F.col("_ok"), "syslog", "no known head").drop("_l", "_ok", "_sd", "_cap")


def slow_log(df: DataFrame) -> DataFrame:
    """Slow-query events (whole events in `value`, see streaming.pull.assemble) to their fields."""
    get = lambda rx, i=1: F.nullif(F.regexp_extract(LINE, rx, i), F.lit(""))
    who = r"# User@Host: ([^\[\s]*)\[[^\]]*\] @ (\S*) ?\[([^\]]*)\]"
    numbers = r"# Query_time: ([\d.]+)\s+Lock_time: ([\d.]+)\s+Rows_sent: (\d+)\s+Rows_examined: (\d+)"
    statement = F.regexp_replace(F.regexp_replace(LINE, r"(?m)^#.*$\n?", ""), r"(?mi)^(?:use [^;]+|SET timestamp=\d+);\s*\n?", "")
    df = _lines(df).select(
        "*", get(who, 1).alias("User"), F.coalesce(get(who, 2), get(who, 3)).alias("Host"), get(r"(?mi)^use ([^;]+);").alias("Database"),
        get(numbers, 1).try_cast("double").alias("Query_time"), get(numbers, 2).try_cast("double").alias("Lock_time"),
        get(numbers, 3).try_cast("bigint").alias("Rows_sent"), get(numbers, 4).try_cast("bigint").alias("Rows_examined"),
        F.timestamp_seconds(get(r"(?i)SET timestamp=(\d+)").try_cast("bigint")).alias("Timestamp"), F.nullif(F.trim(F.regexp_replace(statement, r"\s+$", "")), F.lit("")).alias("Statement"),
    )
    return _failed(df, F.col("Query_time").isNull(), "mysqllog", "no query time")


#: Head fields of a service log line, and the two that combine: a request id and a level in either order, of
#: which both may be missing, and a module or a file in brackets or before a line number.
HEADERS = {
    "prefix": r"(?P<prefix>[^\d\s]\S*)\s*", "date": r"(?P<date>\d{4}/\d{2}/\d{2})\s+", "time": r"(?P<time>\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)\s*",
    "reqid": r"\[(?P<reqid>[A-Za-z0-9_-]{8,})\]\s*", "level": r"\[(?P<level>[A-Z]{4,5})\]\s*", "module": r"\[(?P<module>[^\]]*)\]\s*", "file": r"(?P<file>[^\s:\[\]]+:\d+):?\s*",
    "combinedReqidLevel": r"(?:\[(?P<level>[A-Z]{4,5})\]\s*(?:\[(?P<reqid>[A-Za-z0-9_-]{8,})\]\s*)?|\[(?P<reqid>[A-Za-z0-9_-]{8,})\]\s*\[(?P<level>[A-Z]{4,5})\]\s*|\[(?P<reqid>[A-Za-z0-9_-]{8,})\]\s*)",
    "combinedModuleFile": r"(?:\[(?P<module>[^\]]*)\]\s*(?:(?P<file>[^\s:\[\]]+:\d+):\s*)?|(?P<file>[^\[\]]*?[^\s:\[\]]+:\d+):\s*)",
}
DEFAULT_HEADERS = ("date", "time", "combinedReqidLevel", "combinedModuleFile")
#: What an event of a service log begins with, for streaming.pull.assemble.
HEADER_HEAD = r"^[1-9]\d{3}/[0-1]\d/[0-3]\d [0-2]\d:[0-6]\d:[0-6]\d(\.\d{6})? \["


def header_log(df: DataFrame, headers: list[str] = DEFAULT_HEADERS,
               optional: list[str] = ("prefix", "reqid", "level", "module", "file", "combinedReqidLevel", "combinedModuleFile")) -> DataFrame:
    """Service log lines with a declared order of head fields; the rest of a line is `log`."""
    rx = "^" + "".join(f"(?:{HEADERS[h]})?" if h in optional else HEADERS[h] for h in headers) + r"(?P<log>[\s\S]*)$"
    order = re.findall(r"\(\?P<(\w+)>", rx)
    df = with_captures(_lines(df), [re.sub(r"\(\?P<\w+>", "(", rx)], [len(order)], F.col(LINE))
    group = lambda i: F.nullif(F.get("_cap", F.lit(i + 2)), F.lit(""))
    got = {n: F.coalesce(*[group(i) for i, m in enumerate(order) if m == n]) for n in dict.fromkeys(order)}
    df = df.select("*", *[c.alias(n) for n, c in got.items()])
    if "date" in got and "time" in got:
        df = df.withColumn("time", dates.parsed(F.concat_ws(" ", "date", "time"))).drop("date")
    return _failed(df, F.col("_cap").isNull(), "headerlog", "head does not match").drop("_cap")


def rest_proxy(df: DataFrame) -> DataFrame:
    """REST proxy log: request lines, and error and warning counters; other lines give nothing."""
    t = F.split(F.trim(LINE), r"\s+")
    at = lambda i: F.get(t, F.lit(i))
    level = F.regexp_extract(LINE, r"\b(INFO|ERROR|WARN)\b", 1)
    request = (F.size(t) == 16) & (level == "INFO")
    quoted = lambda c: F.btrim(c, F.lit('"'))
    stamp = F.regexp_extract(LINE, r"\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d),(\d{3})\]", 0)
    millis = F.unix_millis(F.try_to_timestamp(F.btrim(stamp, F.lit("[]")), F.lit("yyyy-MM-dd HH:mm:ss,SSS")))
    method_at = F.array_position(t, F.filter(t, lambda x: x.rlike('^"(GET|POST|PUT|DELETE)$'))[0])
    path = F.element_at(t, (method_at + 1).cast("int"))
    return (
        _lines(df).where(request | level.isin("ERROR", "WARN"))
        .select("*", F.when(request, F.regexp_extract(LINE, r"(\d+\.\d+\.\d+\.\d+)", 1)).alias("source_ip"),
                F.when(request, F.regexp_extract(path, r"/topics/([^/\s\"]+)", 1)).alias("topic"), F.when(request, quoted(F.element_at(t, method_at.cast("int")))).alias("method"),
                F.when(request, at(12).try_cast("bigint")).alias("code"), F.when(request, at(13).try_cast("bigint")).alias("resp_len"), F.when(request, at(14).try_cast("bigint")).alias("duration"),
                millis.alias("log_time"), F.when(level == "ERROR", 1).alias("error"), F.when(level == "WARN", 1).alias("warn"))
    )


def raw(df: DataFrame, timestamp: bool = True, labels: dict | None = None) -> DataFrame:
    out = df.where(F.col(LINE) != "").select(F.col(LINE).alias("raw"), *[c for c in df.columns if c not in (LINE, "raw")])
    return _labels(out.withColumn("timestamp", F.current_timestamp()) if timestamp else out, labels, True)


def empty(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def redis_log(df: DataFrame, key: str = LINE) -> DataFrame:
    """Redis server lines, [pid] or pid:role form: pid, role, timestamp text, level, message."""
    old, new = r"^\[(\d+)\] (\d{2} \w{3}(?: \d{4})? [\d:.]+) ([.*#-]) (.*)$", r"^(\d+):([XCSM]) (\d{2} \w{3}(?: \d{4})? [\d:.]+) ([.*#-]) (.*)$"
    c = F.col(key)
    a, b = F.regexp_like(c, F.lit(old)), F.regexp_like(c, F.lit(new))
    word = lambda v, names: F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), v)
    either = lambda i, j: F.when(a, F.regexp_extract(c, old, i)).when(b, F.regexp_extract(c, new, j))
    roles = {"X": "sentinel", "C": "RDB/AOF writing child", "S": "slave", "M": "master"}
    levels = {".": "debug", "-": "verbose", "*": "notice", "#": "warning"}
    df = df.select("*", either(1, 1).try_cast("bigint").alias("pid"), F.when(b, word(F.regexp_extract(c, new, 2), roles)).alias("role"),
                   either(2, 3).alias("log_time"), F.when(a | b, word(either(3, 4), levels)).alias("level"), either(4, 5).alias("message"))
    return with_error(df, ~F.coalesce(a | b, F.lit(False)), "redis", key, "no known form")


def tode_log(df: DataFrame, key: str = LINE) -> DataFrame:
    """[time]LEVEL:host:server:pid:[source:line]: message, missing parts as unknown."""
    rx = r"^\[([^\]]*)\]([A-Z]*):([^:]*):([^:]*):([^:]*):\[([^:\]]*):?([^\]]*)\]:\s*(.*)$"
    names = ["timestamp", "level", "host", "server", "pid", "source", "line", "message"]
    c = F.col(key)
    df = df.select("*", *[F.coalesce(F.nullif(F.trim(F.regexp_extract(c, rx, i + 1)), F.lit("")), F.lit("unknown")).alias(n) for i, n in enumerate(names)])
    return with_error(df, ~F.coalesce(F.regexp_like(c, F.lit(rx)), F.lit(False)), "tode", key, "no known form")


def container_path(df: DataFrame, key: str) -> DataFrame:
    """Container log path to pod, namespace, container name and id."""
    base = F.regexp_replace(F.regexp_replace(F.col(key), r"^.*/", ""), r"\.log$", "")
    parts = F.split(base, "_")
    last = F.get(parts, F.lit(2))
    df = df.select("*", F.get(parts, F.lit(0)).alias("pod"), F.get(parts, F.lit(1)).alias("namespace"),
                   F.regexp_extract(last, r"^(.*)-[^-]*$", 1).alias("container_name"), F.regexp_extract(last, r"-([^-]*)$", 1).alias("container_id"))
    return with_error(df, F.size(parts) < 3, "k8stag", key, "fewer than three parts")
