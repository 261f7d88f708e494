"""Dates in many layouts, and epochs of any precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_CLOCK = r"\d\d:\d\d:\d\d(?:[.,]\d{1,9})?"
_ZONE = r"(?:Z|[+-]\d\d:?\d\d)"
#: Texts that need no layout: year, month and day with - or /, maybe a clock with a fraction, maybe a zone.
_ISO = rf"^\d{{4}}([-/])\d\d\1\d\d(?:[T ]{_CLOCK})?(?: ?{_ZONE})?$"
#: The other layouts, each by the shape of its texts; weekdays are gone and named zones are offsets by then.
SHAPES = [
    (r"^\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4}$", "dd/MMM/yyyy:HH:mm:ss xx"),
    (r"^\d{8}T\d{6}[+-]\d\d$", "yyyyMMdd'T'HHmmssx"),
    (r"^\d{4}/\d\d/\d\d/\d\d/\d\d/\d\d$", "yyyy/MM/dd/HH/mm/ss"),
    (r"^\d\d/\d\d/\d{4}--\d\d:\d\d:\d\d$", "dd/MM/yyyy--HH:mm:ss"),
    (r"^\d\d/\d\d/\d{4}$", "dd/MM/yyyy"),
    (r"^\d\d? [A-Z][a-z]{2} \d\d \d\d:\d\d$", "d MMM yy HH:mm"),
    (r"^\d\d? [A-Z][a-z]{2} \d\d \d\d:\d\d [+-]\d{4}$", "d MMM yy HH:mm xx"),
    (r"^\d\d?-[A-Z][a-z]{2}-\d\d \d\d:\d\d:\d\d [+-]\d{4}$", "d-MMM-yy HH:mm:ss xx"),
    (r"^\d\d? [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [+-]\d{4}$", "d MMM yyyy HH:mm:ss xx"),
    (r"^\d\d? [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d$", "d MMM yyyy HH:mm:ss"),
    (r"^[A-Z][a-z]{2} \d\d? \d\d:\d\d:\d\d \d{4}$", "MMM d HH:mm:ss yyyy"),
    (r"^[A-Z][a-z]{2} \d\d? \d\d:\d\d:\d\d [+-]\d{4} \d{4}$", "MMM d HH:mm:ss xx yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
]
_STAMP = r"^([A-Z][a-z]{2}) (\d\d?) (\d\d:\d\d:\d\d(?:\.\d{1,9})?)$"
_KITCHEN = r"^(\d\d?):(\d\d)([AP])M$"


def cleaned(c: Column) -> Column:
    """Text without a weekday name, with single spaces, and with a named zone as an offset (its name alone is taken as
    UTC; behind an offset it says nothing)."""
    text = F.trim(c)
    text = F.when(F.regexp_like(text, F.lit("^[MTWFS][a-z]")), F.regexp_replace(text, r"^(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun)(?:day)?,?\s+", "")).otherwise(text)
    text = F.when(text.contains("  ") | text.contains("\t"), F.regexp_replace(text, r"\s+", " ")).otherwise(text)
    named = F.regexp_replace(F.regexp_replace(text, r"([+-]\d{4}) [A-Z]{3,4}\b", "$1"), r" [A-Z]{3,4}\b", " +0000")
    return F.when(F.regexp_like(text, F.lit(" [A-Z]{3}")), named).otherwise(text)


def from_epoch(c: Column) -> Column:
    """Timestamp of a whole number: seconds, milli-, micro- or nanoseconds by its number of digits."""
    digits = F.trim(c.cast("string"))
    micros = F.substring(F.rpad(digits, 16, "0"), 1, 16).try_cast("bigint")
    return F.when(F.regexp_like(digits, F.lit(r"^\d{9,19}$")), F.timestamp_micros(F.when(F.length(digits) == 9, digits.try_cast("bigint") * 1_000_000).otherwise(micros)))


def _iso(text: Column) -> Column:
    """Timestamp of a text of the shape _ISO; a day with a zone and no clock begins at midnight."""
    iso = F.translate(text, "/,", "-.")
    short = F.length(iso).between(11, 17) & F.regexp_like(iso, F.lit(rf"^.{{10}} ?{_ZONE}$"))
    midnight = F.concat(F.substring(iso, 1, 10), F.lit(" 00:00:00"), F.trim(F.substring(iso, F.lit(11), F.length(iso))))
    return F.when(short, midnight).otherwise(iso).try_cast("timestamp")


def _built_in(text: Column) -> Column:
    """Timestamp of a cleaned text; the layout is chosen by its shape, so that no other is tried."""
    out = F.when(F.regexp_like(text, F.lit(_ISO)), _iso(text))
    for shape, layout in SHAPES:
        at = F.try_to_timestamp(text, F.lit(layout))
        if " yy " in f" {layout} " or "-yy " in layout:  # 69 to 99 lie in the century before
            at = F.when(F.year(at) >= 2069, F.add_months(at, -1200).cast("timestamp") + (at - F.date_trunc("day", at))).otherwise(at)
        out = out.when(F.regexp_like(text, F.lit(shape)), at)
    # Without a year it is the year 0, for Spark the year before 1.
    month = F.lpad(((F.instr(F.lit(_MONTHS), F.regexp_extract(text, _STAMP, 1)) + 2) / 3).cast("int").cast("string"), 2, "0")
    stamp = F.concat(F.lit("0000-"), month, F.lit("-"), F.lpad(F.regexp_extract(text, _STAMP, 2), 2, "0"), F.lit(" "), F.regexp_extract(text, _STAMP, 3))
    hour = F.regexp_extract(text, _KITCHEN, 1).try_cast("int") % 12 + F.when(F.regexp_extract(text, _KITCHEN, 3) == "P", 12).otherwise(0)
    kitchen = F.concat(F.lit("0000-01-01 "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract(text, _KITCHEN, 2), F.lit(":00"))
    out = out.when(F.regexp_like(text, F.lit(_STAMP)), stamp.try_cast("timestamp"))
    return out.when(F.regexp_like(text, F.lit(_KITCHEN)), kitchen.try_cast("timestamp"))


def parsed(c: Column, layouts: list[str] | None = None, offset_hours: int = 0) -> Column:
    """Timestamp of a number or text; own layouts come before the built-in ones. Null if none fits."""

    def one(text: Column) -> Column:
        return F.coalesce(from_epoch(text), *[F.try_to_timestamp(text, F.lit(p)) for p in layouts or []], _built_in(text))

    text = c.cast("string")
    out = F.element_at(F.transform(F.array(cleaned(text)), one), 1)
    if not layouts:  # most texts have the first shape as they are
        out = F.when(F.regexp_like(text, F.lit(_ISO)), _iso(text)).otherwise(out)
    return out + F.make_dt_interval(hours=F.lit(offset_hours)) if offset_hours else out


def reformatted(c: Column, before: list[str] | None = None, after: str = "yyyy-MM-dd'T'HH:mm:ss'Z'", offset_hours: int = 0) -> Column:
    return F.date_format(parsed(c, before, offset_hours), after)


def epoch(c: Column, precision: str = "s", offset_hours: int = 0) -> Column:
    """Epoch of a date text in s, ms, us or ns (nanoseconds are microseconds times 1000)."""
    t = parsed(c, None, offset_hours)
    return {"s": F.unix_seconds(t), "ms": F.unix_millis(t), "us": F.unix_micros(t), "ns": F.unix_micros(t) * 1000}[precision]


def with_year(c: Column, layout: str, reference_date: str) -> Column:
    """Text without a year, in the reference date's year, or the one before if that lies ahead of it."""
    ref = F.lit(reference_date).cast("date")
    at = F.try_to_timestamp(F.concat(F.year(ref).cast("string"), F.lit(" "), cleaned(c)), F.lit(f"yyyy {layout}"))
    return F.when(at.cast("date") > ref, F.add_months(at, -12).cast("timestamp") + (at - F.date_trunc("day", at))).otherwise(at)


def in_time_of_day(t: Column, begin: str, end: str) -> Column:
    """Whether the clock time lies in hh:mm to hh:mm; the range may wrap around midnight."""
    clock = F.date_format(t, "HH:mm")
    return (clock >= begin) & (clock < end) if begin <= end else (clock >= begin) | (clock < end)
