"""Column functions over tickers, strikes, rule texts and inventory lines.

The patterns and the words they give are fixed values of the venues' and the forecast's formats.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BETWEEN = r"(?i)(\d+)\s*(?:°|deg)?\s*to\s*(\d+)\s*(?:°|deg)?"
_ABOVE = r"(?i)(\d+)\s*(?:°|deg)?\s*or\s*(?:above|higher)"
_BELOW = r"(?i)(\d+)\s*(?:°|deg)?\s*or\s*(?:below|lower)"
_LINE = r"^(\d+):(\d+):d=(\d{10}):TMP:2 m above ground:([^:]+):(.*)$"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def strike(kind: Column, floor: Column, cap: Column, label: Column) -> Column:
    """role, floor_f, cap_f, width_f and strike_source, from metadata or else the label; null if neither tells."""
    kind = F.lower(F.trim(kind))
    lo, hi = F.rint(floor.try_cast("double")).cast("int"), F.rint(cap.try_cast("double")).cast("int")
    none = F.lit(None).cast("int")

    def made(role: str, low: Column, high: Column, source: str) -> Column:
        width = high - low + 1 if role == "between" else none
        return F.struct(F.lit(role).alias("role"), low.alias("floor_f"), high.alias("cap_f"), width.alias("width_f"), F.lit(source).alias("strike_source"))

    part = lambda pattern, i: _int(F.regexp_extract(label, pattern, i))
    return (
        F.when((kind == "between") & lo.isNotNull() & hi.isNotNull(), made("between", lo, hi, "metadata"))
        .when((kind == "greater") & lo.isNotNull(), made("greater", lo, none, "metadata"))
        .when((kind == "less") & hi.isNotNull(), made("less", none, hi, "metadata"))
        .when(label.rlike(_BETWEEN), made("between", part(_BETWEEN, 1), part(_BETWEEN, 2), "subtitle"))
        .when(label.rlike(_ABOVE), made("greater", part(_ABOVE, 1), none, "subtitle"))
        .when(label.rlike(_BELOW), made("less", none, part(_BELOW, 1), "subtitle"))
    )


def label_text(*fields: Column) -> Column:
    """The first of several texts that is not blank, trimmed; else empty."""
    return F.coalesce(*[F.when(F.trim(f) != "", F.trim(f)) for f in fields], F.lit(""))


def suffix_class(ticker: Column) -> Column:
    suffix = F.upper(F.regexp_extract(ticker, r"(?i)-([TB][A-Z0-9.]+)$", 1))
    return F.when(suffix.startswith("T"), "T_tail").when(suffix.startswith("B") & suffix.endswith(".5"), "B_midpoint").when(suffix.startswith("B"), "B_other").otherwise("other")


def settlement_phrase(*texts: Column) -> Column:
    joined = F.trim(F.regexp_replace(F.concat_ws(" ", *texts), r"\s+", " "))
    found = F.upper(F.regexp_extract(joined, r"(?i)first\s+(.+?)\s+(?:ET\s+)?following", 1))
    return F.when(found != "", found).otherwise("unspecified (rulebook reference only)")


def venue_bracket(title: Column, question: Column) -> Column:
    """kind, low, high and label of a second-venue bracket: four patterns in order, over the title, then the question."""
    patterns = (
        ("tail_above", r"(?i)(\d+)\s*(?:°|º)?F?\s*or higher"),
        ("tail_below", r"(?i)(\d+)\s*(?:°|º)?F?\s*or below"),
        ("between", r"(?i)between\s+(\d+)\s*[-–]\s*(\d+)"),
        ("between", r"(?i)(\d+)\s*[-–]\s*(\d+)\s*(?:°|º)?F"),
    )
    none = F.lit(None).cast("int")
    title = F.coalesce(F.trim(title), F.lit(""))
    options = []
    for text in (title, question):
        for kind, pattern in patterns:
            one = _int(F.regexp_extract(text, pattern, 1))
            two = _int(F.regexp_extract(text, pattern, 2)) if kind == "between" else none
            low, high = {"tail_above": (one, none), "tail_below": (none, one), "between": (one, two)}[kind]
            name = {"tail_above": F.concat(one.cast("string"), F.lit("°F or higher")), "tail_below": F.concat(one.cast("string"), F.lit("°F or below")), "between": F.concat(one.cast("string"), F.lit("-"), two.cast("string"), F.lit("°F"))}[kind]
            options.append(F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), F.when(title != "", title).otherwise(name).alias("label"))))
    return F.coalesce(*options)


def first_token(raw: Column) -> Column:
    """The first id of a JSON list in a string; else null."""
    return F.from_json(raw, "array<string>")[0]


def inventory(line: Column) -> Column:
    """msg, byte_offset, cycle, window_stat, tail, start_h, end_h and level of an inventory line; null if it is none."""
    part = lambda i: F.regexp_extract(line, _LINE, i)
    window, tail = F.trim(part(4)), F.trim(part(5))
    hours = r"^(\d+)-(\d+) hour max fcst$"
    return F.when(
        line.rlike(_LINE),
        F.struct(
            part(1).try_cast("long").alias("msg"),
            part(2).try_cast("long").alias("byte_offset"),
            part(3).alias("cycle"),
            window.alias("window_stat"),
            tail.alias("tail"),
            _int(F.regexp_extract(window, hours, 1)).alias("start_h"),
            _int(F.regexp_extract(window, hours, 2)).alias("end_h"),
            _int(F.regexp_extract(tail, r"^P?(\d+)% level$", 1)).alias("level"),
        ),
    )


def cycle_epoch(tag: Column) -> Column:
    """Epoch seconds of `d=YYYYMMDDCC` or `YYYYMMDDCC`; else null."""
    text = F.regexp_replace(tag, "^d=", "")
    day = F.unix_date(F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))
    return day.cast("long") * 86400 + F.substring(text, 9, 2).try_cast("int") * 3600


def file_hour(name: Column) -> Column:
    return _int(F.regexp_extract(name, r"\.f(\d{3})\.", 1))


def endpoint_ticker(endpoint: Column) -> Column:
    """The path part after `markets`, unless that is `candlesticks`."""
    found = F.regexp_extract(endpoint, r"(?:^|/)markets/([^/]+)", 1)
    return F.when((found != "") & (found != "candlesticks"), found)
