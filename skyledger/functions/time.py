"""Column functions over instants, climate days (fixed UTC-5) and printed clocks.

Days are DATE columns, instants TIMESTAMP columns or epoch seconds, as named; the session time zone
plays no part where epoch seconds go in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = 5 * 3600
DAY = 86400
NEW_YORK = "America/New_York"
#: Month names as printed, in order.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def month_number(name: Column) -> Column:
    """1 to 12 of a month's first three letters, else null."""
    found = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(F.substring(name, 1, 3)))
    return F.when(found > 0, found.cast("int"))


def day_number(date: Column) -> Column:
    return F.unix_date(date)


def climate_day(epoch: Column) -> Column:
    """The day number that holds an instant."""
    return F.floor((epoch - OFFSET) / DAY).cast("long")


def day_start(day: Column) -> Column:
    return day * DAY + OFFSET


def day_end(day: Column) -> Column:
    return day * DAY + OFFSET + DAY


def ticker_date(ticker: Column) -> Column:
    """The date in a ticker's `-YYMONDD-`, else null."""
    pattern = r"-(\d{2})([A-Z]{3})(\d{2})-"
    year = F.lit(2000) + F.regexp_extract(ticker, pattern, 1).try_cast("int")
    return F.try_to_date(F.format_string("%04d-%02d-%s", year, month_number(F.regexp_extract(ticker, pattern, 2)), F.regexp_extract(ticker, pattern, 3)), "yyyy-MM-dd")


def era(date: Column, last_early: int = 2021) -> Column:
    return F.when(F.year(date) <= last_early, f"{last_early}_early").when(date.isNotNull(), f"{last_early + 1}_plus")


def season(date: Column) -> Column:
    m = F.month(date)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").when(m.isNotNull(), "SON")


def iso_epoch(text: Column) -> Column:
    """Epoch seconds of an ISO instant with Z, an offset, or none (then UTC); else null."""
    plain = F.regexp_replace(F.trim(text), r"Z$", "+00:00")
    zoned = F.when(plain.rlike(r"[+-]\d{2}:\d{2}$") & plain.rlike("T"), plain).otherwise(F.concat(plain, F.lit("+00:00")))
    return F.unix_seconds(zoned.try_cast("timestamp"))


def civil_offset(epoch: Column) -> Column:
    """Seconds that New York's clock is ahead of UTC at an instant (negative).

    Both conversions go through UTC by name, so the session's time zone falls out.
    """
    at = F.timestamp_seconds(epoch)
    return F.unix_seconds(F.from_utc_timestamp(at, NEW_YORK)) - F.unix_seconds(at)


def dst_status(day: Column) -> Column:
    """edt, est, or transition where the offset changes within the climate day."""
    start, end, noon = (civil_offset(x) for x in (day_start(day), day_end(day), day_start(day) + DAY // 2))
    return F.when(start != end, "transition").when(noon != -OFFSET, "edt").when(day.isNotNull(), "est")


def clock_of(epoch: Column) -> Column:
    """HH:MM of epoch seconds as they are."""
    minutes = F.pmod(F.floor(epoch / 60), F.lit(1440)).cast("int")
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), minutes % 60)


def close_rule(close: Column, last: str = "23:59") -> Column:
    """Which last-trading-time rule a close is in keeping with."""
    civil, fixed = clock_of(close + civil_offset(close)) == last, clock_of(close - OFFSET) == last
    named = F.when(civil & fixed, "both (EST, not identifying)").when(civil, "civil_et_2359").when(fixed, "lst_2359_fixed_utc")
    return F.when(close.isNull(), "other").otherwise(F.coalesce(named, F.concat(F.lit("other ("), clock_of(close - OFFSET), F.lit(" LST)"))))


def clock_minutes(raw: Column) -> Column:
    """Minutes of the day of a printed clock such as `455 PM` or `4:55 PM`, without a zone; else null."""
    text = F.trim(F.regexp_replace(F.upper(F.regexp_replace(raw, ":", "")), r"\s+", " "))
    pattern = r"^(\d+) (AM|PM)( |$)"
    digits, half = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    value = digits.try_cast("int")
    hour = F.when(F.length(digits) <= 2, value).otherwise(F.floor(value / 100))
    minute = F.when(F.length(digits) <= 2, 0).otherwise(value % 100)
    return (hour % 12 * 60 + minute + F.when(half == "PM", 720).otherwise(0)).cast("int")


def clock_instant(day: Column, minutes: Column, convention: str) -> Column:
    """Epoch seconds of a printed clock on a climate date, under the fixed (lst) or the civil (ldt) reading."""
    if convention == "lst":
        return day_start(day) + minutes * 60
    naive = F.timestamp_seconds(day * DAY + minutes * 60)
    return F.unix_seconds(F.to_utc_timestamp(naive, NEW_YORK))


def maximum_instant(day: Column, time_raw: Column, convention: str = "unknown") -> Column:
    """Epoch seconds of a label's printed time of the maximum; of an unknown convention the fixed reading."""
    return clock_instant(day, clock_minutes(time_raw), "lst" if convention == "unknown" else convention)


def regime_at(snapshot: Column, at: Column, convention: str = "unknown") -> tuple[Column, Column]:
    """pre_max or post_max at a snapshot, and whether that is uncertain, from the instant of the maximum."""
    name = F.when(at.isNotNull(), F.when(snapshot < at, "pre_max").otherwise("post_max"))
    unsure = F.abs(snapshot - at) <= 3600 if convention == "unknown" else F.lit(False)
    return name, F.when(at.isNull(), True).otherwise(unsure)


def regime(snapshot: Column, day: Column, time_raw: Column, convention: str = "unknown") -> tuple[Column, Column]:
    """`regime_at` with the printed time; for many snapshots of one label work out the instant once, before they meet."""
    return regime_at(snapshot, maximum_instant(day, time_raw, convention), convention)


def issuance_epoch(header: Column) -> Column:
    """Epoch seconds of `220 AM EDT SUN JUL 05 2026`; the printed zone is New York's civil time."""
    text = F.trim(F.regexp_replace(F.upper(header), r"\s+", " "))
    pattern = r"^(\S+) (AM|PM) (\S+) (\S+) (\S+) (\d+) (\d+)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    minutes = clock_minutes(F.concat(F.regexp_replace(part(1), r"\D", ""), F.lit(" "), part(2)))
    day = F.unix_date(F.try_to_date(F.format_string("%s-%02d-%s", part(7), month_number(part(5)), F.lpad(part(6), 2, "0")), "yyyy-MM-dd"))
    return clock_instant(day, minutes, "ldt")


def max_window(day: Column) -> tuple[Column, Column]:
    """The forecast's window for a day's maximum: 12Z to 06Z of the next day."""
    return day * DAY + 12 * 3600, day * DAY + 30 * 3600


def within(at: Column, start: Column, end: Column) -> Column:
    return (at >= start) & (at < end)


def minutes_between(nominal: Column, seen: Column) -> Column:
    return (seen - nominal) / 60.0


def http_date_epoch(text: Column) -> Column:
    """Epoch seconds of `Tue, 05 Mar 2024 10:20:30 GMT`; else null."""
    pattern = r"(\d{1,2}) (\w{3}) (\d{4}) (\d{2}:\d{2}:\d{2})"
    stamp = F.format_string("%s-%02d-%sT%s+00:00", F.regexp_extract(text, pattern, 3), month_number(F.regexp_extract(text, pattern, 2)), F.lpad(F.regexp_extract(text, pattern, 1), 2, "0"), F.regexp_extract(text, pattern, 4))
    return F.unix_seconds(stamp.try_cast("timestamp"))


def date_text(day: Column) -> Column:
    return F.date_from_unix_date(day.cast("int")).cast("string")
