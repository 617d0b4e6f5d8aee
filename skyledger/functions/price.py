"""Column functions over quotes, prices and volumes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_BID, MAX_ASK = 0.01, 0.99
STALE_SECONDS = 900
MID_LO, MID_HI = 0.10, 0.90


def number(c: Column) -> Column:
    """A lenient cast: what is no finite number is null."""
    v = c.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def first_key(*fields: Column) -> Column:
    """The first of several names of one field."""
    return F.coalesce(*fields)


def two_sided(bid: Column, ask: Column) -> Column:
    return F.coalesce((bid >= MIN_BID) & (ask <= MAX_ASK), F.lit(False))


def mid(bid: Column, ask: Column) -> Column:
    return F.when(two_sided(bid, ask), (bid + ask) / 2)


def spread(bid: Column, ask: Column) -> Column:
    return F.when(two_sided(bid, ask), ask - bid)


def mid_or_trade(bid: Column, ask: Column, trade: Column) -> Column:
    return F.coalesce(mid(bid, ask), trade)


def empty_book(bid: Column, ask: Column) -> Column:
    """Both quotes are there, but outside the bounds of a real book."""
    return F.coalesce(bid.isNotNull() & ask.isNotNull(), F.lit(False)) & ~two_sided(bid, ask)


def stale(age: Column, seconds: int = STALE_SECONDS) -> Column:
    return age > seconds


def in_window(at: Column, open_: Column, close: Column) -> Column:
    """Inclusive; an unknown bound is open."""
    return F.coalesce(at >= open_, F.lit(True)) & F.coalesce(at <= close, F.lit(True))


def region(price: Column) -> Column:
    return F.when(price.between(MID_LO, MID_HI), "10_90").when(price.isNotNull(), "tails")


def hours_bucket(hours: Column) -> Column:
    """Hours to close in seven buckets, closed on the right; unknown hours have none."""
    edges = (1, 3, 6, 12, 24, 48)
    out, low = None, 0
    for edge in edges:
        out = F.when(hours <= edge, f"{low}-{edge}h") if out is None else out.when(hours <= edge, f"{low}-{edge}h")
        low = edge
    return out.when(hours.isNotNull(), "48h+")


def tier(endpoint: Column) -> Column:
    return F.when(F.coalesce(endpoint.contains("/historical/"), F.lit(False)), "historical").otherwise("live")


def same_quantity(a: Column, b: Column) -> Column:
    """Equality at hundredths."""
    return a.cast("decimal(18,2)") == b.cast("decimal(18,2)")


def price_match(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def before_cutoff(settled: Column, close: Column, cutoff: Column) -> Column:
    """Whether a market is served by the historical tier."""
    return F.coalesce(F.coalesce(settled, close) < cutoff, F.lit(False))


def imbalance(bid_size: Column, ask_size: Column) -> Column:
    total = bid_size + ask_size
    return F.when(total > 0, (bid_size - ask_size) / total)
