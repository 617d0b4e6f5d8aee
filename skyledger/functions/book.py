"""Array functions over order books: arrays of (price, size), yes bids and no bids."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE, SIZE = "decimal(6,4)", "decimal(18,2)"


def _level(x: Column) -> tuple[Column, Column]:
    return F.try_element_at(x, F.lit(1)).try_cast(PRICE), F.try_element_at(x, F.lit(2)).try_cast(SIZE)


def any_level(raw: Column) -> Column:
    """Whether some level is readable; false for a null array."""
    good = lambda x: _level(x)[0].isNotNull() & _level(x)[1].isNotNull()
    return F.coalesce(F.exists(raw, good), F.lit(False))


def levels(raw: Column) -> Column:
    """Typed levels of [price, size] string pairs, malformed ones left out, highest price first."""
    typed = F.transform(raw, lambda x: F.struct(_level(x)[0].alias("price"), _level(x)[1].alias("size")))
    good = F.filter(F.coalesce(typed, F.array().cast(f"array<struct<price:{PRICE},size:{SIZE}>>")), lambda x: x["price"].isNotNull() & x["size"].isNotNull())
    return F.sort_array(good, asc=False)


def asks(no_levels: Column) -> Column:
    """Yes asks are one less the no bids; lowest first."""
    return F.sort_array(F.transform(no_levels, lambda x: F.struct((F.lit(1).cast(PRICE) - x["price"]).cast(PRICE).alias("price"), x["size"].alias("size"))))


def best(sorted_levels: Column) -> Column:
    return F.try_element_at(sorted_levels, F.lit(1))["price"]


def total(array: Column, value, zero: str = "decimal(38,6)") -> Column:
    return F.aggregate(array, F.lit(0).cast(zero), lambda acc, x: (acc + value(x)).cast(zero))


def size_at(sorted_levels: Column, n: int) -> Column:
    return total(F.slice(sorted_levels, 1, n), lambda x: x["size"])


def dollars_at(sorted_levels: Column, n: int) -> Column:
    return total(F.slice(sorted_levels, 1, n), lambda x: x["price"] * x["size"])


def depth(mid: Column, bids: Column, ask_levels: Column, cents: int, dollars: bool = False) -> Column:
    """Contracts, or dollars, resting within some cents of the middle on both sides."""
    reach = F.lit(cents).cast(PRICE) / 100
    value = (lambda x: x["price"] * x["size"]) if dollars else (lambda x: x["size"])
    return total(F.filter(bids, lambda x: x["price"] >= mid - reach), value) + total(F.filter(ask_levels, lambda x: x["price"] <= mid + reach), value)


def units(sorted_levels: Column) -> Column:
    """Levels as whole numbers, `p` ten-thousandths and `s` hundredths, whose sums are quick and exact in a long.

    Null where a price isn't from 0 to 1, a size isn't from 0 to 10^8 or there are over 10^4 levels: sums of those are left to decimals.
    """
    fits = (F.size(sorted_levels) <= 10_000) & F.forall(sorted_levels, lambda x: x["price"].between(0, 1) & x["size"].between(0, 10**8))
    return F.when(fits, F.transform(sorted_levels, lambda x: F.struct(F.rint(x["price"].cast("double") * 10_000).cast("long").alias("p"), F.rint(x["size"].cast("double") * 100).cast("long").alias("s"))))


def _sum(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + value(x))


def _decimal(sum_: Column, places: int) -> Column:
    return (sum_.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-places))).cast("decimal(38,6)")


def size_at_units(levels_: Column, n: int) -> Column:
    """As `size_at`, of `units`."""
    return _decimal(_sum(F.slice(levels_, 1, n), lambda x: x["s"]), 2)


def dollars_at_units(levels_: Column, n: int) -> Column:
    """As `dollars_at`, of `units`."""
    return _decimal(_sum(F.slice(levels_, 1, n), lambda x: x["p"] * x["s"]), 6)


def depth_units(twice_mid: Column, bids: Column, no_levels: Column, cents: int, dollars: bool = False) -> Column:
    """As `depth`, of `units` of yes bids and no bids; `twice_mid` in ten-thousandths."""
    near = lambda bound, value: lambda x: F.when(x["p"] * 2 >= bound, value(x)).otherwise(F.lit(0).cast("long"))
    bid = (lambda x: x["p"] * x["s"]) if dollars else (lambda x: x["s"])
    ask = (lambda x: (10_000 - x["p"]) * x["s"]) if dollars else (lambda x: x["s"])
    both = _sum(bids, near(twice_mid - 200 * cents, bid)) + _sum(no_levels, near(20_000 - twice_mid - 200 * cents, ask))
    return _decimal(both, 6 if dollars else 2)
