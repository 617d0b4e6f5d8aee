"""Jobs over quotes, candles and books: spread, turnover, validation, depth and emission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import book, price, text, time
from skyledger.operators.ordered import asof_backward, changes, gaps, hot_spans, latest, parts_of, with_previous
from skyledger.operators.quantiles import counted_quantiles

HORIZONS = (48, 36, 24, 12, 6, 3, 1)
BANDS = (("10_90", 0.10, 0.90), ("20_80", 0.20, 0.80))
TURNOVER_BANDS = ("10_90", "tails", "all")


def deduplicated(pages: DataFrame, keys: tuple[str, ...] = ("ticker", "end_ts"), order: str = "pos") -> DataFrame:
    """Overlapping pages leave one row for each ticker and end, the last taken in."""
    return latest(pages, list(keys), [order]).select(*pages.columns)


def grid(markets: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Every market at every horizon before the end of its climate day."""
    return markets.withColumn("horizon_h", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("snap_ts", time.day_end(F.col("day")) - F.col("horizon_h") * 3600)


def snapshots(markets: DataFrame, candles: DataFrame, labels: DataFrame, convention: str = "unknown", horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """The census grain: the quote in force at each market and horizon, under both staleness rules."""
    quotes = candles.select("ticker", "end_ts", "bid", "ask", "volume")
    asked = grid(markets, horizons)
    rows = asof_backward(asked, quotes, ["ticker"], "snap_ts", "end_ts", every=hot_spans([(asked, "snap_ts"), (quotes, "end_ts")], ["ticker"]), parts=parts_of(quotes, 1 << 17))
    bid, ask, age = F.col("found.bid"), F.col("found.ask"), F.col("snap_ts") - F.col("found.end_ts")
    present = F.col("found").isNotNull()
    valid = F.coalesce(~price.stale(age), F.lit(False))
    date = F.date_from_unix_date(F.col("day").cast("int"))
    # The printed clock is parsed once a label; the snapshots only meet its instant.
    label = labels.select(F.col("day").alias("label_day"), time.maximum_instant(F.col("day"), F.coalesce("time_raw", F.lit("")), convention).alias("max_ts"))
    rows = rows.join(label, F.col("day") == F.col("label_day"), "left")
    name, unsure = time.regime_at(F.col("snap_ts"), F.col("max_ts"), convention)
    return rows.select(
        "ticker", "day", "climate_date", "horizon_h", "snap_ts",
        time.season(date).alias("season"), time.era(date).alias("era"),
        F.when(F.col("label_day").isNotNull(), name).alias("regime"),
        F.when(F.col("label_day").isNotNull(), unsure).otherwise(True).alias("regime_uncertain"),
        valid.alias("quote_valid"), (present & ~valid).alias("stale"),
        (valid & price.two_sided(bid, ask)).alias("two_sided"),
        (bid.isNotNull() & ask.isNotNull()).alias("book_present"),
        (valid & price.empty_book(bid, ask)).alias("extreme_empty_book"),
        price.in_window(F.col("snap_ts"), F.col("open_ts"), F.col("close_ts")).alias("in_window"),
        (F.col("open_ts").isNotNull() & F.col("close_ts").isNotNull()).alias("window_known"),
        present.alias("quote_present"), age.alias("quote_age"),
        (present & price.two_sided(bid, ask)).alias("two_sided_cf"),
        price.mid(bid, ask).alias("mid_cf"), price.spread(bid, ask).alias("spread_cf"),
        F.when(valid, price.mid(bid, ask)).alias("mid"), F.when(valid, price.spread(bid, ask)).alias("spread"),
        F.col("found.volume").alias("volume"),
    )


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


SPREAD_KEYS = ["horizon_h", "era", "season", "regime", "regime_uncertain", "band"]


def variant(tag: str, two: str, quote: str, of: Column | None = None) -> list[Column]:
    """The shares that exist once for each staleness rule; `of` restricts the rows."""
    keep = F.lit(True) if of is None else of
    only = lambda c, cond: F.when(keep & cond, c)
    return [
        F.coalesce(F.avg(only(F.col(two).cast("double"), F.lit(True))), F.lit(0.0)).alias(f"two_sided_share_{tag}"),
        F.coalesce(F.avg(only(F.col(two).cast("double"), F.col(quote))), F.lit(0.0)).alias(f"two_sided_share_given_quote_{tag}"),
        F.coalesce(F.avg(only(F.col(quote).cast("double"), F.col("in_window"))), F.lit(0.0)).alias(f"coverage_given_open_{tag}"),
    ]


SPREAD_QUANTILES = {"median_spread": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9}


def banded(rows: DataFrame, bands=BANDS) -> DataFrame:
    """The rows once for each band, with in-band flags under both staleness rules."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in bands]))
    rows = rows.withColumn("b", each).withColumn("band", F.col("b.band"))
    inside = lambda two, mid: F.col("in_window") & F.col(two) & F.coalesce(F.col(mid).between(F.col("b.lo"), F.col("b.hi")), F.lit(False))
    return rows.withColumns({"band_cf": inside("two_sided_cf", "mid_cf"), "band_15": inside("two_sided", "mid")})


def per_day_medians(rows: DataFrame, flags: dict[str, str], keys: list[str]) -> DataFrame:
    """Medians over days of the numbers of flagged rows, days without any included, with the days and market days.

    `flags` names a flag column for each result.  Rows are one for each ticker under the same keys, as those of
    `snapshots` are by horizon and band, so that market days are counted and no task holds the tickers.
    """
    daily = rows.groupBy(*keys, "day").agg(*[F.sum(F.col(flag).cast("long")).alias(name) for name, flag in flags.items()], F.count("ticker").alias("_markets"))
    return daily.groupBy(*keys).agg(*[F.percentile(name, F.lit(0.5)).alias(name) for name in flags], F.count("*").alias("n_days"), F.sum("_markets").alias("n_market_days"))


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    b = b.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in b.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        cond = c if cond is None else cond & c
    return a.join(b, cond, how).drop(*[f"_{k}" for k in keys])


def spread_census(rows: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Spread and coverage by horizon, era, season, regime and band, under each staleness rule; `excluded` has tickers.

    Rows are one for each ticker and horizon, as of `snapshots`.  They are read three times, so hand in a table that is written or cheap.
    """
    if excluded is not None:  # before the rows are there once for each band
        rows = rows.repartition(parts_of(rows, 1 << 20), "ticker").join(excluded.select("ticker", F.lit(True).alias("out")).distinct(), "ticker", "left").withColumn("out", F.coalesce("out", F.lit(False)))
    tagged = banded(rows)
    columns = [
        F.count("*").alias("n_snapshots"),
        share(F.col("quote_valid")).alias("coverage"), share(F.col("quote_present")).alias("coverage_carryforward"),
        share(~F.col("in_window")).alias("outside_window_share"), share(F.col("extreme_empty_book")).alias("empty_book_share"),
        F.sum(F.coalesce("volume", F.lit(0))).alias("volume_sum"),
        *variant("carryforward", "two_sided_cf", "quote_present"),
        *variant("strict15", "two_sided", "quote_valid"),
    ]
    # Quantiles of values on a grid (cents, seconds): a value of each row and rule, counted before they meet.
    spreads = {"carryforward": F.when(F.col("band_cf"), F.col("spread_cf")), "strict15": F.when(F.col("band_15"), F.col("spread"))}
    if excluded is not None:
        columns += variant("exclnoreconcile", "two_sided_cf", "quote_present", ~F.col("out"))
        spreads["exclnoreconcile"] = F.when(F.col("band_cf") & ~F.col("out"), F.col("spread_cf"))
    asked = {"age": (F.when(F.col("quote_present"), F.col("quote_age") / 60.0), {"age_median_min": 0.5, "age_p90_min": 0.9})}
    asked |= {tag: (x, {f"{n}_{tag}": p for n, p in SPREAD_QUANTILES.items()}) for tag, x in spreads.items()}
    found = counted_quantiles(tagged, SPREAD_KEYS, asked)
    found = found.drop("n_age").withColumnsRenamed({f"n_{tag}": f"n_spread_obs_{tag}" for tag in spreads})
    out = null_safe_join(tagged.groupBy(*SPREAD_KEYS).agg(*columns), found, SPREAD_KEYS).withColumns({f"n_spread_obs_{tag}": F.coalesce(f"n_spread_obs_{tag}", F.lit(0)) for tag in spreads})
    medians = per_day_medians(tagged, {"brackets_per_day_carryforward": "band_cf", "brackets_per_day_strict15": "band_15"}, SPREAD_KEYS)
    return null_safe_join(out, medians, SPREAD_KEYS)


def market_days(candles: DataFrame, markets: DataFrame, bands: tuple[str, ...] = TURNOVER_BANDS) -> DataFrame:
    """Turnover of each market and band: contracts, premium, active minutes and shares of the last hours.

    Markets without a traded candle keep a row for each band, with nulls for the shares.
    """
    info = markets.select(F.col("ticker").alias("t"), "open_ts", "close_ts")
    traded = candles.where(F.col("volume") > 0).join(info, F.col("ticker") == F.col("t")).where(price.in_window(F.col("end_ts"), F.col("open_ts"), F.col("close_ts")))
    traded = traded.withColumn("px", price.mid_or_trade(F.col("bid"), F.col("ask"), F.col("trade_close")))
    traded = traded.withColumn("hours", (F.col("close_ts") - F.col("end_ts")) / 3600.0)
    traded = traded.withColumn("band", F.explode(F.array_compact(F.array(price.region(F.col("px")), F.lit("all")))))
    late = [F.sum(F.when(F.col("hours") <= h, F.col("volume")).otherwise(0)).alias(f"late_{h}") for h in (1, 3, 6)]
    sums = traded.groupBy("ticker", "band").agg(F.sum("volume").alias("contracts"), F.sum(F.col("volume") * F.col("px")).alias("premium"), F.count("*").alias("active"), *late)
    spine = markets.select("ticker", "day", "climate_date").withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))
    date = F.date_from_unix_date(F.col("day").cast("int"))
    total = F.when(F.col("contracts") > 0, F.col("contracts"))
    return spine.join(sums, ["ticker", "band"], "left").select(
        "ticker", "day", "climate_date", time.season(date).alias("season"), time.era(date).alias("era"), "band",
        F.coalesce("contracts", F.lit(0)).alias("contracts_traded"), F.coalesce("premium", F.lit(0.0)).alias("premium_traded"), F.coalesce("active", F.lit(0)).alias("active_minutes"),
        *[(F.col(f"late_{h}") / total).alias(f"share_last_{h}h") for h in (1, 3, 6)],
    )


def concentration(days: DataFrame) -> DataFrame:
    """Of each climate day the brackets with volume in the middle band, and the top one's share."""
    own = days.where((F.col("band") == "10_90") & (F.col("contracts_traded") > 0)).groupBy("climate_date", "ticker").agg(F.sum("contracts_traded").alias("v"))
    return own.groupBy("climate_date").agg(F.count("*").alias("n_brackets_with_volume"), (F.max("v") / F.sum("v")).alias("top_bracket_share"))


def climate_days(days: DataFrame) -> DataFrame:
    rows = days.groupBy("climate_date", "season", "era", "band").agg(
        F.sum("premium_traded").alias("premium_day"), F.sum("contracts_traded").alias("contracts_day"), F.countDistinct("ticker").alias("n_brackets"),
        *[F.avg(f"share_last_{h}h").alias(f"share_last_{h}h") for h in (1, 3, 6)],
    )
    return rows.join(concentration(days), "climate_date", "left").withColumn("n_brackets_with_volume", F.coalesce("n_brackets_with_volume", F.lit(0)))


def quartiles(column: str, name: str) -> dict[str, tuple[Column, dict[str, float]]]:
    return {column: (F.col(column), {f"{tag}_{name}": p for tag, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))})}


def turnover_census(days: DataFrame, by_day: DataFrame) -> DataFrame:
    """Turnover by era, season and band, a market day and a climate day; quantiles from counted values.

    Both inputs are read twice, so hand in tables that are written or cheap.
    """
    keys = ["era", "season", "band"]
    shares = {f"share_last_{h}h": (F.col(f"share_last_{h}h"), {f"median_share_last_{h}h": 0.5}) for h in (1, 3, 6)}
    found = counted_quantiles(days, keys, quartiles("contracts_traded", "contracts_market_day") | quartiles("premium_traded", "premium_market_day") | shares)
    a = days.groupBy(*keys).agg(F.count("*").alias("n_market_days"), share(F.col("contracts_traded") <= 0).alias("zero_volume_frac"))
    a = null_safe_join(a, found.drop(*[c for c in found.columns if c.startswith("n_")]), keys)
    middle = by_day.withColumns({c: F.when(F.col("band") == "10_90", F.col(c)) for c in ("top_bracket_share", "n_brackets_with_volume")})
    premium, names = quartiles("premium_day", "premium_climate_day")["premium_day"]
    asked = quartiles("contracts_day", "contracts_climate_day") | {"premium_day": (premium, names | {f"climate_day_premium_p{int(p * 100)}": p for p in (0.1, 0.9)})}
    found = counted_quantiles(middle, keys, asked | quartiles("n_brackets_with_volume", "brackets_with_volume") | quartiles("top_bracket_share", "top_bracket_share"))
    b = middle.groupBy(*keys).agg(F.countDistinct("climate_date").alias("n_climate_days"))
    b = null_safe_join(b, found.drop(*[f"n_{c}" for c in (*asked, "n_brackets_with_volume", "top_bracket_share")]), keys)
    return a.join(b, keys, "full_outer")


def time_to_close(candles: DataFrame, markets: DataFrame, since: str = "2022-01-01") -> DataFrame:
    """Volume in the middle band by hours to close, and its share."""
    info = markets.where(F.col("climate_date") >= since).select(F.col("ticker").alias("t"), "open_ts", "close_ts")
    rows = candles.where(F.col("volume") > 0).join(info, F.col("ticker") == F.col("t")).where(F.col("close_ts").isNotNull() & price.in_window(F.col("end_ts"), F.col("open_ts"), F.col("close_ts")))
    rows = rows.where(price.region(price.mid_or_trade(F.col("bid"), F.col("ask"), F.col("trade_close"))) == "10_90")
    sums = rows.groupBy(price.hours_bucket((F.col("close_ts") - F.col("end_ts")) / 3600.0).alias("bucket")).agg(F.sum("volume").alias("volume"))
    return sums.withColumn("volume_share", F.col("volume") / F.sum("volume").over(Window.partitionBy(F.lit(0))))  # seven rows


def region_shares(by_day: DataFrame) -> DataFrame:
    """Volume of the middle band and the tails of each day, nulls as none, and the middle's share."""
    part = lambda band, name: by_day.where(F.col("band") == band).select("climate_date", F.col("contracts_day").alias(name))
    both = part("10_90", "mid_volume").join(part("tails", "tail_volume"), "climate_date", "full_outer").fillna(0, ["mid_volume", "tail_volume"])
    total = F.col("mid_volume") + F.col("tail_volume")
    return both.withColumn("mid_share", F.when(total != 0, F.col("mid_volume") / total))


def gap_distribution(candles: DataFrame) -> DataFrame:
    rows = gaps(candles, ["tier", "ticker"], "end_ts", hot_spans([(candles, "end_ts")], ["tier", "ticker"]))
    out = rows.groupBy("tier").agg(
        F.countDistinct("ticker").alias("n_markets"), F.count("*").alias("n_candles"), F.count("gap").alias("n_gaps"),
        share(F.col("gap") > 60).alias("share_over_period"), share(F.col("gap") > price.STALE_SECONDS).alias("share_over_15min"),
    )
    counts = rows.where("gap is not null").groupBy("tier", "gap").agg(F.count("*").alias("n"))  # a row for each length
    modal = counts.groupBy("tier").agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("modal_gap"))
    found = counted_quantiles(rows, ["tier"], {"gap": (F.col("gap"), {"median_gap": 0.5, "p90_gap": 0.9})}).drop("n_gap")
    return null_safe_join(null_safe_join(out, modal, ["tier"]), found, ["tier"])


def agreement(rows: DataFrame) -> DataFrame:
    out = rows.where("in_window").groupBy("horizon_h").agg(F.count("*").alias("n_snapshots"), share(F.col("quote_valid")).alias("coverage_strict15"), share(F.col("quote_present")).alias("coverage_carryforward"))
    return out.withColumn("abs_difference", F.abs(F.col("coverage_carryforward") - F.col("coverage_strict15")))


def reconciliation(markets: DataFrame, candles: DataFrame) -> DataFrame:
    """Of each market the candles' volume against the declared one; the live tier where a market is in both."""
    sums = candles.groupBy("ticker", "tier").agg(F.sum("volume").alias("s"), F.max("volume").alias("m"))
    one = sums.groupBy("ticker").agg(F.min_by(F.struct("tier", "s", "m"), F.when(F.col("tier") == "live", 0).otherwise(1)).alias("x"))
    rows = markets.where("market_volume is not null").join(one, "ticker").select("ticker", F.col("x.tier").alias("tier"), "market_volume", F.coalesce("x.s", F.lit(0)).alias("candle_sum"), F.coalesce("x.m", F.lit(0)).alias("candle_max"))
    return rows.withColumns({
        "difference": F.col("candle_sum") - F.col("market_volume"),
        "sum_matches": price.same_quantity(F.col("candle_sum"), F.col("market_volume")),
        "max_matches": price.same_quantity(F.col("candle_max"), F.col("market_volume")),
    })


def emptying(candles: DataFrame) -> DataFrame:
    """Candles with their book emptied right after a two-sided one: is_empty and transition flags."""
    two = price.two_sided(F.col("bid"), F.col("ask"))
    rows = with_previous(candles.withColumn("two", two), ["ticker"], ["end_ts"], ["two"], every=hot_spans([(candles, "end_ts")], ["ticker"]))
    empty = ~F.col("two") & F.col("bid").isNotNull()
    return rows.withColumns({"is_empty": empty, "transition": empty & F.coalesce("prev_two", F.lit(False))})


def emptying_events(candles: DataFrame) -> DataFrame:
    return emptying(candles).groupBy("ticker").agg(F.count("*").alias("n_candles"), F.count_if("is_empty").alias("n_empty"), F.count_if("transition").alias("n_to_empty"))


def emptying_samples(candles: DataFrame, tickers: int = 3, rows: int = 5) -> DataFrame:
    """The first tickers with transitions, and the first transitions of each."""
    found = emptying(candles).where("transition").withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy("end_ts"))).where(F.col("rn") <= rows)
    first = found.select("ticker").distinct().orderBy("ticker").limit(tickers)
    return found.join(first, "ticker", "left_semi").select("ticker", "end_ts", "bid", "ask", "rn")


def tops(books: DataFrame) -> DataFrame:
    """Book captures (arrays yes and no of string pairs) with sorted levels, best bid and best ask."""
    # From a generator, so that filters on what comes of the levels don't read and sort them once more.
    typed = F.struct(book.levels(F.col("yes")).alias("bids"), book.levels(F.col("no")).alias("nos"))
    rows = books.select("*", F.inline(F.array(typed))).withColumn("asks", book.asks(F.col("nos")))
    return rows.withColumns({"bid": book.best(F.col("bids")), "ask": book.best(F.col("asks"))})


def two_sides(books: DataFrame) -> DataFrame:
    """The captures that have a readable level on both sides."""
    return books.where(book.any_level(F.col("yes")) & book.any_level(F.col("no")))


def depth_metrics(books: DataFrame) -> DataFrame:
    """All depth measures of captures with both sides; others are left out.

    Sums are taken in whole units, and in decimals for books whose sums a long may not hold.
    """
    rows = tops(books).where((F.size("bids") > 0) & (F.size("nos") > 0)).withColumn("mid", ((F.col("bid") + F.col("ask")) / 2).cast("decimal(10,6)"))
    rows = rows.withColumns({"_yes": book.units(F.col("bids")), "_no": book.units(F.col("nos"))})
    rows = rows.withColumn("_twice", F.when(F.col("_yes").isNotNull() & F.col("_no").isNotNull(), F.col("_yes")[0]["p"] + 10_000 - F.col("_no")[0]["p"]))
    either = lambda quick, exact: F.when(F.col("_twice").isNotNull(), quick).otherwise(exact)
    sizes = {f"{side}_size_{n}": either(book.size_at_units(F.col(u), n), book.size_at(F.col(a), n)) for side, a, u in (("yes", "bids", "_yes"), ("no", "nos", "_no")) for n in (1, 2, 3, 5)}
    depth = {
        f"{'dollar_' if d else ''}depth_{c}c": either(book.depth_units(F.col("_twice"), F.col("_yes"), F.col("_no"), c, d), book.depth(F.col("mid"), F.col("bids"), F.col("asks"), c, d))
        for c in (1, 2, 3, 5) for d in (False, True)
    }
    dollars = {f"dollar_{side}_5": either(book.dollars_at_units(F.col(u), 5), book.dollars_at(F.col(a), 5)) for side, a, u in (("yes", "bids", "_yes"), ("no", "nos", "_no"))}
    more = {"imbalance": price.imbalance(F.col("bids")[0]["size"], F.col("asks")[0]["size"]).cast("double")}
    return rows.withColumns(sizes | depth | dollars | more).drop("yes", "no", "bids", "nos", "asks", "_yes", "_no", "_twice")


def depth_census(books: DataFrame, markets: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """The book in force at each horizon, with its depth, age, week and band flags.

    `books` has one capture a ticker and time; of several, leave one with both sides (`two_sides` before `latest`).  The lookup goes over the times of captures with both sides alone; only
    the books that it finds are fetched and measured, once each.  The captures are read twice, so hand in a table
    that is written or cheap.
    """
    asked = grid(markets, horizons)
    sided = two_sides(books).select("ticker", "end_ts")
    rows = asof_backward(asked, sided, ["ticker"], "snap_ts", "end_ts", every=hot_spans([(asked, "snap_ts"), (sided, "end_ts")], ["ticker"])).where("found is not null")
    used = rows.select("ticker", "found.end_ts").distinct()
    measured = depth_metrics(books.join(used, ["ticker", "end_ts"], "left_semi"))
    measured = measured.select(F.col("ticker").alias("of"), F.col("end_ts").alias("seen_ts"), F.struct(*[c for c in measured.columns if c not in ("ticker", "day")]).alias("book"))
    rows = rows.join(measured, (F.col("ticker") == F.col("of")) & (F.col("found.end_ts") == F.col("seen_ts"))).withColumn("found", F.col("book")).drop("of", "seen_ts", "book")
    bid, ask, mid = F.col("found.bid").cast("double"), F.col("found.ask").cast("double"), F.col("found.mid").cast("double")
    two = price.two_sided(bid, ask)
    at = F.date_from_unix_date(F.floor(F.col("found.end_ts") / 86400).cast("int"))
    return rows.select(
        "ticker", "climate_date", "horizon_h", "snap_ts", F.col("found.end_ts").alias("capture_ts"), (F.col("snap_ts") - F.col("found.end_ts")).alias("age_sec"),
        F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), at), F.weekofyear(at)).alias("capture_week"),
        price.in_window(F.col("snap_ts"), F.col("open_ts"), F.col("close_ts")).alias("in_window"), two.alias("two_sided"), (two & mid.between(0.1, 0.9)).alias("in_band"),
        bid.alias("bid"), ask.alias("ask"), mid.alias("mid"), F.col("found.imbalance").alias("imbalance"),
        *[F.col(f"found.{c}").cast("double").alias(c) for c in ("yes_size_1", "yes_size_5", "no_size_1", "no_size_5", *(f"{d}depth_{c}c" for c in (1, 2, 3, 5) for d in ("", "dollar_")))],
    )


def depth_medians(rows: DataFrame, by: str) -> DataFrame:
    asked = {c: (F.col(c), {f"median_{c}": 0.5}) for c in ("depth_2c", "dollar_depth_2c")}
    return counted_quantiles(rows.where("in_band and in_window"), [by], asked).select(by, F.col("n_depth_2c").alias("n"), "median_depth_2c", "median_dollar_depth_2c")


def forward_check(candles: DataFrame, captures: DataFrame) -> DataFrame:
    """Candles on a minute, within a ticker's captures, against the book carried to that minute."""
    span = captures.groupBy("ticker").agg(F.min("end_ts").alias("from_ts"), F.max("end_ts").alias("to_ts"))
    rows = candles.where(F.col("end_ts") % 60 == 0).join(span, "ticker").where(F.col("end_ts").between(F.col("from_ts") - 60, F.col("to_ts") + 60)).select("ticker", "end_ts", F.col("bid").alias("candle_bid"), F.col("ask").alias("candle_ask"))
    own = captures.select("ticker", "end_ts", "bid", "ask")
    found = asof_backward(rows, own, ["ticker"], "end_ts", "end_ts", every=hot_spans([(candles, "end_ts"), (own, "end_ts")], ["ticker"]))
    found = found.where("found.bid is not null or found.ask is not null")
    return found.withColumn("matched", price.price_match(F.col("found.bid"), F.col("candle_bid")) & price.price_match(F.col("found.ask"), F.col("candle_ask")))


def silent_changes(captures: DataFrame, candles: DataFrame, align: str = "floor") -> DataFrame:
    """Book changes at whose minute no candle ended; the minute is the one begun, or with `ceil` the one to come."""
    rows = changes(captures, ["ticker"], ["end_ts"], ["bid", "ask"], hot_spans([(captures, "end_ts")], ["ticker"]))
    minute = F.floor(F.col("end_ts") / 60) * 60 if align == "floor" else F.ceil(F.col("end_ts") / 60) * 60
    ends = candles.select("ticker", F.col("end_ts").alias("minute")).distinct()
    return rows.withColumn("minute", minute.cast("long")).join(ends, ["ticker", "minute"], "left_anti")


def endpoint_columns(df: DataFrame) -> DataFrame:
    """Ticker and tier of captured candle pages, from the payload or else the request's path."""
    return df.withColumns({"ticker": F.coalesce(F.when(F.col("payload_ticker") != "", F.col("payload_ticker")), text.endpoint_ticker(F.col("endpoint"))), "tier": price.tier(F.col("endpoint"))})
