"""Jobs over market rules and ladders: close conventions, change points, bracket structure and its regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import text, time
from skyledger.operators.ordered import change_points, islands


def era_table(markets: DataFrame) -> DataFrame:
    """Of each market (ticker, day, close_ts and rule texts) the close's offset, rule and DST state, and the settlement wording."""
    return markets.where("day is not null and close_ts is not null").select(
        "ticker", "day",
        F.rint((time.day_end(F.col("day")) - F.col("close_ts")) / 60.0).cast("long").alias("close_offset_min"),
        time.close_rule(F.col("close_ts")).alias("close_convention"),
        (time.dst_status(F.col("day")) == "transition").alias("dst_transition_day"),
        text.settlement_phrase(F.col("early_close"), F.col("rules_secondary"), F.col("rules_primary")).alias("settlement_phrase"),
    )


def daily_mode(rows: DataFrame, day: str, value: str) -> DataFrame:
    """One value a day; of equally frequent ones the least, so that an odd market moves no boundary."""
    return rows.groupBy(day).agg(F.mode(value, deterministic=True).alias(value))


def spans(daily: DataFrame, day: str, value: str) -> DataFrame:
    return daily.groupBy(value).agg(F.count("*").alias("n_days"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def parsed(markets: DataFrame) -> DataFrame:
    """Markets with their strike (role, floor_f, cap_f, width_f, source) and suffix class."""
    return markets.withColumns({"strike": text.strike(F.col("strike_type"), F.col("floor_strike"), F.col("cap_strike"), F.col("subtitle")), "suffix": text.suffix_class(F.col("ticker"))})


def contiguous(bins: Column) -> Column:
    """Whether sorted (low, high) bins follow on one another; one bin or none does."""
    later = F.slice(bins, 2, F.greatest(F.size(bins) - 1, F.lit(0)))
    return F.forall(F.arrays_zip(F.slice(bins, 1, F.greatest(F.size(bins) - 1, F.lit(0))).alias("a"), later.alias("b")), lambda x: x["b"]["low"] == x["a"]["high"] + 1)


def event_structure(markets: DataFrame) -> DataFrame:
    """The ladder of each day: counts, modal width, alignment, contiguity, tails, suffix scheme and an id of all."""
    role = F.col("strike.role")
    inner = role == "between"
    rows = parsed(markets).groupBy("day").agg(
        F.count("*").alias("n_brackets"), F.count("strike").alias("n_parsed"), F.count_if(F.col("strike").isNull()).alias("n_unparsed"),
        F.count_if(inner).alias("n_interior"), F.count_if(role.isin("greater", "less")).alias("n_tails"),
        F.mode(F.when(inner, F.col("strike.width_f")), deterministic=True).alias("width"), F.countDistinct(F.when(inner, F.col("strike.width_f"))).alias("n_widths"),
        F.sort_array(F.collect_list(F.when(inner, F.struct(F.col("strike.floor_f").alias("low"), F.col("strike.cap_f").alias("high"))))).alias("bins"),
        F.coalesce(F.bool_and(F.when(inner, (F.col("strike.floor_f") % 2 == 0) & (F.col("strike.cap_f") % 2 == 0))), F.lit(True)).alias("all_even"),
        F.coalesce(F.bool_and(F.when(inner, F.col("strike.width_f") == 2)), F.lit(True)).alias("all_two"),
        F.coalesce(F.bool_or(role == "less"), F.lit(False)).alias("has_less"), F.coalesce(F.bool_or(role == "greater"), F.lit(False)).alias("has_greater"),
        F.sort_array(F.collect_set("suffix")).alias("classes"),
    )
    width = F.col("width").cast("string")
    align = (
        F.when(F.col("n_interior") == 0, "no_interior")
        .when(F.col("width").isNull(), "mixed_width")
        .when(F.col("width") != 2, F.concat(F.lit("width_"), width, F.lit("f")))
        .when(F.col("all_two"), F.concat(F.lit("integer_2f_bins_"), F.when(F.col("all_even"), "even").otherwise("mixed_parity")))
        .otherwise("nonuniform_interior")
    )
    within = lambda *names: F.size(F.array_except("classes", F.array(*[F.lit(n) for n in names]))) == 0
    scheme = F.when(within("T_tail", "B_midpoint"), "T_tail_B_midpoint").when(within("T_tail", "B_other", "B_midpoint"), "T_tail_B_mixed").otherwise(F.array_join("classes", "+"))
    rows = rows.withColumns({"boundary_alignment": align, "contiguous_interior": contiguous(F.col("bins")), "open_tails": F.col("has_less") & F.col("has_greater"), "suffix_scheme": scheme, "mixed_interior_widths": F.col("n_widths") > 1})
    word = lambda c: F.when(F.col(c), "True").otherwise("False")
    ident = F.concat_ws("|", F.concat(F.lit("n="), F.col("n_brackets").cast("string")), F.concat(F.lit("width="), F.coalesce(width, F.lit("None"))), F.concat(F.lit("align="), "boundary_alignment"), F.concat(F.lit("contig="), word("contiguous_interior")), F.concat(F.lit("tails="), word("open_tails")), F.concat(F.lit("suffix="), "suffix_scheme"))
    return rows.withColumn("structure_id", ident).withColumnRenamed("width", "interior_width_f").drop("bins", "classes", "n_widths", "all_even", "all_two", "has_less", "has_greater")


def regimes(daily: DataFrame) -> DataFrame:
    """Spans of days of one structure, with the first day's attributes and the median of brackets a day."""
    rows = islands(daily, "day", "structure_id")
    first = lambda c: F.min_by(c, "day").alias(c)
    return rows.groupBy("island").agg(
        first("structure_id"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_climate_days"), F.percentile("n_brackets", F.lit(0.5)).alias("median_brackets_per_day"),
        first("interior_width_f"), first("boundary_alignment"), first("contiguous_interior"), first("open_tails"), first("suffix_scheme"),
    )


def width_verdict(regime_rows: DataFrame, daily: DataFrame) -> DataFrame:
    """Whether bins are two degrees wide: confirmed, era-dependent, falsified, or not to be told; one row."""
    a = regime_rows.agg(F.count("*").alias("n_regimes"), F.coalesce(F.bool_and(F.coalesce(F.col("interior_width_f") == 2, F.lit(False))), F.lit(False)).alias("all_two"), F.lit(1).alias("k"))
    b = daily.agg(F.count("*").alias("n_days"), F.count("interior_width_f").alias("n_width"), F.count_if(F.col("interior_width_f") != 2).alias("n_other"), F.lit(1).alias("k"))
    other, n = F.col("n_other"), F.col("n_regimes")
    verdict = (
        F.when((n == 0) | (F.col("n_days") == 0), "insufficient_data")
        .when(F.col("n_width") == 0, "no_interior_width_observed")
        .when((other == 0) & F.col("all_two"), "confirmed_2f_bins")
        .when((n == 1) & F.col("all_two"), "confirmed_2f_bins")
        .when((other > 0) & (n > 1), "era_dependent")
        .when(other > 0, "falsified_or_sparse")
        .otherwise("era_dependent")
    )
    return a.join(b, "k").select("n_regimes", "n_days", "n_other", verdict.alias("verdict"))


__all__ = ["change_points", "daily_mode", "era_table", "event_structure", "parsed", "regimes", "spans", "width_verdict"]
