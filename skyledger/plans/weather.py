"""Jobs over station observations and labels: daily maxima, station basis, window mismatch, clock calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions import time, weather

SEASONS = ("DJF", "MAM", "JJA", "SON")


def daily_max(obs: DataFrame) -> DataFrame:
    """Of each station and climate day the maximum and the earliest time it was reached."""
    rows = obs.where("tmpf is not null").withColumn("day", time.climate_day(F.col("valid_ts")))
    best = F.max(F.struct(F.col("tmpf").alias("t"), (-F.col("valid_ts")).alias("at")))
    return rows.groupBy("station", "day").agg(best.alias("b")).select("station", "day", F.col("b.t").alias("max_f"), (-F.col("b.at")).alias("max_ts"))


def paired_days(maxima: DataFrame, base: str = "NYC", other: str = "LGA") -> DataFrame:
    """Days with both stations: whole-degree maxima, their difference and brackets."""
    one = lambda s: F.max(F.when(F.col("station") == s, weather.whole(F.col("max_f"))))
    rows = maxima.groupBy("day").agg(one(base).alias("base_f"), one(other).alias("other_f")).where("base_f is not null and other_f is not null")
    date = F.date_from_unix_date(F.col("day").cast("int"))
    rows = rows.withColumns({"season": time.season(date), "month": F.month(date), "delta_f": F.col("other_f") - F.col("base_f"), "base_bracket": weather.even_bracket(F.col("base_f")), "other_bracket": weather.even_bracket(F.col("other_f"))})
    return rows.withColumn("disagree", F.col("base_bracket") != F.col("other_bracket"))


def share(c) -> F.Column:
    return F.avg(c.cast("double"))


def basis(paired: DataFrame) -> DataFrame:
    """Overall and by season, empty seasons included: differences, shares and disagreement; the middle only overall."""
    delta = F.col("delta_f")
    limits = paired.agg(F.percentile("base_f", F.lit(0.1)).alias("p10"), F.percentile("base_f", F.lit(0.9)).alias("p90"))
    rows = paired.withColumn("_k", F.lit(1)).join(limits.withColumn("_k", F.lit(1)), "_k")  # one row of limits
    inside = F.col("base_f").between(F.col("p10"), F.col("p90"))
    q = lambda p: F.percentile("delta_f", F.lit(p))
    sums = rows.rollup("season").agg(
        F.count("*").alias("n_days"), F.avg("delta_f").alias("delta_mean"), q(0.5).alias("delta_median"), q(0.1).alias("delta_p10"), q(0.25).alias("delta_p25"), q(0.75).alias("delta_p75"), q(0.9).alias("delta_p90"),
        share(delta == 0).alias("share_equal"), share(delta > 0).alias("share_other_warmer"), share(delta < 0).alias("share_base_warmer"), share(F.col("disagree")).alias("disagree_frac"),
        F.avg(F.when(inside, F.col("disagree").cast("double"))).alias("middle"), F.first("p10").alias("p10"), F.first("p90").alias("p90"), F.grouping("season").alias("g"),
    ).withColumn("slice", F.when(F.col("g") == 1, "overall").otherwise(F.col("season")))
    only = lambda c: F.when(F.col("slice") == "overall", F.col(c))
    sums = sums.withColumns({"disagree_frac_middle": only("middle"), "middle_p10": only("p10"), "middle_p90": only("p90")}).drop("season", "g", "middle", "p10", "p90")
    spine = paired.sparkSession.createDataFrame([(s,) for s in ("overall", *SEASONS)], "slice string")
    return spine.join(sums, "slice", "left").fillna(0, ["n_days"])


def disagreement_by_max(paired: DataFrame) -> DataFrame:
    return paired.groupBy("base_f").agg(F.count("*").alias("n_days"), share(F.col("disagree")).alias("disagree_frac"), F.percentile("delta_f", F.lit(0.5)).alias("delta_median"))


def top_disagreement(table: DataFrame, least_days: int = 10, n: int = 8) -> DataFrame:
    """The highest rates among maxima with enough days, or among all if none has."""
    any_ = table.agg(F.coalesce(F.max("n_days"), F.lit(0)).alias("_most")).withColumn("_k", F.lit(1))
    rows = table.withColumn("_k", F.lit(1)).join(any_, "_k")
    return rows.where((F.col("n_days") >= least_days) | (F.col("_most") < least_days)).orderBy(F.desc("disagree_frac"), "base_f").limit(n).drop("_k", "_most")


def hypotheses(labels: DataFrame) -> DataFrame:
    """Labels once for each reading of the printed clock, with the instant and whether it is outside the forecast window."""
    minutes = time.clock_minutes(F.coalesce("time_raw", F.lit("")))
    rows = None
    for h in ("lst", "ldt"):
        one = labels.withColumns({"convention": F.lit(h), "instant": time.clock_instant(F.col("day"), minutes, h)})
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("outside", ~time.within(F.col("instant"), *time.max_window(F.col("day"))))


def mismatch(labels: DataFrame) -> DataFrame:
    rows = hypotheses(labels).where("instant is not null")
    return rows.groupBy(time.season(F.date_from_unix_date(F.col("day").cast("int"))).alias("season"), "convention").agg(F.count("*").alias("n"), share(F.col("outside")).alias("mismatch_rate"))


def label_days(labels: DataFrame, maxima: DataFrame) -> DataFrame:
    """Days with a printed clock and a station maximum: both maxima, their difference and what falls outside the window.

    A clock that cannot be read is not outside.
    """
    minutes = time.clock_minutes(F.coalesce("time_raw", F.lit("")))
    rows = labels.where(F.trim(F.coalesce("time_raw", F.lit(""))) != "").join(maxima.select("day", "max_f", "max_ts"), "day")
    window = time.max_window(F.col("day"))
    high = weather.label_high(F.col("high_raw"))
    rows = rows.withColumns({"season": time.season(F.date_from_unix_date(F.col("day").cast("int"))), "label_f": weather.whole(high), "station_f": weather.whole(F.col("max_f"))})
    rows = rows.withColumns({
        "delta_f": F.col("station_f") - F.col("label_f"), "disagree": weather.even_bracket(F.col("label_f")) != weather.even_bracket(F.col("station_f")),
        "station_outside": ~time.within(F.col("max_ts"), *window),
        **{f"outside_{h}": F.coalesce(~time.within(time.clock_instant(F.col("day"), minutes, h), *window), F.lit(False)) for h in ("lst", "ldt")},
    })
    return rows


def conditional_summary(rows: DataFrame) -> DataFrame:
    """Rates and medians by season and over all, also given that the label's or the station's maximum is outside."""
    q = lambda flag: F.percentile(F.when(F.col(flag), F.col("delta_f")), F.lit(0.5))
    rate = lambda flag: F.avg(F.when(F.col(flag), F.col("disagree").cast("double")))
    sums = rows.rollup("season").agg(
        F.count("*").alias("n_days"), share(F.col("outside_lst")).alias("rate_lst"), share(F.col("outside_ldt")).alias("rate_ldt"), share(F.col("station_outside")).alias("rate_station"), share(F.col("disagree")).alias("disagree_rate"),
        q("outside_lst").alias("delta_when_lst"), q("outside_ldt").alias("delta_when_ldt"), q("station_outside").alias("delta_when_station"),
        rate("outside_lst").alias("disagree_when_lst"), rate("station_outside").alias("disagree_when_station"), F.grouping("season").alias("g"),
    )
    return sums.withColumn("season", F.when(F.col("g") == 1, "ALL").otherwise(F.col("season"))).drop("g")


def clock_table(labels: DataFrame, maxima: DataFrame) -> DataFrame:
    """Minutes between the station's maximum and the printed clock, under both readings, with the day's DST state."""
    minutes = time.clock_minutes(F.coalesce("time_raw", F.lit("")))
    rows = labels.join(maxima.select("day", "max_ts"), "day").withColumn("dst_status", time.dst_status(F.col("day")))
    for h in ("lst", "ldt"):
        rows = rows.withColumn(f"delta_{h}", F.round(F.abs(F.col("max_ts") - time.clock_instant(F.col("day"), minutes, h)) / 60.0, 1))
    return rows.where("delta_lst is not null or delta_ldt is not null")


def clock_summary(rows: DataFrame) -> DataFrame:
    q = lambda c, p: F.percentile(c, F.lit(p))
    cols = []
    for c in ("delta_lst", "delta_ldt"):
        cols += [q(c, 0.5).alias(f"{c}_median"), (q(c, 0.75) - q(c, 0.25)).alias(f"{c}_iqr")]
    return rows.groupBy("dst_status").agg(F.count("*").alias("n"), *cols)


def clock_histogram(rows: DataFrame, column: str = "delta_lst", width: int = 5) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy("dst_status", (F.floor(F.col(column) / width) * width).alias("bin")).agg(F.count("*").alias("n"))
