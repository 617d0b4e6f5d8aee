"""Jobs over forecast cycles, inventories and ladders: vintage choice, byte ranges, ladders, availability."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import text, time, weather
from skyledger.sources.bronze import written

LEVELS = (10, 20, 30, 40, 50, 60, 70, 80, 90)


def candidates(days: DataFrame, hours: tuple[int, ...] = (0, 12)) -> DataFrame:
    """Cycles of the snapshot's day and the day before, before the snapshot, at the given hours, that cover the day's maximum."""
    start = F.col("snapshot_ts") - F.pmod(F.col("snapshot_ts"), F.lit(86400)) - 86400
    rows = days.withColumn("cycle_ts", F.explode(F.sequence(start, start + 47 * 3600, F.lit(3600))))
    rows = rows.where((F.col("cycle_ts") < F.col("snapshot_ts")) & (F.pmod(F.col("cycle_ts"), F.lit(86400)) / 3600).isin(*hours))
    return rows.withColumn("forecast_hour", weather.max_hour(F.col("cycle_ts"), F.col("day"))).where("forecast_hour is not null")


def vintages(days: DataFrame, latency_min: int = 60) -> DataFrame:
    """Of each day (day, snapshot_ts) the latest covering cycle that was published strictly before the snapshot."""
    good = candidates(days).where(F.col("cycle_ts") + latency_min * 60 < F.col("snapshot_ts"))
    best = good.groupBy("day").agg(F.max(F.struct("cycle_ts", "forecast_hour")).alias("b"))
    return days.join(best, "day", "left").select(*days.columns, F.col("b.cycle_ts").alias("vintage_ts"), F.col("b.forecast_hour").alias("forecast_hour"))


def inventory(lines: DataFrame) -> DataFrame:
    """Parsed lines of (file_id, pos, line); what is no line of the kind is left out."""
    return lines.withColumn("p", text.inventory(F.col("line"))).where("p is not null").select("file_id", "pos", "line", "p.*")


def byte_ranges(rows: DataFrame) -> DataFrame:
    """First and last byte of each message, from the next line's offset in the whole file; the last one's end is its start."""
    after = F.lead("byte_offset").over(Window.partitionBy("file_id").orderBy("pos"))
    return rows.withColumns({"first_byte": F.col("byte_offset"), "last_byte": F.coalesce(after - 1, F.col("byte_offset"))}).withColumn("size", F.col("last_byte") - F.col("first_byte") + 1)


def max_percentiles(rows: DataFrame, levels: tuple[int, ...] | None = None, hour: int | None = None) -> DataFrame:
    """Lines of an 18-hour maximum window with a percentile level; call after `byte_ranges`."""
    out = rows.where((F.col("end_h") - F.col("start_h") == 18) & F.col("level").isNotNull())
    if hour is not None:
        out = out.where(F.col("end_h") == hour)
    return out.where(F.col("level").isin(*levels)) if levels else out


def ladder_status(days: DataFrame, ladders: DataFrame, expected: int = len(LEVELS)) -> DataFrame:
    """Completeness of each day's ladder: days with vintage_ts and forecast_hour, ladders with (day, level)."""
    counts = ladders.groupBy("day").agg(F.countDistinct("level").alias("n_levels"))
    n = F.coalesce("n_levels", F.lit(0))
    status = F.when(F.col("vintage_ts").isNull(), "no_vintage_cycle").when(F.col("forecast_hour").isNull(), "no_max_forecast_hour").when(n == 0, "empty_ladder").when(n < expected, "partial_ladder").otherwise("ok")
    return days.join(counts, "day", "left").select("day", n.alias("n_levels"), status.alias("status"))


#: Sides of the cubes in which cells are looked for, as parts of the globe's radius; of 2 a cube and its neighbours hold it all.
CUBES = (1 / 64, 1 / 16, 1 / 4, 1.0, 2.0)


def on_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def cube(lat: str, lon: str, side: float) -> list[Column]:
    return [F.floor(c / side).cast("int") for c in on_sphere(F.col(lat), F.col(lon))]


def cube_index(cells: DataFrame) -> DataFrame:
    """Every cell (cell, cell_lat, cell_lon) under its cube (level, x, y, z) of each size in CUBES."""
    levels = F.array(*[F.struct(F.lit(i).alias("level"), *[c.alias(n) for c, n in zip(cube("cell_lat", "cell_lon", side), "xyz")]) for i, side in enumerate(CUBES)])
    return cells.select("cell", "cell_lat", "cell_lon", F.explode(levels).alias("at")).select("cell", "cell_lat", "cell_lon", "at.*")


def nearest(points: DataFrame, cells: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Of each point (name, lat, lon) the nearest cell (cell, cell_lat, cell_lon), the lesser of ties; none where there are no cells.

    Points and cells lie on a globe in grids of cubes, small to large (`cube_index`, which a caller with many lookups keeps).
    A cell no further than a cube's side, along the chord, is in the point's cube or a neighbour.  So each point first
    meets the cubes that hold cells: the smallest size at which one of its 27 does bounds the distance by twice a cube's
    diagonal.  The size that is as large as this bound holds the nearest cell in one of 27 cubes, which are met by one more
    equi-join.  Cells are read twice at most, poles and the date line need no care.
    """
    index = written(cube_index(cells)) if index is None else index
    own = points.select("name", "lat", "lon")

    def around(rows: DataFrame, levels: list[int], level: Column) -> DataFrame:
        at = F.array(*[F.struct(F.lit(i).alias("level"), *[c.alias(n) for c, n in zip(cube("lat", "lon", CUBES[i]), "xyz")]) for i in levels])
        rows = rows.withColumn("at", F.explode(F.filter(at, lambda x: level.isNull() | (x["level"] == level)))).select("name", "lat", "lon", "at.*")
        for c in "xyz":
            rows = rows.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
        return rows

    every = list(range(len(CUBES)))
    bound = [next((j for j in every if CUBES[j] >= 2 * math.sqrt(3) * CUBES[i]), every[-1]) for i in every]
    there = index.select("level", "x", "y", "z").distinct()
    first = around(own, every, F.lit(None).cast("int")).join(there, ["level", "x", "y", "z"], "left_semi").groupBy("name").agg(F.min("level").alias("first"))
    sized = own.join(first, "name").withColumn("sure", F.element_at(F.array(*[F.lit(j) for j in bound]), F.col("first") + 1))
    near = index.join(around(sized, every, F.col("sure")), ["level", "x", "y", "z"])
    km = weather.haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"))
    return near.groupBy("name").agg(F.min(F.struct(km.alias("km"), F.col("cell"))).alias("b")).select("name", F.col("b.cell").alias("cell"), F.col("b.km").alias("km"))


def day_spine(span: DataFrame) -> DataFrame:
    """Every day number from a to b, as `at`."""
    return span.select(F.explode(F.sequence("a", "b")).alias("at"))


def month_spine(span: DataFrame) -> DataFrame:
    """Every month of the days from a to b, as months since year 0."""
    number = lambda c: F.year(F.date_from_unix_date(F.col(c).cast("int"))) * 12 + F.month(F.date_from_unix_date(F.col(c).cast("int"))) - 1
    return span.select(F.explode(F.sequence(number("a"), number("b"))).alias("at"))


def minute_spine(span: DataFrame, period: int = 60) -> DataFrame:
    """Every boundary of `period` seconds from the one begun at a to the one begun at b."""
    begun = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(period))
    return span.select(F.explode(F.sequence(begun("a"), begun("b"), F.lit(period).cast("long"))).alias("at"))


def cycle_spine(span: DataFrame, days: int, hours: tuple[int, ...] = (0, 12)) -> DataFrame:
    """The cycles at the given hours of the last `days` days up to b."""
    day = F.explode(F.sequence(F.col("b") - days + 1, F.col("b")))
    return span.select(day.alias("d")).select(F.explode(F.array(*[F.col("d") * 86400 + h * 3600 for h in hours])).alias("at"))


def sample_days(span: DataFrame, count: int, first: int | None = None, end: int | None = None) -> DataFrame:
    """The last `count` days up to b, none before `first` and all before `end`."""
    last = F.col("b") if end is None else F.least(F.col("b"), F.lit(end - 1))
    start = last - count + 1 if first is None else F.greatest(last - count + 1, F.lit(first))
    return span.where(start <= last).select(F.explode(F.sequence(start, last)).alias("at"))


def current_and_next(rows: DataFrame, key: str, coming: Column, order: list[str]) -> DataFrame:
    """Of each series the first two rows that are coming (rn 1 and 2), or where none is its last two, in order."""
    w = Window.partitionBy(key)
    ahead = F.coalesce(coming, F.lit(False)).cast("int")
    marked = rows.withColumns({
        "_ahead": ahead, "_any": F.max(ahead).over(w), "_n": F.count("*").over(w),
        "_rn": F.row_number().over(w.orderBy(ahead.desc(), *order)), "_back": F.row_number().over(w.orderBy(*[F.desc(c) for c in order])),
    })
    rn = F.when(F.col("_any") == 1, F.when(F.col("_ahead") == 1, F.col("_rn"))).otherwise(F.least(F.col("_n"), F.lit(2)) + 1 - F.col("_back"))
    return marked.withColumn("rn", rn).where(F.col("rn").between(1, 2)).drop("_ahead", "_any", "_n", "_rn", "_back")


def lag_stats(rows: DataFrame, minutes: str, by: list[str]) -> DataFrame:
    q = lambda p: F.percentile(minutes, F.lit(p))
    return rows.where(F.col(minutes).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), q(0.5).alias("median_min"), q(0.9).alias("p90_min"), F.max(minutes).alias("max_min"))


def hard_stop(rows: DataFrame, minutes: str, assumed: int) -> DataFrame:
    """One row: the lags' median, p90 and maximum, and whether p90 is over what was assumed; true without lags."""
    stats = lag_stats(rows, minutes, [])
    return stats.withColumn("hard_stop", F.coalesce(F.col("p90_min") > assumed, F.lit(True)))


def availability(probes: DataFrame) -> DataFrame:
    """Final state of each watched file from its probes (source, nominal_ts, fhour, probe_ts, http_status, modified_ts).

    pending before the nominal time, waiting after a probe without success, complete at the first success
    after that, pre_existing where the very first probe succeeds.  Probes after an end state change nothing.
    """
    keys = ["source", "nominal_ts", "fhour"]
    w = Window.partitionBy(*keys).orderBy("probe_ts", "probe_id")
    rows = probes.where(F.col("probe_ts") >= F.col("nominal_ts")).withColumns({"rn": F.row_number().over(w), "ok": F.col("http_status") == 200})
    hit = F.struct("rn", "probe_ts", "modified_ts")
    agg = rows.groupBy(*keys).agg(F.min(F.when(F.col("ok"), hit)).alias("h"))
    spine = probes.select(*keys).distinct()
    out = spine.join(agg.withColumn("seen", F.lit(True)), keys, "left")
    status = F.when(F.col("seen").isNull(), "pending").when(F.col("h").isNull(), "waiting").when(F.col("h.rn") == 1, "pre_existing").otherwise("complete")
    first = F.when(status == "complete", time.minutes_between(F.col("nominal_ts"), F.col("h.probe_ts")))
    modified = time.minutes_between(F.col("nominal_ts"), F.col("h.modified_ts"))
    return out.select(*keys, status.alias("status"), first.alias("first_min"), modified.alias("modified_min"), (modified - first).alias("gap_min"))


def availability_verdict(rows: DataFrame) -> DataFrame:
    """One row: whether a late modification stamp is an artefact or the mirror is late, and whether the other source leads."""
    done = F.col("status") == "complete"
    med = lambda c, s: F.percentile(F.when(done & (F.col("source") == s), F.col(c)), F.lit(0.5))
    m = rows.agg(med("first_min", "aws").alias("first_median"), med("modified_min", "aws").alias("modified_median"), med("first_min", "nomads").alias("other_median"))
    first, modified, other = F.col("first_median"), F.col("modified_median"), F.col("other_median")
    verdict = F.when(first.isNull() | modified.isNull(), "insufficient_data").when(modified - first > 120, "metadata_artifact").when(first > 120, "real_lag").otherwise("aligned")
    return m.withColumns({"verdict": verdict, "other_leads": F.coalesce(other < first - 30, F.lit(False))})


def upcoming(now_ts: int, spark, plan=((0, 30), (12, 18)), back_days: int = 1, ahead_days: int = 1) -> DataFrame:
    """(nominal_ts, fhour) of the cycles around a time, two a day."""
    start = (now_ts - back_days * 86400) // 86400
    end = (now_ts + ahead_days * 86400) // 86400
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("hour"), F.lit(f).alias("fhour")) for h, f in plan]))
    return spark.range(start, end + 1).select((F.col("id") * 86400).alias("d"), each.alias("x")).select((F.col("d") + F.col("x.hour") * 3600).alias("nominal_ts"), F.col("x.fhour").cast("long").alias("fhour"))


def watch_list(cycles: DataFrame, done: DataFrame, now_ts: int, least: int = 2, max_age_h: int = 12) -> DataFrame:
    """Cycles to watch: not done and not too old; of each hour the newest that is due, filled up in order to `least`."""
    open_ = cycles.join(done.select("nominal_ts").distinct(), "nominal_ts", "left_anti").where(F.col("nominal_ts") >= now_ts - max_age_h * 3600)
    due = (F.col("nominal_ts") <= now_ts + 6 * 3600).cast("int")
    flat = Window.partitionBy(F.lit(0))  # a few cycles
    rows = open_.withColumn("due", due).withColumn("n_due", F.sum("due").over(flat)).where((F.col("due") == 1) | (F.col("n_due") < least))
    newest = F.row_number().over(Window.partitionBy(F.pmod(F.col("nominal_ts"), F.lit(86400))).orderBy(F.desc("nominal_ts"))) == 1
    rows = rows.withColumn("first_choice", newest.cast("int"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("first_choice"), "nominal_ts")
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= least).select("nominal_ts", "fhour")


def safe_vintages(days: DataFrame, measured: DataFrame, latency_min: int = 60) -> DataFrame:
    """Whether each day's vintage had really been seen (nominal_ts, first_min) before its snapshot; null where unmeasured."""
    seen = measured.where("first_min is not null").groupBy("nominal_ts").agg(F.min("first_min").alias("seen_min"))
    rows = vintages(days, latency_min).join(seen, F.col("vintage_ts") == F.col("nominal_ts"), "left")
    return rows.withColumn("safe", F.col("vintage_ts") + F.col("seen_min") * 60 < F.col("snapshot_ts")).drop("nominal_ts")
