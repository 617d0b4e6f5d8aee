"""Registered queries of the forecast and audit jobs over the bound views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.bindings import frame
from skyledger.functions import text, time, weather
from skyledger.operators.ordered import latest, missing, stratified
from skyledger.plans import audit, forecast
from skyledger.plans.market_queries import markets, r, rounded
from skyledger.registry import query

COL = F.col

CAND = """SELECT c.day, c.snapshot_ts, z.cyc AS cycle_ts, CAST((c.day * 86400 + 108000 - z.cyc) / 3600 AS BIGINT) AS forecast_hour
    FROM v_cycles c CROSS JOIN LATERAL (SELECT unnest(range(c.snapshot_ts - c.snapshot_ts % 86400 - 86400, c.snapshot_ts - c.snapshot_ts % 86400 + 86400, 3600)) AS cyc) z
    WHERE z.cyc < c.snapshot_ts AND z.cyc % 43200 = 0 AND (c.day * 86400 + 108000 - z.cyc) >= 64800 AND ((c.day * 86400 + 108000 - z.cyc) / 3600 - 18) % 12 = 0
    AND (z.cyc % 86400) / 3600 = CASE WHEN ((c.day * 86400 + 108000 - z.cyc) / 3600 - 18) % 24 = 0 THEN 12 ELSE 0 END"""
VINT = f"SELECT c.day, c.snapshot_ts, MAX(x.cycle_ts) AS vintage_ts, arg_max(x.forecast_hour, x.cycle_ts) AS forecast_hour FROM v_cycles c LEFT JOIN ({CAND}) x ON x.day = c.day AND x.cycle_ts + 3600 < c.snapshot_ts GROUP BY 1, 2"


def days(s, d):
    return frame(s, d, "SELECT day, snapshot_ts FROM v_cycles")


@query("prj_fh", f"SELECT day, cycle_ts, forecast_hour FROM ({CAND}) x")
def prj_fh(s, d):
    return rounded(forecast.candidates(days(s, d)).select("day", "cycle_ts", "forecast_hour"))


@query("jn_vint", VINT)
def jn_vint(s, d):
    return rounded(forecast.vintages(days(s, d)))


INV = """SELECT file_id, pos, line, CAST(pos + 1 AS BIGINT) AS msg, byte_offset, regexp_extract(line, 'd=(\\d{10})', 1) AS cycle, CAST(CASE WHEN pos < 22 THEN 12 WHEN pos < 30 THEN 30 ELSE 24 END AS BIGINT) AS start_h, CAST(CASE WHEN pos < 22 THEN 30 WHEN pos < 30 THEN 48 ELSE 30 END AS BIGINT) AS end_h, TRY_CAST(regexp_extract(line, ':P?(\\d+)% level$', 1) AS BIGINT) AS level FROM v_inventory"""
RNG = f"SELECT *, byte_offset AS first_byte, COALESCE(LEAD(byte_offset) OVER (PARTITION BY file_id ORDER BY pos) - 1, byte_offset) AS last_byte FROM ({INV}) i"


def inv(s, d):
    return forecast.inventory(frame(s, d, "SELECT file_id, pos, line FROM v_inventory"))


@query("src_idx", f"SELECT file_id, pos, msg, byte_offset, cycle, start_h, end_h, level FROM ({INV}) i")
def src_idx(s, d):
    return rounded(inv(s, d).select("file_id", "pos", "msg", "byte_offset", "cycle", "start_h", "end_h", "level"))


@query("win_byte", f"SELECT file_id, pos, first_byte, last_byte FROM ({RNG}) x")
def win_byte(s, d):
    return forecast.byte_ranges(inv(s, d)).select("file_id", "pos", "first_byte", "last_byte")


@query("prj_pct", f"SELECT file_id, pos, level FROM ({INV}) x WHERE end_h - start_h = 18 AND level IN (10, 20, 30, 40, 50, 60, 70, 80, 90)")
def prj_pct(s, d):
    return rounded(forecast.max_percentiles(inv(s, d), forecast.LEVELS).select("file_id", "pos", "level"))


@query("agg_bytes", f"SELECT COUNT(*) AS n_files, ROUND(AVG(b), 6) AS mean_bytes, CAST(FLOOR(AVG(b) * 300) AS BIGINT) AS total_300 FROM (SELECT file_id, SUM(last_byte - first_byte + 1) AS b FROM ({RNG}) x WHERE end_h - start_h = 18 AND level IN (10, 20, 30, 40, 50, 60, 70, 80, 90) GROUP BY 1) y")
def agg_bytes(s, d):
    per = forecast.max_percentiles(forecast.byte_ranges(inv(s, d)), forecast.LEVELS).groupBy("file_id").agg(F.sum("size").alias("b"))
    return rounded(per.agg(F.count("*").alias("n_files"), F.avg("b").alias("mean_bytes"), F.floor(F.avg("b") * 300).cast("long").alias("total_300")))


@query("prj_cyc", f"SELECT file_id, pos, CAST(CASE WHEN cycle = '2024010100' THEN 1704067200 ELSE 1707998400 END AS BIGINT) AS cycle_ts, CAST(CASE WHEN cycle = '2024010100' THEN 1704067200 ELSE 1707998400 END + 3600 AS BIGINT) AS published_ts, end_h AS fh FROM ({INV}) x")
def prj_cyc(s, d):
    rows = inv(s, d)
    name = F.format_string("blend.t00z.qmd.f%03d.co.grib2", COL("end_h"))
    at = text.cycle_epoch(F.concat(F.lit("d="), COL("cycle")))
    return rounded(rows.select("file_id", "pos", at.alias("cycle_ts"), (at + 3600).alias("published_ts"), text.file_hour(name).alias("fh")))


ERAD = "SELECT day, CAST(CAST(substr(climate_date, 1, 4) AS INT) + 28 AS {str}) AS y, substr(climate_date, 5) AS md FROM v_days WHERE substr(climate_date, 6) <> '02-29'"


@query("prj_eraf", "SELECT day, CASE WHEN dt < '2020-09-29' THEN 'v3.2' WHEN dt < '2023-01-17' THEN 'v4.0' WHEN dt < '2024-05-15' THEN 'v4.1' WHEN dt < '2025-04-15' THEN 'v4.2' WHEN dt < '2026-05-04' THEN 'v4.3' ELSE 'v5.0' END AS version, CASE WHEN dt < '2026-05-04' THEN 'v4_retrospective' ELSE 'v5_prospective' END AS band, CAST(CASE WHEN dt < '2026-05-04' THEN 99 ELSE 21 END AS BIGINT) AS levels FROM (SELECT day, y || md AS dt FROM (" + ERAD + ") a) b")
def prj_eraf(s, d):
    rows = frame(s, d, ERAD).withColumn("dt", F.concat("y", "md").cast("date"))
    return rounded(rows.select("day", weather.version(COL("dt")).alias("version"), weather.era_band(COL("dt")).alias("band"), weather.level_count(COL("dt")).alias("levels")))


STRATA = "SELECT day, climate_date, CASE WHEN CAST(substr(climate_date, 6, 2) AS INT) IN (12, 1, 2) THEN 'DJF' WHEN CAST(substr(climate_date, 6, 2) AS INT) <= 5 THEN 'MAM' WHEN CAST(substr(climate_date, 6, 2) AS INT) <= 8 THEN 'JJA' ELSE 'SON' END AS season, CASE WHEN climate_date < '1996-05-15' THEN 'early' ELSE 'late' END AS sub FROM v_days"
STRAT = f"SELECT day, season, sub FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season, sub ORDER BY md5('42|' || day)) AS rn, DENSE_RANK() OVER (ORDER BY season, sub) AS i FROM ({STRATA}) a) b WHERE rn <= 37 + CASE WHEN i <= 4 THEN 1 ELSE 0 END"


@query("win_strat", STRAT)
def win_strat(s, d):
    return stratified(frame(s, d, STRATA), ["season", "sub"], "day", 300, 42).select("day", "season", "sub")


@query("agg_stra", f"SELECT season, sub, COUNT(*) AS n, COUNT(CASE WHEN day < 9000 THEN 1 END) AS n_before FROM ({STRAT}) x GROUP BY 1, 2")
def agg_stra(s, d):
    return win_strat(s, d).groupBy("season", "sub").agg(F.count("*").alias("n"), F.count_if(COL("day") < 9000).alias("n_before"))


@query("top_rep", f"SELECT season, sub, MIN(day) AS rep FROM ({STRAT}) x GROUP BY 1, 2")
def top_rep(s, d):
    return win_strat(s, d).groupBy("season", "sub").agg(F.min("day").alias("rep"))


GRIDP = "SELECT s_suppkey AS cell, 25 + s_suppkey % 25 AS cell_lat, -100 + (s_suppkey * 7) % 60 + 360 AS cell_lon FROM supplier"
POINTS = "SELECT n_nationkey AS n, n_name AS name, 30 + n_nationkey % 15 AS lat, -95 + n_nationkey * 2 AS lon FROM nation"
KM = "2 * 6371e0 * asin(sqrt(pow(sin(radians(c.cell_lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.cell_lat)) * pow(sin(radians(c.cell_lon - 360 - p.lon) / 2), 2)))"


@query("jn_gridpt", f"SELECT name, cell, ROUND(km, 4) AS km FROM (SELECT p.name, c.cell, {KM} AS km, ROW_NUMBER() OVER (PARTITION BY p.name ORDER BY {KM}, c.cell) AS rn FROM ({POINTS}) p CROSS JOIN ({GRIDP}) c) x WHERE rn = 1")
def jn_gridpt(s, d):
    return rounded(forecast.nearest(frame(s, d, POINTS).drop("n"), frame(s, d, GRIDP)), 4)


@query("prj_hav", f"SELECT p.name, c.cell, ROUND({KM}, 4) AS km FROM ({POINTS}) p JOIN ({GRIDP}) c ON c.cell % 25 = p.n")
def prj_hav(s, d):
    """Every cell's distance from one of the points."""
    cells = frame(s, d, GRIDP).withColumn("n", COL("cell") % 25)
    rows = cells.join(frame(s, d, POINTS), "n")
    return rounded(rows.select("name", "cell", weather.haversine_km(COL("lat"), COL("lon"), COL("cell_lat"), COL("cell_lon")).alias("km")), 4)


LADS = "SELECT day, (o_orderkey % 9 + 1) * 10 AS level FROM (SELECT ({e0} o_orderdate {e1}) {div} 86400 AS day, o_orderkey FROM orders) x"


@query("gate_lad", f"SELECT v.day, COALESCE(n, 0) AS n_levels, CASE WHEN v.vintage_ts IS NULL THEN 'no_vintage_cycle' WHEN COALESCE(n, 0) = 0 THEN 'empty_ladder' WHEN n < 9 THEN 'partial_ladder' ELSE 'ok' END AS status FROM (SELECT day, CASE WHEN day % 11 > 0 THEN 1 END AS vintage_ts FROM v_days) v LEFT JOIN (SELECT day, COUNT(DISTINCT level) AS n FROM ({LADS}) l WHERE day % 13 > 0 GROUP BY 1) l ON l.day = v.day")
def gate_lad(s, d):
    spine = frame(s, d, "SELECT day, CASE WHEN day % 11 > 0 THEN 1 END AS vintage_ts, 30 AS forecast_hour FROM v_days")
    return forecast.ladder_status(spine, frame(s, d, LADS).where("day % 13 > 0"))


# Availability.
WATCH = "SELECT source, nominal_ts, fhour, CASE WHEN n_after = 0 THEN 'pending' WHEN hit IS NULL THEN 'waiting' WHEN hit = 1 THEN 'pre_existing' ELSE 'complete' END AS status, CASE WHEN hit > 1 THEN (ht - nominal_ts) / 60e0 END AS first_min, (hm - nominal_ts) / 60e0 AS modified_min FROM (SELECT source, nominal_ts, fhour, COUNT(CASE WHEN probe_ts >= nominal_ts THEN 1 END) AS n_after, MIN(rn) FILTER (http_status = 200) AS hit, arg_min(probe_ts, rn) FILTER (http_status = 200) AS ht, NULLIF(arg_min(COALESCE(modified_ts, -1), rn) FILTER (http_status = 200), -1) AS hm FROM (SELECT *, CASE WHEN probe_ts >= nominal_ts THEN ROW_NUMBER() OVER (PARTITION BY source, nominal_ts, fhour, probe_ts >= nominal_ts ORDER BY probe_ts, event_id) END AS rn FROM v_watch) a GROUP BY 1, 2, 3) b"
WATCHR = f"SELECT source, nominal_ts, CAST(fhour AS BIGINT) AS fhour, status, {r('first_min', 'modified_min')}, ROUND(modified_min - first_min, 6) AS gap_min FROM ({WATCH}) w"


def watched(s, d):
    return forecast.availability(frame(s, d, "SELECT *, event_id AS probe_id FROM v_watch"))


@query("src_watch", WATCHR)
def src_watch(s, d):
    return rounded(watched(s, d))


@query("prj_lag", f"SELECT source, nominal_ts, CAST(fhour AS BIGINT) AS fhour, {r('first_min', 'modified_min')}, ROUND(modified_min - first_min, 6) AS gap_min FROM ({WATCH}) w WHERE status = 'complete'")
def prj_lag(s, d):
    return rounded(watched(s, d).where("status = 'complete'").drop("status"))


def _lag(keys, sel):
    return f"SELECT {sel} COUNT(*) AS n, ROUND(quantile_cont(first_min, 0.5), 6) AS median_min, ROUND(quantile_cont(first_min, 0.9), 6) AS p90_min, ROUND(MAX(first_min), 6) AS max_min FROM ({WATCH}) w WHERE first_min IS NOT NULL {keys}"


@query("agg_avl", _lag("GROUP BY source", "source, CAST(-1 AS BIGINT) AS hour,") + " UNION ALL " + _lag("GROUP BY source, nominal_ts % 86400 // 3600", "source, CAST(nominal_ts % 86400 // 3600 AS BIGINT) AS hour,"))
def agg_avl(s, d):
    rows = watched(s, d).withColumn("hour", (F.pmod(COL("nominal_ts"), F.lit(86400)) / 3600).cast("long"))
    return rounded(forecast.lag_stats(rows, "first_min", ["source"]).withColumn("hour", F.lit(-1).cast("long")).unionByName(forecast.lag_stats(rows, "first_min", ["source", "hour"])))


@query("agg_lat", _lag("", ""))
def agg_lat(s, d):
    return rounded(forecast.lag_stats(watched(s, d), "first_min", []))


@query("gate_lat", f"SELECT *, COALESCE(p90_min > 60, TRUE) AS hard_stop FROM ({_lag('', '')}) z")
def gate_lat(s, d):
    return rounded(forecast.hard_stop(watched(s, d), "first_min", 60))


@query("gate_avl", f"SELECT ROUND(f, 6) AS first_median, ROUND(m, 6) AS modified_median, ROUND(o, 6) AS other_median, CASE WHEN f IS NULL OR m IS NULL THEN 'insufficient_data' WHEN m - f > 120 THEN 'metadata_artifact' WHEN f > 120 THEN 'real_lag' ELSE 'aligned' END AS verdict, COALESCE(o < f - 30, FALSE) AS other_leads FROM (SELECT quantile_cont(CASE WHEN status = 'complete' AND source = 'aws' THEN first_min END, 0.5) AS f, quantile_cont(CASE WHEN status = 'complete' AND source = 'aws' THEN modified_min END, 0.5) AS m, quantile_cont(CASE WHEN status = 'complete' AND source = 'nomads' THEN first_min END, 0.5) AS o FROM ({WATCH}) w) x")
def gate_avl(s, d):
    return rounded(forecast.availability_verdict(watched(s, d)))


SAFE = f"SELECT v.day, v.vintage_ts, v.vintage_ts + q.m * 60 < v.snapshot_ts AS safe FROM ({VINT}) v LEFT JOIN (SELECT nominal_ts, MIN(first_min) AS m FROM ({WATCH}) w WHERE first_min IS NOT NULL GROUP BY 1) q ON q.nominal_ts = v.vintage_ts"


@query("jn_safe", SAFE)
def jn_safe(s, d):
    return forecast.safe_vintages(days(s, d), watched(s, d)).select("day", "vintage_ts", "safe")


@query("agg_safer", f"SELECT COUNT(safe) AS n, ROUND(AVG(safe::INT::DOUBLE), 6) AS share FROM ({SAFE}) x")
def agg_safer(s, d):
    return rounded(jn_safe(s, d).agg(F.count("safe").alias("n"), F.avg(COL("safe").cast("double")).alias("share")))


NOW = 1704974400 + 7 * 3600  # a fixed time among the events


@query("win_watch", f"""WITH o AS (SELECT n * 43200 AS nominal_ts, CASE WHEN n % 2 = 0 THEN 30 ELSE 18 END AS fhour FROM range(39464, 39470) t(n) WHERE n * 43200 >= {NOW} - 43200 AND n * 43200 BETWEEN ({NOW} - 86400) // 86400 * 86400 AND ({NOW} + 86400) // 86400 * 86400 + 43200 AND n * 43200 NOT IN (SELECT nominal_ts FROM ({WATCH}) w WHERE status = 'complete' AND source = 'aws' AND nominal_ts % 86400 = 0)),
    a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY nominal_ts % 86400 ORDER BY nominal_ts DESC) AS k FROM o WHERE nominal_ts <= {NOW} + 21600 OR (SELECT COUNT(*) FROM o WHERE nominal_ts <= {NOW} + 21600) < 2)
    SELECT CAST(nominal_ts AS BIGINT) AS nominal_ts, CAST(fhour AS BIGINT) AS fhour FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY k = 1 DESC, nominal_ts) AS rn FROM a) b WHERE rn <= 2""")
def win_watch(s, d):
    done = watched(s, d).where("status = 'complete' and source = 'aws' and nominal_ts % 86400 = 0")
    return rounded(forecast.watch_list(forecast.upcoming(NOW, s), done, NOW))


# Calendars, coverage, inventories, state.
LIMITS = "SELECT MIN(day) AS a, MAX(day) AS b FROM v_days"
SPINES = {
    "day": f"SELECT unnest(range(a, b + 1)) AS v FROM ({LIMITS}) x",
    "month": f"SELECT DISTINCT year(t) * 12 + month(t) - 1 AS v FROM (SELECT DATE '1970-01-01' + CAST(unnest(range(a, b + 1)) AS INTEGER) AS t FROM ({LIMITS}) x) y",
    "minute": "SELECT unnest(range(a - a % 60, b - b % 60 + 60, 60)) AS v FROM (SELECT MIN(end_ts) AS a, MAX(end_ts) AS b FROM v_raw) x",
    "cycle": f"SELECT unnest(range((b - 11) * 86400, (b + 1) * 86400, 43200)) AS v FROM ({LIMITS}) x",
    "sample": f"SELECT unnest(range(b - 19, b + 1)) AS v FROM ({LIMITS}) x",
}


@query("jn_spine", " UNION ALL ".join(f"SELECT '{kind}' AS kind, CAST(v AS BIGINT) AS place FROM ({sql}) z" for kind, sql in SPINES.items()))
def jn_spine(s, d):
    """Days, months and minutes over the data's span, the last twelve days' cycles and the last twenty days."""
    span = frame(s, d, LIMITS)
    seconds = frame(s, d, "SELECT MIN(end_ts) AS a, MAX(end_ts) AS b FROM v_raw")
    kinds = {"day": forecast.day_spine(span), "month": forecast.month_spine(span), "minute": forecast.minute_spine(seconds), "cycle": forecast.cycle_spine(span, 12), "sample": forecast.sample_days(span, 20)}
    out = None
    for kind, rows in kinds.items():
        rows = rows.select(F.lit(kind).alias("kind"), COL("at").cast("long").alias("place"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("jn_cover", "SELECT CAST(day AS BIGINT) AS day FROM (SELECT unnest(range(MIN(day), MAX(day) + 1)) AS day FROM v_days) x WHERE day NOT IN (SELECT day FROM v_days)")
def jn_cover(s, d):
    spine = forecast.day_spine(frame(s, d, LIMITS)).withColumnRenamed("at", "day")
    return missing(spine, frame(s, d, "v_days"), ["day"])


@query("agg_inv", "SELECT kind, value, COUNT(*) AS n, MIN(open_ts) AS first_open, MAX(close_ts) AS last_close, ROUND(AVG(CASE WHEN close_ts > open_ts THEN (close_ts - open_ts) / 3600e0 END), 6) AS mean_open_hours FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {v} AS value, open_ts, close_ts FROM v_markets" for k, v in (("prefix", "'KXHIGHNY'"), ("close_year", "COALESCE(CAST(2024 AS VARCHAR), '') || substr(CAST(close_ts AS VARCHAR), 1, 0)"), ("tier", "CASE WHEN COALESCE(close_ts < 1705000000, FALSE) THEN 'historical' ELSE 'live' END"), ("all", "''"))) + ") x WHERE NOT (kind = 'close_year' AND close_ts IS NULL) GROUP BY 1, 2 UNION ALL SELECT 'close_year', '', COUNT(*), MIN(open_ts), MAX(close_ts), NULL FROM v_markets WHERE close_ts IS NULL HAVING COUNT(*) > 0")
def agg_inv(s, d):
    return rounded(audit.market_inventory(markets(s, d), 1705000000))


UPS = "SELECT user_id, end_ts, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS open_time, event_type AS status FROM v_raw"


@query("agg_ups", f"SELECT user_id, MAX(end_ts * 1000000 + event_id) AS seq, arg_max(open_time, end_ts * 1000000 + event_id) FILTER (open_time IS NOT NULL) AS open_time, arg_max(status, end_ts * 1000000 + event_id) AS status FROM ({UPS}) u GROUP BY 1")
def agg_ups(s, d):
    rows = frame(s, d, UPS).withColumn("seq", COL("end_ts") * 1000000 + COL("event_id"))
    return audit.upsert(rows, "user_id", "seq", ["open_time"], ["status"])


@query("agg_known", f"SELECT user_id, MIN(end_ts * 1000000 + event_id) AS first_seen, MAX(end_ts * 1000000 + event_id) AS last_seen, arg_max(status, end_ts * 1000000 + event_id) AS last_status FROM ({UPS}) u GROUP BY 1")
def agg_known(s, d):
    return audit.known(frame(s, d, UPS).withColumn("seq", COL("end_ts") * 1000000 + COL("event_id")), "user_id", "seq")


OPEN = "SELECT DISTINCT user_id FROM v_raw WHERE day = {x}"
D0, D1 = OPEN.replace("{x}", "19733"), OPEN.replace("{x}", "19734")


@query("jn_drop", f"SELECT user_id FROM ({D0}) a WHERE user_id NOT IN (SELECT user_id FROM ({D1}) b)")
def jn_drop(s, d):
    return audit.dropped(frame(s, d, D0), frame(s, d, D1), "user_id")


@query("set_exc", f"{D0} EXCEPT {D1}")
def set_exc(s, d):
    return frame(s, d, D0).exceptAll(frame(s, d, D1))


@query("agg_sett", f"SELECT user_id FROM ({D0}) a WHERE user_id NOT IN (SELECT user_id FROM ({D1}) b) AND user_id % 4 <> 0")
def agg_sett(s, d):
    captured = frame(s, d, "SELECT DISTINCT user_id FROM v_raw WHERE user_id % 4 = 0")
    return missing(jn_drop(s, d), captured, ["user_id"])


@query("win_pref", f"SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM ({D1}) b) THEN 'live' ELSE 'historical' END AS src FROM (({D0}) UNION ({D1})) u")
def win_pref(s, d):
    return audit.preferred(frame(s, d, D1).withColumn("x", F.lit(1)), frame(s, d, D0).withColumn("x", F.lit(2)), "user_id").select("user_id", "src")


@query("set_dist", "SELECT DISTINCT user_id, day FROM v_raw")
def set_dist(s, d):
    return frame(s, d, "SELECT user_id, day FROM v_raw").distinct()


@query("src_days", "SELECT DISTINCT day, ticker FROM v_quotes")
def src_days(s, d):
    return frame(s, d, "SELECT day, ticker FROM v_quotes").distinct()


@query("set_new", "SELECT event_id FROM v_raw WHERE event_id NOT IN (SELECT event_id FROM v_raw WHERE event_id % 10 < 4)")
def set_new(s, d):
    return missing(frame(s, d, "SELECT event_id FROM v_raw"), frame(s, d, "SELECT event_id FROM v_raw WHERE event_id % 10 < 4"), ["event_id"])


HB = "SELECT end_ts - end_ts % 3600 AS hour_ts, endpoint, COUNT(*) AS attempts, COUNT(CASE WHEN ok = 0 THEN 1 END) AS failures FROM v_polls {w} GROUP BY 1, 2"


@query("agg_hb", HB.replace("{w}", ""))
def agg_hb(s, d):
    return audit.heartbeat(frame(s, d, "v_polls"))


@query("agg_hb1", HB.replace("{w}", "WHERE end_ts >= (SELECT MAX(end_ts) FROM v_polls) - 3600"))
def agg_hb1(s, d):
    polls = frame(s, d, "v_polls")
    last = polls.agg(F.max("end_ts").alias("m")).withColumn("k", F.lit(1))
    rows = polls.withColumn("k", F.lit(1)).join(last, "k").where(COL("end_ts") >= COL("m") - 3600)  # one row of limits
    return audit.heartbeat(rows)


NEXT = 19757  # a day from which on many series have no event left


@query("win_next", f"SELECT user_id, event_id, rn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY end_ts, event_id) AS rn FROM v_raw WHERE day >= {NEXT}) x WHERE rn <= 2 UNION ALL SELECT user_id, event_id, LEAST(n, 2) + 1 - back AS rn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY end_ts DESC, event_id DESC) AS back, COUNT(*) OVER (PARTITION BY user_id) AS n, MAX(day) OVER (PARTITION BY user_id) AS last FROM v_raw) y WHERE last < {NEXT} AND back <= 2")
def win_next(s, d):
    """Of each series the current and the next event from a day on; where none is left, the last two."""
    return rounded(forecast.current_and_next(frame(s, d, "SELECT user_id, event_id, end_ts, day FROM v_raw"), "user_id", COL("day") >= NEXT, ["end_ts", "event_id"]).select("user_id", "event_id", "rn"))
