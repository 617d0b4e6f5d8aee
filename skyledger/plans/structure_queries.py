"""Registered queries of the structure and weather jobs over the bound views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.bindings import frame
from skyledger.functions import text, time, weather
from skyledger.operators.ordered import change_points, islands
from skyledger.plans import structure
from skyledger.plans import weather as jobs
from skyledger.plans.market_queries import labels, r, rounded
from skyledger.registry import query

COL = F.col

# Days of several years from the orders: closes at 23:59 of either clock, or else.
MK = """SELECT CONCAT('KXHIGHNY-', {k0} day {k1}, '-B', CAST(mn AS {str})) AS ticker, day, climate_date, mn,
    CASE WHEN mn % 9 = 0 THEN NULL ELSE day * 86400 + 104400 - 60 - CASE WHEN mn % 3 = 0 THEN 3600 WHEN mn % 31 = 1 THEN 1800 ELSE 0 END END AS close_ts,
    CASE WHEN mn % 4 = 0 THEN 'If  the first 10:00 AM ET following the day' WHEN mn % 4 = 1 THEN 'closes at the FIRST business day following' ELSE NULL END AS early_close,
    CASE WHEN mn % 4 = 2 THEN 'See Rule 100.19' ELSE NULL END AS rules_secondary, CAST(NULL AS {str}) AS rules_primary FROM v_days"""
_OFF = "date_diff('second', timezone('UTC', to_timestamp({x})), timezone('America/New_York', to_timestamp({x})))"


def off(x: str) -> str:
    return _OFF.replace("{x}", x)


def hhmm(x: str) -> str:
    return f"lpad(CAST((({x}) // 3600) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST((({x}) // 60) % 60 AS VARCHAR), 2, '0')"


DST = f"CASE WHEN {off('day * 86400 + 18000')} <> {off('day * 86400 + 104400')} THEN 'transition' WHEN {off('day * 86400 + 61200')} <> -18000 THEN 'edt' ELSE 'est' END"
RULE = f"CASE WHEN close_ts IS NULL THEN 'other' WHEN {hhmm('close_ts + ' + off('close_ts'))} = '23:59' AND {hhmm('close_ts - 18000')} = '23:59' THEN 'both (EST, not identifying)' WHEN {hhmm('close_ts + ' + off('close_ts'))} = '23:59' THEN 'civil_et_2359' WHEN {hhmm('close_ts - 18000')} = '23:59' THEN 'lst_2359_fixed_utc' ELSE 'other (' || {hhmm('close_ts - 18000')} || ' LST)' END"
PHRASE = "CASE WHEN mn % 4 = 0 THEN '10:00 AM' WHEN mn % 4 = 1 THEN 'BUSINESS DAY' ELSE 'unspecified (rulebook reference only)' END"
ERA = f"SELECT ticker, day, CAST(round_even((day * 86400 + 104400 - close_ts) / 60e0, 0) AS BIGINT) AS close_offset_min, {RULE} AS close_convention, {DST} = 'transition' AS dst_transition_day, {PHRASE} AS settlement_phrase FROM ({MK}) k WHERE close_ts IS NOT NULL"


def mk(s, d):
    return frame(s, d, MK)


def eras(s, d):
    return structure.era_table(mk(s, d))


@query("agg_erat", ERA)
def agg_erat(s, d):
    return eras(s, d)


@query("prj_off", f"SELECT ticker, close_offset_min FROM ({ERA}) e")
def prj_off(s, d):
    return eras(s, d).select("ticker", "close_offset_min")


@query("prj_conv", f"SELECT ticker, {RULE} AS out FROM ({MK}) k")
def prj_conv(s, d):
    return mk(s, d).select("ticker", time.close_rule(COL("close_ts")).alias("out"))


@query("prj_dst", f"SELECT day, {DST} AS out FROM v_days")
def prj_dst(s, d):
    return frame(s, d, "v_days").select("day", time.dst_status(COL("day")).alias("out"))


@query("prj_phr", f"SELECT ticker, {PHRASE} AS out FROM ({MK}) k")
def prj_phr(s, d):
    return mk(s, d).select("ticker", text.settlement_phrase(COL("early_close"), COL("rules_secondary"), COL("rules_primary")).alias("out"))


# A daily series that changes now and then.
SER = "SELECT day, CASE WHEN day % 97 < 40 THEN 'a' WHEN day % 97 < 70 THEN 'b' ELSE 'c' END AS v FROM v_days"


@query("agg_mode", "SELECT day, v FROM (SELECT day, event_type AS v, ROW_NUMBER() OVER (PARTITION BY day ORDER BY COUNT(*) DESC, event_type) AS rn FROM v_raw GROUP BY 1, 2) x WHERE rn = 1")
def agg_mode(s, d):
    return structure.daily_mode(frame(s, d, "SELECT day, event_type AS v FROM v_raw"), "day", "v")


@query("agg_span", f"SELECT v, COUNT(*) AS n_days, MIN(day) AS first_date, MAX(day) AS last_date FROM ({SER}) x GROUP BY v")
def agg_span(s, d):
    return structure.spans(frame(s, d, SER), "day", "v")


@query("win_cp", f"SELECT pd AS last_date_before, day AS first_date_after, pv AS value_before, v AS value_after, (SELECT COUNT(*) FROM ({SER}) b WHERE b.day <= x.pd AND b.v = x.pv) AS days_before, (SELECT COUNT(*) FROM ({SER}) a WHERE a.day >= x.day AND a.v = x.v) AS days_after FROM (SELECT day, v, LAG(day) OVER (ORDER BY day) AS pd, LAG(v) OVER (ORDER BY day) AS pv FROM ({SER}) z) x WHERE pd IS NOT NULL AND v <> pv")
def win_cp(s, d):
    return change_points(frame(s, d, SER), "day", "v")


@query("win_islands", f"SELECT day, SUM(c) OVER (ORDER BY day)::BIGINT AS island FROM (SELECT day, CASE WHEN LAG(v) OVER (ORDER BY day) <> v THEN 1 ELSE 0 END AS c FROM ({SER}) z) x")
def win_islands(s, d):
    return islands(frame(s, d, SER), "day", "v").select("day", "island")


# Strikes and ladders.
STRIKE = """SELECT ticker, day, p_partkey, CASE WHEN strike_type = 'between' THEN 'between' WHEN strike_type = 'greater' THEN 'greater' WHEN strike_type = 'less' THEN 'less' WHEN p_partkey % 12 = 2 THEN 'between' WHEN p_partkey % 12 = 8 THEN 'greater' END AS role,
    CAST(CASE WHEN strike_type IN ('between', 'greater') THEN floor_strike WHEN p_partkey % 12 = 2 THEN p_size + 40 WHEN p_partkey % 12 = 8 THEN p_size END AS BIGINT) AS floor_f,
    CAST(CASE WHEN strike_type IN ('between', 'less') THEN cap_strike WHEN p_partkey % 12 = 2 THEN p_size + 41 END AS BIGINT) AS cap_f,
    CASE WHEN p_partkey % 6 = 2 THEN 'subtitle' ELSE 'metadata' END AS strike_source,
    CASE WHEN p_partkey % 6 IN (0, 1) THEN 'T_tail' WHEN p_partkey % 6 = 5 AND p_partkey % 150 > 75 THEN 'B_other' ELSE 'B_midpoint' END AS suffix FROM v_strikes"""
EVT = f"""SELECT *, 'n=' || n_brackets || '|width=' || COALESCE(CAST(interior_width_f AS VARCHAR), 'None') || '|align=' || boundary_alignment || '|contig=' || CASE WHEN contiguous_interior THEN 'True' ELSE 'False' END || '|tails=' || CASE WHEN open_tails THEN 'True' ELSE 'False' END || '|suffix=' || suffix_scheme AS structure_id FROM (
    SELECT day, COUNT(*) AS n_brackets, COUNT(role) AS n_parsed, COUNT(*) - COUNT(role) AS n_unparsed, COUNT(CASE WHEN role = 'between' THEN 1 END) AS n_interior, COUNT(CASE WHEN role IN ('greater', 'less') THEN 1 END) AS n_tails,
        ANY_VALUE(m.w) AS interior_width_f, COUNT(DISTINCT width) > 1 AS mixed_interior_widths,
        CASE WHEN COUNT(CASE WHEN role = 'between' THEN 1 END) = 0 THEN 'no_interior' WHEN ANY_VALUE(m.w) <> 2 THEN 'width_' || ANY_VALUE(m.w) || 'f' WHEN BOOL_AND(width = 2) THEN 'integer_2f_bins_' || CASE WHEN BOOL_AND(floor_f % 2 = 0 AND cap_f % 2 = 0) FILTER (role = 'between') THEN 'even' ELSE 'mixed_parity' END ELSE 'nonuniform_interior' END AS boundary_alignment,
        COALESCE(BOOL_AND(pc IS NULL OR floor_f = pc + 1) FILTER (role = 'between'), TRUE) AS contiguous_interior,
        COALESCE(BOOL_OR(role = 'less'), FALSE) AND COALESCE(BOOL_OR(role = 'greater'), FALSE) AS open_tails,
        CASE WHEN BOOL_OR(suffix = 'B_other') THEN 'T_tail_B_mixed' ELSE 'T_tail_B_midpoint' END AS suffix_scheme
    FROM (SELECT *, CASE WHEN role = 'between' THEN cap_f - floor_f + 1 END AS width, LAG(cap_f) OVER (PARTITION BY day, role = 'between' ORDER BY floor_f, cap_f) AS pc FROM ({STRIKE}) s0) s
    LEFT JOIN (SELECT day AS md, w FROM (SELECT day, cap_f - floor_f + 1 AS w, ROW_NUMBER() OVER (PARTITION BY day ORDER BY COUNT(*) DESC, cap_f - floor_f + 1) AS rn FROM ({STRIKE}) s1 WHERE role = 'between' GROUP BY 1, 2) z WHERE rn = 1) m ON m.md = s.day
    GROUP BY day) e"""


@query("prj_strk", f"SELECT p_partkey, role, floor_f, cap_f, CASE WHEN role = 'between' THEN cap_f - floor_f + 1 END AS width_f, CASE WHEN role IS NOT NULL THEN strike_source END AS strike_source FROM ({STRIKE}) x")
def prj_strk(s, d):
    return rounded(structure.parsed(frame(s, d, "v_strikes")).select("p_partkey", "strike.role", "strike.floor_f", "strike.cap_f", "strike.width_f", "strike.strike_source"))


@query("prj_suf", f"SELECT p_partkey, suffix FROM ({STRIKE}) x")
def prj_suf(s, d):
    return structure.parsed(frame(s, d, "v_strikes")).select("p_partkey", "suffix")


def daily(s, d):
    return rounded(structure.event_structure(frame(s, d, "v_strikes")))


@query("agg_evt", EVT)
def agg_evt(s, d):
    return daily(s, d)


@query("win_cont", f"SELECT day, contiguous_interior FROM ({EVT}) x")
def win_cont(s, d):
    return daily(s, d).select("day", "contiguous_interior")


REG = f"""SELECT island, MIN(day) AS first_day, MAX(day) AS last_day, COUNT(*) AS n_climate_days, ROUND(quantile_cont(n_brackets, 0.5), 6) AS median_brackets_per_day, arg_min(structure_id, day) AS structure_id, arg_min(COALESCE(interior_width_f, -1), day) AS w, arg_min(boundary_alignment, day) AS boundary_alignment, arg_min(contiguous_interior, day) AS contiguous_interior, arg_min(open_tails, day) AS open_tails, arg_min(suffix_scheme, day) AS suffix_scheme
    FROM (SELECT *, SUM(c) OVER (ORDER BY day)::BIGINT AS island FROM (SELECT *, CASE WHEN LAG(structure_id) OVER (ORDER BY day) <> structure_id THEN 1 ELSE 0 END AS c FROM ({EVT}) v) y) z GROUP BY island"""


@query("win_reg", f"SELECT * EXCLUDE (w), NULLIF(w, -1) AS interior_width_f FROM ({REG}) q")
def win_reg(s, d):
    return rounded(structure.regimes(daily(s, d)))


@query("gate_2f", f"SELECT n_regimes, n_days, n_other, CASE WHEN n_other = 0 AND all_two THEN 'confirmed_2f_bins' WHEN n_other > 0 AND n_regimes > 1 THEN 'era_dependent' WHEN n_other > 0 THEN 'falsified_or_sparse' ELSE 'era_dependent' END AS verdict FROM (SELECT COUNT(*) AS n_regimes, BOOL_AND(w = 2) AS all_two FROM ({REG}) a) x CROSS JOIN (SELECT COUNT(*) AS n_days, COUNT(CASE WHEN interior_width_f <> 2 THEN 1 END) AS n_other FROM ({EVT}) b) y")
def gate_2f(s, d):
    rows = daily(s, d)
    return structure.width_verdict(structure.regimes(rows), rows)


# Second-venue labels.
PM = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CONCAT(CAST(p_size AS {str}), '°F or higher') WHEN p_partkey % 5 = 1 THEN CONCAT(CAST(p_size AS {str}), 'F or below') WHEN p_partkey % 5 = 2 THEN '' ELSE CONCAT(CAST(p_size AS {str}), '-', CAST(p_size + 1 AS {str}), '°F') END AS title, CASE WHEN p_partkey % 5 = 2 AND p_partkey % 3 > 0 THEN CONCAT('Will it be between ', CAST(p_size AS {str}), '-', CAST(p_size + 1 AS {str}), ' today?') ELSE 'no' END AS question, p_size, p_partkey % 7 = 0 AS closed, CONCAT('[\"', CAST(p_partkey AS {str}), '\", \"x\"]') AS tokens, p_partkey % 40 AS ev FROM part"
PMB = f"SELECT p_partkey, ev, closed, CASE WHEN p_partkey % 5 = 0 THEN 'tail_above' WHEN p_partkey % 5 = 1 THEN 'tail_below' WHEN p_partkey % 5 = 2 AND p_partkey % 3 = 0 THEN NULL ELSE 'between' END AS kind, CAST(CASE WHEN p_partkey % 5 = 1 OR (p_partkey % 5 = 2 AND p_partkey % 3 = 0) THEN NULL ELSE p_size END AS BIGINT) AS low, CAST(CASE WHEN p_partkey % 5 = 1 THEN p_size WHEN p_partkey % 5 IN (3, 4) OR (p_partkey % 5 = 2 AND p_partkey % 3 > 0) THEN p_size + 1 END AS BIGINT) AS high, CASE WHEN p_partkey % 5 <> 2 THEN title WHEN p_partkey % 3 > 0 THEN p_size || '-' || (p_size + 1) || '°F' END AS label, CAST(p_partkey AS VARCHAR) AS token FROM ({PM}) pm"


def venue(s, d):
    rows = frame(s, d, PM).withColumn("b", text.venue_bracket(COL("title"), COL("question")))
    return rounded(rows.select("p_partkey", "ev", "closed", "b.kind", "b.low", "b.high", "b.label", text.first_token(COL("tokens")).alias("token")))


@query("prj_pmb", f"SELECT p_partkey, kind, low, high, label FROM ({PMB}) x")
def prj_pmb(s, d):
    return venue(s, d).select("p_partkey", "kind", "low", "high", "label")


@query("prj_tok", f"SELECT p_partkey, token FROM ({PMB}) x")
def prj_tok(s, d):
    return venue(s, d).select("p_partkey", "token")


@query("prj_open", f"SELECT p_partkey, ev, kind FROM ({PMB}) x WHERE NOT closed AND kind IS NOT NULL")
def prj_open(s, d):
    return venue(s, d).where("not closed and kind is not null").select("p_partkey", "ev", "kind")


@query("arr_lad", f"SELECT ev, p_partkey, ROW_NUMBER() OVER (PARTITION BY ev ORDER BY COALESCE(low, -1), COALESCE(high, 999), p_partkey) AS rung FROM ({PMB}) x WHERE kind IS NOT NULL")
def arr_lad(s, d):
    rung = F.struct(F.coalesce("low", F.lit(-1)).alias("a"), F.coalesce("high", F.lit(999)).alias("b"), "p_partkey")
    rows = venue(s, d).where("kind is not null").groupBy("ev").agg(F.sort_array(F.collect_list(rung)).alias("ladder"))
    return rounded(rows.select("ev", F.posexplode("ladder").alias("i", "x")).select("ev", COL("x.p_partkey").alias("p_partkey"), (COL("i") + 1).alias("rung")))


@query("prj_leg", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'between' WHEN p_partkey % 3 = 1 THEN 'tail_above' END AS kind, CAST(CASE WHEN p_partkey % 3 < 2 THEN p_size END AS BIGINT) AS low, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 END AS BIGINT) AS high FROM part")
def prj_leg(s, d):
    """Legacy rows hold a strike and a direction; `>=` reads as a bin of two where the slug says between."""
    rows = frame(s, d, "SELECT p_partkey, p_size, CONCAT('{\"strike_f\": ', CAST(p_size AS {str}), ', \"direction\": \"', CASE WHEN p_partkey % 3 = 2 THEN '<' ELSE '>=' END, '\", \"market_slug\": \"', CASE WHEN p_partkey % 3 = 0 THEN 'x-between-y' ELSE 'x' END, '\"}') AS state FROM part")
    j = F.from_json("state", "strike_f int, direction string, market_slug string, bracket_kind string, bracket_low_f int, bracket_high_f int")
    rows = rows.withColumn("j", j)
    old = (COL("j.direction") == ">=") & COL("j.strike_f").isNotNull()
    between = COL("j.market_slug").contains("between")
    return rounded(rows.select("p_partkey", F.coalesce("j.bracket_kind", F.when(old, F.when(between, "between").otherwise("tail_above"))).alias("kind"), F.coalesce("j.bracket_low_f", F.when(old, COL("j.strike_f"))).alias("low"), F.coalesce("j.bracket_high_f", F.when(old & between, COL("j.strike_f") + 1)).alias("high")))


# Weather.
MAXQ = "SELECT station, day, MAX(tmpf) AS max_f, arg_min(valid_ts, valid_ts) FILTER (tmpf = mx) AS max_ts FROM (SELECT *, MAX(tmpf) OVER (PARTITION BY station, day) AS mx FROM v_obs WHERE tmpf IS NOT NULL) o GROUP BY 1, 2"


def even(x: str) -> str:
    return f"CASE WHEN {x} <= 75 THEN 'tail_below' WHEN {x} >= 94 THEN 'tail_above' WHEN {x} IS NOT NULL THEN 'between_' || ({x} - {x} % 2) || '-' || ({x} - {x} % 2 + 1) END"


PAIR = f"SELECT *, {even('base_f')} AS base_bracket, {even('other_f')} AS other_bracket, {even('base_f')} <> {even('other_f')} AS disagree FROM (SELECT a.day, s.season, CAST(substr(s.climate_date, 6, 2) AS BIGINT) AS month, CAST(round_even(a.max_f, 0) AS BIGINT) AS base_f, CAST(round_even(b.max_f, 0) AS BIGINT) AS other_f, CAST(round_even(b.max_f, 0) AS BIGINT) - CAST(round_even(a.max_f, 0) AS BIGINT) AS delta_f FROM ({MAXQ}) a JOIN ({MAXQ}) b ON a.day = b.day AND a.station = 'NYC' AND b.station = 'LGA' JOIN v_season s ON s.day = a.day) y"


def maxima(s, d):
    return jobs.daily_max(frame(s, d, "SELECT station, valid_ts, tmpf FROM v_obs"))


def pairs(s, d):
    return jobs.paired_days(maxima(s, d))


@query("agg_dmax", f"SELECT station, day, {r('max_f')}, max_ts FROM ({MAXQ}) x")
def agg_dmax(s, d):
    return rounded(maxima(s, d))


@query("jn_pair", PAIR)
def jn_pair(s, d):
    return rounded(pairs(s, d))


def _slices(where: str, name: str, mid: bool) -> str:
    m = f"ROUND(AVG(disagree::INT::DOUBLE) FILTER (base_f BETWEEN (SELECT quantile_cont(base_f, 0.1) FROM ({PAIR}) c) AND (SELECT quantile_cont(base_f, 0.9) FROM ({PAIR}) c)), 6) AS disagree_frac_middle, ROUND((SELECT quantile_cont(base_f, 0.1) FROM ({PAIR}) c), 6) AS middle_p10, ROUND((SELECT quantile_cont(base_f, 0.9) FROM ({PAIR}) c), 6) AS middle_p90" if mid else "CAST(NULL AS DOUBLE) AS disagree_frac_middle, CAST(NULL AS DOUBLE) AS middle_p10, CAST(NULL AS DOUBLE) AS middle_p90"
    q = lambda p, n: f"ROUND(quantile_cont(delta_f, {p}), 6) AS {n}"
    return f"SELECT '{name}' AS slice, COUNT(*) AS n_days, ROUND(AVG(delta_f), 6) AS delta_mean, {q(0.5, 'delta_median')}, {q(0.1, 'delta_p10')}, {q(0.25, 'delta_p25')}, {q(0.75, 'delta_p75')}, {q(0.9, 'delta_p90')}, ROUND(AVG((delta_f = 0)::INT::DOUBLE), 6) AS share_equal, ROUND(AVG((delta_f > 0)::INT::DOUBLE), 6) AS share_other_warmer, ROUND(AVG((delta_f < 0)::INT::DOUBLE), 6) AS share_base_warmer, ROUND(AVG(disagree::INT::DOUBLE), 6) AS disagree_frac, {m} FROM ({PAIR}) p WHERE {where}"


@query("agg_bas", " UNION ALL ".join(_slices("TRUE" if n == "overall" else f"season = '{n}'", n, n == "overall") for n in ("overall", *jobs.SEASONS)))
def agg_bas(s, d):
    return rounded(jobs.basis(pairs(s, d)))


@query("agg_midd", f"SELECT slice, disagree_frac_middle, middle_p10, middle_p90 FROM ({_slices('TRUE', 'overall', True)}) x")
def agg_midd(s, d):
    return rounded(jobs.basis(pairs(s, d)).where("slice = 'overall'").select("slice", "disagree_frac_middle", "middle_p10", "middle_p90"))


BYMX = f"SELECT base_f, COUNT(*) AS n_days, ROUND(AVG(disagree::INT::DOUBLE), 6) AS disagree_frac, ROUND(quantile_cont(delta_f, 0.5), 6) AS delta_median FROM ({PAIR}) p GROUP BY base_f"


@query("agg_bymx", BYMX)
def agg_bymx(s, d):
    return rounded(jobs.disagreement_by_max(pairs(s, d)))


@query("top_dis", f"SELECT * FROM ({BYMX}) t WHERE n_days >= 10 OR (SELECT MAX(n_days) FROM ({BYMX}) u) < 10 ORDER BY disagree_frac DESC, base_f LIMIT 8")
def top_dis(s, d):
    return rounded(jobs.top_disagreement(jobs.disagreement_by_max(pairs(s, d))))


CLK = f"SELECT l.day, l.time_raw, l.high_raw, c.minutes, l.day * 86400 + 18000 + c.minutes * 60 AS lst, l.day * 86400 + c.minutes * 60 - {off('l.day * 86400 + 61200')} AS ldt FROM v_labels l JOIN v_clock c ON c.day = l.day"
OUT = lambda x: f"NOT ({x} >= k.day * 86400 + 43200 AND {x} < k.day * 86400 + 108000)"


@query("prj_clk", "SELECT day, minutes AS out FROM v_clock")
def prj_clk(s, d):
    return rounded(labels(s, d).select("day", time.clock_minutes(COL("time_raw")).alias("out")))


@query("prj_inst", f"SELECT day, lst, ldt FROM ({CLK}) k")
def prj_inst(s, d):
    m = time.clock_minutes(COL("time_raw"))
    return labels(s, d).select("day", time.clock_instant(COL("day"), m, "lst").alias("lst"), time.clock_instant(COL("day"), m, "ldt").alias("ldt"))


@query("prj_reg", "SELECT ticker, CAST(horizon_h AS BIGINT) AS horizon_h, regime, regime_uncertain FROM v_snapshots")
def prj_reg(s, d):
    from skyledger.plans.market_queries import snaps

    return rounded(snaps(s, d).select("ticker", "horizon_h", "regime", "regime_uncertain"))


@query("prj_nbmw", f"SELECT k.day, {OUT('k.lst')} AS out FROM ({CLK}) k")
def prj_nbmw(s, d):
    return jobs.hypotheses(labels(s, d)).where("convention = 'lst'").select("day", COL("outside").alias("out"))


SEAS = "JOIN (SELECT DISTINCT day, season FROM v_season) n ON n.day = k.day"
MISM = f"SELECT season, convention, COUNT(*) AS n, ROUND(AVG(o::INT::DOUBLE), 6) AS mismatch_rate FROM (SELECT n.season, 'lst' AS convention, {OUT('k.lst')} AS o FROM ({CLK}) k {SEAS} WHERE k.lst IS NOT NULL UNION ALL SELECT n.season, 'ldt', {OUT('k.ldt')} FROM ({CLK}) k {SEAS} WHERE k.ldt IS NOT NULL) x GROUP BY 1, 2"


@query("agg_mism", MISM)
def agg_mism(s, d):
    return rounded(jobs.mismatch(labels(s, d)))


@query("gate_conv", MISM.replace("season, convention, COUNT", "convention, COUNT").replace("GROUP BY 1, 2", "GROUP BY 1"))
def gate_conv(s, d):
    """With an unknown clock there is no headline; both readings are given."""
    rows = jobs.hypotheses(labels(s, d)).where("instant is not null")
    return rounded(rows.groupBy("convention").agg(F.count("*").alias("n"), jobs.share(COL("outside")).alias("mismatch_rate")))


@query("set_union", f"SELECT day, 'lst' AS convention, lst AS instant FROM ({CLK}) k UNION ALL SELECT day, 'ldt', ldt FROM ({CLK}) k")
def set_union(s, d):
    return jobs.hypotheses(labels(s, d)).select("day", "convention", "instant")


K2 = f"SELECT k.day, n.season, CAST(round_even(TRY_CAST(k.high_raw AS DOUBLE), 0) AS BIGINT) AS label_f, CAST(round_even(o.max_f, 0) AS BIGINT) AS station_f, COALESCE({OUT('k.lst')}, FALSE) AS outside_lst, COALESCE({OUT('k.ldt')}, FALSE) AS outside_ldt, {OUT('o.max_ts')} AS station_outside FROM ({CLK}) k JOIN ({MAXQ}) o ON o.day = k.day AND o.station = 'NYC' {SEAS} WHERE TRIM(k.time_raw) <> ''"
K2D = f"SELECT *, station_f - label_f AS delta_f, {even('label_f')} <> {even('station_f')} AS disagree FROM ({K2}) k2"


def k2(s, d):
    return jobs.label_days(labels(s, d), maxima(s, d).where("station = 'NYC'"))


@query("jn_obsd", K2D)
def jn_obsd(s, d):
    return rounded(k2(s, d).select("day", "season", "label_f", "station_f", "outside_lst", "outside_ldt", "station_outside", "delta_f", "disagree"))


def _k2s(name: str, group: str) -> str:
    q = lambda f, n: f"ROUND(quantile_cont(CASE WHEN {f} THEN delta_f END, 0.5), 6) AS {n}"
    a = lambda x, n: f"ROUND(AVG({x}::INT::DOUBLE), 6) AS {n}"
    return f"SELECT {name} AS season, COUNT(*) AS n_days, {a('outside_lst', 'rate_lst')}, {a('outside_ldt', 'rate_ldt')}, {a('station_outside', 'rate_station')}, {a('disagree', 'disagree_rate')}, {q('outside_lst', 'delta_when_lst')}, {q('outside_ldt', 'delta_when_ldt')}, {q('station_outside', 'delta_when_station')}, {a('CASE WHEN outside_lst THEN disagree END', 'disagree_when_lst')}, {a('CASE WHEN station_outside THEN disagree END', 'disagree_when_station')} FROM ({K2D}) z {group}"


@query("agg_k2", _k2s("season", "GROUP BY season") + " UNION ALL " + _k2s("'ALL'", ""))
def agg_k2(s, d):
    return rounded(jobs.conditional_summary(k2(s, d)))


CLKB = f"SELECT k.day, 'est' AS dst_status, ROUND(ABS(o.max_ts - k.lst) / 60e0, 1) AS delta_lst, ROUND(ABS(o.max_ts - k.ldt) / 60e0, 1) AS delta_ldt FROM ({CLK}) k JOIN ({MAXQ}) o ON o.day = k.day AND o.station = 'NYC' WHERE k.lst IS NOT NULL OR k.ldt IS NOT NULL"


def clk(s, d):
    return jobs.clock_table(labels(s, d), maxima(s, d).where("station = 'NYC'"))


@query("agg_clkb", f"SELECT dst_status, COUNT(*) AS n, " + ", ".join(f"ROUND(quantile_cont({c}, 0.5), 6) AS {c}_median, ROUND(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS {c}_iqr" for c in ("delta_lst", "delta_ldt")) + f" FROM ({CLKB}) x GROUP BY 1")  # noqa: F541
def agg_clkb(s, d):
    return rounded(jobs.clock_summary(clk(s, d)))


@query("agg_clkb_hist", f"SELECT dst_status, CAST(FLOOR(delta_lst / 5) * 5 AS BIGINT) AS bin, COUNT(*) AS n FROM ({CLKB}) x GROUP BY 1, 2")
def agg_clkb_hist(s, d):
    return rounded(jobs.clock_histogram(clk(s, d)))


@query("prj_high", "SELECT day, k, TRY_CAST(high_raw AS DOUBLE) AS out FROM (SELECT day, CAST(k AS BIGINT) AS k, high_raw FROM v_issuances) x")
def prj_high(s, d):
    return rounded(frame(s, d, "v_issuances").select("day", "k", weather.label_high(COL("high_raw")).alias("out")))


DATES = "SELECT day, climate_date FROM v_days"
SC = {
    "prj_wf": ("SELECT event_id, tmpf FROM v_obs", lambda: weather.whole(COL("tmpf") + 0.5), "CAST(round_even(tmpf + 0.5, 0) AS BIGINT)"),
    "prj_brk": ("SELECT event_id, CAST(tmpf AS INT) AS f FROM v_obs", lambda: weather.even_bracket(COL("f")), even("f")),
    "prj_k2f": ("SELECT event_id, tmpf + 200 AS k FROM v_obs", lambda: F.round(weather.kelvin_f(COL("k")), 6), "ROUND((k - 273.15) * 9e0 / 5e0 + 32e0, 6)"),
    "prj_era": (DATES, lambda: time.era(COL("climate_date").cast("date"), 1995), "CASE WHEN CAST(substr(climate_date, 1, 4) AS INT) <= 1995 THEN '1995_early' ELSE '1996_plus' END"),
    "prj_seas": (DATES, lambda: time.season(COL("climate_date").cast("date")), "CASE WHEN CAST(substr(climate_date, 6, 2) AS INT) IN (12, 1, 2) THEN 'DJF' WHEN CAST(substr(climate_date, 6, 2) AS INT) <= 5 THEN 'MAM' WHEN CAST(substr(climate_date, 6, 2) AS INT) <= 8 THEN 'JJA' ELSE 'SON' END"),
    "prj_subera": (DATES, lambda: weather.sub_era(COL("climate_date").cast("date"), "1996-05-15"), "CASE WHEN climate_date < '1996-05-15' THEN 'early' ELSE 'late' END"),
    "prj_snap": (DATES, lambda: time.day_end(COL("day")) - 24 * 3600, "day * 86400 + 18000"),
}


def _sc(name, view, column, sql):
    key = "event_id" if "event_id" in view else "day"

    @query(name, f"SELECT {key}, {sql} AS out FROM ({view.replace('CAST(tmpf AS INT)', 'CAST(trunc(tmpf) AS BIGINT)')}) x")
    def run(s, d):
        return rounded(frame(s, d, view).select(key, column().alias("out")))


for _name, _x in SC.items():
    _sc(_name, *_x)
