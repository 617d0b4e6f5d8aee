"""Views that only the SQL for DuckDB uses: the middle steps of the larger jobs, written a second time in SQL."""

from __future__ import annotations

VIEWS = {
    "v_clock": """
        SELECT day, CASE WHEN d = '' THEN NULL ELSE (CASE WHEN LENGTH(d) <= 2 THEN CAST(d AS BIGINT) % 12 ELSE (CAST(d AS BIGINT) // 100) % 12 END) * 60 + (CASE WHEN LENGTH(d) <= 2 THEN 0 ELSE CAST(d AS BIGINT) % 100 END) + CASE WHEN h = 'PM' THEN 720 ELSE 0 END END AS minutes
        FROM (SELECT day, regexp_extract(time_raw, '^(\\d+) (AM|PM)$', 1) AS d, regexp_extract(time_raw, '^(\\d+) (AM|PM)$', 2) AS h FROM v_labels) x""",
    "v_season": """
        SELECT DISTINCT day, climate_date, CASE WHEN CAST(substr(climate_date, 6, 2) AS INTEGER) IN (12, 1, 2) THEN 'DJF' WHEN CAST(substr(climate_date, 6, 2) AS INTEGER) <= 5 THEN 'MAM' WHEN CAST(substr(climate_date, 6, 2) AS INTEGER) <= 8 THEN 'JJA' ELSE 'SON' END AS season,
            CASE WHEN CAST(substr(climate_date, 1, 4) AS INTEGER) <= 2021 THEN '2021_early' ELSE '2022_plus' END AS era FROM (SELECT DISTINCT day, climate_date FROM v_markets UNION SELECT day, climate_date FROM v_days) z""",
    "v_grid": """
        SELECT m.*, h.h AS horizon_h, m.day * 86400 + 104400 - h.h * 3600 AS snap_ts FROM v_markets m CROSS JOIN (VALUES (48), (36), (24), (12), (6), (3), (1)) h(h)""",
    "v_snapshots": """
        SELECT g.ticker, g.day, g.climate_date, g.horizon_h, g.snap_ts, s.season, s.era,
            CASE WHEN l.day IS NULL OR c.minutes IS NULL THEN NULL WHEN g.snap_ts < g.day * 86400 + 18000 + c.minutes * 60 THEN 'pre_max' ELSE 'post_max' END AS regime,
            CASE WHEN l.day IS NULL OR c.minutes IS NULL THEN TRUE ELSE ABS(g.snap_ts - (g.day * 86400 + 18000 + c.minutes * 60)) <= 3600 END AS regime_uncertain,
            q.end_ts IS NOT NULL AND g.snap_ts - q.end_ts <= 900 AS quote_valid, q.end_ts IS NOT NULL AND g.snap_ts - q.end_ts > 900 AS stale,
            q.end_ts IS NOT NULL AND g.snap_ts - q.end_ts <= 900 AND COALESCE(q.bid >= 0.01 AND q.ask <= 0.99, FALSE) AS two_sided,
            q.bid IS NOT NULL AND q.ask IS NOT NULL AS book_present,
            q.end_ts IS NOT NULL AND g.snap_ts - q.end_ts <= 900 AND q.bid IS NOT NULL AND q.ask IS NOT NULL AND NOT COALESCE(q.bid >= 0.01 AND q.ask <= 0.99, FALSE) AS extreme_empty_book,
            COALESCE(g.snap_ts >= g.open_ts, TRUE) AND COALESCE(g.snap_ts <= g.close_ts, TRUE) AS in_window, g.open_ts IS NOT NULL AND g.close_ts IS NOT NULL AS window_known,
            q.end_ts IS NOT NULL AS quote_present, g.snap_ts - q.end_ts AS quote_age,
            COALESCE(q.bid >= 0.01 AND q.ask <= 0.99, FALSE) AS two_sided_cf,
            CASE WHEN q.bid >= 0.01 AND q.ask <= 0.99 THEN (q.bid + q.ask) / 2 END AS mid_cf, CASE WHEN q.bid >= 0.01 AND q.ask <= 0.99 THEN q.ask - q.bid END AS spread_cf,
            CASE WHEN g.snap_ts - q.end_ts <= 900 AND q.bid >= 0.01 AND q.ask <= 0.99 THEN (q.bid + q.ask) / 2 END AS mid, CASE WHEN g.snap_ts - q.end_ts <= 900 AND q.bid >= 0.01 AND q.ask <= 0.99 THEN q.ask - q.bid END AS spread,
            q.volume
        FROM v_grid g ASOF LEFT JOIN v_candles q ON g.ticker = q.ticker AND g.snap_ts >= q.end_ts
        LEFT JOIN v_labels l ON l.day = g.day LEFT JOIN v_clock c ON c.day = g.day JOIN v_season s ON s.day = g.day""",
    "v_tagged": """
        SELECT s.*, b.band, s.in_window AND s.two_sided_cf AND COALESCE(s.mid_cf BETWEEN b.lo AND b.hi, FALSE) AS band_cf, s.in_window AND s.two_sided AND COALESCE(s.mid BETWEEN b.lo AND b.hi, FALSE) AS band_15
        FROM v_snapshots s CROSS JOIN (VALUES ('10_90', 0.1e0, 0.9e0), ('20_80', 0.2e0, 0.8e0)) b(band, lo, hi)""",
    "v_traded": """
        SELECT c.*, m.close_ts, (m.close_ts - c.end_ts) / 3600e0 AS hours, COALESCE(CASE WHEN c.bid >= 0.01 AND c.ask <= 0.99 THEN (c.bid + c.ask) / 2 END, c.trade_close) AS px
        FROM v_candles c JOIN v_markets m ON m.ticker = c.ticker WHERE c.volume > 0 AND COALESCE(c.end_ts >= m.open_ts, TRUE) AND COALESCE(c.end_ts <= m.close_ts, TRUE)""",
    "v_marketdays": """
        SELECT m.ticker, m.day, m.climate_date, s.season, s.era, b.band, COALESCE(SUM(t.volume), 0) AS contracts_traded, COALESCE(SUM(t.volume * t.px), 0e0) AS premium_traded, COUNT(t.ticker) AS active_minutes,
            COALESCE(SUM(t.volume) FILTER (t.hours <= 1), 0) / NULLIF(SUM(t.volume), 0) AS share_last_1h, COALESCE(SUM(t.volume) FILTER (t.hours <= 3), 0) / NULLIF(SUM(t.volume), 0) AS share_last_3h, COALESCE(SUM(t.volume) FILTER (t.hours <= 6), 0) / NULLIF(SUM(t.volume), 0) AS share_last_6h
        FROM v_markets m CROSS JOIN (VALUES ('10_90'), ('tails'), ('all')) b(band) JOIN v_season s ON s.day = m.day
        LEFT JOIN v_traded t ON t.ticker = m.ticker AND (b.band = 'all' OR b.band = CASE WHEN t.px BETWEEN 0.1e0 AND 0.9e0 THEN '10_90' WHEN t.px IS NOT NULL THEN 'tails' END)
        GROUP BY ALL""",
    "v_conc": """
        SELECT climate_date, COUNT(*) AS n_brackets_with_volume, MAX(contracts_traded) / SUM(contracts_traded) AS top_bracket_share FROM v_marketdays WHERE band = '10_90' AND contracts_traded > 0 GROUP BY 1""",
    "v_climatedays": """
        SELECT d.climate_date, d.season, d.era, d.band, SUM(premium_traded) AS premium_day, SUM(contracts_traded) AS contracts_day, COUNT(DISTINCT ticker) AS n_brackets, AVG(share_last_1h) AS share_last_1h, AVG(share_last_3h) AS share_last_3h, AVG(share_last_6h) AS share_last_6h,
            COALESCE(ANY_VALUE(c.n_brackets_with_volume), 0) AS n_brackets_with_volume, ANY_VALUE(c.top_bracket_share) AS top_bracket_share
        FROM v_marketdays d LEFT JOIN v_conc c ON c.climate_date = d.climate_date GROUP BY d.climate_date, d.season, d.era, d.band""",
    "v_recon": """
        SELECT m.ticker, s.tier, m.market_volume, COALESCE(s.s, 0) AS candle_sum, COALESCE(s.m, 0) AS candle_max, COALESCE(s.s, 0) - m.market_volume AS difference, COALESCE(s.s, 0) = m.market_volume AS sum_matches, COALESCE(s.m, 0) = m.market_volume AS max_matches
        FROM v_markets m JOIN (SELECT ticker, tier, SUM(volume) AS s, MAX(volume) AS m FROM v_candles GROUP BY 1, 2) s ON s.ticker = m.ticker WHERE m.market_volume IS NOT NULL""",
    "v_emptying": """
        SELECT *, NOT two AND bid IS NOT NULL AS is_empty, NOT two AND bid IS NOT NULL AND COALESCE(LAG(two) OVER (PARTITION BY ticker ORDER BY end_ts), FALSE) AS transition
        FROM (SELECT *, COALESCE(bid >= 0.01 AND ask <= 0.99, FALSE) AS two FROM v_candles) x""",
    "v_top": """
        SELECT event_id, ticker, day, end_ts, MAX(cents) FILTER (side = 'yes') / 1e2 AS bid, (100 - MAX(cents) FILTER (side = 'no')) / 1e2 AS ask FROM v_levels GROUP BY 1, 2, 3, 4""",
    "v_depth": """
        SELECT t.event_id, t.ticker, t.day, t.end_ts, t.bid, t.ask, (t.bid + t.ask) / 2 AS mid,
            SUM(size) FILTER (side = 'yes' AND lvl < 1) AS yes_size_1, SUM(size) FILTER (side = 'yes' AND lvl < 2) AS yes_size_2, SUM(size) FILTER (side = 'yes' AND lvl < 3) AS yes_size_3, SUM(size) FILTER (side = 'yes' AND lvl < 5) AS yes_size_5,
            SUM(size) FILTER (side = 'no' AND lvl < 1) AS no_size_1, SUM(size) FILTER (side = 'no' AND lvl < 2) AS no_size_2, SUM(size) FILTER (side = 'no' AND lvl < 3) AS no_size_3, SUM(size) FILTER (side = 'no' AND lvl < 5) AS no_size_5,
            SUM(size * cents) FILTER (side = 'yes' AND lvl < 5) / 1e2 AS dollar_yes_5, SUM(size * cents) FILTER (side = 'no' AND lvl < 5) / 1e2 AS dollar_no_5,
            (SUM(size) FILTER (side = 'yes' AND lvl = 0) - SUM(size) FILTER (side = 'no' AND lvl = 0)) / (SUM(size) FILTER (side = 'yes' AND lvl = 0) + SUM(size) FILTER (side = 'no' AND lvl = 0)) AS imbalance,
            """
    + ", ".join(
        f"COALESCE(SUM({v}) FILTER (near <= {c}), 0){d} AS {n}depth_{c}c" for c in (1, 2, 3, 5) for n, v, d in (("", "size", ""), ("dollar_", "size * px", " / 1e2"))
    )
    + """
        FROM (SELECT l.*, CASE WHEN l.side = 'yes' THEN l.cents ELSE 100 - l.cents END AS px,
                CASE WHEN l.side = 'yes' THEN (ROUND(t.bid * 100) + ROUND(t.ask * 100)) / 2 - l.cents ELSE (100 - l.cents) - (ROUND(t.bid * 100) + ROUND(t.ask * 100)) / 2 END AS near
            FROM v_levels l JOIN v_top t ON t.event_id = l.event_id) l JOIN v_top t ON t.event_id = l.event_id WHERE t.bid IS NOT NULL AND t.ask IS NOT NULL GROUP BY t.event_id, t.ticker, t.day, t.end_ts, t.bid, t.ask""",
}
