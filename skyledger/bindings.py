"""Views that give the driver's tables market, weather and forecast shapes.

The text of a view is plain arithmetic that Spark and DuckDB both run; the few places where the dialects
differ are the names in braces below.  Times are epoch seconds, days are days since 1970-01-01 of the
fixed UTC-5 climate day.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from skyledger import oracle_views

_SPARK = {
    "div": "div",
    "d0": "CAST(date_from_unix_date(CAST(", "d1": " AS INT)) AS STRING)",
    "k0": "upper(date_format(date_from_unix_date(CAST(", "k1": " AS INT)), 'yyMMMdd'))",
    "e0": "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ", "e1": ")",
    "str": "STRING",
}
_DUCK = {
    "div": "//",
    "d0": "CAST(DATE '1970-01-01' + CAST(", "d1": " AS INTEGER) AS VARCHAR)",
    "k0": "upper(strftime(DATE '1970-01-01' + CAST(", "k1": " AS INTEGER), '%y%b%d'))",
    "e0": "(epoch_us(", "e1": ") // 1000000)",
    "str": "VARCHAR",
}

VIEWS = {
    "v_raw": """
        SELECT event_id, user_id, event_type, value, {e0} ts {e1} AS end_ts, ({e0} ts {e1} - 18000) {div} 86400 AS day FROM events""",
    "v_quotes": """
        SELECT event_id, user_id, day, end_ts, CONCAT('KXHIGHNY-', {k0} day {k1}, '-B', CAST(user_id AS {str}), '.5') AS ticker,
            CASE WHEN event_id % 7 = 0 THEN 0e0 WHEN event_id % 17 = 0 THEN NULL ELSE ((event_id * 7919) % 100) / 1e2 END AS bid,
            CASE WHEN event_id % 7 = 0 THEN 1e0 ELSE LEAST(100, (event_id * 7919) % 100 + (event_id * 104729) % 9 + 1) / 1e2 END AS ask,
            CASE WHEN event_id % 5 = 0 THEN NULL ELSE ((event_id * 31) % 100) / 1e2 END AS trade_close,
            CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(FLOOR(value) AS BIGINT) END AS volume,
            CASE WHEN user_id % 5 = 0 THEN 'live' ELSE 'historical' END AS tier, event_id AS pos
        FROM v_raw""",
    "v_pages": """
        SELECT * FROM v_quotes
        UNION ALL SELECT event_id, user_id, day, end_ts, ticker, bid, ask, trade_close, volume + 1 AS volume, tier, pos + 1000000000 AS pos FROM v_quotes WHERE event_id % 10 = 0""",
    "v_candles": """
        SELECT event_id, user_id, day, end_ts, ticker, bid, ask, trade_close, volume, tier FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, end_ts ORDER BY pos DESC) AS rn FROM v_pages) x WHERE rn = 1""",
    "v_markets": """
        SELECT ticker, MIN(user_id) AS user_id, MIN(day) AS day, {d0} MIN(day) {d1} AS climate_date,
            CASE WHEN MIN(user_id) % 23 = 0 THEN NULL ELSE MIN(day) * 86400 + 18000 - 50400 + 3600 * (MIN(user_id) % 20) END AS open_ts,
            CASE WHEN MIN(user_id) % 29 = 0 THEN NULL ELSE MIN(day) * 86400 + 104400 - 60 - 3600 * (MIN(user_id) % 3) END AS close_ts,
            SUM(volume) + CASE WHEN MIN(user_id) % 11 = 0 THEN 1 ELSE 0 END AS market_volume
        FROM v_candles GROUP BY ticker""",
    "v_issuances": """
        SELECT d.day, {d0} d.day {d1} AS climate_date, k.k, CASE WHEN d.day % 9 = 0 AND k.k = 2 THEN NULL ELSE d.day * 86400 + 104400 + 3600 * k.k - 7200 END AS issuance_ts,
            k.k = 0 AS intermediate,
            CASE WHEN d.day % 8 = 0 THEN 'MM' WHEN d.day % 10 = 0 THEN '' ELSE CAST(40 + (d.day * 7 + k.k) % 55 AS {str}) END AS high_raw,
            CASE WHEN d.day % 6 = 0 THEN '' WHEN d.day % 6 = 1 THEN CONCAT(CAST(d.day % 12 + 1 AS {str}), ' PM') ELSE CONCAT(CAST(d.day % 12 + 1 AS {str}), CASE WHEN d.day % 2 = 0 THEN '05' ELSE '47' END, CASE WHEN d.day % 5 = 0 THEN ' AM' ELSE ' PM' END) END AS time_raw
        FROM (SELECT DISTINCT day FROM v_raw) d CROSS JOIN (VALUES (0), (1), (2)) k(k)""",
    "v_labels": """
        SELECT day, climate_date, issuance_ts, high_raw, time_raw FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY day ORDER BY COALESCE(issuance_ts, -1) DESC) AS rn FROM v_issuances WHERE NOT intermediate) x WHERE rn = 1""",
    "v_obs": """
        SELECT event_id, CASE WHEN event_type IN ('view', 'signup') THEN 'NYC' ELSE 'LGA' END AS station, end_ts AS valid_ts, day,
            CASE WHEN event_id % 19 = 0 THEN NULL ELSE 60 + (event_id * 31 % 400) / 1e1 END AS tmpf
        FROM v_raw""",
    "v_levels": """
        SELECT q.event_id, q.ticker, q.day, q.end_ts, s.side, l.l AS lvl,
            (CASE WHEN s.side = 'yes' THEN (q.event_id * 7919) % 100 ELSE 99 - LEAST(99, (q.event_id * 7919) % 100 + (q.event_id * 104729) % 5) END - l.l) AS cents,
            ((q.event_id * 13 + l.l * 7 + CASE WHEN s.side = 'yes' THEN 3 ELSE 0 END) % 500 + 1) AS size
        FROM v_quotes q CROSS JOIN (VALUES ('yes'), ('no')) s(side) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) l(l)
        WHERE (CASE WHEN s.side = 'yes' THEN (q.event_id * 7919) % 100 ELSE 99 - LEAST(99, (q.event_id * 7919) % 100 + (q.event_id * 104729) % 5) END - l.l) > 0""",
    "v_days": """
        SELECT day, {d0} day {d1} AS climate_date, n, mn, mx FROM (
            SELECT ({e0} o_orderdate {e1}) {div} 86400 AS day, COUNT(*) AS n, MIN(o_orderkey) AS mn, MAX(o_orderkey) AS mx FROM orders GROUP BY 1) x""",
    "v_strikes": """
        SELECT CONCAT('KXHIGHNY-', {k0} 19700 + p_partkey % 150 {k1}, '-', CASE WHEN p_partkey % 6 IN (0, 1) THEN 'T' ELSE 'B' END, CAST(p_size + 40 AS {str}), CASE WHEN p_partkey % 6 = 5 AND (p_partkey % 150) > 75 THEN '' WHEN p_partkey % 6 IN (0, 1) THEN '' ELSE '.5' END) AS ticker,
            19700 + p_partkey % 150 AS day, {d0} 19700 + p_partkey % 150 {d1} AS climate_date, p_partkey, p_size,
            CASE p_partkey % 6 WHEN 0 THEN 'less' WHEN 1 THEN 'greater' WHEN 2 THEN 'structured' ELSE 'between' END AS strike_type,
            CASE WHEN p_partkey % 6 IN (0, 2) THEN NULL ELSE p_size + 40 END AS floor_strike,
            CASE WHEN p_partkey % 6 IN (1, 2) THEN NULL ELSE p_size + 41 + CASE WHEN (p_partkey % 150) > 90 THEN 1 ELSE 0 END END AS cap_strike,
            CASE WHEN p_partkey % 12 = 2 THEN CONCAT(CAST(p_size + 40 AS {str}), '° to ', CAST(p_size + 41 AS {str}), '°') WHEN p_partkey % 12 = 8 THEN CONCAT(CAST(p_size AS {str}), '° or above') ELSE p_name END AS subtitle
        FROM part""",
    "v_polls": """
        SELECT event_id, end_ts, event_type AS endpoint, CONCAT('T', CAST(user_id AS {str})) AS ticker, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS BIGINT) AS ok, CAST(FLOOR(value) AS BIGINT) AS latency_ms FROM v_raw""",
    "v_cycles": """
        SELECT d.day, {d0} d.day {d1} AS climate_date, d.day * 86400 + 104400 - 86400 AS snapshot_ts FROM (SELECT DISTINCT day FROM v_raw) d""",
    "v_watch": """
        SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'aws' ELSE 'nomads' END AS source, day * 86400 + CASE WHEN user_id % 4 < 2 THEN 0 ELSE 43200 END AS nominal_ts,
            CASE WHEN user_id % 4 < 2 THEN 30 ELSE 18 END AS fhour, end_ts AS probe_ts, CASE WHEN (end_ts - day * 86400) > 25200 + 600 * (user_id % 7) THEN 200 ELSE 404 END AS http_status,
            CASE WHEN event_id % 3 = 0 THEN NULL ELSE day * 86400 + 30000 + 60 * (event_id % 90) END AS modified_ts
        FROM v_raw""",
    "v_inventory": """
        SELECT p_partkey {div} 40 AS file_id, p_partkey % 40 AS pos, (p_partkey % 40) * 100000 + p_size * 100 AS byte_offset,
            CONCAT(CAST(p_partkey % 40 + 1 AS {str}), ':', CAST((p_partkey % 40) * 100000 + p_size * 100 AS {str}), ':d=2024', CASE WHEN p_size % 2 = 0 THEN '010100' ELSE '021512' END, ':TMP:2 m above ground:',
                CASE WHEN p_partkey % 40 < 22 THEN '12-30 hour max fcst:' WHEN p_partkey % 40 < 30 THEN '30-48 hour max fcst:' ELSE '24-30 hour max fcst:' END,
                CASE WHEN p_partkey % 3 = 0 THEN CONCAT(CAST((p_partkey % 40) * 5 % 100 AS {str}), '% level') WHEN p_partkey % 3 = 1 THEN CONCAT('P', CAST((p_partkey % 40) * 10 % 100 AS {str}), '% level') ELSE 'ens std dev' END) AS line
        FROM part""",
}
_ALL = VIEWS | oracle_views.VIEWS
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def with_views(text: str, dialect: dict[str, str], given: dict[str, str] | None = None) -> str:
    """The query with the views it uses, and those that they use, before it; `given` has other names for some."""
    needed: dict[str, str] = {}

    def put(body: str) -> str:
        for name, own in (given or {}).items():
            body = re.sub(rf"\b{name}\b", own, body)
        for name in re.findall(r"\bv_\w+", body):
            if name in _ALL and name not in needed:
                needed[name] = put(_ALL[name].strip())
        return body

    body = put(text.strip())
    head = ",\n".join(f"{name} AS ({sql})" for name, sql in needed.items())
    if needed:
        body = f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"
    for name, word in dialect.items():
        body = body.replace("{" + name + "}", word)
    return body


def duck(text: str) -> str:
    return with_views(text, _DUCK)


def frame(spark: SparkSession, sf_dir: str, text: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """The query over the tables of a folder, in Spark; a bare view name is all of it.

    `given` has rows that stand for a view, where they have been worked out before.
    """
    own = {name: f"given_{uuid.uuid4().hex}" for name in given or {}}
    for name, rows in (given or {}).items():
        rows.createOrReplaceTempView(own[name])
    full = with_views(text if " " in text.strip() else f"SELECT * FROM {text}", _SPARK, own)
    for name in _TABLES:
        if re.search(rf"\b{name}\b", full):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    out = spark.sql(full)
    for name in own.values():  # the frame holds what it reads; the names were for the text alone
        spark.catalog.dropTempView(name)
    return out
