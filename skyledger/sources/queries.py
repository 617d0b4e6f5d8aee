"""Registered queries of readers and writers: captures made from the bound views, written and read again."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import functions as F

from skyledger.bindings import frame
from skyledger.functions import time
from skyledger.operators.ordered import latest
from skyledger.plans import market
from skyledger.plans.market_queries import agg_spr, mdays, rounded, snaps, spread_sql
from skyledger.registry import query
from skyledger.sources import bronze, captures
from skyledger.streaming import streams

COL = F.col
#: Rows of a page of a made capture, about, were all rows of one capture.
PAGE_ROWS = 500


def envelope(rows, category, endpoint, payload, ts="end_ts"):
    return rows.select(bronze.utc_text(COL(ts)).alias("ts_utc"), endpoint.alias("endpoint"), F.lit(200).alias("http_status"), F.lit(5).alias("latency_ms"), payload.alias("payload"), F.lit(category).alias("category"))


def landed(s, rows, category):
    path = bronze.scratch(s)
    bronze.write_envelopes(rows, path)
    return bronze.read_envelopes(s, path, category)


def poll_envelopes(s, d):
    rows = frame(s, d, "v_polls")
    return envelope(rows, "polls", COL("endpoint"), F.struct("ticker", (COL("ok") == 1).alias("ok"), "event_id"))


@query("src_env", "SELECT event_id, endpoint, ticker, ok = 1 AS ok, substr({d0} end_ts {div} 86400 {d1}, 1, 10) AS dt FROM v_polls")
def src_env(s, d):
    return landed(s, poll_envelopes(s, d), "polls").select("payload.event_id", "endpoint", "payload.ticker", "payload.ok", "dt")


@query("snk_env", "SELECT {d0} end_ts {div} 86400 {d1} AS dt, COUNT(*) AS n FROM v_polls GROUP BY 1")
def snk_env(s, d):
    return landed(s, poll_envelopes(s, d), "polls").groupBy("dt").agg(F.count("*").alias("n"))


def gzip_files(s, d, members: int = 4):
    """Capture files of 500 polls or fewer, four members each; of every third file the last member is torn in its last line.

    With fewer `members` what the files held some time before.
    """
    rows = frame(s, d, "SELECT event_id, endpoint, event_id {div} 500 AS file_id, day FROM v_polls JOIN (SELECT event_id {div} 500 AS f, MIN(day) AS day FROM v_raw GROUP BY 1) x ON f = event_id {div} 500")
    line = F.to_json(F.struct("event_id", "endpoint"))
    name = F.concat(F.lit("dt="), time.date_text(COL("day")), F.lit("/polls/"), COL("file_id"), F.lit(".jsonl.gz"))
    files = rows.groupBy("file_id", name.alias("name")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x")).select("file_id", "name", F.col("x.line").alias("lines"))

    def run(batches):
        # A file at a time: a batch is thousands of files, many GB as Python strings.
        for one in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            out = []
            for file_id, lines in zip(one.column("file_id").to_pylist(), one.column("lines").to_pylist()):
                cuts = [len(lines) * i // 4 for i in range(5)]
                # A stored member holds its lines as they are, so a cut of a few bytes costs the last line.
                packed = [gzip.compress("".join(x + "\n" for x in lines[a:b]).encode(), 0 if i == 3 else 6, mtime=0) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                out.append(b"".join(packed[:members])[: -12 if file_id % 3 == 0 and members == 4 else None])
            yield pa.RecordBatch.from_arrays([one.column("name"), pa.array(out, pa.binary())], names=["name", "content"])

    return files.mapInArrow(run, "name string, content binary")


def by_file(lines):
    """Each file's lines, the sum of their ids, and whether it is torn."""
    rows = lines.withColumn("r", F.from_json("line", "event_id bigint, endpoint string"))
    file_id = F.regexp_extract("path", r"(\d+)\.jsonl\.gz$", 1).cast("long")
    return rows.groupBy(file_id.alias("file_id")).agg(F.bool_or("torn").alias("torn"), F.count("line").alias("n"), F.sum("r.event_id").alias("ids"))


GZ = "SELECT file_id, file_id % 3 = 0 AS torn, COUNT(*) AS n, CAST(SUM(event_id) AS BIGINT) AS ids FROM (SELECT event_id, event_id {div} 500 AS file_id, ROW_NUMBER() OVER (PARTITION BY event_id {div} 500 ORDER BY event_id DESC) AS back FROM v_polls) x WHERE file_id % 3 <> 0 OR back > 1 GROUP BY 1, 2"


@query("src_gz", GZ)
def src_gz(s, d):
    """Concatenated members with torn tails, as files of the capture source; every complete line counts."""
    path = bronze.scratch(s)
    captures.put_files(gzip_files(s, d), path)
    s.dataSource.register(captures.Captures)
    return by_file(s.read.format("captures").load(path))


@query("src_gz_bytes", GZ)
def src_gz_bytes(s, d):
    """The same files through Spark's own reader of whole files."""
    path = bronze.scratch(s)
    captures.put_files(gzip_files(s, d), path)
    files = s.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl.gz").load(path)
    return by_file(bronze.gzip_lines(files))


@query("src_gz_stream", GZ)
def src_gz_stream(s, d):
    """The same files as a stream in two runs: first with two of the four members, then grown."""
    path, out, checkpoint = bronze.scratch(s), bronze.scratch(s), bronze.scratch(s)
    s.dataSource.register(captures.Captures)
    for members in (2, 4):
        captures.put_files(gzip_files(s, d, members), path)
        streams.to_table(s.readStream.format("captures").option("openDays", 1000).load(path), out, checkpoint)
    return by_file(s.read.parquet(out))


def market_rows(s, d):
    """Each market in two captures; the later has the status `closed` for some, and the volume."""
    return frame(s, d, "SELECT ticker, day, CASE WHEN k = 1 AND user_id % 2 = 0 THEN 'closed' ELSE 'open' END AS status, market_volume + k AS vol, day * 86400 + 3600 * k AS end_ts FROM v_markets CROSS JOIN (VALUES (0), (1)) k(k)")


def paged(rows, key: str):
    """A page number by hash, out of as many pages as all rows would fill: captures come in pages, so none grows with its day."""
    return F.pmod(F.xxhash64(key), F.lit(1 + rows.count() // PAGE_ROWS)).alias("page")


def market_struct():
    return F.struct("ticker", "status", F.lit(None).cast("string").alias("open_time"), F.lit(None).cast("string").alias("close_time"), COL("vol").cast("string").alias("volume_fp"))


@query("src_mkt", "SELECT ticker, CASE WHEN user_id % 2 = 0 THEN 'closed' ELSE 'open' END AS status, CAST(market_volume + 1 AS DOUBLE) AS volume_fp FROM v_markets")
def src_mkt(s, d):
    listed = market_rows(s, d)
    pages = listed.groupBy("day", "end_ts", paged(listed, "ticker")).agg(F.collect_list(market_struct()).alias("markets"))
    rows = envelope(pages, "markets_history", F.lit("/markets"), F.struct("markets", F.lit("").alias("cursor")))
    return rounded(bronze.latest_markets(landed(s, rows, "markets_history")).select("ticker", "status", "volume_fp"))


@query("src_meta", "SELECT ticker, CASE WHEN user_id % 2 = 0 THEN 'closed' ELSE 'open' END AS status FROM v_markets")
def src_meta(s, d):
    """Early captures list markets, later ones hold a single market."""
    rows = market_rows(s, d)
    first = rows.where("end_ts % 86400 = 0").groupBy("day", "end_ts", paged(rows, "ticker")).agg(F.collect_list(market_struct()).alias("markets"))
    none = F.lit(None).cast(bronze.MARKET)
    a = envelope(first, "markets", F.lit("/markets"), F.struct("markets", none.alias("market")))
    b = envelope(rows.where("end_ts % 86400 > 0"), "markets", F.lit("/markets/x"), F.struct(F.lit(None).cast(f"array<{bronze.MARKET}>").alias("markets"), market_struct().alias("market")))
    return bronze.latest_markets(landed(s, a.unionByName(b), "markets")).select("ticker", "status")


def candle_envelopes(s, d):
    """Pages a ticker; the historical tier names its fields without suffix, and some payloads lack the ticker."""
    rows = frame(s, d, "v_quotes")
    text = lambda c: F.when(COL(c).isNotNull(), F.format_number(COL(c), 2))
    live = COL("tier") == "live"
    side = lambda c: F.struct(F.when(live, text(c)).alias("close_dollars"), F.when(~live, text(c)).alias("close"))
    vol = COL("volume").cast("string")
    candle = F.struct(COL("end_ts").cast("double").alias("end_period_ts"), side("bid").alias("yes_bid"), side("ask").alias("yes_ask"), side("trade_close").alias("price"), F.when(live, vol).alias("volume_fp"), F.when(~live, vol).alias("volume"))
    pages = rows.groupBy("ticker", "tier", "user_id", "day").agg(F.collect_list(candle).alias("candlesticks"), F.max("end_ts").alias("end_ts"))
    path = F.concat(F.when(live, F.lit("/series/K/markets/")).otherwise(F.lit("/historical/markets/")), "ticker", F.lit("/candlesticks"))
    return envelope(pages, "candlesticks", path, F.struct(F.when(COL("user_id") % 2 == 0, COL("ticker")).alias("ticker"), "candlesticks"))


CDL = "SELECT ticker, tier, end_ts, ROUND(bid, 6) AS bid, ROUND(ask, 6) AS ask, ROUND(trade_close, 6) AS trade_close, CAST(volume AS DOUBLE) AS volume FROM v_quotes"


def landed_candles(s, d):
    return bronze.exploded_candles(landed(s, candle_envelopes(s, d), "candlesticks"))


@query("src_cdl", CDL)
def src_cdl(s, d):
    return rounded(landed_candles(s, d).drop("pos"))


@query("src_cdlt", "SELECT tier, COUNT(DISTINCT ticker) AS n_tickers, COUNT(*) AS n FROM v_quotes GROUP BY 1")
def src_cdlt(s, d):
    return landed_candles(s, d).groupBy("tier").agg(F.countDistinct("ticker").alias("n_tickers"), F.count("*").alias("n"))


@query("src_cdl1", f"SELECT * FROM ({CDL}) x WHERE ticker = (SELECT MIN(ticker) FROM v_quotes)")
def src_cdl1(s, d):
    first = frame(s, d, "SELECT MIN(ticker) AS t FROM v_quotes")
    rows = landed_candles(s, d)
    return rounded(rows.join(first, rows["ticker"] == first["t"], "left_semi").drop("pos"))


@query("src_book", "SELECT event_id, ROUND(MAX(cents) FILTER (side = 'yes') / 1e2, 6) AS bid, ROUND((100 - MAX(cents) FILTER (side = 'no')) / 1e2, 6) AS ask FROM v_levels WHERE day BETWEEN 19735 AND 19740 GROUP BY 1")
def src_book(s, d):
    """Captures of some days, read with the other days' folders left out."""
    from skyledger.plans.market_queries import books

    rows = books(s, d)
    path = bronze.scratch(s)
    pay = F.struct(F.struct(COL("yes").alias("yes_dollars"), COL("no").alias("no_dollars")).alias("orderbook_fp"))
    out = envelope(rows.withColumn("noon", COL("day") * 86400 + 43200), "orderbook", COL("event_id").cast("string"), pay, ts="noon")
    bronze.write_envelopes(out, path)
    found = bronze.read_envelopes(s, path, "orderbook").where(F.col("dt").between("2024-01-13", "2024-01-18"))
    tops = market.tops(found.select(COL("endpoint").cast("long").alias("event_id"), COL("payload.orderbook_fp.yes_dollars").alias("yes"), COL("payload.orderbook_fp.no_dollars").alias("no")))
    return rounded(tops.select("event_id", "bid", "ask"))


@query("src_obs", "SELECT station, valid_ts - valid_ts % 60 AS valid_ts, ROUND(tmpf, 6) AS tmpf FROM v_obs WHERE tmpf IS NOT NULL")
def src_obs(s, d):
    rows = frame(s, d, "v_obs")
    stamp = F.regexp_replace(F.substring(bronze.utc_text(COL("valid_ts")), 1, 16), "T", " ")
    line = F.concat_ws(",", "station", stamp, F.coalesce(F.format_number("tmpf", 1), F.lit("M")))
    pages = rows.groupBy("station", "day", paged(rows, "event_id")).agg(F.concat_ws("\n", F.lit("station,valid,tmpf"), F.array_join(F.collect_list(line), "\n")).alias("text"), F.max("valid_ts").alias("end_ts"))
    return rounded(bronze.observations(landed(s, envelope(pages, "asos_obs", F.lit("asos"), F.struct("station", "text")), "asos_obs")))


BUL = "SELECT day, climate_date, n, mn, mn % 3 = 0 AS inter FROM v_days"


def bulletin_envelopes(s, d):
    """Captures of 30 days, each day's bulletin in them one after another."""
    rows = frame(s, d, BUL)
    date = F.date_from_unix_date(COL("day").cast("int"))
    names = F.array(*[F.lit(m) for m in ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")])
    after = F.date_add(date, 1)
    month = lambda x: F.element_at(names, F.month(x))
    text = F.concat(
        F.lit("CDUS41 KOKX 050620\nCLINYC\nCLIMATE REPORT\nNATIONAL WEATHER SERVICE\n920 AM EST FRI "), F.substring(month(after), 1, 3), F.lit(" "), F.lpad(F.dayofmonth(after).cast("string"), 2, "0"), F.lit(" "), F.year(after).cast("string"),
        F.lit("\n\nCLIMATE SUMMARY FOR "), month(date), F.lit(" "), F.dayofmonth(date).cast("string"), F.lit(" "), F.year(date).cast("string"),
        F.when(COL("inter"), F.lit("\nVALID TODAY AS OF 0400 PM LOCAL TIME.")).otherwise(F.lit("")), F.lit("\nITEM VALUE (LST)\nTEMPERATURE (F)\n YESTERDAY\n  MAXIMUM   "),
        F.when(COL("mn") % 10 == 0, F.lit("MM \n")).otherwise(F.concat((COL("mn") % 50 + 40).cast("string"), F.lit("    455 PM 99\n"))),
    )
    pages = rows.withColumn("text", text).groupBy(F.floor(COL("day") / 30).alias("m")).agg(F.array_join(F.collect_list("text"), "\n").alias("text"), F.max(COL("day") * 86400).alias("end_ts"))
    return envelope(pages, "cli", F.lit("cli"), F.struct("text", COL("m").cast("string").alias("month")))


@query("src_bul", f"SELECT climate_date, CAST(CASE WHEN mn % 10 = 0 THEN NULL ELSE 40 + mn % 50 END AS BIGINT) AS high_f, CASE WHEN mn % 10 = 0 THEN '' ELSE '455 PM' END AS time_raw, inter AS intermediate, day * 86400 + 9 * 3600 + 1200 + 86400 AS naive_ts FROM ({BUL}) x")
def src_bul(s, d):
    out = bronze.bulletins(landed(s, bulletin_envelopes(s, d), "cli"))
    # The printed zone is New York's; its offset is put back for the comparison.
    from skyledger.functions.time import civil_offset

    return rounded(out.select("climate_date", "high_f", "time_raw", "intermediate", (COL("issuance_ts") + civil_offset(COL("issuance_ts"))).alias("naive_ts")))


@query("gate_cap", "SELECT CAST(day {div} 30 AS {str}) AS source_month, COUNT(*) AS n, COUNT(*) >= 30 AS maybe_cut FROM v_days GROUP BY 1")
def gate_cap(s, d):
    """Of each month's captured text the products, against a limit of 30 a request."""
    return bronze.possibly_cut(landed(s, bulletin_envelopes(s, d), "cli"), 30)


@query("prj_nws", f"SELECT day, naive_ts FROM (SELECT day, day * 86400 + 9 * 3600 + 1200 AS naive_ts FROM ({BUL}) x) y")
def prj_nws(s, d):
    rows = frame(s, d, BUL)
    date = F.date_from_unix_date(COL("day").cast("int"))
    header = F.concat(F.lit("920 AM EDT SUN "), F.element_at(F.array(*[F.lit(m) for m in time.MONTHS]), F.month(date)), F.lit(" "), F.lpad(F.dayofmonth(date).cast("string"), 2, "0"), F.lit(" "), F.year(date).cast("string"))
    at = time.issuance_epoch(header)
    return rows.select("day", (at + time.civil_offset(at)).alias("naive_ts"))


def round_trip(s, df, write, read):
    path = bronze.scratch(s)
    write(df, path)
    return read(path)


ISS = "SELECT day, CAST(k AS BIGINT) AS k, issuance_ts, intermediate, NULLIF(high_raw, '') AS high_raw FROM v_issuances"


def issuances(s, d):
    return rounded(frame(s, d, "v_issuances").select("day", "k", "issuance_ts", "intermediate", F.when(COL("high_raw") != "", COL("high_raw")).alias("high_raw")))


def read_labels(s, path):
    return bronze.read_csv(s, f"{path}/data", "day bigint, k bigint, issuance_ts bigint, intermediate boolean, high_raw string")


@query("snk_lbl", ISS)
def snk_lbl(s, d):
    """All issuances as CSV with notes, read back."""
    return round_trip(s, issuances(s, d), lambda x, p: bronze.write_notes_csv(x, p, ["labels"]), lambda p: read_labels(s, p))


@query("src_lbl", "SELECT day, issuance_ts, NULLIF(high_raw, '') AS high_raw FROM v_labels")
def src_lbl(s, d):
    """The census's labels out of the CSV: of each day the last issuance that covers all of it; notes within the data are passed over."""
    path = bronze.scratch(s)
    bronze.write_notes_csv(issuances(s, d), path, ["labels"])
    s.createDataFrame([("# a note within the data",), ("#,,,,",)], "value string").coalesce(1).write.mode("append").text(f"{path}/data")
    rows = read_labels(s, path).where("day is not null and not intermediate")
    return latest(rows, ["day"], [F.coalesce("issuance_ts", F.lit(-1))]).select("day", "issuance_ts", "high_raw")


@query("snk_csv", spread_sql(False))
def snk_csv(s, d):
    """The census as CSV with notes; read back it is the same table."""
    rows = agg_spr(s, d)
    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return round_trip(s, rows, lambda x, p: bronze.write_notes_csv(x, p, ["the early era is never pooled with the later"]), lambda p: bronze.read_csv(s, f"{p}/data", schema))


LAD = "SELECT day, level, CAST(COUNT(*) AS DOUBLE) AS value_f FROM (SELECT ({e0} o_orderdate {e1}) {div} 86400 AS day, (o_orderkey % 9 + 1) * 10 AS level FROM orders) x GROUP BY 1, 2"


@query("snk_lad", LAD)
def snk_lad(s, d):
    """Ladders by month: some written with other values before, then replaced; one commit tried twice."""
    rows = frame(s, d, LAD).withColumn("part", F.floor(COL("day") / 30).cast("long")).repartition("part")
    table = bronze.DayTable(s, bronze.scratch(s), "part long, day long, level long, value_f double", "part")
    table.put(rows.where("part % 2 = 0").withColumn("value_f", F.lit(-1.0)), "first")
    table.put(rows.where("part % 3 > 0"), "second")
    table.put(rows.where("part % 3 = 0"), "third")
    table.put(rows.withColumn("value_f", F.lit(-2.0)), "second")
    return table.rows().select("day", "level", "value_f")


@query("src_lad", LAD)
def src_lad(s, d):
    """All levels of the ladders out of files of two layouts: older ones have no column for the model."""
    rows = frame(s, d, LAD)
    path = bronze.scratch(s)
    rows.where("day % 2 = 0").write.parquet(f"{path}/a")
    rows.where("day % 2 = 1").withColumn("model", F.lit("qmd")).write.parquet(f"{path}/a", mode="append")
    rows = s.read.schema("day long, level long, value_f double, model string").parquet(f"{path}/a")
    return rows.select("day", "level", "value_f")


@query("snk_poll", "SELECT event_id, endpoint, ok FROM v_polls")
def snk_poll(s, d):
    rows = frame(s, d, "v_polls").select("event_id", "endpoint", "ok")

    def write(x, p):
        x.where("event_id % 2 = 0").write.mode("append").parquet(p)
        x.where("event_id % 2 = 1").write.mode("append").parquet(p)

    return rounded(round_trip(s, rows, write, lambda p: s.read.parquet(p)))


@query("src_poll", "SELECT endpoint, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(latency_ms), 6) AS mean_ms FROM v_polls GROUP BY 1")
def src_poll(s, d):
    rows = round_trip(s, frame(s, d, "v_polls"), lambda x, p: x.write.parquet(p), lambda p: s.read.schema("endpoint string, latency_ms bigint").parquet(p))
    return rounded(rows.groupBy("endpoint").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_ms")))


@query("src_pm", "SELECT CAST(p_partkey {div} 20 AS BIGINT) AS ev, p_name AS slug, p_partkey AS k FROM part WHERE p_partkey % 7 <> 0")
def src_pm(s, d):
    """Second-venue events with nested markets, exploded and filtered to open ones."""
    rows = frame(s, d, "SELECT p_partkey {div} 20 AS ev, p_name AS slug, p_partkey % 7 = 0 AS closed, p_partkey AS k FROM part")
    pages = rows.groupBy("ev").agg(F.collect_list(F.struct("slug", "closed", "k")).alias("markets"), (F.max("k") % 30 * 86400).cast("long").alias("end_ts"))
    path = bronze.scratch(s)
    bronze.write_envelopes(envelope(pages, "pm", F.lit("/events"), F.struct("ev", "markets")), path)
    found = bronze.read_envelopes(s, path, "pm", payload="struct<ev:bigint,markets:array<struct<slug:string,closed:boolean,k:bigint>>>")
    return found.select("payload.ev", F.explode("payload.markets").alias("m")).where("not m.closed").select("ev", "m.slug", "m.k")


@query("snk_rep", "SELECT COUNT(*) AS n, COUNT(CASE WHEN stale THEN 1 END) AS n_stale FROM v_snapshots")
def snk_rep(s, d):
    rows = snaps(s, d).agg(F.count("*").alias("n"), F.count_if("stale").alias("n_stale"))
    return round_trip(s, rows, lambda x, p: x.coalesce(1).write.json(p), lambda p: s.read.schema("n bigint, n_stale bigint").json(p))


@query("snk_ser", "SELECT 'spread_by_horizon' AS series, CAST(horizon_h AS VARCHAR) AS x, ROUND(quantile_cont(spread_cf, 0.5), 6) AS y FROM v_snapshots GROUP BY horizon_h UNION ALL SELECT 'two_sided_by_horizon', CAST(horizon_h AS VARCHAR), ROUND(AVG(two_sided_cf::INT::DOUBLE), 6) FROM v_snapshots GROUP BY horizon_h UNION ALL SELECT 'premium_by_day', climate_date, ROUND(SUM(premium_traded), 6) FROM v_marketdays WHERE band = 'all' GROUP BY climate_date")
def snk_ser(s, d):
    """The series that the charts draw, as one small table."""
    rows = snaps(s, d)
    x = COL("horizon_h").cast("string").alias("x")
    a = rows.groupBy(x).agg(F.percentile("spread_cf", F.lit(0.5)).alias("y")).withColumn("series", F.lit("spread_by_horizon"))
    b = rows.groupBy(x).agg(F.avg(COL("two_sided_cf").cast("double")).alias("y")).withColumn("series", F.lit("two_sided_by_horizon"))
    c = mdays(s, d).where("band = 'all'").groupBy(COL("climate_date").alias("x")).agg(F.sum("premium_traded").alias("y")).withColumn("series", F.lit("premium_by_day"))
    out = rounded(a.unionByName(b).unionByName(c).select("series", "x", "y"))
    return round_trip(s, out, lambda x, p: x.write.parquet(p), lambda p: s.read.parquet(p))
