"""Registered queries of the streams: captures made from the bound views, landed as files, streamed to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.bindings import frame
from skyledger.operators.ordered import latest
from skyledger.plans.forecast_queries import HB, WATCH
from skyledger.plans.market_queries import CHG, r, rounded
from skyledger.registry import query
from skyledger.sources.bronze import scratch, written
from skyledger.streaming import streams

COL = F.col


def land(s, *parts):
    """The parts one after another as files of a folder."""
    path = scratch(s)
    for part in parts:
        part.write.mode("append").parquet(path)
    return path, parts[0].schema


@query("str_hb", HB.replace("{w}", ""))
def str_hb(s, d):
    rows = frame(s, d, "SELECT end_ts, endpoint, ok FROM v_polls")
    path, schema = land(s, rows.where("end_ts < 1705500000"), rows.where("end_ts >= 1705500000"))
    return streams.run_heartbeat(s, path, schema)


TRADES = "SELECT event_id AS trade_id, end_ts, user_id FROM v_raw"


@query("str_dedup", TRADES)
def str_dedup(s, d):
    """Pages that overlap by a third, in two runs with a restart between."""
    rows = frame(s, d, TRADES)
    path, schema = land(s, rows.where("trade_id % 3 < 2"))
    out, checkpoint = scratch(s), scratch(s)
    for part in (None, rows.where("trade_id % 3 > 0")):
        if part is not None:
            part.write.mode("append").parquet(path)
        streams.to_table(streams.deduplicated(streams.landed(s, path, schema)), out, checkpoint)
    return s.read.parquet(out)


@query("str_sink", "SELECT event_id, endpoint, ok FROM v_polls")
def str_sink(s, d):
    rows = frame(s, d, "SELECT event_id, endpoint, ok FROM v_polls")
    path, schema = land(s, rows.where("event_id % 2 = 0"))
    out, checkpoint = scratch(s), scratch(s)
    streams.to_table(streams.landed(s, path, schema), out, checkpoint)
    rows.where("event_id % 2 = 1").write.mode("append").parquet(path)
    streams.to_table(streams.landed(s, path, schema), out, checkpoint)
    streams.to_table(streams.landed(s, path, schema), out, checkpoint)
    return s.read.parquet(out)


def clock(rows, ts, **key):
    """A row long after the others, as of a poller that goes on: it moves the watermark past them."""
    last = rows.agg((F.max(ts) + 40 * 86400).alias(ts))
    given = {c: F.lit(v) for c, v in key.items()} | {ts: COL(ts)}
    return last.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])


@query("str_book", f"SELECT ticker, end_ts, {r('bid', 'ask')} FROM ({CHG.replace('{v}', 'v_candles')}) y")
def str_book(s, d):
    """Captures that land out of order: two batches that each hold half of all times, then a later row, with a restart between."""
    rows = written(frame(s, d, "SELECT ticker, end_ts, bid, ask FROM v_candles"))
    late = F.pmod(F.xxhash64("ticker", "end_ts"), F.lit(2)) == 1
    path, schema = land(s, rows.where(late))
    out, checkpoint = scratch(s), scratch(s)
    for part in (rows.where(~late), clock(rows, "end_ts", ticker="clock")):
        with streams.timed_state(s):
            streams.to_table(streams.changes(streams.landed(s, path, schema), "60 days"), out, checkpoint)
        part.write.mode("append").parquet(path)
    with streams.timed_state(s):
        streams.to_table(streams.changes(streams.landed(s, path, schema), "1 day"), out, checkpoint)
    return rounded(s.read.parquet(out))


@query("str_avail", f"SELECT source, nominal_ts, CAST(fhour AS BIGINT) AS fhour, status, {r('first_min', 'modified_min')} FROM ({WATCH}) w")
def str_avail(s, d):
    """Probes that land out of order over three batches; ends come out as the watermark passes."""
    rows = frame(s, d, "SELECT source, nominal_ts, CAST(fhour AS BIGINT) AS fhour, event_id AS probe_id, probe_ts, CAST(http_status AS BIGINT) AS http_status, modified_ts FROM v_watch")
    some, n = F.pmod(F.xxhash64("probe_id"), F.lit(3)), s.sparkContext.defaultParallelism
    # As many files a batch as tasks write, so that there are as many batches whatever the rows.
    path, schema = land(s, *[rows.where(some == i).repartition(n, "probe_id") for i in range(3)], clock(rows, "probe_ts", source="clock", nominal_ts=0, fhour=0, probe_id=0).coalesce(1))
    with streams.timed_state(s):
        found = streams.latest_updates(s, streams.availability(streams.landed(s, path, schema, n), "35 days"), ["source", "nominal_ts", "fhour"], scratch(s), scratch(s))
    return rounded(found.where("source <> 'clock'"))


SWEEP = "SELECT DISTINCT day AS sweep, day % 7 <> 3 AS complete, user_id FROM v_raw"


@query("str_open", "SELECT n.nd AS sweep, a.user_id FROM (SELECT DISTINCT day, user_id FROM v_raw) a JOIN (SELECT day, LEAD(day) OVER (ORDER BY day) AS nd FROM (SELECT DISTINCT day FROM v_raw WHERE day % 7 <> 3) d) n ON n.day = a.day WHERE n.nd IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_raw c WHERE c.day = n.nd AND c.user_id = a.user_id)")
def str_open(s, d):
    """A sweep each day, some cut short, landed in two parts with a restart between; what is gone at the next complete one is dropped."""
    rows = frame(s, d, SWEEP)
    root, path = scratch(s), scratch(s)
    for part in (rows.where("sweep < 19745"), rows.where("sweep >= 19745")):
        part.repartition("sweep").write.mode("append").parquet(path)
        gone, _ = streams.run_open_set(s, streams.landed(s, path, rows.schema), root, "user_id")
    return gone.select("sweep", "user_id")


@query("str_lad", "SELECT user_id, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY end_ts DESC, event_id DESC) AS rn FROM v_raw) x WHERE rn = 1")
def str_lad(s, d):
    """The active row of each key after all batches; a batch without rows leaves what was."""
    rows = frame(s, d, "SELECT user_id, event_id, end_ts FROM v_raw")
    path, schema = land(s, rows.where("end_ts < 1705500000"), rows.where("end_ts >= 1705500000"), rows.where("end_ts < 0"))
    table = streams.StateTable(s, scratch(s), schema, ["user_id"], ["end_ts", "event_id"], every=2)
    # Of a batch one row a key goes to the table.
    streams.each_batch(streams.landed(s, path, schema, 2), lambda df, n: table.put(latest(df, ["user_id"], ["end_ts", "event_id"]), n), scratch(s), "append")
    return table.rows().select("user_id", "event_id")
