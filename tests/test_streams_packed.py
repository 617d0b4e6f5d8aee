"""Rows that wait are packed by frames, and give what rows taken one by one give."""

import random

import pandas as pd

from skyledger.sources.bronze import scratch
from skyledger.streaming import streams

PROBES = "source string, nominal_ts long, fhour long, probe_id long, probe_ts long, http_status long, modified_ts long"


class Store:
    """A state of one bucket that counts what is written to it."""

    def __init__(self):
        self.rows, self.written = [], 0

    def appendList(self, rows):
        self.rows += rows
        self.written += len(rows)

    def put(self, rows):
        self.rows, self.written = rows, self.written + len(rows)

    def update(self, row):
        self.rows = [row]

    def clear(self):
        self.rows = []

    def get(self):
        return self.rows


class Value(Store):
    def get(self):
        return self.rows[0] if self.rows else None


class Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, name, schema):
        return Store()

    def getValueState(self, name, schema):
        return Value()

    def registerTimer(self, at):
        self.timers.append(at)


class At:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def started(processor):
    processor.init(Handle())
    return processor


def test_a_frame_is_one_write(spark):
    p = started(streams.BookChanges(1000))
    frame = pd.DataFrame({"ticker": "a", "end_ts": range(5000), "bid": 0.1, "ask": [i // 2 for i in range(5000)]})
    list(p.handleInputRows(None, iter([frame, frame.assign(ticker="b")]), At(0)))
    assert p.waiting.written == 2
    out = pd.concat(p.handleExpiredTimer(None, At(3000_000), None))
    assert len(out) == 2 * 1499 and p.waiting.written == 3
    out = pd.concat(p.handleExpiredTimer(None, At(9000_000), None))
    assert len(out) == 2 * 1000 and not p.waiting.rows


def test_probes_that_change_nothing_do_not_wait(spark):
    rng, rows = random.Random(5), []
    for i in range(3000):
        rows.append(("aws", 1000, rng.choice([1, 2, 3]), 900 + rng.randrange(2000), i, rng.choice([200, 404, 404, None]), rng.choice([None, 5000 + i])))
    frame = pd.DataFrame(rows, columns=["source", "nominal_ts", "fhour", "probe_ts", "probe_id", "http_status", "modified_ts"])
    p = started(streams.Probes(10**6))
    assert len(p.thinned(frame)) <= 12
    # A watermark that rests between finds each file as it then is.
    for now in (950, 1003, 1400, 5000):
        own, q = frame[frame["probe_ts"] < now], started(streams.Probes(10**6))
        list(q.handleInputRows(None, iter([frame[:1000], frame[1000:2000], frame[2000:]]), At(0)))
        got = {}
        for at in sorted({now - 40, now}):
            for out in q.handleExpiredTimer(None, At(at * 1000), None):
                got |= {r[2]: r[3] for r in out.itertuples(index=False, name=None)}
        for fhour in (1, 2, 3):
            due = own[(own["fhour"] == fhour) & (own["probe_ts"] >= 1000)].sort_values(["probe_ts", "probe_id"])["http_status"].tolist()
            want = "pending" if not due else "waiting" if 200 not in due else "pre_existing" if due[0] == 200 else "complete"
            assert got.get(fhour, "pending") == want


def test_missing_values_and_restarts_over_batches(spark):
    rows = [("aws", 1000, 1, i, 900 + 100 * i, [404, 404, None, 200, 200][i], [None, None, None, 2**53 + 1, 7][i]) for i in range(5)]
    path, out, checkpoint = (scratch(spark) for _ in range(3))
    for part in (rows[3:], rows[:3], [("clock", 0, 0, 0, 10**6, None, None)]):
        spark.createDataFrame(part, PROBES).coalesce(1).write.mode("append").parquet(path)
        with streams.timed_state(spark):
            found = streams.latest_updates(spark, streams.availability(streams.landed(spark, path, PROBES, 1), "1 day"), ["source", "nominal_ts", "fhour"], out, checkpoint)
    row = found.where("source = 'aws'").first()
    assert row["status"] == "complete" and row["first_min"] == 200 / 60 and row["modified_min"] == (2**53 + 1 - 1000) / 60
