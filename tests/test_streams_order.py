"""Rows out of order over batches, state that goes, and tables whose reads don't grow with the batches."""

import random

from pyspark.sql import functions as F

from skyledger.sources.bronze import scratch
from skyledger.streaming import streams

QUOTES = "ticker string, end_ts long, bid double, ask double"


def run(spark, path, out, checkpoint, **how):
    with streams.timed_state(spark):
        streams.to_table(streams.changes(streams.landed(spark, path, QUOTES, 1), **how), out, checkpoint)
    return sorted((r["ticker"], r["end_ts"], r["bid"], r["ask"]) for r in spark.read.parquet(out).collect())


def land(spark, path, rows):
    spark.createDataFrame(rows, QUOTES).coalesce(1).write.mode("append").parquet(path)


def changed(rows):
    """In the order of time, the rows that differ from the one before."""
    out, last = [], {}
    for t, at, bid, ask in sorted(rows, key=lambda r: r[:2]):
        if t in last and last[t] != (bid, ask):
            out.append((t, at, bid, ask))
        last[t] = bid, ask
    return out


def test_shuffled_batches_give_the_changes_in_order(spark):
    rng = random.Random(3)
    rows = [(t, 1000 + 60 * i, rng.choice([0.1, 0.2, None]), 0.5) for t in "abc" for i in range(40)]
    want = changed(rows)
    rng.shuffle(rows)
    path, out, checkpoint = (scratch(spark) for _ in range(3))
    for i in range(0, len(rows), 40):
        land(spark, path, rows[i : i + 40])
        got = run(spark, path, out, checkpoint, late="1 day", buckets=2)  # a restart after each
    assert got == []  # nothing is certain yet
    land(spark, path, [("clock", 10 * 86400, None, None)])
    assert run(spark, path, out, checkpoint, late="1 day", buckets=2) == want


def test_state_goes_and_late_rows_are_left_out(spark):
    path, out, checkpoint = (scratch(spark) for _ in range(3))
    how = {"late": "10 seconds", "keep": 1000, "buckets": 1}
    land(spark, path, [("a", 100, 0.1, 0.2), ("b", 100, 0.1, 0.2)])
    land(spark, path, [("clock", 500, None, None)])
    run(spark, path, out, checkpoint, **how)
    land(spark, path, [("a", 600, 0.3, 0.4), ("b", 200, 0.9, 1.0)])  # b's row is older than the watermark
    land(spark, path, [("clock", 1600, None, None)])
    assert run(spark, path, out, checkpoint, **how) == [("a", 600, 0.3, 0.4)]
    # By now b is forgotten, so its next row is a first one; a is not.
    land(spark, path, [("a", 1601, 0.1, 0.2), ("b", 1601, 0.7, 0.8)])
    land(spark, path, [("clock", 9000, None, None)])
    assert run(spark, path, out, checkpoint, **how) == [("a", 600, 0.3, 0.4), ("a", 1601, 0.1, 0.2)]


def test_reads_of_a_state_table_stay_constant(spark):
    root, rng, want = scratch(spark), random.Random(4), {}
    schema = spark.createDataFrame([], "k long, v long").schema
    table = streams.StateTable(spark, root, schema, ["k"], every=4)
    for n in range(26):
        rows = [(k, rng.randrange(100)) for k in rng.sample(range(8), 3)]
        want |= dict(rows)
        df = spark.createDataFrame(rows, schema).coalesce(1)
        table.put(df, n)
        if n % 5 == 0:
            table.put(df, n)  # tried again
        assert len(table.tail(table.snapshot())) < 4 and len(streams.folders(spark, f"{root}/snapshot", "version")) <= 2
        assert len(streams.folders(spark, f"{root}/tail", "batch")) < 5
    assert {r["k"]: r["v"] for r in streams.StateTable(spark, root, schema, ["k"]).rows().collect()} == want


def test_a_merge_that_was_lost_midway_leaves_the_table(spark):
    root = scratch(spark)
    schema = spark.createDataFrame([], "k long, v long").schema
    table = streams.StateTable(spark, root, schema, ["k"], ["v"], every=3)
    for n in range(4):
        table.put(spark.createDataFrame([(1, 10 - n), (n, n)], schema), n)
    # A snapshot without its mark, as of a writer that died.
    spark.createDataFrame([(1, 99, 9)], "k long, v long, batch long").write.parquet(f"{root}/snapshot/version=9")
    streams.removed(spark, f"{root}/snapshot/version=9/_SUCCESS")
    assert sorted(map(tuple, table.rows().collect())) == [(0, 0), (1, 10), (2, 2), (3, 3)]
    table.put(spark.createDataFrame([(1, 50)], schema), 4)
    table.put(spark.createDataFrame([(2, 1)], schema), 5)
    assert sorted(map(tuple, table.rows().collect())) == [(0, 0), (1, 50), (2, 2), (3, 3)]


def test_the_open_set_keeps_two_batches(spark):
    root, path = scratch(spark), scratch(spark)
    for n in range(6):
        spark.createDataFrame([(n, True, t) for t in "abcdefgh"[n:]], "sweep long, complete boolean, ticker string").coalesce(1).write.mode("append").parquet(path)
        gone, left = streams.run_open_set(spark, streams.landed(spark, path, "sweep long, complete boolean, ticker string"), root)
        assert len(streams.folders(spark, f"{root}/open", "batch")) <= 2
    assert sorted((r["sweep"], r["ticker"]) for r in gone.collect()) == [(n + 1, "abcdefgh"[n]) for n in range(5)]
    assert sorted(r["ticker"] for r in left.agg(F.collect_list("ticker").alias("x")).first()["x"] and left.collect()) == list("fgh")
