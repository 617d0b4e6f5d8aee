"""Streams over restarts: state and sinks go on where they were, and a batch that is tried again leaves its rows once."""

from pyspark.sql import functions as F

from skyledger.sources.bronze import scratch
from skyledger.streaming import streams

SWEEPS = "sweep long, complete boolean, ticker string"


def landed_sweeps(spark, path, *sweeps):
    rows = [(n, complete, t) for n, complete, tickers in sweeps for t in tickers]
    spark.createDataFrame(rows, SWEEPS).coalesce(1).write.mode("append").parquet(path)


def open_set(spark, path, root):
    gone, left = streams.run_open_set(spark, streams.landed(spark, path, SWEEPS), root)
    return sorted((r["sweep"], r["ticker"]) for r in gone.collect()), sorted(r["ticker"] for r in left.collect())


def test_open_set_survives_restarts(spark):
    path, root = scratch(spark), scratch(spark)
    landed_sweeps(spark, path, (1, True, "abc"))
    assert open_set(spark, path, root) == ([], ["a", "b", "c"])  # a single sweep drops nothing
    landed_sweeps(spark, path, (2, True, "bcd"))
    assert open_set(spark, path, root) == ([(2, "a")], ["b", "c", "d"])
    landed_sweeps(spark, path, (3, False, "b"))
    assert open_set(spark, path, root) == ([(2, "a")], ["b", "c", "d"])  # an incomplete sweep changes nothing
    landed_sweeps(spark, path, (4, True, "de"), (5, True, "e"))
    want = [(2, "a"), (4, "b"), (4, "c"), (5, "d")], ["e"]
    assert open_set(spark, path, root) == want
    assert open_set(spark, path, root) == want  # nothing new has landed


def test_a_batch_tried_again_replaces_its_rows(spark):
    out = scratch(spark)
    rows = spark.range(3)
    streams.put_batch(rows, out, 0)
    streams.put_batch(rows, out, 1)
    streams.put_batch(rows, out, 1)
    assert streams.batches(spark, out, rows.schema).groupBy("batch").count().orderBy("batch").collect() == [(0, 3), (1, 3)]
    assert streams.batches(spark, scratch(spark), rows.schema).count() == 0


def test_updates_go_on_after_a_restart(spark):
    path, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    schema = "end_ts long, endpoint string, ok long"
    for rows in ([(10, "a", 1), (20, "a", 0)], [(30, "a", 1), (4000, "b", 1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        got = streams.latest_updates(spark, streams.heartbeat(streams.landed(spark, path, schema)), ["hour_ts", "endpoint"], out, checkpoint)
    assert {tuple(r) for r in got.select("hour_ts", "endpoint", "attempts", "failures").collect()} == {(0, "a", 3, 1), (3600, "b", 1, 0)}


def test_the_scratch_folder_is_shared_or_spark_is_local(spark):
    assert scratch(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert spark.range(1).select(F.lit(1)).count() == 1
