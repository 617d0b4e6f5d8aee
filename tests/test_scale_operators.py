"""Operators that must not put a key, a series or a table in one task: skew spans, segmented scans, quotas, counted quantiles, day tables."""

import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import ordered
from skyledger.operators.quantiles import counted_quantiles
from skyledger.sources import bronze

QUOTES = "ticker string, end_ts long, bid double"


def skewed(spark, n=3000, seed=1):
    """Half of all rows are one ticker's; some times repeat, some bids are null, some tickers too."""
    rng = random.Random(seed)
    rows = [("hot" if i % 2 else rng.choice(["a", "b", "c", None]), rng.randrange(100_000), rng.choice([0.1, 0.2, None])) for i in range(n)]
    return spark.createDataFrame(sorted({(t, at): (t, at, b) for t, at, b in rows}.values(), key=str), QUOTES).repartition(4)


def test_hot_keys_alone_are_cut(spark):
    rows = skewed(spark)
    hot = ordered.hot_spans([(rows, "end_ts")], ["ticker"], most=200, few_bytes=0)
    n = {r["ticker"]: r["count"] for r in rows.groupBy("ticker").count().collect()}
    assert {r["ticker"] for r in hot.collect()} == {t for t, k in n.items() if k > 200} and "hot" in n
    spans = ordered.spanned(rows, ["ticker"], "end_ts", hot).groupBy("ticker", "_span").count()
    assert spans.agg(F.max("count")).first()[0] < 2 * 200
    assert ordered.hot_spans([(rows, "end_ts")], ["ticker"], most=10**6, few_bytes=0) is None
    assert ordered.hot_spans([(bronze.written(rows), "end_ts")], ["ticker"], most=200) is None  # less than a task's work


@pytest.mark.parametrize("strict", [False, True])
def test_asof_with_spans_is_the_one_without(spark, strict):
    left, right = skewed(spark), skewed(spark, seed=2)
    hot = ordered.hot_spans([(left, "end_ts"), (right, "end_ts")], ["ticker"], most=300, few_bytes=0)
    plain, cut, all_cut = (sorted(map(str, ordered.asof_backward(left, right, ["ticker"], "end_ts", "end_ts", strict, every=e).collect())) for e in (None, hot, 777))
    assert plain == cut == all_cut


def test_sequences_with_spans_are_the_ones_without(spark):
    rows = skewed(spark)
    hot = ordered.hot_spans([(rows, "end_ts")], ["ticker"], most=150, few_bytes=0)
    for f in (
        lambda e: ordered.gaps(rows, ["ticker"], "end_ts", e),
        lambda e: ordered.changes(rows, ["ticker"], ["end_ts"], ["bid"], e),
        lambda e: ordered.with_previous(rows, ["ticker"], ["end_ts"], ["bid", "end_ts"], every=e),
    ):
        plain = sorted(map(str, f(None).collect()))
        assert plain == sorted(map(str, f(hot).collect())) == sorted(map(str, f(999).collect()))


@pytest.mark.parametrize("every", [1, 7, 365, 10**6])
def test_segmented_scans(spark, every):
    rng = random.Random(3)
    rows, v = [], {}
    for k in ("x", "y"):
        for day in sorted(rng.sample(range(100, 1200), 150)):
            if rng.random() < 0.2 or k not in v:
                v[k] = rng.choice(["a", "b", None])
            rows.append((k, day, v[k]))
    df = spark.createDataFrame(rows, "k string, day long, v string").repartition(3)
    want_islands, want_points = [], []
    for k in ("x", "y"):
        own, island = [r for r in rows if r[0] == k], 0
        for i, (_, day, value) in enumerate(own):
            if i and own[i - 1][2] != value:
                island += 1
                want_points.append((k, own[i - 1][1], day, own[i - 1][2], value, sum(r[2] == own[i - 1][2] for r in own[:i]), sum(r[2] == value for r in own[i:])))
            want_islands.append((k, day, value, island))
    assert sorted(map(str, map(tuple, ordered.islands(df, "day", "v", ["k"], every=every).collect()))) == sorted(map(str, want_islands))
    assert sorted(map(str, map(tuple, ordered.change_points(df, "day", "v", ["k"], every=every).collect()))) == sorted(map(str, want_points))
    one = df.where("k = 'x'").drop("k")
    assert sorted(map(str, map(tuple, ordered.islands(one, "day", "v", every=every).collect()))) == sorted(str(r[1:]) for r in want_islands if r[0] == "x")
    assert ordered.change_points(one, "day", "v", every=every).count() == sum(r[0] == "x" for r in want_points)
    assert ordered.islands(df.limit(0), "day", "v", ["k"]).count() == 0


def test_quotas_pass_few_rows_on(spark):
    df = spark.range(5000).select((F.col("id") % 3).cast("string").alias("s"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("t"), "id")
    got = ordered.stratified(df, ["s", "t"], "id", 50, 1)
    n = sorted(r["count"] for r in got.groupBy("s", "t").count().collect())
    assert n == [5] * 4 + [6] * 5 and got.count() == 50
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert ordered.stratified(df.limit(0), ["s"], "id", 50, 1).count() == 0


def test_counted_quantiles_are_percentiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *[i / 100 for i in range(20)]]), rng.random()) for _ in range(800)] + [("c", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    ps = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["k"]: r.asDict() for r in counted_quantiles(df, ["k"], {"x": (F.col("x"), {f"x_{n}": p for n, p in ps.items()}), "y": (F.col("y"), {"y_50": 0.5})}).collect()}
    want = df.groupBy("k").agg(F.count("x").alias("n_x"), F.count("y").alias("n_y"), F.percentile("y", F.lit(0.5)).alias("y_50"), *[F.percentile("x", F.lit(p)).alias(f"x_{n}") for n, p in ps.items()])
    for r in want.collect():
        for c, v in r.asDict().items():
            assert got[r["k"]][c] == (pytest.approx(v) if isinstance(v, float) else v)
    assert counted_quantiles(df.limit(0), ["k"], {"x": (F.col("x"), {"m": 0.5})}).count() == 0


def test_a_day_table_is_its_last_whole_manifest(spark):
    root = bronze.scratch(spark)
    table = bronze.DayTable(spark, root, "day long, v long", "day")
    rows = lambda *r: spark.createDataFrame(list(r), "day long, v long")
    read = lambda: sorted(map(tuple, bronze.DayTable(spark, root, "day long, v long", "day").rows().collect()))
    assert read() == []
    table.put(rows((1, 10), (1, 11), (2, 20)), "a")
    table.put(rows((2, 21), (3, 30)), "b")
    want = [(1, 10), (1, 11), (2, 21), (3, 30)]
    assert read() == want
    table.put(rows((1, 99)), "b")  # tried again: the name is known
    assert read() == want
    # A writer that died after its data, and one that died within its manifest.
    rows((1, 77)).write.partitionBy("day").parquet(f"{root}/data/commit=lost")
    spark.createDataFrame([(1, "lost", True)], "day long, commit string, live boolean").write.parquet(f"{root}/manifest/version=2")
    bronze.removed(spark, f"{root}/manifest/version=2/_SUCCESS")
    assert read() == want
    table.put(rows((1, 12), (2, 22), (3, 32)), "c")
    assert read() == [(1, 12), (2, 22), (3, 32)]
    table.put(rows((4, 40)), "d")
    assert read() == [(1, 12), (2, 22), (3, 32), (4, 40)]
    store = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data")
    left = {x.getPath().getName() for x in store.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(store)}
    assert "commit=a" not in left and {"commit=c", "commit=d"} <= left
