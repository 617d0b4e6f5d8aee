"""The census holds no set of tickers in a task: its groups are few, whatever the input."""

import re

from skyledger.plans import market

ROWS = (
    "ticker string, day long, horizon_h int, era string, season string, regime string, regime_uncertain boolean, quote_valid boolean, quote_present boolean, in_window boolean, "
    "extreme_empty_book boolean, volume long, two_sided boolean, two_sided_cf boolean, mid double, mid_cf double, spread double, spread_cf double, quote_age long"
)


def test_no_group_is_by_ticker(spark):
    rows = [(f"T{i}", i % 3, 6, "e", "s", None, True, i % 2 == 0, True, True, False, i, True, True, 0.5, 0.15, 0.02, 0.01 * (i % 4), 60 * i) for i in range(30)]
    rows = spark.createDataFrame(rows, ROWS)
    bad = spark.createDataFrame([("T1",), ("T1",), ("T8",)], "ticker string")
    # The excluded tickers alone are made distinct.
    for out, most in ((market.spread_census(rows), 0), (market.spread_census(rows, bad), 1)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        groups = [g for g in re.findall(r"Aggregate \[([^\]]*)\]", plan) if "ticker" in g]
        assert all(g.count("#") == 1 for g in groups) and bool(groups) <= most, groups
        got = {r["band"]: r for r in out.collect()}
        assert {b: (r["n_snapshots"], r["n_market_days"], r["n_days"]) for b, r in got.items()} == {"10_90": (30, 30, 3), "20_80": (30, 30, 3)}
    assert got["10_90"]["n_spread_obs_carryforward"] == 30 and got["10_90"]["n_spread_obs_exclnoreconcile"] == 28


def test_tasks_grow_with_the_rows(spark):
    from skyledger.operators.ordered import asof_backward, parts_of

    rows = spark.range(1000).selectExpr("id % 50 as k", "id as at")
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts_of(rows, 10) == 101 and parts_of(rows, 10**6) == own
    out = asof_backward(rows, rows, ["k"], "at", "at", parts=40)
    assert out.rdd.getNumPartitions() == 40 and out.where("found.at = at").count() == 1000
