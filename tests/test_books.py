"""Books are made within their quote's row, and measured the same in whole units as in decimals."""

from pyspark.sql import functions as F

from skyledger.functions import book
from skyledger.plans import market
from skyledger.plans.market_queries import books

SF = "/root/testdata/sf0.001"


def test_levels_are_not_shuffled(spark):
    plan = books(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan


def test_quotes_that_are_there_twice_are_one_capture(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(20)
    events.coalesce(1).write.parquet(f"{tmp_path}/one/events.parquet")
    events.union(events).coalesce(1).write.parquet(f"{tmp_path}/two/events.parquet")
    one, two = ({r["event_id"]: r for r in books(spark, f"{tmp_path}/{n}").collect()} for n in ("one", "two"))
    assert one.keys() == two.keys() and one
    for k, r in two.items():
        assert sorted(r["yes"][:-2]) == sorted(2 * one[k]["yes"][:-2]) and sorted(r["no"][:-2]) == sorted(2 * one[k]["no"][:-2])


def test_units_and_decimals_agree(spark):
    rows = [
        (1, [["0.40", "10.25"], ["0.39", "3"], ["x", "1"], ["0.385", "7"]], [["0.55", "4.5"], ["0.555", "2"], ["0.5"]]),
        (2, [["0.40", "9000000000000000"], ["0.39", "3"]], [["0.55", "8000000000000000.01"]]),  # no sum of dollars fits a long
        (3, [["1.2", "5"]], [["0.3", "5"]]),  # a price that no contract has
        (4, [["0.4", "5"]], [["x", "5"]]),
    ]
    own = spark.createDataFrame(rows, "event_id long, yes array<array<string>>, no array<array<string>>")
    got = {r["event_id"]: r for r in market.depth_metrics(own).collect()}
    exact = market.tops(own).withColumn("mid", ((F.col("bid") + F.col("ask")) / 2).cast("decimal(10,6)"))
    exact = exact.withColumns({f"{'dollar_' if x else ''}depth_{c}c": book.depth(F.col("mid"), F.col("bids"), F.col("asks"), c, x) for c in (1, 2, 3, 5) for x in (False, True)})
    exact = exact.withColumns({"yes_size_2": book.size_at(F.col("bids"), 2), "no_size_2": book.size_at(F.col("nos"), 2), "dollar_no_5": book.dollars_at(F.col("nos"), 5)})
    assert sorted(got) == [1, 2, 3]
    for r in exact.where("event_id < 4").collect():
        for c in exact.columns:
            if c in got[1].asDict():
                assert got[r["event_id"]][c] == r[c], (r["event_id"], c)
    assert str(got[2]["yes_size_2"]) == "9000000000000003.000000"
