"""The ladders read back are all levels of all days."""

from pyspark.sql import functions as F

from skyledger import catalog

SF = "/root/testdata/sf0.001"


def test_every_level_comes_back(spark):
    got = catalog.QUERIES["src_lad"](spark, SF)
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    levels = orders.select(day.alias("day"), (F.col("o_orderkey") % 9).alias("level")).distinct().count()
    assert sorted(got.columns) == ["day", "level", "value_f"] and got.count() == levels
    assert got.agg(F.sum("value_f")).first()[0] == orders.count()
