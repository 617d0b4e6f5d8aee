"""Exact quantiles from counted values.

Each different value of a group is counted, in part before the shuffle, and a quantile is found by its rank in the running
counts.  What meets is a row for each value and not for each row, so on a grid (cents, seconds, whole contracts) a
group is as large as the grid, whatever the input; and it is sorted, with spilling, instead of held in a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted_quantiles(df: DataFrame, keys: list[str], asked: dict[str, tuple[Column, dict[str, float]]]) -> DataFrame:
    """A row for each group: of each name in `asked` the quantiles of its column, by their own names, and `n_<name>`, how many values aren't null.

    Quantiles lie between two ranks in proportion, as `percentile` and `quantile_cont` have it.  Of a group without
    values they are null and n is 0.  Keys may be null.
    """
    tags = list(asked)
    values = F.array(*[F.struct(F.lit(i).alias("tag"), x.cast("double").alias("v")) for i, (x, _) in enumerate(asked.values())])
    rows = df.select(*keys, F.explode(values).alias("t")).select(*keys, "t.tag", "t.v")
    # A group's null values count as none, but keep the group.
    counted = rows.groupBy(*keys, "tag", "v").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("v").isNull(), 0).otherwise(F.col("n")))
    group = Window.partitionBy(*keys, "tag")
    ranked = counted.withColumns({"upto": F.sum("n").over(group.orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(group)})
    columns = []
    for i, (_, names) in enumerate(asked.values()):
        own = F.col("tag") == i
        columns.append(F.max(F.when(own, F.col("all"))).alias(f"n_{tags[i]}"))
        for name, p in names.items():
            at = F.col("all").cast("double") * p - p  # the rank, from 0
            past = lambda rank: F.min(F.when(own & (F.col("n") > 0) & (F.col("upto") > rank), F.col("v")))
            low, high = past(F.floor(at)), past(F.ceil(at))
            share = F.max(F.when(own, at - F.floor(at)))
            columns.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*keys).agg(*columns)
