"""Jobs over captures and state: coverage, inventory, upserts, polling health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions import price


def upsert(rows: DataFrame, key: str, ts: str, keep: list[str], overwrite: list[str]) -> DataFrame:
    """The state after all rows in order: `keep` columns are never overwritten by null, `overwrite` columns take the last row."""
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ts, key))).alias(c) for c in keep]
    last = F.max_by(F.struct(*overwrite), F.col(ts)).alias("_last")
    return rows.groupBy(key).agg(*kept, last, F.max(ts).alias(ts)).select(key, ts, *keep, "_last.*")


def known(rows: DataFrame, key: str = "ticker", ts: str = "ts", status: str = "status") -> DataFrame:
    return rows.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.max_by(status, ts).alias("last_status"))


def dropped(before: DataFrame, now: DataFrame, key: str = "ticker") -> DataFrame:
    """Open before and not now: to be settled."""
    return before.select(key).distinct().join(now.select(key).distinct(), key, "left_anti")


def preferred(live: DataFrame, historical: DataFrame, key: str) -> DataFrame:
    """The union of two sources, a key's live row before its historical one."""
    rows = live.withColumn("src", F.lit("live")).unionByName(historical.withColumn("src", F.lit("historical")), allowMissingColumns=True)
    values = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*values), F.when(F.col("src") == "live", 0).otherwise(1)).alias("r")).select(key, "r.*")


def heartbeat(polls: DataFrame) -> DataFrame:
    """Attempts and failures by hour and endpoint."""
    hour = F.col("end_ts") - F.pmod(F.col("end_ts"), F.lit(3600))
    return polls.groupBy(hour.alias("hour_ts"), "endpoint").agg(F.count("*").alias("attempts"), F.count_if(F.col("ok") == 0).alias("failures"))


def market_inventory(markets: DataFrame, cutoff_ts: int) -> DataFrame:
    """Counts of markets by prefix, close year and tier, and over all, with the span and mean open hours."""
    hours = F.when(F.col("close_ts") > F.col("open_ts"), (F.col("close_ts") - F.col("open_ts")) / 3600.0)
    rows = markets.withColumns({
        "prefix": F.when(F.col("ticker").contains("-"), F.substring_index("ticker", "-", 1)).otherwise("?"),
        "close_year": F.floor(F.col("close_ts") / 86400),
        "tier": F.when(price.before_cutoff(F.lit(None).cast("long"), F.col("close_ts"), F.lit(cutoff_ts)), "historical").otherwise("live"),
        "hours": hours,
    })
    rows = rows.withColumn("close_year", F.year(F.date_from_unix_date(F.col("close_year").cast("int"))))
    sets = rows.groupingSets([["prefix"], ["close_year"], ["tier"], []], "prefix", "close_year", "tier")
    out = sets.agg(F.count("*").alias("n"), F.min("open_ts").alias("first_open"), F.max("close_ts").alias("last_close"), F.avg("hours").alias("mean_open_hours"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "prefix").when(F.col("g") == 5, "close_year").when(F.col("g") == 6, "tier").otherwise("all")
    return out.select(kind.alias("kind"), F.coalesce("prefix", F.col("close_year").cast("string"), "tier", F.lit("")).alias("value"), "n", "first_open", "last_close", "mean_open_hours")
