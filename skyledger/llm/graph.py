"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import FEW_IDS, checkpoint


def _small_star(links: DataFrame, few: bool) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(F.broadcast(least) if few else least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _large_star(links: DataFrame, few: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(F.broadcast(least) if few else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node and component (the least node reachable) of every node that has a link.

    `links` has two columns of one orderable type, in any direction; loops and repeats do no harm, and
    links with a null end are none.  Large-star and small-star rounds move links to lesser nodes until
    every node hangs on its least; a hub's links are summed up before they are shuffled and joined back,
    so that no task needs all links of a node; sums of FEW_IDS nodes or fewer are sent to the links, more are
    joined.  Every round is written to the shared folder.
    """
    a, b = links.columns
    links = links.where((F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = checkpoint(links)
    state = (links.count(),)
    for _ in range(most_rounds):
        few = 2 * state[0] <= FEW_IDS  # links have two ends
        links = checkpoint(_small_star(_large_star(links, few), few))
        found = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    else:
        raise RuntimeError(f"links still move after {most_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
