"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2^BITS bins; a row's cell is its index on the Hilbert curve through the
bins, so neighbouring cells agree in most dimensions and a run of the curve has narrow minimum and
maximum values in all of them, by which a reader can skip whole files.  The rows in curve order are cut
into runs of equal row counts (law `rows`: counts differ by one at most).

Strings are quantised by their first bytes as a number, numbers by their value, both at approximate
quantiles, so a value with a third of all rows fills bins but never breaks anything.  Within a cell rows
are in the order of a hash of their id, size and crc32, and cells are cut into sub-cells of about `SUBCELL` rows by
that hash; only the counts of sub-cells meet in a running sum, so no task holds a hot cell.

Cases: a null dimension is in bin 0; a null text has 0 bytes (size 16, crc32 0); repeated rows get
places of their own next to one another; equal ids are ordered by size and crc32; an empty table gives
an empty one; other columns are ignored by `assign`, and kept by `write_shards`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import stored

#: Bins of a dimension: 2^BITS.
BITS = 4
#: Rows that share a sub-cell, about.
SUBCELL = 512


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of points given as integer rows of `axes` (points x dimensions).

    Works from the top bit down: the Gray code of the point's half in each dimension picks the sub-cube,
    then the axes are flipped and swapped so that the curve in that sub-cube is the first one again.
    """
    x = np.array(axes, dtype=np.int64).T
    n = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for d in range(n):
            upper = (x[d] & top) > 0
            swap = np.where(upper, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap if d else 0
    for d in range(1, n):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[n - 1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    x ^= turn
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            out = out << 1 | x[d] >> level & 1
    return out


@F.pandas_udf(T.LongType())
def _cell(bins: pd.Series) -> pd.Series:
    if not len(bins):
        return pd.Series([], dtype="int64")
    return pd.Series(hilbert_index(np.stack(bins.to_numpy()), BITS))


def as_number(df: DataFrame, name: str) -> F.Column:
    """A number in the order of the column's values: the value, or a string's first six bytes."""
    if df.schema[name].dataType.simpleString() == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(name).cast("double")


def cells(rows: DataFrame, dims: list[str], cell_col: str = "cell") -> DataFrame:
    """The rows with their place on the curve.  Only the bin bounds, 2^BITS - 1 a dimension, reach the driver."""
    numbers = {d: as_number(rows, d) for d in dims}
    shares = [i / 2**BITS for i in range(1, 2**BITS)]
    found = rows.agg(*[F.percentile_approx(c, shares, 1000).alias(f"b{i}") for i, c in enumerate(numbers.values())]).first()
    bins = []
    for i, c in enumerate(numbers.values()):
        bounds = sorted(set(found[i] or []))
        above = F.lit(0)
        for b in bounds:
            above = above + F.when(c >= F.lit(b), 1).otherwise(0)
        bins.append(above.cast("int"))
    return rows.withColumn(cell_col, _cell(F.array(*bins)))


def assign(docs: DataFrame, shards: int, dims: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of every row of `docs`, with the cell on the curve.

    `dims` are columns of `docs`, or `size` for the text's bytes plus 16.
    """
    dims = dims or ["lang", "source", "size"]
    if BITS * len(dims) > 16:
        raise ValueError("four dimensions at most")
    own = [d for d in dims if d != "size"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(d).alias(f"dim_{d}") for d in own],
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # The texts are read once; what follows goes over these narrow rows.
    meta = stored(meta)
    total = max(1, meta.count())
    placed = cells(meta, [d if d == "size" else f"dim_{d}" for d in dims])
    # At most 2^(BITS * dims) cells, so their counts may be broadcast and summed up in one task.
    counted = placed.groupBy("cell").agg(F.count("*").alias("cell_rows"))
    by_cell = counted.withColumn("cell_at", F.coalesce(F.sum("cell_rows").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # In a cell of n rows the hash range falls in ceil(n / SUBCELL) equal parts.
    placed = (
        placed.join(F.broadcast(by_cell), "cell")
        .withColumn("spread", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(1 << 30)))
        .withColumn("part", F.expr(f"(spread * ((cell_rows + {SUBCELL - 1}) div {SUBCELL})) div {1 << 30}L"))
    )
    # A row for each SUBCELL rows of input; summed up cell by cell.
    sizes = placed.groupBy("cell", "part").agg(F.count("*").alias("n"), F.first("cell_at").alias("cell_at"))
    offsets = sizes.select("cell", "part", (F.col("cell_at") + F.coalesce(F.sum("n").over(Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("at"))
    within = Window.partitionBy("cell", "part").orderBy("spread", "doc_id", "size", "text_crc32")
    ranked = (
        placed.withColumn("k", F.row_number().over(within) - 1)
        .join(offsets, ["cell", "part"])
        .withColumn("rank", F.col("at") + F.col("k"))
        .withColumn("shard", F.expr(f"(rank * {shards}L) div {total}L"))
    )
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell")


def write_shards(docs: DataFrame, path: str, shards: int, dims: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows of `docs` as Parquet files, a folder for each shard, in curve order within it.

    Rows meet their places by id, size and crc32; a repeated row takes one of its places each.
    """
    keys = ["doc_id", "size", "text_crc32"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    extra = {f"_{k}" for k in (*keys, "shard", "slot", "n")}
    keyed = docs.select("*", F.col(id_col).alias("_doc_id"), (F.octet_length(text) + 16).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_text_crc32"))
    keyed = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*[f"_{k}" for k in keys]).orderBy(F.lit(0))))
    places = assign(docs, shards, dims, id_col, text_col)
    places = places.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("shard", "slot"))).select(*[F.col(k).alias(f"p_{k}") for k in (*keys, "n")], F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    joined = keyed.join(places, (F.col("_doc_id").eqNullSafe(F.col("p_doc_id"))) & (F.col("_size") == F.col("p_size")) & (F.col("_text_crc32") == F.col("p_text_crc32")) & (F.col("_n") == F.col("p_n")))
    kept = [c for c in docs.columns if c not in extra]
    (
        joined.repartitionByRange(shards, "_shard")
        .sortWithinPartitions("_shard", "_slot")
        .select(*kept, F.col("_shard").alias("shard_id"))
        .write.partitionBy("shard_id").mode("overwrite").parquet(path)
    )
