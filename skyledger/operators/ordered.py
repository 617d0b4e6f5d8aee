"""Operators over ordered rows: as-of lookup, latest per key, gaps, changes, islands, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a key beyond which its sequence is cut, and bytes of input below which no key is looked for.
MOST_ROWS, FEW_BYTES = 2_000_000, 256 << 20

#: How sequences are cut in spans: of so many seconds for all keys, of the seconds given for some (see `hot_spans`), or not.
Spans = int | DataFrame | None


def hot_spans(frames: list[tuple[DataFrame, str]], by: list[str], most: int | None = None, few_bytes: int | None = None) -> DataFrame | None:
    """by and _every, the seconds of a span, of the keys that have more than `most` rows in all frames (each with its time column); None if there are none.

    A first pass counts the rows of each key, in part before the shuffle.  A hot key's range of time is cut in as many equal
    spans as give `most` rows each on average.  Inputs of fewer than `few_bytes`, as Spark estimates them, are less than
    one task's work; they are not counted.
    """
    most, few_bytes = most or MOST_ROWS, FEW_BYTES if few_bytes is None else few_bytes
    if sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df, _ in frames) < few_bytes:
        return None
    rows = None
    for df, ts in frames:
        own = df.select(*by, F.col(ts).alias("_at"))
        rows = own if rows is None else rows.unionByName(own)
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"), F.max("_at").alias("_to")).where(F.col("_n") > most)
    every = F.ceil((F.col("_to") - F.col("_from") + 1) / F.ceil(F.col("_n") / most)).cast("long")
    # A row for each `most` rows of input at most.
    hot = counts.select(*by, F.greatest(every, F.lit(1)).alias("_every")).collect()
    if not hot:
        return None
    found = df.sparkSession.createDataFrame(hot, counts.select(*by, every.alias("_every")).schema)
    return F.broadcast(found) if len(hot) <= 1 << 16 else found


def parts_of(rows: DataFrame, most: int) -> int:
    """Tasks of about `most` rows each, no fewer than the session's shuffles have.

    A number of its own isn't made less by what rows take in a shuffle, which is far less than what sorting them takes.
    Rows are counted, so hand in a table that is written.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // most + 1)


def same_keys(keys: list[str], suffix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}_{suffix}"))
    return cond


def spanned(rows: DataFrame, by: list[str], ts: str, spans: Spans) -> DataFrame:
    """The rows with `_span`, the number of the span of their key that holds their time; null for keys that aren't cut."""
    if not isinstance(spans, DataFrame):
        return rows.withColumn("_span", F.floor(F.col(ts) / spans).cast("long"))
    own = spans.select(*[F.col(k).alias(f"_{k}_hot") for k in by], "_every")
    return rows.join(own, same_keys(by, "hot"), "left").withColumn("_span", F.floor(F.col(ts) / F.col("_every")).cast("long")).drop("_every", *[f"_{k}_hot" for k in by])


def carried(rows: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """The rows with `_before`: the last value of `_end` in the earlier spans of their key, from a row (by, _span, _end) for each span."""
    earlier = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.where("_span is not null").withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    starts = starts.select(*[F.col(k).alias(f"_{k}_of") for k in [*by, "_span"]], "_before")
    return rows.join(starts, same_keys([*by, "_span"], "of"), "left").drop(*[f"_{k}_of" for k in [*by, "_span"]])


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, strict: bool = False, found: str = "found", every: Spans = None, parts: int | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before its time, as a struct; before it, if strict.

    Both sides are laid in one sequence per key and the last right row seen is carried forward: one shuffle
    and one sort, linear whatever the sides' sizes.  An age limit is a filter on what was found, afterwards.
    Right rows of one key and time are taken in the order of all their columns; the last stands.

    every: cut sequences into spans, so that a key with many rows is many tasks' work; what a span begins with comes
    from a second, narrow pass that takes the last right row of each earlier span.
    parts: over how many tasks sequences are dealt (see `parts_of`).
    """
    order = F.lit(1 if not strict else 0), F.lit(0 if not strict else 1)
    a = left.select(*by, F.col(left_ts).alias("_at"), order[0].alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*right.columns).alias("s")).schema["s"].dataType).alias("_right"))
    b = right.select(*by, F.col(right_ts).alias("_at"), order[1].alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_left"), F.struct(*right.columns).alias("_right"))
    rows, keys = a.unionByName(b), list(by)
    if every is not None:
        rows, keys = spanned(rows, by, "_at", every), [*by, "_span"]
    if parts is not None:
        rows = rows.repartition(parts, *keys)
    seen = Window.partitionBy(*keys).orderBy("_at", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(found, F.last("_right", ignorenulls=True).over(seen)).where(F.col("_left").isNotNull())
    if every is not None:
        ends = rows.where("_span is not null").groupBy(*keys).agg(F.max(F.when(F.col("_right").isNotNull(), F.struct("_at", "_right"))).alias("_end"))
        out = carried(out, ends, by).withColumn(found, F.coalesce(found, "_before._right"))
    return out.select("_left.*", found)


def latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key in a total order; partial maxima are taken before the shuffle."""
    values = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def with_previous(df: DataFrame, by: list[str], order: list[str], columns: list[str], prefix: str = "prev_", every: Spans = None) -> DataFrame:
    """Rows with columns of the row before, and whether they are their key's first.  `every` as in `asof_backward`, over the first of `order`."""
    now = F.struct(*columns)
    rows, keys = (spanned(df, by, order[0], every), [*by, "_span"]) if every is not None else (df, list(by))
    out = rows.withColumn("_lag", F.lag(now).over(Window.partitionBy(*keys).orderBy(*order)))
    if every is not None:
        ends = rows.where("_span is not null").groupBy(*keys).agg(F.max_by(now, F.struct(*order)).alias("_end"))
        out = carried(out, ends, by).withColumn("_lag", F.coalesce("_lag", "_before"))
    return out.select(*df.columns, *[F.col(f"_lag.{c}").alias(f"{prefix}{c}") for c in columns], F.col("_lag").isNull().alias("is_first"))


def gaps(df: DataFrame, by: list[str], ts: str, every: Spans = None) -> DataFrame:
    """Rows with the seconds since the one before; null for a key's first.  `every` as in `asof_backward`."""
    rows = with_previous(df, by, [ts], [ts], "_prev_", every)
    return rows.withColumn("gap", F.col(ts) - F.col(f"_prev_{ts}")).select(*df.columns, "gap")


def changes(df: DataFrame, by: list[str], order: list[str], values: list[str], every: Spans = None) -> DataFrame:
    """Rows where some value differs, null-safe, from the row before; a key's first row is none.  `every` as in `asof_backward`, over the first of `order`."""
    rows = with_previous(df, by, order, values, "_prev_", every)
    before = F.struct(*[F.col(f"_prev_{c}").alias(c) for c in values])
    return rows.where(~F.col("is_first") & ~F.struct(*values).eqNullSafe(before)).select(*df.columns)


#: Days of a span of a daily series.
SPAN_DAYS = 365


def change_points(daily: DataFrame, day: str, value: str, by: list[str] | None = None, every: int = SPAN_DAYS) -> DataFrame:
    """Where a series changes, with how many earlier days had the old value and later days the new.

    A segmented scan: rows are counted within spans of `every` days, each a task's work; what spans begin with comes from
    a row for each span (and value), so no window holds a whole series.
    """
    keys = by or []
    rows = spanned(daily, keys, day, every)
    own = Window.partitionBy(*keys, "_span", value).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy(*keys, "_span", value).agg(F.count("*").alias("_n"))
    each = Window.partitionBy(*keys, value)
    earlier = counts.withColumns({"_earlier": F.coalesce(F.sum("_n").over(each.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_n").over(each)})
    earlier = earlier.select(*[F.col(k).alias(f"_{k}_of") for k in (*keys, "_span", value)], "_earlier", "_total")
    rows = rows.withColumn("_own", F.count("*").over(own)).join(earlier, same_keys([*keys, "_span", value], "of"))
    rows = rows.withColumn("_so_far", F.col("_earlier") + F.col("_own")).select(*daily.columns, "_so_far", "_total")
    rows = with_previous(rows, keys, [day], [day, value, "_so_far"], "_prev_", every)
    changed = ~F.col("is_first") & ~F.col(f"_prev_{value}").eqNullSafe(F.col(value))
    return rows.where(changed).select(
        *keys, F.col(f"_prev_{day}").alias("last_date_before"), F.col(day).alias("first_date_after"), F.col(f"_prev_{value}").alias("value_before"), F.col(value).alias("value_after"),
        F.col("_prev__so_far").alias("days_before"), (F.col("_total") - F.col("_so_far") + 1).alias("days_after"),
    )


def islands(daily: DataFrame, day: str, value: str, by: list[str] | None = None, name: str = "island", every: int = SPAN_DAYS) -> DataFrame:
    """Rows with a number that grows where the value changes in day order; a segmented scan as in `change_points`."""
    keys = by or []
    rows = spanned(daily, keys, day, every)
    w = Window.partitionBy(*keys, "_span").orderBy(day)
    step = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    rows = rows.withColumn("_step", step).withColumn("_local", F.sum("_step").over(w))
    spans = rows.groupBy(*keys, "_span").agg(F.sum("_step").alias("_steps"), F.min_by(F.struct(value), day).alias("_first"), F.max_by(F.struct(value), day).alias("_last"))
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_span")  # a row for each span
    jump = F.coalesce((~F.col("_first").eqNullSafe(F.lag("_last").over(across))).cast("int"), F.lit(0))
    spans = spans.withColumn("_jump", F.when(F.row_number().over(across) == 1, 0).otherwise(jump))
    spans = spans.withColumn("_before", F.sum(F.col("_steps") + F.col("_jump")).over(across) - F.col("_steps"))
    spans = spans.select(*[F.col(k).alias(f"_{k}_of") for k in (*keys, "_span")], "_before")
    return rows.join(spans, same_keys([*keys, "_span"], "of")).withColumn(name, F.col("_before") + F.col("_local")).select(*daily.columns, name)


def stratified(df: DataFrame, strata: list[str], key: str, target: int, seed: int) -> DataFrame:
    """About `target` rows with equal quotas a stratum, the first strata one more; chosen by a hash of seed and key.

    Short strata are taken whole and their lack is not made up for elsewhere.  No quota is over the greatest, so each
    task passes at most so many rows of a stratum on, before they meet.
    """
    named = df.select(*strata).distinct()
    most = target // max(1, named.count()) + 1
    ranked = named.withColumns({"_i": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*strata)) - 1, "_n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    quota = ranked.select(*[F.col(c).alias(f"_{c}_of") for c in strata], (F.floor(F.lit(target) / F.col("_n")) + (F.col("_i") < F.lit(target) % F.col("_n")).cast("long")).alias("quota"))
    order = Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    first = df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most)
    return first.join(quota, same_keys(strata, "of")).where(F.col("_rn") <= F.col("quota")).select(*df.columns)


def missing(expected: DataFrame, captured: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows that nothing was captured for."""
    return expected.join(captured.select(*keys).distinct(), keys, "left_anti")
