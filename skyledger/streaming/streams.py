"""Streams over landed captures.  Each has a batch twin; run to the end of what has landed, both give the same rows.

Results go to Parquet through checkpointed sinks.  Sinks that write batch by batch keep a folder for each
batch id and replace it, so a batch that is tried again after a failure leaves its rows once.  Tables of
keys with a last row each are kept by `StateTable`: a snapshot and a short tail of batches, so a read stays as
large as the table, however many batches there were.

Where order matters (book changes, probes of watched files) rows wait in state until the watermark has passed them
and then are taken in the order of time, whatever batch they came in; what comes later than the watermark is
left out by Spark.  A key's state goes when the key has been silent for `keep` seconds of event time.  The last rows
come out once the watermark has passed them, so a source has to show that time goes on, as pollers' later rows do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from skyledger.sources.bronze import folders, removed, scratch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def landed(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that has landed into a Parquet table; a second run takes up where the first ended."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    stream.writeStream.outputMode(mode).foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def put_batch(df: DataFrame, out: str, n: int) -> None:
    """The rows of batch n; those of an earlier try are replaced."""
    df.write.mode("overwrite").parquet(f"{out}/batch={n}")


def batches(spark: SparkSession, out: str, schema: StructType, numbers: list[int] | None = None) -> DataFrame:
    """What `put_batch` has written, with the number of the batch; all or some of them, no rows where nothing has."""
    full = StructType([*schema.fields, StructField("batch", LongType())])
    numbers = folders(spark, out, "batch") if numbers is None else numbers
    if not numbers:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", out).parquet(*[f"{out}/batch={n}" for n in numbers])


class StateTable:
    """The last row of each key over all batches, under a root: a snapshot of the batches up to one, and the batches since.

    `put` writes a batch as a folder of its own.  Every `every` batches they are merged with the snapshot to a new one;
    a snapshot counts once it is written to the end, and only then what it holds is removed, the one before it
    at the next merge, for readers that still have it.  So a lost writer leaves a whole table, a batch that is tried again
    changes nothing, and a read takes one snapshot and fewer than `every` batches, however many there were.

    order: what makes a row the last one; the number of the batch if not given.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str], order: list[str] | None = None, every: int = 8):
        self.spark, self.root, self.schema, self.keys, self.every = spark, root, schema, keys, every
        self.order = order or ["batch"]

    def snapshot(self) -> int | None:
        found = folders(self.spark, f"{self.root}/snapshot", "version", whole=True)
        return found[-1] if found else None

    def tail(self, after: int | None) -> list[int]:
        return [n for n in folders(self.spark, f"{self.root}/tail", "batch", whole=True) if after is None or n > after]

    def numbered(self) -> DataFrame:
        """The table with the batch of each row."""
        version = self.snapshot()
        rows = batches(self.spark, f"{self.root}/tail", self.schema, self.tail(version))
        if version is not None:
            rows = self.spark.read.schema(rows.schema).parquet(f"{self.root}/snapshot/version={version}").unionByName(rows)
        values = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), F.struct(*self.order)).alias("r")).select(*self.keys, "r.*")

    def rows(self) -> DataFrame:
        return self.numbered().select(*self.schema.names)

    def put(self, df: DataFrame, n: int) -> None:
        version = self.snapshot()
        if version is not None and n <= version:
            return
        put_batch(df.select(*self.schema.names), f"{self.root}/tail", n)
        if len(self.tail(version)) >= self.every:
            self.merge(n)

    def merge(self, n: int) -> None:
        old = folders(self.spark, f"{self.root}/snapshot", "version")
        self.numbered().write.mode("overwrite").parquet(f"{self.root}/snapshot/version={n}")
        for version in old[:-1]:
            removed(self.spark, f"{self.root}/snapshot/version={version}")
        for batch in [b for b in folders(self.spark, f"{self.root}/tail", "batch") if b <= n]:
            removed(self.spark, f"{self.root}/tail/batch={batch}")


def latest_updates(spark: SparkSession, updates: DataFrame, keys: list[str], out: str, checkpoint: str, order: list[str] | None = None, every: int = 8) -> DataFrame:
    """The last update of each key, of all calls so far with this table and checkpoint."""
    table = StateTable(spark, out, updates.schema, keys, order, every)
    each_batch(updates, table.put, checkpoint)
    return table.rows()


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in the store that timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def heartbeat(polls: DataFrame, late: str = "2 hours") -> DataFrame:
    """Attempts and failures by hour and endpoint; hours later than the watermark are closed."""
    rows = polls.withColumn("ts", F.timestamp_seconds("end_ts")).withWatermark("ts", late)
    hours = rows.groupBy(F.window("ts", "1 hour").alias("w"), "endpoint").agg(F.count("*").alias("attempts"), F.count_if(F.col("ok") == 0).alias("failures"))
    return hours.select(F.unix_seconds("w.start").alias("hour_ts"), "endpoint", "attempts", "failures")


def run_heartbeat(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The heartbeat table, each hour as its last update left it."""
    return latest_updates(spark, heartbeat(landed(spark, path, schema)), ["hour_ts", "endpoint"], scratch(spark), scratch(spark))


def deduplicated(trades: DataFrame, key: str = "trade_id", late: str = "40 days") -> DataFrame:
    """Each id once, across overlapping pages and restarts, as far back as the watermark."""
    return trades.withColumn("ts", F.timestamp_seconds("end_ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key]).drop("ts")


class InOrder(StatefulProcessor):
    """Takes the rows of keys in the order of time once the watermark has passed them.

    Keys share the state of a bucket, so that a batch costs a few calls to the state store for each bucket and not for
    each key.  Rows wait as packed frames with their first time, so that a call costs by its frames and not by its rows; a timer
    at the first of them brings up the frames that the watermark has reached.  `keep` seconds after a key's last row
    what is known of it goes.  Subclasses say which columns keys and rows have (`KEY` and `ROW`, the time in seconds first),
    what is remembered of a key (`STATE`), what rows in order give (`taken`), and which rows need not wait (`thinned`).
    """

    KEY = ROW = STATE = OUT = ""
    #: Rows of a packed frame of those that wait on.
    FRAME = 1 << 16

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first long, frame binary")
        self.known = handle.getValueState("known", "frame binary")
        self.keys, self.row = named(self.KEY), named(f"{self.KEY}, {self.ROW}")
        self.state = named(f"{self.KEY}, last_ts long, {self.STATE}")
        self.ts = self.row.names[len(self.keys)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [self.thinned(frame[self.row.names]) for frame in rows if len(frame)]
        self.waiting.appendList([(int(frame[self.ts].min()), packed(frame, self.row)) for frame in new])
        self.handle.registerTimer(max(min(int(frame[self.ts].min()) for frame in new) * 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        frames = list(self.waiting.get())
        rows = unpacked([frame for first, frame in frames if first * 1000 < now], self.row)
        passed = pc.less(pc.multiply(rows[self.ts], 1000), now)
        ready, rest = rows.filter(passed), rows.filter(pc.invert(passed))
        order = pc.sort_indices(ready, [(c, "ascending") for c in self.row.names], null_placement="at_start")
        before = self.known.get()
        known = plain(unpacked([before[0]] if before else [], self.state))
        found = None
        if len(order):
            found, known = self.taken(plain(ready.take(order)), known)
            waiting = [(first, frame) for first, frame in frames if first * 1000 >= now]
            for at in range(0, len(rest), self.FRAME):
                own = rest.slice(at, self.FRAME)
                waiting.append((pc.min(own[self.ts]).as_py(), packed(own, self.row)))
            self.waiting.put(waiting) if waiting else self.waiting.clear()
        left = known[(known["last_ts"] + self.keep) * 1000 >= now]
        if len(order) or len(left) < len(known):
            self.known.update((packed(left, self.state),)) if len(left) else self.known.clear()
        if len(order):
            for at in ([min(first for first, _ in waiting)] if waiting else []) + ([int(left["last_ts"].min()) + self.keep] if len(left) else []):
                self.handle.registerTimer(max(at * 1000, now) + 1)
        if found is not None and len(found):
            kinds = {c.split()[0]: {"long": "Int64", "double": "Float64", "string": "object"}[c.split()[1]] for c in self.OUT.split(",")}
            yield found[list(kinds)].astype(kinds)

    def close(self) -> None:
        pass

    def thinned(self, frame: pd.DataFrame) -> pd.DataFrame:
        """The rows of those that came in together which have to wait; all, if not given."""
        return frame

    def taken(self, rows: pd.DataFrame, known: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """What rows in the order of keys and time give, and what is known of all keys after them."""
        raise NotImplementedError


def named(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(","))])


def packed(rows: pd.DataFrame | pa.Table, schema: pa.Schema) -> bytes:
    """Rows as an Arrow stream; NaN counts as null."""
    table = rows if isinstance(rows, pa.Table) else pa.Table.from_pandas(rows, schema, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(frames: list[bytes], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *[pa.ipc.open_stream(bytes(f)).read_all() for f in frames]])


def plain(table: pa.Table) -> pd.DataFrame:
    """Longs stay whole numbers where some are null."""
    return table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


class BookChanges(InOrder):
    """Rows whose quote differs from the last one seen, null-safe; the first of a ticker is none."""

    KEY, ROW, STATE = "ticker string", "end_ts long, bid double, ask double", "bid double, ask double"
    OUT = "ticker string, end_ts long, bid double, ask double"

    def taken(self, rows, known):
        both = pd.concat([known.rename(columns={"last_ts": "end_ts"}), rows], ignore_index=True)
        codes, _ = pd.factorize(both["ticker"], use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")  # what is known of a ticker comes before its rows
        both, codes = both.iloc[order], codes[order]
        same, differs = np.append(False, codes[1:] == codes[:-1]), np.zeros(len(both), bool)
        for c in ("bid", "ask"):
            x = both[c].to_numpy(float, na_value=np.nan)
            differs[1:] |= (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
        last = np.append(codes[1:] != codes[:-1], True)
        return both[same & differs], both[last].rename(columns={"end_ts": "last_ts"})


class Probes(InOrder):
    """pending, waiting, then complete or, where the first probe already succeeds, pre_existing; ends change no more."""

    KEY, ROW, STATE = "source string, nominal_ts long, fhour long", "probe_ts long, probe_id long, http_status long, modified_ts long", "status string, first long, modified long"
    OUT = "source string, nominal_ts long, fhour long, status string, first_min double, modified_min double"

    def firsts(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Of rows in order, each file's first success and first failure from its nominal time on."""
        due = rows["probe_ts"] >= rows["nominal_ts"]
        success = (rows["http_status"] == 200).fillna(False).astype(bool)
        return rows[due & success].drop_duplicates(self.keys.names), rows[due & ~success].drop_duplicates(self.keys.names)

    def thinned(self, frame):
        """Beside a file's first success and failure its first and last row, for when it is heard of and silent; all, if time goes on for longer than states are kept."""
        if frame["probe_ts"].max() - frame["probe_ts"].min() > self.keep:
            return frame
        rows = frame.sort_values(self.row.names, na_position="first", ignore_index=True)
        ends = [rows.drop_duplicates(self.keys.names, keep=k) for k in ("first", "last")]
        return rows.loc[sorted({i for some in (*ends, *self.firsts(rows)) for i in some.index})]

    def taken(self, rows, known):
        by_key = lambda some: {r[:3]: r for r in ((*(None if pd.isna(x) else x for x in r[1:]), r[0]) for r in some.itertuples(name=None))}
        hits, fails = (by_key(some) for some in self.firsts(rows))
        states = {key: r[3:7] for key, r in by_key(known).items()}
        ends = by_key(rows.drop_duplicates(self.keys.names, keep="last"))
        out = []
        minutes = lambda x, nominal: None if x is None else (x - nominal) / 60.0
        for key, end in ends.items():
            _, status, first, modified = states.get(key, (None, "pending", None, None))
            hit, fail = hits.get(key), fails.get(key)
            if status not in ("complete", "pre_existing"):
                waited = status == "waiting" or (fail is not None and (hit is None or fail[-1] < hit[-1]))
                if hit is not None:
                    modified = hit[6]
                    status, first = ("complete", hit[3]) if waited else ("pre_existing", None)
                elif waited:
                    status = "waiting"
            states[key] = end[3], status, first, modified
            out.append((*key, status, minutes(first, key[1]), minutes(modified, key[1])))
        after = pd.DataFrame([(*key, *state) for key, state in states.items()], columns=self.state.names)
        after = after.astype({f.name: "Int64" for f in self.state if f.type == pa.int64()})
        return pd.DataFrame(out, columns=[c.split()[0] for c in self.OUT.split(",")]), after


def in_order(rows: DataFrame, keys: list[str], ts: str, late: str, processor: InOrder, mode: str, buckets: int) -> DataFrame:
    timed = rows.withColumn("ts", F.timestamp_seconds(ts)).withWatermark("ts", late).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    return timed.groupBy("bucket").transformWithStateInPandas(processor, processor.OUT, mode, "eventTime")


def changes(quotes: DataFrame, late: str = "1 hour", keep: int = 90 * 86400, buckets: int = 64) -> DataFrame:
    """Book changes of (ticker, end_ts, bid, ask); rows may come up to `late` behind the newest of all."""
    return in_order(quotes, ["ticker"], "end_ts", late, BookChanges(keep), "Append", buckets)


def availability(probes: DataFrame, late: str = "1 hour", keep: int = 90 * 86400, buckets: int = 64) -> DataFrame:
    """An update of a watched file's state whenever probes of it are taken; one that says nothing new may be left out."""
    return in_order(probes, ["source", "nominal_ts", "fhour"], "probe_ts", late, Probes(keep), "Update", buckets)


def sweep_step(before: DataFrame, now: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Of complete sweeps (sweep, key) and those of a new batch: what drops out at each next sweep, and the last sweep."""
    rows = before.unionByName(now).distinct()
    sweeps = rows.select("sweep").distinct()  # a row for each sweep of the batch
    order = Window.partitionBy(F.lit(0)).orderBy("sweep")
    following = sweeps.withColumn("next", F.lead("sweep").over(order))
    gone = rows.join(following, "sweep").where("next is not null").select(F.col("next").alias("sweep"), key)
    last = following.where("next is null").select("sweep")
    return gone.join(rows, ["sweep", key], "left_anti"), rows.join(last, "sweep", "left_semi")


def run_open_set(spark: SparkSession, sweeps: DataFrame, root: str, key: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """Dropped (sweep, key) markets of all sweeps so far, and the set (sweep, key) open after the last.

    `sweeps` streams (sweep, complete, key) rows; a sweep lands at once.  A sweep that is not complete changes
    nothing, as its missing markets may only not have been asked for.  Everything is kept under `root`: another
    call with the same root, in this process or a later one, goes on after the last batch, from the set that
    the batch before left.  The first sweep opens markets and drops none.
    """
    rows = StructType([f for f in sweeps.schema.fields if f.name in ("sweep", key)])
    state, gone = f"{root}/open", f"{root}/dropped"

    def step(df: DataFrame, n: int) -> None:
        earlier = [m for m in folders(spark, state, "batch", whole=True) if m < n]
        before = batches(df.sparkSession, state, rows, earlier[-1:]).select("sweep", key)
        dropped, last = sweep_step(before, df.where("complete").select("sweep", key), key)
        put_batch(dropped.select("sweep", key), gone, n)
        put_batch(last.select("sweep", key), state, n)
        for m in earlier[:-1]:  # the set before stays, for a batch that is tried again
            removed(spark, f"{state}/batch={m}")

    each_batch(sweeps.select("sweep", "complete", key), step, f"{root}/checkpoint", "append")
    return batches(spark, gone, rows).drop("batch"), batches(spark, state, rows, folders(spark, state, "batch", whole=True)[-1:]).select("sweep", key)
