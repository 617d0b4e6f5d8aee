"""Readers and writers of captured envelopes and of the tables made from them.

An envelope is a JSON line {ts_utc, endpoint, http_status, latency_ms, payload}; the payload's schema is
the category's.  Files lie under root/dt=YYYY-MM-DD/category=name; older trees, root/YYYY-MM-DD/name/key.jsonl.gz,
are read with `layout="plain"`.  Schemas are given, never inferred; a torn gzip tail keeps what came before it,
and `gzip_lines` says which files are torn.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.sources import captures

CANDLE = "struct<end_period_ts:double,yes_bid:struct<close_dollars:string,close:string>,yes_ask:struct<close_dollars:string,close:string>,price:struct<close_dollars:string,close:string>,volume_fp:string,volume:string>"
MARKET = "struct<ticker:string,status:string,open_time:string,close_time:string,volume_fp:string>"
PAYLOADS = {
    "candlesticks": f"struct<ticker:string,candlesticks:array<{CANDLE}>>",
    "markets_history": f"struct<markets:array<{MARKET}>,cursor:string>",
    "markets": f"struct<markets:array<{MARKET}>,market:{MARKET}>",
    "orderbook": "struct<orderbook_fp:struct<yes_dollars:array<array<string>>,no_dollars:array<array<string>>>>",
    "trades": "struct<trades:array<struct<trade_id:string,id:string,ticker:string,price:int,count:int>>,cursor:string>",
    "asos_obs": "struct<station:string,text:string>",
    "cli": "struct<text:string,month:string>",
    "polls": "struct<ticker:string,ok:boolean,event_id:bigint>",
}


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share; a local one only where all of Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/skyledger-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, for what is read more than once."""
    path = scratch(df.sparkSession)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def folders(spark: SparkSession, path: str, prefix: str, whole: bool = False) -> list[int]:
    """The numbers of the folders `prefix=number` under a path, in order; only those written to the end, if `whole`."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    names = [x.getPath() for x in store.listStatus(at)]
    found = [(p, p.getName().partition("=")) for p in names]
    done = lambda p: not whole or store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(n) for p, (name, _, n) in found if name == prefix and done(p))


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_envelopes(spark: SparkSession, root: str, category: str, layout: str = "partitioned", payload: str | None = None) -> DataFrame:
    """All envelopes of a category, with the file each came from.

    Files of the plain layout come through the capture source: of a torn one every complete line counts, and the
    source's own table says which are torn.  Lines that are no JSON are left out.  In the partitioned layout files are whole,
    as Spark commits them, and a damaged one is an error.
    """
    schema = f"ts_utc string, endpoint string, http_status int, latency_ms int, payload {payload or PAYLOADS[category]}"
    if layout == "plain":
        spark.dataSource.register(captures.Captures)
        lines = spark.read.format("captures").option("suffix", ".jsonl.gz").load(root).where(F.col("path").contains(f"/{category}/") & F.col("line").isNotNull())
        rows = lines.select(F.from_json("line", schema).alias("e"), F.col("path").alias("file"))
        return rows.where("e.ts_utc is not null").select("e.*", "file")
    reader = spark.read.schema(schema + ", dt string, category string")
    return reader.json(root).where(F.col("category") == category).withColumn("file", F.col("_metadata.file_path"))


def gzip_lines(files: DataFrame) -> DataFrame:
    """path, members, torn and line of the complete lines in (path, content), as Spark's binaryFile reader gives them.

    A file is a run of gzip members, as a writer appends them; what a torn last member still holds counts up to
    its last line end.  A file without a complete line has one row, with a null line.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                # Whether the last member is torn is only known at the end, so the members are gone through twice.
                source = pa.BufferReader(content.as_buffer() or b"")
                members, torn = 0, False
                for _, _, whole, torn in captures.pieces(source):
                    members += whole
                source.seek(0)
                some = False
                for _, _, lines in captures.lines_of(source):
                    for i in range(0, len(lines), captures.LINES):
                        some = True
                        yield row(path, members, torn, lines[i : i + captures.LINES])
                if not some:
                    yield row(path, members, torn, [None])

    def row(path, members, torn, lines):
        n = len(lines)
        text = [x if x is None else x.decode("utf-8", "replace") for x in lines]
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([members] * n, pa.int32()), pa.array([torn] * n), pa.array(text, pa.string())], names=["path", "members", "torn", "line"])

    return files.select("path", "content").mapInArrow(run, "path string, members int, torn boolean, line string")


def write_envelopes(df: DataFrame, root: str) -> None:
    """Append envelopes, gzip, in folders by the UTC date of `ts_utc` and the category."""
    df.withColumn("dt", F.substring("ts_utc", 1, 10)).write.mode("append").partitionBy("dt", "category").option("compression", "gzip").json(root)


def utc_text(epoch: Column) -> Column:
    """ISO text of epoch seconds, whatever the session's time zone."""
    day = F.date_from_unix_date(F.floor(epoch / 86400).cast("int")).cast("string")
    s = F.pmod(epoch, F.lit(86400)).cast("int")
    return F.concat(day, F.format_string("T%02d:%02d:%02dZ", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60))


def latest_markets(envelopes: DataFrame) -> DataFrame:
    """One row for each ticker, from the last capture; payloads with a list of markets, a single one, or both."""
    fields = [F.coalesce("payload.markets", F.array())]
    if "market" in envelopes.select("payload.*").columns:
        fields.append(F.when(F.col("payload.market").isNotNull(), F.array("payload.market")).otherwise(F.array()))
    rows = envelopes.select("ts_utc", "file", F.posexplode(F.concat(*fields)).alias("pos", "m")).where("m.ticker is not null")
    return rows.groupBy(F.col("m.ticker").alias("ticker")).agg(F.max_by("m", F.struct("ts_utc", "file", "pos")).alias("m")).select("ticker", "m.status", "m.open_time", "m.close_time", F.col("m.volume_fp").try_cast("decimal(18,2)").alias("volume_fp"))


def exploded_candles(envelopes: DataFrame) -> DataFrame:
    """Typed candles with ticker and tier, both naming tiers as one; rows keep the order they were taken in."""
    from skyledger.plans.market import endpoint_columns

    rows = endpoint_columns(envelopes.withColumn("payload_ticker", F.col("payload.ticker"))).where("ticker is not null")
    rows = rows.select("ticker", "tier", "ts_utc", "file", F.posexplode("payload.candlesticks").alias("n", "c")).where("c.end_period_ts is not null")
    money = lambda a: F.coalesce(F.col(f"c.{a}.close_dollars"), F.col(f"c.{a}.close")).try_cast("decimal(6,4)")
    return rows.select("ticker", "tier", F.col("c.end_period_ts").cast("long").alias("end_ts"), money("yes_bid").alias("bid"), money("yes_ask").alias("ask"), money("price").alias("trade_close"), F.coalesce("c.volume_fp", "c.volume").try_cast("decimal(18,2)").alias("volume"), F.struct("ts_utc", "file", "n").alias("pos"))


def observations(envelopes: DataFrame, default: str = "NYC") -> DataFrame:
    """station, valid_ts and tmpf out of CSV texts; the station from the payload, the file's name, or the default.

    The columns are found by the text's header line; values M, null and blank are missing.
    """
    name = F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?(?:\.gz)?$", 1)
    by_name = F.regexp_extract(name, r"^([A-Z0-9]+)_\d{4}-\d{2}$", 1)
    station = F.coalesce(F.when(F.trim("payload.station") != "", F.trim("payload.station")), F.when(by_name != "", by_name), F.lit(default))
    lines = F.split("payload.text", r"\r?\n")
    head = F.transform(F.split(lines[0], ","), lambda x: F.trim(x))
    at = lambda c: F.try_element_at(F.split(F.col("line"), ","), F.array_position("head", c).cast("int"))
    rows = envelopes.select(station.alias("station"), head.alias("head"), F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))
    rows = rows.where(F.array_contains("head", "valid") & F.array_contains("head", "tmpf"))
    stamp = F.trim(at("valid"))
    good = stamp.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$")
    epoch = F.unix_date(F.try_to_date(F.substring(stamp, 1, 10), "yyyy-MM-dd")).cast("long") * 86400 + F.substring(stamp, 12, 2).try_cast("long") * 3600 + F.substring(stamp, 15, 2).try_cast("long") * 60
    return rows.select("station", F.when(good, epoch).alias("valid_ts"), F.trim(at("tmpf")).try_cast("double").alias("tmpf")).where("valid_ts is not null and tmpf is not null and not isnan(tmpf)")


#: The format of the bulletins.
BULLETIN_MARKS = "[\\x01\\x03]"
BULLETIN_HEADER = r"(?m)(?=^CDUS41\s+KOKX\b)"
BULLETIN_WORDS = ("CDUS41", "KOKX", "CLIMATE REPORT")
BULLETIN_SUMMARY = r"(?i)CLIMATE SUMMARY FOR\s+([A-Z]+)\s+(\d{1,2})\s+(\d{4})"
BULLETIN_MAXIMUM = r"(?im)^\s*MAXIMUM\s+(-?\d+|MM)\s+(\d{1,2}:?\d{0,2}\s*[AP]M)?"
BULLETIN_ISSUED = r"(?i)(\d{3,4}\s+[AP]M\s+[A-Z]{3}\s+[A-Z]{3}\s+[A-Z]{3}\s+\d{1,2}\s+\d{4})"
BULLETIN_COLUMN = r"(?i)VALUE\s+(\([^)]+\))"
BULLETIN_SAME_DAY = ("(?i)VALID TODAY AS OF", r"(?is)TEMPERATURE \(F\).*?\n\s*TODAY\b")


def products(envelopes: DataFrame) -> DataFrame:
    """source_month and product of concatenated bulletins, split at control marks or at header lines; blank ones are none."""
    text = F.regexp_replace("payload.text", "\r\n", "\n")
    parts = F.when(text.rlike(BULLETIN_MARKS), F.split(text, BULLETIN_MARKS + "+")).otherwise(F.split(text, BULLETIN_HEADER))
    return envelopes.select(F.col("payload.month").alias("source_month"), F.explode(parts).alias("product")).withColumn("product", F.trim("product")).where("product <> ''")


def possibly_cut(envelopes: DataFrame, most: int) -> DataFrame:
    """Products of each month's captures, and whether they reach what a request returns at most."""
    return products(envelopes).groupBy("source_month").agg(F.count("*").alias("n"), (F.count("*") >= most).alias("maybe_cut"))


def bulletins(envelopes: DataFrame) -> DataFrame:
    """Label issuances out of concatenated bulletins."""
    from skyledger.functions import time

    rows = products(envelopes)
    head = F.upper(F.substring("product", 1, 400))
    for word in BULLETIN_WORDS:
        rows = rows.where(head.contains(word))
    ex = lambda pattern, i=1: F.regexp_extract("product", pattern, i)
    year, month, day = (ex(BULLETIN_SUMMARY, i) for i in (3, 1, 2))
    date = F.try_to_date(F.format_string("%s-%02d-%s", year, time.month_number(month), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return rows.select(
        time.issuance_epoch(ex(BULLETIN_ISSUED)).alias("issuance_ts"),
        date.alias("climate_date"), ex(BULLETIN_MAXIMUM).try_cast("int").alias("high_f"), F.trim(ex(BULLETIN_MAXIMUM, 2)).alias("time_raw"), ex(BULLETIN_COLUMN).alias("time_col_label"),
        (F.col("product").rlike(BULLETIN_SAME_DAY[0]) | F.col("product").rlike(BULLETIN_SAME_DAY[1])).alias("intermediate"), "source_month",
    ).where("climate_date is not null")


def write_notes_csv(df: DataFrame, path: str, notes: list[str]) -> None:
    """A gold table as CSV with a header, and its notes as a text table beside it."""
    df.write.mode("overwrite").option("header", "true").csv(f"{path}/data")
    df.sparkSession.createDataFrame([(n,) for n in notes], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/notes")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; lines that begin with # are notes."""
    return spark.read.schema(schema).option("header", "true").option("comment", "#").csv(path)


def overwrite_days(df: DataFrame, path: str, day: str) -> None:
    """Parquet in folders by day; days that are written again are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


class DayTable:
    """A table by day under a root, of which days are replaced whole: data in a folder for each commit, and manifests.

    A commit writes its days beside what is there, and then a manifest that names the live folder of every day; the
    newest manifest that is written to the end is the table.  So a writer that is lost midway leaves the table as
    it was, a commit that is tried again (by its name) changes nothing, and readers see all of a commit or nothing.
    Data that neither of the last two manifests names is removed.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, day: str):
        self.spark, self.root, self.day = spark, root, day
        self.schema = spark.createDataFrame([], schema).schema

    def manifest(self, back: int = 0) -> tuple[int, list[tuple[int, str]], list[str]]:
        """Number, (day, commit) of each live day, and all commits so far; of the newest manifest, or `back` before it."""
        versions = folders(self.spark, f"{self.root}/manifest", "version", whole=True)
        if len(versions) <= back:
            return -1, [], []
        rows = self.spark.read.schema("day long, commit string, live boolean").parquet(f"{self.root}/manifest/version={versions[-1 - back]}").collect()
        return versions[-1 - back], [(r["day"], r["commit"]) for r in rows if r["live"]], sorted({r["commit"] for r in rows})

    def put(self, rows: DataFrame, commit: str) -> None:
        """Replace the days (whole numbers) that the rows have."""
        number, live, commits = self.manifest()
        if commit in commits:
            return
        path = f"{self.root}/data/commit={commit}"
        rows.select(*self.schema.names).write.mode("overwrite").partitionBy(self.day).parquet(path)
        new = folders(self.spark, path, self.day)
        live = [(d, c) for d, c in live if d not in set(new)] + [(d, commit) for d in new]
        entries = [(d, c, True) for d, c in live] + [(None, c, False) for c in [*commits, commit]]
        self.spark.createDataFrame(entries, "day long, commit string, live boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={number + 1}")
        named = {c for _, c in live} | {c for _, c in self.manifest(1)[1]}
        for old in [c for c in commits if c not in named]:
            removed(self.spark, f"{self.root}/data/commit={old}")

    def rows(self) -> DataFrame:
        paths = [f"{self.root}/data/commit={c}/{self.day}={d}" for d, c in self.manifest()[1]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.root}/data").parquet(*paths).select(*self.schema.names)
