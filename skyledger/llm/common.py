"""Helpers that several of the operators share: tables, shared folders, Arrow blocks, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step works on; a longer text is a step of its own.
BLOCK_BYTES = 1 << 19

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
_scopes: list[list] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only where all of Spark is local and none is named."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, outer: bool = False) -> DataFrame:
    """As checkpoint, but as Parquet: smaller, and read column by column.  `outer`: it outlives the scope it is stored in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if len(_scopes) > outer:
        _scopes[-1 - outer].append((path, schema))
    return spark.read.schema(schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is stored within is emptied at the end; nothing that is used later may hang on it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path, schema in _scopes.pop():
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


#: Ids up to which they are sent to the texts, so that the texts stay where they are.
FEW_IDS = 1 << 20


def among(texts: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The texts with one of the ids (one column).  At most FEW_IDS ids, counted first, are sent to the texts; more are joined."""
    ids = ids.withColumnRenamed(ids.columns[0], "_among_id")
    few = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    return texts.join(few, texts[on] == few["_among_id"], "left_semi")


def small(df: DataFrame) -> DataFrame:
    """A table that is sent to all tasks if it has FEW_IDS rows or fewer, counted first; else it is joined."""
    return F.broadcast(df) if df.count() <= FEW_IDS else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches, column: int | str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into row runs of about `most` bytes of text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        offsets = text_offsets(batch.column(column))
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task; workers are used again and would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row's begin and end in them; null rows are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = text_offsets(texts)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, from one running sum."""
    up, down = powers(len(values) + 1)
    running = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=running[1:])
    return mix((running[ends] - running[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+ in the bytes, and the first word of each row (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    black = ~WHITE[data]
    begins = np.empty(n, dtype=bool)
    begins[0] = True
    np.logical_not(black[:-1], out=begins[1:])
    begins[offsets[:-1][offsets[:-1] < n]] = True
    ends = np.empty(n, dtype=bool)
    ends[:-1] = begins[1:] | ~black[1:]
    ends[-1] = True
    starts = np.flatnonzero(begins & black)
    return starts, np.flatnonzero(ends & black) + 1, np.searchsorted(starts, offsets)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive hashes; shorter than the input by n - 1."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(_BASE)
        out += hashes[k : k + m]
    return mix(out)


def crc32_text(column) -> "F.Column":
    return F.crc32(column.cast("string").cast("binary"))
