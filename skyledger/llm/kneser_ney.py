"""Quality by an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted texts.  Their n-grams of the highest order are counted in Spark; the counts
of lower orders are the numbers of different characters before (continuation counts), each derived from the
order above; three discounts an order come from the counts of counts.  Probabilities are built up from order 1
by joins of count tables dealt out by hash: each n-gram with its context's totals and its suffix's probability.
Scoring looks n-grams up by 64-bit hashes.

A text's perplexity needs the rows of its own n-grams alone.  Texts are dealt out in blocks of about
BLOCK_TEXT bytes; every block asks once for each of its different n-grams and contexts; what is asked is joined
with the model, shard by shard of the hash, and the answers go back to the block, where back-off sums them up for each
text.  What a task holds is bounded by the block, whatever the model's size.

A text is kept if its perplexity is within the `quantile` of trusted texts of its language that were held out
of training (a fifth of them), or of all held-out texts where its language has fewer than `ENOUGH`.

Cases: a null or empty text has no perplexity and is not kept; a null language is a language of its own;
repeated rows train again and give repeated results; without trusted texts every text with a character is
kept; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import among, blocks, mix, scope, shuffle_partitions, stored, text_bytes

ORDER = 5
#: Bytes of text that ask for their n-grams together, about, and of text that is packed at a time.
BLOCK_TEXT, PACKED = 32 << 20, 16 << 20
ENOUGH = 50
QUANTILE = 0.995
#: Different n-grams that a task counts before it hands them on.
COUNTED = 400_000
#: How hard packed texts are compressed.
ZSTD_LEVEL = 5
#: Hashes of a batch that is asked.
ASKED = 1 << 16
START = 2
_WHITE = np.zeros(0x110000, dtype=bool)
_WHITE[[0x20, 0xA0, *range(0x09, 0x0E)]] = True


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the texts with runs of white space as one blank, ORDER - 1 start marks before each text.

    Returns the characters, which of them are scored, and which text each is of.
    """
    data, offsets = text_bytes(texts)
    n = len(texts)
    raw = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    firsts = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    white = _WHITE[raw]
    text_of = np.repeat(np.arange(n), np.diff(firsts))
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = ~(white[1:] & white[:-1] & (text_of[1:] == text_of[:-1]))
    raw = np.where(white, np.uint32(0x20), np.maximum(raw, 1))[keep]
    text_of = text_of[keep]
    pad = ORDER - 1
    place = np.arange(len(raw)) + pad * (text_of + 1)
    out = np.full(len(raw) + pad * n, START, dtype=np.uint64)
    out[place] = raw
    scored = np.zeros(len(out), dtype=bool)
    scored[place] = True
    owner = np.zeros(len(out), dtype=np.int64)
    owner[place] = text_of
    return out, scored, owner


def gram_hash(rows: np.ndarray) -> np.ndarray:
    """The hash of each row of characters."""
    k = rows.shape[1]
    running = np.zeros(len(rows), dtype=np.uint64)
    for j in range(k):
        running += rows[:, k - 1 - j] * np.uint64(pow(0x9E3779B97F4A7C15, j, 1 << 64))
    return mix(running + np.uint64(k))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different grams of ORDER characters in the texts as rows, which of them ends at each scored place, and the place's text."""
    chars, scored, owner = characters(texts)
    at = np.flatnonzero(scored)
    running = np.zeros(len(chars), dtype=np.uint64)
    for j in range(ORDER):
        running[j:] += chars[: len(chars) - j] * np.uint64(pow(0x9E3779B97F4A7C15, j, 1 << 64))
    which, _ = pd.factorize(running[at].view(np.int64))
    first = np.zeros(which.max(initial=-1) + 1, dtype=np.int64)
    first[which[::-1]] = at[::-1]
    return np.stack([chars[first - j] for j in range(ORDER - 1, -1, -1)], axis=1), which, owner[at]


def suffixes(rows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order from 1 the hashes of the rows' last characters, and of their contexts: the same without the last."""
    return [gram_hash(rows[:, ORDER - k :]) for k in range(1, ORDER + 1)], [gram_hash(rows[:, ORDER - k : ORDER - 1]) for k in range(2, ORDER + 1)]


def count_grams(texts: DataFrame) -> DataFrame:
    """gram (ORDER characters) and n: how often each stands in the texts, start marks included."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            rows, n = (np.concatenate(x) for x in zip(*held))
            which, _ = pd.factorize(gram_hash(rows).view(np.int64))
            first = np.zeros(which.max(initial=-1) + 1, dtype=np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            return rows[first], np.bincount(which, weights=n).astype(np.int64)

        def out(rows, n):
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows.astype("<u4")).view(f"<U{ORDER}")[:, 0].tolist(), pa.string()), pa.array(n)], names=["gram", "n"])

        for block in blocks(batches, "text"):
            rows, which, _ = grams(block.column("text"))
            if not len(rows):
                continue
            held.append((rows, np.bincount(which)))
            if sum(len(h[0]) for h in held) > COUNTED:
                held = [merged()]
                if len(held[0][0]) > COUNTED // 2:
                    yield out(*held[0])
                    held = []
        if held:
            yield out(*merged())

    return texts.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(level: DataFrame) -> list[float]:
    """The discounts for counts 1, 2 and 3 or more, from the counts of counts."""
    row = level.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]).first()
    n = [row[f"n{k}"] for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) if n[k] else (k + 1) * 0.5 for k in range(3)]


def hashed(model: DataFrame) -> DataFrame:
    """The model with the hash of its grams in place of them; 0 for the empty one."""

    def run(batches):
        for batch in batches:
            texts = batch.column("gram").to_pylist()
            out = np.zeros(len(texts), dtype=np.uint64)
            sizes = np.array([len(g) for g in texts], dtype=np.int64)
            for k in range(1, ORDER + 1):
                own = np.flatnonzero(sizes == k)
                if len(own):
                    chars = np.frombuffer("".join([texts[i] for i in own]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                    out[own] = gram_hash(chars.reshape(-1, k))
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), batch.column("p"), batch.column("w")], names=["h", "p", "w"])

    return model.select("gram", "p", "w").mapInArrow(run, "h long, p double, w double")


def train(texts: DataFrame) -> DataFrame | None:
    """The model: h (the hash of a gram, or of a context), p (a gram's log probability) and w (the log weight
    that a context leaves to the order below), as floats; h = 0 is any unknown character.  None without any text."""
    with scope(texts.sparkSession):
        return trained(texts)


def trained(texts: DataFrame) -> DataFrame | None:
    levels = {ORDER: stored(count_grams(texts))}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = stored(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")))
    size = levels[1].count()
    if not size:
        return None
    none = F.lit(None).cast("double")
    discount = lambda k: (lambda d: F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2]))(discounts(levels[k]))
    # Order 1 has one context, the empty one: its totals are two numbers.
    rows = levels[1].select("gram", "n", discount(1).alias("d"))
    total, taken = rows.agg(F.sum("n"), F.sum("d")).first()
    rest = taken / total / (size + 1)
    below = rows.select("gram", ((F.col("n") - F.col("d")) / total + rest).alias("q"))
    unknown = texts.sparkSession.range(1).select(F.lit("").alias("gram"), F.lit(math.log(rest)).alias("p"), none.alias("w"))
    parts = [unknown, below.select("gram", F.log("q").alias("p"), none.alias("w"))]
    for k in range(2, ORDER + 1):
        rows = levels[k].select("gram", F.substring("gram", 1, k - 1).alias("c"), F.substring("gram", 2, k - 1).alias("s"), "n", discount(k).alias("d"))
        totals = stored(rows.groupBy("c").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("left")))
        parts.append(totals.select(F.col("c").alias("gram"), none.alias("p"), F.log("left").alias("w")))
        joined = rows.join(totals, "c").join(below.select(F.col("gram").alias("s"), "q"), "s")
        below = stored(joined.select("gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("left") * F.col("q")).alias("q")))
        parts.append(below.select("gram", F.log("q").alias("p"), none.alias("w")))
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    model = hashed(model.groupBy("gram").agg(F.max("p").alias("p"), F.max("w").alias("w")))
    return stored(model.select("h", F.col("p").cast("float").alias("p"), F.col("w").cast("float").alias("w")), outer=True)


class Lookup:
    """Model rows in memory, by hash."""

    def __init__(self, h: np.ndarray, p: np.ndarray, w: np.ndarray):
        order = np.argsort(h)
        self.h, self.p, self.w = h[order], p[order], w[order]
        self.unknown = float(self.p[np.searchsorted(self.h, 0)])

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p (NaN where it is no gram) and w (0 where it is no context) of each hash."""
        hashes = hashes.view(np.int64)
        at = np.minimum(np.searchsorted(self.h, hashes), len(self.h) - 1)
        there = self.h[at] == hashes
        return np.where(there, self.p[at], np.nan), np.where(there, np.nan_to_num(self.w[at], nan=0.0), 0.0)

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Of the last character of each row after the others: of the longest known gram, with the weights of longer contexts."""
        own, contexts = suffixes(rows)
        total, open_ = np.zeros(len(rows)), np.arange(len(rows))
        for k in range(ORDER, 0, -1):
            p, _ = self.of(own[k - 1][open_])
            found = ~np.isnan(p)
            total[open_[found]] += p[found]
            open_ = open_[~found]
            if k > 1 and len(open_):
                total[open_] += self.of(contexts[k - 2][open_])[1]
        total[open_] += self.unknown
        return total

    def perplexities(self, texts: pa.Array) -> np.ndarray:
        rows, which, owner = grams(texts)
        n = len(texts)
        if not len(rows):
            return np.full(n, np.nan)
        sums = np.bincount(owner, weights=self.log_probabilities(rows)[which], minlength=n)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.exp(-sums / np.bincount(owner, minlength=n))


def packed(texts: DataFrame, n_blocks: int) -> DataFrame:
    """block and rows: the rows of `texts` by block, some at a time, as compressed Arrow data."""
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int"))
    names = texts.columns

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        block = rows.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], block[order][1:] != block[order][:-1], [True])))
        found, data = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = rows.select(names).take(pa.array(order[a:b])).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD_LEVEL))) as writer:
                writer.write_table(own)
            found.append(int(block[order[a]]))
            data.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(data, pa.binary())], names=["block", "rows"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > PACKED:
                yield from out(held)
                held, size = [], 0
        if held:
            yield from out(held)

    return dealt.mapInArrow(run, "block int, rows binary")


def unpacked(column: pa.Array) -> Iterator[pa.RecordBatch]:
    for data in column:
        with pa.ipc.open_stream(data.as_buffer()) as reader:
            yield from blocks(reader, "text")


def perplexities(texts: DataFrame, model: DataFrame, block_text: int = BLOCK_TEXT) -> DataFrame:
    """The rows of `texts` (columns id and text among them) without text, with their perplexity."""
    names = [c for c in texts.columns if c != "text"]
    schema = T.StructType([*[texts.schema[c] for c in names], T.StructField("perplexity", T.DoubleType())])
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = packed(texts, 1 + size // block_text).repartition(shuffle_partitions(texts.sparkSession), "block")

    def asked(block: int, seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = pd.unique(np.concatenate([np.zeros(1, dtype=np.int64), *seen]))
        for i in range(0, len(found), ASKED):
            part = found[i : i + ASKED]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, dtype=np.int32)), pa.array(part)], names=["block", "h"])

    def ask(batches):
        last, seen = None, []
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                if block != last and seen:
                    yield from asked(last, seen)
                    seen = []
                last = block
                for part in unpacked(batch.column("rows").slice(i, 1)):
                    own, contexts = suffixes(grams(part.column("text"))[0])
                    seen.append(pd.unique(np.concatenate([*own, *contexts]).view(np.int64)))
                if len(seen) > 8:
                    seen = [pd.unique(np.concatenate(seen))]
        if seen:
            yield from asked(last, seen)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        lookup = Lookup(*[right.column(c).to_numpy() for c in ("h", "p", "w")])
        out = []
        for batch in left.to_batches():
            for part in unpacked(batch.column("rows")):
                values = lookup.perplexities(part.column("text"))
                out.append(pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(values, pa.float64(), mask=np.isnan(values))], names=[*names, "perplexity"]))
        return pa.Table.from_batches(out)

    asks = dealt.sortWithinPartitions("block").mapInArrow(ask, "block int, h long")
    answers = asks.join(model, "h").select("block", "h", "p", "w")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, schema)


def judged(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, block_text: int = BLOCK_TEXT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept of every row; `trusted` has the ids of trusted documents (doc_id)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    good = trusted.select(F.col("doc_id").alias("id")).distinct().withColumn("held", F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    model = train(among(texts, good.where("not held").select("id"), "id"))
    if model is None:
        scored = texts.select("id", "lang", F.when(F.length("text") > 0, 1.0).alias("perplexity"))
        return scored.select(F.col("id").alias("doc_id"), "lang", "perplexity", F.lit(None).cast("double").alias("threshold"), F.col("perplexity").isNotNull().alias("kept"))
    scored = stored(perplexities(texts, model, block_text))
    held = scored.join(good.where("held"), "id", "left_semi").where("perplexity is not null")
    overall = held.agg(F.percentile_approx("perplexity", quantile, 10000)).first()[0]
    by_lang = held.groupBy(F.col("lang").alias("l")).agg(F.percentile_approx("perplexity", quantile, 10000).alias("own"), F.count("*").alias("n")).where(F.col("n") >= ENOUGH)
    joined = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    return joined.select(F.col("id").alias("doc_id"), "lang", "perplexity", "threshold", (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("kept"))
