"""Substring removal by suffix automata: passages of `length` words that also start earlier go.

Reference shards: the regions around one repeated anchor (see `repeats`), in order of place, are one
shard.  Its suffix automaton grows word by word while the regions stream through it; the matching
statistic of a word is the length of the longest run ending there that ended earlier in the shard, which
the automaton has at hand as the length of its last state's suffix link.  Where it reaches `length`,
the last `length` words are a passage that also starts earlier.  Every passage meets all its earlier
copies, since they share its anchor, and a shard is small, however large the input.

Cases: a null or empty text has no words and keeps none; texts shorter than `length` lose nothing; equal
rows are one document and give equal results; rows of one id with different texts are documents of their
own, in the order of a hash of the texts; a row with a null id neither loses nor hides anything; an empty table gives an empty one; other columns are ignored by `digests`,
and kept by `trimmed`.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import blocks
from skyledger.llm.repeats import Units, covered, with_spans

LENGTH = 20
#: No symbol.
NONE = -(1 << 63)
GRAM = 6
#: Bytes of reference text in a broadcast automaton, about; some ten times as many in memory.
SHARD_BYTES = 1 << 20


class SuffixAutomaton:
    """Of a sequence of numbers that grows at its end.

    Most states have one way on; its number and target are kept in flat arrays, further ones in dictionaries.
    """

    def __init__(self):
        self.symbol, self.target, self.link, self.length = array("q", [NONE]), array("q", [0]), array("q", [-1]), array("q", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.last = 0

    def step(self, state: int, symbol: int) -> int:
        """The state that the symbol leads to, or -1."""
        if self.symbol[state] == symbol:
            return self.target[state]
        more = self.more.get(state)
        return more.get(symbol, -1) if more else -1

    def lead(self, state: int, symbol: int, to: int) -> None:
        if self.symbol[state] in (NONE, symbol):
            self.symbol[state], self.target[state] = symbol, to
        else:
            self.more.setdefault(state, {})[symbol] = to

    def state(self, link: int, length: int, symbol: int = NONE, target: int = 0) -> int:
        for column, value in ((self.symbol, symbol), (self.target, target), (self.link, link), (self.length, length)):
            column.append(value)
        return len(self.link) - 1

    def extend(self, symbol: int) -> int:
        """Append; returns the length of the longest suffix that also ends earlier."""
        link, length = self.link, self.length
        p = self.last
        new = self.last = self.state(0, length[p] + 1)
        while p >= 0 and (q := self.step(p, symbol)) < 0:
            self.lead(p, symbol, new)
            p = link[p]
        if p >= 0:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = self.state(link[q], length[p] + 1, self.symbol[q], self.target[q])
                if q in self.more:
                    self.more[copy] = self.more[q].copy()
                while p >= 0 and self.step(p, symbol) == q:
                    self.lead(p, symbol, copy)
                    p = link[p]
                link[q] = link[new] = copy
        return length[link[new]]

    def statistics(self, symbols):
        """For each symbol the length of the longest run ending there that stands in the sequence; the automaton stays as it is."""
        state, n = 0, 0
        for symbol in symbols:
            while state and self.step(state, symbol) < 0:
                state = self.link[state]
                n = self.length[state]
            if (to := self.step(state, symbol)) >= 0:
                state, n = to, n + 1
            yield n


def sequences(group: list[tuple[int, int, int, bytes]]):
    """The regions of a group with those of one document that overlap as one: doc, start, words."""
    doc = start = stop = None
    words: list[bytes] = []
    for d, a, b, payload in group:
        own = payload.split(b" ")
        if d == doc and a <= stop:
            words += own[stop - a :] if b > stop else []
            stop = max(stop, b)
            continue
        if doc is not None:
            yield doc, start, words
        doc, start, stop, words = d, a, b, own
    yield doc, start, words


class Shards:
    """Finds the repeats in one group of regions at a time, by an automaton that grows while they stream through it."""

    def __init__(self, length: int):
        self.least = length

    def add(self, group: list[tuple[int, int, int, bytes]]):
        shard, seen, numbers, least = SuffixAutomaton(), set(), {}, self.least
        for n, (doc, start, words) in enumerate(sequences(group)):
            whole = tuple(words)
            if whole in seen:
                yield doc, start, start + len(words)
                continue
            seen.add(whole)
            shard.extend(-1 - n)  # a separator, no word's number
            first = None
            for i, word in enumerate(words):
                if shard.extend(numbers.setdefault(word, len(numbers))) >= least:
                    if first is None:
                        first = i - least + 1
                elif first is not None:
                    yield doc, start + first, start + i
                    first = None
            if first is not None:
                yield doc, start + first, start + len(words)

    def end(self):
        return ()


def spans_of(statistics, length: int) -> list[tuple[int, int]]:
    """The maximal runs of words that lie in runs of `length` or more which the statistics report."""
    out: list[list[int]] = []
    for i, n in enumerate(statistics):
        if n >= length:
            if out and i - length + 1 <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([i - length + 1, i + 1])
    return [tuple(x) for x in out]


def numbered(words: list[bytes]) -> list[int]:
    """A number of 62 bits for each word."""
    return [xxhash.xxh64_intdigest(w) >> 2 for w in words]


def shards(reference: DataFrame, text_col: str, most: int) -> Iterator[SuffixAutomaton]:
    """Automata over the reference texts, each over `most` bytes of them or one longer text; one in the driver at a time."""
    shard, size = SuffixAutomaton(), 0
    for n, row in enumerate(reference.select(F.col(text_col).alias("t")).where("t is not null").toLocalIterator()):
        text = row["t"].encode()
        if size and size + len(text) > most:
            yield shard
            shard, size = SuffixAutomaton(), 0
        shard.extend(-1 - n)  # a separator, no word's number
        for word in numbered(text.split()):
            shard.extend(word)
        size += len(text)
    if size:
        yield shard


def stripped(docs: DataFrame, reference: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, text_col: str = "text", reference_text: str = "text") -> DataFrame:
    """The rows of `docs` without the words in passages of `length` that stand in a reference text, with their white space.

    For a reference of its own, of bounded size (boilerplate, licences): each shard's automaton is broadcast and all
    documents stream past it, a pass for each `shard_bytes` of reference.  Spans of all shards are gathered
    before anything is cut.  The column `spans` is used meanwhile and may not be one of `docs`.
    """
    rows = docs.withColumn("spans", F.array().cast("array<struct<a:int,b:int>>"))
    for shard in shards(reference, reference_text, shard_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches, sent=sent):
            for block in blocks(batches, text_col):
                found = []
                for text, spans in zip(block.column(text_col).to_pylist(), block.column("spans").to_pylist()):
                    found.append(spans + [{"a": a, "b": b} for a, b in spans_of(sent.value.statistics(numbered((text or "").encode().split())), length)])
                yield block.set_column(block.schema.get_field_index("spans"), "spans", pa.array(found, block.schema.field("spans").type))

        rows = rows.mapInArrow(run, rows.schema)

    def cut(batches):
        for block in blocks(batches, text_col):
            kept = pa.array(without(block.column(text_col), block.column("spans").to_pylist()), pa.string())
            yield block.set_column(block.schema.get_field_index(text_col), text_col, kept).drop_columns(["spans"])

    return rows.mapInArrow(cut, docs.schema)


def without(texts: pa.Array, spans: list) -> list[str | None]:
    """The texts without the words of their spans, in their own white space; those without spans as they are."""
    data, starts, ends, first = Units(True, 1, 1).cut(texts)
    whole, out = data.tobytes(), []
    for i, (text, own) in enumerate(zip(texts.to_pylist(), spans)):
        if own:
            a, b = int(first[i]), int(first[i + 1])
            keep = np.flatnonzero(~covered([(s["a"], s["b"]) for s in own], b - a)) + a
            # A kept word brings the white space before it along, except where it begins the text.
            before = np.where(keep > a, ends[np.maximum(keep - 1, 0)], starts[keep])
            text = b"".join([whole[x:y] for x, y in zip(before.tolist(), ends[keep].tolist())]).strip().decode()
        out.append(text)
    return out


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    rows = with_spans(docs, Units(True, length, gram), lambda: Shards(length), id_col, text_col)

    def run(batches):
        for block in blocks(batches, "text"):
            n_words, removed, digest = [], [], []
            for text, spans in zip(block.column("text").to_pylist(), block.column("spans").to_pylist()):
                words = (text or "").encode().split()
                gone = covered([(s["a"], s["b"]) for s in spans or ()], len(words))
                n_words.append(len(words))
                removed.append(int(gone.sum()))
                kept = words if not removed[-1] else [words[i] for i in np.flatnonzero(~gone).tolist()]
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def trimmed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with the words that remain, in their own white space; a text that loses nothing stays as it is."""
    rows = with_spans(docs, Units(True, length, gram), lambda: Shards(length), id_col, text_col, rest=True)

    def run(batches):
        for block in blocks(batches, "text"):
            kept = without(block.column("text"), block.column("spans").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), block.column("rest")], names=["text", "rest"])

    done = rows.select("text", "rest", "spans").mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), rows.schema["rest"]]))
    return done.select(*[(F.col("text") if c == text_col else F.col("rest").getField(c)).alias(c) for c in docs.columns])
