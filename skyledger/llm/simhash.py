"""SimHash classes by a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight bytes at eight positions.  Fingerprints that differ in `radius` bits or
fewer share `8 - radius` positional bytes at least: the guaranteed minimum.  Of the two halves of the
positions one then holds half of that number, rounded up, of the shared bytes; so the inverted index keeps a
posting list for each choice of so many positions of a half and the bytes there (eight lists a fingerprint
at radius 3, of three bytes each), and every pair that reaches the minimum meets in one.  In a list the
shared positional bytes of pairs are tallied over all eight positions, pairs that reach the minimum are
retained, and those are verified by their differing bits.

Only different fingerprints enter the index, once each.  A list of more than MOST_LIST fingerprints is not
searched but dealt again by further positions, until its fingerprints agree in the whole minimum; such a list
has at most 2^(8 * radius).  Long lists give a spanning forest of their links instead of all pairs; components
over all lists are the same.

Cases: a null or empty text, or one without words, has the fingerprint zero, linked like any other; a
text shorter than a shingle is one shingle; equal texts are one fingerprint; repeated rows give repeated
results; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import blocks, shuffle_partitions, stored
from skyledger.llm.graph import components

SEED = 42
#: Fingerprints of a list beyond which it is dealt again by further positions.
MOST_LIST = 1 << 16
#: Lists up to this length are compared many at a time.
SHORT_LIST = 48
#: A list is searched by flipping bits where its fingerprints are so many times as many as the flips.
FLIPS = 40
#: Links of a batch.
BATCH_LINKS = 1 << 16


def shingles(text: bytes, size: int) -> list[bytes]:
    """The text's runs of `size` words, A-Z lower-cased, joined by one blank; of a shorter text the whole."""
    words = text.lower().split()
    if not words:
        return []
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    return [flat[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def fingerprint(parts: list[bytes], seed: int = SEED) -> int:
    """Bits that are 1 in over half the XXH64 values of the parts; zero if there are none."""
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(part, seed) for part in parts], dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for block in blocks(batches, "text"):
            values = [fingerprint(shingles((t or "").encode(), shingle)) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def choices(least: int) -> list[tuple[int, ...]]:
    """Choices of positions such that any `least` of the eight positions hold all of one choice."""
    if least >= 8:
        return [tuple(range(8))]
    size = max(1, -(-least // 2))
    return [c for half in (range(4), range(4, 8)) for c in combinations(half, size)]


def mask(positions: Iterable[int]) -> int:
    """The bits of the bytes at these positions, as a signed long."""
    bits = sum(0xFF << (8 * p) for p in positions)
    return bits - (1 << 64) if bits >> 63 else bits


def postings(nodes: DataFrame, least: int) -> DataFrame:
    """The inverted index: a row (key, chosen, fp, node) of every fingerprint for each choice of positions; chosen has a bit a position."""
    keys = [F.struct(F.xxhash64(F.lit(sum(1 << p for p in c)), F.col("fp").bitwiseAND(F.lit(mask(c)))).alias("key"), F.lit(sum(1 << p for p in c)).alias("chosen")) for c in choices(least)]
    return nodes.select(F.explode(F.array(*keys)).alias("k"), "fp", "node").select("k.key", "k.chosen", "fp", "node")


def dealt_again(rows: DataFrame, least: int) -> DataFrame:
    """Postings of lists that are too long, for each choice of further positions up to `least` in all."""
    every = [c for c in combinations(range(8), least)]
    bits = F.array(*[F.when(F.lit(sum(1 << p for p in c)).bitwiseAND(F.col("chosen")) == F.col("chosen"), F.struct(F.xxhash64(F.col("key"), F.lit(sum(1 << p for p in c)), F.col("fp").bitwiseAND(F.lit(mask(c)))).alias("key"), F.lit(sum(1 << p for p in c)).alias("chosen"))) for c in every])
    return rows.select(F.explode(F.array_compact(bits)).alias("k"), "fp", "node").select("k.key", "k.chosen", "fp", "node")


def tally(differ: np.ndarray) -> np.ndarray:
    """How many positional bytes pairs share, from their differing bits."""
    return (np.ascontiguousarray(differ).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether pairs share the guaranteed minimum of positional bytes and, of these, differ in `radius` bits or fewer."""
    differ = a ^ b
    hit = tally(differ) >= 8 - radius
    hit[hit] = np.bitwise_count(differ[hit]) <= radius
    return hit


def forest(fp: np.ndarray, node: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that hold the components of one list together: every found node with its finder.

    Finders come in the order of their distance from the list's majority bits, so that in a group of
    copies the text that they were copied from comes early.
    """
    fp, first, which = np.unique(fp, return_index=True, return_inverse=True)
    equal = np.flatnonzero(first[which] != np.arange(len(which)))
    if len(equal):
        yield node[first[which[equal]]], node[equal]
    node = node[first]
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    varied = [np.uint64(1 << b) for b in np.flatnonzero(bits.any(axis=0) & ~bits.all(axis=0)).tolist()]
    if FLIPS * sum(comb(len(varied), n) for n in range(1, radius + 1)) < len(fp):
        # Look up every fingerprint with each choice of bits flipped; linear in the list.
        for n in range(1, radius + 1):
            for chosen in combinations(varied, n):
                flipped = fp ^ np.bitwise_or.reduce(np.array(chosen, dtype=np.uint64))
                at = np.minimum(np.searchsorted(fp, flipped), len(fp) - 1)
                hit = (fp[at] == flipped) & (flipped > fp)
                if hit.any():
                    yield node[hit], node[at[hit]]
        return
    middle = np.packbits(2 * bits.sum(axis=0) > len(fp), bitorder="little").view(np.uint64)[0]
    order = np.argsort(np.bitwise_count(fp ^ middle), kind="stable")
    left, left_node = fp[order], node[order]
    while len(left):
        front, front_node = left[:1], left_node[:1]
        left, left_node = left[1:], left_node[1:]
        while len(front) and len(left):
            hit = near(left, front[0], radius)
            if hit.any():
                yield np.full(int(hit.sum()), front_node[0]), left_node[hit]
                front, front_node = np.concatenate((front, left[hit])), np.concatenate((front_node, left_node[hit]))
                left, left_node = left[~hit], left_node[~hit]
            front, front_node = front[1:], front_node[1:]


def list_links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int, short_list: int = SHORT_LIST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of whole lists, from rows sorted by key."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    for a, n in zip(starts[sizes > short_list].tolist(), sizes[sizes > short_list].tolist()):
        yield from forest(fp[a : a + n], node[a : a + n], radius)
    short = (sizes > 1) & (sizes <= short_list)
    rows = np.repeat(short, sizes)
    key, fp, node = key[rows], fp[rows], node[rows]
    for d in range(1, int(sizes[short].max(initial=1))):
        at = np.flatnonzero(key[d:] == key[:-d])
        at = at[near(fp[at + d], fp[at], radius)]
        if len(at):
            yield node[at], node[at + d]


def lists(batches, columns: list[str], most: int, split: bool = True) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """The columns of rows sorted by the first in runs of whole lists of about `most` rows; if split, longer lists come in parts, marked True."""
    held: list[list[np.ndarray]] = []
    n, over = 0, None  # over: the key of a long list that is passing
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).to_numpy() for c in columns])
        n += batch.num_rows
        if n <= most:
            continue
        rows = [np.concatenate(x) for x in zip(*held)]
        key = rows[0]
        if over is not None and (m := int(np.searchsorted(key, over, side="right"))):
            yield True, [x[:m] for x in rows]
            rows = [x[m:] for x in rows]
            key = rows[0]
            if not len(key):  # its list may go on
                held, n = [], 0
                continue
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield False, [x[:last] for x in rows]
            rows = [x[last:] for x in rows]
        over = None
        if split and len(rows[0]) > most:
            over = rows[0][-1]
            yield True, rows
            rows = [x[:0] for x in rows]
        held, n = [rows], len(rows[0])
    if held:
        rows = [np.concatenate(x) for x in zip(*held)]
        if over is not None and (m := int(np.searchsorted(rows[0], over, side="right"))):
            yield True, [x[:m] for x in rows]
            rows = [x[m:] for x in rows]
        if len(rows[0]):
            yield False, rows


def gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = BATCH_LINKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs in larger arrays."""
    held, n = [], 0
    for a, b in pairs:
        held.append((a, b))
        n += len(a)
        if n >= most:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def links(nodes: DataFrame, radius: int = 3, short_list: int = SHORT_LIST, most: int = MOST_LIST) -> DataFrame:
    """a and b: links between nodes (fp, node) within the radius, enough of them to join all components.

    short_list: lists up to this length give all their links, longer ones a spanning forest.
    """
    if not 0 <= radius <= 7:
        raise ValueError("pairs within the radius have to share a byte")
    n, least = shuffle_partitions(nodes.sparkSession), 8 - radius
    columns = ["key", "chosen", "fp", "node"]

    def link(batches, whole: bool):
        def pairs(rows):
            return gathered(list_links(rows[0], rows[2].view(np.uint64), rows[3], radius, short_list))

        for long, rows in lists(batches, columns, most, not whole):
            if long:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows[:2]] + [pa.array(rows[2]), pa.array(rows[3])], names=["key", "chosen", "a", "b"])
                continue
            for a, b in pairs(rows):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), pa.array(a), pa.array(b)], names=["key", "chosen", "a", "b"])

    def searched(rows: DataFrame, whole: bool) -> DataFrame:
        return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda batches: link(batches, whole), "key long, chosen int, a long, b long")

    first = stored(searched(postings(nodes, least), False))
    long = first.where("key is not null").select("key", "chosen", F.col("a").alias("fp"), F.col("b").alias("node"))
    found = first.where("key is null").select("a", "b")
    return found if long.isEmpty() else found.unionByName(searched(dealt_again(long, least), True).select("a", "b"))


def classes(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the least id reachable over links) of every row."""
    marked = stored(fingerprints(docs, shingle, id_col, text_col))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(distinct.select("fp", F.col("fp").alias("node")), radius))
    named = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select(F.col("fp").alias("of"), "component_id")
    return marked.join(by_fp, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")
