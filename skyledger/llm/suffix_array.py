"""Suffix-array removal of bytes that stand in strings of `length` bytes which also start earlier.

Regions around repeated anchors (see `repeats`) are laid end to end, whole groups at a time up to
BATCH_BYTES, and their suffixes are sorted in two stages.  Only the suffixes that are smaller than their
successors, by their first bytes (a byte not greater than the next), are sorted directly, eight bytes at a
time, to `length` bytes; the others are induced: going through the buckets of first bytes in order, each
sorted suffix puts the one before it, if it begins with a greater byte, next in that byte's bucket.  In
the suffix array adjacent suffixes with a common prefix of `length` bytes inside their regions form
runs; all of a run but the earliest place are repeats.

Cases: a null or empty text has no bytes and keeps none; texts shorter than `length` lose nothing; equal
rows are one document and give equal results; rows of one id with different texts are documents of their
own, in the order of a hash of the texts; a row with a null id neither loses nor hides anything; an empty table gives an empty one; other columns are ignored by `digests`.  Cut bytes may leave no valid
UTF-8, so the results are digests and spans, not texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyledger.llm.common import blocks
from skyledger.llm.repeats import Units, covered, with_spans

LENGTH = 100
GRAM = 24
#: Bytes of regions that are sorted together.
BATCH_BYTES = 1 << 20


def eights(text: np.ndarray) -> np.ndarray:
    """For each place the next eight symbols of a byte each as one number; zeros follow the text."""
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8))).astype(np.uint64)
    n = len(text)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + n]
    return out


def suffix_array(text: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """The places of all suffixes in order of their first `depth` bytes at least."""
    n = len(text)
    after = np.append(text[1:], 0).astype(np.int16)
    induced = text > after
    # Stage one: the suffixes not greater than their successors by the first bytes.
    direct = np.flatnonzero(~induced)
    order = direct[np.argsort(keys[direct], kind="stable")]
    group = np.cumsum(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(order) else np.zeros(0, dtype=np.int64)
    for offset in range(8, depth, 8):
        several = np.concatenate(([False], group[1:] == group[:-1]))
        several[:-1] |= several[1:]
        open_ = np.flatnonzero(several)
        if not len(open_):
            break
        at = order[open_] + offset
        key = np.where(at < n, keys[np.minimum(at, n - 1)], 0)
        inner = np.lexsort((key, group[open_]))
        order[open_] = order[open_][inner]
        key, was = key[inner], group[open_]
        # Groups keep their places: a new number for each change of key within one.
        new = np.zeros(len(group), dtype=np.int64)
        new[open_] = np.concatenate(([0], (key[1:] != key[:-1]) & (was[1:] == was[:-1])))
        group = group + np.cumsum(new)
    # Stage two: bucket by bucket, the suffixes before sorted ones.
    pending: list[list[np.ndarray]] = [[] for _ in range(257)]
    starts = np.searchsorted(text[order], np.arange(257))
    out = []
    if n and induced[n - 1]:
        pending[int(text[n - 1])].append(np.array([n - 1]))  # its successor is the empty suffix, before all
    for c in range(256):
        bucket = np.concatenate([*pending[c], order[starts[c] : starts[c + 1]]]).astype(np.int64)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        by = np.argsort(text[before], kind="stable")
        before = before[by]
        first = text[before]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(before, cuts) if len(before) else ():
            pending[int(text[part[0]])].append(part)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def joined(group: list[tuple[int, int, int, bytes]]):
    """The regions of a group with those of one document that overlap as one: doc, start, bytes."""
    doc = None
    for d, a, b, payload in group:
        if d == doc and a <= stop:
            if b > stop:
                whole += payload[stop - a :]
                stop = b
            continue
        if doc is not None:
            yield doc, start, bytes(whole)
        doc, start, stop, whole = d, a, b, bytearray(payload)
    yield doc, start, bytes(whole)


def repeats_in(regions: list[tuple[int, int, bytes]], length: int):
    """doc, a, b of the runs of bytes in strings that also start earlier, over regions in any order."""
    sizes = np.array([len(r[2]) for r in regions], dtype=np.int64)
    # A region is followed by a zero byte; whether it or a text's own zero, no match runs over the end.
    text = np.frombuffer(b"\0".join(r[2] for r in regions) + b"\0", dtype=np.uint8)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    which = np.repeat(np.arange(len(regions)), sizes + 1)
    keys = eights(text)
    order = suffix_array(text, keys, length)
    room = begins[which] + sizes[which] - np.arange(len(text))
    order = order[room[order] >= length]
    if len(order) < 2:
        return
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), dtype=bool)
    for offset in range(0, length, 8):
        at = np.flatnonzero(same)
        x, y = keys[a[at] + offset], keys[b[at] + offset]
        if length - offset < 8:
            shift = np.uint64(8 * (8 - (length - offset)))
            x, y = x >> shift, y >> shift
        same[at] = x == y
    run = np.cumsum(np.concatenate(([True], ~same)))
    docs = np.array([r[0] for r in regions], dtype=np.int64)[which[order]]
    places = np.array([r[1] for r in regions], dtype=np.int64)[which[order]] + order - begins[which[order]]
    by = np.lexsort((places, docs, run))
    first = np.concatenate(([True], run[by][1:] != run[by][:-1]))
    head = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
    # The same place may stand in two regions; it is no repeat of itself.
    gone = by[(docs[by] != docs[head]) | (places[by] != places[head])]
    pairs = np.unique(np.stack((docs[gone], places[gone])), axis=1)
    if not pairs.shape[1]:
        return
    d, p = pairs
    cut = np.flatnonzero((d[1:] != d[:-1]) | (p[1:] > p[:-1] + length)) + 1
    heads, tails = np.concatenate(([0], cut)), np.concatenate((cut, [len(d)])) - 1
    yield from zip(d[heads].tolist(), p[heads].tolist(), (p[tails] + length).tolist())


class Batches:
    """Sorts whole groups together, BATCH_BYTES at a time."""

    def __init__(self, length: int):
        self.least, self.batch, self.size = length, [], 0

    def add(self, group: list[tuple[int, int, int, bytes]]):
        seen: set[bytes] = set()
        for doc, start, whole in joined(group):
            if whole in seen:
                yield doc, start, start + len(whole)
                continue
            seen.add(whole)
            self.batch.append((doc, start, whole))
            self.size += len(whole)
        if self.size >= BATCH_BYTES:
            yield from self.end()

    def end(self):
        batch, self.batch, self.size = self.batch, [], 0
        if batch:
            yield from repeats_in(batch, self.least)


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (from, to) of every row."""
    rows = with_spans(docs, Units(False, length, gram), lambda: Batches(length), id_col, text_col)

    def run(batches):
        for block in blocks(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(block.column("text").to_pylist(), block.column("spans").to_pylist()):
                data = (text or "").encode()
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *[x for span in merged for x in span], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for column, value in zip(out, (len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), merged)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([block.column("id"), *[pa.array(c, k) for c, k in zip(out, kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return rows.select("id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
