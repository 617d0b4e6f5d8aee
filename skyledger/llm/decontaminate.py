"""Benchmark decontamination by SimHash windows of an item's size.

Every item is a window of its own number of words.  A text's windows of that size are fingerprinted
(SimHash over the window's shingles), multi-index blocks find all windows within `radius` bits of the
item, and every window found is verified by the exact weighted similarity of the shingle bags: the sum of
the lesser weights over the sum of the greater.  Blocks: the 64 bits fall in `radius + 1` blocks, of which a
pair within the radius has one in common.

Only windows that can pass are fingerprinted: a window that is alike has shingles of the item, so its
shingles are first looked up among those of all items, and only stretches with enough of them, for
some item, are worked on; that leaves out nothing.  Items reach the tasks as a broadcast, whose size is
checked; larger benchmarks are worked off in parts of `PART_BYTES`, each a pass.

Cases: a null or empty text has no window and is clean; a null or empty item is no item; an item shorter
than a shingle is one shingle; equal items are found together; repeated rows give repeated results; with
no items every text is clean; ids of documents and items may be of any type, and null; other columns are
ignored by `contaminated` and kept by `cleaned`.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skyledger.llm.common import blocks, rolling, span_hashes, text_bytes, word_spans

SHINGLE = 5
LEAST = 0.8
#: Windows alike in LEAST of their weight differ in about 10 bits of 64; within this radius lie all but very few.
RADIUS = 18
#: Bytes of item texts that are broadcast at a time.
PART_BYTES = 8 << 20


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    return rolling(words, min(size, len(words))) if len(words) else np.zeros(0, dtype=np.uint64)


def simhash(shingles: np.ndarray) -> int:
    votes = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(shingles), bitorder="little").view(np.uint64)[0])


def window_simhashes(shingles: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint of each run of `width` shingles, by differences of running votes."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(shingles) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=total[1:])
    return np.packbits(2 * (total[width:] - total[:-width]) > width, axis=1, bitorder="little").view(np.uint64)[:, 0]


class Items:
    """The benchmark's items: bags of shingles, fingerprints in blocks, and all shingles in one sorted array."""

    def __init__(self, rows: list[tuple[int, str]], shingle: int, least: float, radius: int):
        self.shingle, self.least, self.radius = shingle, least, radius
        self.ids, self.bags, self.fps, self.widths, self.short = [], [], [], [], []
        seen: dict[str, int] = {}
        for item, text in rows:
            data, offsets = text_bytes(pa.array([text or ""]))
            data = lowered(data)
            words = span_hashes(data, *word_spans(data, offsets)[:2])
            if not len(words):
                continue
            bag = shingle_hashes(words, shingle)
            if text in seen:
                self.ids[seen[text]].append(item)
                continue
            seen[text] = len(self.ids)
            self.ids.append([item])
            self.bags.append(Counter(bag.tolist()))
            self.fps.append(simhash(bag))
            self.widths.append(len(bag))
            self.short.append(len(words) if len(words) < shingle else 0)
        self.fps = np.array(self.fps, dtype=np.uint64)
        self.by_width: dict[tuple[int, int], np.ndarray] = {}
        groups = defaultdict(list)
        for i, (w, s) in enumerate(zip(self.widths, self.short)):
            groups[w, s].append(i)
        self.by_width = {k: np.array(v) for k, v in groups.items()}
        self.known = {s: np.unique(np.array([h for i in range(len(self.ids)) if self.short[i] == s for h in self.bags[i]], dtype=np.uint64)) for s in set(self.short)}
        self.bits = {s: np.zeros(1 << 20, dtype=bool) for s in self.known}
        for s, known in self.known.items():
            self.bits[s][known & np.uint64((1 << 20) - 1)] = True
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.masks = [np.uint64(((1 << int(b)) - 1) ^ ((1 << int(a)) - 1)) for a, b in zip(edges, edges[1:])]

    def holds(self, shingles: np.ndarray, short: int) -> np.ndarray:
        """Whether each shingle is one of the items'."""
        hit = self.bits[short][shingles & np.uint64((1 << 20) - 1)]
        at = np.flatnonzero(hit)
        known = self.known[short]
        hit[at] = known[np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)] == shingles[at]
        return hit

    def candidates(self, fps: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items that have a block of bits in common and differ in `radius` bits or fewer."""
        found = []
        for mask in self.masks:
            blocks_ = fps & mask
            own = self.fps[items] & mask
            order = np.argsort(own, kind="stable")
            low = np.searchsorted(own[order], blocks_, side="left")
            high = np.searchsorted(own[order], blocks_, side="right")
            n = high - low
            window = np.repeat(np.arange(len(fps)), n)
            at = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            item = order[at]
            close = np.bitwise_count(fps[window] ^ self.fps[items][item]) <= self.radius
            found.append(window[close] * len(items) + item[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(items), items[pairs % len(items)]

    def alike(self, shingles: np.ndarray, item: int) -> bool:
        bag, mine = self.bags[item], Counter(shingles.tolist())
        both = sum(min(n, mine[h]) for h, n in bag.items() if h in mine)
        return both >= self.least * (len(shingles) + self.widths[item] - both)

    def find(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, words, item) of the windows of a text that are alike to an item, at one place at most each shift."""
        out = []
        for short in self.known:
            size = short or self.shingle
            if len(words) < size:
                continue
            shingles = rolling(words, size)
            hit = self.holds(shingles, short)
            if not hit.any():
                continue
            total = np.concatenate(([0], np.cumsum(hit)))
            for (width, s), items in self.by_width.items():
                if s != short:
                    continue
                if len(shingles) < width:
                    continue
                # Alike in `least` means 2 * least / (1 + least) of the shingles in common.
                enough = total[width:] - total[:-width] >= 2 * self.least / (1 + self.least) * width - 1e-9
                places = np.flatnonzero(enough)
                if not len(places):
                    continue
                for run in np.split(places, np.flatnonzero(np.diff(places) > width) + 1):
                    part = shingles[run[0] : run[-1] + width]
                    fps = window_simhashes(part, width)[run - run[0]]
                    for w, item in zip(*self.candidates(fps, items)):
                        first = int(run[w])
                        if self.alike(shingles[first : first + width], int(item)):
                            out.append((first, width + size - 1, int(item)))
        return out


def item_parts(benchmark: DataFrame, id_col: str, text_col: str, most: int):
    """The items in parts of at most `most` bytes, one part in the driver at a time."""
    picked = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    part, size = [], 0
    for row in picked.toLocalIterator():
        if part and size + len(row["t"]) > most:
            yield part
            part, size = [], 0
        part.append((row["i"], row["t"]))
        size += len(row["t"])
    yield part


def _found(texts: pa.Array, items: Items) -> list[list[tuple[int, int, int]]]:
    data, offsets = text_bytes(texts)
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    # One look at all shingles of the block: most texts have none of the items'.
    touched = np.zeros(len(texts), dtype=bool)
    for short in items.known:
        shingles = rolling(words, short or items.shingle)
        touched[np.searchsorted(first, np.flatnonzero(items.holds(shingles, short)), side="right") - 1] = True
    return [items.find(words[first[i] : first[i + 1]]) if touched[i] else [] for i in range(len(texts))]


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, least: float = LEAST, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, first_word and n_words (of the first window found) for each row and item it holds."""
    kinds = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_id].dataType)]
    schema = T.StructType([*kinds, *[T.StructField(c, T.LongType()) for c in ("n_windows", "first_word", "n_words")]])
    item_kind = to_arrow_type(benchmark.schema[item_id].dataType)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for part in item_parts(benchmark, item_id, item_text, PART_BYTES):
        sent = docs.sparkSession.sparkContext.broadcast(Items(part, shingle, least, radius))

        def run(batches, sent=sent):
            for block in blocks(batches, "text"):
                rows = []
                for i, found in enumerate(_found(block.column("text"), sent.value)):
                    by_item = defaultdict(list)
                    for first, n, item in found:
                        by_item[item].append((first, n))
                    for item, spans in by_item.items():
                        rows += [(i, x, len(spans), *min(spans)) for x in sent.value.ids[item]]
                at, items, counts, firsts, sizes = (list(c) for c in zip(*rows)) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays([block.column("doc_id").take(pa.array(at, pa.int64())), pa.array(items, item_kind), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "item_id", "n_windows", "first_word", "n_words"])

        some = picked.mapInArrow(run, schema)
        out = some if out is None else out.unionByName(some)
    return out


def cleaned(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, least: float = LEAST, radius: int = RADIUS, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns."""
    for part in item_parts(benchmark, item_id, item_text, PART_BYTES):
        sent = docs.sparkSession.sparkContext.broadcast(Items(part, shingle, least, radius))

        def run(batches, sent=sent):
            for block in blocks(batches, text_col):
                yield block.filter(pa.array([not x for x in _found(block.column(text_col), sent.value)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
