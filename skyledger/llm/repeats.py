"""Finding repeated passages of at least `length` units without comparing every passage with every other.

A unit is a word or a byte.  Of each run of consecutive k-grams that a passage of `length` units holds, the
one with the least hash is an anchor; equal passages have equal anchors at equal places, so a passage that
occurs twice has an anchor that occurs twice.  Anchors are narrow rows; only those that repeat call for
text, and only for the region around them that passages reach whose first least gram this anchor is.  Regions
with one anchor meet in one group, where an algorithm given by the caller finds the passages in them that also
start earlier.

Anchors that repeat within a block of text are known to do so before the shuffle: all but one go past the
comparison, dealt by place instead of by anchor, so a hot anchor has a row for each block.  Of equal regions
that a task meets, those later than the least place so far are repeats from end to end; they need no text.

The comparison also counts how often each anchor occurs.  Of one that occurs more than HOT times (say the edge
of a passage in very many texts, whose regions all differ) regions are not searched in one group: they are
dealt by their own digest, equal ones are repeats of the first, and each that is left gives its windows of
`length` units, which are dealt by their digests in turn; equal ones later than the least are the repeats.
Spans are the unions of such windows, so results are the same, and no group grows with an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import blocks, rolling, shuffle_partitions, small, span_hashes, stored, text_bytes, word_spans

SINGLE, WITNESS, REPEATED = 0, 1, 2
#: Bytes of text within which anchors that repeat are known before the shuffle.
ANCHOR_BYTES = 2 << 20
#: Occurrences of an anchor beyond which its regions are compared window by window.
HOT = 2_000
#: Regions whose least places a task remembers.
SEEN = 1 << 18
#: Rows of a batch that is handed on.
READY = 20_000
#: A region, one of a hot anchor, a window of such a region.
REGION, HOT_REGION, WINDOW = 0, 1, 2


@dataclass(frozen=True)
class Units:
    """How texts fall into units, and the sizes in units of passages and k-grams."""

    words: bool
    length: int
    gram: int

    @property
    def context(self) -> int:
        return self.length - self.gram

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, start and end of each unit in them, and the first unit of each text."""
        data, offsets = text_bytes(texts)
        if self.words:
            return (data, *word_spans(data, offsets))
        at = np.arange(len(data))
        return data, at, at + 1, offsets

    def grams(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(starts) < self.gram:
            return np.zeros(0, dtype=np.uint64)
        if self.words:
            return rolling(span_hashes(data, starts, ends), self.gram)
        return span_hashes(data, starts[: len(starts) - self.gram + 1], ends[self.gram - 1 :])

    def payload(self, raw: bytes) -> bytes:
        return b" ".join(raw.split()) if self.words else raw


def slide(x: np.ndarray, width: int, op: Callable) -> np.ndarray:
    """op over each run of `width` values."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchor_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """The places that hold the least hash of some run of `width` hashes."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64)
    least = slide(hashes, width, np.minimum)
    padded = np.concatenate((np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)))
    return np.flatnonzero(slide(padded, width, np.maximum) == hashes)


def anchors(texts: DataFrame, units: Units) -> DataFrame:
    """anchor, doc and mark (place * 4 + kind) of all anchors of (doc, text); a witness has their number as its place."""
    width = units.length - units.gram + 1

    def out(found, doc, place):
        h, place, doc = np.concatenate(found), np.concatenate(place), np.concatenate(doc)
        values, which, n = np.unique(h, return_inverse=True, return_counts=True)
        kind = np.where(n[which] > 1, REPEATED, SINGLE)
        several = values[n > 1]
        h[n[which] > 1] = 0  # what is known to repeat needs no comparison
        none = np.zeros(len(several), dtype=np.int64)
        columns = np.concatenate((h, several)).view(np.int64), np.concatenate((doc, none)), np.concatenate((place * 4 + kind, n[n > 1] * 4 + WITNESS))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "doc", "mark"])

    def run(batches):
        found, doc, place, size = [], [], [], 0
        for block in blocks(batches, "text"):
            data, starts, ends, first = units.cut(block.column("text"))
            hashes = units.grams(data, starts, ends)
            docs = block.column("doc").to_numpy(zero_copy_only=False)
            for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
                if b - a >= units.length:
                    own = hashes[a : b - units.gram + 1]
                    at = anchor_places(own, width)
                    found.append(own[at])
                    place.append(at)
                    doc.append(np.full(len(at), docs[i], dtype=np.int64))
            size += len(data)
            if found and size >= ANCHOR_BYTES:
                yield out(found, doc, place)
                found, doc, place, size = [], [], [], 0
        if found:
            yield out(found, doc, place)

    return texts.mapInArrow(run, "anchor long, doc long, mark long")


def repeated(found: DataFrame, hot: int) -> DataFrame:
    """doc and place of the anchors that occur twice or more; and of those that occur more than `hot` times the anchor as doc, -1 as place, and their number n."""
    n = shuffle_partitions(found.sparkSession)

    def out(rows, keep):
        m = int(keep.sum())
        return pa.RecordBatch.from_arrays([pa.array(rows[1][keep]), pa.array((rows[2][keep] >> 2).astype(np.int32)), pa.nulls(m, pa.int64())], names=["doc", "place", "n"])

    def often(anchors, counts):
        m = counts > hot
        return pa.RecordBatch.from_arrays([pa.array(anchors[m]), pa.array(np.full(int(m.sum()), -1, dtype=np.int32)), pa.array(counts[m])], names=["doc", "place", "n"])

    def run(batches):
        held, before = None, False  # the last row so far, and whether the row before it has its anchor
        last, so_far = np.zeros(0, dtype=np.int64), 0  # the last anchor, and how often it has occurred
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy() for c in ("anchor", "doc", "mark")]
            kind = own[2] & 3
            occurs = np.where(kind == WITNESS, own[2] >> 2, kind == SINGLE)
            starts = np.flatnonzero(np.concatenate(([True], own[0][1:] != own[0][:-1])))
            anchors, counts = own[0][starts], np.add.reduceat(occurs, starts)
            if len(last) and last[0] == anchors[0]:
                counts[0] += so_far
            elif len(last):
                yield often(last, np.array([so_far]))
            yield often(anchors[:-1], counts[:-1])
            last, so_far = anchors[-1:], int(counts[-1])
            rows = [np.concatenate((x, y)) for x, y in zip(held, own)] if held else own
            anchor, kind = rows[0], rows[2] & 3
            same = np.concatenate(([before], anchor[1:] == anchor[:-1]))
            twice = same.copy()
            twice[:-1] |= same[1:]
            keep = (kind == REPEATED) | ((kind == SINGLE) & twice)
            keep[-1] = False
            yield out(rows, keep)
            held, before = [x[-1:] for x in rows], bool(same[-1])
        if held:
            kind = held[2] & 3
            yield out(held, (kind == REPEATED) | ((kind == SINGLE) & before))
            yield often(last, np.array([so_far]))

    dealt = F.when(F.col("mark").bitwiseAND(F.lit(3)) == REPEATED, F.xxhash64("doc", "mark")).otherwise(F.col("anchor"))
    return found.repartition(n, dealt).sortWithinPartitions("anchor").mapInArrow(run, "doc long, place int, n long")


def hot_anchors(hits: DataFrame) -> DataFrame:
    """The anchors (hot) that `repeated` found to be hot."""
    return hits.where("place < 0").groupBy(F.col("doc").alias("hot")).agg(F.max("n").alias("n")).select("hot")


def reach(hashes: np.ndarray, place: np.ndarray, first: np.ndarray, end: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """The first and last start of the passages whose first least gram stands at each place; first above last if there is none.

    hashes: of all grams; first and end: the bounds of the text of each place.
    """
    own = hashes[place]
    low, high = np.maximum(place - units.context, first), np.minimum(place, end - units.length)
    for k in range(units.context, 0, -1):
        at = place - k
        low = np.where((at >= first) & (hashes[np.maximum(at, 0)] <= own), at + 1, low)
        at = place + k
        high = np.where((at <= end - units.gram) & (hashes[np.minimum(at, len(hashes) - 1)] < own), np.minimum(high, at - units.context - 1), high)
    return low, high


def digest_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


KINDS = (("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("payload", pa.binary()), ("kind", pa.int32()))
ROWS = "key long, doc long, start int, stop int, payload binary, kind int"


def table_of(rows: list[tuple], kinds: tuple = KINDS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def regions(texts: DataFrame, hits: DataFrame, units: Units, hot: DataFrame | None) -> DataFrame:
    """key, doc, start, stop, payload and kind of the region of every hit; the key is its anchor, or of a `hot` anchor its digest.

    Regions that repeat from end to end have neither key nor payload, and those of a text that overlap are one.
    """

    def run(batches):
        seen: dict[bytes, tuple[int, int]] = {}  # the least place so far of each anchor and payload
        for block in blocks(batches, "text"):
            data, starts, ends, first = units.cut(block.column("text"))
            whole = data.tobytes()
            docs = block.column("doc").to_pylist()
            lists = block.column("hits")
            bounds = np.frombuffer(lists.buffers()[1], dtype=np.int32)[lists.offset : lists.offset + len(lists) + 1]
            text_of = np.repeat(np.arange(len(docs)), np.diff(bounds))
            place = lists.values.to_numpy()[bounds[0] : bounds[-1]].astype(np.int64) + first[text_of]
            by = np.lexsort((place, text_of))
            place, text_of = place[by], text_of[by]
            hashes = units.grams(data, starts, ends)
            low, high = reach(hashes, place, first[text_of], first[text_of + 1], units)
            there = low <= high
            place, text_of, low, high = (x[there] for x in (place, text_of, low, high))
            cuts = np.searchsorted(text_of, np.arange(len(docs) + 1)).tolist()
            anchor_of = hashes[place].view(np.int64).tolist()
            low, stop = low.tolist(), (high + units.length).tolist()
            rows: list[tuple] = []
            for i, doc in enumerate(docs):
                base = int(first[i])
                known: list[list[int]] = []
                if len(seen) > SEEN:  # what is forgotten comes once more, and is found to repeat where it is compared
                    seen.clear()
                for anchor, a, b in zip(anchor_of[cuts[i] : cuts[i + 1]], low[cuts[i] : cuts[i + 1]], stop[cuts[i] : cuts[i + 1]]):
                    payload = units.payload(whole[starts[a] : ends[b - 1]])
                    digest, here = xxhash.xxh3_128_digest(payload, anchor & (1 << 63) - 1), (doc, a - base)
                    old = seen.get(digest)
                    if old == here:
                        continue
                    if old is None or here < old:
                        seen[digest] = here
                        rows.append((anchor, *here, b - base, payload, digest_key(digest)))
                    elif known and known[-1][0] <= a - base <= known[-1][1]:
                        known[-1][1] = max(known[-1][1], b - base)
                    else:
                        known.append([a - base, b - base])
                rows += [(None, doc, x, y, None, None) for x, y in known]
            if rows:
                yield table_of(rows, (*KINDS[:-1], ("digest", pa.int64())))

    by_doc = hits.where("place >= 0").groupBy("doc").agg(F.collect_list("place").alias("hits"))
    joined = texts.join(by_doc, "doc", "left")  # left, so that the texts' shuffle is the same as for the spans
    found = joined.mapInArrow(run, "key long, doc long, start int, stop int, payload binary, digest long")
    if hot is None:
        return found.withColumn("digest", F.lit(REGION)).withColumnRenamed("digest", "kind")
    marked = found.join(small(hot), F.col("key") == F.col("hot"), "left")
    is_hot = F.col("hot").isNotNull()
    return marked.select(F.when(is_hot, F.col("digest")).otherwise(F.col("key")).alias("key"), "doc", "start", "stop", "payload", F.when(is_hot, HOT_REGION).otherwise(REGION).alias("kind"))


def repeat_spans(found: DataFrame, search: Callable, units: Units) -> DataFrame:
    """key, doc, start, stop, payload and kind, without a key the runs of units that stand in passages which also start earlier; with one, the windows of hot regions.

    search() makes an object whose add(group) takes a list of (doc, start, stop, payload) in order of place; add
    and end() yield (doc, a, b), of the last group or of earlier ones.
    """
    n = shuffle_partitions(found.sparkSession)

    def opened(doc: int, start: int, payload: bytes) -> Iterator[tuple]:
        """The windows of a region."""
        data, starts, ends, _ = units.cut(pa.array([payload], pa.binary()))
        for i in range(len(starts) - units.length + 1):
            digest = xxhash.xxh3_128_digest(payload[starts[i] : ends[i + units.length - 1]])
            yield digest_key(digest), doc, start + i, start + i + units.length, digest, WINDOW

    def run(batches):
        finder = search()
        group, last = [], None
        at, digests = None, set()  # of hot regions: the key, and the digests so far under it
        before = None  # the key and place of the region before: one may come twice
        ready: list[tuple] = []

        def repeats(spans) -> None:
            ready.extend((None, *span, None, REGION) for span in spans)

        for batch in batches:
            for key, doc, start, stop, payload, kind in zip(*[batch.column(c).to_pylist() for c in ("key", "doc", "start", "stop", "payload", "kind")]):
                if payload is None:
                    ready.append((None, doc, start, stop, None, REGION))
                elif (key, doc, start, stop) == before:
                    continue
                elif kind == HOT_REGION:
                    if key != at:
                        at, digests = key, set()
                    digest = xxhash.xxh3_128_digest(payload)
                    if digest in digests:
                        ready.append((None, doc, start, stop, None, REGION))
                    else:
                        digests.add(digest)
                        ready.extend(opened(doc, start, payload))
                else:
                    if key != last:
                        if len(group) > 1:
                            repeats(finder.add(group))
                        group, last = [], key
                    group.append((doc, start, stop, payload))
                before = key, doc, start, stop
                if len(ready) >= READY:
                    yield table_of(ready)
                    ready.clear()
        if len(group) > 1:
            repeats(finder.add(group))
        repeats(finder.end())
        if ready:
            yield table_of(ready)

    # Rows known to be repeats only pass through; dealt by place, they add nothing to a hot anchor's task.
    dealt = F.when(F.col("payload").isNull(), F.xxhash64("doc", "start")).otherwise(F.col("key"))
    return found.repartition(n, dealt).sortWithinPartitions("key", "doc", "start").mapInArrow(run, ROWS)


def repeated_windows(windows: DataFrame) -> DataFrame:
    """doc, a and b of the windows (doc, start, stop, payload: their digest) that are not the first of their digest.

    The first of each digest is a minimum, taken in part before the shuffle; then they are taken away from all
    windows by place.  So the copies of one window meet in no task.
    """
    places = windows.select("doc", "start", "stop", F.lit(False).alias("first"))
    firsts = windows.groupBy("payload").agg(F.min(F.struct("doc", "start", "stop")).alias("p")).select("p.*", F.lit(True).alias("first"))
    both = places.unionByName(firsts).groupBy("doc", "start", "stop").agg(F.bool_or("first").alias("first"))
    return both.where("not first").select("doc", F.col("start").alias("a"), F.col("stop").alias("b"))


def told_apart(texts: DataFrame) -> DataFrame:
    """The rows of (id, text and others) with `doc`: the id, or where some id has different texts, a number in the order of ids and of a hash of the texts."""
    ids = texts.where("id is not null").select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    if ids.groupBy("id").agg((F.min("h") != F.max("h")).alias("several")).where("several").isEmpty():
        return texts.withColumn("doc", F.col("id"))
    placed = stored(ids.distinct().orderBy("id", "h").select(F.col("id").alias("of"), F.col("h").alias("is"), F.monotonically_increasing_id().alias("doc")))
    return texts.join(placed, (F.col("id") == F.col("of")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("is")), "left").drop("of", "is")


def with_spans(docs: DataFrame, units: Units, search: Callable, id_col: str, text_col: str, rest: bool = False) -> DataFrame:
    """id, text and spans (a list of (a, b), in units; null where nothing repeats) of every row, and the other columns as `rest`.

    The texts are shuffled by id once; the regions are cut from, and the spans come back to, that one copy.
    """
    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")] if rest else []
    texts = told_apart(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *others))
    dealt = texts.repartition(shuffle_partitions(docs.sparkSession), "doc")
    hits = stored(repeated(anchors(texts.where("doc is not null").select("doc", "text"), units), HOT))
    often = hot_anchors(hits)
    some = not often.isEmpty()
    found = repeat_spans(regions(dealt, hits, units, often if some else None), search, units)
    if some:
        found = stored(found)
    spans = found.where("key is null").select("doc", F.col("start").alias("a"), F.col("stop").alias("b"))
    if some:
        spans = spans.unionByName(repeated_windows(found.where("key is not null")))
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return dealt.join(by_doc, "doc", "left").drop("doc")


def covered(spans, n: int) -> np.ndarray:
    """Which of n units the spans cover."""
    step = np.zeros(n + 1, dtype=np.int64)
    for a, b in spans or ():
        step[a] += 1
        step[b] -= 1
    return np.cumsum(step[:-1]) > 0
