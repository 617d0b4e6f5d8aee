"""Near-duplicates: classes of texts alike in `least` of their word shingles, from SimHash links and an exact filter for the rest.

Candidates come from two sources.  The SimHash index (see `simhash`), over fingerprints of the sets of shingles,
gives the closest copies.  Fingerprints of sets that are alike in 0.8 differ in about ten bits, so the index
can't promise more; what it leaves is found by a filter that misses nothing:

Two sets alike in `least` share one of their first `(1 - least) * n + 1` hashes in any order common to all
sets.  So all texts of a pair meet in a posting list of these hashes, in an order from rare to common that keeps
lists short.  Places in the order and sizes drop what can't reach `least`.  Short lists give all their pairs,
longer ones first the pairs with their middle text; once those are verified, a second round compares the texts
of a list that are still in different components.  So every pair of a list is verified or joined by others.

The second round takes only lists that hold several components.  Those of a list's main component needn't be compared
with one another, so the others are cut in parts of about PART texts, the main component in parts too, and each part of
the others meets every part in a group of its own.  Each text brings its parity bits along.  So no task holds a list,
whatever its length, and only pairs that the bits don't tell apart come out.

Candidates are verified first by parity bits (two sets differ in as many elements at least as their bits do),
then by the sets themselves.  For that pairs are dealt to bounded blocks of pairs that have texts in common,
and each text's bits or set goes once to each block that needs it.

Cases: texts without words, null ones included, are one class; a text shorter than a shingle is one shingle;
texts of one set are one node, named by its least id; of rows with one id the least text counts, and one
row stays; rows with a null id are in no class and stay; an empty table gives an empty one; other columns are kept by `deduplicated`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import simhash
from skyledger.llm.common import among, blocks, rolling, scope, shuffle_partitions, small, span_hashes, stored, text_bytes, word_spans
from skyledger.llm.graph import components

#: Lists up to this length give all their pairs in the first round.
FEW_PAIRS = 6
#: A shingle is common if COMMON_TEXTS of each COUNTED texts hold it, and COMMON_TEXTS at least; the order names COMMON of them at most.
COMMON_TEXTS, COUNTED, COMMON = 3, 20_000, 1 << 16
#: Bins in which all hashes are counted first, and those that meet at a time.
BINS, BINS_CHUNK = 1 << 22, 1 << 16
#: Rows of a batch of postings.
POST_ROWS = 1 << 16
#: Elements of the sets of a block's pairs, about: the pairs' sizes added up, a hundred a pair at least.
BLOCK_ELEMENTS = 1 << 20
#: Parity bits of a set, at least and at most; about two an element.
LEAST_BITS, MOST_BITS = 512, 1 << 16
#: Differing bits of the fingerprints that are candidates.
RADIUS = 3
#: Texts of a list's part in the second round, and pairs that are compared at a time.
PART, PAIRS = 1024, 1 << 15


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted hashes of each text's different shingles (as `simhash.shingles` cuts them)."""
    data, offsets = text_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    return [np.unique(rolling(hashes[a:b], min(size, b - a))) if b > a else hashes[:0] for a, b in zip(first.tolist(), first[1:].tolist())]


def majority(hashes: np.ndarray) -> int:
    """Bits that are 1 in over half of the hashes, as a signed long."""
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def parity(hashes: np.ndarray) -> bytes:
    """Bits that say whether an odd number of the hashes falls on each; about two a hash, a power of two."""
    n = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(hashes) - 1).bit_length())) if len(hashes) else LEAST_BITS
    return np.packbits(np.bincount((hashes % np.uint64(n)).astype(np.int64), minlength=n) & 1 > 0, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """The bits in which two parities differ; the longer one is folded."""
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix(hashes: np.ndarray, least: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first hashes in the order rare to common: sets alike in `least` have one of theirs in common."""
    n = len(hashes)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = common[at] == hashes
        hashes = np.concatenate((hashes[~often], hashes[often][np.argsort(rank[at[often]], kind="stable")]))
    return hashes[: n - int(np.ceil(least * n - 1e-9)) + 1]


def common_shingles(texts: DataFrame, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles, sorted, and their rank, counted over all n texts.  They order the prefixes, results don't hang on them.

    Common is what `least` texts hold.  A first pass counts all hashes in bins; only those of bins that reach `least`,
    so all common ones and few others, are counted by themselves in the second.
    """
    least = max(COMMON_TEXTS, -(-n * COMMON_TEXTS // COUNTED))
    bins, chunk = BINS, BINS_CHUNK

    def tally(batches):
        counts = np.zeros(bins, dtype=np.uint32)
        for block in blocks(batches, "text"):
            for own in shingle_sets(block.column("text"), size):
                np.add.at(counts, own & np.uint64(bins - 1), np.uint32(1))
        for i in range(0, bins, chunk):
            if counts[i : i + chunk].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // chunk]), pa.array([zlib.compress(counts[i : i + chunk].tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    def reached(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                own = sums.setdefault(i, np.zeros(chunk, dtype=np.uint64))
                own += np.frombuffer(zlib.decompress(counts.as_buffer()), dtype=np.uint32)
        for i, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([np.packbits(own >= least).tobytes()], pa.binary())], names=["chunk", "flags"])

    # A bit for each bin, half a megabyte, whatever the input.
    flags = np.zeros(bins // chunk * (chunk // 8), dtype=np.uint8).reshape(-1, chunk // 8)
    for i, own in texts.mapInArrow(tally, "chunk long, counts binary").repartition(bins // chunk, "chunk").mapInArrow(reached, "chunk long, flags binary").collect():
        flags[i] = np.frombuffer(own, dtype=np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(flags.reshape(-1))

    def run(batches):
        hot = np.unpackbits(sent.value).astype(bool)
        for block in blocks(batches, "text"):
            sets = [own[hot[own & np.uint64(bins - 1)]] for own in shingle_sets(block.column("text"), size)]
            if sets:
                h, counts = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(counts)], names=["h", "n"])

    counts = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("count")).where(F.col("count") >= least)
    h = counts.orderBy(F.desc("count"), "h").limit(COMMON).select("h").toArrow().column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - np.arange(len(h)))[order]


def able(size_a, at_a, size_b, at_b, least: float) -> np.ndarray:
    """Whether sets of these sizes can be alike in `least` if the hash at these places of their orders is the first that they have in common.

    What they have in common then lies at or after these places.  Of a pair that is alike the first one passes.
    """
    return np.minimum(size_a - at_a, size_b - at_b) >= least / (1 + least) * (size_a + size_b) - 1e-6


def list_pairs(key: np.ndarray, node: np.ndarray, fp: np.ndarray, size: np.ndarray, at: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs from rows sorted by key: all of a short list, those with the middle text of a longer one."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    for a, n in zip(starts[sizes > FEW_PAIRS].tolist(), sizes[sizes > FEW_PAIRS].tolist()):
        own = slice(a, a + n)
        mid = a + int(np.argmin(np.bitwise_count(fp[own] ^ np.uint64(majority(fp[own]) & (1 << 64) - 1))))
        hit = able(size[own], at[own], size[mid], at[mid], least) & (node[own] != node[mid])
        yield np.full(int(hit.sum()), node[mid]), node[own][hit]
    rows = np.repeat((sizes > 1) & (sizes <= FEW_PAIRS), sizes)
    key, node, size, at = key[rows], node[rows], size[rows], at[rows]
    for d in range(1, FEW_PAIRS):
        hit = (key[d:] == key[:-d]) & able(size[d:], at[d:], size[:-d], at[:-d], least)
        if hit.any():
            yield node[:-d][hit], node[d:][hit]


def whole_lists(batches, columns: list[str]) -> Iterator[list[np.ndarray]]:
    for _, rows in simhash.lists(batches, columns, POST_ROWS, split=False):
        yield rows


def sharing(texts: DataFrame, size: int, least: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Pairs a and b of the texts (node, text) that share a hash of their prefixes, without a key: all of short lists, some of longer ones.

    The rows of the longer lists come along, with key, node as `a` and spot (size and place) as `b`.
    """
    sent = texts.sparkSession.sparkContext.broadcast(common)
    n = shuffle_partitions(texts.sparkSession)

    def post(batches):
        for block in blocks(batches, "text"):
            sets = shingle_sets(block.column("text"), size)
            if not sets:
                continue
            keys = [prefix(x, least, *sent.value) if len(x) else np.zeros(1, dtype=np.uint64) for x in sets]
            counts = [len(k) for k in keys]
            fps = np.array([majority(x) if len(x) else 0 for x in sets], dtype=np.int64)
            place = np.concatenate([np.arange(c) for c in counts])
            spot = np.repeat(np.array([len(x) for x in sets], dtype=np.int64), counts) << 32 | place
            columns = [np.concatenate(keys).view(np.int64), np.repeat(block.column("node").to_numpy(), counts), np.repeat(fps, counts), spot]
            for i in range(0, len(spot), POST_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + POST_ROWS]) for c in columns], names=["key", "node", "fp", "spot"])

    def pair(batches):
        for key, node, fp, spot in whole_lists(batches, ["key", "node", "fp", "spot"]):
            for a, b in simhash.gathered(list_pairs(key, node, fp.view(np.uint64), spot >> 32, spot & 0xFFFFFFFF, least)):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["key", "a", "b"])
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(starts, len(key)))
            long = np.repeat(sizes > FEW_PAIRS, sizes)
            if long.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[long]) for x in (key, node, spot)], names=["key", "a", "b"])

    lists = texts.mapInArrow(post, "key long, node long, fp long, spot long").repartition(n, "key").sortWithinPartitions("key")
    return lists.mapInArrow(pair, "key long, a long, b long")


class Parities:
    """Parity bits of a group's texts, to tell many pairs apart at once."""

    def __init__(self, bits: list[bytes]):
        self.words = np.array([len(b) // 8 for b in bits], dtype=np.int64)
        self.row = np.zeros(len(bits), dtype=np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for n in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == n)
            self.row[own] = np.arange(len(own))
            self.rows[n] = np.frombuffer(b"".join([bits[i] for i in own.tolist()]), dtype=np.uint64).reshape(-1, n)

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The bits in which a[i] and b[i] differ, for each i; the longer one of two is folded."""
        out = np.zeros(len(a), dtype=np.int64)
        kinds = self.words[a] << 32 | self.words[b]
        for kind in np.unique(kinds).tolist():
            own = np.flatnonzero(kinds == kind)
            x, y = self.rows[kind >> 32][self.row[a[own]]], self.rows[kind & 0xFFFFFFFF][self.row[b[own]]]
            while x.shape[1] != y.shape[1]:
                x, y = (x, y) if x.shape[1] > y.shape[1] else (y, x)
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            out[own] = np.bitwise_count(x ^ y).sum(axis=1)
        return out


def apart(part: np.ndarray, named: np.ndarray, spot: np.ndarray, bits: list[bytes], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a group's texts, of its two parts if it has two, that are in different components (`named`) and can be alike."""
    if (named == named[0]).all():
        return
    size, at, parities = spot >> 32, spot & 0xFFFFFFFF, Parities(bits)
    left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    whole = len(left) == len(part)
    step = max(1, PAIRS // len(right))
    for k in range(0, len(left), step):
        i, j = np.repeat(left[k : k + step], len(right)), np.tile(right, len(left[k : k + step]))
        hit = (named[i] != named[j]) & able(size[i], at[i], size[j], at[j], least)
        if whole:
            hit &= i < j
        i, j = i[hit], j[hit]
        hit = parities.differing(i, j) <= (1 - least) / (1 + least) * (size[i] + size[j]) + 1e-6
        if hit.any():
            yield i[hit], j[hit]


def still_apart(lists: DataFrame, joined: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """a and b: the pairs of the long lists that the components (node, component) found so far don't join, and that can be alike."""
    placed = lists.select("key", F.col("a").alias("of"), F.col("b").alias("spot")).join(small(joined), F.col("of") == F.col("node"), "left")
    placed = stored(placed.select("key", "of", "spot", F.coalesce("component", "of").alias("named")))
    counts = placed.groupBy(F.col("key").alias("list"), "named").agg(F.count("*").alias("n"))
    several = counts.groupBy("list").agg(F.max_by("named", F.struct("n", "named")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main"), F.count("*").alias("kinds")).where("kinds > 1")
    parts = lambda n: F.ceil(n / PART).cast("int")
    several = several.select("list", "main", parts(F.col("n") - F.col("n_main")).alias("others"), parts(F.col("n_main")).alias("mains"))
    rows = placed.join(several, F.col("key") == F.col("list")).join(nodes.select("node", F.expr("substring(bits, 9)").alias("bits")), F.col("of") == F.col("node"))
    # The parts of the others come first; each of them meets itself and all parts, one of the main component only them.
    inside, some = F.col("named") == F.col("main"), F.xxhash64("of")
    rows = rows.withColumn("part", F.when(inside, F.col("others") + F.pmod(some, F.col("mains"))).otherwise(F.pmod(some, F.col("others"))).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
    rows = rows.select(F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with")).alias("met"), "of", "part", "named", "spot", "bits")

    def run(batches):
        for met, node, part, named, spot, bits in whole_groups(batches, ["met", "of", "part", "named", "spot", "bits"]):
            starts = np.flatnonzero(np.concatenate(([True], met[1:] != met[:-1])))
            for x, y in zip(starts.tolist(), np.append(starts[1:], len(met)).tolist()):
                own = node[x:y]
                for i, j in apart(part[x:y], named[x:y], spot[x:y], bits[x:y], least):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own[i], own[j])), pa.array(np.maximum(own[i], own[j]))], names=["a", "b"])

    groups = rows.repartition(shuffle_partitions(lists.sparkSession), "met").sortWithinPartitions("met")
    return groups.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def whole_groups(batches, columns: list[str]) -> Iterator[list]:
    """The columns of rows sorted by the first, in runs of whole groups; the last column as a list."""
    held: list[list] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(c).to_numpy() for c in columns[:-1]] + [batch.column(columns[-1]).to_pylist()]
        if held:
            cut = int(np.searchsorted(own[0], held[-1][0][-1], side="right"))  # what goes on with the last group
            held.append([x[:cut] for x in own])
            if cut == len(own[0]):
                continue
            yield [np.concatenate(x) for x in list(zip(*held))[:-1]] + [sum((x[-1] for x in held), [])]
            own = [x[cut:] for x in own]
        last = int(np.searchsorted(own[0], own[0][-1]))
        if last:
            yield [x[:last] for x in own]
        held = [[x[last:] for x in own]]
    if held:
        yield [np.concatenate(x) for x in list(zip(*held))[:-1]] + [sum((x[-1] for x in held), [])]


def meet(pairs: DataFrame, data: DataFrame, sizes: DataFrame, check: Callable) -> DataFrame:
    """The pairs (a, b) for which check(data of a, data of b) holds; data has (node, data), and sizes (node, size) the elements of each.

    Pairs go to the block of the least node that they reach in two steps, those of blocks with many elements to
    parts by the end that is in fewer pairs, so that texts that are compared with one another meet in few places.
    """
    spark, n = pairs.sparkSession, shuffle_partitions(pairs.sparkSession)
    ends = pairs.select(F.col("a").alias("n"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("n"), F.col("a").alias("o")))
    one = ends.groupBy("n").agg(F.least("n", F.min("o")).alias("low"), F.count("*").alias("met"))
    one = small(stored(one.join(small(sizes), F.col("n") == F.col("node")).select("n", F.struct("low", "met", "size").alias("own"))))
    both = pairs.join(one.select(F.col("n").alias("a"), F.col("own").alias("x")), "a").join(one.select(F.col("n").alias("b"), F.col("own").alias("y")), "b")
    lesser = F.when(F.col("x.met") <= F.col("y.met"), F.col("a")).otherwise(F.col("b"))
    weighed = stored(both.select("a", "b", F.least("x.low", "y.low").alias("low"), lesser.alias("lesser"), F.greatest(F.col("x.size") + F.col("y.size"), F.lit(100)).alias("elements")))
    parts = weighed.groupBy("low").agg((F.sum("elements") / BLOCK_ELEMENTS).cast("long").alias("more")).where("more > 0")
    part = F.when(F.col("more").isNull(), 0).otherwise(F.pmod(F.xxhash64("lesser"), F.col("more") + 1))
    dealt = stored(weighed.join(small(stored(parts)), "low", "left").select(F.xxhash64("low", part).alias("block"), "a", "b"))
    wanted = dealt.select("block", F.col("a").alias("n")).unionByName(dealt.select("block", F.col("b").alias("n"))).distinct()
    given = data.join(small(stored(wanted)), F.col("node") == F.col("n")).select("block", F.col("n").alias("a"), F.lit(None).cast("long").alias("b"), "data")
    rows = given.unionByName(dealt.withColumn("data", F.lit(None).cast("binary")))

    def run(batches):
        block, held = None, {}
        for batch in batches:
            kept: list[tuple[int, int]] = []
            for k, a, b, x in zip(*[batch.column(c).to_pylist() for c in ("block", "a", "b", "data")]):
                if k != block:
                    block, held = k, {}
                if x is not None:
                    held[a] = x
                elif check(held[a], held[b]):
                    kept.append((a, b))
            if kept:
                a, b = zip(*kept)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    # Of a block first the data, then the pairs.
    return rows.repartition(n, "block").sortWithinPartitions("block", F.col("b").isNotNull()).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) are alike in `least` of their sets of shingles; nodes has (node, size, bits)."""

    def sets(batches):
        for block in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.column("node"), pa.array([x.tobytes() for x in shingle_sets(block.column("text"), size)], pa.binary())], names=["node", "data"])

    def possible(x: bytes, y: bytes) -> bool:
        n, m = (int.from_bytes(v[:8], "little") for v in (x, y))
        return min(n, m) >= least * max(n, m) - 1e-6 and differing(x[8:], y[8:]) <= (1 - least) / (1 + least) * (n + m) + 1e-6

    def alike(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= least * (len(x) + len(y) - both) - 1e-9

    sizes = nodes.select("node", "size")
    open_ = stored(meet(pairs, nodes.select("node", F.col("bits").alias("data")), sizes.withColumn("size", F.col("size") / 32), possible))
    ids = stored(open_.select(F.col("a").alias("n")).unionByName(open_.select(F.col("b").alias("n"))).distinct())
    return stored(meet(open_, among(texts, ids, "node").mapInArrow(sets, "node long, data binary"), sizes, alike))


def similar(docs: DataFrame, size: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (the least id reachable) of every id: classes over pairs alike in `least` of their shingles."""

    def run(batches):
        for block in blocks(batches, "text"):
            sets = shingle_sets(block.column("text"), size)
            columns = [
                pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([len(x).to_bytes(8, "little") + parity(x) for x in sets], pa.binary()),
                pa.array([majority(x) if len(x) else 0 for x in sets], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([block.column("node"), *columns], names=["doc_id", "same", "size", "bits", "fp"])

    def marks(own: DataFrame) -> DataFrame:
        return stored(own.mapInArrow(run, "doc_id long, same binary, size long, bits binary, fp long"))

    own = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("node is not null")
    marked = marks(own)
    if not marked.groupBy("doc_id").agg((F.min("same") != F.max("same")).alias("several")).where("several").isEmpty():
        own = own.groupBy("node").agg(F.min("text").alias("text"))
        marked = marks(own)
    nodes = stored(marked.groupBy("same").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("size", "bits", "fp")]))
    texts = among(own, nodes.select("node"), "node")
    shared = stored(sharing(texts, size, least, common_shingles(own, size, marked.count())))
    close = simhash.links(nodes.select("fp", "node"), RADIUS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(close.unionByName(shared.where("key is null").select("a", "b")).where("a <> b").distinct())
    found = verified(pairs, own, nodes, size, least)
    joined = components(found)
    rest = shared.where("key is not null")
    if not rest.isEmpty():
        more = stored(still_apart(rest, joined, nodes, least).join(pairs, ["a", "b"], "left_anti"))
        joined = components(found.unionByName(verified(more, own, nodes, size, least)))
    by_node = nodes.select("same", "node").join(joined.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(F.col("same").alias("as"), F.coalesce("component", "node").alias("component_id"))
    return marked.join(by_node, F.col("same") == F.col("as")).select("doc_id", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` with the least id of their class, with all columns; of rows with one id one stays.

    Ids are integers; rows with a null id are in no class and stay.
    """
    with scope(docs.sparkSession):
        found = stored(similar(docs, id_col=id_col, text_col=text_col, **how).where(F.col("doc_id") == F.col("component_id")).select("doc_id"))
        n = found.count()
        kept = stored(found.distinct(), outer=True)
    out = among(docs, kept, id_col)
    # Only where an id repeats do the rows have to meet.
    out = out if n == kept.count() else out.dropDuplicates([id_col])
    return out.unionByName(docs.where(docs[id_col].isNull()))
