"""Hard negatives: of other labels the best rows whose score lies in a window below each positive's score.

Components become integers, floor(256 x), and a score is an inner product of them, so all scores are exact.  An
anchor's positives are its best rows of the same label; a positive of score p gives the window from `low` to
`high` hundredths of p, and the best rows of other labels in it are its negatives.

Candidates are written as Parquet in blocks: in the order of label and of the place on a Hilbert curve through the
dimensions of most variance, cut in runs of `block_rows`.  Each block has a zone map, the least and the greatest value of
every dimension.  Interval arithmetic on these bounds the scores of an anchor with all rows of a block from both
sides, without reading it: so an anchor reads blocks of its label only where they can hold one of its best (it knows
what its own block holds), and other blocks only where one of its windows lies within the bounds.

Anchors go by groups past the zone maps, which are packed in bounded chunks; a request is a group and a block.  Requests are
joined with the blocks, a task scores the group's anchors that ask with the block's rows in one product, and
keeps the best of each anchor (or window) over its blocks; the last ranking takes these.  Nothing goes through the driver but
the mean, spread and largest value of each dimension.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part.  A vector shorter than the
longest is as if filled with zeros.  Repeated rows are candidates of their own, and repeated anchors give repeated
results; a row is never a positive of an anchor with its id.  Ties go to the smaller id.  A positive without
negatives gives no row; an empty table gives an empty one.  Ids and labels are integers; scores have to fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import shuffle_partitions, stored
from skyledger.llm.sharding import hilbert_index

#: Rows of a candidate block.
BLOCK_ROWS = 512
#: Dimensions of the Hilbert curve and bits of each.
CURVE_DIMS, CURVE_BITS = 8, 4
#: Anchors of a group, zone maps of a chunk.
GROUP, CHUNK = 128, 1024
#: Groups of which a task holds what it found so far.
HELD_GROUPS = 256
#: A score below all.
LEAST = -(1 << 62)

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    bounds = vectors.offsets.to_numpy().astype(np.int64)
    n = np.diff(bounds)
    out = np.zeros((len(n), width), dtype=np.int64)
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(int(n.sum())) - np.repeat(bounds[:-1] - bounds[0], n)] = vectors.values.to_numpy()[bounds[0] : bounds[-1]]
    return out


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices; exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 1 << 53:
        return np.rint(x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x.astype(np.int64) @ y.T.astype(np.int64)


def bounds_of(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that each anchor can have with rows between low and high in every dimension."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def hundredths(percent: int, p: Column, up: bool) -> Column:
    """percent * p / 100 as a whole number, rounded up or down."""
    x = F.lit(-percent if up else percent).cast("long") * p
    down = F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))
    return -down if up else down


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores of each row and their ids, the smaller id first; ids grow along a row.  What is LEAST is no score."""
    scores = scores.copy()
    rows = np.arange(len(scores))
    found, whose = np.full((len(scores), k), LEAST), np.zeros((len(scores), k), dtype=np.int64)
    for i in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        found[:, i], whose[:, i] = scores[rows, at], ids[at]
        scores[rows, at] = LEAST
    return found, whose


def merged(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, by score and then id, along the last axis."""
    scores, ids = np.concatenate((old[0], new[0]), axis=-1), np.concatenate((old[1], new[1]), axis=-1)
    order = np.lexsort((ids, -scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def prepared(rows: DataFrame, anchors: Column, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """id, label, q (integer components) and whether a row is an anchor, of the rows that take part."""
    x = F.col(vec_col)
    kept = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull())
    kept = kept.where(~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long"))
    return kept.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), q.alias("q"))


def spread(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and deviation of each dimension, and the greatest absolute value of any; one row a dimension reaches the driver."""

    def run(batches):
        n, sums, squares, most = 0, np.zeros(0), np.zeros(0), 0
        for batch in batches:
            q = batch.column("q")
            width = int(np.diff(q.offsets.to_numpy()).max(initial=0))
            m = matrix(q, width)
            grown = max(width, len(sums))
            sums, squares = (np.pad(v, (0, grown - len(v))) for v in (sums, squares))
            sums[:width] += m.sum(axis=0)
            squares[:width] += (m.astype(np.float64) ** 2).sum(axis=0)
            n, most = n + len(m), max(most, int(np.abs(m).max(initial=0)))
        d = len(sums)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([float(n), *sums]), pa.array([0.0, *squares]), pa.array([most] * (d + 1), pa.int64())], names=["dim", "s", "s2", "most"])

    found = rows.select("q").mapInArrow(run, "dim int, s double, s2 double, most long").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.max("most").alias("most")).orderBy("dim").collect()
    n = max(1.0, found[0]["s"]) if found else 1.0
    mean = np.array([r["s"] for r in found[1:]]) / n
    return mean, np.sqrt(np.maximum(np.array([r["s2"] for r in found[1:]]) / n - mean**2, 0)), max((r["most"] for r in found), default=0)


def candidate_blocks(rows: DataFrame, block_rows: int) -> tuple[DataFrame, np.dtype, int]:
    """The stored blocks: block, label, ids (growing), vecs (rows of integers as bytes), the places of anchors, and the zone map `low`, `high`; the integers' type; the dimensions."""
    mean, deviation, most = spread(rows)
    width = len(mean)
    kind = np.dtype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")
    dims = np.argsort(-deviation, kind="stable")[:CURVE_DIMS]
    top = (1 << CURVE_BITS) - 1

    def place(batches):
        for batch in batches:
            m = matrix(batch.column("q"), width)
            bins = np.clip((m[:, dims] - mean[dims]) / np.maximum(deviation[dims], 1e-9) * (top + 1) / 4 + (top + 1) / 2, 0, top).astype(np.int64)
            curve = hilbert_index(bins, CURVE_BITS) if len(dims) else np.zeros(len(m), dtype=np.int64)
            vecs = pa.array([v.tobytes() for v in m.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("anchor"), pa.array(curve), vecs], names=["id", "label", "anchor", "curve", "vec"])

    def block(number: int, label: int, ids: np.ndarray, anchor: np.ndarray, vecs: list[bytes]) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        m = np.frombuffer(b"".join([vecs[i] for i in order.tolist()]), dtype=kind).reshape(len(ids), width)
        columns = [[number], [label], [ids[order].tolist()], [m.tobytes()], [np.flatnonzero(anchor[order]).tolist()], [m.min(axis=0).tobytes()], [m.max(axis=0).tobytes()]]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["block", "label", "ids", "vecs", "anchors", "low", "high"])

    def cut(batches):
        from pyspark import TaskContext

        number, last = TaskContext.get().partitionId() << 32, None
        ids, anchor, vecs = [], [], []
        for batch in batches:
            for i, label, mark, vec in zip(*[batch.column(c).to_pylist() for c in ("id", "label", "anchor", "vec")]):
                if ids and (label != last or len(ids) >= block_rows):
                    yield block(number, last, np.array(ids), np.array(anchor), vecs)
                    number, ids, anchor, vecs = number + 1, [], [], []
                last = label
                ids.append(i)
                anchor.append(mark)
                vecs.append(vec)
        if ids:
            yield block(number, last, np.array(ids), np.array(anchor), vecs)

    placed = rows.mapInArrow(place, "id long, label long, anchor boolean, curve long, vec binary")
    ordered = placed.repartitionByRange(shuffle_partitions(rows.sparkSession), "label", "curve", "id").sortWithinPartitions("label", "curve", "id")
    return stored(ordered.mapInArrow(cut, "block long, label long, ids array<long>, vecs binary, anchors array<int>, low binary, high binary")), kind, width


def anchors_of(blocks: DataFrame, kind: np.dtype, width: int, k: int) -> DataFrame:
    """anchor (a number of its own), group, id, label, vec, and `least`: the k-th best score in its own block, or LEAST."""

    def run(batches):
        from pyspark import TaskContext

        count = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = []
            for label, ids, vecs, places in zip(*[batch.column(c).to_pylist() for c in ("label", "ids", "vecs", "anchors")]):
                if not places:
                    continue
                m, ids = np.frombuffer(vecs, dtype=kind).reshape(-1, width), np.array(ids)
                scores = np.where(ids[places][:, None] == ids[None], LEAST, product(m[places], m))
                found, _ = best(scores, ids, k)
                for i, p in enumerate(places):
                    rows.append((count, count // GROUP, int(ids[p]), label, m[p].tobytes(), int(found[i, -1])))
                    count += 1
            if rows:
                types = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["anchor", "group", "id", "label", "vec", "least"])

    return stored(blocks.where(F.size("anchors") > 0).mapInArrow(run, "anchor long, group long, id long, label long, vec binary, least long"))


def chosen(groups: DataFrame, blocks: DataFrame, kind: np.dtype, width: int, same: bool) -> DataFrame:
    """Requests: block, group and the group's anchors that must read it (as rows of `anchors`: anchor, id, vec, least and most).

    Of the anchor's own label if `same`, of others if not; with scores that can lie between one of its `least` and `most`.
    """
    n_chunks = 1 + blocks.count() // CHUNK
    zones = blocks.select(F.pmod(F.xxhash64("block"), F.lit(n_chunks)).alias("chunk"), "block", F.col("label").alias("zone_label"), "low", "high")
    packed = zones.groupBy("chunk").agg(F.collect_list(F.struct("block", "zone_label", "low", "high")).alias("zones"))
    asked = groups.withColumn("of_chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    met = asked.join(packed, F.col("of_chunk") == F.col("chunk")).select("group", "anchors", "zones")

    def run(batches):
        for batch in batches:
            for group, anchors, zones in zip(*[batch.column(c) for c in ("group", "anchors", "zones")]):
                a, z = anchors.values, zones.values
                m = np.frombuffer(b"".join(a.field("vec").to_pylist()), dtype=kind).reshape(-1, width)
                low, high = (np.frombuffer(b"".join(z.field(c).to_pylist()), dtype=kind).reshape(-1, width) for c in ("low", "high"))
                under, over = bounds_of(m, low, high)
                wanted = (a.field("label").to_numpy()[:, None] == z.field("zone_label").to_numpy()[None]) == same
                inside = np.zeros_like(wanted)
                least, most = (np.array(a.field(c).to_pylist(), dtype=np.int64) for c in ("least", "most"))
                for i in range(least.shape[1]):
                    inside |= (over >= least[:, i, None]) & (under <= most[:, i, None]) & (least[:, i, None] <= most[:, i, None])
                wanted &= inside
                numbers = z.field("block").to_numpy()
                reads = np.flatnonzero(wanted.any(axis=0)).tolist()
                if reads:
                    lists = [np.flatnonzero(wanted[:, j]).astype(np.int32) for j in reads]
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[reads]), pa.array([group.as_py()] * len(reads), pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["of_block", "of_group", "which"])

    return met.mapInArrow(run, "of_block long, of_group long, which array<int>")


def read(requests: DataFrame, groups: DataFrame, blocks: DataFrame, kind: np.dtype, width: int, k: int) -> DataFrame:
    """anchor, window, id and score: the k best of each anchor in each of its windows (least to most) over the blocks that it asked for."""
    asked = requests.join(groups, F.col("of_group") == F.col("group")).select("of_block", "of_group", "which", "anchors")
    met = asked.join(blocks.select("block", "ids", "vecs"), F.col("of_block") == F.col("block")).select("of_group", "which", "anchors", "ids", "vecs")

    def out(held: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        for numbers, (scores, ids) in held.values():
            i, w, r = np.nonzero(scores > LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[i]), pa.array(w.astype(np.int32)), pa.array(ids[i, w, r]), pa.array(scores[i, w, r])], names=["anchor", "window", "id", "score"])

    def run(batches):
        held: dict[int, tuple] = {}  # of a group its anchors, and the best so far of each window
        for batch in batches:
            for group, which, anchors, ids, vecs in zip(*[batch.column(c) for c in ("of_group", "which", "anchors", "ids", "vecs")]):
                group, own, ids = group.as_py(), which.values.to_numpy(), ids.values.to_numpy()
                a = anchors.values
                least, most = (np.array(a.field(c).take(which.values).to_pylist(), dtype=np.int64) for c in ("least", "most"))
                if group not in held:
                    if len(held) >= HELD_GROUPS:
                        yield from out(held)
                        held = {}
                    shape = (len(a), least.shape[1], k)
                    held[group] = a.field("anchor").to_numpy(), (np.full(shape, LEAST), np.zeros(shape, dtype=np.int64))
                m = np.frombuffer(b"".join(a.field("vec").take(which.values).to_pylist()), dtype=kind).reshape(-1, width)
                scores = product(m, np.frombuffer(vecs.as_py(), dtype=kind).reshape(-1, width))
                scores[a.field("id").to_numpy()[own][:, None] == ids[None]] = LEAST
                so_far = held[group][1]
                for w in range(least.shape[1]):
                    floor = np.maximum(least[:, w], so_far[0][own, w, -1])
                    found = best(np.where((scores >= floor[:, None]) & (scores <= most[:, w, None]), scores, LEAST), ids, k)
                    so_far[0][own, w], so_far[1][own, w] = merged((so_far[0][own, w], so_far[1][own, w]), found, k)
        yield from out(held)

    found = met.mapInArrow(run, "anchor long, window int, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def grouped(anchors: DataFrame) -> DataFrame:
    """A row for each group of at most GROUP anchors."""
    return anchors.groupBy("group").agg(F.collect_list(F.struct("anchor", "id", "label", "vec", "least", "most")).alias("anchors"))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the rows that `anchors` picks."""
    spark = rows.sparkSession
    own = stored(prepared(rows, anchors, id_col, label_col, vec_col))
    if own.isEmpty():
        return spark.createDataFrame([], RESULT)
    blocks, kind, width = candidate_blocks(own, block_rows)
    known = anchors_of(blocks, kind, width, positives)
    # Positives: above what an anchor's own block has.
    first = stored(grouped(known.withColumn("least", F.array("least")).withColumn("most", F.array(F.lit(-LEAST)))))
    found = stored(read(chosen(first, blocks, kind, width, True), first, blocks, kind, width, positives).select(F.col("anchor").alias("of"), F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("p")))
    # Negatives: a window for each positive, none beyond the last.
    by_anchor = found.groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("place", "p"))).alias("scores"))
    scores = [F.try_element_at("scores", F.lit(i + 1)) for i in range(positives)]
    lows = F.array(*[F.coalesce(hundredths(low, p, True), F.lit(-LEAST)) for p in scores])
    highs = F.array(*[F.coalesce(hundredths(high, p, False), F.lit(LEAST)) for p in scores])
    second = stored(grouped(known.drop("least").join(by_anchor, F.col("anchor") == F.col("of")).withColumn("least", lows).withColumn("most", highs)))
    ranked = read(chosen(second, blocks, kind, width, False), second, blocks, kind, width, negatives).select("anchor", F.col("window") + 1, "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).toDF("anchor", "at", "rank", "negative_id", "negative_score")
    names = known.select(F.col("anchor").alias("named"), F.col("id").alias("anchor_id"))
    both = ranked.join(found, (F.col("anchor") == F.col("of")) & (F.col("at") == F.col("place"))).join(names, F.col("anchor") == F.col("named"))
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("p").alias("positive_score"), "negative_score")
