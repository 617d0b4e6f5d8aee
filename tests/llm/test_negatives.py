"""Hard negatives against all scores in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import negatives, queries

SF = "/root/testdata/sf0.01"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, is_anchor, k=5, low=80, high=100):
    """rows: (id, label, vector).  All results, sorted."""
    kept = [(i, l, [math.floor(256 * float(x)) for x in v]) for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(q) for *_, q in kept), default=0)
    m = np.array([q + [0] * (width - len(q)) for *_, q in kept], dtype=object).reshape(len(kept), width)
    out = []
    for a, (i, l, _) in enumerate(kept):
        if not is_anchor(i):
            continue
        scores = (m @ m[a]).tolist() if width else [0] * len(kept)
        order = sorted(range(len(kept)), key=lambda r: (-scores[r], kept[r][0]))
        for p in [r for r in order if kept[r][1] == l and kept[r][0] != i][:k]:
            fit = [r for r in order if kept[r][1] != l and kept[r][0] != i and low * scores[p] <= 100 * scores[r] <= high * scores[p]]
            out += [(i, kept[p][0], n + 1, kept[r][0], scores[p], scores[r]) for n, r in enumerate(fit[:k])]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def test_whole_table(spark):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = result(queries.op13_hard_negatives(spark, SF))
    assert got == brute(rows, lambda i: i % 100 == 0) and len(got) > 20


@pytest.mark.parametrize("block_rows,group,chunk,held", [(7, 3, 2, 1), (64, 128, 1024, 256)])
def test_clusters_ties_and_edges(spark, monkeypatch, block_rows, group, chunk, held):
    for name, value in (("GROUP", group), ("CHUNK", chunk), ("HELD_GROUPS", held)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(7)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(400):
        c = rng.choice(centres)
        rows.append((i, rng.choice([0, 0, 0, 1, 2]), [float(np.float32(round(x + rng.uniform(-0.3, 0.3), 1))) for x in c][: rng.choice([6, 6, 6, 4])]))
    rows += [(401, None, [1.0] * 6), (402, 1, None), (403, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (404, 1, [float("nan")] * 6), (405, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (406, 9, [0.5] * 6), (407, 8, [])]
    rows += [(i, 1, rows[0][2]) for i in range(500, 540)]
    docs = frame(spark, rows).repartition(4).withColumn("group", F.lit("x")).withColumn("anchor", F.lit(1))
    assert result(negatives.hard_negatives(docs, F.col("vec_id") % 9 == 0, block_rows=block_rows)) == brute(rows, lambda i: i % 9 == 0)


def test_zone_maps_spare_blocks(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, int(i % 3), (centres[i % 12] + rng.normal(size=8) * 0.05).tolist()) for i in range(3000)]
    own = negatives.stored(negatives.prepared(frame(spark, rows), F.col("vec_id") % 100 == 0, "vec_id", "label", "embedding"))
    blocks, kind, width = negatives.candidate_blocks(own, 32)
    known = negatives.anchors_of(blocks, kind, width, 5)
    asked = negatives.grouped(known.withColumn("least", F.array("least")).withColumn("most", F.array(F.lit(-negatives.LEAST))))
    reads = negatives.chosen(asked, blocks, kind, width, True).agg(F.sum(F.size("which"))).first()[0]
    assert known.count() == 30 and 30 <= reads < 0.5 * 10 * blocks.count()
    assert result(negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0, block_rows=32)) == brute([(i, l, np.float32(v).tolist()) for i, l, v in rows], lambda i: i % 100 == 0)


def test_bounds_hold():
    rng = np.random.default_rng(9)
    rows, anchors = rng.integers(-300, 300, (50, 9)), rng.integers(-300, 300, (20, 9))
    under, over = negatives.bounds_of(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = negatives.product(anchors, rows)
    assert (scores == anchors @ rows.T).all() and (under <= scores).all() and (scores <= over).all()
    assert (negatives.product(rows << 20, rows << 20) == (rows << 20) @ (rows << 20).T).all()


def test_no_rows_and_repeated_rows(spark):
    assert negatives.hard_negatives(frame(spark, []), F.lit(True)).count() == 0
    assert negatives.hard_negatives(frame(spark, [(1, None, None)]), F.lit(True)).count() == 0
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (2, 2, [0.9]), (3, 1, [-1.0]), (4, 2, [0.1])]
    assert result(negatives.hard_negatives(frame(spark, rows), F.col("vec_id") == 0)) == brute(rows, lambda i: i == 0)
    twice = [*rows, rows[0]]
    got = result(negatives.hard_negatives(frame(spark, twice), F.col("vec_id") == 0))
    assert got == brute(twice, lambda i: i == 0) and len(got) == 2 * len(brute(rows, lambda i: i == 0))
