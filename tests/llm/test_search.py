import math

import numpy as np
import pytest

from tickloom.llm import hilbert_search as H
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, rank string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)


def brute(rows, k):
    usable = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if v is not None
              and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, i, v in usable:
        if i is not None and i % 5 == 0:
            scored = sorted(
                (-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 9), j is None, j or 0)
                for m, j, w in usable if m != n)
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def test_small_tables_are_searched_whole(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.standard_normal(8).astype(np.float32)]) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(30)] + [(7, rows[7][1]), (None, rows[3][1])]
    rows += [(200, None), (205, [0.0] * 8), (210, [1.0] * 7 + [None]), (215, [math.nan] * 8),
             (220, [math.inf] + [1.0] * 7), (225, [1.0, 2.0])]
    got = H.nearest(frame(spark, rows), F.col("vec_id") % 5 == 0, 5, recall=1.0).collect()
    found = sorted(((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got), key=str)
    assert found == brute(rows, 5)


def test_fewer_candidates_than_wanted_and_no_rows(spark):
    rows = [(0, [1.0] * 8), (1, [1.0] * 4 + [-1.0] * 4), (5, [2.0] * 8)]
    got = H.nearest(frame(spark, rows), F.col("vec_id") % 5 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [
        (0, 1, 5), (0, 2, 1), (5, 1, 0), (5, 2, 1)]
    assert H.nearest(frame(spark, []), F.col("vec_id") % 5 == 0, 5).count() == 0


def test_ties_go_to_the_smallest_ids(spark):
    # Parallel vectors, and many directions of few-valued components with one cosine, ids in no order.
    parallel = [(i, [float(x * 2.0 ** (i % 13) * (3 if i % 2 else 1)) for x in (1, -2, 0, 4, 5, 1, 0, 3)])
                for i in range(40)]
    got = H.nearest(frame(spark, parallel[::-1]), F.col("vec_id") == 0, 5).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
    query = (0, [1.0] * 8)
    one_off = [(1 + (i * 37) % 64, [1.0 if j != i % 8 else 2.0 + i // 8 for j in range(8)]) for i in range(64)]
    rows = [query, *one_off]
    got = H.nearest(frame(spark, rows).repartition(5), F.col("vec_id") == 0, 5, recall=1.0).collect()
    score = {i: round(float(np.sum(v) / np.sqrt(8 * np.sum(np.square(v)))), 12) for i, v in one_off}
    want = sorted(score, key=lambda i: (-score[i], i))[:5]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == want


def test_recall(spark):
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) for x in draw.standard_normal(16).astype(np.float32)])
            for i in range(3000)]
    got = H.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, 5).collect()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 100):
        score = x @ x[q]
        score[q] = -2
        best = set(np.argsort(-score)[:5].tolist())
        hits += len(best & {r.vec_id for r in got if r.query_id == q})
    assert hits / 150 >= 0.9


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3)])
def test_hilbert_neighbours_are_adjacent_cells(dimensions, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dimensions), axis=-1).reshape(-1, dimensions)
    keys = H.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(side ** dimensions))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
