"""Top-k search and vector codes against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import knn_join, vector_codes, vectors

ROWS = "vec_id long, embedding array<float>, label int, rank int"


def clustered(seed, n, width=8, centers=12):
    rng = np.random.default_rng(seed)
    mid = rng.normal(0, 3, (centers, width))
    x = (mid[rng.integers(0, centers, n)] + rng.normal(0, 0.05, (n, width))).astype(np.float32)
    x[n // 3 : n // 2] = x[n // 3]  # a group of equal vectors
    return x.astype(float).tolist()


def odd_rows(width=8):
    bad = [None, [None] * width, [float("nan")] + [0.0] * (width - 1), [float("inf")] * width, [1.0, None]]
    return [(700 + i, v, 1, 9) for i, v in enumerate(bad)] + [(800, [], 2, 9), (900, [0.5], None, 9), (None, [0.25] * width, None, 9), (100, [0.1] * width, 3, 9), (100, [0.1] * width, 3, 9), (-200, [-1.5] * width, 3, 9)]


def best(rows, scale, k):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(kept):
        if q is None or q % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for n, (i, b) in enumerate(kept) if n != at]
        out += [(q, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [{}, {"max_pivots": 16, "cell_rows": 20, "group_queries": 4, "part_rows": 50}])
def test_top_k_against_brute_force(spark, settings):
    rows = [(i * 5, v, i % 3, 0) for i, v in enumerate(clustered(1, 600))] + odd_rows()
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    out = knn_join.top_k(df, F.col("vec_id") % 100 == 0, k=7, scale=64, **settings)
    assert out.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:bigint>"
    seen = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None) for i, v, *_ in rows]
    assert sorted([tuple(r) for r in out.collect()], key=str) == best(seen, 64, 7)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, 1), (1, [0.5, 0.0], 1, 1)], ROWS)
    assert [tuple(r) for r in knn_join.top_k(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 512)]
    assert knn_join.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert knn_join.top_k(df.limit(1), F.lit(True)).count() == 0
    assert knn_join.top_k(df, F.col("vec_id") < 0).count() == 0
    large = spark.createDataFrame([(0, [1e4, -1e4, 3.0], 1, 1), (1, [-1e4, 1e4, 1.0], 1, 1), (2, [1e4, 1e4, 2.0], 1, 1)], ROWS)
    got = [tuple(r) for r in knn_join.top_k(large, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 6 << 20), (0, 2, 1, -2 * 10240000**2 + (3 << 20))]


def test_bounds_rule_out_cells():
    """In clusters most cells aren't needed, and no needed one is ruled out."""
    x = np.array(clustered(3, 900))
    x = np.floor(x / np.sqrt((x**2).sum(1))[:, None] * 1024).astype(np.int64)
    most = float((x**2).sum(1).max())
    space = knn_join.Space(np.unique(x[::40], axis=0), most)
    d, q = space.from_pivots(x, space.lifted(x)), space.from_pivots(x, np.zeros(len(x)))
    cell, q_cell = d.argmin(1), q.argmin(1)
    cells = len(space.pivots)
    n = np.bincount(cell, minlength=cells)
    lo = np.array([d[cell == c, c].min(initial=np.inf) for c in range(cells)])
    hi = np.array([d[cell == c, c].max(initial=0) for c in range(cells)])
    near = np.full((cells, 11), np.inf)
    for c in range(cells):
        own = np.sort(d[cell == c, c])[:11]
        near[c, : len(own)] = own
    q_n = np.bincount(q_cell, minlength=cells)
    radius = np.array([q[q_cell == c, c].max(initial=0) for c in range(cells)])
    use = knn_join.needed(space, 10, n, lo, hi, near, q_n, radius)
    s = x @ x.T
    np.fill_diagonal(s, -(1 << 62))
    for i in range(len(x)):
        theirs = set(cell[s[i] > np.sort(s[i])[-10]])
        assert use[q_cell[i]][list(theirs)].all()
    assert use.sum() < 0.6 * (q_n > 0).sum() * (n > 0).sum()


def plain_codes(rows, scale, rounds):
    """Codes, errors and final codebooks by full scans."""
    width = max((len(v) for *_, v in rows), default=0)
    width += -width % 8
    ints = [[math.floor(scale * x) for x in v] + [0] * (width - len(v)) for *_, v in rows]
    x = np.array(ints, dtype=object).reshape(len(rows), 8, -1)
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, [math.floor(scale * c) for c in rows[i][2]]))[:16]
    book = [[x[i, p].tolist() for i in first] for p in range(8)]
    for t in range(rounds + 1):
        d = [[[sum((a - b) ** 2 for a, b in zip(v[p], c)) for c in book[p]] for p in range(8)] for v in x]
        code = [[row[p].index(min(row[p])) for p in range(8)] for row in d]
        if t == rounds:
            break
        for p in range(8):
            for j in range(len(first)):
                own = [x[i, p] for i in range(len(rows)) if code[i][p] == j]
                if own:
                    book[p][j] = [sum(c) // len(own) for c in zip(*own)]
    return [("".join("%02x" % j for j in c), sum(min(r) for r in row)) for c, row in zip(code, d)], book


@pytest.mark.parametrize("n,block_rows", [(300, 64), (9, 1024)])
def test_codes_against_full_scans(spark, n, block_rows):
    rows = [((i * 7) % 311, v, i % 4 if i % 5 else None, 0) for i, v in enumerate(clustered(5, n, 16))]
    rows += odd_rows(16)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    out, history, rescans = vector_codes.compress(df, scale=256, block_rows=block_rows)
    kept = [(i, label, [float(np.float32(x)) for x in v]) for i, v, label, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    codes, book = plain_codes(kept, 256, 6)
    assert history[-1].tolist() == book
    by_label = {}
    for (_, label, _), (_, e) in zip(kept, codes):
        by_label[label] = by_label.get(label, 0) + e
    want = sorted(((i, label, c, e, by_label[label]) for (i, label, _), (c, e) in zip(kept, codes)), key=str)
    assert sorted([tuple(r) for r in out.collect()], key=str) == want
    assert rescans[0] == 8 * len(kept) and (n < 100 or rescans[-1] < 0.7 * rescans[0])


def test_codes_of_an_empty_table(spark):
    out, history, _ = vector_codes.compress(spark.createDataFrame([(1, None, 1, 1)], ROWS))
    assert out.count() == 0 and out.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert vector_codes.codebooks_text(history[-1]) == ""


def test_net_displacement_is_tighter_than_drifts():
    """An entry that comes back costs a bound nothing, while step-by-step drifts would add up."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-50, 50, (200, 4)), rng.integers(950, 1050, (200, 4))])
    a, b = np.array([[0] * 4, [1000] * 4]), np.array([[300] * 4, [700] * 4])
    bounds = vector_codes.Bounds(len(x))
    assert bounds.assign(x, np.stack([a]))[1] == 400
    bounds.assign(x, np.stack([a, b]))
    d, again = bounds.assign(x, np.stack([a, b, a]))
    assert again < 400 and (d == vector_codes.squares(x, a).min(1)).all()
    assert (bounds.entry == vector_codes.squares(x, a).argmin(1)).all()


def test_products_stay_whole():
    a, b = np.array([[vectors.LARGEST, -1]]), np.array([[vectors.LARGEST, 1]])
    assert vectors.product(a, b)[0, 0] == vectors.LARGEST**2 - 1
    assert random.Random(0) and vectors.kind_for(40_000) == "<i4"
