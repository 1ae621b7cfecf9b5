"""Hard negatives by the multi-index against all scores."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from leaksift.llm import negatives


def brute(rows, every=50):
    good = {(i, l, tuple(math.floor(256 * x) for x in v)) for i, v, l in rows if i is not None and l is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in good:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in good if b != a)
        for s, p, _ in [r for r in scored if r[2] == a[1]][:5]:
            fit = [(n, m) for n, m, l in scored if l != a[1] and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(a[0], p, k + 1, m, -s, -n) for k, (n, m) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **how):
    table = spark.createDataFrame([(i, v, l, "x", 0.5) for i, v, l in rows], "vec_id long, embedding array<double>, label int, qid string, score double")
    return sorted(map(tuple, negatives.hard_negatives(table, **how).collect()))


def clustered(rng, n, d=6, labels=4):
    centres = rng.standard_normal((12, d)) * 2
    return [(i, (centres[rng.integers(12)] + rng.standard_normal(d) * .3).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Many cells, parts, batches and rounds on few rows."""
    for name, value in (("CELL_ROWS", 8), ("PART_ROWS", 20), ("ANCHORS_PER_TASK", 5), ("FIRST_ROWS", 16), ("GROWTH", 3), ("FITTED_ON", 100)):
        monkeypatch.setattr(negatives, name, value)


def test_equal_to_all_scores(spark, small):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 600)
    hot = rows[7][1]
    rows += [(600 + i, hot, i % 2) for i in range(300)]  # a third are one vector, of two labels
    rows += [(2000 + i, [float(x) for x in rng.integers(-2, 3, 6) / 64], 1) for i in range(60)]  # ties, and scores of 0 and below
    rows += [rows[5], rows[5], (50, hot, 3), (50, hot, 0), (None, hot, 1), (3000, None, 1), (3050, hot, None), (3100, [1.0, None], 1),
             (3150, [float("nan")] * 6, 1), (3200, [float("inf")] + [0.0] * 5, 2), (3250, [1.0, 2.0], 1), (3300, [], 1), (3350, [-0.0] * 6, 2)]
    want = brute([(i, (v + [0.0] * 6)[:6] if v is not None and len(v) < 6 and None not in v else v, l) for i, v, l in rows])
    got = mined(spark, rows)
    assert got == want and len({r[0] for r in got}) > 15


def test_visits_only_what_bounds_leave_open(spark, small):
    """Cells of an anchor are visited until its floor lies above the next bound, and none above its ceiling."""
    index = negatives.MultiIndex((np.eye(2), np.eye(2)), (np.zeros(2), np.zeros(2)), np.array([[3, 1], [1, 1]]))
    high, low = index.bounds(np.array([3.0, 1.0, 5.0, 0.0]))
    assert [(i, j) for _, i, j in negatives.cells_in_order(high)] == [(0, 0), (1, 0), (0, 1), (1, 1)]
    assert all(h >= x for h, x in zip(high[0], low[0]))

    def visit(budget, done, floor, ceiling):
        row = pd.DataFrame([{"v": np.array([3.0, 1.0, 5.0, 0.0]), "done": done, "floor": floor, "ceiling": ceiling}])
        out = next(negatives._next_cells(index, 4, budget)(iter([row]))).iloc[0]
        return out["cells"], out["done"], round(out["frontier"]) if np.isfinite(out["frontier"]) else None

    assert visit(3, 0, -99.0, 99.0) == ([0], 1, 6)
    assert visit(2, 1, -99.0, 99.0) == ([2, 1], 3, 1)
    assert visit(100, 0, 5.0, 99.0) == ([0, 2], 2, None)
    assert visit(100, 0, -99.0, 7.0) == ([2, 1, 3], 4, None)


def test_heap_gives_every_cell_in_order():
    rng = random.Random(1)
    for _ in range(30):
        high = [np.array([rng.choice([1.0, 2.0, 5.5, -3.0]) for _ in range(rng.randrange(1, 9))]) for _ in range(2)]
        cells = list(negatives.cells_in_order(high))
        bounds = [b for b, _, _ in cells]
        assert bounds == sorted(bounds, reverse=True) and len({c[1:] for c in cells}) == len(cells) == len(high[0]) * len(high[1])
        assert all(b == high[0][i] + high[1][j] for b, i, j in cells)


def test_huge_numbers_and_products(spark):
    a = np.array([[2.0 ** 40, 3.0], [2.0 ** 20, -1.0]])
    exact = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in a] for r in a]
    assert negatives.products(a[1:], a[1:]).tolist() == [[2 ** 40 + 1]]
    assert negatives.products(a, a).tolist() == [[min(x, negatives.HIGHEST) for x in r] for r in exact]
    rows = [(50 * i, [1e300 * (i + 1), 1.0], i % 2) for i in range(4)]
    assert all(abs(r[4]) <= negatives.HIGHEST for r in mined(spark, rows))
    assert mined(spark, [(0, [1e15], 1), (1, [1e-3], 1), (2, [5e-4], 0)]) == brute([(0, [1e15], 1), (1, [1e-3], 1), (2, [5e-4], 0)])


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0, 1.0], 1)]) == []
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 0), (3, [0.75], 0)]
    assert mined(spark, rows) == brute(rows) == [(0, 1, 1, 2, 65536, 49152), (0, 1, 2, 3, 65536, 49152)]
