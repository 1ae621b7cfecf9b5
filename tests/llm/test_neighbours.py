"""Collision counting against brute force."""

import math

import numpy as np

from leaksift.llm import neighbours


def brute(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            scored = sorted((-(q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum())), j) for j, v in good if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_recall_order_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(3000)]
    hot = rng.standard_normal(16).tolist()
    rows += [(3000 + i, hot) for i in range(1000)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [1.0, None] + [0.0] * 14), (5150, [float("nan")] * 16),
             (5200, [float("inf")] + [1.0] * 15), (None, hot), (5250, []), (5300, [1.0, 2.0]), (5301, [2.0, 4.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = {}
    for r in neighbours.nearest(table, vectors_per_block=512, queries_per_block=40).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute(rows, 5, 50)
    assert set(got) == set(want) and 5000 not in got and 5050 not in got
    found = total = 0
    for q, best in want.items():
        mine = [got[q][r + 1] for r in range(len(got[q]))]
        assert len(mine) == len(best) and [s for _, s in mine] == sorted([s for _, s in mine], reverse=True)
        found += len({j for j, _ in mine} & {j for j, _ in best})
        total += len(best)
        exact = dict(best)
        assert all(abs(exact[j] - s) < 1e-12 for j, s in mine if j in exact)
    assert found / total >= 0.95
    assert [j for j, _ in (got[3500][r] for r in range(1, 6))] == [3000, 3001, 3002, 3003, 3004]
    assert got[5300] == {1: (5301, got[5300][1][1])}


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(one).collect()] == [(50, 1, 3)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(empty).collect() == []
