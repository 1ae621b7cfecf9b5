"""Counter-based draws: even, alike in SQL, and parted without loss."""

import duckdb
import numpy as np
import pytest

from leaksift.functions import counters
from leaksift.operators import stats


def test_draws_are_even_and_unrelated():
    x = counters.drawn("s", np.arange(400), np.arange(500)) % 97
    expected = x.size / 97
    assert ((np.bincount(x.ravel(), minlength=97) - expected) ** 2 / expected).sum() < 160  # 96 degrees of freedom
    z = x - x.mean()
    for other in (z[1:] * z[:-1], z[:, 1:] * z[:, :-1], z[2:, 1:] * z[:-2, :-1]):
        assert abs(other.mean()) / z.var() < 0.01
    assert (counters.drawn("s", np.arange(3), np.arange(4)) != counters.drawn("t", np.arange(3), np.arange(4))).all()
    assert (counters.drawn("s", np.arange(3), np.arange(4)) != counters.drawn("s", np.arange(3), np.arange(4), 1)).all()


def test_fifth_power_is_a_permutation():
    assert np.gcd(5, counters.PRIME - 1) == 1


def test_sql_draws_alike():
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT a, b FROM (SELECT unnest(range(40)) a), (SELECT unnest(range(50)) b)")
    got = con.execute(f"SELECT a, b, x FROM {counters.drawn_sql('k', 't', '', 'a', 'b')} ORDER BY 1, 2").fetchall()
    want = counters.drawn("k", np.arange(40), np.arange(50))
    assert [r[2] for r in got] == want.ravel().tolist()


def test_tree_parts_all_draws():
    reps, sizes = np.arange(1000, 3000), np.array([5, 8, 8, 1, 8])
    counts = np.stack([counters.split_counts("x", reps, sizes, 30, b) for b in range(5)])
    assert (counts.sum(0) == 30).all() and np.allclose(counts.mean(1), sizes, atol=0.25)
    p = sizes / 30
    assert np.allclose(counts.var(1), 30 * p * (1 - p), rtol=0.15)


@pytest.mark.parametrize("block", [8192, 7])
def test_sums_equal_the_draws(spark, monkeypatch, block):
    monkeypatch.setattr(stats, "BLOCK_GROUPS", block)
    monkeypatch.setattr(stats, "SPAN_REPS", 60)
    rows = [(g, i, i * i % 17, 1) for g in "ab" for i in range(40 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, i long, v long, one int")
    got = {(r.g, r.rep): (r.v, r.one) for r in stats.bootstrap_sums(df, "i", 150, "z", ["v", "one"], ["g"]).collect()}
    assert len(got) == 300 and all(one == (40 if g == "a" else 3) for (g, _), (_, one) in got.items())
    mean = np.mean([v for (g, _), (v, _) in got.items() if g == "a"])
    assert abs(mean - sum(r[2] for r in rows if r[0] == "a")) < 15
    if block > 40:
        order = stats.hash_rank(df.where("g = 'a'"), ["i"], ["g"], "z", "at").orderBy("at").collect()
        values = np.array([r.v for r in order])
        index = counters.drawn("z", np.arange(150), np.arange(40)) % 40
        assert [got["a", r][0] for r in range(150)] == values[index].sum(1).tolist()


@pytest.mark.parametrize("rows,block", [(9_000, 1 << 20), (200, 64)])
def test_sums_of_many_rows_are_those_of_the_plain_draws(spark, monkeypatch, rows, block):
    """However many rows there are and however they are cut, and in parts that adaptive execution does not merge."""
    monkeypatch.setattr(stats, "BLOCK_GROUPS", block)
    monkeypatch.setattr(stats, "SPAN_REPS", 5)
    df = spark.range(rows).selectExpr("id", "id * id % 1009 AS v")
    sums = stats.bootstrap_sums(df, "id", 15, "q", ["v"])
    assert "REPARTITION_BY_NUM" in sums._jdf.queryExecution().executedPlan().toString()
    values = np.array([r.v for r in stats.hash_rank(df, ["id"], [], "q", "at").orderBy("at").collect()])
    index = counters.drawn("q", np.arange(15), np.arange(rows)) % rows
    assert [r.v for r in sums.orderBy("rep").collect()] == values[index].sum(1).tolist()


def test_fast_powers_are_exact():
    edge = np.array([0, 1, 2, 46_340, 46_341, 65_536, 1 << 30, counters.PRIME - 2, counters.PRIME - 1], np.uint64)
    x = np.concatenate([edge, np.random.default_rng(3).integers(0, counters.PRIME, 2_000).astype(np.uint64)])
    want = [pow(int(v), 5, counters.PRIME) for v in x]
    counters._fifth(x)
    assert x.tolist() == want
