"""Replicate scores: counts per item, areas in segments, and whole scores against exploded rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaksift.functions.counters import drawn
from leaksift.operators import replicates
from leaksift.operators.metrics import combined_scores
from leaksift.operators.replicates import Area, packed, random_memberships, replicate_scores, resample_weights, unpacked

REPS = 21


def counts_of(draws, key="k"):
    rows = draws.collect()
    return {r[key]: c for r, c in zip(rows, unpacked([bytes(r["draws"]) for r in rows], REPS))}


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    counts = rng.poisson(1.0, (50, REPS))
    counts[3, 4] = 700
    mixed = packed(counts[:25]) + packed(counts[25:])  # blocks may have different numbers of planes
    assert (unpacked(mixed, REPS) == counts).all()
    assert packed(np.zeros((2, REPS), np.int64))[0] == bytes(3)


def brute_area(value, positive, counts):
    out = np.zeros(counts.shape[1], np.int64)
    for i in np.flatnonzero(positive):
        below = counts[(value < value[i]) & ~positive].sum(0)
        same = counts[(value == value[i]) & ~positive].sum(0)
        out += counts[i] * (2 * below + same)
    return out


@pytest.mark.parametrize("levels", [1, 2, 3, 40])
def test_segments_add_up_however_rows_are_cut(levels):
    rng = np.random.default_rng(levels)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        value = np.sort(rng.integers(levels, size=n)).astype(float)
        positive, counts = rng.random(n) < 0.3, rng.poisson(1.0, (n, 5))
        total = Area(5)
        for part in np.array_split(np.arange(n), rng.integers(1, 5)):  # tasks
            if len(part) == 0:
                continue
            area = Area(5)
            for chunk in np.array_split(part, rng.integers(1, 4)):
                if len(chunk):
                    area.rows(value[chunk], positive[chunk], counts[chunk])
            for low, single, pos, neg, twice, _ in area.segments():
                total.run(low, pos, neg) if single else total.between(low, pos, neg, twice)
        end = Area(5)
        for low, single, pos, neg, twice, _ in total.segments():
            end._absorb(low, pos, neg, pos * neg if single else twice)
        assert (end.inner[2] == brute_area(value, positive, counts)).all()
        assert (end.inner[0] == counts[positive].sum(0)).all() and (end.inner[1] == counts[~positive].sum(0)).all()


def test_resamples_draw_as_many_items_as_there_are(spark):
    items = spark.range(230).select(F.col("id").alias("k"))
    counts = counts_of(resample_weights(items, "k", REPS, "s", block_items=40))
    assert len(counts) == 230
    whole = np.stack(list(counts.values()))
    assert (whole.sum(0) == 230).all() and whole.max() > 1 and (whole == 0).any()
    again = counts_of(resample_weights(items.repartition(3), "k", REPS, "s", block_items=40))
    assert all((again[k] == c).all() for k, c in counts.items())


def test_subsets_have_their_sizes(spark):
    items = spark.range(230).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"))
    plain = np.stack(list(counts_of(random_memberships(items, "k", REPS, "s", size=70, block_items=40)).values()))
    assert plain.max() == 1 and (plain.sum(0) == 70).all() and len(set(map(bytes, plain.T))) == REPS
    targets = spark.createDataFrame([(0, 30), (1, 500)], "c bigint, target bigint")
    counts = counts_of(random_memberships(items, "k", REPS, "s", targets=targets, by=["c"], block_items=40))
    by_class = [sum(v for k, v in counts.items() if k % 3 == c) for c in (0, 1, 2)]
    assert (by_class[0] == 30).all() and (by_class[1] == 77).all() and not np.any(by_class[2])


def test_subsets_are_the_least_draws_of_all_items(spark):
    items = spark.range(230).select(F.col("id").alias("k"), (F.col("id") % 2).alias("c"))
    digest = {k: hashlib.md5(f"s:{k}".encode()).hexdigest() for k in range(230)}
    draws = {k: drawn("s", np.arange(REPS), np.array([int(d[:7], 16)]))[:, 0] for k, d in digest.items()}
    for by, quotas in (([], {None: 70}), (["c"], {0: 1, 1: 114})):
        targets = None if not by else spark.createDataFrame(list(quotas.items()), "c bigint, target bigint")
        got = counts_of(random_memberships(items, "k", REPS, "s", size=70, targets=targets, by=by, block_items=40))
        for c, quota in quotas.items():
            own = [k for k in range(230) if c is None or k % 2 == c]
            for t in range(REPS):
                want = sorted(own, key=lambda k: (draws[k][t], digest[k]))[:quota]  # noqa: B023
                assert {k for k in own if got[k][t]} == set(want)


def test_a_cut_outside_its_window_is_searched_again(spark, monkeypatch):
    items = spark.range(230).select(F.col("id").alias("k"))
    wide = counts_of(random_memberships(items, "k", REPS, "s", size=70, block_items=40))
    monkeypatch.setattr(replicates, "CUT_SLACK", 1e-6)
    again = counts_of(random_memberships(items, "k", REPS, "s", size=70, block_items=40))
    assert all((again[k] == c).all() for k, c in wide.items())


@pytest.mark.parametrize("absent", ["zero", "skip", "null"])
def test_scores_equal_those_of_exploded_rows(spark, absent):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        y = int(rng.integers(4)) if k else 3  # few of class 3, so it is absent in some replicates
        y = min(y, 2) if k else y
        for team in ("a", "b"):
            scores = [float(s) for s in np.round(rng.random(4), 1)]
            rows.append((k, team, y, int(np.argmax(scores)), scores))
    rows.append((60, "a", 1, 1, None))
    scored = spark.createDataFrame(rows, "k bigint, team string, y int, pred int, scores array<double>")
    draws = resample_weights(scored.where("team = 'a' and scores is not null").select("k"), "k", REPS, "s", block_items=16)
    weights = [(int(k), r, int(w)) for k, c in counts_of(draws).items() for r, w in enumerate(c) if w]
    exploded = scored.join(spark.createDataFrame(weights, "k bigint, rep int, weight bigint"), "k")
    want = {(r["rep"], r["team"]): r["combined"] for r in combined_scores(exploded, ["rep", "team"], absent, "weight").collect()}
    got = {(r["rep"], r["team"]): r["combined"] for r in replicate_scores(scored, draws, REPS, "k", "team", absent, chunk_rows=7).collect()}
    assert got.keys() == want.keys()
    for at, value in want.items():
        assert got[at] == (None if value is None else pytest.approx(value, abs=1e-12))


def test_no_items(spark):
    empty = spark.createDataFrame([], "k bigint, team string, y int, pred int, scores array<double>")
    draws = resample_weights(empty.select("k"), "k", REPS, "s")
    assert draws.count() == 0 and replicate_scores(empty, draws, REPS, "k", "team").count() == 0
