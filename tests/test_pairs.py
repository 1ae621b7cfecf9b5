"""Banded joins against brute force, with hot values and every reading of the joint threshold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leaksift.operators.fingerprints import distinct_fingerprints
from leaksift.operators.pairs import (band_plan, flagged_fingerprints, near_pairs, nearest_within, plan_cost,
                                      random_non_matches)

RNG = np.random.default_rng(7)


def clustered(n, words=2, near=0.6):
    """Random words of which a part are copies of earlier ones with a few bits flipped."""
    out = RNG.integers(0, 2**63, size=(n, words), dtype=np.int64).view(np.uint64)
    out |= RNG.integers(0, 2, size=(n, words)).astype(np.uint64) << np.uint64(63)
    for i in range(1, n):
        if RNG.random() < near:
            out[i] = out[RNG.integers(0, i)]
            for w in range(words):
                for bit in RNG.choice(64, RNG.integers(0, 6), replace=False):
                    out[i, w] ^= np.uint64(1) << np.uint64(bit)
    return out.view(np.int64)


def frame(spark, values, start=0):
    pdf = pd.DataFrame(values, columns=[f"w{i}" for i in range(values.shape[1])])
    pdf.insert(0, "id", range(start, start + len(pdf)))
    return spark.createDataFrame(pdf)


def gaps(a, b):
    return [np.bitwise_count(a[:, None, i].view(np.uint64) ^ b[None, :, i].view(np.uint64)).astype(int)
            for i in range(a.shape[1])]


@pytest.mark.parametrize("words,radius,rule,rows,tile", [
    (1, 0, "sum", 400, 20_000), (1, 6, "sum", 400, 20_000), (1, 6, "sum", 10**6, 5), (1, 10, "sum", 10**5, 20_000),
    (2, 6, "sum", 10**9, 5), (2, 6, "each", 400, 20_000), (2, 3, "each", 10**6, 5), (4, 9, "sum", 400, 20_000)])
def test_pairs_equal_brute_force(spark, words, radius, rule, rows, tile):
    values = np.unique(clustered(250, words), axis=0)
    names = [f"w{i}" for i in range(words)]
    groups = distinct_fingerprints(frame(spark, values), names)
    found = near_pairs(groups, words=names, radius=radius, rows=rows, rule=rule, tile_rows=tile)
    got = found.select(*[f"{n}_{s}" for s in "ab" for n in names]).toPandas().to_numpy()
    d = gaps(values, values)
    close = (sum(d) <= radius) if rule == "sum" else np.all([x <= radius for x in d], axis=0)
    i, j = np.nonzero(np.triu(close, 1))
    want = {frozenset((tuple(values[x]), tuple(values[y]))) for x, y in zip(i, j)}
    have = [frozenset((tuple(r[:words]), tuple(r[words:]))) for r in got]
    assert len(have) == len(set(have)) and set(have) == want


def test_two_corpora_with_a_hot_bucket(spark):
    """A third of the rows share the upper half of the word; tiles keep every pair."""
    left = clustered(300, 1, near=0.2)
    left[:100, 0] = (left[:100, 0] & 0xFFFF) | (0x1234 << 40)
    right = np.concatenate([left[50:150], clustered(100, 1)])
    left, right = np.unique(left, axis=0), np.unique(right, axis=0)
    a = distinct_fingerprints(frame(spark, left), ["w0"])
    b = distinct_fingerprints(frame(spark, right), ["w0"])
    got = near_pairs(a, b, words=["w0"], radius=6, rows=1000, tile_rows=20)
    assert "_ta" in got._jdf.queryExecution().toString()
    got = got.count()
    assert got == int((gaps(left, right)[0] <= 6).sum())


def test_copies_cost_one_row(spark):
    values = np.repeat(clustered(3, 1, near=0), [5000, 3, 1], axis=0)
    groups = distinct_fingerprints(frame(spark, values), ["w0"])
    assert groups.count() == 3 and sorted(r.n for r in groups.collect()) == [1, 3, 5000]


def test_null_words_never_match(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 5), (4, 5)], "id int, w0 bigint")
    near = nearest_within(df.where("id in (1,3)"), df.where("id in (2,4)"), words=["w0"], radius=3, rows=4, ref_key="id")
    assert [(r.w0, r.distance, r.nearest) for r in near.collect()] == [(5, 0, 4)]


def test_three_readings_differ(spark):
    zero = np.array([[0, 0]])
    refs = np.array([[3, (1 << 20) - 1], [(1 << 20) - 1, 3], [0b11111, 0b1]])
    items, reference = frame(spark, zero), frame(spark, refs[:2])
    kw = dict(words=["w0", "w1"], radius=6, rows=10, ref_key="id")
    assert flagged_fingerprints(items, reference, "independent", **kw).count() == 1
    assert flagged_fingerprints(items, reference, "same_row", **kw).count() == 0
    both = frame(spark, np.array([[0b11111, 0b11111]]))
    assert flagged_fingerprints(items, both, "same_row", **kw).count() == 1
    assert flagged_fingerprints(items, both, "additive", **kw).count() == 0
    assert flagged_fingerprints(items, frame(spark, refs[2:]), "additive", **kw).count() == 1
    with pytest.raises(ValueError):
        flagged_fingerprints(items, both, "joint", **kw)


def test_nearest_takes_the_first_reference_on_ties(spark):
    reference = frame(spark, np.array([[1], [2], [1]]), start=10)
    near = nearest_within(frame(spark, np.array([[0]])), reference, words=["w0"], radius=4, rows=10, ref_key="id")
    assert [(r.distance, r.nearest) for r in near.collect()] == [(1, 10)]


@pytest.mark.parametrize("rows", [500, 10**6])
def test_nearest_and_flags_equal_brute_force(spark, rows):
    """Small inputs search the radius at once, large ones by growing radii: the same rows."""
    items, reference = clustered(150, 2), clustered(200, 2)
    reference[:60] = items[:60] ^ RNG.integers(0, 4, size=(60, 2))
    a, b = frame(spark, items), frame(spark, reference)
    kw = dict(radius=6, rows=rows, ref_key="id")
    got = {r.w0: (r.distance, r.nearest) for r in nearest_within(a, b, words=["w0"], **kw).collect()}
    d = gaps(items, reference)
    want = {int(items[i, 0]): (int(x.min()), int(x.argmin())) for i, x in enumerate(d[0]) if x.min() <= 6}
    assert got == want
    close = {"independent": (d[0] <= 6).any(1) & (d[1] <= 6).any(1), "same_row": ((d[0] <= 6) & (d[1] <= 6)).any(1),
             "additive": (d[0] + d[1] <= 6).any(1)}
    for mode, flags in close.items():
        hits = flagged_fingerprints(a, b, mode, words=["w0", "w1"], **kw).collect()
        assert {tuple(r) for r in hits} == {tuple(items[i]) for i in np.flatnonzero(flags)}


def test_band_plan_grows_keys_with_rows():
    few, many = band_plan(1, 6, 1000), band_plan(1, 6, 10**8)
    assert len(few.bands) == 7 and len(many.bands) > len(few.bands)
    with pytest.raises(ValueError):
        band_plan(1, 64, 10)


@pytest.mark.parametrize("words,radius,rule", [(2, 6, "sum"), (2, 6, "each"), (4, 12, "sum"), (2, 12, "sum"), (4, 7, "each")])
def test_plans_stay_selective_as_rows_grow(words, radius, rule):
    bits = [plan_cost(words, radius, rows, rule)["key_bits"] for rows in (10**6, 10**8, 10**10)]
    assert bits == sorted(bits) and bits[-1] > bits[0]
    for rows in (10**6, 10**8, 10**10):
        cost = plan_cost(words, radius, rows, rule)
        # Each band row meets few others: the work follows the rows, not their square.
        assert cost["candidates"] <= 200 * cost["band_rows"] and cost["candidates"] < 1e-2 * rows * rows


def test_each_rule_may_band_some_words_only():
    assert plan_cost(2, 6, 10**9, "each")["bands"] < 784
    assert all(b.masks[1] == 0 for b in band_plan(2, 6, 10**9, "each").bands)


def test_non_matches_are_no_matches(spark):
    matches = spark.range(30).select(F.col("id").alias("item"), (F.col("id") % 7).alias("matched"))
    refs = spark.range(7).withColumnRenamed("id", "ref")
    got = random_non_matches(matches, refs, 500, item="item", matched="matched", ref_key="ref").join(matches, "item").collect()
    assert len(got) == 500 and all(r.ref != r.matched for r in got) and len({r.ref for r in got}) == 7


def test_scores_of_pairs_that_share_one_popular_row(spark):
    import leaksift.operators.skew as skew
    from leaksift.operators.pairs import pair_scores

    pairs = spark.range(2000).select(F.col("id").alias("a"), F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id")).alias("b"))
    vectors = spark.range(2000).select("id", F.array((F.col("id") % 5).cast("double"), F.lit(1.0)).alias("unit"))
    want = sorted((r.a, r.b, float((r.a % 5) * (r.b % 5) + 1)) for r in pairs.collect())
    limit = skew.salted_lookup.__defaults__
    skew.salted_lookup.__defaults__ = ("left", 100, None)  # every key above a hundred rows is split
    try:
        got = pair_scores(pairs, vectors, left="a", right="b", key="id").collect()
    finally:
        skew.salted_lookup.__defaults__ = limit
    assert sorted((r.a, r.b, r.score) for r in got) == want


def test_banded_sides_are_never_collected_to_be_broadcast(spark):
    items = distinct_fingerprints(frame(spark, clustered(200)), ["w0", "w1"])
    for pairs in (near_pairs(items, words=["w0", "w1"], radius=6, rows=10**6), near_pairs(items, items, words=["w0"], radius=6, rows=400)):
        pairs.collect()
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("words,radius,rule,rows,tile", [(1, 6, "sum", 10**6, 10**9), (1, 10, "sum", 3 * 10**6, 40), (2, 6, "sum", 10**9, 10**9),
                                                         (2, 4, "each", 10**6, 40)])
def test_large_inputs_are_shuffled_once_per_first_block(spark, monkeypatch, words, radius, rule, rows, tile):
    """Not once per band: that grows with the input. Groups and tiles of groups lose and repeat no pair."""
    from leaksift.operators import pairs

    monkeypatch.setattr(pairs, "GROUP_ROWS", rows // 3)
    monkeypatch.setattr(pairs, "GROUP_TILE_ROWS", tile)
    monkeypatch.setattr(pairs, "SCOUT_SHARE", 1)
    monkeypatch.setattr(pairs, "scout", lambda df, spread: df)
    names = [f"w{i}" for i in range(words)]
    values = np.unique(clustered(300, words), axis=0)
    other = np.unique(np.concatenate([values[::3], clustered(100, words)]), axis=0)
    left, right = (distinct_fingerprints(frame(spark, v), names) for v in (values, other))
    bands = pairs.band_plan(words, radius, rows, rule)
    assert len(pairs._by_first_block(bands)) <= radius + 1 < len(bands.bands)
    for a, b, x, y in ((left, None, values, values), (left, right, values, other)):
        found = near_pairs(a, b, words=names, radius=radius, rows=rows, rule=rule)
        assert "_band" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = found.select(*[f"{n}_{s}" for s in "ab" for n in names], *[f"dist_{n}" for n in names], "distance").toPandas().to_numpy()
        d = gaps(x, y)
        close = (sum(d) <= radius) if rule == "sum" else np.all([g <= radius for g in d], axis=0)
        want = {(*x[i], *y[j], *[g[i, j] for g in d], sum(g[i, j] for g in d)) for i, j in zip(*np.nonzero(close))
                if b is not None or tuple(x[i]) < tuple(y[j])}
        have = [tuple(r) for r in got]
        assert len(have) == len(set(have)) and set(have) == want and want


def test_groups_meet_equal_values_only(spark, monkeypatch):
    values = np.unique(clustered(200, 1), axis=0)
    side = frame(spark, values).withColumn("of", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")))
    groups = distinct_fingerprints(side, ["w0"], by=["of"])
    few, many = (near_pairs(groups, words=["w0"], radius=6, rows=rows, on=["of"]).toPandas() for rows in (10_000, 10**6))
    order = ["of_a", "of_b", "w0_a", "w0_b", "distance", "n_a", "n_b", "dist_w0"]
    rows_of = lambda t: sorted(map(tuple, t[order].to_numpy()))
    assert rows_of(few) == rows_of(many) and len(few)


@pytest.mark.parametrize("mode", ["independent", "same_row", "additive"])
def test_flags_are_never_collected_to_be_broadcast(spark, broadcasts, mode):
    """Neither between the radii nor by who joins them back; they grow with the input."""
    items, reference = clustered(300, 2), clustered(300, 2)
    reference[:200] = items[:200] ^ RNG.integers(0, 4, size=(200, 2))
    a, b = frame(spark, items), frame(spark, reference)
    with broadcasts() as sent:
        hits = flagged_fingerprints(a, b, mode, words=["w0", "w1"], radius=6, rows=10**6, ref_key="id")
        marked = a.join(hits.withColumn("_hit", F.lit(True)), ["w0", "w1"], "left").where("_hit").count()
    d = gaps(items, reference)
    close = {"independent": (d[0] <= 6).any(1) & (d[1] <= 6).any(1), "same_row": ((d[0] <= 6) & (d[1] <= 6)).any(1),
             "additive": (d[0] + d[1] <= 6).any(1)}
    assert marked == int(close[mode].sum()) and sent == []
