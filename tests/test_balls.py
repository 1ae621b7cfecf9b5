"""Nearest neighbours without a radius, pairs at large radii, medians: against all comparisons."""

import random

import numpy as np
import pytest

from leaksift.functions.bits import signed
from leaksift.operators import balls


def prints(rng, n, words, centres=6, flips=20):
    """Fingerprints around a few centres, with copies and uneven bits."""
    bits = words * 64
    middle = [rng.getrandbits(bits) & rng.getrandbits(bits) for _ in range(centres)]
    out = []
    for _ in range(n):
        x = rng.choice(middle) if rng.random() < .7 else rng.getrandbits(bits)
        for _ in range(rng.randrange(flips)):
            x ^= 1 << rng.randrange(bits)
        out.append(x)
    return out


def split(x, words):
    return [signed(x >> 64 * k & (1 << 64) - 1) for k in range(words)]


def frame(spark, values, words, groups=None):
    names = [f"w{k}" for k in range(words)]
    rows = [(i, (groups or ["g"] * len(values))[i], *(split(x, words) if x is not None else [None] * words)) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "id long, g string, " + ", ".join(f"{n} long" for n in names)), names


def brute(left, right, ga=None, gb=None):
    out = {}
    for i, x in enumerate(left):
        found = [((x ^ y).bit_count(), j) for j, y in enumerate(right) if y is not None and x is not None and (ga is None or ga[i] == gb[j])]
        if found:
            out[i] = min(found)
    return out


@pytest.mark.parametrize("words,cost", [(1, 0.01), (1, 3.0), (4, 0.5), (2, 0.0)])
def test_nearest_at_any_distance(spark, words, cost, monkeypatch):
    monkeypatch.setattr(balls, "BLOCK_ROWS", 64)  # several pivots, parts and batches
    monkeypatch.setattr(balls, "QUERIES_PER_TASK", 50)
    rng = random.Random(words)
    left, right = prints(rng, 400, words), prints(rng, 500, words)
    left += left[:20] + right[:20] + [None]
    right += right[:30] + [None]
    a, names = frame(spark, left, words)
    b, _ = frame(spark, right, words)
    near = balls.nearest(a, b, words=names, rows=500, ref_key="id", compare_cost=cost, round_cost=0, tile_rows=40)
    got = {tuple(r[n] for n in names): (r.distance, r.nearest) for r in near.collect()}
    want = {tuple(split(left[i], words)): v for i, v in brute(left, right).items()}
    assert got == want and max(d for d, _ in got.values()) > 15


def test_nearest_inside_groups(spark):
    rng = random.Random(3)
    left, right = prints(rng, 150, 1), prints(rng, 150, 1)
    ga, gb = [rng.choice("abc") for _ in left], [rng.choice("ab") for _ in right]
    a, names = frame(spark, left, 1, ga)
    b, _ = frame(spark, right, 1, gb)
    want = {(ga[i], split(left[i], 1)[0]): v for i, v in brute(left, right, ga, gb).items()}
    for cost in (0.01, 2.0):
        near = balls.nearest(a, b, words=names, rows=150, ref_key="id", on=["g"], compare_cost=cost, round_cost=0)
        assert {(r.g, r.w0): (r.distance, r.nearest) for r in near.collect()} == want


def test_no_rows(spark):
    a, names = frame(spark, [5, 6], 1)
    for cost in (0.01, 50.0):
        assert balls.nearest(a, a.where("false"), words=names, rows=2, ref_key="id", compare_cost=cost, round_cost=0).collect() == []
        assert balls.nearest(a.where("false"), a, words=names, rows=2, ref_key="id", compare_cost=cost, round_cost=0).collect() == []


@pytest.mark.parametrize("words,radius", [(4, 50), (1, 12), (2, 0)])
def test_all_pairs_of_a_large_radius(spark, words, radius):
    rng = random.Random(radius)
    both = prints(rng, 500, words, flips=50 if words == 4 else 14)
    left, right = sorted(set(both[:250])), sorted({*both[250:], *both[:3]})
    a, names = frame(spark, left, words)
    b, _ = frame(spark, right, words)
    pairs = balls.ball_pairs(a.drop("g"), b.drop("g"), words=names, radius=radius, rows=250, tile_rows=30)
    got = sorted((r.id_a, r.id_b, r.distance) for r in pairs.collect())
    want = sorted((i, j, (x ^ y).bit_count()) for i, x in enumerate(left) for j, y in enumerate(right) if (x ^ y).bit_count() <= radius)
    assert got == want and want


def test_thresholds_cover_the_radius():
    for bits, radius, rows in ((64, 10, 1e6), (256, 50, 1e6), (256, 50, 1e8), (128, 3, 1e4)):
        _, parts, thresholds = balls.cheapest(lambda n: balls.uniform_parts(bits, n), bits, radius, rows)
        assert sum(t + 1 for t in thresholds) == radius + 1 and sorted(b for p in parts.bits for b in p) == list(range(bits))


def test_parts_that_tell_little_get_no_threshold():
    """Bits that never differ let everything through; the plan leaves their part out."""
    rng = np.random.default_rng(1)
    sample = np.concatenate([np.zeros((300, 32)), rng.integers(0, 2, (300, 96))], axis=1).astype(float)
    parts = balls.Parts((tuple(range(32)), tuple(range(32, 80)), tuple(range(80, 128))), tuple(
        tuple(np.cumsum(np.bincount((sample[:50, p][:, None] != sample[None, :, p]).sum(2).ravel(), minlength=len(p) + 1)) / (50 * 300))
        for p in (range(32), range(32, 80), range(80, 128))))
    assert balls.allotted(parts, 4, 1e6)[1][0] == -1


def test_correlated_bits_are_dealt_apart():
    rng = np.random.default_rng(2)
    sample = np.repeat(rng.integers(0, 2, (500, 16)), 4, axis=1).astype(float)  # every bit four times
    parts = balls.spread_bits(sample, 4)
    assert all(len({b // 4 for b in p}) == 16 for p in parts)


def test_medians(spark):
    rng = random.Random(8)
    left, right = prints(rng, 300, 1), prints(rng, 200, 1)
    left += [left[0]] * 150 + [None] * 5
    groups = [rng.choice("abcd") for _ in left[:-5]] + ["empty"] * 5
    a, names = frame(spark, left, 1, groups)
    b, _ = frame(spark, right, 1)
    near = brute(left, right)
    want = {g: float(np.median([near[i][0] for i in range(len(left)) if groups[i] == g and i in near])) for g in "abcd"} | {"empty": None}
    for cost in (0.01, 3.0):
        got = balls.median_distance(a, b, words=names, rows=500, ref_key="id", by=["g"], compare_cost=cost, round_cost=0)
        assert {r.g: r.median_distance for r in got.collect()} == want


def test_medians_search_only_open_groups(spark, monkeypatch):
    """A group whose middle row is settled by near copies sends nothing on."""
    rng = random.Random(9)
    right = [rng.getrandbits(64) for _ in range(100)]
    left = right[:60] + [rng.getrandbits(64) for _ in range(40)] + [rng.getrandbits(64) for _ in range(50)]
    groups = ["near"] * 100 + ["far"] * 50
    a, names = frame(spark, left, 1, groups)
    b, _ = frame(spark, right, 1)
    seen, blocks = [], balls._nearest_by_blocks
    monkeypatch.setattr(balls, "_nearest_by_blocks", lambda start, *rest: (seen.append(start.count()), blocks(start, *rest))[1])
    got = balls.median_distance(a, b, words=names, rows=150, ref_key="id", by=["g"], compare_cost=1.0, round_cost=0)
    assert {r.g: r.median_distance for r in got.collect()}["near"] == 0.0 and seen[0] <= 50


def test_gaps_of_any_width():
    rng = np.random.default_rng(3)
    for words in (1, 3, 4):
        a = rng.integers(0, 2**63, size=(5, words), dtype=np.int64).view(np.uint64)
        b = np.vstack([~a[:1], rng.integers(0, 2**63, size=(7, words), dtype=np.int64).view(np.uint64)])
        want = [[sum((int(x) ^ int(y)).bit_count() for x, y in zip(r, q)) for q in b] for r in a]
        assert balls._gaps(a, np.ascontiguousarray(b.T)).astype(int).tolist() == want and want[0][0] == 64 * words


def test_balls_meet_by_shuffle(spark):
    rng = random.Random(9)
    (left, names), (right, _) = frame(spark, prints(rng, 60, 1), 1), frame(spark, prints(rng, 60, 1), 1)
    parts = balls.uniform_parts(64, 4)
    met = balls._met(left, right, names, [], parts, [(p, 0) for p in range(4)], 60, 20_000)
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.split("== Initial Plan ==")[0].count("BroadcastHashJoin") <= 1  # the masks


@pytest.mark.parametrize("words,radius,cost", [(1, 12, 0.0), (4, 50, 0.0), (1, 12, 1e9), (4, 50, 1e9)])
def test_pairs_by_blocks_and_by_balls(spark, words, radius, cost, monkeypatch):
    monkeypatch.setattr(balls, "PAIR_BLOCK_ROWS", 40)
    rng = random.Random(words)
    left, right = sorted(set(prints(rng, 150, words))), sorted(set(prints(rng, 130, words)))
    right = sorted({*right, *left[:3]})
    (a, names), (b, _) = frame(spark, left, words), frame(spark, right, words)
    pairs = balls.ball_pairs(a.drop("g"), b.drop("g"), words=names, radius=radius, rows=150, compare_cost=cost)
    got = sorted((r.id_a, r.id_b, r.distance) for r in pairs.collect())
    want = sorted((i, j, (x ^ y).bit_count()) for i, x in enumerate(left) for j, y in enumerate(right) if (x ^ y).bit_count() <= radius)
    assert got == want and want
    by_blocks = "CoGroup" in pairs._jdf.queryExecution().executedPlan().toString()
    assert by_blocks == (cost == 0)
    assert pairs.limit(0).columns == [*[f"{c}_a" for c in a.drop("g").columns], *[f"{c}_b" for c in b.drop("g").columns], "distance"]


def test_groups_are_planned_by_what_they_hold(spark):
    sizes = spark.createDataFrame([(i, "a" if i < 30 else "b") for i in range(40)], "id long, g string")
    assert balls._within(sizes, ["g"]) == (30 * 30 + 10 * 10) / 40 and balls._within(sizes.limit(0), ["g"]) == 0.0


@pytest.mark.parametrize("search", ["nearest", "medians"])
def test_open_and_settled_rows_are_never_collected_to_be_broadcast(spark, broadcasts, search, monkeypatch):
    """They grow with the input. Ball masks and cells, with whole numbers as keys, may be broadcast."""
    monkeypatch.setattr(balls, "BLOCK_ROWS", 64)
    rng = random.Random(11)
    left, right = prints(rng, 300, 1), prints(rng, 300, 1)
    right += left[:40]
    groups = [rng.choice("abc") for _ in left]
    (a, names), (b, _) = frame(spark, left, 1, groups), frame(spark, right, 1)
    near, kw = brute(left, right), dict(words=names, rows=400, ref_key="id", compare_cost=2.0, round_cost=0)
    with broadcasts() as sent:
        if search == "nearest":
            found = balls.nearest(a, b, **kw)
            got = {r.id: (r.distance, r.nearest) for r in a.join(found, names, "left").collect()}
        else:
            got = {r.g: r.median_distance for r in balls.median_distance(a, b, by=["g"], **kw).collect()}
    want = near if search == "nearest" else {g: float(np.median([near[i][0] for i in near if groups[i] == g])) for g in "abc"}
    assert got == want and [x for x in sent if "bigint, " in x] == []
