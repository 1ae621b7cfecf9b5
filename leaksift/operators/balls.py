"""Hamming search at any distance: substring balls with a threshold per part, and blocks around pivots for the rest.

General pigeonhole: cut the bits into parts; if part ``i`` has threshold ``t_i``,
two fingerprints at distance below ``sum(t_i + 1)`` are within ``t_i`` on some
part ``i``. One side lists every part value within its threshold (a ball), the
other its own part values, and an equi-join on (part, value) meets all such
pairs. Bits are dealt to parts so that correlated ones are apart, and what a
threshold lets through is read off a bounded sample, so parts that tell little
get low thresholds or none. The sample decides the cost only, never the rows.

* :func:`ball_pairs` finds all pairs within a fixed radius, thresholds allotted
  by dynamic programming.
* :func:`nearest` has no radius. Thresholds grow by the cheapest step; a row is
  settled when its best distance is below the sum. What would cost more to
  reach by balls than by comparing goes to :func:`_nearest_by_blocks`:
  references lie in cells around pivots, and a row meets only the cells that
  the triangle inequality leaves open, as bit counts of whole blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksift.functions.bits import WORD_BITS, hamming_words, signed
from leaksift.operators.fingerprints import distinct_fingerprints
from leaksift.operators.pairs import TILE_ROWS, _long, _tiled, nearest_within, plan_cost
from leaksift.operators.skew import by_shuffle, sized
from leaksift.session import materialise

SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 256
MOST_PARTS = 20
BALL_ROWS = 200_000       # masks of one plan; they are broadcast
INDEX_COST = 4.0          # of a reference's row per part, against a probe or a candidate
COMPARE_COST = 0.001      # of one comparison inside a block (2 ns a word), against a shuffled probe or candidate
COMPARED_AT_ONCE = 1 << 18  # rows times references, so that their distances stay in a cache
ROUND_COST = 5e6          # of starting a round, against a probe or a candidate
NEAR_BANDS = 40
PIVOTS = 64
BLOCK_ROWS = 65_536
PAIR_BLOCK_ROWS = 4_096   # of either side; all pairs of two blocks fit in a task
QUERIES_PER_TASK = 16_384
FAR = 1 << 20


@dataclass(frozen=True)
class Parts:
    """Bits of every part (numbered over all words) and, per part, the share of pairs within each distance."""

    bits: tuple[tuple[int, ...], ...]
    within: tuple[tuple[float, ...], ...]

    def step_cost(self, part: int, threshold: int, rows: float) -> float:
        """Probes and candidates per row that raising ``part`` to ``threshold`` adds."""
        size, share = len(self.bits[part]), self.within[part]
        return math.comb(size, threshold) + rows * (share[threshold] - (share[threshold - 1] if threshold else 0.0))


def uniform_parts(bits: int, count: int) -> Parts:
    """Parts of fingerprints whose bits are fair and independent."""
    cut = [i * bits // count for i in range(count + 1)]
    sizes = [b - a for a, b in zip(cut, cut[1:])]
    shares = [tuple(float(x) for x in np.cumsum([math.comb(s, d) / 2.0 ** s for d in range(s + 1)])) for s in sizes]
    return Parts(tuple(tuple(range(a, b)) for a, b in zip(cut, cut[1:])), tuple(shares))


def spread_bits(sample: np.ndarray, count: int) -> list[list[int]]:
    """Bits dealt to parts of equal size, each to the part whose bits it correlates with least."""
    bits = sample.shape[1]
    centred = sample - sample.mean(0)
    scale = np.sqrt((centred * centred).sum(0))
    scale[scale == 0] = np.inf
    tied = np.abs((centred / scale).T @ (centred / scale))
    room = [(i + 1) * bits // count - i * bits // count for i in range(count)]
    parts: list[list[int]] = [[] for _ in range(count)]
    for bit in np.argsort(-tied.sum(0), kind="stable"):
        at = min((p for p in range(count) if len(parts[p]) < room[p]), key=lambda p: (tied[bit, parts[p]].sum(), len(parts[p])))
        parts[at].append(int(bit))
    return [sorted(p) for p in parts]


def _unpacked(frame: pd.DataFrame, words: Sequence[str]) -> np.ndarray:
    raw = np.ascontiguousarray(frame[list(words)].to_numpy(np.int64)).view(np.uint8)
    return np.unpackbits(raw, axis=1, bitorder="little").astype(np.float64)


def _sampled(side: DataFrame, words: Sequence[str], rows: int) -> np.ndarray:
    """Bits of the ``rows`` fingerprints with the least hashes; a task chooses them, so the driver gets no more than these."""
    return _unpacked(side.select(*words).orderBy(F.xxhash64(*words), *words).limit(rows).coalesce(1).toPandas(), words)


def measured_parts(left: np.ndarray, right: np.ndarray, count: int) -> Parts:
    """Parts for sampled bits of both sides."""
    parts, shares = spread_bits(right, count), []
    for p in parts:
        a, b = left[:, p], right[:, p]
        apart = (a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * a @ b.T).astype(int)
        shares.append(tuple(float(x) for x in np.cumsum(np.bincount(apart.ravel(), minlength=len(p) + 1)) / apart.size))
    return Parts(tuple(map(tuple, parts)), tuple(shares))


def allotted(parts: Parts, radius: int, rows: float) -> tuple[float, tuple[int, ...]]:
    """Least cost and thresholds (-1: part unused) with ``sum(t + 1) = radius + 1``, by dynamic programming."""
    best: list[tuple[float, tuple[int, ...]]] = [(0.0, ())] + [(math.inf, ())] * (radius + 1)
    for part, bits in enumerate(parts.bits):
        costs, ball = [0.0], 0
        for t in range(min(len(bits), radius + 1)):
            ball += math.comb(len(bits), t)
            if ball > BALL_ROWS:
                break
            costs.append(costs[-1] + parts.step_cost(part, t, rows) + (INDEX_COST if t == 0 else 0.0))
        after: list[tuple[float, tuple[int, ...]]] = [(math.inf, ())] * (radius + 2)
        for spent, (cost, chosen) in enumerate(best):
            if math.isinf(cost):
                continue
            for give, extra in enumerate(costs[:radius + 2 - spent]):
                if cost + extra < after[spent + give][0]:
                    after[spent + give] = cost + extra, (*chosen, give - 1)
        best = after
    return best[radius + 1]


def cheapest(parts_of: Callable[[int], Parts], bits: int, radius: int, rows: float,
             around: int | None = None) -> tuple[float, Parts, tuple[int, ...]]:
    """Cost, parts and thresholds of the best number of parts (near ``around`` if given); none wider than a signed long."""
    found = None
    fewest = -(-bits // (WORD_BITS - 1))
    for count in range(fewest, max(fewest, min(MOST_PARTS, radius + 1)) + 1):
        if around is not None and abs(count - around) > 2:
            continue
        parts = parts_of(count)
        cost, thresholds = allotted(parts, radius, rows)
        if not math.isinf(cost) and (found is None or cost < found[0]):
            found = cost, parts, thresholds
    if found is None:
        raise ValueError(f"radius {radius} of {bits} bits needs balls of more than {BALL_ROWS} values")
    return found


def ball_cost(words: int, radius: int, rows: int) -> dict[str, float]:
    """What :func:`ball_pairs` does per row among ``rows`` uniform fingerprints: ``parts``, ``probes``, ``candidates``.

    ``share`` is probes and candidates as a share of all comparisons.
    """
    _, parts, thresholds = cheapest(lambda n: uniform_parts(words * WORD_BITS, n), words * WORD_BITS, radius, rows)
    probes = sum(math.comb(len(b), d) for b, t in zip(parts.bits, thresholds) for d in range(t + 1))
    candidates = rows * sum(w[t] for w, t in zip(parts.within, thresholds) if t >= 0)
    return {"parts": len(parts.bits), "probes": float(probes), "candidates": candidates, "share": (probes + candidates) / rows}


# --- part values and balls ----------------------------------------------------

def _value(words: Sequence[str], bits: Sequence[int]) -> str:
    """The chosen bits as one number, in SQL."""
    return " | ".join(f"shiftleft(shiftright(`{words[b // WORD_BITS]}`, {b % WORD_BITS}) & 1L, {k})" for k, b in enumerate(bits))


def _part_distance(a: Sequence[Column], b: Sequence[Column], bits: Sequence[int]) -> Column:
    """Differing bits inside a part."""
    masks = [0] * len(a)
    for bit in bits:
        masks[bit // WORD_BITS] |= 1 << bit % WORD_BITS
    counts = [F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(signed(m)).cast("bigint"))) for x, y, m in zip(a, b, masks) if m]
    return reduce(Column.__add__, counts)


def _valued(side: DataFrame, words: Sequence[str], parts: Parts, used: Sequence[int]) -> DataFrame:
    """One row per fingerprint and part used: ``_part`` and ``_value``."""
    entries = ", ".join(f"struct({p} AS _part, {_value(words, parts.bits[p])} AS _value)" for p in used)
    return side.select("*", F.inline(F.expr(f"array({entries})")))


def _masks(spark, parts: Parts, steps: Sequence[tuple[int, int]]) -> DataFrame:
    """The ball layers (part, distance) as ``_part`` and ``_mask``; at most ``BALL_ROWS`` per part."""
    frames = []
    for part, distance in steps:
        size = len(parts.bits[part])
        chosen = np.fromiter((x for c in combinations(range(size), distance) for x in c), np.int64, math.comb(size, distance) * distance)
        masks = (np.int64(1) << chosen.reshape(-1, distance)).sum(1) if distance else np.zeros(1, np.int64)
        frames.append(pd.DataFrame({"_part": np.full(len(masks), part, np.int32), "_mask": masks}))
    return F.broadcast(spark.createDataFrame(pd.concat(frames), "_part int, _mask bigint"))


def _met(left: DataFrame, right: DataFrame, words: Sequence[str], on: Sequence[str], parts: Parts,
         steps: Sequence[tuple[int, int]], rows: int, tile_rows: int) -> DataFrame:
    """Rows of ``left`` and ``right`` that meet in a ball layer; columns end in ``_a`` and ``_b``."""
    used = sorted({p for p, _ in steps})
    probes = (_valued(left, words, parts, used).join(_masks(left.sparkSession, parts, steps), "_part")
              .withColumn("_value", F.col("_value").bitwiseXOR(F.col("_mask"))).drop("_mask"))
    values = _valued(right, words, parts, used)
    key = [*on, "_part", "_value"]
    if rows > tile_rows:
        tiles = _tiled(probes, values, words, key, tile_rows, False)
        if tiles:
            (probes, values), key = tiles, [*key, "_ta", "_tb"]
    a = probes.select(*[F.col(c).alias(f"{c}_a") for c in dict.fromkeys([*left.columns, *key])])
    b = values.select(*[F.col(c).alias(f"{c}_b") for c in dict.fromkeys([*right.columns, *key])])
    return by_shuffle(a).join(b, reduce(Column.__and__, [F.col(f"{c}_a") == F.col(f"{c}_b") for c in key]))


def ball_pairs(left: DataFrame, right: DataFrame, *, words: Sequence[str], radius: int, rows: int,
               on: Sequence[str] = (), tile_rows: int = TILE_ROWS, compare_cost: float = COMPARE_COST) -> DataFrame:
    """Pairs of distinct fingerprints of two sides within ``radius`` over all words, each exactly once, with ``distance``.

    For radii that are a large share of the bits, where :func:`near_pairs` would
    need too many bands; :func:`ball_cost` tells the work. A pair that meets on
    several parts is kept by the first of them, decided from the pair itself.
    Where balls cost more than comparing all (``compare_cost`` a word), blocks of
    both sides are compared; both are exact.
    """
    words, on = list(words), list(on)
    a, b = _sampled(left, words, SAMPLE_QUERIES), _sampled(right, words, SAMPLE_ROWS)
    bits = len(words) * WORD_BITS
    cost, parts, thresholds = cheapest(lambda n: uniform_parts(bits, n), bits, radius, rows)
    if len(a) and len(b):
        cost, parts, thresholds = cheapest(lambda n: measured_parts(a, b, n), bits, radius, rows, around=len(parts.bits))
    if cost > compare_cost * len(words) * rows:
        return _block_pairs(left, right, words, on, radius, rows)
    steps = [(p, d) for p, t in enumerate(thresholds) for d in range(t + 1)]
    met = _met(left, right, words, on, parts, steps, rows, tile_rows)
    wa, wb = ([F.col(f"{w}_{s}") for w in words] for s in "ab")
    first = F.coalesce(*[F.when(_part_distance(wa, wb, parts.bits[p]) <= t, F.lit(p)) for p, t in enumerate(thresholds) if t >= 0])
    total = hamming_words(wa, wb)
    return met.where((total <= radius) & (first == F.col("_part_a"))).select(
        *[f"{c}_a" for c in left.columns], *[f"{c}_b" for c in right.columns], total.alias("distance"))


def _block_pairs(left: DataFrame, right: DataFrame, words: Sequence[str], on: Sequence[str], radius: int, rows: int) -> DataFrame:
    """The same pairs by comparing every block of one side with every block of the other, each two in a task's group."""
    blocks = F.lit(max(1, -(-rows // PAIR_BLOCK_ROWS)))
    own = F.pmod(F.xxhash64(F.lit("block"), *words), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))
    a = left.dropna(subset=[*on, *words]).select("*", own.alias("_ta"), every.alias("_tb"))
    b = right.dropna(subset=[*on, *words]).select("*", own.alias("_tb"), every.alias("_ta"))
    meet, mine, other, some = [*on, "_ta", "_tb"], left.columns, right.columns, -(-len(words) // 2)
    schema = ", ".join([*[f"`{c}_a` {kind}" for c, kind in left.dtypes], *[f"`{c}_b` {kind}" for c, kind in right.dtypes], "distance int"])

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        p = x[words].to_numpy(np.int64).view(np.uint64)
        q = np.ascontiguousarray(y[words].to_numpy(np.int64).view(np.uint64).T)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        step = max(1, COMPARED_AT_ONCE // max(1, len(y)))
        for i in range(0, len(p) if len(y) else 0, step):
            gap = _gaps(p[i:i + step, :some], q[:some])  # what half the words leave is compared in the rest
            at, to = np.nonzero(gap <= radius)
            total = gap[at, to].astype(np.int32)
            for k in range(some, len(words)):
                total += np.bitwise_count(p[at + i, k] ^ q[k, to])
            near = total <= radius
            found.append((at[near] + i, to[near], total[near]))
        at, to, distance = (np.concatenate(part) for part in zip(*found))
        sides = (x[mine].iloc[at].add_suffix("_a").reset_index(drop=True), y[other].iloc[to].add_suffix("_b").reset_index(drop=True))
        return pd.concat([*sides, pd.Series(distance, name="distance")], axis=1)

    return a.groupBy(*meet).cogroup(b.groupBy(*meet)).applyInPandas(compare, schema)


# --- nearest without a radius ----------------------------------------------------

def _growth(parts: Parts, rows: float, limit: float) -> list[list[tuple[int, int]]]:
    """Rounds of ball layers, each the cheapest to add next, as long as all together cost less than ``limit`` per row.

    A round ends when its cost passes that of all rounds before it by
    eight times, so there are few.
    """
    reached, spent, rounds, budget, now = [-1] * len(parts.bits), 0.0, [], 8.0 * len(parts.bits), []
    while True:
        options = [(parts.step_cost(p, reached[p] + 1, rows) + (INDEX_COST if reached[p] < 0 else 0.0), p)
                   for p in range(len(reached)) if reached[p] < len(parts.bits[p])]
        cost, part = min(options, default=(math.inf, -1))
        size = len(parts.bits[part]) if part >= 0 else 0
        if spent + cost > limit or sum(math.comb(size, d) for d in range(reached[part] + 2)) > BALL_ROWS:
            return [*rounds, now] if now else rounds
        reached[part] += 1
        now.append((part, reached[part]))
        spent += cost
        if spent > budget:
            rounds.append(now)
            now, budget = [], budget * 8


def _best_parts(left: DataFrame, right: DataFrame, words: Sequence[str], rows: int, limit: float) -> tuple[Parts, list[list[tuple[int, int]]]]:
    """The parts whose balls certify the largest distance within ``limit``, and their rounds."""
    a, b = _sampled(left, words, SAMPLE_QUERIES), _sampled(right, words, SAMPLE_ROWS)
    bits, found = len(words) * WORD_BITS, None
    if not len(a) or not len(b):
        return uniform_parts(bits, 2), []
    usual, fewest = round(bits / max(1.0, math.log2(rows))), -(-bits // (WORD_BITS - 1))
    for count in range(max(fewest, min(usual, MOST_PARTS) - 2), max(fewest, min(usual + 2, MOST_PARTS)) + 1):
        parts = measured_parts(a, b, count)
        rounds = _growth(parts, rows, limit)
        layers = sum(map(len, rounds))
        if found is None or layers > found[0]:
            found = layers, parts, rounds
    return found[1], found[2]


def _least(rows: DataFrame, keys: Sequence[str], ref_key: str) -> DataFrame:
    """Smallest (distance, reference key) per row."""
    best = F.min(F.struct("distance", ref_key)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.distance", F.col(f"_best.{ref_key}").alias("nearest"))


def _within(reference: DataFrame, on: Sequence[str]) -> float:
    """References that a reference's own group holds, on average: what a row would be compared with."""
    sizes = reference.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return sizes.agg(F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).first()[0] or 0.0


def nearest(items: DataFrame, reference: DataFrame, *, words: Sequence[str], rows: int, ref_key: str, on: Sequence[str] = (),
            need: Callable[[DataFrame, DataFrame], DataFrame] | None = None, compare_cost: float = COMPARE_COST,
            round_cost: float = ROUND_COST, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Smallest distance and first nearest reference key of every distinct item fingerprint, however far.

    ``on`` compares rows with equal values only; where those have no reference
    a fingerprint is absent. ``rows`` bounds the fingerprints of either side.
    ``need`` may drop open rows after each stage: it gets the settled and
    the open rows and returns the open ones to go on with; rows it drops are
    absent. Near copies are settled first with long, rare keys, then balls
    grow, then the rest is compared block by block; all three are exact. Open
    and settled rows grow with the input and are joined by shuffle, here and
    by whoever gets them.
    ``compare_cost`` and ``round_cost`` set where the last begins, never the
    result: a round of balls is not worth its start where comparing all costs less.
    """
    words, on = list(words), list(on)
    keys = [*on, *words]
    left = materialise(distinct_fingerprints(items, words, by=on).drop("n"))
    right = materialise(distinct_fingerprints(reference, words, first=ref_key, by=on).drop("n"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides may come from one table
    within = rows if not on else _within(right, on)
    limit = compare_cost * within if compare_cost * within * rows >= round_cost else 0.0
    settled, still = [], left

    def settle(found: DataFrame) -> DataFrame:
        """Keep what is settled; the rows that go on."""
        settled.append(found)
        on_with = still.join(by_shuffle(found), keys, "left_anti")
        if need is not None:
            on_with = need(by_shuffle(reduce(DataFrame.unionByName, settled)), on_with)
        return materialise(on_with)

    near = max((r for r in range(len(words) * WORD_BITS // 10 + 1) if plan_cost(len(words), r, rows)["bands"] <= NEAR_BANDS), default=0)
    if plan_cost(len(words), near, rows)["bands"] <= limit:
        still = settle(materialise(nearest_within(still, right, words=words, radius=near, rows=rows, ref_key=ref_key, on=on)))
    best, reached = None, 0
    parts, rounds = _best_parts(still, right, words, rows, limit) if limit else (None, [])
    wa, wb = ([F.col(f"{w}_{s}") for w in words] for s in "ab")
    for steps in rounds:
        met = _met(still, right, words, on, parts, steps, rows, tile_rows)
        hits = met.select(*[F.col(f"{c}_a").alias(c) for c in keys], hamming_words(wa, wb).alias("distance"), F.col(f"{ref_key}_b").alias(ref_key))
        if best is not None:
            hits = hits.unionByName(best.join(by_shuffle(still), keys, "left_semi").withColumnRenamed("nearest", ref_key))
        best = materialise(_least(hits, keys, ref_key))
        reached += len(steps)  # below this distance every pair has met
        still = settle(best.where(F.col("distance") < reached))
    start = still.withColumn("distance", F.lit(FAR)) if best is None else still.join(
        by_shuffle(best.drop("nearest")), keys, "left").withColumn("distance", F.coalesce("distance", F.lit(FAR)))
    settled.append(_nearest_by_blocks(start, right, words, on, rows, ref_key))
    return by_shuffle(reduce(DataFrame.unionByName, settled))


def _nearest_by_blocks(left: DataFrame, right: DataFrame, words: Sequence[str], on: Sequence[str], rows: int, ref_key: str) -> DataFrame:
    """Nearest reference of rows with an upper bound ``distance``, comparing all that pivots cannot rule out.

    A cell holds the references nearest to one pivot within a span of
    distances; a row whose distance to the pivot differs from the span by more
    than its bound skips the cell. Rows first meet the likeliest cell, which
    tightens the bound, then all cells left open. Cells above ``BLOCK_ROWS`` are
    cut in parts, rows of one part in batches; a task compares a part with a
    batch and returns one row per row. References that fit in one block need no
    pivots.
    """
    keys = [*on, *words]
    if rows <= BLOCK_ROWS:
        whole = {"_pivot": F.lit(0), "_span": F.lit(0)}
        return _compared(left.select(*keys).withColumns({**whole, "_parts": F.lit(1)}), right.withColumns({**whole, "_at": F.lit(0)}),
                         words, on, ref_key, rows)
    count = int(min(PIVOTS, rows // BLOCK_ROWS + 1))
    chosen = right.select(*words).distinct().orderBy(F.xxhash64(F.lit("pivot"), *words), *words).limit(count).collect()  # at most PIVOTS
    if not chosen:
        return left.select(*keys, "distance", F.lit(None).cast(right.schema[ref_key].dataType).alias("nearest")).where("false")
    apart = [hamming_words([F.col(w) for w in words], [F.expr(_long(p[w])) for w in words]) for p in chosen]
    own = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("pivot")) for i, d in enumerate(apart)]))
    span = max(8, len(words) * WORD_BITS // 16)
    placed = right.withColumn("_own", own).select("*", F.col("_own.pivot").alias("_pivot"), F.col("_own.d").alias("_d")).drop("_own")
    placed = placed.withColumn("_span", F.floor(F.col("_d") / span).cast("int"))
    cells = placed.groupBy(*on, "_pivot", "_span").agg(F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_low"), F.max("_d").alias("_high"))
    cells = sized(cells.withColumn("_parts", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int")))[1]
    cut = (placed.join(cells.select(*on, "_pivot", "_span", "_parts"), [*on, "_pivot", "_span"])
           .withColumn("_at", F.pmod(F.xxhash64(*words), F.col("_parts")).cast("int")))
    cut = materialise(cut.select(*keys, ref_key, "_pivot", "_span", "_at"))
    every = F.array(*[d.alias(f"_{i}") for i, d in enumerate(apart)])
    here = F.get("_to", F.col("_pivot"))
    bound = F.greatest(F.lit(0), F.col("_low") - here, here - F.col("_high"))
    cell = F.struct(bound.alias("bound"), F.when(bound == 0, -F.col("_n")).otherwise(0).alias("n"), "_pivot", "_span", "_parts")
    with_to = left.withColumn("_to", every)
    open_cells = (with_to.join(cells, on) if on else with_to.join(cells, F.lit(True))).select(*keys, "distance", cell.alias("c"))
    first = materialise(open_cells.groupBy(*keys).agg(F.min("c").alias("c")))
    found = materialise(_compared(first.select(*keys, "c.*"), cut, words, on, ref_key, rows))
    met = F.struct("c._pivot", "c._span")
    with_to = first.select(*keys, met.alias("_met")).join(by_shuffle(found), keys).select(*keys, "distance", "_met", every.alias("_to"))
    others = (with_to.join(cells, on) if on else with_to.join(cells, F.lit(True))).select(*keys, "distance", "_met", cell.alias("c"))
    rest = others.where((F.col("c.bound") <= F.col("distance")) & (F.col("_met") != met)).select(*keys, "c.*")
    more = _compared(rest, cut, words, on, ref_key, rows)
    both = found.unionByName(more).withColumnRenamed("nearest", ref_key)
    return _least(both, keys, ref_key)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of every row of ``a`` (one column per word) to every column of ``b`` (one row per word)."""
    gap = np.bitwise_count(a[:, 0, None] ^ b[0][None, :])
    if len(b) * WORD_BITS > 255:
        gap = gap.astype(np.uint16)
    for k in range(1, len(b)):
        gap += np.bitwise_count(a[:, k, None] ^ b[k][None, :])
    return gap


def _compared(visits: DataFrame, cut: DataFrame, words: Sequence[str], on: Sequence[str], ref_key: str, rows: int) -> DataFrame:
    """Nearest reference within the cells each row visits; at most ``rows`` rows visit a cell."""
    keys, cell = [*on, *words], [*on, "_pivot", "_span", "_at"]
    asked = visits.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(*keys, "_pivot", "_span", "_at")
    busy, batches = 0, None
    if rows > QUERIES_PER_TASK:
        busy, batches = sized(asked.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > QUERIES_PER_TASK)
                              .select(*cell, F.ceil(F.col("_n") / QUERIES_PER_TASK).cast("int").alias("_batches")))
    if busy:
        most = F.coalesce("_batches", F.lit(1))
        asked = asked.join(batches, cell, "left").withColumn("_batch", F.pmod(F.xxhash64(F.lit("batch"), *words), most).cast("int"))
        cut = cut.join(batches, cell, "left").withColumn("_batch", F.explode(F.sequence(F.lit(0), most - 1)))
    else:
        asked, cut = asked.withColumn("_batch", F.lit(0)), cut.withColumn("_batch", F.lit(0))
    meet = [*cell, "_batch"]
    asked, cut = asked.select(*keys, "_pivot", "_span", "_at", "_batch"), cut.select(*keys, ref_key, "_pivot", "_span", "_at", "_batch")
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "distance int", f"nearest {kinds[ref_key]}"])

    def compare(rows: pd.DataFrame, references: pd.DataFrame) -> pd.DataFrame:
        out = rows[keys].copy()
        if len(rows) == 0 or len(references) == 0:
            return out.iloc[:0].assign(distance=np.zeros(0, np.int32), nearest=references[ref_key].iloc[:0])
        references = references.sort_values(ref_key, kind="stable")
        a = rows[words].to_numpy(np.int64).view(np.uint64)
        b = np.ascontiguousarray(references[words].to_numpy(np.int64).view(np.uint64).T)
        low, at = np.zeros(len(a), np.int32), np.zeros(len(a), np.int64)
        step = max(1, COMPARED_AT_ONCE // b.shape[1])
        for i in range(0, len(a), step):
            gap = _gaps(a[i:i + step], b)
            first = gap.argmin(1)  # the first of the least: references are in key order
            at[i:i + step], low[i:i + step] = first, gap[np.arange(len(gap)), first]
        return out.assign(distance=low, nearest=references[ref_key].to_numpy()[at])

    return asked.groupBy(*meet).cogroup(cut.groupBy(*meet)).applyInPandas(compare, schema)


def median_distance(items: DataFrame, reference: DataFrame, *, words: Sequence[str], rows: int, ref_key: str, by: Sequence[str],
                    on: Sequence[str] = (), out: str = "median_distance", compare_cost: float = COMPARE_COST,
                    round_cost: float = ROUND_COST) -> DataFrame:
    """Median distance to the nearest reference row per group of items.

    An order-statistic search: after every stage of :func:`nearest` the settled
    rows of a group are its nearest ones, so a group is done once they
    reach past its middle row, and only open groups go on. ``on`` compares
    rows with equal values only and must be among ``by``. Rows without a
    fingerprint take no part; a group without any, or without a reference, has a
    null median.
    """
    by, on, words = list(by), list(on), list(words)
    keys = [*on, *words]
    weights = materialise(items.dropna(subset=words).groupBy(*dict.fromkeys([*by, *words])).agg(F.count(F.lit(1)).alias("_w")))
    totals = weights.groupBy(*by).agg(F.sum("_w").alias("_all"))

    def open_groups(settled: DataFrame, still: DataFrame) -> DataFrame:
        known = weights.join(settled.select(*keys), keys, "left_semi").groupBy(*by).agg(F.sum("_w").alias("_known"))
        short = totals.join(known, by, "left").where(F.coalesce("_known", F.lit(0)) < F.floor(F.col("_all") / 2) + 1)
        return still.join(by_shuffle(weights.join(short.select(*by), by, "left_semi").select(*keys)), keys, "left_semi")

    found = nearest(items, reference, words=words, rows=rows, ref_key=ref_key, on=on, need=open_groups, compare_cost=compare_cost,
                    round_cost=round_cost)
    from leaksift.operators.rates import censored_median

    counted = weights.join(found.select(*keys, "distance"), keys, "left")
    medians = censored_median(counted, "distance", by, "_w", out)
    return items.select(*by).distinct().join(medians, by, "left") if by else medians
