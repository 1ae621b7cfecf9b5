"""Hamming joins over fingerprint words.

Pigeonhole: cut the bits into ``radius + r`` blocks; two fingerprints within
``radius`` agree exactly on at least ``r`` of them. Every choice of ``r``
blocks is a band, and a pair within the radius meets in some band, so equi-joins
on (band, masked word) find all pairs and nothing is compared exhaustively.
More blocks mean more band rows but longer, rarer keys; the plan is chosen
from the number of distinct fingerprints.

Larger inputs are not shuffled once per band. A row goes to one group per block
that can be the first one agreed on (``radius + 1`` of them at most, however
long the keys are), and the bands that begin with this block are sorted and met
inside the group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksift.functions.bits import WORD_BITS, hamming, signed
from leaksift.operators.fingerprints import distinct_fingerprints
from leaksift.operators.skew import SCOUT_SHARE, by_shuffle, scout, sized
from leaksift.session import materialise

TILE_ROWS = 20_000
ONE_PASS_ROWS = 200_000
ROW_COST = 20
PATIENCE = 4
GROUP_ROWS = 65_536         # of one side in a group of bands with one first block
GROUP_TILE_ROWS = 262_144   # above these a group is cut into tiles
MOST_GROUP_PARTS = 2_000
MET_AT_ONCE = 1 << 18       # candidates, so that they stay in a cache


@dataclass(frozen=True)
class Band:
    """Masks per word, the blocks they cover, and all blocks up to the last covered one."""

    masks: tuple[int, ...]
    need: int
    scope: int


@dataclass(frozen=True)
class BandPlan:
    blocks: tuple[tuple[int, int], ...]  # (word, mask)
    bands: tuple[Band, ...]


def _blocks(words: Sequence[int], count: int) -> list[tuple[int, int]]:
    """``count`` blocks over the given words; none crosses a word."""
    out = []
    for at, word in enumerate(words):
        share = count // len(words) + (1 if at < count % len(words) else 0)
        edges = [i * WORD_BITS // share for i in range(share + 1)] if share else []
        out += [(word, ((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(edges, edges[1:])]
    return out


def _choices(blocks: Sequence[tuple[int, int]], first: int, agree: int, words: int):
    for chosen in combinations(range(len(blocks)), agree):
        masks = [0] * words
        for b in chosen:
            masks[blocks[b][0]] |= blocks[b][1]
        need = sum(1 << (first + b) for b in chosen)
        scope = sum(1 << (first + b) for b in range(chosen[-1] + 1))
        yield masks, need, scope


def _cost(rows: float, bands: int, key_bits: float) -> float:
    """Candidate checks plus shuffled band rows, each as dear as ``ROW_COST`` checks."""
    return bands * (ROW_COST * 2 * rows + rows * rows / 2.0 ** key_bits)


def _best_shape(words: int, radius: int, rows: float, rule: str) -> tuple[float, int, int, int] | None:
    """Cost, banded words, blocks and blocks per key of the cheapest plan.

    Two fingerprints within the radius are within it on any of their words, so
    keys may be cut from some words and the others only verified. For each
    choice of words keys grow until they have not paid off ``PATIENCE`` times in
    a row.
    """
    best = None
    for used in range(1, words + 1):
        bits = (used if rule == "sum" else 1) * WORD_BITS
        power = 1 if rule == "sum" else used
        worse, least = 0, None
        for extra in range(1, bits - radius + 1):
            count = radius + extra
            if rule == "sum" and count < used:
                continue
            if count * power >= WORD_BITS:
                break  # a pair's agreeing blocks are the bits of one number
            cost = _cost(rows, math.comb(count, extra) ** power, bits * extra / count * power)
            if best is None or cost < best[0]:
                best = (cost, used, count, extra)
            worse = 0 if least is None or cost < least else worse + 1
            least = cost if least is None else min(least, cost)
            if worse >= PATIENCE:
                break
    return best


def plan_cost(words: int, radius: int, rows: int, rule: str = "sum") -> dict[str, float]:
    """What :func:`near_pairs` would do: ``bands``, ``key_bits``, ``band_rows`` and ``candidates`` of one side.

    No plan is cheap where the radius is a large share of the bits: this tells
    before a job is run.
    """
    best = _best_shape(words, radius, rows, rule)
    if best is None:
        raise ValueError(f"radius {radius} leaves no band over {words * WORD_BITS} bits")
    _, used, count, extra = best
    power = 1 if rule == "sum" else used
    bits = (used if rule == "sum" else 1) * WORD_BITS * extra / count * power
    bands = math.comb(count, extra) ** power
    return {"bands": bands, "key_bits": bits, "band_rows": float(bands) * rows, "candidates": bands * float(rows) ** 2 / 2.0 ** bits}


def band_plan(words: int, radius: int, rows: int, rule: str = "sum") -> BandPlan:
    """Cheapest bands for ``rows`` distinct fingerprints of ``words`` words.

    ``sum``: total distance at most ``radius``. ``each``: every word at most
    ``radius``, where each banded word contributes its own blocks to a key.
    """
    best = _best_shape(words, radius, rows, rule)
    if best is None:
        raise ValueError(f"radius {radius} leaves no band over {words * WORD_BITS} bits")
    _, used, count, extra = best
    if rule == "sum":
        blocks = _blocks(range(used), count)
        bands = [Band(tuple(m), need, scope) for m, need, scope in _choices(blocks, 0, extra, words)]
        return BandPlan(tuple(blocks), tuple(bands))
    blocks, per_word = [], []
    for word in range(used):
        own = _blocks([word], count)
        per_word.append(list(_choices(own, len(blocks), extra, words)))
        blocks += own
    bands = []
    for parts in product(*per_word):
        masks = tuple(sum(p[0][w] for p in parts) for w in range(words))
        bands.append(Band(masks, sum(p[1] for p in parts), sum(p[2] for p in parts)))
    return BandPlan(tuple(blocks), tuple(bands))


def _banded(side: DataFrame, words: Sequence[str], plan: BandPlan) -> DataFrame:
    """One row per fingerprint and band, with the masked words as keys."""
    names = ["_band", *[f"_m{k}" for k in range(len(words))]]
    entries = [f"struct({i}, {', '.join(map(_long, b.masks))})" for i, b in enumerate(plan.bands)]
    fields = ", ".join(f"{n}: {'int' if n == '_band' else 'bigint'}" for n in names)
    bands = F.expr(f"array({', '.join(entries)})").cast(f"array<struct<{fields}>>")
    keys = [F.col(w).bitwiseAND(F.col(f"_m{k}")).alias(f"_k{k}") for k, w in enumerate(words)]
    return side.select("*", F.inline(bands)).select(*side.columns, "_band", *keys)


def _long(value: int) -> str:
    """A 64-bit SQL literal (the lowest one cannot be written as digits)."""
    value = signed(value)
    return "shiftleft(1L, 63)" if value == -(1 << 63) else f"{value}L"


def _of_band(values: Sequence[int], band: Column) -> Column:
    """The entry of a constant array that belongs to a band."""
    return F.get(F.expr(f"array({', '.join(map(_long, values))})"), band)


def near_pairs(left: DataFrame, right: DataFrame | None = None, *, words: Sequence[str], radius: int,
               rows: int, rule: str = "sum", on: Sequence[str] = (), tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs of distinct fingerprints within ``radius``, each exactly once.

    ``left`` and ``right`` hold one row per fingerprint (see
    :func:`distinct_fingerprints`); without ``right`` the unordered pairs of
    ``left`` are found. Columns come back with ``_a`` and ``_b`` endings plus
    ``distance`` (total) and ``dist_<word>``. ``on`` adds equality columns.
    ``rows`` is an upper bound on the fingerprints of either side.

    A pair meeting in several bands is kept only by the first of them, decided
    from the pair itself, so no distinct over pairs is needed. Buckets larger
    than ``tile_rows`` are cut into square tiles that are joined in separate
    tasks. Where a plan has several bands per first block, inputs above
    ``tile_rows`` are shuffled per first block only.
    """
    words, on = list(words), list(on)
    plan = band_plan(len(words), radius, rows, rule)
    own = right is None
    if rows > tile_rows and len(plan.bands) >= 2 * len(_by_first_block(plan)):
        return _grouped_pairs(left, right, words, radius, rows, rule, on, plan)
    key = ["_band", *[f"_k{k}" for k in range(len(words))]]
    a = _banded(left, words, plan)
    b = _banded(left if own else right, words, plan)
    join_key = [*on, *key]
    if rows > tile_rows:
        tiles = _tiled(a, b, words, join_key, tile_rows, own)
        if tiles:
            (a, b), join_key = tiles, [*join_key, "_ta", "_tb"]
    a = a.select(*[F.col(c).alias(f"{c}_a") for c in [*left.columns, *join_key[len(on):]]])
    b = b.select(*[F.col(c).alias(f"{c}_b")
                   for c in [*(left if own else right).columns, *join_key[len(on):]]])
    meet = F.lit(True)
    for c in join_key:
        meet = meet & (F.col(f"{c}_a") == F.col(f"{c}_b"))
    joined = by_shuffle(a).join(b, meet)

    per_word = [hamming(F.col(f"{w}_a"), F.col(f"{w}_b")) for w in words]
    total = sum(per_word[1:], per_word[0])
    close = total <= radius
    if rule == "each":
        close = per_word[0] <= radius
        for d in per_word[1:]:
            close = close & (d <= radius)
    if own:
        close = close & (F.struct(*[f"{w}_a" for w in words]) < F.struct(*[f"{w}_b" for w in words]))
    agree = None
    for i, (word, mask) in enumerate(plan.blocks):
        differs = F.col(f"{words[word]}_a").bitwiseXOR(F.col(f"{words[word]}_b"))
        bit = F.when(differs.bitwiseAND(F.lit(signed(mask)).cast("bigint")) == 0,
                     F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        agree = bit if agree is None else agree.bitwiseOR(bit)
    band = F.col("_band_a")
    first_band = agree.bitwiseAND(_of_band([x.scope for x in plan.bands], band)) == _of_band(
        [x.need for x in plan.bands], band)
    keep = [f"{c}_a" for c in left.columns] + [f"{c}_b" for c in (left if own else right).columns]
    return joined.where(close).where(first_band).select(
        *keep, *[d.alias(f"dist_{w}") for d, w in zip(per_word, words)], total.alias("distance"))


def _by_first_block(plan: BandPlan) -> dict[int, list[Band]]:
    """The bands by the first block they need."""
    out: dict[int, list[Band]] = {}
    for band in plan.bands:
        out.setdefault((band.need & -band.need).bit_length() - 1, []).append(band)
    return out


def _grouped_pairs(left: DataFrame, right: DataFrame | None, words: list[str], radius: int, rows: int, rule: str,
                   on: list[str], plan: BandPlan) -> DataFrame:
    """The pairs of :func:`near_pairs` with one shuffled row per fingerprint and first block.

    Rows with the same value of a block lie in one of ``rows / GROUP_ROWS``
    groups of this block; larger groups are cut into tiles. A task sorts a
    group by the key of one band at a time and holds no more than
    ``MET_AT_ONCE`` candidates besides the pairs it has found.
    """
    own, firsts = right is None, _by_first_block(plan)
    buckets = -(-rows // GROUP_ROWS)
    entries = []
    for first in firsts:
        word, mask = plan.blocks[first]
        entries.append(f"struct({first} AS _first, cast(pmod(xxhash64({first}, `{words[word]}` & {_long(mask)}"
                       f"{''.join(f', `{c}`' for c in on)}), {buckets}) as int) AS _bucket)")

    def dealt(side: DataFrame) -> DataFrame:
        hashed = side.withColumn("_on", F.xxhash64(*on)) if on else side
        return hashed.dropna(subset=[*on, *words]).select("*", F.inline(F.expr(f"array({', '.join(entries)})")))

    a, key = dealt(left), ["_first", "_bucket"]
    b = a if own else dealt(right)
    tiles = _tiled(a, b, words, key, GROUP_TILE_ROWS, own) if rows > GROUP_TILE_ROWS else None
    if tiles:
        (a, b), key = tiles, [*key, "_ta", "_tb"]
    mine, other = left.columns, (left if own else right).columns
    schema = ", ".join([*[f"`{c}_a` {kind}" for c, kind in left.dtypes], *[f"`{c}_b` {kind}" for c, kind in (left if own else right).dtypes],
                        *[f"`dist_{w}` int" for w in words], "distance int"])

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        bands = firsts[int(x["_first"].iloc[0])] if len(x) and len(y) else []
        at, to, gaps = _met_in_bands(x, y, words, on, radius, rule, plan, bands)
        if own:  # a pair is met in one order without tiles, in both with them
            p, q = ([z[w].to_numpy(np.int64)[i] for w in words] for z, i in ((x, at), (y, to)))
            less, same = np.zeros(len(at), bool), np.ones(len(at), bool)
            for u, v in zip(p, q):
                less, same = less | (same & (u < v)), same & (u == v)
            if x is y:
                at, to = np.where(less, at, to), np.where(less, to, at)
            else:
                at, to, gaps = at[less], to[less], gaps[:, less]
        sides = (x[mine].iloc[at].add_suffix("_a").reset_index(drop=True), y[other].iloc[to].add_suffix("_b").reset_index(drop=True))
        found = pd.DataFrame({**{f"dist_{w}": g for w, g in zip(words, gaps)}, "distance": gaps.sum(0, dtype=np.int32)})
        return pd.concat([*sides, found], axis=1)

    parts = min(MOST_GROUP_PARTS, len(firsts) * buckets)  # given, as small rows here are long work
    a = a.repartition(parts, *key).groupBy(*key)
    if own and not tiles:
        return a.applyInPandas(lambda x: meet(x, x), schema)
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # both sides may come from one table
    return a.cogroup(b.repartition(parts, *key).groupBy(*key)).applyInPandas(meet, schema)


def _met_in_bands(x: pd.DataFrame, y: pd.DataFrame, words: Sequence[str], on: Sequence[str], radius: int, rule: str, plan: BandPlan,
                  bands: Sequence[Band]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and distances per word of the close rows whose first band is one of ``bands``; once each if ``x`` is ``y``."""
    p, q = ([z[w].to_numpy(np.int64).view(np.uint64) for w in words] for z in (x, y))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((len(words), 0), np.int32))]

    def keyed(z: pd.DataFrame, values: Sequence[np.ndarray], band: Band) -> np.ndarray:
        key = np.zeros(len(z), np.uint64)
        for v, mask in zip(values, band.masks):
            if mask:
                key = key * np.uint64(0x9E3779B97F4A7C15) + (v & np.uint64(mask))
        return key * np.uint64(0x9E3779B97F4A7C15) + z["_on"].to_numpy(np.int64).view(np.uint64) if on else key

    for band in bands:
        key_x = keyed(x, p, band)
        order_x = np.argsort(key_x)
        key_x = key_x[order_x]
        if x is y:
            order_y, low, high = order_x, np.arange(1, len(x) + 1), np.searchsorted(key_x, key_x, "right")
        else:
            key_y = keyed(y, q, band)
            order_y = np.argsort(key_y)
            low, high = (np.searchsorted(key_y[order_y], key_x, side) for side in ("left", "right"))
        lead_x, lead_y = p[0][order_x], q[0][order_y]
        sizes = high - low
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + MET_AT_ONCE, "right")))
            n, upto = sizes[start:stop], ends[start:stop] - before
            shift = low[start:stop] - (upto - n)
            place = np.arange(upto[-1]) + np.repeat(shift, n)
            near = np.flatnonzero(np.bitwise_count(np.repeat(lead_x[start:stop], n) ^ lead_y[place]) <= radius)
            if len(near):
                at, to = order_x[start + np.searchsorted(upto, near, "right")], order_y[place[near]]
                found.append(_first_met(x, y, p, q, at, to, on, radius, rule, plan, band))
            start = stop
    return tuple(np.concatenate(part, -1) for part in zip(*found))


def _first_met(x, y, p, q, at, to, on, radius, rule, plan, band) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the met rows that are within the radius in all words, equal in ``on`` and meet in no earlier band."""
    apart = [u[at] ^ v[to] for u, v in zip(p, q)]
    gaps = np.stack([np.bitwise_count(d).astype(np.int32) for d in apart])
    keep = (gaps.max(0) if rule == "each" else gaps.sum(0)) <= radius
    for c in on:
        keep &= x[c].to_numpy()[at] == y[c].to_numpy()[to]
    agree = np.zeros(len(at), np.int64)
    for i, (word, mask) in enumerate(plan.blocks):
        agree |= np.where(apart[word] & np.uint64(mask) == 0, np.int64(1 << i), np.int64(0))
    keep &= agree & np.int64(band.scope) == np.int64(band.need)
    return at[keep], to[keep], gaps[:, keep]


def _tiled(a: DataFrame, b: DataFrame, words: Sequence[str], key: list[str], tile_rows: int,
           own: bool) -> tuple[DataFrame, DataFrame] | None:
    """Cut buckets above ``tile_rows`` on either side into tiles ``_ta`` x ``_tb``; None without such buckets.

    Large buckets are found on a 64th of the fingerprints, so looking for them
    shuffles little, and are counted before their table is broadcast.
    """
    def sizes(side: DataFrame, name: str) -> DataFrame:
        estimate = (F.count(F.lit(1)) * SCOUT_SHARE).alias(name)
        return scout(side, words).groupBy(*key).agg(estimate).where(F.col(name) > tile_rows)

    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(c), F.lit(0)) / tile_rows)).cast("int")
    if own:
        large = sizes(a, "_na").withColumn("_nb", F.col("_na"))
    else:
        large = sizes(a, "_na").join(sizes(b, "_nb"), key, "full")
    found, large = sized(large.select(*key, parts("_na").alias("_pa"), parts("_nb").alias("_pb")))
    if not found:
        return None

    def tile(side: DataFrame, mine: str, other: str, out_mine: str, out_other: str) -> DataFrame:
        spread = F.pmod(F.xxhash64(*words), F.coalesce(F.col(mine), F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        return (side.join(large, key, "left").withColumn(out_mine, spread)
                .withColumn(out_other, every).drop("_pa", "_pb"))

    return tile(a, "_pa", "_pb", "_ta", "_tb"), tile(b, "_pb", "_pa", "_tb", "_ta")


def _radii(radius: int, rows: int) -> list[int]:
    """Radii to search in turn: small inputs at once, large ones exact matches first."""
    return [radius] if rows <= ONE_PASS_ROWS else sorted({0, radius // 3, radius})


def _by_radius(left: DataFrame, keys: Sequence[str], radii: Sequence[int], search) -> DataFrame:
    """``search(rows, radius)`` over growing radii, each only for rows the earlier ones left open.

    In a large cluster of near copies nearly every row has a partner very close
    by and is settled with long, rare keys; only the rest meets the many short
    keys of the full radius. What is found has up to a row per fingerprint, so
    it is joined by shuffle, here and by whoever gets it.
    """
    found = None
    for step in radii:
        hits = search(left, step)
        if step != radii[-1]:
            hits = materialise(hits)
            left = materialise(left.join(by_shuffle(hits), list(keys), "left_anti"))
        found = hits if found is None else found.unionByName(hits)
    return by_shuffle(found)


def nearest_within(items: DataFrame, reference: DataFrame, *, words: Sequence[str], radius: int, rows: int,
                   ref_key: str, rule: str = "sum", on: Sequence[str] = ()) -> DataFrame:
    """Smallest distance and first nearest reference key per distinct item fingerprint.

    Exact for every fingerprint with a neighbour inside ``radius``; the others
    are absent, which means "farther than ``radius``". Ties go to the smallest
    reference key. A fingerprint settled at a smaller radius has no nearer
    neighbour, as all within that radius were met.
    """
    keys = [*on, *words]
    left = distinct_fingerprints(items, words, by=on).drop("n")
    right = distinct_fingerprints(reference, words, first=ref_key, by=on).drop("n")

    def search(open_rows: DataFrame, step: int) -> DataFrame:
        pairs = near_pairs(open_rows, right, words=words, radius=step, rows=rows, rule=rule, on=on)
        nearest = F.min_by(f"{ref_key}_b", F.struct("distance", f"{ref_key}_b"))
        return (pairs.groupBy(*[F.col(f"{c}_a").alias(c) for c in keys])
                .agg(F.min("distance").alias("distance"), nearest.alias("nearest")))

    radii = _radii(radius, rows) if rule == "sum" else [radius]
    return _by_radius(left, keys, radii, search)


def flag_independent(items: DataFrame, reference: DataFrame, *, words: Sequence[str], radius: int,
                     rows: int, ref_key: str, on: Sequence[str] = ()) -> DataFrame:
    """Distinct item fingerprints whose every word has some reference row within ``radius``.

    The rows may differ from word to word.
    """
    flagged = distinct_fingerprints(items, words, by=on).drop("n")
    for word in words:
        near = nearest_within(items, reference, words=[word], radius=radius, rows=rows,
                              ref_key=ref_key, on=on)
        flagged = flagged.join(near.select(*on, word, F.col("distance").alias(f"dist_{word}")), [*on, word])
    return by_shuffle(flagged)


def flag_same_row(items: DataFrame, reference: DataFrame, *, words: Sequence[str], radius: int,
                  rows: int, on: Sequence[str] = ()) -> DataFrame:
    """Distinct item fingerprints with one reference row within ``radius`` in every word."""
    return _flag(items, reference, words, radius, rows, "each", on)


def flag_additive(items: DataFrame, reference: DataFrame, *, words: Sequence[str], radius: int,
                  rows: int, on: Sequence[str] = ()) -> DataFrame:
    """Distinct item fingerprints with one reference row at total distance within ``radius``."""
    return _flag(items, reference, words, radius, rows, "sum", on)


def _flag(items, reference, words, radius, rows, rule, on) -> DataFrame:
    keys = [*on, *words]
    left = distinct_fingerprints(items, words, by=on).drop("n")
    right = distinct_fingerprints(reference, words, by=on).drop("n")

    def search(open_rows: DataFrame, step: int) -> DataFrame:
        pairs = near_pairs(open_rows, right, words=words, radius=step, rows=rows, rule=rule, on=on)
        return pairs.select(*[F.col(f"{c}_a").alias(c) for c in keys]).distinct()

    return _by_radius(left, keys, _radii(radius, rows), search)


FLAG_MODES = {"independent": flag_independent, "same_row": flag_same_row, "additive": flag_additive}


def flagged_fingerprints(items: DataFrame, reference: DataFrame, mode: str, *, words: Sequence[str],
                         radius: int, rows: int, ref_key: str, on: Sequence[str] = ()) -> DataFrame:
    """One of three readings of "both distances within the radius"; there is no default.

    ``independent``, ``same_row`` and ``additive`` give different rows.
    """
    if mode not in FLAG_MODES:
        raise ValueError(f"mode must be one of {sorted(FLAG_MODES)}")
    extra = {"ref_key": ref_key} if mode == "independent" else {}
    found = FLAG_MODES[mode](items, reference, words=words, radius=radius, rows=rows, on=on, **extra)
    return found.select(*on, *words)


def random_non_matches(matches: DataFrame, reference: DataFrame, n: int, *, item: str, matched: str,
                       ref_key: str, seed: str = "non-match") -> DataFrame:
    """``n`` seeded (item, reference) pairs, none of them the item's own match.

    Items are drawn with replacement. A drawn reference equal to the match
    moves to the next one in digest order.
    """
    from leaksift.functions.digest import draw_index
    from leaksift.operators.skew import hash_rank

    numbered_items = hash_rank(matches.select(item, matched), [item], seed=seed, out="_i")
    numbered_refs = hash_rank(reference.select(ref_key).distinct(), [ref_key], seed=seed, out="_r")
    totals = (numbered_items.agg(F.count(F.lit(1)).alias("_ni"))
              .join(numbered_refs.agg(F.count(F.lit(1)).alias("_nr")), F.lit(True)))
    spark = matches.sparkSession
    draws = (spark.range(n).withColumnRenamed("id", "draw").join(totals, F.lit(True))
             .select("draw", "_nr",
                     (draw_index(F.col("_ni"), F.lit(f"{seed}:item"), F.col("draw")) + 1).alias("_i"),
                     draw_index(F.col("_nr"), F.lit(f"{seed}:ref"), F.col("draw")).alias("_at")))
    picked = draws.join(numbered_items, "_i")
    options = picked.select("draw", item, matched, F.posexplode(F.array(
        F.col("_at") + 1, F.pmod(F.col("_at") + 1, F.col("_nr")) + 1)).alias("_try", "_r"))
    named = options.join(numbered_refs, "_r").where(~F.col(ref_key).eqNullSafe(F.col(matched)))
    best = F.min_by(F.struct(item, ref_key), F.col("_try")).alias("_pick")
    return named.groupBy("draw").agg(best).select("draw", "_pick.*")


def pair_scores(pairs: DataFrame, vectors: DataFrame, *, left: str, right: str, key: str,
                unit: str = "unit") -> DataFrame:
    """Attach both prepared vectors to each pair and score it.

    ``vectors`` holds ``key`` and ``unit`` (centred unit vectors give the
    correlation, unit vectors the cosine). Pairs without both vectors are
    dropped, as a failed verification is. Vectors are joined, not collected, and
    their length is returned with the score.
    """
    from leaksift.functions.vectors import dot
    from leaksift.operators.skew import salted_lookup

    a = vectors.select(F.col(key).alias(left), F.col(unit).alias("_ua"))
    b = vectors.select(F.col(key).alias(right), F.col(unit).alias("_ub"))
    # A row that many pairs name has its vector joined in parts; either side may hold such a row.
    with_left = salted_lookup(pairs, a, [left], [right], "inner")
    return (salted_lookup(with_left, b, [right], [left], "inner")
            .withColumn("score", dot(F.col("_ua"), F.col("_ub")))
            .withColumn("vector_length", F.size("_ua")).drop("_ua", "_ub"))
