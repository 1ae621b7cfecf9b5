"""Scores of every team in every resample or random subset of the items.

How often a replicate draws an item is kept per item, as bit planes: plane
``p`` holds bit ``p`` of the counts of all replicates, so a subset is one
bitmap and a resample about three. No row per (item, replicate) exists.

Scores come from one pass over the rows sorted by (team, class, score): a task
adds the counts of all replicates at once and returns, per team and class, what
its first value, its last value and the rows between hold. These segments add
up in the order of scores, so one class, or one very common score, may be
spread over any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksift.functions.counters import PRIME, drawn, split_counts
from leaksift.operators.metrics import mean_auc
from leaksift.operators.skew import hash_rank
from leaksift.session import materialise

BLOCK_ITEMS = 8_192
DRAWN_AT_ONCE = 64
CUT_SLACK = 8.0  # of the window a subset's last item is sought in, in usual deviations
CHUNK_ROWS = 1_024


def packed(counts: np.ndarray) -> list[bytes]:
    """Bit planes of each row's counts, the lowest bit first."""
    planes = max(1, int(counts.max(initial=0)).bit_length())
    rows = np.hstack([np.packbits((counts >> p & 1).astype(np.uint8), axis=1) for p in range(planes)])
    return [row.tobytes() for row in rows]


def unpacked(draws: Sequence[bytes], reps: int) -> np.ndarray:
    """Counts, one row per item and one column per replicate."""
    width = -(-reps // 8)
    planes = max(len(d) for d in draws) // width
    held = np.frombuffer(b"".join(d.ljust(planes * width, b"\0") for d in draws), np.uint8).reshape(len(draws), planes, width)
    counts = np.zeros((len(draws), reps), np.int64)
    for p in range(planes):
        counts += np.unpackbits(held[:, p], axis=1, count=reps).astype(np.int64) << p
    return counts


def _blocks(size: int, most: int) -> np.ndarray:
    sizes = np.full(-(-size // most), most, np.int64)
    sizes[-1] = size - most * (len(sizes) - 1)
    return sizes


def _resampled(seed: str, reps: int, most: int, size: int, block: int, n: int) -> np.ndarray:
    counts = split_counts(seed, np.arange(reps), _blocks(size, most), size, block)
    out = np.empty((n, reps), np.int64)
    for lo in range(0, reps, DRAWN_AT_ONCE):
        part = np.arange(lo, min(reps, lo + DRAWN_AT_ONCE))
        index = drawn(seed, part, np.arange(counts[part].max(initial=0)), block) % n
        for r, row in zip(part, index):
            out[:, r] = np.bincount(row[:counts[r]], minlength=n)
    return out


def _places(seed: str, trials: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """Where every item stands in the order of its draws, one row per trial; equal draws stand in digest order."""
    return drawn(seed, trials, rows["_counter"].to_numpy(np.int64)) << 32 | rows["_at"].to_numpy(np.int64)


def _window(size: int, quota: int, slack: float) -> tuple[int, int]:
    """Places between which the ``quota``-th of ``size`` uniform draws lies, but for a deviation above about ``slack`` times the usual."""
    off = slack * (np.sqrt(max(quota, 0)) + 4)
    return tuple(int(min(max((quota + d) / size, 0.0), 1.0) * PRIME) << 32 for d in (-off, off))


def _near_cut(seed: str, trials: int, by: Sequence[str], slack: float, rows: pd.DataFrame) -> pd.DataFrame:
    """Per trial how many of a block's items stand before the window around the cut, and the places inside it."""
    low, high = _window(int(rows["_size"].iloc[0]), int(rows["_quota"].iloc[0]), slack)
    before, inside = [], []
    for lo in range(0, trials, DRAWN_AT_ONCE):
        places = _places(seed, np.arange(lo, min(trials, lo + DRAWN_AT_ONCE)), rows)
        before += (places < low).sum(1).tolist()
        inside += [row[(row >= low) & (row < high)] for row in places]
    return pd.DataFrame({**{c: [rows[c].iloc[0]] * trials for c in by}, "_trial": np.arange(trials), "_before": before, "_inside": inside})


def _cuts(placed: DataFrame, seed: str, trials: int, by: Sequence[str]) -> DataFrame:
    """``by`` and ``_cuts``: the place of the last item of every trial's subset.

    Only places near the expected cut leave a task, about sixteen times the
    root of the quota per trial. Should a cut lie elsewhere, the search is made
    again with wider windows, up to all places.
    """
    kinds, slack = dict(placed.dtypes), CUT_SLACK
    while True:
        found = placed.groupBy(*by, "_block").applyInPandas(
            lambda rows: _near_cut(seed, trials, by, slack, rows),  # noqa: B023
            ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "_trial int, _before bigint, _inside array<bigint>"]))
        merged = found.groupBy(*by, "_trial").agg(F.sum("_before").alias("_before"), F.sort_array(F.flatten(F.collect_list("_inside"))).alias("_inside"))
        goals = placed.select(*by, "_quota").distinct()
        nth = F.col("_quota") - F.col("_before")
        cut = F.when(nth >= 1, F.get("_inside", (nth - 1).cast("int")))
        cuts = materialise(merged.join(goals, list(by) or F.lit(True)).select(*by, "_trial", cut.alias("_cut")))
        if slack > 1 << 32 or cuts.where(F.col("_cut").isNull()).isEmpty():
            ordered = F.sort_array(F.collect_list(F.struct("_trial", "_cut")))
            return cuts.groupBy(*by).agg(F.transform(ordered, lambda x: x["_cut"]).alias("_cuts"))
        slack *= 256


def _subsets(seed: str, trials: int, rows: pd.DataFrame) -> np.ndarray:
    cuts = np.asarray(rows["_cuts"].iloc[0], np.int64)
    out = np.empty((len(rows), trials), np.int64)
    for lo in range(0, trials, DRAWN_AT_ONCE):
        part = np.arange(lo, min(trials, lo + DRAWN_AT_ONCE))
        out[:, part] = (_places(seed, part, rows) <= cuts[part, None]).T
    return out


def _drawn_items(placed: DataFrame, key: str, by: Sequence[str], most: int, counts) -> DataFrame:
    """``key`` and ``draws``; a task takes one block of items and all replicates."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        return pd.DataFrame({key: rows[key], "draws": packed(counts(rows))})

    block = F.expr(f"cast((_at - 1) div {most} as int)")
    return placed.withColumn("_block", block).groupBy(*by, "_block").applyInPandas(one, f"`{key}` {dict(placed.dtypes)[key]}, draws binary")


def resample_weights(items: DataFrame, key: str, reps: int, seed: str = "boot", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``key`` and ``draws``: how often each item is drawn in each of ``reps`` resamples of all items.

    Items are numbered in digest order and cut into blocks. A binomial splitting
    tree says how many draws of a replicate fall into a block, counter-based
    draws inside the block say on which items.
    """
    sizes = items.agg(F.count(F.lit(1)).alias("_size"))
    placed = hash_rank(items.select(key), [key], (), seed, "_at").join(sizes, F.lit(True))
    return _drawn_items(placed, key, (), block_items, lambda rows: _resampled(
        seed, reps, block_items, int(rows["_size"].iloc[0]), int(rows["_block"].iloc[0]), len(rows)))


def random_memberships(items: DataFrame, key: str, trials: int, seed: str = "null", size: int | None = None,
                       targets: DataFrame | None = None, by: Sequence[str] = (), block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``key`` and ``draws``: which of ``trials`` seeded subsets hold an item.

    Every subset has exactly ``size`` items, or ``target`` items per class of
    ``targets`` (all, where there are fewer): the ones with the least
    counter-based draws of all the class, however many blocks it has, the
    counter being a digest of the item. A class of four thousand million items
    or more is an error. Classes that ``targets`` does not name take no part.
    """
    by = list(by)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    numbered = hash_rank(items.select(key, *by), [key], by, seed, "_at").withColumn(
        "_counter", F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint"))
    sizes = items.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    goals = sizes.withColumn("_quota", F.lit(size)) if targets is None else sizes.join(
        targets.select(*by, F.col("target").alias("_quota")), by or F.lit(True))
    goals = goals.withColumn("_quota", F.least("_quota", "_size").cast("bigint")).where(F.col("_quota") > 0)
    goals = goals.withColumn("_size", F.when(F.col("_size") < 1 << 32, F.col("_size")).otherwise(F.raise_error(F.lit("a class is too large"))))
    block = F.expr(f"cast((_at - 1) div {block_items} as int)")
    placed = materialise(numbered.join(goals, by or F.lit(True)).withColumn("_block", block))
    cuts = _cuts(placed, seed, trials, by)
    return _drawn_items(placed.join(cuts, by or F.lit(True)), key, by, block_items, lambda rows: _subsets(seed, trials, rows))


class Area:
    """Positives, negatives and twice the ROC area of rows in the order of scores, per replicate.

    The first and the last value are kept apart, since rows with the same value
    may follow in another task. Sums are integers, so their order is free.
    """

    def __init__(self, reps: int):
        self.first = self.last = None
        self.inner = np.zeros((3, reps), np.int64)
        self.lowest = None
        self.hits = np.zeros(reps, np.int64)

    def _absorb(self, value: float, pos: np.ndarray, neg: np.ndarray, area: np.ndarray) -> None:
        self.lowest = value if self.lowest is None else self.lowest
        self.inner[2] += area + 2 * pos * self.inner[1]
        self.inner[0] += pos
        self.inner[1] += neg

    def run(self, value: float, pos: np.ndarray, neg: np.ndarray) -> None:
        """Rows of one value."""
        top = self.last or self.first
        if top is not None and top[0] == value:
            top[1], top[2] = top[1] + pos, top[2] + neg
        elif self.first is None:
            self.first = [value, pos, neg]
        else:
            self.close()
            self.last = [value, pos, neg]

    def close(self) -> None:
        if self.last is not None:
            value, pos, neg = self.last
            self._absorb(value, pos, neg, pos * neg)
            self.last = None

    def between(self, value: float, pos: np.ndarray, neg: np.ndarray, area: np.ndarray) -> None:
        """Rows of values above all earlier and below all later ones, the least being ``value``."""
        self.close()
        self._absorb(value, pos, neg, area)

    def rows(self, value: np.ndarray, positive: np.ndarray, counts: np.ndarray) -> None:
        """Sorted rows."""
        pos, neg = counts * positive[:, None], counts * ~positive[:, None]
        starts = np.append(0, np.flatnonzero(value[1:] != value[:-1]) + 1)
        ends = np.append(starts[1:], len(value))
        self.run(value[0], pos[:ends[0]].sum(0), neg[:ends[0]].sum(0))
        if len(starts) > 2:
            lo, hi = starts[1], starts[-1]
            below = np.vstack([np.zeros(counts.shape[1], np.int64), np.cumsum(neg[lo:hi], axis=0)])
            at = np.flatnonzero(positive[lo:hi])
            of = np.searchsorted(starts, at + lo, side="right") - 1
            area = np.einsum("ir,ir->r", pos[lo + at], below[starts[of] - lo] + below[ends[of] - lo])
            self.between(value[lo], pos[lo:hi].sum(0), below[-1], area)
        if len(starts) > 1:
            self.run(value[-1], pos[starts[-1]:].sum(0), neg[starts[-1]:].sum(0))

    def segments(self) -> list[tuple]:
        """Up to three rows: least value, whether it is the only one, positives, negatives, twice the area, hits."""
        nothing = np.zeros_like(self.hits)
        out = [(self.first[0], True, self.first[1], self.first[2], nothing, self.hits)]
        if self.lowest is not None:
            out.append((self.lowest, False, *self.inner, nothing))
        if self.last is not None:
            out.append((self.last[0], True, self.last[1], self.last[2], nothing, nothing))
        return out


def _segments(batches: Iterator[pd.DataFrame], team: str, reps: int, chunk: int) -> Iterator[pd.DataFrame]:
    names = [team, "label", "low", "single", "pos", "neg", "area", "hits"]
    open_key, area = None, None
    for batch in batches:
        keys = list(zip(batch[team], batch["label"]))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if area is None or keys[lo] != open_key:
                if area is not None:
                    yield pd.DataFrame([(*open_key, *s) for s in area.segments()], columns=names)
                open_key, area = keys[lo], Area(reps)
            for at in range(lo, hi, chunk):
                part = batch.iloc[at:min(hi, at + chunk)]
                counts = unpacked(list(part["draws"]), reps)
                area.rows(part["score"].to_numpy(np.float64), part["_is"].to_numpy(bool), counts)
                area.hits = area.hits + counts[part["_hit"].to_numpy(bool)].sum(0)
    if area is not None:
        yield pd.DataFrame([(*open_key, *s) for s in area.segments()], columns=names)


def replicate_scores(scored: DataFrame, draws: DataFrame, reps: int, key: str, team: str, absent: str = "zero",
                     chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rep``, ``team`` and ``combined`` (mean of mean class AUC and balanced accuracy) of every replicate.

    ``scored`` has the true class ``y`` (a position in ``scores``), ``pred`` and
    ``scores``. Rows whose key ``draws`` does not name, or without scores, take
    no part. ``absent`` says what a class with one label value counts.
    """
    kind = dict(scored.dtypes)[team]
    rows = scored.select(key, team, "y", "pred", "scores").join(materialise(draws), key)
    long = rows.select(key, team, "draws", "y", "pred", F.posexplode("scores").alias("label", "score")).where(F.col("score").isNotNull())
    # The key as a last order lets rows of one common score lie in several tasks.
    ranged = long.select(key, team, "label", "score", "draws", (F.col("y") == F.col("label")).alias("_is"),
                         ((F.col("y") == F.col("label")) & (F.col("pred") == F.col("y"))).alias("_hit")).fillna(False, ["_is", "_hit"])
    ranged = ranged.repartitionByRange(team, "label", "score", key).sortWithinPartitions(team, "label", "score")
    arrays = "pos array<bigint>, neg array<bigint>, area array<bigint>, hits array<bigint>"
    segments = ranged.mapInPandas(lambda b: _segments(b, team, reps, chunk_rows), f"`{team}` {kind}, label int, low double, single boolean, {arrays}")

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        area = Area(reps)
        for _, s in parts.sort_values("low", kind="stable").iterrows():
            pos, neg = np.array(s["pos"]), np.array(s["neg"])
            area.run(s["low"], pos, neg) if s["single"] else area.between(s["low"], pos, neg, np.array(s["area"]))
            area.hits = area.hits + np.array(s["hits"])
        total = Area(reps)
        for low, single, pos, neg, twice, _ in area.segments():
            total._absorb(low, pos, neg, pos * neg if single else twice)
        pos, neg, twice = total.inner.astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            auc, recall = twice / 2 / (pos * neg), area.hits / pos
        return pd.DataFrame({team: [parts[team].iloc[0]], "label": [parts["label"].iloc[0]], "auc": [auc], "recall": [recall]})

    curves = segments.groupBy(team, "label").applyInPandas(joined, f"`{team}` {kind}, label int, auc array<double>, recall array<double>")
    flat = curves.select(team, "label", F.posexplode(F.arrays_zip("auc", "recall")).alias("rep", "_v")).select(
        "rep", team, "label", *[F.when(~F.isnan(F.col(f"_v.{c}")), F.col(f"_v.{c}")).alias(c) for c in ("auc", "recall")])
    # No item drawn: the team has no score in that replicate.
    balanced = flat.groupBy("rep", team).agg(F.avg("recall").alias("_balanced")).where(F.col("_balanced").isNotNull())
    return balanced.join(mean_auc(flat, ["rep", team], absent), ["rep", team]).select(
        "rep", team, ((F.col("mean_auc") + F.col("_balanced")) / 2).alias("combined"))
