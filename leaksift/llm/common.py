"""Helpers shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksift.operators.skew import ROWS_PER_TASK, salted_lookup
from leaksift.session import materialise

WORDS = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return WORDS.findall(text.lower()) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash per word, the same in every process."""
    global _POWERS
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], gaps + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(raw) + 1]])))[:len(raw)]
    top = int(place.max()) + 1
    if top > len(_POWERS):
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(top * 2, _BASE)]).astype(np.uint64))
    values = (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[place]
    values[gaps] = 0
    return mixed(np.add.reduceat(values, starts))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words; fewer words make one run, none makes none."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = out * _BASE + hashes[i:n - size + 1 + i]
    return mixed(out + np.uint64(size))


def sorted_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole runs of equal ``keys`` from sorted batches: rows, and where each run starts.

    A run that goes on in the next batch waits for it, so at most one batch and
    one run are held.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch) == 0:
            continue
        change = np.zeros(len(batch), bool)
        for k in keys:
            v = batch[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        if held and all(held[-1][k].iloc[-1] == batch[k].iloc[0] for k in keys) and len(starts) == 0:
            held.append(batch)
            continue
        cut = int(starts[-1]) if len(starts) else 0
        done = pd.concat([*held, batch.iloc[:cut]], ignore_index=True) if held or cut else None
        held = [batch.iloc[cut:]]
        if done is not None and len(done):
            yield done, _starts(done, keys)
    if held:
        rest = pd.concat(held, ignore_index=True)
        yield rest, _starts(rest, keys)


def _starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    change = np.zeros(len(rows), bool)
    change[0] = True
    for k in keys:
        v = rows[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def least_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least position in every position's component, for the given links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)  # the labels' own nodes move too, so long chains fold quickly
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node`` and ``root`` (least node of its component) for every node of ``edges`` (``a``, ``b``).

    Large-star and small-star steps in turn: every node hangs its larger, then
    its smaller neighbours on the least it knows, until nothing changes. A star
    with very many leaves is split by :func:`salted_lookup`. Each round is
    written to the shared checkpoint folder. Rounds that end unsettled are an
    error: the classes would be wrong.
    """
    links = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def hung(pairs: DataFrame, rows: int) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return salted_lookup(pairs, least, ["u"], ["v"], "inner", rows=rows)

    for _ in range(rounds):
        ends = 2 * links.count()  # counted on what is written: with few links no star can be large, and none is looked for
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = hung(both, ends).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = hung(large, ends)
        new = materialise(small.select(F.col("u").alias("a"), F.col("m").alias("b"))
                          .unionByName(small.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")))
                          .where(F.col("a") != F.col("b")).distinct())
        # Settled when every node hangs on one node that hangs on none.
        many = new.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1)
        deep = new.select(F.col("b").alias("a")).distinct().join(new.select("a").distinct(), "a", "left_semi").limit(1)
        links = new
        if not many.unionByName(deep.select("a", F.lit(0).cast("bigint").alias("n"))).head(1):
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``node`` and ``root`` of all links of one task."""
    left, right = [], []
    for batch in batches:
        left.append(batch["a"].to_numpy())
        right.append(batch["b"].to_numpy())
    if left:
        nodes, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
        half = len(at) // 2
        yield pd.DataFrame({"node": nodes, "root": nodes[least_labels(len(nodes), at[:half], at[half:])]})


def connected(edges: DataFrame, alone: int = ROWS_PER_TASK) -> DataFrame:
    """What :func:`components` gives, in one pass where few links are left.

    The links are written and counted. At most ``alone`` of them (16 bytes
    each) are settled by one task; more go through the rounds. The rows are the
    same either way; few links need no driver work per round.
    """
    links = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if links.count() > alone:
        return components(links)
    return links.coalesce(1).mapInPandas(settled, "node bigint, root bigint")
