"""Approximate nearest neighbours by collision-counting hashing.

Unit vectors are projected on single random directions; each direction is one
hash function, kept as a sorted array. A query's window on every array is
centred on its own projection and grows by virtual rehashing: a larger radius
widens the windows, and only what they newly cover is counted. Vectors that
fall into enough windows are verified by the exact cosine in double precision.
A query stops when its k-th best verified distance lies within the radius, for
which any nearer vector has reached the collision threshold with high
probability.

Queries and vectors meet in blocks of bounded size: a task holds the sorted
arrays of one block of vectors and answers one block of queries from it; the
blocks' best are then merged. Nothing passes through the driver but counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = 48
WIDTH = 2.7
THRESHOLD = 35  # collisions of a vector at exactly the radius: 39.5 on average, 35 or more in 96 % of cases
FIRST_RADIUS = 0.3
GROWTH = 1.2
VECTORS_PER_BLOCK = 65536
QUERIES_PER_BLOCK = 16384
QUERIES_AT_ONCE = 128
HUGE = 1e140


def _norms(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their lengths; rows whose squares would leave the range of a double are scaled first."""
    top = np.abs(vectors).max(1, keepdims=True)
    vectors = np.where((top > HUGE) | (top < 1 / HUGE), vectors / top, vectors)
    return vectors, np.sqrt((vectors * vectors).sum(1))


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int,
                 seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query position, vector position and cosine of the best ``k`` vectors found per query."""
    queries, q_norm = _norms(queries)
    vectors, v_norm = _norms(vectors)
    axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], DIRECTIONS))
    shadow = (vectors / v_norm[:, None]) @ axes
    order = np.argsort(shadow, axis=0, kind="stable").T.astype(np.int32).copy()
    arrays = np.take_along_axis(shadow.T, order, 1)
    aims = (queries / q_norm[:, None]) @ axes
    found = [_expand(queries[lo:lo + QUERIES_AT_ONCE], query_ids[lo:lo + QUERIES_AT_ONCE], q_norm[lo:lo + QUERIES_AT_ONCE],
                     aims[lo:lo + QUERIES_AT_ONCE], vectors, ids, v_norm, order, arrays, k)
             for lo in range(0, len(query_ids), QUERIES_AT_ONCE)]
    best = [b for part in found for b in part]
    sizes = [len(b[0]) for b in best]
    return (np.repeat(np.arange(len(best)), sizes), np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best]))


def _expand(queries, query_ids, q_norm, aims, vectors, ids, v_norm, order, arrays, k) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grow the windows of a few queries, radius by radius, until each has its ``k`` vectors."""
    n, n_queries = len(ids), len(query_ids)
    counts = np.zeros((n_queries, n), np.uint8)
    checked = np.zeros((n_queries, n), bool)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * n_queries
    low = np.stack([np.searchsorted(arrays[j], aims[:, j]) for j in range(DIRECTIONS)], 1)
    high = low.copy()
    active, radius = np.arange(n_queries), FIRST_RADIUS
    while len(active):
        final = radius >= 2.0  # two unit vectors are never farther apart: whatever is left is verified as it is
        half = WIDTH * radius / 2
        to_low = np.stack([np.searchsorted(arrays[j], aims[active, j] - half) for j in range(DIRECTIONS)], 1)
        to_high = np.stack([np.searchsorted(arrays[j], aims[active, j] + half, "right") for j in range(DIRECTIONS)], 1)
        going = []
        for at, q in enumerate(active):
            if not final:
                new = ([order[j, a:b] for j, (a, b) in enumerate(zip(to_low[at], low[q])) if a < b]
                       + [order[j, a:b] for j, (a, b) in enumerate(zip(high[q], to_high[at])) if a < b])
                if new:
                    counts[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.uint8)
            low[q], high[q] = np.minimum(low[q], to_low[at]), np.maximum(high[q], to_high[at])
            fresh = np.flatnonzero(~checked[q] if final else (counts[q] >= THRESHOLD) & ~checked[q])
            checked[q, fresh] = True
            fresh = fresh[ids[fresh] != query_ids[q]]
            # Row sums of products, not a matrix product: equal vectors get equal scores to the last bit.
            score = (vectors[fresh] * queries[q]).sum(1) / (v_norm[fresh] * q_norm[q])
            where, value = np.concatenate([best[q][0], fresh]), np.concatenate([best[q][1], score])
            if len(where) > 4 * k:
                close = value >= np.partition(value, len(value) - k)[len(value) - k]
                where, value = where[close], value[close]
            top = np.lexsort((ids[where], -value))[:k]
            best[q] = where[top], value[top]
            kth = best[q][1][-1] if len(top) == k else -2.0
            if not final and 2 - 2 * kth > radius * radius:
                going.append(q)
        active, radius = np.array(going, np.int64), radius * GROWTH
    return best


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``id``, ``v`` (doubles) and ``d`` of vectors that are not null or zero and hold only finite numbers."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return (table.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), v.alias("v"))
            .where(F.col("v").isNotNull() & good).withColumn("d", F.size("v")))


def nearest(table: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding",
            vectors_per_block: int = VECTORS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """The ``k`` nearest vectors found for every row whose key is divisible by ``every``.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (cosine); ties
    go to the smaller key. Rows with a null key, or a vector that is null, zero,
    empty or holds null or non-finite components, take no part. Only vectors of
    one length are compared. A key that occurs more than once is searched once,
    with its least vector, and its rows are not their own neighbours; as
    candidates all rows count. With fewer than ``k`` candidates all are
    returned; an empty table gives an empty one. Other columns are ignored.
    """
    rows = usable(table, key, vector)
    asked = rows.where(F.col("id") % every == 0).groupBy("id", "d").agg(F.min("v").alias("v"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("id") % every == 0, F.col("id"))).alias("q")).first()
    # The layout only: enough blocks for all cores, none larger than its bound.
    cores = table.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-sizes["n"] // vectors_per_block))
    batches = max(-(-2 * cores // blocks), -(-sizes["q"] // queries_per_block))
    block = F.pmod(F.xxhash64(F.lit("block"), "id", "v"), F.lit(blocks)).cast("int")
    batch = F.pmod(F.xxhash64(F.lit("batch"), "id"), F.lit(batches)).cast("int")
    left = asked.select("id", "v", "d", batch.alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = rows.select("id", "v", "d", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))

    def answer(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if len(queries) == 0 or len(vectors) == 0:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, asked_ids = vectors["id"].to_numpy(), queries["id"].to_numpy()
        q, v, score = search_block(np.stack(queries["v"].to_numpy()), asked_ids, np.stack(vectors["v"].to_numpy()), ids, k)
        return pd.DataFrame({"query_id": asked_ids[q], "vec_id": ids[v], "score": score})

    met = (left.groupBy("batch", "block", "d").cogroup(right.groupBy("batch", "block", "d"))
           .applyInPandas(answer, "query_id bigint, vec_id bigint, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
