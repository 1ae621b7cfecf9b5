"""Ranks on leaderboards: one row per team and board, so a window holds one board."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_rank(rows: DataFrame, by: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """1 for the largest; equal values share their mean position."""
    order = Window.partitionBy(*by).orderBy(F.desc(value))
    ties = Window.partitionBy(*by, value)
    return rows.withColumn(out, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def ordinal_rank(rows: DataFrame, by: Sequence[str], value: str, name: str, out: str = "rank") -> DataFrame:
    """1 for the largest; ties in name order."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), name)
    return rows.withColumn(out, F.row_number().over(order))


def rank_shift(before: DataFrame, after: DataFrame, on: Sequence[str], rank: str = "rank") -> DataFrame:
    """Per team: rank before, rank after and ``shift`` (positive is a rise)."""
    return (before.select(*on, F.col(rank).alias("rank_before"))
            .join(after.select(*on, F.col(rank).alias("rank_after")), list(on))
            .withColumn("shift", F.col("rank_before") - F.col("rank_after")))


def shift_summary(shifts: DataFrame, by: Sequence[str] = (), far: int = 3) -> DataFrame:
    s = F.col("shift")
    return shifts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(s) > 1e-9).alias("n_changed"),
        F.count_if(F.abs(s) >= far).alias("n_far"), F.max(s).alias("max_rise"), F.min(s).alias("max_drop"),
        F.median(F.abs(s)).alias("median_abs_shift"))


def top_overlap(left: DataFrame, right: DataFrame, on: Sequence[str], k: int = 5, rank: str = "rank") -> DataFrame:
    """Teams in the first ``k`` of both boards."""
    a = left.where(F.col(rank) <= k).select(*on)
    b = right.where(F.col(rank) <= k).select(*on)
    return a.join(b, list(on)).agg(F.count(F.lit(1)).alias("overlap"))


def last_row(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The row with the largest ``order`` per key."""
    rest = [c for c in rows.columns if c not in key]
    return (rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
            .select(*key, "_last.*").select(*rows.columns))


def extremes(rows: DataFrame, value: str, name: str, k: int = 10) -> DataFrame:
    """The ``k`` largest and ``k`` smallest rows by value (names break ties)."""
    top = rows.orderBy(F.desc(value), name).limit(k).withColumn("side", F.lit("top"))
    low = rows.orderBy(F.asc(value), name).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)
