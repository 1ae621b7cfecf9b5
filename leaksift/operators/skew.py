"""Building blocks that keep one hot key from landing in one task.

* :func:`salted_lookup` joins rows to a table with one row per key and spreads
  the rows of hot keys over several tasks.
* :func:`hash_rank` numbers rows inside groups of any size without a window
  over a whole group.
* :func:`quota_sample` takes an exact number of rows per group the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaksift.functions.digest import order_digest
from leaksift.session import materialise

ROWS_PER_TASK = 1_000_000
BROADCAST_ROWS = 1_000_000
SMALL_INPUT_BYTES = 256 << 20
BUCKET_HEX = 4
SCOUT_SHARE = 64


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[int, DataFrame]:
    """``df`` kept and counted; marked for broadcast only when it has at most ``limit`` rows."""
    table = materialise(df)
    rows = table.count()
    return rows, F.broadcast(table) if rows <= limit else table


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` marked so that its next join shuffles both sides, however small they seem.

    Spark takes a side with one row per item and band for no larger than the
    items, and would collect it on the driver to broadcast it.
    """
    return df.hint("merge")


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scout(df: DataFrame, spread: Sequence[str]) -> DataFrame:
    """The rows whose ``spread`` columns hash into one of ``SCOUT_SHARE`` parts.

    Used to find hot keys before a join: a key with a million rows has thousands
    in the part. Only the layout of the join depends on it, never its rows; and
    being a function of the row itself, it is the same when a task runs again.
    """
    return df.where(F.pmod(F.xxhash64(F.lit("scout"), *spread), F.lit(SCOUT_SHARE)) == 0)


def salted_lookup(items: DataFrame, table: DataFrame, on: Sequence[str], spread: Sequence[str],
                  how: str = "left", rows_per_task: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Join ``items`` to ``table`` (unique per ``on``), splitting hot keys.

    Keys with more than about ``rows_per_task`` rows get a salt per
    ``rows_per_task`` of them, and their table row is repeated once per salt. A
    row's salt is a hash of its ``spread`` columns, so a task that runs again
    after an executor is lost gives the same salts. There are about
    ``count(items) / rows_per_task`` such keys at most; they are counted before
    they are broadcast. ``rows`` is a known bound on the items: where it is at
    most ``rows_per_task`` no key can be hot and this is a plain join.
    """
    on = list(on)
    if rows is not None and rows <= rows_per_task:
        return items.join(table, on, how)
    estimate = F.count(F.lit(1)) * SCOUT_SHARE
    found, hot = sized(scout(items, spread).groupBy(*on).agg(estimate.alias("_n"))
                       .where(F.col("_n") > rows_per_task)
                       .select(*on, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_copies")))
    if not found:
        return items.join(table, on, how)
    salted_items = (items.join(hot, on, "left")
                    .withColumn("_salt", F.when(F.col("_copies").isNull(), 0)
                                .otherwise(F.pmod(F.xxhash64(*spread), F.col("_copies")).cast("int")))
                    .drop("_copies"))
    salted_table = (table.join(hot, on, "left")
                    .withColumn("_salt", F.explode(F.sequence(
                        F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1)))
                    .drop("_copies"))
    return salted_items.join(salted_table, [*on, "_salt"], how).drop("_salt")


def _bucketed(df: DataFrame, seed: object, key: Sequence[str]) -> DataFrame:
    digest = order_digest(seed, *[F.col(c) for c in key])
    return df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, BUCKET_HEX))


def _bucket_offsets(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per (group, bucket) and rows in the group's earlier buckets.

    At most ``16**BUCKET_HEX`` rows per group reach the window.
    """
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (df.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_in_bucket"))
            .withColumn("_before", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0))))


def hash_rank(df: DataFrame, key: Sequence[str], by: Sequence[str] = (), seed: object = 0,
              out: str = "position") -> DataFrame:
    """Number rows 1..n inside each group in seeded digest order.

    A row's number is the count of rows in earlier digest buckets plus its
    place in its own bucket, so no task sees more than one bucket of a group.
    ``by`` and ``key`` together must identify a row.
    """
    by, key = list(by), list(key)
    bucketed = _bucketed(df, seed, key)
    within = Window.partitionBy(*by, "_bucket").orderBy("_digest", *key)
    return (bucketed.join(_bucket_offsets(bucketed, by).drop("_in_bucket"), [*by, "_bucket"])
            .withColumn(out, (F.col("_before") + F.row_number().over(within)).cast("bigint"))
            .drop("_digest", "_bucket", "_before"))


def quota_sample(df: DataFrame, targets: DataFrame | int, key: Sequence[str],
                 by: Sequence[str] = (), seed: object = 0, target: str = "target") -> DataFrame:
    """Exactly ``target`` rows per group in seeded digest order (all rows if short).

    ``targets`` is a table of ``by`` plus ``target``, or one number without
    groups. Per group the digest bucket holding the cut is found from bucket
    counts. Rows of earlier buckets pass as they are, without a shuffle when the
    one-row-per-group table of cuts is small enough to broadcast (counted first
    for large inputs; for small ones Spark decides); only the cut bucket is
    ranked, a 65,536th part of a group.
    """
    by, key = list(by), list(key)
    bucketed = _bucketed(df, seed, key)
    offsets = _bucket_offsets(bucketed, by)
    if isinstance(targets, int):
        goals = df.sparkSession.range(1).select(F.lit(targets).cast("bigint").alias(target))
    else:
        goals = targets.select(*by, target)
    match = by if by else F.lit(True)
    crossing = (offsets.join(goals, match)
                .where((F.col("_before") <= F.col(target)) & (F.col("_before") + F.col("_in_bucket") > F.col(target)))
                .select(*by, F.col("_bucket").alias("_cut"), (F.col(target) - F.col("_before")).alias("_room")))
    cuts = goals.join(crossing, by if by else F.lit(True), "left").drop(target)
    if estimated_bytes(df) > SMALL_INPUT_BYTES:
        cuts = sized(cuts)[1]
    placed = bucketed.join(cuts, match)
    within = Window.partitionBy(*by, "_bucket").orderBy("_digest", *key)
    whole = placed.where(F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut")))
    cut = (placed.where(F.col("_bucket") == F.col("_cut"))
           .withColumn("_rank", F.row_number().over(within))
           .where(F.col("_rank") <= F.col("_room")).drop("_rank"))
    return whole.unionByName(cut).drop("_digest", "_bucket", "_room", "_cut")


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key, the first by ``order``; an aggregate, so it combines map-side."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*key).agg(first).select(*key, "_first.*").select(*df.columns)


def running_total(df: DataFrame, value: str, order: str, bucket: Column, by: Sequence[str],
                  out: str) -> DataFrame:
    """Sum of ``value`` over the rows of a group with a smaller ``order``.

    ``order`` must be unique inside a group and ``bucket`` must not decrease
    with it. Bucket sums give the part before a row's bucket; the window only
    covers one bucket.
    """
    by = list(by)
    tagged = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (tagged.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
            .select(*by, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base")))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (tagged.join(sums, [*by, "_bucket"])
            .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("_bucket", "_base"))
