"""Cleaned splits, matched controls and samples.

Draws follow the order of ``md5(seed:key)``: any engine can repeat them, and no
draw needs a window over a whole class or source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksift.operators.lookups import exact_membership, remove_keys
from leaksift.operators.skew import hash_rank, quota_sample, salted_lookup


def threshold_splits(items: DataFrame, distance: str, thresholds: Sequence[int],
                     restrict: Column | None = None) -> DataFrame:
    """Rows kept at each threshold, in one pass: ``threshold`` plus the item columns.

    A row is dropped at ``t`` when its distance is at most ``t``; ``restrict`` limits
    dropping to some rows (one source, for example). Null distances stay.
    """
    limit = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    near = F.coalesce(F.col(distance) <= F.col("threshold"), F.lit(False))
    if restrict is not None:
        near = near & F.coalesce(restrict, F.lit(False))
    return items.select("*", limit).where(~near)


def internal_leaks(items: DataFrame, *, key: str, name: str, words: Sequence[str], source: str,
                   split: str = "split", rows: int | None = None) -> DataFrame:
    """Keys of validation rows that share a name or an exact fingerprint with training, per source."""
    train = items.where(F.col(split) == "training")
    held = items.where(F.col(split) == "validation")
    same_name = exact_membership(held, train, [source, name], [key], rows=rows).where("is_member")
    same_hash = exact_membership(held, train, [source, *words], [key], rows=rows).where("is_member")
    return same_name.select(key).unionByName(same_hash.select(key)).distinct()


def remove_internal_leaks(kept: DataFrame, leaks: DataFrame, key: str) -> DataFrame:
    return remove_keys(kept, leaks, [key])


def random_subset(items: DataFrame, n: int, key: str, seed: object) -> DataFrame:
    """Exactly ``n`` rows without replacement."""
    return quota_sample(items, n, [key], seed=seed)


def require_enough(items: DataFrame, targets: DataFrame, by: Sequence[str], target: str = "target") -> DataFrame:
    """``targets`` again, failing at run time when a group has fewer rows than asked for."""
    have = items.groupBy(*by).agg(F.count(F.lit(1)).alias("_have"))
    n = F.coalesce(F.col("_have"), F.lit(0))
    message = F.concat(F.lit("short of rows in "), F.concat_ws("/", *[F.col(c).cast("string") for c in by]))
    checked = F.when(n < F.col(target), F.raise_error(message).cast("bigint")).otherwise(F.col(target).cast("bigint"))
    return targets.join(have, list(by), "left").select(*by, checked.alias(target))


def stratified_subset(items: DataFrame, targets: DataFrame, key: str, by: Sequence[str], seed: object) -> DataFrame:
    """Exactly ``target`` rows per stratum; too few rows is an error."""
    return quota_sample(items, require_enough(items, targets, by), [key], by, seed)


def composition_matched(items: DataFrame, targets: DataFrame, *, key: str, label: str, source: str,
                        preferred: str, seed: object) -> DataFrame:
    """``target`` rows per class, from the preferred source first, the rest from the others."""
    is_preferred = F.col(source) == preferred
    have = items.where(is_preferred).groupBy(label).agg(F.count(F.lit(1)).alias("_have"))
    plan = targets.join(have, label, "left").withColumn(
        "_first", F.least(F.col("target"), F.coalesce(F.col("_have"), F.lit(0))))
    first = quota_sample(items.where(is_preferred), plan.select(label, F.col("_first").alias("target")),
                         [key], [label], seed)
    rest = quota_sample(items.where(~is_preferred),
                        plan.select(label, (F.col("target") - F.col("_first")).alias("target")),
                        [key], [label], seed)
    return first.unionByName(rest)


def shortfall(sample: DataFrame, targets: DataFrame, label: str) -> DataFrame:
    """Classes of a sample that fell short of their target, with the gap."""
    got = sample.groupBy(label).agg(F.count(F.lit(1)).alias("_got"))
    return (targets.join(got, label, "left")
            .select(label, "target", F.coalesce(F.col("_got"), F.lit(0)).alias("got"))
            .where(F.col("got") < F.col("target")))


def swap_cell(items: DataFrame, cell: Column, incoming: DataFrame) -> DataFrame:
    """Remove the rows of a (source, class) cell and append other rows."""
    return items.where(~cell).unionByName(incoming)


def displace_and_add(items: DataFrame, cell: Column, n: int, incoming: DataFrame, key: str,
                     seed: object) -> DataFrame:
    """Drop ``n`` seeded rows of a cell and append other rows."""
    dropped = random_subset(items.where(cell), n, key, seed)
    return items.join(dropped.select(key), key, "left_anti").unionByName(incoming)


def duplicate_cell(items: DataFrame, displaced: Column, duplicated: Column, key: str, seed: object,
                   n: int) -> DataFrame:
    """Drop ``n`` rows of one cell and append ``n`` copies of rows of another, size unchanged."""
    copies = random_subset(items.where(duplicated), n, key, f"{seed}:copy")
    return displace_and_add(items, displaced, n, copies, key, seed)


def add_unseen(items: DataFrame, pool: DataFrame, n: int, key: str, seed: object) -> DataFrame:
    """Append ``n`` seeded pool rows whose key is not present yet."""
    unseen = pool.join(items.select(key), key, "left_anti")
    return items.unionByName(random_subset(unseen, n, key, seed))


def capped_addon(items: DataFrame, pool: DataFrame, cap: int, key: str, label: str, seed: object) -> DataFrame:
    """Append up to ``cap`` unseen pool rows per class (unmapped classes are left out)."""
    unseen = pool.where(F.col(label).isNotNull()).join(items.select(key), key, "left_anti")
    targets = unseen.select(label).distinct().withColumn("target", F.lit(cap))
    return items.unionByName(quota_sample(unseen, targets, [key], [label], seed))


def shuffle_labels(items: DataFrame, key: str, label: str, scope: Column, by: Sequence[str], seed: object,
                   out: str = "shuffled") -> DataFrame:
    """Permute labels inside each group of the rows in ``scope``; others keep theirs.

    Receivers and labels are numbered in two different digest orders and joined
    on the number, so class counts are kept exactly.
    """
    inside = items.where(scope)
    takers = hash_rank(inside.select(*by, key), [key], by, f"{seed}:to", "_p")
    givers = hash_rank(inside.select(*by, key, label), [key], by, f"{seed}:from", "_p")
    moved = takers.join(givers.select(*by, "_p", F.col(label).alias(out)), [*by, "_p"]).select(key, out)
    return items.join(moved, key, "left").withColumn(out, F.coalesce(F.col(out), F.col(label)))


def group_holdout(items: DataFrame, *, group: str, label: str, priority: Sequence[str], k: int,
                  min_rows: int) -> DataFrame:
    """Choose ``k`` groups to hold out: ``group``, ``n`` and ``step``.

    For each priority class the eligible group with most rows of it (and at
    least half of ``min_rows``), then the largest remaining groups. Each step is a
    top-1 over the per-group table; rows are never collected.
    """
    cells = items.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    sizes = cells.groupBy(group).agg(F.sum("_n").alias("n")).where(F.col("n") >= min_rows)
    chosen = None
    for step, name in enumerate(priority[:k]):
        options = sizes.join(cells.where((F.col(label) == name) & (F.col("_n") >= min_rows // 2)), group)
        if chosen is not None:
            options = options.join(chosen.select(group), group, "left_anti")
        pick = (options.orderBy(F.desc("_n"), group).limit(1)
                .select(group, "n", F.lit(step).alias("step")))
        chosen = pick if chosen is None else chosen.unionByName(pick)
    rest = sizes if chosen is None else sizes.join(chosen.select(group), group, "left_anti")
    largest = rest.orderBy(F.desc("n"), group).limit(k)
    filled = (chosen.agg(F.count(F.lit(1)).alias("_filled")) if chosen is not None
              else items.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("_filled")))
    ordered = largest.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("_o"), F.col(group), "n"))).alias("_all"))
    fill = (ordered.join(filled, F.lit(True))
            .select(F.explode(F.slice("_all", F.lit(1), F.greatest(F.lit(k) - F.col("_filled"), F.lit(0)).cast("int"))).alias("_g"))
            .select(f"_g.{group}", "_g.n", F.lit(len(priority)).alias("step")))
    return fill if chosen is None else chosen.unionByName(fill)


def holdout_rows(items: DataFrame, chosen: DataFrame, group: str, key: Sequence[str], out: str = "part") -> DataFrame:
    """The rows, each ``held_out`` or ``reduced`` by its group; a null group is never held out.

    A group that holds many of the rows is spread over tasks by ``key``.
    """
    marked = chosen.select(group).distinct().withColumn(out, F.lit("held_out"))
    return salted_lookup(items, marked, [group], key).withColumn(out, F.coalesce(out, F.lit("reduced")))


def ratio_split(items: DataFrame, key: str, shares: Sequence[tuple[str, float]], seed: object,
                by: Sequence[str] = ()) -> DataFrame:
    """Assign rows to named parts by seeded order; cumulative shares times n, rounded down, are the cuts."""
    ranked = hash_rank(items, [key], by, seed, "_p")
    sizes = items.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    joined = ranked.join(sizes, list(by)) if by else ranked.join(sizes, F.lit(True))
    part, total = F.lit(shares[-1][0]), sum(s for _, s in shares[:-1])
    for name, share in reversed(list(shares[:-1])):
        part = F.when(F.col("_p") <= F.floor(F.col("_size") * F.lit(round(total, 9)) + 1e-9), name).otherwise(part)
        total -= share
    return joined.withColumn("part", part).drop("_p", "_size")



def leave_one_out_sizes(items: DataFrame, group: str) -> DataFrame:
    """Training and test size of every fold, from one count per group."""
    sizes = items.groupBy(group).agg(F.count(F.lit(1)).alias("n_test"))
    total = items.agg(F.count(F.col(group)).alias("_total"))
    return sizes.join(total, F.lit(True)).select(
        group, (F.col("_total") - F.col("n_test")).alias("n_train"), "n_test")


def two_fold(items: DataFrame, fold: str, train: object, test: object) -> DataFrame:
    """Rows of two folds with their role."""
    role = F.when(F.col(fold) == train, "train").otherwise("test")
    return items.where(F.col(fold).isin(train, test)).withColumn("role", role)


def proportional_targets(items: DataFrame, by: str, n: Column | int, out: str = "target") -> DataFrame:
    """Class targets ``round(count * n / total)``; the rounding gap goes to the largest class.

    Halves round to even; of equally large classes the first by name takes the gap.
    """
    size = n if isinstance(n, Column) else F.lit(n)
    counts = items.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"), F.min_by(by, F.struct(-F.col("_n"), F.col(by))).alias("_largest"))
    raw = counts.join(total, F.lit(True)).withColumn(
        out, F.bround(F.col("_n") * size / F.col("_total")).cast("bigint"))
    gap = raw.agg((size - F.sum(out)).alias("_gap"))
    fixed = F.col(out) + F.when(F.col(by) == F.col("_largest"), F.col("_gap")).otherwise(0)
    return raw.join(gap, F.lit(True)).select(by, fixed.cast("bigint").alias(out))


def held_in_sample(train: DataFrame, held_out_size: int, key: str, seed: object) -> DataFrame:
    """As many training rows as there are held-out rows."""
    return random_subset(train, held_out_size, key, seed)


def review_sample(flagged: DataFrame, key: str, seed: object, most: int = 200) -> DataFrame:
    """Up to ``most`` flagged rows for manual review."""
    return random_subset(flagged, most, key, seed)
