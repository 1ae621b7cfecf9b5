"""Membership, attribution, reconciliation and cascade joins on equal keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksift.operators.fingerprints import normalised_words
from leaksift.operators.skew import salted_lookup


def exact_membership(items: DataFrame, other: DataFrame, on: Sequence[str], spread: Sequence[str],
                     flag: str = "is_member", rows: int | None = None) -> DataFrame:
    """Flag items whose ``on`` values occur in the other corpus; null values never match."""
    known = other.select(*on).dropna().distinct().withColumn(flag, F.lit(True))
    return salted_lookup(items, known, on, spread, rows=rows).withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def exact_matches(items: DataFrame, reference: DataFrame, *, on: Sequence[str], item: str, ref_key: str,
                  group: str, rows: int | None = None) -> DataFrame:
    """Items with an equal fingerprint in the reference, with first match and multiplicity.

    The reference is reduced to one row per fingerprint first, so a fingerprint
    with many copies on both sides never multiplies out. Adds ``first_match``,
    ``n_matches`` and ``same_group`` (group of the item and of the first match).
    """
    first = F.min_by(F.struct(F.col(ref_key).alias("first_match"), F.col(group).alias("_group")),
                     F.col(ref_key)).alias("_first")
    table = (reference.dropna(subset=list(on)).groupBy(*on)
             .agg(first, F.count(F.lit(1)).alias("n_matches"))
             .select(*on, "n_matches", "_first.*"))
    return (salted_lookup(items.dropna(subset=list(on)), table, on, [item], how="inner", rows=rows)
            .withColumn("same_group", F.col(group).eqNullSafe(F.col("_group"))).drop("_group"))


def remove_keys(items: DataFrame, flagged: DataFrame, on: Sequence[str],
                restrict: Column | None = None) -> DataFrame:
    """Rows whose key is not flagged. ``restrict`` limits removal to some rows, such as one source."""
    keys = flagged.select(*on).distinct()
    if restrict is None:
        return items.join(keys, list(on), "left_anti")
    marked = keys.withColumn("_flagged", F.lit(True))
    hit = F.coalesce(F.col("_flagged"), F.lit(False)) & F.coalesce(restrict, F.lit(False))
    return items.join(marked, list(on), "left").where(~hit).drop("_flagged")


def keep_keys(items: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return items.join(keys.select(*on).distinct(), list(on), "left_semi")


def name_overlap(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Key values present on both sides."""
    return left.select(*on).intersect(right.select(*on))


def attach(items: DataFrame, table: DataFrame, on: Sequence[str], spread: Sequence[str],
           found: str = "is_found") -> DataFrame:
    """Left lookup that also says whether a row was found, so misses can be counted."""
    return (salted_lookup(items, table.withColumn(found, F.lit(True)), on, spread)
            .withColumn(found, F.coalesce(F.col(found), F.lit(False))))


def check_alignment(predictions: DataFrame, truth: DataFrame, team: str, item: str) -> DataFrame:
    """Per team: items missing, unexpected and repeated; ``aligned`` when all are zero."""
    teams = predictions.select(team).distinct()
    got = predictions.groupBy(team, item).agg(F.count(F.lit(1)).alias("_n"))
    sides = got.join(truth.select(item).withColumn("_known", F.lit(1)), item, "left")
    per_team = sides.groupBy(team).agg(
        F.sum(F.when(F.col("_known").isNotNull(), 1).otherwise(0)).alias("_matched"),
        F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).alias("n_unexpected"),
        F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)).alias("n_repeated"))
    size = truth.agg(F.count(F.lit(1)).alias("_size"))
    out = teams.join(per_team, team).join(size, F.lit(True)).select(
        team, (F.col("_size") - F.col("_matched")).alias("n_missing"), "n_unexpected", "n_repeated")
    return out.withColumn("aligned", (F.col("n_missing") == 0) & (F.col("n_unexpected") == 0)
                          & (F.col("n_repeated") == 0))


def reconcile(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every key with the side it occurs on: ``both``, ``left_only`` or ``right_only``."""
    a = left.select(*on).distinct().withColumn("_l", F.lit(True))
    b = right.select(*on).distinct().withColumn("_r", F.lit(True))
    side = (F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both")
            .when(F.col("_l").isNotNull(), "left_only").otherwise("right_only"))
    return a.join(b, list(on), "full").select(*on, side.alias("side"))


def group_overlap(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """One row: shared, left-only and right-only groups, and test rows of shared groups."""
    a = train.groupBy(group).agg(F.count(F.lit(1)).alias("_a"))
    b = test.groupBy(group).agg(F.count(F.lit(1)).alias("_b"))
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return a.join(b, group, "full").agg(
        F.count_if(in_a & in_b).alias("n_shared"),
        F.count_if(in_a & ~in_b).alias("n_train_only"),
        F.count_if(~in_a & in_b).alias("n_test_only"),
        F.coalesce(F.sum(F.when(in_a & in_b, F.col("_b"))), F.lit(0)).alias("test_rows_shared"),
        F.coalesce(F.sum("_b"), F.lit(0)).alias("test_rows"))


def manifest_check(listing: DataFrame, manifest: DataFrame, path: str, digest: str) -> DataFrame:
    """Every path of either side: ``ok``, ``mismatch``, ``missing`` or ``unlisted``."""
    a = listing.select(path, F.col(digest).alias("_actual"))
    b = manifest.select(path, F.col(digest).alias("_expected"))
    status = (F.when(F.col("_actual").isNull(), "missing").when(F.col("_expected").isNull(), "unlisted")
              .when(F.col("_actual") == F.col("_expected"), "ok").otherwise("mismatch"))
    return a.join(b, path, "full").select(path, status.alias("status"))


def majority_vote(rows: DataFrame, key: Sequence[str], label: str, out: str = "vote") -> DataFrame:
    """Most frequent label per key, the alphabetically first on ties."""
    counts = rows.groupBy(*key, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*key).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias(out))


def class_prior(rows: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """Share of each listed class among rows, zeros kept."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = rows.where(F.col(label).isNotNull()).agg(F.count(F.lit(1)).alias("_total"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return (classes.select(label).join(counts, label, "left").join(total, F.lit(True))
            .select(label, n.alias("n"), F.when(F.col("_total") > 0, n / F.col("_total")).otherwise(0.0).alias("prior")))


def priority_cascade(items: DataFrame, rules: Mapping[str, tuple[DataFrame, Sequence[str]]],
                     spread: Sequence[str], fallback: str, out: str = "vote",
                     rows: int | None = None) -> DataFrame:
    """First rule that knows an item's key wins; adds ``rule`` and ``out``.

    ``rules``: name → (vote table with its key columns and ``vote``, key columns), in
    order. Vote tables have one row per key; rows with null keys never match.
    """
    joined = items
    names = []
    for i, (name, (table, key)) in enumerate(rules.items()):
        vote = f"_vote{i}"
        joined = salted_lookup(joined, table.dropna(subset=list(key)).withColumnRenamed("vote", vote), key, spread,
                               rows=rows)
        names.append((name, vote))
    rule = F.lit(fallback)
    for name, vote in reversed(names):
        rule = F.when(F.col(vote).isNotNull(), name).otherwise(rule)
    return (joined.withColumn(out, F.coalesce(*[F.col(v) for _, v in names]))
            .withColumn("rule", rule).drop(*[v for _, v in names]))


def seed_pairs(left: DataFrame, right: DataFrame, seed: str, value: str,
               on: Sequence[str] = ()) -> DataFrame:
    """Runs of two arms joined on their seed: ``left_value``, ``right_value``."""
    return (left.select(*on, seed, F.col(value).alias("left_value"))
            .join(right.select(*on, seed, F.col(value).alias("right_value")), [*on, seed]))


def unmatched_names(names: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Membership entries that name nobody; a filter using them would silently do nothing."""
    return names.select(on).distinct().join(known.select(on).distinct(), on, "left_anti")


def filter_group(rows: DataFrame, membership: DataFrame, on: str, exclude: bool = True) -> DataFrame:
    """Keep or drop the members of a group; a member that matches no row is an error."""
    missing = (unmatched_names(membership, rows, on)
               .agg(F.count(F.lit(1)).alias("_missing"), F.min(on).cast("string").alias("_name")))
    kept = rows.join(membership.select(on).distinct(), on, "left_anti" if exclude else "left_semi")
    check = F.when(F.col("_missing") > 0, F.raise_error(F.concat(
        F.lit("group members without rows, first: "), F.col("_name")))).otherwise(F.lit(True))
    return kept.join(missing, F.lit(True)).where(check.cast("boolean")).drop("_missing", "_name")



def passage_hits(items: DataFrame, benchmark: DataFrame, key: str, size: int = 8, text: str = "text") -> DataFrame:
    """Keys of items that share a run of ``size`` words with any benchmark text.

    Runs of whole texts are hashed in the JVM to 96 bits (two hash families), so
    texts never meet in the shuffle. The benchmark's distinct hashes are one side
    of a semi-join, which Spark broadcasts when their size allows; otherwise it
    shuffles both sides and adaptive execution splits a run that very many items
    share.
    """
    def runs(df: DataFrame, *keep: str) -> DataFrame:
        def at(i: Column) -> Column:
            words = [F.get("_w", i + d) for d in range(size)]
            return F.struct(F.xxhash64(*words).alias("_run"), F.hash(*words).alias("_check"))

        tokens = df.select(*keep, normalised_words(F.col(text)).alias("_w")).where(F.size("_w") >= size)
        every = F.transform(F.sequence(F.lit(0), F.size("_w") - size), at)
        return tokens.select(*keep, F.inline(every))

    return (runs(items, key).join(runs(benchmark).distinct(), ["_run", "_check"], "left_semi")
            .select(key).distinct())
