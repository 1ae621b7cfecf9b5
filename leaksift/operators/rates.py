"""Counts, rates and summaries of leakage.

Rates are computed from rows aggregated to (fingerprint, source, split, label)
counts wherever possible, so copies cost one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaksift.functions.intervals import wilson
from leaksift.functions.keys import band_label, bin_label


def source_split_counts(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Row counts with every level of totals; totals carry ``(all)``."""
    totals = items.rollup(*by).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_all_{c}") for c in by])
    return totals.select(
        *[F.when(F.col(f"_all_{c}") == 1, "(all)").otherwise(F.col(c)).alias(c) for c in by], "n")


def threshold_counts(rows: DataFrame, distance: str, thresholds: Sequence[int], by: Sequence[str] = (),
                     weight: str | None = None, intervals: bool = True) -> DataFrame:
    """Rows within each threshold, their share and its Wilson interval.

    One aggregate counts every threshold; a null distance is outside all of them.
    ``weight`` counts a row several times.
    """
    one = F.col(weight) if weight else F.lit(1)
    hits = [F.sum(F.when(F.col(distance) <= t, one).otherwise(0)).alias(f"_le{t}") for t in thresholds]
    wide = rows.groupBy(*by).agg(F.sum(one).alias("n"), *hits)
    long = wide.select(*by, "n", F.inline(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"_le{t}").alias("k")) for t in thresholds])))
    long = long.withColumn("rate", F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0))
    if not intervals:
        return long
    low, high = wilson(F.col("k"), F.col("n"))
    return long.withColumn("ci_low", low).withColumn("ci_high", high)


def censored_median(rows: DataFrame, distance: str, by: Sequence[str] = (), weight: str | None = None, out: str = "median_distance") -> DataFrame:
    """Median of an integer distance that is null beyond a radius: exact where the middle rows lie within it, else null.

    Rows are counted per distance first, so a window sees one row per distance.
    """
    by, one = list(by), F.col(weight) if weight else F.lit(1)
    counts = rows.groupBy(*by, distance).agg(F.sum(one).alias("_n"))
    upto = Window.partitionBy(*by).orderBy(F.col(distance).asc_nulls_last())
    placed = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))

    def middle(place: Column) -> Column:
        return F.min(F.when(F.col("_upto") >= place, F.col(distance)))

    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    found = placed.groupBy(*by).agg(middle(low).alias("_low"), middle(high).alias("_high"), F.max(high).alias("_place"),
                                    F.max(F.when(F.col(distance).isNotNull(), F.col("_upto")).otherwise(0)).alias("_known"))
    return found.select(*by, F.when(F.col("_known") >= F.col("_place"), (F.col("_low") + F.col("_high")) / 2).alias(out))


def histogram(rows: DataFrame, value: str, edges: Sequence[float], by: Sequence[str] = (),
              weight: str | None = None, outside: str = "outside") -> DataFrame:
    """Counts per half-open bin named ``lo,hi`` (last bin closed); nulls and others under ``outside``."""
    one = F.col(weight) if weight else F.lit(1)
    label = F.coalesce(bin_label(F.col(value), edges), F.lit(outside))
    return rows.groupBy(*by, label.alias("bin")).agg(F.sum(one).alias("n"))


def density(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Unit bins of an integer value with their share of the group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    return counts.join(totals, list(by)).withColumn("density", F.col("n") / F.col("_total")).drop("_total")


def location_summary(rows: DataFrame, value: str, by: Sequence[str] = (),
                     cuts: Sequence[float] = ()) -> DataFrame:
    """n, mean, both deviations, quantiles (interpolated), extremes and shares at or above cuts.

    Exact percentiles count distinct values per group; they combine map-side.
    """
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd_sample"), F.stddev_pop(v).alias("sd_population"),
        *[F.percentile(v, F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.10, 0.25, 0.50, 0.75, 0.95)],
        F.min(v).alias("min"), F.max(v).alias("max"),
        *[F.avg((v >= c).cast("double")).alias(f"share_ge_{str(c).replace('.', '_')}") for c in cuts])


def band_summary(rows: DataFrame, band: str, value: str, bands: Sequence[tuple[int, int]],
                 cuts: Sequence[float] = ()) -> DataFrame:
    """:func:`location_summary` per band of another column; values outside every band stay as ``other``."""
    return location_summary(rows.withColumn("band", band_label(F.col(band), bands)), value, ["band"], cuts)


def leak_rate(rows: DataFrame, flag: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Flagged share per group with its Wilson interval."""
    one = F.col(weight) if weight else F.lit(1)
    out = rows.groupBy(*by).agg(F.sum(one).alias("n"),
                                F.sum(F.when(F.col(flag), one).otherwise(0)).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return (out.withColumn("rate", F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0))
            .withColumn("ci_low", low).withColumn("ci_high", high))


def group_coverage(items: DataFrame, hits: DataFrame, group: str) -> DataFrame:
    """Total, hit rows and fraction per group; groups without a hit are kept."""
    total = items.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    hit = hits.groupBy(group).agg(F.count(F.lit(1)).alias("hit"))
    n = F.coalesce(F.col("hit"), F.lit(0))
    return total.join(hit, group, "left").select(
        group, "total", n.alias("hit"), (n / F.col("total")).alias("fraction"))


def fraction_buckets(coverage: DataFrame, fraction: str = "fraction", full: float = 0.99) -> DataFrame:
    """How many groups are fully, mostly, half or not covered, with mean and population deviation."""
    f = F.col(fraction)
    return coverage.agg(
        F.count(F.lit(1)).alias("n_groups"), F.avg(f).alias("mean_fraction"),
        F.stddev_pop(f).alias("sd_population"), F.count_if(f >= full).alias("n_full"),
        F.count_if(f > 0.9).alias("n_above_90"), F.count_if(f > 0.5).alias("n_above_50"),
        F.count_if(f == 0).alias("n_zero"))


def duplicate_groups(items: DataFrame, on: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Groups of equal fingerprints: how many, rows in them, extra rows and percent extra."""
    sizes = items.dropna(subset=list(on)).groupBy(*by, *on).agg(F.count(F.lit(1)).alias("_n"))
    many = F.col("_n") > 1
    out = sizes.groupBy(*by).agg(
        F.sum("_n").alias("n_rows"), F.count_if(many).alias("n_groups"),
        F.coalesce(F.sum(F.when(many, F.col("_n"))), F.lit(0)).alias("rows_in_groups"))
    return (out.withColumn("extra_rows", F.col("rows_in_groups") - F.col("n_groups"))
            .withColumn("extra_percent", F.when(F.col("n_rows") > 0, 100.0 * F.col("extra_rows") / F.col("n_rows"))
                        .otherwise(0.0)))


def cross_source_groups(items: DataFrame, on: Sequence[str], source: str, least: int = 2) -> DataFrame:
    """Fingerprints seen in at least ``least`` sources."""
    per_source = items.dropna(subset=list(on)).groupBy(*on, source).agg(F.count(F.lit(1)).alias("_n"))
    return (per_source.groupBy(*on)
            .agg(F.count(F.lit(1)).alias("n_sources"), F.sum("_n").alias("n_rows"),
                 F.min(source).alias("first_source"))
            .where(F.col("n_sources") >= least))


def bounded_examples(rows: DataFrame, key: Sequence[str], order: str, k: int, out: str = "examples") -> DataFrame:
    """First ``k`` values per key in order.

    Spark limits a ranked window before the shuffle, so every task sends at most
    ``k`` rows of a key.
    """
    inside = Window.partitionBy(*key).orderBy(order)
    short = rows.select(*key, order).withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= k)
    return short.groupBy(*key).agg(F.sort_array(F.collect_list(order)).alias(out))


def disagreement(rows: DataFrame, left: str, right: str, top: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent (mapped, actual) label pairs that differ, ``top`` for each value of ``by``."""
    pairs = (rows.where(F.col(left).isNotNull() & (F.col(left) != F.col(right)))
             .groupBy(*by, left, right).agg(F.count(F.lit(1)).alias("n")))
    order = [F.desc("n"), F.col(left), F.col(right)]
    if not by:
        return pairs.orderBy(*order).limit(top)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return pairs.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")


def agreement(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Agreeing, disagreeing and unmappable rows; the fraction is over mappable ones."""
    mapped = F.col(left).isNotNull() & F.col(right).isNotNull()
    agree = mapped & (F.col(left) == F.col(right))
    out = rows.agg(F.count_if(agree).alias("n_agree"), F.count_if(mapped & ~agree).alias("n_disagree"),
                   F.count_if(~mapped).alias("n_unmappable"))
    seen = F.col("n_agree") + F.col("n_disagree")
    return out.withColumn("agree_fraction", F.when(seen > 0, F.col("n_agree") / seen))


def unmappable(rows: DataFrame, label: str, left: str, right: str) -> DataFrame:
    """Rows per ``label`` that lack one of two labels, with the share of the label's rows."""
    lost = F.col(left).isNull() | F.col(right).isNull()
    counts = rows.groupBy(label).agg(F.count_if(lost).alias("n_unmappable"), F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n_unmappable") > 0).withColumn("share", F.col("n_unmappable") / F.col("n"))


def rule_coverage(rows: DataFrame, rule: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per cascade rule."""
    return rows.groupBy(*by, rule).agg(F.count(F.lit(1)).alias("n"))


def touched_rows(pairs: DataFrame, groups: DataFrame, words: Sequence[str]) -> DataFrame:
    """Number of rows that are in any pair, from fingerprint pairs and copy counts.

    A row is touched when its fingerprint is in a pair or has a second copy.
    """
    ends = (pairs.select(*[F.col(f"{w}_a").alias(w) for w in words])
            .unionByName(pairs.select(*[F.col(f"{w}_b").alias(w) for w in words]))
            .distinct().withColumn("_paired", F.lit(True)))
    hit = F.coalesce(F.col("_paired"), F.lit(False)) | (F.col("n") > 1)
    return groups.join(ends, list(words), "left").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("rows_in_pairs"),
        F.sum("n").alias("n_rows"))


def curve(rows: DataFrame, by: Sequence[str], value: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Mean and both deviations of a value along one or more axes (severity, scale, group count)."""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd_population"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd_sample"), *extra)


def corruption_summary(cells: DataFrame) -> DataFrame:
    """Per (corruption, severity): n, mean entropy, mean and deviation of pass rate, mean accuracy."""
    return cells.groupBy("corruption", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.avg("entropy").alias("mean_entropy"),
        F.avg("pass_rate").alias("mean_pass"), F.stddev_pop("pass_rate").alias("sd_pass"),
        F.avg("balanced").alias("mean_balanced"))


def group_profile(rows: DataFrame, group: str, label: str, correct: str,
                  high: float = 0.8, low: float = 0.2, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy per group, its dominant label, and weighted accuracy outside that label; each for every value of ``by``."""
    keys = [*by, group]
    cells = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"),
                                           F.sum(F.col(correct).cast("int")).alias("_k"))
    top = cells.groupBy(*keys).agg(
        F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("dominant_label"),
        F.sum("_n").alias("n"), (F.sum("_k") / F.sum("_n")).alias("accuracy"))
    other = (cells.join(top.select(*keys, "dominant_label"), keys)
             .where(F.col(label) != F.col("dominant_label"))
             .groupBy(*keys).agg((F.sum("_k") / F.sum("_n")).alias("accuracy_other")))
    level = F.when(F.col("accuracy") >= high, "high").when(F.col("accuracy") <= low, "low").otherwise("mid")
    return top.join(other, keys, "left").withColumn("level", level)
