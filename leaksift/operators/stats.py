"""Paired, bootstrap, rank and null-distribution statistics.

Replicates and trials are a column, so a whole bootstrap is one grouped job.
Draws come from digests: a rerun, or another engine, gives the same draws.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksift.functions.counters import PRIME, drawn, replicate_sums
from leaksift.functions.intervals import T_CRITICAL_DF9, normal_tail, z_quantile
from leaksift.operators.lookups import seed_pairs
from leaksift.operators.ranks import average_rank, ordinal_rank
from leaksift.operators.skew import hash_rank, running_total

BOARD_EDGES = 64
RATE_FLOOR = 1e-9  # fixed value of the published test
LEAST_LIKELY = 1e-13
EXACT_PAIRS = 3_000
BLOCK_GROUPS, SPAN_REPS, SPAN_RANKS = 1 << 20, 500, 250
CLUSTER_REPS, PAIRED_REPS, NULL_TRIALS, RANK_REPS = 20_000, 10_000, 1_000, 1_000


# --- means and contrasts -----------------------------------------------------

def mean_summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample and population deviation, standard error, median, extremes.

    One value has deviation 0.
    """
    v = F.col(value)
    sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), sd.alias("sd_sample"),
        F.stddev_pop(v).alias("sd_population"), (sd / F.sqrt(F.count(v))).alias("se"),
        F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"))


def paired_contrast(left: DataFrame, right: DataFrame, *, seed: str, value: str, by: Sequence[str] = (),
                    seeds: int | None = None) -> DataFrame:
    """Per-seed differences of two arms (left - right), summarised; ``seeds`` demands that many."""
    pairs = seed_pairs(left, right, seed, value, by).withColumn("delta", F.col("left_value") - F.col("right_value"))
    out = mean_summary(pairs, by, "delta")
    if seeds is not None:
        out = out.withColumn("n", F.when(F.col("n") == seeds, F.col("n")).otherwise(
            F.raise_error(F.lit(f"arms do not share {seeds} seeds")).cast("bigint")))
    return out


def t_interval(contrast: DataFrame, critical: float = T_CRITICAL_DF9) -> DataFrame:
    """Paired t interval of a contrast (default critical value: ten pairs)."""
    half = F.lit(critical) * F.col("se")
    return contrast.withColumn("t_low", F.col("mean") - half).withColumn("t_high", F.col("mean") + half)


def normal_interval(summary: DataFrame) -> DataFrame:
    """``1.96 * sd / sqrt(n)`` around a mean."""
    half = 1.96 * F.col("sd_sample") / F.sqrt(F.col("n"))
    return summary.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def effect_size(rows: DataFrame, by: Sequence[str], delta: str) -> DataFrame:
    """d_z: mean over sample deviation, null when the deviation is 0."""
    sd = F.stddev_samp(delta)
    return rows.groupBy(*by).agg(F.count(delta).alias("n"), F.avg(delta).alias("mean"), sd.alias("sd_sample"),
                                 F.when(sd > 0, F.avg(delta) / sd).alias("d_z"))


def dose_response(runs: DataFrame, arm: str, seed: str, value: str, baseline: str) -> DataFrame:
    """Mean and deviation per arm with the seed-paired difference to the baseline arm."""
    base = runs.where(F.col(arm) == baseline)
    pairs = (runs.join(base.select(seed, F.col(value).alias("_base")), seed)
             .select(arm, F.col(value).alias("_v"), (F.col(value) - F.col("_base")).alias("_delta")))
    return pairs.groupBy(arm).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"),
        F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("sd_sample"),
        F.avg("_delta").alias("delta"), F.coalesce(F.stddev_samp("_delta"), F.lit(0.0)).alias("delta_sd"))


def arm_means(runs: DataFrame, arm: str, value: str, arms: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One column per arm with its mean."""
    return runs.groupBy(*by).pivot(arm, list(arms)).agg(F.avg(value))


def decompose(means: DataFrame, steps: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Named differences of arm means, such as size, class, source and residual effects."""
    return means.select("*", *[(F.col(a) - F.col(b)).alias(name) for name, (a, b) in steps.items()])


# --- rates -------------------------------------------------------------------

def rate_gap(rates: DataFrame, name: str) -> DataFrame:
    """Ratio and difference of every rate to the first one by name (``k``, ``n`` columns)."""
    first = rates.agg(F.min_by(F.struct(name, "k", "n"), name).alias("_f"))
    p, q = F.col("k") / F.col("n"), F.col("_f.k") / F.col("_f.n")
    return rates.join(first, F.lit(True)).select(
        name, "k", "n", p.alias("rate"), (p - q).alias("gap"),
        F.when(q > 0, p / F.when(q > 0, q)).alias("ratio"))



def binomial_table(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts a binomial of ``n`` trials at rate ``k / n`` can take, and its distribution function.

    Counts less likely than ``LEAST_LIKELY`` of the likeliest are left out, so
    the table has some fifteen standard deviations of rows.
    """
    if k in (0, n):
        return np.array([k]), np.ones(1)
    p, reach = k / n, int(9 * math.sqrt(k * (n - k) / n)) + 10
    counts = np.arange(max(0, k - reach), min(n, k + reach) + 1)
    steps = np.log((n - counts[1:] + 1) / counts[1:] * (p / (1 - p)))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.exp(logs - logs.max())
    likely = weight > LEAST_LIKELY
    total = np.cumsum(weight[likely])
    return counts[likely], total / total[-1]


def binomial_counts(k: int, n: int, seed: str):
    """A column function: the binomial count of a replicate number, by inversion of a counter-based draw."""
    @F.pandas_udf(T.LongType())
    def counted(rep: pd.Series) -> pd.Series:
        counts, upto = binomial_table(k, n)
        u = drawn(seed, rep.to_numpy(), np.zeros(1, np.int64))[:, 0] / PRIME
        return pd.Series(counts[np.minimum(np.searchsorted(upto, u, side="right"), len(counts) - 1)])

    return counted


def ratio_bootstrap(k1: int, n1: int, k2: int, n2: int, spark, reps: int = CLUSTER_REPS, seed: str = "ratio") -> DataFrame:
    """Ratio of two resampled rates: median, 95 % range and their logarithms.

    Both rates are raised by ``RATE_FLOOR``, so that a rate of 0 has a ratio; a
    side without trials makes all columns null.
    """
    rates = [(counts("id") / F.lit(n or None) + RATE_FLOOR)
             for counts, n in ((binomial_counts(k1, n1, f"{seed}:1"), n1), (binomial_counts(k2, n2, f"{seed}:2"), n2))]
    ratios = spark.range(reps).select((rates[0] / rates[1]).alias("_r"))
    out = ratios.agg(F.percentile("_r", F.array(*map(F.lit, (0.5, 0.025, 0.975)))).alias("_q"))
    out = out.select(*[F.get("_q", i).alias(c) for i, c in enumerate(("median_ratio", "low", "high"))])
    floor = F.greatest(F.col("low"), F.when(F.col("low").isNotNull(), F.lit(RATE_FLOOR)))
    return out.withColumns({"log10_median": F.log10("median_ratio"), "log10_low": F.log10(floor), "log10_high": F.log10("high")})


# --- bootstrap over groups ---------------------------------------------------

def bootstrap_sums(groups: DataFrame, group: str, reps: int, seed: str, sums: Sequence[str],
                   by: Sequence[str] = ()) -> DataFrame:
    """Sums of ``reps`` resamples with replacement of the rows of ``groups`` (as many as there are).

    Rows are numbered in digest order; counter-based draws of a (replicate,
    slot) say which row it takes, as in the SQL, whatever the number of rows. A
    task takes a span of replicates and returns one row per replicate, so
    nothing holds a row per (group, replicate), and sums combine map-side. Rows
    above ``BLOCK_GROUPS`` are cut into blocks of that many: a task holds one of
    them, makes all draws of its replicates and adds those that fall into it.
    Integers are summed as such, other numbers as doubles.
    """
    by, sums = list(by), list(sums)
    kinds = dict(groups.dtypes)
    whole = all(kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in sums)
    out = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "rep int", *[f"`{c}` {'bigint' if whole else 'double'}" for c in sums]])
    numbered = hash_rank(groups.select(*by, group, *sums), [group], by, seed, "_at")
    sizes = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    placed = numbered.join(sizes, by or F.lit(True)).select(
        *by, *sums, "_at", "_size", F.expr(f"cast((_at - 1) div {BLOCK_GROUPS} as int)").alias("_block"),
        F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(SPAN_REPS))).alias("_from"))

    def resampled(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        size, block, first = (int(rows[c].iloc[0]) for c in ("_size", "_block", "_from"))
        numbers = np.arange(first, min(first + SPAN_REPS, reps))
        values = np.asfortranarray(rows[sums].to_numpy(np.int64 if whole else np.float64))
        totals = replicate_sums(seed, values, numbers, size, block * BLOCK_GROUPS)
        found = pd.DataFrame(totals, columns=sums)
        return pd.concat([pd.DataFrame({**{c: [rows[c].iloc[0]] * len(numbers) for c in by}, "rep": numbers}), found], axis=1)

    # The number of parts is given: few bytes are long work here, which adaptive execution would put into one task.
    placed = placed.repartition(4 * -(-reps // SPAN_REPS), *by, "_block", "_from")
    drawn = placed.groupBy(*by, "_block", "_from").applyInPandas(resampled, out)
    return drawn.groupBy(*by, "rep").agg(*[F.sum(s).alias(s) for s in sums])


def cluster_rates(groups: DataFrame, group: str, reps: int = CLUSTER_REPS, seed: str = "boot") -> DataFrame:
    """Replicate rates of a cluster bootstrap over per-group (``n``, ``k``); no rows counts as rate 0."""
    return bootstrap_sums(groups, group, reps, seed, ["n", "k"]).select(
        "rep", F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0).alias("rate"))


def percentile_interval(replicates: DataFrame, value: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    v = F.col(value)
    return replicates.groupBy(*by).agg(
        F.avg(v).alias("boot_mean"), F.median(v).alias("boot_median"),
        F.percentile(v, F.lit(alpha / 2)).alias("low"), F.percentile(v, F.lit(1 - alpha / 2)).alias("high"))


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """Inverse normal distribution on small tables."""
    inverse = NormalDist().inv_cdf
    return p.map(lambda x: -math.inf if x <= 0 else math.inf if x >= 1 else inverse(x)).astype("float64")


def _sorted_quantile(values: Column, q: Column) -> Column:
    """Linear interpolation in a sorted array."""
    place = F.greatest(F.lit(0.0), F.least(q, F.lit(1.0))) * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    high = F.least(low + 1, F.size(values) - 1)
    base = F.element_at(values, low + 1)
    return base + (place - low) * (F.element_at(values, high + 1) - base)


def bca_interval(groups: DataFrame, group: str, replicates: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Bias-corrected accelerated interval of a pooled rate.

    The jackknife is each group's counts taken from the totals. The last step
    works on one row and the replicate rates, whose number is fixed.
    """
    totals = groups.agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    n, k = F.col("_n") - F.col("n"), F.col("_k") - F.col("k")
    jack = groups.join(totals, F.lit(True)).select(F.when(n > 0, k / F.when(n > 0, n)).otherwise(0.0).alias("_j"))
    centre = jack.agg(F.avg("_j").alias("_mean"))
    d = F.col("_mean") - F.col("_j")
    moments = jack.join(centre, F.lit(True)).agg(F.sum(d * d * d).alias("_m3"), F.sum(d * d).alias("_m2"))
    accel = F.when(F.col("_m2") > 0, F.col("_m3") / (6.0 * F.pow(F.col("_m2"), F.lit(1.5)))).otherwise(0.0)
    point = totals.select((F.col("_k") / F.col("_n")).alias("rate"))
    rates = replicates.agg(F.array_sort(F.collect_list("rate")).alias("_rates"))
    below = F.size(F.filter("_rates", lambda r: r < F.col("rate")))
    z0 = F.when(below > 0, normal_quantile(below / F.size("_rates"))).otherwise(0.0)
    one = (point.join(moments, F.lit(True)).join(rates, F.lit(True))
           .withColumn("_accel", accel).withColumn("_z0", z0))

    def adjusted(z: float) -> Column:
        shifted = F.col("_z0") + z
        return 1 - normal_tail(F.col("_z0") + shifted / (1 - F.col("_accel") * shifted))

    z = z_quantile(alpha)
    return one.select("rate", F.col("_z0").alias("z0"), F.col("_accel").alias("acceleration"),
                      _sorted_quantile(F.col("_rates"), adjusted(-z)).alias("bca_low"),
                      _sorted_quantile(F.col("_rates"), adjusted(z)).alias("bca_high"))


def leave_top_out(groups: DataFrame, group: str, most: int = 3) -> DataFrame:
    """Pooled rate after dropping the 1..``most`` groups with the largest ``k`` (ties by name)."""
    top = groups.orderBy(F.desc("k"), group).limit(most)
    order = Window.orderBy(F.desc("k"), F.col(group)).rowsBetween(Window.unboundedPreceding, 0)
    running = top.select(F.row_number().over(Window.orderBy(F.desc("k"), F.col(group))).alias("dropped"),
                         F.sum("n").over(order).alias("_dn"), F.sum("k").over(order).alias("_dk"))
    totals = groups.agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    left = running.join(totals, F.lit(True)).select(
        "dropped", (F.col("_n") - F.col("_dn")).alias("n"), (F.col("_k") - F.col("_dk")).alias("k"))
    return left.withColumn("rate", F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0))


def paired_bootstrap(deltas: DataFrame, team: str, delta: str, reps: int = PAIRED_REPS, seed: str = "pair",
                     by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval of the mean of team deltas."""
    ones = deltas.select(*by, team, F.col(delta).alias("_d"), F.lit(1).alias("_one"))
    sums = bootstrap_sums(ones, team, reps, seed, ["_d", "_one"], by)
    return percentile_interval(sums.withColumn("_mean", F.col("_d") / F.col("_one")), "_mean", by)


# --- signed ranks and agreement ----------------------------------------------

def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distribution of the sum of two independent numbers."""
    if min(len(a), len(b)) <= 64:
        return np.convolve(a, b)
    size = len(a) + len(b) - 1
    wide = 1 << (size - 1).bit_length()
    return np.clip(np.fft.irfft(np.fft.rfft(a, wide) * np.fft.rfft(b, wide), wide)[:size], 0.0, None)


def signed_rank_null(ranks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability of every sum of positive ranks when each sign is fair; ``ranks`` are whole numbers.

    Equal ranks make one binomial; distributions are joined in pairs, halving
    their number each time.
    """
    parts = []
    for rank, count in zip(ranks, counts):
        ways = np.zeros(rank * count + 1)
        ways[::rank] = [math.exp(math.lgamma(count + 1) - math.lgamma(i + 1) - math.lgamma(count - i + 1) - count * math.log(2)) for i in range(count + 1)]
        parts.append(ways)
    while len(parts) > 1:
        parts.sort(key=len)
        parts = [_joined(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] / parts[0].sum() if parts else np.ones(1)


_P_VALUES = T.StructType([T.StructField("p_two_sided", T.DoubleType()), T.StructField("p_less", T.DoubleType())])


def _two_sided(less: float, more: float) -> tuple[float, float]:
    return min(1.0, 2 * min(less, more)), float(less)


@F.pandas_udf(_P_VALUES)
def _exact_p(plus: pd.Series, doubled: pd.Series, counts: pd.Series) -> pd.DataFrame:
    """Exact p-values from the doubled mean ranks and how many pairs share each."""
    def one(w: float | None, ranks: np.ndarray | None, n: np.ndarray | None) -> tuple[float | None, float | None]:
        if ranks is None or len(ranks) == 0:
            return None, None
        if sum(n) > EXACT_PAIRS:
            raise ValueError(f"the exact test takes at most {EXACT_PAIRS} pairs that differ; use the normal one")
        ranks, n = np.array(ranks, np.int64), np.array(n, np.int64)
        step = int(np.gcd.reduce(ranks))
        p, at = signed_rank_null(ranks // step, n), round(2 * w) // step
        return _two_sided(p[:at + 1].sum(), p[at:].sum())

    return pd.DataFrame([one(*row) for row in zip(plus, doubled, counts)], columns=["p_two_sided", "p_less"]).astype("float64")


@F.pandas_udf(_P_VALUES)
def _normal_p(n: pd.Series, plus: pd.Series, ties: pd.Series) -> pd.DataFrame:
    """p-values of the normal approximation with tie correction."""
    def one(size: int, w: float, tied: float) -> tuple[float | None, float | None]:
        if size == 0:
            return None, None
        error = math.sqrt((size * (size + 1) * (2 * size + 1) - tied / 2) / 24)
        less = NormalDist().cdf((w - size * (size + 1) / 4) / error)
        return _two_sided(less, 1 - less)

    return pd.DataFrame([one(int(a), float(b), float(c)) for a, b, c in zip(n, plus, ties)], columns=["p_two_sided", "p_less"]).astype("float64")


def signed_rank(rows: DataFrame, by: Sequence[str], delta: str, method: str = "normal") -> DataFrame:
    """Wilcoxon signed-rank test of paired differences.

    Zeros are dropped, ties share their mean rank. ``method`` is the caller's
    choice and comes back with the result: ``normal`` (with tie correction, at
    any size) or ``exact`` (ties included; its distribution is held by one task,
    so more than ``EXACT_PAIRS`` pairs are an error). Equal differences are
    counted first and ranks come from bucket totals, so no task orders all rows.
    """
    if method not in ("normal", "exact"):
        raise ValueError("method must be normal or exact")
    size, above = F.abs(F.col(delta).cast("double")), F.col(delta) > 0
    cells = (rows.where(F.col(delta) != 0).select(*by, size.alias("_abs"), above.alias("_up")).groupBy(*by, "_abs")
             .agg(F.count(F.lit(1)).alias("_n"), F.count_if("_up").alias("_plus")))
    cells = running_total(cells, "_n", "_abs", F.floor(F.log2("_abs") * 64), by, "_lower")
    rank = F.col("_lower") + (F.col("_n") + 1) / 2
    exact = [F.collect_list((2 * rank).cast("bigint")).alias("_doubled"), F.collect_list("_n").alias("_counts")] if method == "exact" else []
    sums = cells.groupBy(*by).agg(
        *exact, F.sum("_n").alias("n"), F.sum(F.col("_plus") * rank).alias("w_plus"), F.sum((F.col("_n") - F.col("_plus")) * rank).alias("w_minus"),
        F.sum(F.col("_n") * (F.col("_n") * F.col("_n") - 1)).cast("double").alias("_ties"))
    if not by:  # an aggregate without groups has a row for no pairs too
        sums = sums.fillna(0, ["n", "w_plus", "w_minus", "_ties"])
    return (sums.withColumn("w", F.least("w_plus", "w_minus"))
            .withColumn("_p", _exact_p("w_plus", "_doubled", "_counts") if exact else _normal_p("n", "w_plus", "_ties"))
            .select(*by, "n", "w_plus", "w_minus", "w", "_p.p_two_sided", "_p.p_less", F.lit(method).alias("method")))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null (not an error) without variance."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def pearson(rows: DataFrame, by: Sequence[str], x: str, y: str, out: str = "pearson") -> DataFrame:
    """Null with fewer than two rows or no variance."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(x, y).alias(out))


def spearman(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks."""
    ranked = average_rank(average_rank(rows, by, x, "_rx"), by, y, "_ry")
    return pearson(ranked, by, "_rx", "_ry", "spearman")


def _inversions(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Weighted pairs with smaller ``x`` and larger ``y``; equal values on either side do not count."""
    order = np.lexsort((y, x))

    def count(at: np.ndarray) -> tuple[float, np.ndarray]:
        if len(at) < 2:
            return 0.0, at
        (a, left), (b, right) = count(at[:len(at) // 2]), count(at[len(at) // 2:])
        larger = np.concatenate([np.cumsum(n[left][::-1])[::-1], [0.0]])
        between = float((larger[np.searchsorted(y[left], y[right], side="right")] * n[right]).sum())
        both = np.concatenate([left, right])
        return a + b + between, both[np.argsort(y[both], kind="stable")]

    return count(order)[0]


def kendall(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Tau-b of two columns per board; pairs are never listed and no task holds a whole board.

    Equal rows are counted first. Both columns are cut at quantiles into
    buckets, a value at a cut being a bucket of its own. Discordant pairs that
    differ in both buckets come from bucket totals, those inside a bucket of
    ``x`` or of ``y`` are counted there, in n log n. Rows with a null take no
    part; a board without two different values on either side has a null tau.
    """
    by = list(by)
    cells = (rows.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
             .groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    cuts = F.array(*[F.lit(i / BOARD_EDGES) for i in range(1, BOARD_EDGES)])
    edges = cells.groupBy(*by).agg(*[F.percentile_approx(c, cuts, F.lit(10_000)).alias(f"{c}e") for c in ("_x", "_y")])

    def bucket(c: str) -> Column:
        below = F.size(F.filter(F.col(f"{c}e"), lambda e: e < F.col(c)))
        return (2 * below + F.array_contains(f"{c}e", F.col(c)).cast("int")).alias(f"{c}b")

    placed = cells.join(edges, by or F.lit(True)).select(*by, "_x", "_y", "_n", bucket("_x"), bucket("_y"))
    total = placed.groupBy(*by).agg(F.sum("_n").alias("_all"))

    def tied(*on: str) -> DataFrame:
        name = "_t" + "".join(on)
        t = placed.groupBy(*by, *on).agg(F.sum("_n").alias("_c")).groupBy(*by)
        return t.agg(F.sum(F.col("_c") * (F.col("_c") - 1) / 2).alias(name))

    schema = ", ".join([*[f"`{c}` {dict(rows.dtypes)[c]}" for c in by], "_d double"])

    def counted(kind: str):
        def one(part: pd.DataFrame) -> pd.DataFrame:
            key = part.iloc[0][by].to_dict() if by else {}
            n = part["_n"].to_numpy()
            if kind == "both":
                d = _inversions(part["_xb"].to_numpy(), part["_yb"].to_numpy(), n)
            else:
                d = _inversions(part["_x"].to_numpy(), part["_y"].to_numpy(), n)
            if kind == "y":  # pairs that share the bucket of x too are counted there
                d -= sum(_inversions(p["_x"].to_numpy(), p["_y"].to_numpy(), p["_n"].to_numpy()) for _, p in part.groupby("_xb"))
            return pd.DataFrame([{**key, "_d": d}])
        return one

    grid = placed.groupBy(*by, "_xb", "_yb").agg(F.sum("_n").alias("_n"))
    # An odd bucket is one value: no pair inside it is discordant.
    inside = [placed.where(F.col(c) % 2 == 0).groupBy(*by, c).applyInPandas(counted(k), schema) for c, k in (("_xb", "x"), ("_yb", "y"))]
    apart = grid.withColumn("_board", F.lit(0)).groupBy(*by, "_board").applyInPandas(counted("both"), schema)
    wrong = apart.unionByName(inside[0]).unionByName(inside[1]).groupBy(*by).agg(F.sum("_d").alias("_d"))
    on = by or F.lit(True)
    out = total.join(tied("_x"), on).join(tied("_y"), on).join(tied("_x", "_y"), on).join(wrong, on, "left")
    pairs = F.col("_all") * (F.col("_all") - 1) / 2
    scale = (pairs - F.col("_t_x")) * (pairs - F.col("_t_y"))
    tau = (pairs - F.col("_t_x") - F.col("_t_y") + F.col("_t_x_y") - 2 * F.coalesce("_d", F.lit(0.0))) / F.sqrt(scale)
    return out.select(*by, F.col("_all").cast("bigint").alias("n"), F.when(scale > 0, tau).alias("kendall"))


def agreement_errors(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """MAE, bias (y - x) and RMSE of values, mean and median absolute rank difference."""
    ranked = average_rank(average_rank(rows, by, x, "_rx"), by, y, "_ry")
    d, r = F.col(y) - F.col(x), F.abs(F.col("_ry") - F.col("_rx"))
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"),
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(r).alias("rank_mae"), F.median(r).alias("rank_median_error"))


# --- nulls and rank uncertainty ----------------------------------------------

def null_trials(trials: DataFrame, original: DataFrame, team: str) -> DataFrame:
    """Per trial: mean and median team delta, Spearman of ranks, ranks changed, extreme shifts.

    ``trials`` holds each team's ``combined`` per ``rep``, ``original`` on all
    rows. Scores that agree to twelve digits are a tie.
    """
    again = trials.select(F.col("rep").alias("trial"), team, F.round("combined", 12).alias("_sub"))
    both = again.join(original.select(team, F.round("combined", 12).alias("_orig")), team)
    ranked = average_rank(average_rank(both, ["trial"], "_orig", "_ro"), ["trial"], "_sub", "_rs")
    delta, shift = F.col("_sub") - F.col("_orig"), F.col("_ro") - F.col("_rs")
    rho = correlation("_ro", "_rs")
    return ranked.groupBy("trial").agg(
        F.count(F.lit(1)).alias("n_teams"), F.avg(delta).alias("mean_delta"), F.median(delta).alias("median_delta"),
        rho.alias("rho"), F.count_if(F.abs(shift) > 1e-9).alias("n_changed"),
        F.min(shift).alias("max_drop"), F.max(shift).alias("max_rise"),
        F.median(F.abs(shift)).alias("median_abs_shift"))


def null_summary(trials: DataFrame, values: Sequence[str] = ("mean_delta", "rho", "n_changed")) -> DataFrame:
    """Mean and 95 % range of each trial value."""
    return trials.agg(F.count(F.lit(1)).alias("n_trials"), *[
        c for v in values for c in (
            F.avg(v).alias(f"{v}_mean"), F.percentile(v, F.lit(0.025)).alias(f"{v}_low"),
            F.percentile(v, F.lit(0.975)).alias(f"{v}_high"))])


def attributable(observed: DataFrame, null: DataFrame) -> DataFrame:
    """Observed mean delta less the null mean, with bounds from the null range only."""
    o = F.col("observed")
    return observed.join(null, F.lit(True)).select(
        "observed", (o - F.col("mean_delta_mean")).alias("attributable"),
        (o - F.col("mean_delta_high")).alias("low"), (o - F.col("mean_delta_low")).alias("high"))


def rank_replicates(scores: DataFrame, team: str) -> DataFrame:
    """``scores`` per ``rep`` with the rank of every team; ties (to twelve digits) by name."""
    return ordinal_rank(scores.withColumn("combined", F.round("combined", 12)), ["rep"], "combined", team)


def rank_ranges(replicates: DataFrame, team: str, top: int = 5) -> DataFrame:
    """Median rank, 95 % range and chance of being in the first ``top``."""
    return replicates.groupBy(team).agg(
        F.median("rank").alias("rank_median"), F.percentile("rank", F.lit(0.025)).alias("rank_low"),
        F.percentile("rank", F.lit(0.975)).alias("rank_high"),
        F.avg((F.col("rank") <= top).cast("double")).alias("top_probability"))


def win_probabilities(replicates: DataFrame, team: str, sure: float = 0.95) -> DataFrame:
    """Team pairs of which one nearly always ranks above the other; the report is one row per pair.

    Ranks of a span of replicates are one array per team, so a pair is compared
    once per span, not once per replicate. Every team has a rank in every replicate.
    """
    spans = (replicates.groupBy(F.floor(F.col("rep") / SPAN_RANKS).alias("_span"), team)
             .agg(F.array_sort(F.collect_list(F.struct("rep", "rank")))["rank"].alias("_ranks")))
    a, b = (spans.select("_span", F.col(team).alias(f"team_{side}"), F.col("_ranks").alias(f"_{side}")) for side in "ab")
    won = F.size(F.filter(F.zip_with("_a", "_b", lambda x, y: x < y), lambda w: w))
    p = F.sum("_won") / F.sum("_n")
    return (a.join(b, "_span").where(F.col("team_a") < F.col("team_b"))
            .select("team_a", "team_b", won.alias("_won"), F.size("_a").alias("_n"))
            .groupBy("team_a", "team_b").agg(p.alias("p_a_above_b"))
            .where((F.col("p_a_above_b") >= sure) | (F.col("p_a_above_b") <= 1 - sure)))


def protocol_gap(scores: DataFrame, model: str, protocol: str, value: str, row_split: str,
                 group_split: str) -> DataFrame:
    """Row-split mean less group-split mean per model."""
    return arm_means(scores, protocol, value, [row_split, group_split], [model]).select(
        model, F.col(row_split).alias("row_split"), F.col(group_split).alias("group_split"),
        (F.col(row_split) - F.col(group_split)).alias("gap"))
