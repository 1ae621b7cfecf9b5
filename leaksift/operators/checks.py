"""Merging of run shards, row and cell contracts, claim checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts, columns aligned by name, duplicates kept."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def common_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.select(*on).intersect(right.select(*on))


def left_only_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.select(*on).distinct().join(right.select(*on), list(on), "left_anti")


def seed_status(runs: DataFrame, expected: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every run key with its count and status: ``ok``, ``missing``, ``duplicate`` or ``extra``."""
    got = runs.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    want = expected.select(*on).distinct().withColumn("_want", F.lit(True))
    n = F.coalesce(F.col("_n"), F.lit(0))
    status = (F.when(F.col("_want").isNull(), "extra").when(n == 0, "missing")
              .when(n > 1, "duplicate").otherwise("ok"))
    return got.join(want, list(on), "full").select(*on, n.alias("n"), status.alias("status"))


def strict_merge(parts: Sequence[DataFrame], expected: DataFrame, on: Sequence[str]) -> DataFrame:
    """All runs of all shards; any missing, duplicate or extra run fails the job."""
    runs = concat_all(parts)
    bad = (seed_status(runs, expected, on).where(F.col("status") != "ok")
           .agg(F.count(F.lit(1)).alias("_bad"),
                F.min(F.concat_ws(" ", "status", *[F.col(c).cast("string") for c in on])).alias("_first")))
    check = F.when(F.col("_bad") > 0, F.raise_error(F.concat(F.lit("shards do not merge: "), F.col("_first")))
                   ).otherwise(F.lit("ok"))
    return runs.join(bad, F.lit(True)).where(check == "ok").drop("_bad", "_first")


def tolerant_merge(parts: Sequence[DataFrame], complete: DataFrame | None, expected: DataFrame,
                   on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Runs of all shards, filled from an earlier complete result, and the status of every key."""
    runs = concat_all(parts).dropDuplicates(list(on))
    if complete is not None:
        runs = runs.unionByName(complete.join(runs.select(*on), list(on), "left_anti").select(*runs.columns))
    return runs, seed_status(runs, expected, on)


def metadata_agreement(parts: DataFrame, key: str, value: str) -> DataFrame:
    """Per metadata key: distinct values over parts and whether there is exactly one."""
    return parts.groupBy(key).agg(F.count_distinct(value).alias("n_values")).withColumn(
        "ok", F.col("n_values") == 1)


def contract(actual: DataFrame, expected: DataFrame, on: Sequence[str], value: str = "n") -> DataFrame:
    """Expected against actual counts per file, split or cell; absent counts are 0."""
    a = actual.select(*on, F.col(value).alias("_actual"))
    e = expected.select(*on, F.col(value).alias("_expected"))
    got, want = F.coalesce(F.col("_actual"), F.lit(0)), F.coalesce(F.col("_expected"), F.lit(0))
    return a.join(e, list(on), "full").select(
        *on, got.alias("actual"), want.alias("expected"), (got == want).alias("ok"))


def cell_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def claims(observed: DataFrame, expected: DataFrame, on: str = "claim") -> DataFrame:
    """Observed against expected values within a tolerance; NaN and missing values fail."""
    joined = expected.select(on, F.col("value").alias("expected"), "tolerance").join(
        observed.select(on, F.col("value").alias("observed")), on, "left")
    gap = F.abs(F.col("observed") - F.col("expected"))
    finite = F.col("observed").isNotNull() & ~F.isnan("observed") & (F.abs("observed") < float("inf"))
    return joined.withColumn("ok", F.coalesce(finite & (gap <= F.col("tolerance")), F.lit(False)))


def equal_claims(observed: DataFrame, expected: DataFrame, on: str = "claim") -> DataFrame:
    """Claims of exact equality over any comparable value."""
    joined = expected.select(on, F.col("value").alias("expected")).join(
        observed.select(on, F.col("value").alias("observed")), on, "left")
    return joined.withColumn("ok", F.col("observed").eqNullSafe(F.col("expected")))


def scorecard(sections: dict[str, DataFrame]) -> DataFrame:
    """One long table (section, metric, value) out of several metric tables."""
    return concat_all([df.select(F.lit(name).alias("section"), F.col("metric"), F.col("value").cast("double").alias("value"))
                       for name, df in sections.items()])


def long_form(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Columns to rows: keys, ``metric``, ``value``."""
    entries = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return df.select(*keys, F.inline(F.array(*entries)))


def preflight(listing: DataFrame, required: DataFrame, kind: str = "kind") -> DataFrame:
    """Files per required kind against a minimum."""
    have = listing.groupBy(kind).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    return required.join(have, kind, "left").select(
        kind, n.alias("n"), "minimum", (n >= F.col("minimum")).alias("ok"))


def provenance(results: DataFrame, known: DataFrame, digest: str) -> DataFrame:
    """Recorded digests that no known input has; an empty digest counts as unknown."""
    return results.join(known.select(digest).distinct(), digest, "left_anti")


def require(df: DataFrame, ok: Column, message: str | Column) -> DataFrame:
    """The rows again; the first one failing ``ok`` fails the job."""
    message = F.lit(message) if isinstance(message, str) else message
    check = F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(message)).otherwise(F.lit("ok"))
    return df.where(check == "ok")


def metric_status(official: Column, again: Column, tolerance: float = 1e-6, name: Column | None = None,
                  allowed: Sequence[str] = ()) -> Column:
    """Status of a re-scored row: excluded without either score, ``drift`` beyond the tolerance.

    With ``allowed``, the drift of a row whose ``name`` is listed is expected and called ``excluded_known_drift``.
    """
    drift = F.lit("drift") if name is None else F.when(name.isin(*allowed), "excluded_known_drift").otherwise("drift")
    return (F.when(official.isNull(), "excluded_no_official_score")
            .when(again.isNull(), "excluded_no_reproduction")
            .when(F.abs(official - again) > tolerance, drift).otherwise("ok"))


def without_drift(rows: DataFrame, status: str = "status", name: str = "name") -> DataFrame:
    """The rows again; drift outside the allowed list fails the job and names its row."""
    return require(rows, ~F.col(status).eqNullSafe("drift"), F.concat(F.lit("score does not reproduce: "), F.coalesce(F.col(name).cast("string"), F.lit("?"))))
