"""Cleaned splits with controls of the same size and composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksift.operators.checks import cell_counts, concat_all
from leaksift.operators.skew import quota_sample
from leaksift.operators.splits import internal_leaks, remove_internal_leaks, threshold_splits


def cleaned_arms(items: DataFrame, *, key: str, label: str, source: str, split: str, distance: str, name: str,
                 words: Sequence[str], threshold: int, restrict: Column | None = None, seed: object = 0,
                 rows: int | None = None) -> DataFrame:
    """The arms of a cleaning study as one table with an ``arm`` column.

    ``cleaned`` drops near copies, ``strict`` also drops held-out rows that share
    a name or exact fingerprint with training, ``random`` has the size of
    ``cleaned`` per split and ``matched`` its class counts too.
    """
    cleaned = threshold_splits(items, distance, (threshold,), restrict).drop("threshold")
    leaks = internal_leaks(items, key=key, name=name, words=words, source=source, split=split, rows=rows)
    sizes = cell_counts(cleaned, [split]).withColumnRenamed("n", "target")
    classes = cell_counts(cleaned, [split, label]).withColumnRenamed("n", "target")
    arms = {
        "cleaned": cleaned,
        "strict": remove_internal_leaks(cleaned, leaks, key),
        "random": quota_sample(items, sizes, [key], [split], f"{seed}:random"),
        "matched": quota_sample(items, classes, [key], [split, label], f"{seed}:matched"),
    }
    return concat_all([arm.select(F.lit(a).alias("arm"), *items.columns) for a, arm in arms.items()])
