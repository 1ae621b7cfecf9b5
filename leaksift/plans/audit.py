"""Audit of one fingerprinted corpus: how much of the held-out part is in training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksift.operators.pairs import flagged_fingerprints, nearest_within
from leaksift.operators.rates import duplicate_groups, leak_rate, source_split_counts, threshold_counts
from leaksift.operators.skew import by_shuffle
from leaksift.session import materialise


def leakage_audit(items: DataFrame, *, key: str, words: Sequence[str], source: str, label: str, split: str,
                  rows: int, radius: int = 6, thresholds: Sequence[int] = (0, 2, 6),
                  modes: Sequence[str] = ("independent", "same_row", "additive")) -> dict[str, DataFrame]:
    """Counts, leak rates per class and per source, every joint reading, and duplicate groups.

    Nearest neighbours are found once per distinct fingerprint and kept; all
    tables are aggregates over (fingerprint, source, class) counts.
    """
    words = list(words)
    train, held = items.where(F.col(split) == "training"), items.where(F.col(split) == "validation")
    near = materialise(nearest_within(held, train, words=words[:1], radius=max(radius, *thresholds), rows=rows, ref_key=key))
    cells = materialise(held.groupBy(source, label, *words).agg(F.count(F.lit(1)).alias("n_rows"))
                        .join(by_shuffle(near.select(words[0], "distance")), words[0], "left"))
    out = {
        "counts": source_split_counts(items, [source, split]),
        "by_class": threshold_counts(cells, "distance", thresholds, [label], "n_rows"),
        "by_source": threshold_counts(cells, "distance", thresholds, [source], "n_rows"),
        "duplicates": duplicate_groups(items, words, [source]),
        "unhashed": items.groupBy(source).agg(F.count_if(F.col(words[0]).isNull()).alias("n_unhashed")),
    }
    for mode in modes:
        hit = flagged_fingerprints(held, train, mode, words=words, radius=radius, rows=rows, ref_key=key)
        marked = cells.join(hit.withColumn("hit", F.lit(True)), words, "left")
        out[mode] = leak_rate(marked.withColumn("hit", F.coalesce("hit", F.lit(False))), "hit", [source], "n_rows")
    return out
