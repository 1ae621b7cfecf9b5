"""Re-scoring of prediction tables on any subset of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksift.operators.metrics import combined_scores
from leaksift.operators.ranks import average_rank


def rescore(scored: DataFrame, keep: DataFrame, *, team: str, item: str, absent: str = "zero") -> DataFrame:
    """Combined score and rank of every team on all items and on ``keep``, with the changes."""
    before = combined_scores(scored, [team], absent).select(team, F.col("combined").alias("combined_all"))
    subset = scored.join(keep.select(item), item, "left_semi")
    after = combined_scores(subset, [team], absent).select(team, "n", F.col("combined").alias("combined_subset"))
    both = average_rank(average_rank(before.join(after, team), [], "combined_all", "rank_all"), [], "combined_subset", "rank_subset")
    return (both.withColumn("delta", F.col("combined_subset") - F.col("combined_all"))
            .withColumn("shift", F.col("rank_all") - F.col("rank_subset")))
