"""Classification metrics over prediction tables.

Rows carry key columns (team, source, trial ...), the true class ``y``, the
predicted class ``pred``, class ``scores`` and an optional integer weight. Label
metrics come from confusion cells, one small aggregate however many rows there
are; AUC comes from counts per distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaksift.functions.keys import entropy
from leaksift.operators.skew import running_total

ABSENT = ("zero", "skip", "null")


def confusion(rows: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Cells ``y``, ``pred``, ``n``."""
    one = F.col(weight) if weight else F.lit(1)
    return rows.groupBy(*by, "y", "pred").agg(F.sum(one).cast("bigint").alias("n"))


def confusion_matrix(rows: DataFrame, by: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """Square form: one row per true class, one column per predicted class, zeros filled."""
    counts = [F.count_if(F.col("pred") == c).alias(f"pred_{c}") for c in classes]
    return rows.groupBy(*by, "y").agg(*counts)


def class_counts(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per class over the union of true and predicted labels: support, predicted, hits."""
    sides = cells.select(*by, F.inline(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")))))
    return sides.groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))


def label_metrics(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy, balanced accuracy (over present classes), macro and weighted F1, null accuracy.

    With a single present class the balanced accuracy is the plain accuracy.
    """
    f1 = F.when(F.col("support") + F.col("predicted") > 0,
                2 * F.col("hits") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support"))
    return class_counts(cells, by).withColumn("_f1", f1).withColumn("_recall", recall).groupBy(*by).agg(
        F.sum("support").alias("n"), (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("_recall").alias("balanced_accuracy"), F.avg("_f1").alias("macro_f1"),
        (F.sum(F.col("_f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        (F.max("support") / F.sum("support")).alias("null_accuracy"),
        F.count_if(F.col("support") > 0).alias("n_present"))


def class_recall(cells: DataFrame, by: Sequence[str], classes: DataFrame, groups: DataFrame) -> DataFrame:
    """Recall and n for every listed class of every group; null recall where n is 0."""
    grid = groups.select(*by).distinct().join(classes.select("label"), F.lit(True))
    counts = class_counts(cells, by)
    n = F.coalesce(F.col("support"), F.lit(0))
    return grid.join(counts, [*by, "label"], "left").select(
        *by, "label", n.alias("n"), F.when(n > 0, F.col("hits") / n).alias("recall"))


def subset_balanced_accuracy(recalls: DataFrame, by: Sequence[str], keep: Column) -> DataFrame:
    """Mean recall over kept classes with support."""
    return recalls.where(keep).groupBy(*by).agg(F.avg("recall").alias("subset_balanced_accuracy"))


def score_bucket(score: Column) -> Column:
    """A bucket number that never decreases with a probability; fine near both ends."""
    logit = F.ln(score / (1 - score))
    return (F.when(score <= 0, -5000).when(score >= 1, 5000)
            .otherwise(F.floor(logit * 64)).cast("int"))


def binary_auc(rows: DataFrame, by: Sequence[str], score: str, positive: Column,
               weight: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Area under the ROC curve per group, ties at half credit; null with one label value.

    Rows are first counted per distinct score. The negatives below a score are
    bucket totals plus a window inside one bucket, so neither a group with
    most of the rows nor one very common score meets a single task.
    """
    one = F.col(weight) if weight else F.lit(1)
    counts = rows.groupBy(*by, score).agg(
        F.sum(F.when(positive, one).otherwise(0)).alias("_pos"),
        F.sum(F.when(positive, 0).otherwise(one)).alias("_neg"))
    bucket = score_bucket(F.col(score)) if bucket is None else bucket
    ranked = running_total(counts, "_neg", score, bucket, by, "_below")
    gain = F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)
    return (ranked.groupBy(*by)
            .agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.sum(gain).alias("_gain"))
            .withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                                      F.col("_gain") / (F.col("n_pos") * F.col("n_neg"))))
            .drop("_gain"))


def one_vs_rest_auc(rows: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """AUC of every class score against the rest: ``label``, ``n_pos``, ``n_neg``, ``auc``."""
    carried = [weight] if weight else []
    long = rows.select(*by, "y", *carried, F.posexplode("scores").alias("label", "score"))
    return binary_auc(long, [*by, "label"], "score", F.col("y") == F.col("label"), weight)


def mean_auc(aucs: DataFrame, by: Sequence[str], absent: str) -> DataFrame:
    """Mean class AUC; a class with one label value is ``zero``, ``skip`` or makes the mean ``null``."""
    if absent not in ABSENT:
        raise ValueError(f"absent must be one of {ABSENT}")
    value = {"zero": F.avg(F.coalesce(F.col("auc"), F.lit(0.0))), "skip": F.avg("auc"),
             "null": F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc"))}[absent]
    return aucs.groupBy(*by).agg(value.alias("mean_auc"))


def combined_scores(rows: DataFrame, by: Sequence[str], absent: str, weight: str | None = None) -> DataFrame:
    """Label metrics, mean AUC and their ``combined`` mean with the balanced accuracy."""
    labels = label_metrics(confusion(rows, by, weight), by)
    areas = mean_auc(one_vs_rest_auc(rows, by, weight), by, absent)
    return labels.join(areas, list(by)).withColumn(
        "combined", (F.col("mean_auc") + F.col("balanced_accuracy")) / 2)


def source_balanced(rows: DataFrame, by: Sequence[str], source: str) -> DataFrame:
    """Unweighted mean over sources of the balanced accuracy and of the present-class combined score."""
    per_source = combined_scores(rows, [*by, source], "skip")
    return per_source.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.avg("balanced_accuracy").alias("source_balanced_accuracy"),
        F.avg("mean_auc").alias("source_balanced_auc"),
        F.avg("combined").alias("source_balanced_combined"))


def membership_auc(rows: DataFrame, by: Sequence[str], member: Column) -> DataFrame:
    """How well the largest score tells members from non-members."""
    return binary_auc(rows.withColumn("_top", F.array_max("scores")), by, "_top", member)


def filter_pass_rate(rows: DataFrame, by: Sequence[str], probs: str, alpha: float, classes: int) -> DataFrame:
    """Share of rows whose entropy is below ``alpha * ln(classes)``, with the mean entropy."""
    h = entropy(F.col(probs))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(h).alias("mean_entropy"),
        F.avg((h < alpha * F.ln(F.lit(float(classes)))).cast("double")).alias("pass_rate"))


def replay(cells: DataFrame, aucs: DataFrame, recorded: DataFrame, by: Sequence[str],
           tolerance: float = 1e-12) -> DataFrame:
    """Metrics recomputed from confusion cells against recorded ones."""
    again = (label_metrics(cells, by).join(mean_auc(aucs, by, "null"), list(by))
             .withColumn("combined", (F.col("mean_auc") + F.col("balanced_accuracy")) / 2))
    checked = again.select(*by, *[F.col(c).alias(f"again_{c}") for c in ("n", "balanced_accuracy", "mean_auc", "combined")])
    ok = F.lit(True)
    for c in ("n", "balanced_accuracy", "mean_auc", "combined"):
        ok = ok & (F.abs(F.col(f"again_{c}") - F.col(c)) <= tolerance)
    return recorded.join(checked, list(by), "left").withColumn("ok", F.coalesce(ok, F.lit(False)))


def effective_number_weights(counts: DataFrame, n: str = "n", beta: float = 0.999) -> DataFrame:
    """Class weights ``(1-beta)/(1-beta**n)`` scaled to sum to the number of classes; 0 for empty ones.

    An empty class counts as weight ``1-beta`` in the scaling. ``counts`` has one
    row per class.
    """
    raw = F.when(F.col(n) > 0, (1 - beta) / (1 - F.pow(F.lit(beta), F.col(n)))).otherwise(1 - beta)
    scaled = counts.withColumn("_raw", raw)
    total = scaled.agg(F.sum("_raw").alias("_sum"), F.count(F.lit(1)).alias("_k"))
    return (scaled.join(total, F.lit(True))
            .withColumn("weight", F.when(F.col(n) > 0, F.col("_raw") / F.col("_sum") * F.col("_k")).otherwise(0.0))
            .drop("_raw", "_sum", "_k"))


def select_runs(history: DataFrame, run: Sequence[str], value: str, epoch: str = "epoch",
                fixed: int = 10, tail: int = 3) -> DataFrame:
    """Per run: best and last value, mean of the last ``tail`` epochs, value at a fixed epoch or the last."""
    late = Window.partitionBy(*run).orderBy(F.desc(epoch))
    ranked = history.withColumn("_late", F.row_number().over(late))
    return ranked.groupBy(*run).agg(
        F.max(value).alias("best"), F.min_by(value, "_late").alias("last"),
        F.avg(F.when(F.col("_late") <= tail, F.col(value))).alias("last_mean"),
        F.coalesce(F.max(F.when(F.col(epoch) == fixed, F.col(value))), F.min_by(value, "_late")).alias("fixed"))
