"""Classification metrics and leaderboards over derived predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaksift.operators.lookups import check_alignment
from leaksift.operators.metrics import (class_recall, combined_scores, confusion, confusion_matrix,
                                        effective_number_weights, filter_pass_rate, mean_auc, membership_auc,
                                        one_vs_rest_auc, replay, select_runs, source_balanced,
                                        subset_balanced_accuracy)
from leaksift.operators.ranks import (average_rank, extremes, last_row, ordinal_rank, rank_shift, shift_summary,
                                      top_overlap)
from leaksift.operators.skew import first_per_key
from leaksift.plans.rescore import rescore
from leaksift.queries.base import (CLASSES, PREDICTIONS, Registry, auc_sql, kept, label_metrics_sql, predictions,
                                   rounded, table)
from leaksift.session import materialise

registry = Registry()
LABEL_COLUMNS = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "null_accuracy")
_LABELS = ", ".join(f"round({c},9) {c}" for c in LABEL_COLUMNS)


def scored(spark, sf):
    """Predictions, kept once: label metrics and AUC both read them."""
    return kept(spark, sf, "predictions", lambda: predictions(spark, sf), of="embeddings")


def combined_sql(name, keys, absent, rows="pred", longs="long", weight="1"):
    area = {"zero": "avg(coalesce(auc,0))", "skip": "avg(auc)"}[absent]
    return f"""{label_metrics_sql(name + '_l', keys, rows, weight)},
{auc_sql(name + '_a', keys, longs, weight)},
{name}_m AS (SELECT {keys}, {area} mean_auc FROM {name}_a GROUP BY {keys}),
{name} AS (SELECT *, (mean_auc+balanced_accuracy)/2 AS combined FROM {name}_l JOIN {name}_m USING ({keys}))"""


@registry.add(f"""{PREDICTIONS}, {combined_sql('s', 'team', 'zero')}
SELECT team, n, {_LABELS}, n_present, round(mean_auc,9) mean_auc, round(combined,9) combined FROM s""")
def multiclass_scores(spark, sf):
    """Label metrics, mean AUC and combined score per team."""
    return rounded(combined_scores(scored(spark, sf), ["team"], "zero"), *LABEL_COLUMNS, "mean_auc", "combined")


@registry.add(f"""{PREDICTIONS}, {combined_sql('s', 'team, source', 'skip')}
SELECT team, source, n, {_LABELS}, n_present, round(mean_auc,9) mean_auc, round(combined,9) combined FROM s""")
def source_scores(spark, sf):
    """The same per team and source, over present classes."""
    return rounded(combined_scores(scored(spark, sf), ["team", "source"], "skip"), *LABEL_COLUMNS, "mean_auc", "combined")


@registry.add(f"""{PREDICTIONS}, {combined_sql('s', 'team, source', 'skip')}
SELECT team, count(*) n_sources, round(avg(balanced_accuracy),9) source_balanced_accuracy, round(avg(mean_auc),9) source_balanced_auc,
 round(avg(combined),9) source_balanced_combined FROM s GROUP BY 1""")
def source_balanced_scores(spark, sf):
    """Unweighted means over sources."""
    out = source_balanced(scored(spark, sf), ["team"], "source")
    return rounded(out, "source_balanced_accuracy", "source_balanced_auc", "source_balanced_combined")


@registry.add(f"""{PREDICTIONS}, {auc_sql('a', 'team')} SELECT team, label, n_pos, n_neg, round(auc,9) auc FROM a""")
def class_auc(spark, sf):
    """One-vs-rest AUC of every class and team, ties at half credit."""
    return rounded(one_vs_rest_auc(predictions(spark, sf), ["team"]), "auc")


_RECALL = """r AS (SELECT t.team, l AS label, coalesce(n,0) n, recall FROM (SELECT DISTINCT team FROM pred) t CROSS JOIN (SELECT unnest(range(11))::INTEGER l)
 LEFT JOIN (SELECT team, y l, count(*) n, avg((y=pred)::INTEGER) recall FROM pred GROUP BY 1,2) USING (team, l))"""


def _recalls(spark, sf):
    rows = scored(spark, sf)
    classes = spark.range(CLASSES + 1).select(F.col("id").cast("int").alias("label"))
    return class_recall(confusion(rows, ["team"]), ["team"], classes, rows)


@registry.add(f"{PREDICTIONS}, {_RECALL} SELECT team, label, n, round(recall,9) recall FROM r")
def class_recalls(spark, sf):
    """Recall per class; a class nobody has is null, not zero."""
    return rounded(_recalls(spark, sf), "recall")


@registry.add(f"{PREDICTIONS}, {_RECALL} SELECT team, round(avg(recall),9) subset_balanced_accuracy FROM r WHERE label IN (1,3,5,7) GROUP BY 1")
def subset_recalls(spark, sf):
    """Balanced accuracy over kept classes."""
    return rounded(subset_balanced_accuracy(_recalls(spark, sf), ["team"], F.col("label").isin(1, 3, 5, 7)),
                   "subset_balanced_accuracy")


@registry.add(f"{PREDICTIONS} SELECT team, y, pred, count(*) n FROM pred GROUP BY 1,2,3")
def confusion_cells(spark, sf):
    return confusion(predictions(spark, sf), ["team"])


@registry.add(f"{PREDICTIONS} SELECT team, y, " + ", ".join(f"count(*) FILTER (WHERE pred={c}) pred_{c}" for c in range(CLASSES))
              + " FROM pred GROUP BY 1,2")
def confusion_square(spark, sf):
    return confusion_matrix(predictions(spark, sf), ["team"], range(CLASSES))


@registry.add(f"""{PREDICTIONS}, top AS (SELECT team, vec_id, part<5 AS member, max(score) s FROM long GROUP BY 1,2,3)
SELECT a.team, max(n.p) n_pos, max(n.q) n_neg, round(sum(CASE WHEN a.s>b.s THEN 1.0 WHEN a.s=b.s THEN 0.5 ELSE 0 END)/count(*),9)::DOUBLE auc
FROM top a JOIN top b ON a.team=b.team AND a.member AND NOT b.member
JOIN (SELECT team, count(*) FILTER (WHERE member) p, count(*) FILTER (WHERE NOT member) q FROM top GROUP BY 1) n ON n.team=a.team GROUP BY 1""")
def member_auc(spark, sf):
    """How well the top score tells members from others, against all pairs."""
    return rounded(membership_auc(predictions(spark, sf), ["team"], F.col("part") < 5), "auc")


@registry.add(f"""{PREDICTIONS}, s AS (SELECT team, vec_id, sum(score) t FROM long GROUP BY 1,2),
h AS (SELECT team, vec_id, -sum(greatest(score/t,1e-8)*ln(greatest(score/t,1e-8))) h FROM long JOIN s USING (team, vec_id) GROUP BY 1,2)
SELECT team, count(*) n, round(avg(h),9) mean_entropy, round(avg((h<0.9*ln(10.0))::INTEGER),9) pass_rate FROM h GROUP BY 1""")
def entropy_pass_rate(spark, sf):
    """Share of rows whose entropy passes the filter."""
    rows = predictions(spark, sf).withColumn("_t", F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)) \
        .withColumn("probs", F.transform("scores", lambda x: x / F.col("_t")))
    return rounded(filter_pass_rate(rows, ["team"], "probs", 0.9, CLASSES), "mean_entropy", "pass_rate")


@registry.add(f"""{PREDICTIONS}, {combined_sql('s', 'team', 'zero')},
rec AS (SELECT team, CASE WHEN team='team2' THEN n+1 ELSE n END AS n, balanced_accuracy, CASE WHEN team='team3' THEN mean_auc+1e-6 ELSE mean_auc END AS mean_auc,
 CASE WHEN team='team4' THEN combined*(1+1e-9) ELSE combined END AS combined FROM s UNION ALL SELECT 'team9', n, balanced_accuracy, mean_auc, combined FROM s WHERE team='team0')
SELECT rec.team, rec.n, round(rec.combined,9) combined, coalesce(rec.n=s.n AND abs(rec.mean_auc-s.mean_auc)<=1e-12 AND abs(rec.combined-s.combined)<=1e-12, FALSE) AS ok
FROM rec LEFT JOIN s USING (team)""")
def metric_replay(spark, sf):
    """Recorded scores recomputed from confusion cells and class AUCs; some records are altered, one team has no rows."""
    rows = scored(spark, sf)
    true = materialise(combined_scores(rows, ["team"], "zero").select("team", "n", "balanced_accuracy", "mean_auc", "combined"))
    at = lambda team, value, column: F.when(F.col("team") == team, value).otherwise(F.col(column)).alias(column)
    recorded = true.select("team", at("team2", F.col("n") + 1, "n"), "balanced_accuracy", at("team3", F.col("mean_auc") + 1e-6, "mean_auc"),
                           at("team4", F.col("combined") * (1 + 1e-9), "combined"))
    recorded = recorded.unionByName(true.where(F.col("team") == "team0").withColumn("team", F.lit("team9")))
    out = replay(confusion(rows, ["team"]), one_vs_rest_auc(rows, ["team"]), recorded, ["team"])
    return rounded(out.select("team", "n", "combined", "ok"), "combined")


@registry.add("""WITH c AS (SELECT l AS label, count(e.label) n FROM (SELECT unnest(range(11))::INTEGER l) LEFT JOIN embeddings e ON e.label=l GROUP BY 1),
w AS (SELECT label, n, CASE WHEN n>0 THEN 0.001/(1-pow(0.999,n)) ELSE 0.001 END raw FROM c)
SELECT label, n, round(CASE WHEN n>0 THEN raw/(SELECT sum(raw) FROM w)*11 ELSE 0.0 END,9)::DOUBLE weight FROM w""")
def class_weights(spark, sf):
    """Effective-number weights of the label classes, an empty one included."""
    counts = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    classes = spark.range(CLASSES + 1).select(F.col("id").cast("int").alias("label"))
    full = classes.join(counts, "label", "left").select("label", F.coalesce("_n", F.lit(0)).alias("n"))
    return rounded(effective_number_weights(full), "weight")


@registry.add("""WITH h AS (SELECT l_suppkey run, l_linenumber epoch, round(avg(l_discount),9) v FROM lineitem GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) late FROM h)
SELECT run, max(v) best, max(v) FILTER (WHERE late=1) AS last, round(avg(v) FILTER (WHERE late<=3),9) last_mean,
 coalesce(max(v) FILTER (WHERE epoch=4), max(v) FILTER (WHERE late=1)) fixed FROM r GROUP BY 1""")
def run_selection(spark, sf):
    """Best, last, mean-of-last and fixed-epoch value per run."""
    history = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch")).agg(
        F.round(F.avg("l_discount"), 9).alias("v"))
    return rounded(select_runs(history, ["run"], "v", fixed=4), "last_mean")


@registry.add(f"""{PREDICTIONS}, p AS (SELECT team, vec_id FROM pred WHERE NOT (team='team1' AND part=3) AND (part<>5 OR team='team3') UNION ALL SELECT team, vec_id FROM pred WHERE team='team2' AND part=1),
t AS (SELECT vec_id FROM items WHERE part<>5), g AS (SELECT team, vec_id, count(*) c FROM p GROUP BY 1,2),
o AS (SELECT team, (SELECT count(*) FROM t)-count(t.vec_id) AS n_missing, count(*)-count(t.vec_id) AS n_unexpected, count(*) FILTER (WHERE c>1) AS n_repeated FROM g LEFT JOIN t USING (vec_id) GROUP BY 1)
SELECT *, n_missing=0 AND n_unexpected=0 AND n_repeated=0 AS aligned FROM o""")
def sheet_alignment(spark, sf):
    """Missing, unexpected and repeated rows per team against the reference keys; one team each has some, the rest none."""
    rows = predictions(spark, sf)
    truth = rows.where((F.col("team") == "team0") & (F.col("part") != 5)).select("vec_id")
    team, part = F.col("team"), F.col("part")
    sheets = rows.where(~((team == "team1") & (part == 3)) & ((part != 5) | (team == "team3")))
    return check_alignment(sheets.unionByName(rows.where((team == "team2") & (part == 1))), truth, "team", "vec_id")


# --- leaderboards --------------------------------------------------------------

def boards(spark, sf):
    """Combined scores per team on all rows and on a subset of them."""
    rows = scored(spark, sf)
    return (combined_scores(rows, ["team"], "zero").select("team", "combined"),
            combined_scores(rows.where(F.col("part") < 2), ["team"], "zero").select("team", "combined"))


BOARDS = f"""{PREDICTIONS}, sub_pred AS (SELECT * FROM pred WHERE part<2),
sub_long AS (SELECT * FROM long WHERE part<2), {combined_sql('o', 'team', 'zero')}, {combined_sql('u', 'team', 'zero', 'sub_pred', 'sub_long')},
ro AS (SELECT team, rank() OVER (ORDER BY combined DESC) + (count(*) OVER (PARTITION BY combined)-1)/2 AS r FROM o),
ru AS (SELECT team, rank() OVER (ORDER BY combined DESC) + (count(*) OVER (PARTITION BY combined)-1)/2 AS r FROM u)"""


def _shifts(spark, sf):
    before, after = boards(spark, sf)
    return rank_shift(average_rank(before, [], "combined"), average_rank(after, [], "combined"), ["team"])


@registry.add(f"""{BOARDS} SELECT team, u.n, round(o.combined,9) combined_all, round(u.combined,9) combined_subset, ro.r rank_all, ru.r rank_subset,
 round(u.combined-o.combined,9) delta, ro.r-ru.r shift FROM o JOIN u USING (team) JOIN ro USING (team) JOIN ru USING (team)""")
def rescored_teams(spark, sf):
    """Scores, ranks and changes of every team when only a subset counts."""
    rows = scored(spark, sf)
    keep = rows.where((F.col("team") == "team0") & (F.col("part") < 2)).select("vec_id")
    return rounded(rescore(rows, keep, team="team", item="vec_id"), "combined_all", "combined_subset", "delta")


@registry.add(f"{BOARDS} SELECT team, ro.r rank_before, ru.r rank_after, ro.r-ru.r shift FROM ro JOIN ru USING (team)")
def team_rank_shift(spark, sf):
    """Average ranks on all rows and on a subset."""
    return _shifts(spark, sf)


@registry.add(f"""{BOARDS}, s AS (SELECT ro.r-ru.r s FROM ro JOIN ru USING (team))
SELECT count(*) n, count(*) FILTER (WHERE abs(s)>1e-9) n_changed, count(*) FILTER (WHERE abs(s)>=3) n_far, max(s) max_rise, min(s) max_drop,
 median(abs(s)) median_abs_shift FROM s""")
def rank_shift_summary(spark, sf):
    return shift_summary(_shifts(spark, sf))


@registry.add(f"{BOARDS} SELECT count(*) AS overlap FROM ro JOIN ru USING (team) WHERE ro.r<=3 AND ru.r<=3")
def top_team_overlap(spark, sf):
    """Teams in the first three of both boards."""
    before, after = boards(spark, sf)
    return top_overlap(ordinal_rank(before, [], "combined", "team"), ordinal_rank(after, [], "combined", "team"), ["team"], 3)


@registry.add("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1")
def last_event(spark, sf):
    """The last row per key."""
    return last_row(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@registry.add("SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey)=1")
def first_line(spark, sf):
    """The first row per key wins."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    return first_per_key(lines, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"])


@registry.add("""WITH c AS (SELECT user_id, round(count(*) FILTER (WHERE event_type='error')/count(*),9) fraction FROM events GROUP BY 1)
(SELECT *, 'top' AS side FROM c ORDER BY fraction DESC, user_id LIMIT 10) UNION ALL (SELECT *, 'bottom' FROM c ORDER BY fraction, user_id LIMIT 10)""")
def extreme_users(spark, sf):
    """The ten most and ten least covered users."""
    share = F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))
    per_user = table(spark, sf, "events").groupBy("user_id").agg(F.round(share, 9).alias("fraction"))
    return extremes(per_user, "fraction", "user_id")


QUERIES, SQL = registry.queries, registry.sql
__all__ = ["BOARDS", "QUERIES", "SQL", "boards", "combined_sql", "mean_auc", "scored"]
