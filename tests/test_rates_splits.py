"""Rates, lookups and samples on small hand tables, including hot keys."""

import pytest
from pyspark.sql import functions as F

from leaksift.operators import checks, lookups, rates, skew, splits


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_salted_lookup_splits_a_hot_key(spark):
    items = spark.range(3000).withColumn("k", F.when(F.col("id") < 1500, 0).otherwise(F.col("id")))
    items = items.withColumn("k", F.when(F.col("id") == 2999, None).otherwise(F.col("k")))
    table = spark.range(0, 2000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = skew.salted_lookup(items, table, ["k"], ["id"], rows_per_task=100)
    want = items.join(table, "k", "left")
    assert rows(got.select("id", "v")) == rows(want.select("id", "v")) and got.count() == 3000


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_hash_rank_and_quota(spark, monkeypatch, small):
    monkeypatch.setattr(skew, "SMALL_INPUT_BYTES", small)
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))))
    ranked = skew.hash_rank(df, ["id"], ["g"], "s").toPandas()
    for _, part in ranked.groupby("g"):
        assert sorted(part.position) == list(range(1, len(part) + 1))
    targets = df.select("g").distinct().withColumn("target", F.when(F.col("g") == "hot", 321).otherwise(5000))
    sample = skew.quota_sample(df, targets, ["id"], ["g"], "s").toPandas()
    want = ranked[(ranked.g != "hot") | (ranked.position <= 321)]
    assert set(sample.id) == set(want.id) and len(sample) == len(want)
    assert skew.quota_sample(df, 77, ["id"], seed="s").count() == 77
    assert skew.quota_sample(df, 0, ["id"], seed="s").count() == 0


def test_stratified_sample_short_of_rows_fails(spark):
    df = spark.range(10).withColumn("g", F.lit("a"))
    targets = spark.createDataFrame([("a", 11)], "g string, target int")
    with pytest.raises(Exception, match="short of rows"):
        splits.stratified_subset(df, targets, "id", ["g"], 1).collect()


def test_running_total_crosses_buckets(spark):
    df = spark.createDataFrame([("a", i / 10, i) for i in range(10)], "g string, s double, v bigint")
    out = skew.running_total(df, "v", "s", F.floor(F.col("s") * 3), ["g"], "below").orderBy("s").toPandas()
    assert out.below.tolist() == [sum(range(i)) for i in range(10)]


def test_published_threshold_ladder(spark):
    """1,381 exact, 3,182 within 2, 6,352 within 6 and 11,190 within 10 of 11,581."""
    counts = [(0, 1381), (2, 1801), (6, 3170), (10, 4838), (20, 391)]
    df = spark.createDataFrame(counts, "distance int, w int")
    out = {r.threshold: (r.k, round(r.rate, 4)) for r in rates.threshold_counts(df, "distance", (0, 2, 6, 10, 20), weight="w").collect()}
    assert out == {0: (1381, 0.1192), 2: (3182, 0.2748), 6: (6352, 0.5485), 10: (11190, 0.9662), 20: (11581, 1.0)}


def test_histogram_shows_what_no_bin_holds(spark):
    df = spark.createDataFrame([(6,), (None,), (99,)], "d int")
    assert rows(rates.histogram(df, "d", (0, 6, 10))) == [("6,10", 1), ("outside", 2)]


def test_full_coverage_counts_from_99_percent(spark):
    df = spark.createDataFrame([(0.991,), (1.0,), (0.95,), (0.0,)], "fraction double")
    out = rates.fraction_buckets(df).first()
    assert (out.n_full, out.n_above_90, out.n_above_50, out.n_zero) == (2, 3, 3, 1)


def test_duplicate_groups_and_examples(spark):
    df = spark.createDataFrame([(i, "x") for i in range(200)] + [(200, "y"), (201, None)], "id int, h string")
    out = rates.duplicate_groups(df, ["h"]).first()
    assert (out.n_rows, out.n_groups, out.rows_in_groups, out.extra_rows) == (201, 1, 200, 199)
    examples = rates.bounded_examples(df, ["h"], "id", 3)
    assert "WindowGroupLimit" in examples._jdf.queryExecution().toString()
    assert rates.bounded_examples(df.where("h = 'x'"), ["h"], "id", 3).first().examples == [0, 1, 2]


def test_restricted_removal_keeps_other_sources(spark):
    items = spark.createDataFrame([("a", "K"), ("a", "L"), ("b", "K"), ("c", None)], "name string, source string")
    flagged = spark.createDataFrame([("a",), ("c",)], "name string")
    assert lookups.remove_keys(items, flagged, ["name"], F.col("source") == "K").count() == 3
    assert lookups.remove_keys(items, flagged, ["name"]).count() == 1


def test_exact_matches_do_not_multiply(spark):
    items = spark.createDataFrame([(i, 1, "a" if i % 2 else "b") for i in range(100)], "id int, w bigint, g string")
    ref = spark.createDataFrame([(i, 1, "a") for i in range(1000, 1100)], "id int, w bigint, g string")
    out = lookups.exact_matches(items, ref, on=["w"], item="id", ref_key="id", group="g")
    assert out.count() == 100 and out.first().n_matches == 100 and out.where("same_group").count() == 50
    assert out.select("first_match").distinct().collect()[0][0] == 1000


def test_vote_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("j", "c")], "key string, label string")
    assert rows(lookups.majority_vote(df, ["key"], "label")) == [("j", "c"), ("k", "a")]


def test_group_filter_with_an_unknown_name_fails(spark):
    df = spark.createDataFrame([("a",), ("b",)], "team string")
    assert lookups.filter_group(df, spark.createDataFrame([("a",)], "team string"), "team").count() == 1
    with pytest.raises(Exception, match="without rows"):
        lookups.filter_group(df, spark.createDataFrame([("zzz",)], "team string"), "team").collect()


def test_label_shuffle_keeps_counts(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("label"), (F.col("id") % 2).alias("g"))
    out = splits.shuffle_labels(df, "id", "label", F.col("g") == 0, ["g"], "s")
    assert rows(out.groupBy("g", "label").count()) == rows(out.groupBy("g", F.col("shuffled").alias("label")).count())
    assert out.where((F.col("g") == 1) & (F.col("label") != F.col("shuffled"))).count() == 0
    assert out.where(F.col("label") != F.col("shuffled")).count() > 0


def test_proportional_targets_sum_up(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5 + [("c",)], "g string")
    out = dict(rows(splits.proportional_targets(df, "g", 4)))
    assert sum(out.values()) == 4 and out == {"a": 2, "b": 2, "c": 0}


def test_composition_prefers_one_source(spark):
    df = spark.range(40).select("id", F.lit("x").alias("label"), F.when(F.col("id") < 10, "p").otherwise("q").alias("source"))
    targets = spark.createDataFrame([("x", 15)], "label string, target int")
    out = splits.composition_matched(df, targets, key="id", label="label", source="source", preferred="p", seed=1)
    assert rows(out.groupBy("source").count()) == [("p", 10), ("q", 5)]
    assert splits.shortfall(out, targets, "label").count() == 0


def test_shard_merge_demands_every_seed_once(spark):
    expected = spark.range(3).withColumnRenamed("id", "seed")
    a, b = expected.where("seed < 2"), expected.where("seed = 2")
    assert checks.strict_merge([a, b], expected, ["seed"]).count() == 3
    for parts in ([a], [a, b, b], [a, b, spark.range(9, 10).withColumnRenamed("id", "seed")]):
        with pytest.raises(Exception, match="do not merge"):
            checks.strict_merge(parts, expected, ["seed"]).collect()


def test_claims_fail_on_missing_and_nan(spark):
    observed = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "claim string, value double")
    expected = spark.createDataFrame([("a", 1.05, 0.1), ("b", 1.0, 9.0), ("c", 1.0, 9.0)], "claim string, value double, tolerance double")
    assert {r.claim: r.ok for r in checks.claims(observed, expected).collect()} == {"a": True, "b": False, "c": False}


def test_holdout_prefers_priority_classes(spark):
    data = [("g1", "x")] * 6 + [("g2", "y")] * 9 + [("g3", "x")] * 4 + [("g3", "y")] * 9 + [("g4", "z")] * 2
    df = spark.createDataFrame(data, "grp string, label string")
    out = splits.group_holdout(df, group="grp", label="label", priority=("x", "y"), k=3, min_rows=4)
    assert [(r.grp, r.step) for r in out.orderBy("step").collect()] == [("g1", 0), ("g2", 1), ("g3", 2)]


def test_profiles_and_label_pairs_of_every_team(spark):
    from leaksift.operators.rates import disagreement, group_profile

    rows = spark.createDataFrame([(t, "s", y, p) for t in ("a", "b") for y in range(5) for p in range(5) for _ in range(y + 1 if t == "a" else 1)],
                                 "team string, source string, y int, pred int")
    got = disagreement(rows, "y", "pred", by=["team"]).collect()
    want = sorted([(t, -(y + 1 if t == "a" else 1), y, p) for t in ("a", "b") for y in range(5) for p in range(5) if y != p])
    assert sorted((r.team, -r.n, r.y, r.pred) for r in got) == [w for t in ("a", "b") for w in [x for x in want if x[0] == t][:15]]
    rows = rows.withColumn("correct", rows.y == rows.pred)
    found = {r.team: r for r in group_profile(rows, "source", "y", "correct", by=["team"]).collect()}
    assert [(found[t].n, found[t].dominant_label, round(found[t].accuracy, 9), round(found[t].accuracy_other, 9)) for t in "ab"] == [
        (75, 4, 0.2, 0.2), (25, 0, 0.2, 0.2)]
