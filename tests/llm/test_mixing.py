"""The mixing tree: quotas, disjoint pieces, reruns and odd rows."""

from collections import defaultdict

import pytest

from leaksift.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 4}" if i % 11 else None, "x") for i in range(800)]
    rows += [(5, "w " * 5, "s1", "x"), (5, "w " * 5, "s1", "y"), (None, "a b", "s2", "z"), (900, None, "s0", "z"), (901, "", "s0", "z")]
    rows += [(1000 + i, "one two three", "small", "x") for i in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, quota string")


def test_targets_are_met_and_no_document_exceeds_its_passes(docs):
    rows = mixing.mix_plan(docs, block_words=16, shards=4).collect()
    assert len(rows) == docs.count()
    taken, target, size = defaultdict(int), {}, {}
    for r in rows:
        key = (r.source_size, r.target)
        taken[key] += r.taken
        target[key], size[key] = r.target, r.source_size
        assert 0 <= r.taken <= 2 * r.size
    for key in taken:
        assert abs(taken[key] - target[key]) <= 0.5 and target[key] <= 2 * size[key] + 1e-9
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert (6, 12.0) in target  # the excess of a small source goes to the others


def test_pieces_are_disjoint_and_shards_share_every_source(docs):
    plan = mixing.mix_plan(docs, block_words=16, shards=4, keep=["source"])
    words, per_shard = defaultdict(list), defaultdict(int)
    for n, r in enumerate(plan.collect()):
        for p in r.pieces:
            words[(n, p["pass"])].append((p.begin, p.end))
            per_shard[(r.source, p.shard)] += p.end - p.begin
    for parts in words.values():
        parts.sort()
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
    for source in ("s0", "s1", "s2", "s3"):
        assert len([1 for s, _ in per_shard if s == source]) == 4


def test_reruns_agree(docs):
    def one(df):
        return sorted((str(r.doc_id), r.size, r.taken, str(r.pieces)) for r in mixing.mix_plan(df, block_words=16).collect())
    assert one(docs) == one(docs.repartition(7))


def test_hypergeometric_draw_follows_its_distribution(spark):
    from pyspark.sql import functions as F
    n = spark.range(20000).select(((F.col("id") + 0.5) / 20000).alias("u"))
    got = n.select(mixing._left_count(F.lit(50).cast("bigint"), F.lit(20).cast("bigint"), F.lit(25).cast("bigint"), F.col("u")).alias("k"))
    counts = {r.k: r["count"] / 20000 for r in got.groupBy("k").count().collect()}
    from math import comb
    for k in range(21):
        assert abs(counts.get(k, 0) - comb(20, k) * comb(30, 25 - k) / comb(50, 25)) < 1e-3


def test_mixed_rows_are_ordered_in_their_shard(docs):
    rows = mixing.mixed_rows(mixing.mix_plan(docs, block_words=16, shards=2)).collect()
    assert sum(r.end - r.begin for r in rows) == sum(r.taken for r in mixing.mix_plan(docs, block_words=16, shards=2).collect())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(empty).collect() == []
