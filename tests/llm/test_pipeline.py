"""The pipeline's stages: what each keeps, and that its decisions take effect."""

import os

import pytest

import corpus_pipeline
from leaksift.llm import decontamination, quality
from leaksift.llm.common import words_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before and after every stage, written in between as the pipeline's user does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def shingles(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_keep_the_columns(steps):
    for name, (before, after) in steps.items():
        if name != "mixing":
            assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_goes_by_the_score(spark, steps):
    before, after = steps["quality"]
    scored = quality.quality_scores(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(rows(after)) == {r.doc_id for r in scored if r.score >= 0.7}


def test_one_of_each_near_duplicate_group_stays(steps):
    before, after = map(rows, steps["near_duplicates"])
    sets = {k: shingles(r.text) for k, r in before.items()}

    def near(a, b):
        return bool(sets[a] and sets[b]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])

    for k in before:
        group = {k}
        while more := {j for j in before for i in group if j not in group and near(i, j)}:
            group |= more
        assert len(group & set(after)) == 1


def test_leaks_go_and_the_rest_stays(spark, steps):
    before, after = map(rows, steps["decontamination"])
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontamination.matcher([(0, " ".join(i)) for i in items])
    for k, r in before.items():
        words = " ".join(words_of(r.text))
        if any(f" {' '.join(i)} " in f" {words} " for i in items if i):
            assert k not in after
        elif k not in after:
            assert matcher.matches(words_of(r.text))


def test_secrets_are_masked_everywhere_and_clean_texts_stay(steps):
    before, after = map(rows, steps["secrets"])
    assert set(before) == set(after)
    from test_secrets import expected
    for k, r in after.items():
        assert not expected(r.text) and r.n_chars == len(r.text)
        assert ("[SECRET]" in r.text) or r.text == before[k].text
        if expected(before[k].text):
            assert "[SECRET]" in r.text


def test_the_mix_meets_its_targets(steps):
    before, after = map(rows, steps["mixing"])
    assert set(after) <= set(before)
    taken, target = {}, {}
    for r in after.values():
        assert 0 < r.taken <= 2 * r.size and r.taken == sum(p.end - p.begin for p in r.pieces)
        assert r.text == before[r.doc_id].text
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in taken)


def test_run_equals_the_stages(spark, steps):
    """``run`` writes between the stages as the fixture does, so the rows are the same."""
    want = steps["mixing"][1]
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_every_stage_is_computed_once(spark, monkeypatch):
    """A stage's own work runs once per document in ``run``."""
    seen = spark.sparkContext.accumulator(0)

    def counted(spark_, docs, sf):
        def touch(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch
        return docs.mapInPandas(touch, docs.schema)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("counted", counted), *corpus_pipeline.STAGES[3:]])
    corpus_pipeline.run(spark, SF).collect()
    assert seen.value == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_clashing_columns_are_replaced_by_the_mix(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "en", 5, "old", 0.5, 7, "p"), (2, "d e", "y", "en", 3, "old", 0.5, 7, "p")],
                                 "doc_id long, text string, source string, lang string, n_chars long, size string, target double, taken int, pieces string")
    out = corpus_pipeline.mix_sources(spark, docs, SF)
    assert len(set(out.columns)) == len(out.columns) and {r["size"] for r in out.collect()} <= {2, 3}
