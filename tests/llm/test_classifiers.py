"""The quality and toxicity classifiers: held-out accuracy, odd rows, and their parts by hand."""

import os
import zlib

import numpy as np
import pytest

from leaksift.llm import quality, toxicity

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def held_out_accuracy(spark, scorer, label):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r.doc_id: r for r in scorer(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()}
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored.values())
    truth = {r.doc_id: r[label] for r in labels.collect() if r.doc_id in scored and scored[r.doc_id].held_out}
    assert len(truth) > 30
    hits = {y: [scored[k].predicted == y for k, v in truth.items() if v == y] for y in (0, 1)}
    return [sum(h) / len(h) for h in hits.values()], scored


@tables
def test_quality_on_held_out_labels(spark):
    (bad, good), scored = held_out_accuracy(spark, quality.quality_scores, "quality")
    assert bad >= 0.8 and good >= 0.95
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for k, r in scored.items())


@tables
def test_toxicity_on_held_out_labels(spark):
    (clean, toxic), scored = held_out_accuracy(spark, toxicity.toxicity_scores, "toxic")
    assert clean >= 0.97 and toxic >= 0.5
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for k, r in scored.items())


def odd(spark):
    good = "The river ran slowly past the mill, and nobody spoke of it. They went home."
    rows = [(i, (good + f" Day {i}. ") * (1 + i % 3) if i % 2 else f"{i} ### | &&& " * 9 + "you idiot", 0.5, "x") for i in range(60)]
    rows += [(100, None, 0.5, "x"), (101, "", 0.5, "x"), (None, good, 0.5, "x"), (102, good * 5000, 0.5, "x"), (1, rows[1][1], 0.5, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, _label string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)] + [(3, 0, 0), (None, 1, 1), (7, None, None), (999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("scorer", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_rows_and_columns(spark, scorer):
    docs, labels = odd(spark)
    out = scorer(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == ["doc_id", "text", "score", "_label", "held_out", "predicted"]
    by = {(r.doc_id, r._label): r for r in rows}
    assert by[(100, "x")].score == by[(101, "x")].score and by[(None, "x")].held_out is False
    assert by[(1, "x")].score == by[(1, "y")].score
    one = by[(4, "x")].predicted != by[(102, "x")].predicted
    assert one


@pytest.mark.parametrize("scorer", [quality.quality_scores, toxicity.toxicity_scores])
def test_empty_tables(spark, scorer):
    docs, labels = odd(spark)
    assert scorer(docs.limit(0), labels).count() == 0
    rows = scorer(docs, labels.limit(0)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_votes_equal_a_plain_search():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.05, (80, quality.FEATURES)).astype(np.float32)
    labels = np.arange(80) % 3 % 2
    voter = quality.fit_voter(counts, labels, {0: 500, 1: 100}, 10)
    for row, score in zip(counts[:9], voter.scores(counts[:9], 7)):
        v = voter.embed(row[None])[0].astype(float)
        near = sorted(((float(v @ w), i) for i, w in enumerate(voter.vectors.astype(float))), reverse=True)[:7]
        votes = [(max(0, c) ** 8 * voter.weights[i], labels[i]) for c, i in near]
        assert abs(score - sum(a * y for a, y in votes) / sum(a for a, _ in votes)) < 1e-4


def test_grammar_weighs_clauses_not_words():
    g = toxicity.Grammar({"idiot": 1.5, "vequ": 1.0})
    score = lambda t: g.score(g.patterns(t)[None])[0]
    assert score("you are an idiot") > score("an idiot walked by") > score("he is not an idiot") == pytest.approx(score("nothing here"), abs=1e-9)
    assert score("she said you are an idiot") == score("nothing here") < score("she said so. you are an idiot")
    assert score("I will kill you") > score("to kill time")
    assert g.tag("vequmont") == (toxicity.INSULT, 1.0) and g.tag("veq")[0] == toxicity.OTHER
    assert g.patterns(None).sum() == g.patterns("").sum() == 0


def test_composition_carries_all_marks():
    state, marks = 0, []
    for tag in (toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.INSULT, toxicity.TARGET):
        state, mark = toxicity.MACHINE[state][tag]
        marks.append(mark)
    assert marks[3] == toxicity.DENIED | toxicity.REPORTED | toxicity.AIMED and marks[4] & toxicity.HIT
