"""Decontamination against the exact edit distance to every part of every text."""

import random

import numpy as np

from leaksift.llm import decontamination as d
from leaksift.llm.common import words_of


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def corpus():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 8, 15, 16, 30, 55))))) for i in range(40)]
    docs = []
    for k in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((0, 20, 100)))]
        if k % 2:
            copy = words_of(items[k % 40][1])
            for _ in range(rng.randrange(0, len(copy) // 4 + 2)):
                at, kind = rng.randrange(len(copy)) if copy else 0, rng.randrange(3)
                if kind == 0 and copy:
                    copy[at] = "other"
                elif kind == 1:
                    copy.insert(at, "more")
                elif len(copy) > 1:
                    del copy[at]
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        docs.append((k, " ".join(words)))
    docs += [(900, None), (901, ""), (None, items[5][1]), (902, items[6][1]), (902, items[6][1]), (903, "x " * 50000 + items[7][1].upper())]
    items += [(77, None), (78, "..."), (79, items[3][1]), (None, "zz yy xx vv uu tt ss rr")]
    return docs, items


def test_equal_to_brute_force(spark):
    docs, items = corpus()
    got = d.contamination(spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, item_id int"),
                          spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")).collect()
    want = []
    for k, t in docs:
        for i, x in items:
            w = words_of(x)
            if w and k != 903:
                e = distance(w, words_of(t))
                if e <= d.edits_allowed(len(w)):
                    want.append((k, i, e))
    mine = [(r.doc_id, r.item_id, r.edits) for r in got if r.doc_id != 903]
    assert set(mine) <= set(want) and len(set(mine)) >= 0.99 * len(set(want))
    assert sorted(map(str, mine)).count("(902, 6, 0)") == 2
    text = {k: words_of(t) for k, t in docs}
    item = {i: words_of(t) for i, t in items}
    for r in got:
        if r.doc_id is not None and r.doc_id != 902:
            assert distance(item[r.item_id], text[r.doc_id][r.begin:r.end]) == r.edits
    assert any(r.doc_id == 903 and r.item_id == 7 and r.edits == 0 for r in got)


def test_blocks_give_the_same_and_filter_keeps_clean_rows(spark):
    docs, items = corpus()
    left = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, item_id int")
    right = spark.createDataFrame(items, "item_id long, text string")
    one = {(r.doc_id, r.item_id, r.edits) for r in d.contamination(left, right).collect()}
    many = {(r.doc_id, r.item_id, r.edits) for r in d.contamination(left, right, block_words=200).collect()}
    assert len(one & many) >= 0.98 * len(one | many)
    dirty = {k for k, _, _ in one}
    kept = d.without_contaminated(left, right)
    assert kept.columns == left.columns and {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - dirty


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert d.contamination(docs, items).collect() == [] and d.contamination(full, items).collect() == []
    assert d.without_contaminated(full, items).count() == 1


def test_recall_reaches_the_target_at_every_length_and_random_windows_stay_out():
    rng = random.Random(9)
    m = d.matcher([(i, " ".join(f"w{rng.randrange(2000)}" for _ in range(rng.choice((6, 8, 15, 20, 30, 50))))) for i in range(300)])
    draw = np.random.default_rng(4)
    for n in m.by_size:
        if n in m.repetitions:
            assert m.recalls(n, m.repetitions[n], seed=8)[-1] >= 0.95
            texts = [draw.integers(1, 2000, n) for _ in range(400)]
            assert sum(bool(m.candidates(t, n, np.array([0]))) for t in texts) <= 0.05 * len(texts), n
    assert len(m.repetitions) >= 4
    assert np.array_equal(d.best_place(np.array([1, 2, 3]), np.array([9, 1, 3, 9])), (1, 1, 3))


def test_lengths_below_the_target_have_all_windows_verified(monkeypatch):
    monkeypatch.setattr(d, "MOST_REPETITIONS", 1)
    rng = random.Random(3)
    m = d.matcher([(i, " ".join(f"w{rng.randrange(500)}" for _ in range(40))) for i in range(20)])
    assert 40 not in m.repetitions
    draw = np.random.default_rng(2)
    words = list(m.vocabulary)
    for i in range(20):
        copy = ["other" if w == 0 else words[w - 1] for w in d.edited(m.words[i], 8, draw)]
        assert any(found[0] == i and found[1] <= 8 for found in m.matches(["a", *copy, "b"]))
