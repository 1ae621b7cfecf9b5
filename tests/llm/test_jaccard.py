"""The forest join against all pairs."""

import random

from leaksift.llm import jaccard
from leaksift.llm.common import words_of


def shingles(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    links, label = [0] * n, list(range(n))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                label[b] = a
    members = {}
    for i in range(n):
        members.setdefault(top(i), []).append(i)
    out = []
    for i in range(n):
        keys = [rows[j][0] for j in members[top(i)] if rows[j][0] is not None]
        out.append((rows[i][0], min(keys) if keys else None, links[i]))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 8, 40, 120)))]
        for _ in range(rng.choice((1, 2, 5, 9))):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    hot = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(120):
        copy = list(hot)
        for _ in range(rng.choice((0, 1, 2))):
            copy[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, "..."), (None, rows[-1][1]), (None, "alone here"), (7, rows[7][1]), (5010, rows[20][1]),
             (5003, "Some  WORDS, here"), (5004, "some words here"), (5005, "word " * 30000), (5006, "word " * 31000)]
    return rows


def test_equal_to_all_pairs_with_small_tiles(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, root string, n int")
    got = sorted([(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(docs, tile=32).collect()], key=str)
    assert got == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, root string, _class_key int")
    kept = jaccard.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {c for _, c, n in brute(rows) if n} | {k for k, _, n in brute(rows) if not n}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(docs).collect() == []


def test_prefixes_are_shortened_until_the_target():
    assert jaccard.prefix_length(0.8, 0.99, longest=6) == 6 and jaccard.prefix_length(0.8, 0.99) == 7 and jaccard.prefix_length(0.8, 0.999) == 5 and jaccard.prefix_length(0.5, 0.999) < 3


def test_unsettled_components_are_an_error(spark):
    import pytest

    from leaksift.llm.common import components

    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError, match="not settled after 1 rounds"):
        components(chain, rounds=1)


def test_few_and_many_links_give_the_same_components(spark):
    from leaksift.llm.common import components, connected

    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    edges = spark.createDataFrame(links, "a long, b long")
    few, many, rounds = (sorted(map(tuple, d.select("node", "root").collect())) for d in (connected(edges), connected(edges, alone=0), components(edges)))
    assert few == many == rounds
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sets_meet_below_the_prefix_that_one_of_them_asks_for():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    labels = np.sort(rng.integers(0, 2, (40, jaccard.LONGEST)).astype(">u2").view("S16").ravel())
    sig = rng.integers(0, 9, jaccard.TREES * jaccard.LONGEST).astype(np.uint16).tobytes()
    depth = rng.integers(2, jaccard.LONGEST + 1, 40)
    rows = pd.DataFrame({"node": 1, "t": 0, "u": 0, "side": 0, "id": np.arange(40), "depth": depth, "sig": [sig] * 40,
                         "label": [x.ljust(16, b"\0") for x in labels]})

    def shared(i, j):
        a, b = (np.frombuffer(rows["label"][x], np.uint16) for x in (i, j))
        return int(np.cumprod(a == b).sum())

    def classes(pairs):
        top = list(range(40))
        for i, j in pairs:
            top = [min(top[i], top[j]) if t in (top[i], top[j]) else t for t in top]
        return {i: top[i] for pair in pairs for i in pair}

    every = [(i, j) for i in range(40) for j in range(i)]
    whole = [(i, j) for i, j in every if shared(i, j) == jaccard.LONGEST]
    less = [(i, j) for i, j in every if min(depth[i], depth[j]) <= shared(i, j) < jaccard.LONGEST]
    for first, pairs in ((True, whole), (False, less)):
        got = pd.concat([pd.DataFrame({"a": [], "b": []}), *jaccard.near_in_tries(iter([rows]), 0.5, first, 2)])
        assert pairs and dict(zip(got["a"].astype(int), got["b"].astype(int))) == classes(pairs)


def test_prefixes_are_shortened_for_sets_short_of_the_target(spark):
    def met(alike):
        weight = 1 / (jaccard.TREES * alike ** jaccard.LONGEST)
        return weight, [weight * (1 - (1 - alike ** d) ** jaccard.TREES) for d in range(5, jaccard.LONGEST + 1)]

    rows = spark.createDataFrame([(1, *met(0.99)), (1, *met(0.95)), (2, *met(0.85)), (3, *met(0.8)), (4, *met(0.99)), (4, *met(0.8))],
                                 "id long, weight double, got array<double>")
    depth = {r.id: r.d for r in rows.groupBy("id").agg(jaccard.own_depth(0.999, 5).alias("d")).collect()}
    assert depth[1] == jaccard.LONGEST and depth[3] == 5 and 5 < depth[2] < jaccard.LONGEST and depth[4] < jaccard.LONGEST
