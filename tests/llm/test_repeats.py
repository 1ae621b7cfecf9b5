"""Repeated passages against a count of all passages."""

import random
from collections import Counter

import numpy as np
import pandas as pd

from leaksift.llm import repeats
from leaksift.llm.common import words_of


def brute(rows, least):
    count = Counter()
    for _, t in rows:
        w = words_of(t)
        for i in range(len(w) - least + 1):
            count[tuple(w[i:i + least])] += 1
    out = []
    for k, t in rows:
        w, spans = words_of(t), []
        for i in range(len(w) - least + 1):
            if count[tuple(w[i:i + least])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        if spans:
            out.append((k, len(w), sum(b - a for a, b in spans), [tuple(s) for s in spans]))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(200)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [text(n) for n in (50, 51, 60, 80, 300)]
    rows = []
    for _ in range(120):
        w = text(rng.choice((0, 10, 60, 200)))
        for _ in range(rng.choice((0, 1, 2))):
            s = rng.choice(shared)
            a = rng.choice((0, 0, 5))
            at = rng.randrange(len(w) + 1)
            w[at:at] = s[a:]
        rows.append((len(rows), " ".join(w)))
    base = text(150)
    for _ in range(40):  # near copies that cut each other's passages at many places
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3))):
            w[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, "same " * 70), (903, rows[3][1]), (3, rows[3][1]), (None, rows[5][1] + " more"), (904, " ".join(text(49))),
             (905, " ".join(text(30000)))]
    return rows


def check(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id long, text string, digest int, kmer string")
    got = repeats.repeated_passages(docs, hot=hot).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_repeated, [(s.begin, s.end) for s in r.spans]) for r in got], key=str) == brute(rows, 50)


def test_equal_to_counting_all_passages(spark):
    check(spark, repeats.HOT)


def test_frequent_runs_give_the_same(spark):
    check(spark, 3)


def test_empty_table(spark):
    assert repeats.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_matches_come_from_the_order_of_suffixes():
    def row(before, suffix, last):
        coded = [np.array([ord(c) for c in w], ">u4").tobytes() for w in (suffix, before)]
        return dict(kmer=1, digest=0, at=len(before), first=0, last=last, suffix=coded[0], before=coded[1])

    # Passages of six words: the second and third share xab|cde, the first and third only what follows the bar.
    rows = pd.DataFrame([row("ab", "cdef", 2), row("xab", "cdeg", 3), row("xab", "cdeh", 3), row("qab", "cdfh", 3)])

    def found(table):
        r, start = repeats.extended_matches(table.reset_index(drop=True), 6)
        return sorted((table.index[i], int(s)) for i, s in zip(r, start))

    assert found(rows) == [(1, 0), (2, 0)]
    assert found(rows.iloc[[1, 3, 2, 0]]) == []  # out of order the neighbours share too little
    suffixes, sizes = repeats.word_table(list(rows["suffix"]))
    assert repeats.common_prefixes(suffixes, sizes).tolist() == [3, 3, 2]
