"""License scans against the longest common subsequence of every stretch of text."""

import random

from leaksift.llm import licenses
from leaksift.llm.common import words_of


def brute(text):
    """Templates whose coverage is reached by the longest common subsequence with some short enough stretch."""
    words, found = words_of(text), set()
    for name, template in licenses.TEMPLATES.items():
        t = words_of(template)
        reach = int(len(t) / licenses.COVERAGE)
        for lo in range(max(1, len(words) - reach + 1)):
            part = words[lo:lo + reach]
            if len(set(part) & set(t)) >= 0.5 * len(set(t)) and len(licenses.common_subsequence(t, part)) >= licenses.COVERAGE * len(t) - 1e-9:
                found.add(name)
                break
    return found


def corpus():
    rng = random.Random(8)
    names = list(licenses.TEMPLATES)
    rows = []
    for i in range(120):
        words = [rng.choice(["the", "of", "license", "under", "on", "rights", "thand", "er", "version"]) for _ in range(rng.choice((0, 30, 90)))]
        if i % 2:
            copy = words_of(licenses.TEMPLATES[names[i % len(names)]])
            for _ in range(rng.randrange(0, len(copy) // 8 + 1)):
                copy[rng.randrange(len(copy))] = "edit"
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (None, "Released under the MIT License."), (902, "word " * 30000 + "\nAll rights reserved."),
                   (903, "license " * 500), (5, "All rights reserved."), (5, "All rights reserved.")]


def test_found_where_the_longest_common_subsequence_reaches_the_coverage(spark):
    rows = corpus()
    got = licenses.license_spans(spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, begin int")).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.doc_id, []).append(r)
    assert sum(r.doc_id == 5 and r.license == "all-rights-reserved" for r in got) >= 2
    for k, t in rows:
        if k in (902, 5):
            continue
        want, have = brute(t), {r.license for r in mine.get(k, [])}
        assert have <= want and bool(have) == bool(want), (k, want, have)
    (tail,) = mine[902]
    assert (tail.license, tail.coverage, tail.begin, tail.end) == ("all-rights-reserved", 1.0, 30000, 30003)


def test_exact_copies_are_covered_whole():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        n = len(words_of(text))
        assert (name, 1.0, 2, 2 + n) in scanner.scan(["x", "y", *words_of(text), "z"])


def test_alignment_is_in_order():
    a, b = list("abcdefg"), list("xbacydefzg")
    pairs = licenses.patience(a, b)
    assert pairs == sorted(pairs) and all(a[i] == b[j] for i, j in pairs) and len(pairs) == 6
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])


def test_empty_table(spark):
    assert licenses.license_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
