"""Runs by synchronising sets against all periods of all stretches."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from leaksift.llm import runs


def brute(w, least=12):
    """Every run: for each period, maximal stretches; the least period of equal ends."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e, q) for (s, e), q in found.items())


def mine(w, least=12):
    return sorted(map(tuple, runs.find_runs(np.array(w), least).tolist()))


def shapes(rng):
    """Words of small alphabets, repeats of repeats, seams of periodic stretches, powers with an error."""
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(0, 120))]
    if kind == 1:  # a long period that starts with a highly periodic stretch
        unit = [0] * rng.randrange(1, 40) + [1] * rng.randrange(1, 4) + [0] * rng.randrange(0, 5)
        return [5] * rng.randrange(3) + unit * rng.randrange(2, 5) + unit[:rng.randrange(len(unit))]
    if kind == 2:  # two stretches of one period around a seam: runs of many periods
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 5))]
        a, b = root * rng.randrange(2, 40), root * rng.randrange(2, 40)
        return a[:len(a) - rng.randrange(len(root) + 1)] + b[rng.randrange(len(root)):]
    if kind == 3:  # repeats of repeats
        w = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
        for _ in range(3):
            w = w * rng.randrange(1, 4) + [rng.randrange(3)] * rng.randrange(2)
        return w[:260]
    if kind == 4:  # Fibonacci words hold as many runs as any
        a, b = [0], [0, 1]
        while len(b) < rng.randrange(20, 250):
            a, b = b, b + a
        return b
    w = [rng.randrange(50) for _ in range(rng.randrange(1, 40))] * rng.randrange(2, 6)
    w[rng.randrange(len(w))] = 99
    return w


@pytest.mark.parametrize("seed", range(12))
def test_equal_to_all_periods(seed):
    rng = random.Random(seed)
    for _ in range(120):
        w = shapes(rng)
        assert mine(w, 2) == brute(w, 2), w


def test_least_length():
    w = [1, 2, 3] * 4
    assert mine(w) == [(0, 12, 3)] and mine(w[:-1]) == [] and mine([7] * 12) == [(0, 12, 1)] and mine([]) == []


def want(text):
    words = [w.decode() for w in (text or "").encode().split()]
    found = sorted(((s, e - s, q) for s, e, q in brute(words)), key=lambda r: (r[0], r[2]))
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), best[1] * 1000 // best[2] if best else None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def planted(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if h is None or h % 10 or not n:
        return text
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n)).decode()


def test_documents(spark):
    rng = random.Random(5)
    rows = [(None, "a b " * 9), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "x y   " * 8), (4, "x y   " * 8),
            (5, "ä " * 13 + "\x1c \x85 z"), (6, " ".join(["la"] * 5000)), (7, "one two three")]
    rows += [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(90)))) for i in range(10, 120)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, runs string, start int")
    got = runs.run_digest(runs.periodic_runs(runs.with_planted_period(docs))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *want(planted(i, t)))) for i, t in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t)
    none = runs.run_digest(runs.periodic_runs(docs.where("false")))
    assert none.collect() == [] and none.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_portions_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))).encode() for _ in range(40)] + [None, b""]
    runs_, owner, collapsed = runs._documents(texts, 12)
    parts = list(runs._portions(texts, 30))
    assert parts[0].start == 0 and parts[-1].stop == len(texts) and all(a.stop == b.start for a, b in zip(parts, parts[1:]))
    again = [runs._documents(texts[p], 12) for p in parts]
    assert [c for _, _, cs in again for c in cs] == collapsed
    assert np.concatenate([r for r, _, _ in again]).tolist() == runs_.tolist()
