"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

A CGK embedding walks over a sequence of words and, by a random bit per step
and word, repeats a word or moves on; sequences at a small edit distance get
embeddings at a small Hamming distance. Sampling positions of the embedding is
then an LSH for edit distance. Positions are drawn from the part that nearly
all walks reach, so a key is made of words, not of the padding behind them.
Windows of every document, as long as an item, are embedded and meet the items
whose samples they share in any repetition. Every item length has as many
repetitions as its own recall, measured on edited copies of its items, needs
for the target; a length that ``MOST_REPETITIONS`` do not bring there has all
its windows verified. Candidates are verified by the exact word edit distance.

Only windows that can match are embedded: with at most ``e`` edits in ``n``
words some run of ``(n - e) / (e + 1)`` words is untouched, so a text that
shares no such run with an item holds no match of it. This loses nothing.

Items are dealt into blocks of bounded size and each block is broadcast; the
documents are scanned once per block, and no text is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksift.llm.common import mixed, words_of

SIMILARITY = 0.8
BLOCK_WORDS = 1_000_000
SAMPLES, APART = 2, 4
MOST_REPETITIONS = 256
TARGET_RECALL = 0.99
TRIALS = 200
FILTER_BITS = 22


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    """Most word edits of an item of ``n`` words."""
    return int(math.floor((1 - similarity) * n + 1e-9))


def untouched_run(n: int, similarity: float = SIMILARITY) -> int:
    """Words of the longest run that must survive the allowed edits."""
    e = edits_allowed(n, similarity)
    return max(1, -(-(n - e) // (e + 1)))


def embedded(windows: np.ndarray, repetition: int, positions: np.ndarray) -> np.ndarray:
    """The embedding's words at some positions, for rows of equally long sequences (-1 past the end)."""
    rows, n = windows.shape
    padded = np.hstack([windows, np.full((rows, 1), -1, windows.dtype)])
    at, each = np.zeros(rows, np.int64), np.arange(rows)
    out = np.empty((rows, len(positions)), np.int64)
    wanted = {int(p): i for i, p in enumerate(positions)}
    for step in range(int(positions[-1]) + 1):
        word = padded[each, at]
        if step in wanted:
            out[:, wanted[step]] = word
        bit = mixed(word.astype(np.uint64) + np.uint64((repetition * 1_000_003 + step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), n)
    return out


def sampled(n: int, repetition: int) -> np.ndarray:
    """Positions of an embedding of ``n`` words that a repetition looks at.

    They lie before the place where nearly all walks end (about 2n), and apart:
    neighbours would often hold one word twice.
    """
    reach = max(1, int(2 * n - 2 * math.sqrt(2 * n)))
    count = min(SAMPLES, reach)
    apart = min(APART, (reach + 1) // 2)
    free = np.random.default_rng((n, repetition)).choice(reach - (count - 1) * (apart - 1), count, replace=False)
    return np.sort(free) + np.arange(count) * (apart - 1)


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """``words`` after random edits by an unknown word (0)."""
    copy = words.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(copy))))
        if kind == 0 and copy:
            copy[at] = 0
        elif kind == 1:
            copy.insert(at, 0)
        elif len(copy) > 1:
            del copy[at]
    return np.array(copy, np.int64)


def best_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to any part of ``text``, with the first part that has it, the shortest if several."""
    def ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        steps = np.arange(len(a) + 1)
        column, out = steps.copy(), np.empty(len(b) + 1, np.int64)
        out[0] = column[-1]
        for j, word in enumerate(b):
            new = np.empty_like(column)
            new[0] = 0
            new[1:] = np.minimum(column[:-1] + (a != word), column[1:] + 1)
            column = np.minimum.accumulate(new - steps) + steps
            out[j + 1] = column[-1]
        return out

    last = ends(item, text)
    end = int(last.argmin())
    # Backwards from the end: the least reach with the same distance begins the part.
    a, b = item[::-1], text[:end][::-1]
    steps = np.arange(len(a) + 1)
    column, reach = steps.copy(), 0
    for j, word in enumerate(b):
        if column[-1] == last[end]:
            break
        new = np.empty_like(column)
        new[0] = j + 1
        new[1:] = np.minimum(column[:-1] + (a != word), column[1:] + 1)
        column = np.minimum.accumulate(new - steps) + steps
        reach = j + 1
    return int(last[end]), end - reach, end


@dataclass
class Matcher:
    """One block of items, ready to be searched for."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    similarity: float

    def __post_init__(self) -> None:
        self.by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            self.by_size.setdefault(len(w), []).append(i)
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, w in enumerate(self.words):
            run = untouched_run(len(w), self.similarity)
            for offset, code in enumerate(self._runs(w, run).tolist()):
                found.setdefault(run, {}).setdefault(code, []).append((i, offset))
        self.seeds = found
        self.filters = {}
        for run, codes in found.items():
            table = np.zeros(1 << FILTER_BITS, bool)
            table[self._slot(np.fromiter(codes, np.uint64, len(codes)))] = True
            self.filters[run] = table
        self.buckets: dict[tuple[int, int], dict[bytes, list[int]]] = {}
        # Per item length; a length without an entry has all its windows verified.
        self.repetitions: dict[int, int] = {}

    def bucket(self, n: int, repetition: int) -> dict[bytes, list[int]]:
        """Items of ``n`` words by their sampled words; samples of padding only are left out."""
        if (n, repetition) not in self.buckets:
            table: dict[bytes, list[int]] = {}
            items = self.by_size[n]
            for i, key in zip(items, embedded(np.stack([self.words[i] for i in items]), repetition, sampled(n, repetition))):
                if (key >= 0).any():
                    table.setdefault(key.tobytes(), []).append(i)
            self.buckets[(n, repetition)] = table
        return self.buckets[(n, repetition)]

    @staticmethod
    def _runs(words: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - size + 1 + i].astype(np.uint64)
        return mixed(out)

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def windows(self, text: np.ndarray) -> dict[int, np.ndarray]:
        """Per item size, the starts of windows that can hold a match."""
        starts: dict[int, set[int]] = {}
        for run, table in self.filters.items():
            if len(text) < run:
                continue
            codes = self._runs(text, run)
            known = self.seeds[run]
            for p in np.flatnonzero(table[self._slot(codes)]).tolist():
                for i, offset in known.get(int(codes[p]), ()):
                    n = len(self.words[i])
                    e = edits_allowed(n, self.similarity)
                    starts.setdefault(n, set()).update(range(p - offset - e, p - offset + e + 1))
        return {n: np.array(sorted(s), np.int64) for n, s in starts.items()}

    def rows(self, text: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts inside the padded text, and their windows of ``n`` words."""
        e = edits_allowed(n, self.similarity)
        padded = np.concatenate([np.zeros(n + 2 * e, np.int64), text, np.zeros(n + 2 * e, np.int64)])
        starts = np.clip(starts, -n - e, len(text) + e)
        return starts, padded[starts[:, None] + (n + 2 * e) + np.arange(n)]

    def candidates(self, text: np.ndarray, n: int, starts: np.ndarray) -> dict[int, list[int]]:
        """Items of ``n`` words whose sampled embedding a window shares in any repetition, with the windows' starts."""
        starts, rows = self.rows(text, n, starts)
        if n not in self.repetitions:
            return {i: sorted(set(starts.tolist())) for i in self.by_size[n]}
        hits: dict[int, set[int]] = {}
        for r in range(self.repetitions[n]):
            table = self.bucket(n, r)
            for start, key in zip(starts.tolist(), embedded(rows, r, sampled(n, r))):
                for i in table.get(key.tobytes(), ()):
                    hits.setdefault(i, set()).add(start)
        return {i: sorted(s) for i, s in hits.items()}

    def matches(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """Per item within the edit bound: position of the item, edits, first and last word (end exclusive) of the best place."""
        get = self.vocabulary.get
        text = np.array([get(w, 0) for w in words], np.int64)
        out = []
        for n, starts in self.windows(text).items():
            e = edits_allowed(n, self.similarity)
            for i, near in self.candidates(text, n, starts).items():
                best, lo = None, near[0]
                for at, nxt in zip(near, [*near[1:], None]):
                    if nxt is not None and nxt - at <= n:
                        continue
                    begin, end = max(0, lo - e), min(len(text), at + n + e)
                    if begin < end:
                        edits, a, b = best_place(self.words[i], text[begin:end])
                        if edits <= e and (best is None or edits < best[0]):
                            best = (edits, begin + a, begin + b)
                    lo = nxt
                if best is not None:
                    out.append((i, *best))
        return out

    def recalls(self, n: int, most: int, target: float = 1.1, trials: int = TRIALS, seed: int = 3) -> list[float]:
        """Share of edited copies of items of ``n`` words found again with 1, 2, ... repetitions, up to the target or ``most``.

        A copy has as many random edits as are allowed.
        """
        rng = np.random.default_rng((seed, n))
        wanted, parts, of = [], [], []
        for trial, i in enumerate(rng.choice(self.by_size[n], trials)):
            text = np.concatenate([np.zeros(5, np.int64), edited(self.words[i], edits_allowed(n, self.similarity), rng), np.zeros(5, np.int64)])
            wanted.append(int(i))
            starts = self.windows(text).get(n)
            if starts is not None:
                parts.append(self.rows(text, n, starts)[1])
                of += [trial] * len(starts)
        found, out = np.zeros(trials, bool), []
        for r in range(most):
            table = self.bucket(n, r)
            for trial, key in zip(of, embedded(np.vstack(parts), r, sampled(n, r)) if parts else ()):
                found[trial] = found[trial] or wanted[trial] in table.get(key.tobytes(), ())
            out.append(float(found.mean()))
            if out[-1] >= target:
                break
        return out

    def fit(self, target: float) -> None:
        """As many repetitions for every length as its recall needs."""
        for n in self.by_size:
            measured = self.recalls(n, MOST_REPETITIONS, target)
            if measured[-1] >= target:
                self.repetitions[n] = len(measured)
        self.buckets = {(n, r): t for (n, r), t in self.buckets.items() if r < self.repetitions.get(n, 0)}


def matcher(rows: list[tuple], similarity: float = SIMILARITY, recall: float = TARGET_RECALL) -> Matcher:
    """Items with words, with as many repetitions per length as the target recall takes."""
    kept = [(i, w) for i, w in ((i, words_of(t)) for i, t in rows) if w]
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.int64) for _, w in kept]
    out = Matcher([i for i, _ in kept], coded, vocabulary, similarity)
    out.fit(recall)
    return out


def item_blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_words`` words, one at a time on the driver."""
    body = benchmark.where(F.col(text).isNotNull()).select(F.col(item).alias("i"), F.col(text).alias("t"))
    words = body.agg(F.sum(F.regexp_count("t", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    for b in range(blocks):
        rows = body.where(F.pmod(F.xxhash64("t", "i"), F.lit(blocks)) == b).collect()
        yield sorted(((r["i"], r["t"]) for r in rows), key=lambda r: (r[0] is None, r[0], r[1]))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document and item whose words occur in it within the edit bound.

    Columns ``key``, ``item`` (called ``item_id``), ``edits``, ``similarity``
    (1 - edits / words of the item), ``begin`` and ``end`` (words of the best
    place, end exclusive). Words are lower-case runs of letters and digits. A
    null or empty text or item matches nothing; a null key stays null; repeated
    rows give repeated results; an empty table on either side gives an empty
    result. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item]
    schema = f"_key {kind}, item_id {item_kind}, edits int, similarity double, begin int, end int"
    found = None
    for rows in item_blocks(benchmark, item, item_text, block_words):
        shared = spark.sparkContext.broadcast(matcher(rows, similarity))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m = shared.value
            for batch in batches:
                out = [(k, m.ids[i], edits, 1 - edits / len(m.words[i]), a, b)
                       for k, t in zip(batch["_key"], batch["_text"]) for i, edits, a, b in m.matches(words_of(t))]
                yield pd.DataFrame(out, columns=["_key", "item_id", "edits", "similarity", "begin", "end"])

        part = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(search, schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("_key", key)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                         similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; null and empty texts stay. Nothing is shuffled."""
    def free_of(shared):
        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            return pd.Series([not shared.value.matches(words_of(t)) for t in texts], dtype=bool)
        return clean

    for rows in item_blocks(benchmark, item, item_text, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(matcher(rows, similarity))
        docs = docs.where(free_of(shared)(F.col(text)))
    return docs
