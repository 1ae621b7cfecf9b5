"""Periodic runs of words by string synchronising sets.

A run is a stretch of consecutive words with smallest period ``q`` and at least
two periods long that no neighbouring word extends. All runs are found, in
every text whole:

* Words are numbered, then all stretches of 2, 4, 8, ... words (``ranks``):
  equal stretches have equal numbers, a stretch that occurs once has none, so
  the work of a length shrinks to what repeats.
* Periods below 6 are found directly, by comparing each word with the one ``q``
  places on. These, and runs found at smaller scales, are the highly periodic
  regions of the larger scales.
* At scale ``t`` (2, 4, 8, ...) periods from ``3t`` to below ``6t`` are found. A
  place is synchronising when the least hash of the ``t``-word stretches that
  start at it and at the ``t`` places after it belongs to the first or the last
  of them; stretches inside a region of period ``t/3`` or less have no hash. In a
  run of period ``q`` one of the first ``t`` places is synchronising, and the same
  place one period on, with equal ``2t``-word contexts. Such pairs propose
  their distance as a period. At most 18 places of one context lie within
  ``6t``, since nearer ones would make it highly periodic.
* A run that starts in a highly periodic region may have no such place. Then
  either the region's end recurs one period on (pairs of region ends propose),
  or the run is two regions of one period around a seam (each seam proposes
  all periods of the scale that fit in both).

Every proposal is extended to both sides by comparing ranks, longest first,
so that equality is exact and costs a logarithm of the length; what is shorter
than two periods goes. Stretches equal in both ends are one run with the least
of their periods.

Documents are handled where they lie, without a shuffle; a task holds the words
of about ``WORDS_AT_ONCE`` of them at a time (or one longer document), in
arrays of its number of words times the logarithm of its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksift.llm.common import mixed

LEAST_LENGTH = 12
DIRECT = 5
WORDS_AT_ONCE = 400_000
NO_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def ranks_of(codes: np.ndarray) -> list[np.ndarray]:
    """Per power of two, the number of the stretch that starts at each place; -1 where it occurs once."""
    def numbered(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), -1, np.int64)
        if len(keys):
            _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
            again = counts[inverse] > 1
            out[places[again]] = inverse[again]
        return out

    ranks = [numbered(codes, np.arange(len(codes)))]
    while (ranks[-1] >= 0).any():
        last, half = ranks[-1], 1 << (len(ranks) - 1)
        at = np.flatnonzero(last >= 0)
        at = at[at + half < len(codes)]
        at = at[last[at + half] >= 0]
        ranks.append(numbered(last[at] * len(codes) + last[at + half], at))
    return ranks


def _extended(ranks: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end place of the longest stretch around ``at`` whose words equal those ``period`` places on."""
    n = len(ranks[0])
    low, high = at.copy(), at.copy()
    for k in range(len(ranks) - 1, -1, -1):
        size, rank = 1 << k, ranks[k]
        here, there = rank[np.minimum(high, n - 1)], rank[np.minimum(high + period, n - 1)]
        high = high + np.where((high + period < n) & (here >= 0) & (here == there), size, 0)
        here, there = rank[np.maximum(low - size, 0)], rank[np.clip(low + period - size, 0, n - 1)]
        low = low - np.where((low >= size) & (here >= 0) & (here == there), size, 0)
    return low, high + period


def _merged(*parts: np.ndarray) -> np.ndarray:
    """Rows of start, end and period, by start and end, each pair of ends once with its least period."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows) == 0:
        return rows
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[first]


def _direct(codes: np.ndarray, period: int) -> np.ndarray:
    """All stretches of a small period, two periods long and more."""
    if len(codes) <= period:
        return np.zeros((0, 3), np.int64)
    same = np.concatenate([[False], codes[:-period] == codes[period:], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    low, high = edges[::2], edges[1::2]
    keep = high - low >= period
    return np.column_stack([low[keep], high[keep] + period, np.full(keep.sum(), period)]).astype(np.int64)


def _near(places: np.ndarray, group: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of one group, 3 to below 6 scales apart: first place and distance; places ascend in a group."""
    at, apart, lag = [], [], 1
    while lag < len(places):
        close = (group[lag:] == group[:-lag]) & (places[lag:] - places[:-lag] < 6 * scale)
        if not close.any():
            break
        first, far = places[:-lag][close], (places[lag:] - places[:-lag])[close]
        at.append(first[far >= 3 * scale])
        apart.append(far[far >= 3 * scale])
        lag += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *apart])


def _synchronising(rank: np.ndarray, contexts: np.ndarray, regions: np.ndarray, scale: int) -> np.ndarray:
    """Synchronising places among those whose context occurs again."""
    n = len(rank)
    inside = regions[regions[:, 1] - regions[:, 0] >= scale]
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, inside[:, 0], 1)
    np.add.at(depth, inside[:, 1] - scale + 1, -1)
    least = np.where((rank >= 0) & (np.cumsum(depth[:n]) == 0), mixed(rank.astype(np.uint64)), NO_HASH)
    own, width = least, 1
    while width < scale:
        least = np.minimum(least, np.concatenate([least[width:], np.full(min(width, n), NO_HASH)])[:n])
        width *= 2
    at = np.flatnonzero(contexts >= 0)  # a context of 2t words lies inside the array
    lowest = np.minimum(least[at], least[at + 1])
    return at[(lowest < NO_HASH) & ((own[at] == lowest) | (own[at + scale] == lowest))]


def _seams(regions: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposals of two neighbouring regions of one period: a place and a period for every period that fits in both."""
    at, period = [], []
    left, right = regions[:-1], regions[1:]
    met = (left[:, 2] == right[:, 2]) & (right[:, 0] <= left[:, 1]) & (right[:, 0] > left[:, 1] - left[:, 2])
    for (s1, e1, p), (s2, e2, _) in zip(left[met], right[met]):
        q = np.arange(3 * scale, min(6 * scale - 1, e1 - s1, e2 - s2) + 1)
        at.append(s2 - q + p)
        period.append(q)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *period])


def find_runs(codes: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """Start, end and smallest period of every run of at least ``least`` words, by start, then end."""
    codes = np.asarray(codes, np.int64)
    found = _merged(*[_direct(codes, q) for q in range(1, DIRECT + 1)])
    ranks, scale, level = ranks_of(codes), 2, 2
    while level < len(ranks) and (ranks[level] >= 0).any():
        regions = found[found[:, 2] <= scale // 3]
        places = _synchronising(ranks[level - 1], ranks[level], regions, scale)
        context = ranks[level][places]
        order = np.argsort(context, kind="stable")
        long = regions[regions[:, 1] - regions[:, 0] >= 3 * scale - 1]
        ends = np.unique(long[:, 1])
        proposals = [_near(places[order], context[order], scale), _near(ends, np.zeros(len(ends)), scale), _seams(long, scale)]
        at, period = (np.concatenate([p[i] for p in proposals]) for i in (0, 1))
        if len(at):
            low, high = _extended(ranks, at, period)
            whole = high - low >= 2 * period
            found = _merged(found, np.column_stack([low, high, period])[whole])
        scale, level = scale * 2, level + 1
    return found[found[:, 1] - found[:, 0] >= least]


def _documents(texts: list[bytes | None], least: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of some documents: runs (start, length, period), the document of each, and the collapsed texts."""
    words = [t.split() if t else [] for t in texts]  # splits at \x20 and \x09 to \x0D and nowhere else
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    every = np.concatenate([np.array([*w, b""], object) for w in words])
    codes = pd.factorize(every)[0].astype(np.int64)
    # A document ends with a number of its own, so nothing repeats across documents.
    codes[starts[1:] - 1] = -1 - np.arange(len(words))
    runs = find_runs(codes, least)
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    dropped = np.zeros(len(codes) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    kept = np.cumsum(dropped[:-1]) == 0
    whole = np.ones(len(words), bool)
    whole[owner] = False
    collapsed = [b" ".join(w if whole[i] else every[starts[i]:starts[i + 1] - 1][kept[starts[i]:starts[i + 1] - 1]])
                 for i, w in enumerate(words)]
    local = np.column_stack([runs[:, 0] - starts[owner], runs[:, 1] - runs[:, 0], runs[:, 2]])
    order = np.lexsort((local[:, 2], local[:, 0], owner))
    return local[order], owner[order], collapsed


def _portions(texts: list[bytes | None], words: int) -> Iterator[slice]:
    """Slices of documents with about ``words`` words together (six bytes a word)."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t or b"") // 6 + 1
        if held and held + size > words:
            yield slice(low, i)
            low, held = i, 0
        held += size
    yield slice(low, len(texts))


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_LENGTH) -> DataFrame:
    """``key``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` of every document.

    Words are maximal runs of anything but space and the characters 9 to 13.
    ``collapsed`` holds, joined by one space, the words that no run contains
    after its first period. A null or empty text has no run and an empty
    ``collapsed``. Rows come back one for one, repeated and null keys
    included; an empty table gives an empty one; other columns are ignored.
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for part in _portions(texts, WORDS_AT_ONCE) if texts else ():
                runs, owner, collapsed = _documents(texts[part], least)
                offsets = np.searchsorted(owner, np.arange(len(collapsed) + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], fields=list(RUNS_TYPE.value_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start:part.stop], pa.ListArray.from_arrays(pa.array(offsets), rows, type=RUNS_TYPE),
                     pa.array(collapsed, pa.binary()).cast(pa.string())], names=["key", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        found, f"key {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return out.withColumnRenamed("key", key)


def run_digest(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: number of runs, the longest (ties: least start, then period), and digests of all runs and of the rest."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("l"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    best = F.col("_best")
    return runs.withColumn("_best", longest).select(
        key, F.size("runs").cast("bigint").alias("n_runs"), (-best.s).alias("start"), best.l.alias("length"), (-best.p).alias("period"),
        F.expr("_best.l * 1000 div -_best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_planted_period(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``text``, where a tenth of the documents, chosen by the CRC-32 of the key, end in a repeated stretch.

    With ``h`` the checksum and ``g = h // 10``, word ``i`` from place ``a = g % n``
    on becomes word ``a + (i - a) % p``, ``p = 1 + (n - a) // (3 + g % 8)``.
    """
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col(key).cast("string"))
    chosen = docs.select(F.col(key), F.col(text), F.when((h % 10 == 0) & (F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")) > 0), words).alias("_w"),
                         F.expr(f"crc32(cast(`{key}` as string)) div 10").alias("_g"))
    n = F.size("_w")
    placed = chosen.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    placed = placed.withColumn("_p", F.expr("1 + (size(_w) - _a) div (3 + _g % 8)"))
    ends = F.concat(F.slice("_w", 1, F.col("_a").cast("int")), F.transform(
        F.sequence(F.lit(0).cast("bigint"), n - F.col("_a") - 1), lambda i: F.get("_w", (F.col("_a") + i % F.col("_p")).cast("int"))))
    return placed.select(key, F.when(F.col("_w").isNotNull(), F.array_join(ends, " ")).otherwise(F.col(text)).alias(text))
