"""Suffix-array dedup: sparse suffix arrays over content-selected positions.

Of all suffixes of the texts only those are kept that begin at a minimiser: the
run of ``KMER`` words with the least hash among the runs of a passage of
``least`` words. Equal passages choose the same place, so no repeat is lost,
and about one suffix in twenty is kept. Suffixes whose first run occurs once
are dropped by a count. The others are sorted by their words, and each is
compared with its neighbour word by word: the longest common prefixes of
neighbours are the match lengths to the right of the whole order. Matches are
extended to the left over the words before the kept place. Places that reach
``least`` words together are repeats, and overlapping repeats join to maximal
spans.

Equal texts are one text. A suffix carries its words as 32-bit hashes, not the
text: passages that differ in one word only are taken for equal once in 2^32.
A first run with more than ``HOT`` suffixes is no array of one task: there
passages are counted by their hash, with partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaksift.llm.common import mixed, run_hashes, sorted_runs, word_hashes, words_of
from leaksift.operators.skew import salted_lookup
from leaksift.session import materialise

LEAST = 50
KMER = 10
HOT = 20_000
CHUNK = 1 << 15
_BASE = np.uint64(0x9E3779B97F4A7C15)


def minimisers(words: np.ndarray, least: int, kmer: int) -> tuple[np.ndarray, ...]:
    """First run's hash, its place, and the first and last passage that chose it."""
    span = least - kmer + 1
    runs = run_hashes(words, kmer)
    n = len(runs) - span + 1
    chosen = np.empty(n, np.int64)
    for lo in range(0, n, CHUNK):
        part = runs[lo:min(n, lo + CHUNK) + span - 1]
        chosen[lo:lo + CHUNK] = np.lib.stride_tricks.sliding_window_view(part, span).argmin(1) + np.arange(len(part) - span + 1) + lo
    new = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    at = chosen[new]
    return runs[at], at, new, np.append(new[1:], n) - 1


def sampled_suffixes(docs: DataFrame, key: str, text: str, least: int, kmer: int) -> DataFrame:
    """``key``, text digest, words, and the kept suffixes of every text."""
    @F.pandas_udf("n_words int, suffixes array<struct<kmer:bigint,at:int,first:int,last:int>>")
    def sample(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = words_of(t)
            if len(words) < least:
                rows.append((len(words), []))
                continue
            kmers, at, first, last = minimisers(word_hashes(words), least, kmer)
            rows.append((len(words), [{"kmer": k, "at": a, "first": f, "last": z}
                                      for k, a, f, z in zip(kmers.view(np.int64).tolist(), at.tolist(), first.tolist(), last.tolist())]))
        return pd.DataFrame(rows, columns=["n_words", "suffixes"])

    sample = sample.asNondeterministic()  # its fields are used apart; it must run once
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
                       sample(F.col(text)).alias("_s")).select("key", "digest", "_s.*")


def with_context(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """One row per suffix with the words of all passages that chose it, as 32-bit hashes from the first passage on."""
    for batch in batches:
        out = []
        for digest, text, kept in zip(batch["digest"], batch["_text"], batch["kept"]):
            words = (word_hashes(words_of(text)) >> np.uint64(32)).astype(">u4")
            for s in kept:
                first, last = s["first"], s["last"]
                out.append((s["kmer"], s["hot"], digest, s["at"], first, last, words[s["at"]:last + least].tobytes(), words[first:s["at"]].tobytes()))
        for lo in range(0, len(out), 10_000):
            yield pd.DataFrame(out[lo:lo + 10_000], columns=["kmer", "hot", "digest", "at", "first", "last", "suffix", "before"])


def passages(rows: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and hash of every passage of the given suffixes."""
    parts = [b + s for b, s in zip(rows["before"], rows["suffix"])]
    words = mixed(np.frombuffer(b"".join(parts), ">u4").astype(np.uint64))
    sizes = np.array([len(p) // 4 for p in parts])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(least - 1, _BASE)]).astype(np.uint64))
    each = sizes - least + 1
    row = np.repeat(np.arange(len(rows)), each)
    within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    start = offsets[row] + within
    hashes = np.zeros(len(start), np.uint64)
    for i in range(least):
        hashes += words[start + i] * powers[i]
    return row, rows["first"].to_numpy()[row] + within, hashes


def spans_of(row: np.ndarray, start: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Maximal spans of a row's repeated passages: row, first word, end."""
    if len(row) == 0:
        return row, start, start
    cut = np.append(True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1))
    begins = np.flatnonzero(cut)
    ends = np.append(begins[1:], len(row)) - 1
    return row[begins], start[begins], start[ends] + least


def word_table(parts: list[bytes], backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Words of byte strings as rows, padded with zeros, and how many each has; ``backwards`` puts the last word first."""
    sizes = np.array([len(p) // 4 for p in parts], np.int64)
    words = np.frombuffer(b"".join(parts), ">u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(parts)), sizes)
    within = np.arange(len(words)) - np.repeat(ends - sizes, sizes)
    table = np.zeros((len(parts), int(sizes.max(initial=0))), np.uint64)
    table[row, sizes[row] - 1 - within if backwards else within] = words
    return table, sizes


def common_prefixes(suffixes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words that every suffix shares with the one before it, from the second on."""
    differs = suffixes[1:] != suffixes[:-1]
    first = np.where(differs.any(1), differs.argmax(1), suffixes.shape[1])
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


def extended_matches(rows: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word of every passage that another of the sorted suffixes has as well.

    A passage with ``l`` words before its kept place and ``least - l`` from it
    on is repeated when another suffix shares both. Suffixes that share so many
    words to the right lie side by side, bounded by shorter common prefixes;
    among them those with the same ``l`` words to the left are told by
    extending the match by one word at a time.
    """
    suffixes, sizes = word_table(list(rows["suffix"]))
    before, reach = word_table(list(rows["before"]), backwards=True)
    shared = common_prefixes(suffixes, sizes)
    nearest = rows["at"].to_numpy() - rows["last"].to_numpy()  # passages that begin later chose another place
    repeated = np.zeros((len(rows), before.shape[1] + 1), bool)
    left = np.zeros(len(rows), np.uint64)
    for l in range(before.shape[1] + 1):  # noqa: E741
        if l:
            left = np.unique(left << np.uint64(32) | before[:, l - 1], return_inverse=True)[1].astype(np.uint64)
        right = np.append(0, np.cumsum(shared < least - l)).astype(np.uint64)
        able = np.flatnonzero((reach >= l) & (nearest <= l))
        _, group, count = np.unique(right[able] << np.uint64(32) | left[able], return_inverse=True, return_counts=True)
        repeated[able[count[group] > 1], l] = True
    row, from_left = np.nonzero(repeated[:, ::-1])
    return row, rows["at"].to_numpy()[row] - (before.shape[1] - from_left)


def neighbours_equal(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Maximal spans of extended matches; all suffixes of one first run lie in one task, sorted by their words."""
    for rows, _ in sorted_runs(batches, ["kmer"]):
        row, start = extended_matches(rows, least)
        r, begin, end = spans_of(row, start, least)
        if len(r):
            yield pd.DataFrame({"digest": rows["digest"].to_numpy()[r], "begin": begin, "end": end})


def frequent_passages(suffixes: DataFrame, least: int) -> DataFrame:
    """Spans among suffixes with a very frequent first run: passages are counted by their hash, with partial sums."""
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2_000):
                rows = batch.iloc[lo:lo + 2_000]
                row, start, hashes = passages(rows, least)
                yield pd.DataFrame({"kmer": rows["kmer"].to_numpy()[row], "hash": hashes.view(np.int64), "digest": rows["digest"].to_numpy()[row], "begin": start})

    every = suffixes.mapInPandas(listed, "kmer bigint, hash bigint, digest bigint, begin int")
    repeated = every.groupBy("kmer", "hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    found = salted_lookup(every, repeated, ["kmer", "hash"], ["digest", "begin"], "inner")
    return found.select("digest", "begin", (F.col("begin") + least).alias("end"))


def merged(spans: DataFrame) -> DataFrame:
    """``digest`` and its spans as an array, overlapping and touching ones joined."""
    before = Window.partitionBy("digest").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("_new", (F.col("begin") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    island = F.sum("_new").over(Window.partitionBy("digest").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0))
    joined = marked.withColumn("_island", island).groupBy("digest", "_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return joined.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, kmer: int = KMER, hot: int = HOT) -> DataFrame:
    """One row per document with a passage of at least ``least`` words that occurs elsewhere in the table.

    Columns ``key``, ``n_words``, ``n_repeated`` (words inside repeated
    passages) and ``spans`` (first word and end, exclusive, of the maximal
    repeated passages). Words are lower-case runs of letters and digits;
    elsewhere means another document or another place of the same one. A text
    that several rows share is repeated as a whole when it is long enough. Null,
    empty and shorter texts have no passage; a null key stays null; every
    repeated row is a row of the result; an empty table gives an empty one.
    Other columns are ignored.
    """
    found = materialise(sampled_suffixes(docs, key, text, least, kmer))
    texts = (found.where(F.col("n_words") >= least).groupBy("digest")
             .agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("least_key"), F.first("suffixes").alias("suffixes")))
    texts = materialise(texts)
    kept = texts.select("digest", F.inline("suffixes"))
    often = kept.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("kmer", (F.col("_n") > hot).alias("hot"))
    shared = salted_lookup(kept, often, ["kmer"], ["digest", "at"], "inner", rows_per_task=hot)
    per_text = (shared.groupBy("digest").agg(F.collect_list(F.struct("kmer", "hot", "at", "first", "last")).alias("kept"))
                .join(texts.select("digest", "least_key"), "digest"))
    body = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_digest"))
    joined = body.join(per_text, (F.col("_digest") == F.col("digest")) & F.col("_key").eqNullSafe(F.col("least_key")))
    shape = "kmer bigint, hot boolean, digest bigint, at int, first int, last int, suffix binary, before binary"
    suffixes = materialise(joined.select("digest", "_text", "kept").mapInPandas(lambda b: with_context(b, least), shape))
    spans = (suffixes.where(~F.col("hot")).repartition("kmer").sortWithinPartitions("kmer", "suffix", "digest", "at")
             .mapInPandas(lambda b: neighbours_equal(b, least), "digest bigint, begin int, end int"))
    spans = spans.unionByName(frequent_passages(suffixes.where("hot"), least))
    single = merged(spans)
    rows = found.where(F.col("n_words") >= least).select("key", "digest", "n_words")
    # Rows of a shared text are whole repeats: only texts that one row has look up their spans.
    many = texts.where(F.col("copies") > 1).select("digest", F.lit(True).alias("_many"))
    marked = salted_lookup(rows, many, ["digest"], ["key"], "left")
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").alias("end")))
    copied = marked.where(F.col("_many")).select("key", "n_words", whole.alias("spans"))
    other = marked.where(F.col("_many").isNull()).join(single, "digest").select("key", "n_words", "spans")
    total = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["begin"])
    return copied.unionByName(other).select(F.col("key").alias(key), "n_words", total.alias("n_repeated"), "spans")
