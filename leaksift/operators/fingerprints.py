"""Item fingerprints as DataFrame jobs."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksift.functions.bits import WORD_BITS, hamming
from leaksift.functions.vectors import frequency_hash, gradient_hash, perturbations

try:  # Python's own, which starts a hash in a third of the time of the one from OpenSSL
    from _md5 import md5
except ImportError:
    md5 = hashlib.md5

HASHED_AT_ONCE = 1 << 16


def normalised_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order (empty array for none)."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def normalised_text(text: Column) -> Column:
    """The same words with one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def shingle_word(words: Sequence[Column], digest: str) -> Column:
    """64 bits of a run of words: ``md5`` can be repeated elsewhere, ``xxhash64`` is faster."""
    if digest == "xxhash64":
        return F.xxhash64(*words)
    return F.conv(F.substring(F.md5(F.concat_ws(" ", *words)), 1, 16), 16, -10).cast("bigint")


def shingle_words(words: Column, size: int, digest: str) -> Column:
    """Hashes of every run of ``size`` words; a shorter text is one shingle, an empty one null."""
    last = F.greatest(F.size(words) - size, F.lit(0))

    def at(i: Column) -> Column:
        return shingle_word([F.get(words, i + d) for d in range(size)], digest)

    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), at))


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``md5`` hashes of :func:`shingle_words` of a batch of :func:`normalised_text`, and where every text's begin.

    A shingle is a slice of its text; a hash costs a third of what Spark's own
    functions take for it. Hashes are made ``HASHED_AT_ONCE`` at a time.
    """
    held = texts.cast(pa.large_binary()).fill_null(b"")
    _, at, data = held.buffers()
    edges = np.frombuffer(at, np.int64)[held.offset:held.offset + len(held) + 1] if at else np.zeros(len(held) + 1, np.int64)
    raw = data.slice(edges[0], edges[-1] - edges[0]).to_pybytes() if data else b""
    edges = edges - edges[0]
    spaces, filled = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), np.diff(edges) > 0
    starts = np.sort(np.concatenate([edges[:-1][filled], spaces + 1]), kind="stable")
    ends = np.sort(np.concatenate([edges[1:][filled], spaces]), kind="stable")
    first = np.searchsorted(starts, edges)  # word
    counts = np.where(filled, np.maximum(np.diff(first) - size + 1, 1), 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    word = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], counts)
    last = np.minimum(word + size - 1, np.repeat(first[1:] - 1, counts))
    low, high = starts[word], ends[last]
    values = np.empty(len(word), np.uint64)
    for i in range(0, len(word), HASHED_AT_ONCE):
        part = slice(i, i + HASHED_AT_ONCE)
        hashes = b"".join([md5(raw[a:b]).digest() for a, b in zip(low[part].tolist(), high[part].tolist())])
        values[part] = np.frombuffer(hashes, ">u8")[::2]
    return values.view(np.int64), offsets


#: Every byte with each of its bits in a byte of its own, so that 255 hashes are added without a carry.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
_ADDED, _HELD = 255, 1 << 15


def majority_words(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row of a flat list of 64-bit hashes, the word of the bits that more than half of them have set; 0 for no hashes.

    All rows of a batch are counted together: bits are spread to eight counters
    a number, summed over up to 255 hashes of a row at a time, and only those
    sums are widened and added per row.
    """
    sizes = np.diff(offsets)
    filled = np.flatnonzero(sizes)
    words = np.zeros(len(sizes), np.uint64)
    if len(filled) == 0:
        return words.view(np.int64)
    pieces = -(-sizes[filled] // _ADDED)
    first = np.concatenate([[0], np.cumsum(pieces)])
    starts = np.repeat(offsets[:-1][filled], pieces) + (np.arange(first[-1]) - np.repeat(first[:-1], pieces)) * _ADDED
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    sums = np.empty((len(starts), 8), np.uint64)
    low = 0
    while low < len(starts):  # what lies in a cache at a time
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + _HELD)))
        end = starts[high] if high < len(starts) else offsets[-1]
        np.add.reduceat(_LANES[raw[starts[low]:end]], starts[low:high] - starts[low], axis=0, out=sums[low:high])
        low = high
    counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, WORD_BITS).astype(np.int64), first[:-1], axis=0)
    words[filled] = np.packbits(counts * 2 > sizes[filled, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return words.view(np.int64)


@F.arrow_udf(T.LongType())
def majority_word(hashes: pa.Array) -> pa.Array:
    """Bit ``i`` is set when more than half of a row's hashes have it set (null for no hashes)."""
    values = hashes.values.to_numpy(zero_copy_only=False) if hashes.values.null_count == 0 else hashes.values.fill_null(0).to_numpy()
    offsets = hashes.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    return pa.array(majority_words(values, offsets), pa.int64(), mask=(sizes == 0) | hashes.is_null().to_numpy(zero_copy_only=False))


def majority_of_text(size: int):
    """The same for the ``md5`` hashes of runs of ``size`` words of a :func:`normalised_text`."""
    @F.arrow_udf(T.LongType())
    def majority(texts: pa.Array) -> pa.Array:
        values, offsets = shingle_hashes(texts, size)
        return pa.array(majority_words(values, offsets), pa.int64(), mask=np.diff(offsets) == 0)

    return majority.asNondeterministic()


# Keeps a later filter on a fingerprint from being pushed below its computation,
# which would hash every text twice. The value itself depends on the text alone.
majority_word = majority_word.asNondeterministic()


def text_fingerprints(items: DataFrame, keep: Sequence[str], text: str = "text",
                      families: Mapping[str, int] | None = None, digest: str = "xxhash64") -> DataFrame:
    """Simhash words of whole texts, one column per family (name → words per shingle).

    ``keep`` names the columns to carry; the text itself goes no further. The
    job is one narrow stage: shingles are cut and hashed in the JVM (``md5``: in
    Python) and bits are counted in Python per batch.
    """
    families = dict(families or {"fp2": 2, "fp3": 3})
    words = normalised_text if digest == "md5" else normalised_words
    tokens = items.select(*keep, words(F.col(text)).alias("_w"))

    def word(size: int) -> Column:
        if digest == "md5":
            return majority_of_text(size)(F.col("_w"))
        return majority_word(shingle_words(F.col("_w"), size, digest))

    return tokens.select(*keep, *[word(size).alias(name) for name, size in families.items()])


def vector_fingerprints(items: DataFrame, keep: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Gradient and frequency hashes of a vector column as ``dhash`` and ``phash``."""
    return items.select(*keep, gradient_hash(F.col(vector)).alias("dhash"),
                        frequency_hash(F.col(vector)).alias("phash"))


def distinct_fingerprints(items: DataFrame, words: Sequence[str], first: str | None = None,
                          by: Sequence[str] = ()) -> DataFrame:
    """Distinct fingerprints with their row count ``n`` (and first key).

    Copies of one item become one row here, before any comparison, however
    many there are. Rows with a missing word are left out.
    """
    present = items.dropna(subset=list(words))
    aggs = [F.count(F.lit(1)).alias("n")]
    if first:
        aggs.append(F.min(first).alias(first))
    return present.groupBy(*by, *words).agg(*aggs)


def perturbed(items: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Every item under every perturbation: ``key``, ``transform``, original and changed vector."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    base = items.select(key, doubles.alias("original"))
    kinds = F.array(*[F.struct(F.lit(name).alias("transform"), change(F.col("original")).alias("changed"))
                      for name, change in perturbations(size).items()])
    return base.select(key, "original", F.inline(kinds))


def perturbation_robustness(items: DataFrame, key: str, vector: str, size: int,
                            radii: Sequence[int] = (6, 2)) -> DataFrame:
    """Hash distance between an item and its changed form, summarised per perturbation."""
    pairs = perturbed(items, key, vector, size).select(
        "transform",
        hamming(frequency_hash(F.col("original")), frequency_hash(F.col("changed"))).alias("_p"),
        hamming(gradient_hash(F.col("original")), gradient_hash(F.col("changed"))).alias("_d"))
    shares = [F.avg(((F.col("_p") <= r) & (F.col("_d") <= r)).cast("double")).alias(f"share_le{r}")
              for r in radii]
    return pairs.groupBy("transform").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_p").alias("phash_mean"), F.median("_p").alias("phash_median"), F.max("_p").alias("phash_max"),
        F.avg("_d").alias("dhash_mean"), F.median("_d").alias("dhash_median"), F.max("_d").alias("dhash_max"),
        *shares)
