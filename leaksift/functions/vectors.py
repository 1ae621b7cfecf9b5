"""Fingerprints, norms and pair scores over array columns."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leaksift.functions.bits import WORD_BITS, pack_bits


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once.

    Naming an expression in Python repeats it in the plan, inside a lambda once
    per element; a one-element transform binds it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def gradient_hash(vector: Column, bits: int = WORD_BITS) -> Column:
    """Bit ``i`` is set when entry ``i+1`` exceeds entry ``i``; the last entry wraps around."""
    return let(vector, lambda v: F.when(
        F.size(v) >= bits, pack_bits([v[(i + 1) % bits] > v[i] for i in range(bits)])))


def frequency_hash(vector: Column) -> Column:
    """Bit ``i`` is set when cosine coefficient ``i`` exceeds the median coefficient.

    The 64 lowest type-II coefficients of the whole vector; they are rounded
    to nine digits before the comparison. One matrix product per Arrow batch.
    """
    @F.pandas_udf("bigint")
    def hash_batch(batch: pd.Series) -> pd.Series:
        def coefficients(rows: np.ndarray) -> np.ndarray:
            size = rows.shape[1]
            k = np.arange(WORD_BITS)[:, None]
            basis = np.cos(np.pi * k * (2 * np.arange(size)[None, :] + 1) / (2 * size))
            return np.round(rows @ basis.T, 9)

        def words(rows: np.ndarray) -> np.ndarray:
            c = coefficients(rows)
            return _pack(c > np.median(c, axis=1, keepdims=True))[:, 0]

        return _by_length(batch, words)

    return hash_batch.asNondeterministic()(vector)  # once, where it stands: see text_fingerprints


def sign_planes(planes: int, size: int, seed: str) -> np.ndarray:
    """``planes`` x ``size`` signs, each fixed by the MD5 of ``seed:plane:entry``."""
    def sign(p: int, i: int) -> float:
        digest = hashlib.md5(f"{seed}:{p}:{i}".encode()).hexdigest()
        return 1.0 if int(digest[0], 16) % 2 else -1.0

    return np.array([[sign(p, i) for i in range(size)] for p in range(planes)])


def plane_hash(vector: Column, size: int, planes: int = 256, seed: str = "planes") -> Column:
    """Signs of seeded random projections as ``planes/64`` words (``array<bigint>``)."""
    signs = sign_planes(planes, size, seed)

    @F.pandas_udf("array<bigint>")
    def hash_batch(batch: pd.Series) -> pd.Series:
        return _by_length(batch, lambda rows: list(_pack(np.round(rows @ signs.T, 9) > 0)), size)

    return hash_batch.asNondeterministic()(vector)  # once, where it stands: see text_fingerprints


def _pack(bits: np.ndarray) -> np.ndarray:
    """Boolean rows to signed words, bit 0 lowest."""
    rows, width = bits.shape
    grouped = bits.reshape(rows, width // WORD_BITS, WORD_BITS).astype(np.uint64)
    weights = np.left_shift(np.uint64(1), np.arange(WORD_BITS, dtype=np.uint64))
    return (grouped * weights).sum(axis=2, dtype=np.uint64).view(np.int64)


def _by_length(batch: pd.Series, kernel, only: int | None = None) -> pd.Series:
    """Apply a matrix kernel to the rows of each vector length; others stay null."""
    out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
    lengths = batch.map(lambda v: 0 if v is None else len(v))
    for length in sorted(set(lengths) - {0}):
        if only is not None and length != only:
            continue
        at = np.flatnonzero(lengths.to_numpy() == length)
        values = kernel(np.stack(batch.iloc[at].to_numpy()).astype(np.float64))
        for i, value in zip(at, values):
            out.iat[i] = value
    return out


def _doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def _sum(values: Column, term: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + term(x))


def vector_norm(vector: Column) -> Column:
    return F.sqrt(_sum(_doubles(vector), lambda x: x * x))


def unit_vector(vector: Column) -> Column:
    """Vector over its Euclidean norm."""
    return let(_doubles(vector), lambda v: let(vector_norm(v), lambda n: F.transform(v, lambda x: x / n)))


def centred_unit_vector(vector: Column, floor: float = 1e-9) -> Column:
    """Mean removed, scaled to length one; all zeros when nearly constant.

    The correlation of two vectors is then one dot product, so the means and
    norms are paid once per item and not once per pair.
    """
    def scale(c: Column) -> Column:
        return let(vector_norm(c), lambda n: F.when(n < floor, F.transform(c, lambda x: F.lit(0.0)))
                   .otherwise(F.transform(c, lambda x: x / n)))

    def centre(v: Column) -> Column:
        return let(_sum(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))

    return let(_doubles(vector), lambda v: let(centre(v), scale))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def ncc(left: Column, right: Column) -> Column:
    """Correlation of two vectors; 0.0 when either is nearly constant."""
    return dot(centred_unit_vector(left), centred_unit_vector(right))


def cosine(left: Column, right: Column) -> Column:
    return dot(unit_vector(left), unit_vector(right))


def perturbations(size: int) -> dict[str, object]:
    """Eleven named changes of a vector of ``size`` entries, each ``Column -> Column``.

    Ends dropped and stretched back, shifts, quantised values and coarser or
    finer resampling: the vector forms of cropping, rotation, lossy
    compression and resizing.
    """
    def keep_middle(share: float):
        kept = max(1, int(size * share))
        start = (size - kept) // 2
        index = [start + min(kept - 1, (i * kept) // size) for i in range(size)]
        return lambda v: F.array(*[v[j] for j in index])

    def shift(step: int):
        return lambda v: F.array(*[v[(i + step) % size] for i in range(size)])

    def quantise(levels: int):
        return lambda v: F.transform(v, lambda x: F.round(x.cast("double") * levels) / levels)

    def resample(points: int):
        index = [min(size - 1, (((i * points) // size) * size) // points) for i in range(size)]
        return lambda v: F.array(*[v[j] for j in index])

    return {
        "crop90": keep_middle(0.90), "crop75": keep_middle(0.75), "crop60": keep_middle(0.60),
        "shift1": shift(1), "shift2": shift(2), "shift4": shift(4),
        "quant90": quantise(90), "quant40": quantise(40), "quant10": quantise(10),
        "half": resample(math.ceil(size / 2)), "double": resample(size * 2),
    }
