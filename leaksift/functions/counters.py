"""Counter-based draws that arrays and SQL compute alike.

A draw is a keyed permutation of the numbers below a prime: the counters are
added in turn, and after each the fifth power is taken, which is a permutation
since 5 does not divide the prime less one. Numbers stay below ``2**31`` and
products below ``2**62``, so any engine with 64-bit integers gives the same
draws. The keys come from a digest of the seed.
"""

from __future__ import annotations

import hashlib

import numpy as np

PRIME = (1 << 31) - 1
STRIDES = (48271, 69621, 16807)
CACHED = 1 << 15  # draws made at a time


def round_keys(seed: str, count: int) -> list[int]:
    """Keys of a seed, one per round."""
    return [int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:7], 16) for i in range(count)]


def _folded(x: np.ndarray, spare: np.ndarray, times: int) -> None:
    """Each fold takes ``x`` nearer to its rest by the prime, 2**31 being 1 there."""
    for _ in range(times):
        np.right_shift(x, np.uint64(31), out=spare)
        x &= np.uint64(PRIME)
        x += spare


def _fifth(x: np.ndarray) -> None:
    """Fifth powers of numbers below the prime, in place; a division each would cost four times as much."""
    square, spare = x * x, np.empty_like(x)
    _folded(square, spare, 1)
    square *= square  # below 2**64, as a square folded once is below 2**32
    _folded(square, spare, 2)
    x *= square
    _folded(x, spare, 2)
    np.subtract(x, np.uint64(PRIME), out=spare)
    np.minimum(x, spare, out=x)


def drawn(seed: str, first: np.ndarray, second: np.ndarray, block: int = 0) -> np.ndarray:
    """A draw in ``[0, PRIME)`` per pair of counters (every ``first`` with every ``second``), within a block."""
    k = round_keys(seed, 4)
    x = ((np.asarray(first, np.int64) % PRIME * STRIDES[0] + k[0] + block % PRIME * STRIDES[2]) % PRIME).astype(np.uint64)
    _fifth(x)
    y = ((np.asarray(second, np.int64) % PRIME * STRIDES[1] + k[1]) % PRIME).astype(np.uint64)
    out = np.empty((len(x), len(y)), np.uint64)
    step = max(1, CACHED // max(1, len(y)))
    for i in range(0, len(x), step):
        for j in range(0, len(y), CACHED):
            part = x[i:i + step, None] + y[None, j:j + CACHED]
            for key in (0, k[2], k[3]):
                part += np.uint64(key)
                np.minimum(part, part - np.uint64(PRIME), out=part)  # the rest, as a sum is below twice the prime
                _fifth(part)
            out[i:i + step, j:j + CACHED] = part
    return out.view(np.int64)


def _fifth_sql(source: str, columns: str, x: str) -> str:
    square = f"(SELECT {columns}, x, x * x % {PRIME} AS s FROM (SELECT {columns}, ({x}) % {PRIME} AS x FROM {source}))"
    return f"(SELECT {columns}, s * s % {PRIME} * x % {PRIME} AS x FROM {square})"


def drawn_sql(seed: str, source: str, columns: str, first: str, second: str) -> str:
    """The same in SQL: a sub-select of ``columns`` of ``source`` and the draw ``x`` of block 0."""
    k = round_keys(seed, 4)
    held = f"{columns}, {first}, {second}" if columns else f"{first}, {second}"
    rounds = _fifth_sql(source, held, f"{first}::BIGINT * {STRIDES[0]} + {k[0]}")
    rounds = _fifth_sql(rounds, held, f"x + {second}::BIGINT * {STRIDES[1]} + {k[1]}")
    rounds = _fifth_sql(rounds, held, f"x + {k[2]}")
    return _fifth_sql(rounds, held, f"x + {k[3]}")


def split_counts(seed: str, reps: np.ndarray, sizes: np.ndarray, total: int, wanted: int) -> np.ndarray:
    """How many of ``total`` uniform draws over all blocks fall into block ``wanted``, per replicate.

    A binomial splitting tree: from the root, each node's draws are parted
    between its two halves by their sizes, until the block is reached. A node's
    numbers come from a generator keyed by seed, node and first replicate, so
    every task that walks through a node sees the same.
    """
    low, high, left = 0, len(sizes), np.full(len(reps), total, np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    key = int(hashlib.md5(f"{seed}:tree".encode()).hexdigest()[:16], 16)
    while high - low > 1:
        middle = (low + high) // 2
        share = (ends[middle] - ends[low]) / (ends[high] - ends[low])
        generator = np.random.Generator(np.random.Philox(np.random.SeedSequence([key, low, high, int(reps[0])])))
        first = generator.binomial(left, share)
        if wanted < middle:
            high, left = middle, first
        else:
            low, left = middle, left - first
    return left


def replicate_sums(seed: str, values: np.ndarray, reps: np.ndarray, total: int, start: int = 0) -> np.ndarray:
    """Sums per replicate of the rows of ``values`` that are among ``total`` draws of ``total`` rows; these are from row ``start`` on."""
    sums, size = np.zeros((len(reps), values.shape[1]), values.dtype), np.uint64(total)
    step = max(1, CACHED // max(1, total))
    for low in range(0, total, CACHED):
        slots = np.arange(low, min(low + CACHED, total))
        for at in range(0, len(reps), step):
            x = drawn(seed, reps[at:at + step], slots).view(np.uint64)
            index = (x - x // size * size).view(np.int64)
            if len(values) == total:
                sums[at:at + step] += np.stack([column[index].sum(1) for column in values.T], 1)
                continue
            index -= start
            taken = (index >= 0) & (index < len(values))
            index[~taken] = 0
            sums[at:at + step] += np.stack([(column[index] * taken).sum(1) for column in values.T], 1)
    return sums
