"""Content digests and seeded, reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_digest(content: Column) -> Column:
    """Hex SHA-256 of a string or binary column."""
    return F.sha2(content, 256)



def byte_identical(left: Column, right: Column) -> Column:
    """True when both contents have the same length and digest."""
    return (F.octet_length(left) == F.octet_length(right)) & (F.md5(left) == F.md5(right))


def order_digest(seed: object, *keys: Column) -> Column:
    """Digest of ``seed:key:...``; ordering by it is a seeded shuffle.

    Equal on every engine that has MD5, so a sample can be drawn again
    elsewhere and compared row by row.
    """
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def draw(*parts: Column) -> Column:
    """A non-negative 60-bit integer fixed by the values of ``parts``."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def draw_index(size: Column | int, *parts: Column) -> Column:
    """An index in ``[0, size)`` fixed by the values of ``parts``."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.pmod(draw(*parts), size.cast("bigint"))


def split_by_digest(key: Column, seed: str, train_tenths: int) -> Column:
    """``training`` for about ``train_tenths`` tenths of the keys, else ``validation``."""
    return F.when(draw_index(10, F.lit(seed), key) < train_tenths, "training").otherwise("validation")
