"""Fingerprints as signed 64-bit words: parsing, popcount, Hamming distance.

Spark has no unsigned type. Words are compared for equality and XORed, never
ordered as numbers with a meaning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 64


def signed(value: int) -> int:
    """The signed 64-bit reading of an unsigned Python integer."""
    value &= (1 << WORD_BITS) - 1
    return value - (1 << WORD_BITS) if value >> (WORD_BITS - 1) else value


def hex_word(text: Column) -> Column:
    """16 hex digits to a word; anything else is null, not zero."""
    return F.when(text.rlike("^[0-9a-fA-F]{16}$"), F.conv(text, 16, -10).cast("bigint"))


def word_hex(word: Column) -> Column:
    """A word to 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(word)), 16, "0")


def popcount(word: Column) -> Column:
    return F.bit_count(word)


def hamming(left: Column, right: Column) -> Column:
    """Differing bits of two words; null when either is null."""
    return F.bit_count(left.bitwiseXOR(right))


def hamming_or_max(left: Column, right: Column) -> Column:
    """As :func:`hamming`, with a missing word at the full distance of 64."""
    return F.coalesce(hamming(left, right), F.lit(WORD_BITS))


def hamming_words(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Differing bits over several words (256 bits are four words)."""
    total = hamming(left[0], right[0])
    for a, b in zip(left[1:], right[1:]):
        total = total + hamming(a, b)
    return total


def pack_bits(bits: Sequence[Column]) -> Column:
    """Boolean columns to one word, the first as the lowest bit."""
    word = F.when(bits[0], F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    for i, bit in enumerate(bits[1:], start=1):
        word = word.bitwiseOR(
            F.when(bit, F.lit(signed(1 << i)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        )
    return word
