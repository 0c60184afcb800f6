"""Expressions over content digests and unordered sets of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recorded(digest: Column) -> Column:
    """A digest that says something; NULL and the empty string both say nothing."""
    return digest.isNotNull() & (digest != "")


def short(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256 in sixteen bytes, which stand for it where only equality counts; NULL for NULL."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def words(text: Column) -> tuple[Column, Column]:
    """The first 128 bits of a text's SHA-256 as two numbers, which stand for it where only equality counts; NULL for NULL."""
    word = lambda k: F.conv(F.substring(F.sha2(text, 256), 16 * k + 1, 16), 16, -10).cast("bigint")
    return word(0), word(1)


def bag_of(high: Column, low: Column) -> Column:
    """Aggregate: the `bag` of texts known by their `words`."""
    halves = [half for both in (high, low) for half in (F.shiftrightunsigned(both, 32), both.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return F.concat_ws(":", F.count(high).cast("string"), *[F.coalesce(F.sum(word), F.lit(0)).cast("string") for word in halves])


def bag(text: Column) -> Column:
    """
    Aggregate: a fixed-width stand-in for the sorted list of all values in a
    group: their count and, word by word, the sums of the first four 32-bit
    words of their SHA-256. Equal bags give equal values, different ones meet
    with the odds of a 128-bit digest. It sums, so the work is done before the
    shuffle and one huge group never has to sit in one task.
    """
    return bag_of(*words(text))


def well_formed(digest: Column) -> Column:
    """'<algorithm>:<value>' with a value."""
    return digest.rlike("(?s)^[^:]*:.+")
