"""Native expressions over the words of a text, shared by the operators that run without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Words are runs of anything but ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of ``text``; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def hashes(own: Column) -> Column:
    """64-bit hash of every word."""
    return F.transform(own, lambda w: F.xxhash64(w))


def windows(hashed: Column, k: int) -> Column:
    """64-bit hash of every ``k`` words in a row, in order; none if there are fewer words.

    ``hashed`` must be a column or a bound value, since it is read for every window.
    """
    last = F.size(hashed) - k
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(k)])))
