"""Periodic runs of words by block convolution.

A run is a maximal stretch of words with smallest period q and at least ``max(MIN_WORDS, MIN_TURNS * q)``
words. At every dyadic scale B the text is cut into blocks of B words. A run with a period of B to 2B - 1
words holds a whole block within its first two turns, and that block comes again one period later. The sums
of squared differences between the block and all places of the window behind it come from one number
theoretic transform and are exact integers; a sum of zero gives the distance, from which the run is extended.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from longitrack.llm.wordcount import let, words

MIN_WORDS = 6
MIN_TURNS = 4
# A prime with roots of unity for every power of two up to 2^23, and a generator of its group.
PRIME = 998_244_353
GENERATOR = 3
# Words of a block that are compared; of longer blocks the beginning is compared, in several windows.
LONGEST_BLOCK = 1 << 15
# Words transformed at a time.
CELLS = 1 << 19
# Primes and bases of the prefix hashes that extensions are measured with; every run is checked word by word.
HASHES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 69_069_001))

# Words of a block that are compared with its second return before an extension is measured.
PROBES = 8

Run = tuple[int, int, int]  # start, length, period


@cache
def _roots(size: int, inverse: bool) -> np.ndarray:
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    out = np.ones(max(1, size // 2), np.uint64)
    done = 1
    while done < len(out):  # doubling: the next powers are the known ones times the root to the known number
        more = out[:done] * np.uint64(pow(root, done, PRIME)) % np.uint64(PRIME)
        out[done:2 * done] = more[:len(out) - done]
        done *= 2
    return out


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number theoretic transform of every row (a power of two long), not scaled."""
    m, size = rows.shape
    prime, n, s, x = np.uint64(PRIME), size, 1, rows.astype(np.uint64)
    roots = _roots(size, inverse)
    while n > 1:
        half = n // 2
        x = x.reshape(m, n, s)
        a, b = x[:, :half], x[:, half:]
        y = np.empty((m, half, 2, s), np.uint64)
        y[:, :, 0] = (a + b) % prime
        y[:, :, 1] = (a + (prime - b)) % prime * roots[::s][:half, None] % prime
        x, n, s = y, half, s * 2
    return x.reshape(m, size)


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences of each block (L values) and every place 0 .. L of its window (2 L values).

    Exact as long as L times the square of the largest value is below ``PRIME``.
    """
    length = blocks.shape[1]
    size = 2 * length
    padded = np.zeros((len(blocks), size), np.uint64)
    padded[:, :length] = blocks
    product = transform(padded, inverse=True) * transform(windows) % np.uint64(PRIME)
    scale = np.uint64(pow(size, -1, PRIME))
    cross = (transform(product, inverse=True) * scale % np.uint64(PRIME))[:, :length + 1].astype(np.int64)
    squares = np.zeros((len(windows), size + 1), np.int64)
    np.cumsum(windows.astype(np.int64) ** 2, axis=1, out=squares[:, 1:])
    return (blocks.astype(np.int64) ** 2).sum(1)[:, None] + squares[:, length:] - squares[:, :length + 1] - 2 * cross


class Extender:
    """How far the words keep a period on both sides of many places at once, by prefix hashes."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.levels = max(1, self.n.bit_length())
        self.tables = []
        for prime, base in HASHES:
            power = np.ones(self.n + 1, np.uint64)
            done = 1
            while done <= self.n:
                more = power[:done] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
                power[done:2 * done] = more[:self.n + 1 - done]
                done *= 2
            total = np.zeros(self.n + 1, np.uint64)
            values = (ids.astype(np.uint64) * np.uint64(2_654_435_761) + np.uint64(12_345)) % np.uint64(prime)
            np.cumsum(values * power[:-1] % np.uint64(prime), out=total[1:])
            self.tables.append((np.uint64(prime), power, total % np.uint64(prime)))

    def _same(self, a: np.ndarray, d: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``a`` and from ``a + d`` have equal hashes."""
        out = np.ones(len(a), bool)
        for prime, power, total in self.tables:
            one = (total[a + length] + (prime - total[a])) % prime
            two = (total[a + d + length] + (prime - total[a + d])) % prime
            out &= one * power[d] % prime == two
        return out

    def stretches(self, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch around word ``at`` with period ``d``."""
        ahead, back = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for level in range(self.levels, -1, -1):
            step = 1 << level
            more = ahead + step
            fits = at + d + more <= self.n
            if fits.any():
                k = np.flatnonzero(fits)
                ahead[k[self._same(at[k], d[k], more[k])]] += step
            more = back + step
            fits = more <= at
            if fits.any():
                k = np.flatnonzero(fits)
                back[k[self._same(at[k] - more[k], d[k], more[k])]] += step
        return at - back, at + d + ahead


def _seeds(ids: np.ndarray, starts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of every place at a distance of ``scale`` to 2 ``scale`` - 1 that shows no mismatch."""
    length = min(scale, LONGEST_BLOCK)
    codes = ids % isqrt((PRIME - 1) // length)  # keeps the sums below the prime; equal words keep equal codes
    at, distance = [], []
    step = max(1, CELLS // (2 * length))
    for first in range(0, len(starts), step):
        own = starts[first:first + step]
        blocks = codes[own[:, None] + np.arange(length)]
        for shift in range(scale, 2 * scale, length):
            places = own[:, None] + shift + np.arange(2 * length)
            zero = mismatches(blocks, codes[np.minimum(places, len(ids) - 1)])[:, :length] == 0
            zero &= (places[:, :length] + length <= len(ids))
            row, place = np.nonzero(zero)
            at.append(own[row])
            distance.append(shift + place)
    return np.concatenate(at), np.concatenate(distance)


def _comes_twice(ids: np.ndarray, at: np.ndarray, d: np.ndarray, scale: int) -> np.ndarray:
    """Whether some words of the block, spread over it, come again after two distances too: of a run with four
    turns, whose first two hold the block, they must."""
    out = at + 2 * d + scale <= len(ids)
    for i in sorted({k * (scale - 1) // (PROBES - 1) for k in range(PROBES)}):
        own = np.flatnonzero(out)
        out[own] = ids[at[own] + i] == ids[at[own] + 2 * d[own] + i]
    return out


def _covered(runs: list[Run], at: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Whether one known run holds all words from ``at`` to ``upto``."""
    if not runs:
        return np.zeros(len(at), bool)
    own = sorted((start, start + length) for start, length, _ in runs)
    starts, ends = np.asarray([s for s, _ in own]), np.maximum.accumulate([e for _, e in own])
    before = np.searchsorted(starts, at, "right") - 1
    return (before >= 0) & (ends[before] >= upto)


def _extended(ids: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The stretch around ``at`` with period ``d``, word by word."""
    differs = np.flatnonzero(ids[:-d] != ids[d:])
    k = int(np.searchsorted(differs, at))
    return int(differs[k - 1]) + 1 if k else 0, (int(differs[k]) if k < len(differs) else len(ids) - d) + d


def find_runs(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers, by start and then period.

    Blocks are left out only where they cannot give a new run: if one of their words does not come again
    within the distances of the scale, or if the block and its window lie in a known run, whose period
    then divides every such distance.
    """
    n = len(ids)
    if n < MIN_WORDS:
        return []
    order = np.argsort(ids, kind="stable")
    again = np.full(n, n, np.int64)  # distance to the next place of the same word
    same = ids[order[1:]] == ids[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found: dict[tuple[int, int], int] = {}
    runs: list[Run] = []
    extender, scale = None, 1
    while MIN_TURNS * scale <= n:
        blocks = n // scale
        starts = np.flatnonzero(again[:blocks * scale].reshape(blocks, scale).max(1) < 2 * scale) * scale
        starts = starts[starts + 2 * scale <= n]
        starts = starts[~_covered(runs, starts, np.minimum(starts + 3 * scale, n))]
        if len(starts):
            at, d = _seeds(ids, starts, scale)
            new = ~_covered(runs, at, at + d + scale) & _comes_twice(ids, at, d, scale)
            at, d = at[new], d[new]
            if len(at):
                extender = extender or Extender(ids)
                begin, end = extender.stretches(at, d)
                long = end - begin >= np.maximum(MIN_WORDS, MIN_TURNS * d)
                for b, e, q, i in zip(begin[long].tolist(), end[long].tolist(), d[long].tolist(), at[long].tolist()):
                    if found.get((b, e), n) <= q:
                        continue
                    if not np.array_equal(ids[b:e - q], ids[b + q:e]):  # equal hashes of different words
                        b, e = _extended(ids, i, q)
                        if e - b < max(MIN_WORDS, MIN_TURNS * q) or found.get((b, e), n) <= q:
                            continue
                    found[b, e] = q
                runs = [(b, e - b, q) for (b, e), q in found.items()]
        scale *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay when every run is cut down to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (array of start, length, period) and the collapsed text.

    Words are separated by ASCII white space and compared byte by byte. The collapsed text holds the words
    that lie in no run after its first period, joined by one space. A null or blank text has no words, no
    runs and an empty collapsed text; rows alike are judged each for itself, a null doc_id stays null, and
    other columns are ignored. One text is held by one task, whatever its length.
    """
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found, collapsed = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                own = (text.as_py() or b"").split()  # bytes are split at ASCII white space only
                number: dict[bytes, int] = defaultdict(count().__next__)
                ids = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
                runs = find_runs(ids) if len(number) < len(own) else []
                n_words.append(len(own))
                found.append([{"start": s, "length": k, "period": q} for s, k, q in runs])
                if runs:
                    own = [own[i] for i in np.flatnonzero(kept_words(len(own), runs)).tolist()]
                collapsed.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(kind)), pa.array(collapsed, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        judge, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def unrolled(text: Column, doc_id: Column) -> Column:
    """``text`` with its tail repeated for one document in ten, as the checksum of the id says.

    With h the checksum, g = floor(h / 10) and n words, every word i >= a becomes word a + (i - a) % p, where
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts, also those without words or id, stay.
    """
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))

    def turned(own: Column) -> Column:
        n, g = F.size(own).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))

        def word(i: Column) -> Column:
            return F.get(own, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))

        return F.when(n == 0, F.lit("")).otherwise(
            F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long"))), word), " "))

    return F.when((h % 10 == 0) & text.isNotNull(), let(words(text), turned)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of ``documents``, tails repeated as ``unrolled`` says.

    doc_id, n_runs; start, length, period and exponent_milli of the run with the greatest length / period
    (ties: smallest start, then period; null without a run); checksums of all runs and of the collapsed
    text; n_words. Null texts are empty, an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", unrolled(F.col("text"), F.col("doc_id")).alias("text")))

    def better(a: Column, b: Column) -> Column:
        """The run of greater exponent; products of two word counts fit 64 bits. Runs come by start and period."""
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    best = F.aggregate("runs", F.get(F.col("runs"), F.lit(0)), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
