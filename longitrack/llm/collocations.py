"""Phrase collocations by mergeable Misra-Gries summaries.

First pass: every slice of texts counts the fingerprints of its phrases per hash partition. A partition merges
these summaries with more counters than its mass divided by the threshold, so that every phrase that reaches
the threshold keeps a counter, and tells each slice which of its fingerprints still may be frequent. Second pass:
the slices count exactly those phrases, by their words. Scores and ranks are DataFrame joins.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from longitrack.operators.ordering import global_rank
from longitrack.session import materialise

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
# A candidate is dropped for a longer one with at least this share of its occurrences.
HELD_PERCENT = 80
NO_LANG = "und"
# Bytes of text in a slice, and bytes split into words at a time.
SLICE_BYTES = 4 << 20
SPLIT_BYTES = 1 << 20
# Bytes of text for each hash partition, and the least number of partitions. As there are at most two phrases of
# each size for three bytes, a partition holds a few million occurrences at every size of the input.
PARTITION_BYTES = 4 << 20
LEAST_PARTITIONS = 64
# Counters of a merged summary, in multiples of mass / threshold. Any number from one on keeps every frequent phrase.
CAPACITY = 4

# Lower case for A-Z; piece borders become line feeds and tabs spaces. All are single bytes in UTF-8.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_FACTORS = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_GAP, _BREAK = 0, 1


def slices(docs: DataFrame) -> DataFrame:
    """(slice, lang, size, body): the texts of one language laid together, up to about ``SLICE_BYTES``.

    ``body`` has A-Z in lower case, a line feed between pieces and spaces between words. The numbers of slices
    come from the task that makes them, so the result must be written before it is used twice.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = count(TaskContext.get().partitionId() << 33)
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = defaultdict(int)

        def flush(lang: str) -> pa.RecordBatch:
            body = b"\n".join(held.pop(lang))
            sizes.pop(lang)
            return pa.RecordBatch.from_arrays(
                [pa.array([next(number)], pa.int64()), pa.array([lang]), pa.array([len(body)], pa.int64()), pa.array([body], pa.binary())],
                names=["slice", "lang", "size", "body"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary())):
                body = (text.as_py() or b"").translate(_PLAIN)
                held.setdefault(lang, []).append(body)
                sizes[lang] += len(body)
                if sizes[lang] >= SLICE_BYTES:
                    yield flush(lang)
                elif sum(sizes.values()) >= 4 * SLICE_BYTES:
                    yield flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield flush(lang)

    own = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), "text")
    return own.mapInArrow(cut, "slice long, lang string, size long, body binary")


class Words:
    """The words of one slice as numbers, with ``_BREAK`` between pieces."""

    def __init__(self, body: bytes):
        table: dict[bytes, int] = defaultdict(count().__next__)
        assert (table[b""], table[b"\n"]) == (_GAP, _BREAK)
        parts, at = [], 0
        while at < len(body):
            end = body.find(b"\n", at + SPLIT_BYTES)
            end = len(body) if end < 0 else end
            told = body[at:end].replace(b"\n", b" \n ").split(b" ")
            own = np.fromiter(map(table.__getitem__, told), np.int32, len(told))
            parts += [own[own != _GAP], np.asarray([_BREAK], np.int32)]
            at = end + 1
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.told = list(table)

    def hashes(self) -> np.ndarray:
        """Two 64-bit hashes of every distinct word."""
        raw = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in self.told)
        return np.frombuffer(raw, "<u8").reshape(-1, 2).T.copy()


def phrase_hashes(own: np.ndarray, size: int, lang: str) -> np.ndarray:
    """Hash of the ``size`` words from every place on, given the hash of every word."""
    seed = np.uint64(int.from_bytes(hashlib.blake2b(f"{size} {lang}".encode(), digest_size=8).digest(), "little"))
    n = len(own) - size + 1
    out = np.full(max(n, 0), seed)
    for j in range(size):
        out += own[j:j + len(out)] * _FACTORS[j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(29)
    return out


def _keys(hashed: np.ndarray, partitions: int) -> np.ndarray:
    """Hash partition in the high and fingerprint in the low 32 bits."""
    part = ((hashed >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)
    return part << np.uint64(32) | hashed & np.uint64(0xFFFFFFFF)


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2^32 as four rows of bytes, of which the higher are mostly zero and compress well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _packed(sorted_values: np.ndarray) -> bytes:
    return _planes(np.diff(sorted_values.astype(np.int64), prepend=0))


def _unpacked(planes: bytes) -> np.ndarray:
    return np.cumsum(_numbers(planes))


def summaries(cut: DataFrame, partitions: int, longest: int = LONGEST) -> DataFrame:
    """(part, slice, mass, prints, counts): how often each fingerprint occurs in a slice, by hash partition."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, lang, body in zip(*[batch.column(c) for c in ("slice", "lang", "body")]):
                words = Words(body.as_py())
                hashed, real, keys = words.hashes()[0][words.ids], words.ids != _BREAK, []
                inside = real
                for size in range(1, longest + 1):
                    inside = inside[:max(0, len(real) - size + 1)] & real[size - 1:]
                    keys.append(_keys(phrase_hashes(hashed, size, lang.as_py())[inside], partitions))
                del words, hashed
                keys = np.concatenate(keys)
                keys.sort()
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                counts = np.diff(np.append(first, len(keys)))
                keys = keys[first]
                bounds = np.searchsorted(keys, np.arange(partitions + 1, dtype=np.uint64) << np.uint64(32))
                filled = np.flatnonzero(np.diff(bounds))
                rows = [(int(p), int(counts[a:b].sum()), _packed(keys[a:b] & np.uint64(0xFFFFFFFF)), _planes(counts[a:b]))
                        for p, a, b in zip(filled, bounds[filled], bounds[filled + 1])]
                part, mass, prints, planes = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array([number.as_py()] * len(rows), pa.int64()), pa.array(mass, pa.int64()),
                     pa.array(prints, pa.binary()), pa.array(planes, pa.binary())],
                    names=["part", "slice", "mass", "prints", "counts"])

    return cut.select("slice", "lang", "body").mapInArrow(summarise, "part int, slice long, mass long, prints binary, counts binary")


class Summary:
    """Misra-Gries counters of at most ``capacity`` fingerprints. A counter is too small by at most ``error``."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.prints, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, prints: np.ndarray, counts: np.ndarray) -> None:
        """Add counters; equal fingerprints add up. Then the (capacity + 1)-th largest is taken off all."""
        prints, counts = np.concatenate([self.prints, prints]), np.concatenate([self.counts, counts])
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
        if len(first):
            prints, counts = prints[first], np.add.reduceat(counts, first)
        if len(prints) > self.capacity:
            at = len(counts) - self.capacity - 1
            less = int(np.partition(counts, at)[at])
            counts = counts - less
            self.error += less
            prints, counts = prints[counts > 0], counts[counts > 0]
        self.prints, self.counts = prints, counts

    def reaching(self, least: int) -> np.ndarray:
        """Fingerprints, ascending, that may occur ``least`` times; none that does is missing."""
        return self.prints[self.counts + self.error >= least]


def survivors(summed: DataFrame, least: int = MIN_COUNT, capacity: int = CAPACITY) -> DataFrame:
    """(slice, part, prints): for every slice, its fingerprints that may be frequent in all texts."""

    def merge(group: pa.Table) -> pa.Table:
        mass = sum(group.column("mass").to_pylist())
        summary = Summary(capacity * (mass // least) + 1)
        waiting, n_waiting = [], 0
        own = [_unpacked(b.as_py()) for b in group.column("prints")]
        for prints, planes in zip(own, group.column("counts")):
            waiting.append((prints, _numbers(planes.as_py())))
            n_waiting += len(prints)
            if n_waiting > summary.capacity:
                summary.merge(*map(np.concatenate, zip(*waiting)))
                waiting, n_waiting = [], 0
        if waiting:
            summary.merge(*map(np.concatenate, zip(*waiting)))
        kept = summary.reaching(least)
        rows = []
        for number, prints in zip(group.column("slice").to_pylist(), own):
            if len(common := prints[_among(prints, kept)]):
                rows.append((number, _packed(common)))
        part = group.column("part")[0].as_py()
        return pa.table({
            "slice": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int32()),
            "prints": pa.array([r[1] for r in rows], pa.binary())})

    return summed.groupBy("part").applyInArrow(merge, "slice long, part int, prints binary")


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values lie in the ascending array ``ordered``."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _exact_groups(hashed: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of every group of places that agree in both hashes."""
    order = np.argsort(hashed, kind="stable")
    new = np.concatenate([[True], hashed[order][1:] != hashed[order][:-1]])
    first = np.flatnonzero(new)
    if (other[order] != other[order[first]][np.cumsum(new) - 1]).any():  # one hash alone does not tell them apart
        order = np.lexsort((other, hashed))
        first = np.flatnonzero(np.concatenate(
            [[True], (hashed[order][1:] != hashed[order][:-1]) | (other[order][1:] != other[order][:-1])]))
    return order[first], np.diff(np.append(first, len(order)))


def exact_counts(cut: DataFrame, kept: DataFrame, partitions: int, longest: int = LONGEST) -> DataFrame:
    """(part, lang, phrases, sizes, counts): for every slice and hash partition, the phrases that may be frequent and
    how often they occur; in partition 0 also null with size 0 and the number of all words.

    A phrase is looked up only where both of its shorter parts may be frequent, as they are at least as
    frequent as the phrase."""

    def tally(left: pa.Table, right: pa.Table) -> pa.Table:
        parts, phrases, sizes, counts = [], [], [], []
        lang = left.column("lang")[0].as_py() if left.num_rows else NO_LANG
        for body in left.column("body"):
            words = Words(body.as_py())
            real = words.ids != _BREAK
            parts.append(np.zeros(1, np.int64))
            phrases.append(None)
            sizes.append(np.zeros(1, np.int32))
            counts.append(np.asarray([real.sum()], np.int64))
            prints = [_unpacked(p.as_py()).astype(np.uint64) | np.uint64(part.as_py() << 32)
                      for part, p in zip(right.column("part"), right.column("prints"))]
            prints = np.sort(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
            both, ids, told = words.hashes(), words.ids, words.told
            hashed, places = both[0][ids], np.flatnonzero(real)
            for size in range(1, longest + 1):
                if size > 1:  # both parts are among the places of the size before
                    found = np.zeros(len(ids) + 1, bool)
                    found[places] = True
                    places = places[found[places + 1]]
                keys = _keys(phrase_hashes(hashed, size, lang)[places], partitions)
                held = _among(keys, prints)
                places, keys = places[held], keys[held]
                if not len(places):
                    break
                first, number = _exact_groups(keys, phrase_hashes(both[1][ids], size, lang)[places])
                starts = places[first]
                parts.append((keys[first] >> np.uint64(32)).astype(np.int64))
                phrases += [b" ".join([told[i] for i in row]).decode() for row in ids[starts[:, None] + np.arange(size)].tolist()]
                sizes.append(np.full(len(number), size, np.int32))
                counts.append(number.astype(np.int64))
        parts = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        order = np.argsort(parts, kind="stable")
        own, first = np.unique(parts[order], return_index=True)
        offsets = pa.array(np.append(first, len(parts)).astype(np.int32))

        def lists(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(offsets, values.take(pa.array(order)))

        return pa.table({
            "part": pa.array(own, pa.int32()), "lang": pa.array([lang] * len(own), pa.string()),
            "phrases": lists(pa.array(phrases, pa.string())),
            "sizes": lists(pa.array(np.concatenate(sizes) if sizes else [], pa.int32())),
            "counts": lists(pa.array(np.concatenate(counts) if counts else [], pa.int64()))})

    return cut.groupBy("slice").cogroup(kept.groupBy("slice")).applyInArrow(
        tally, "part int, lang string, phrases array<string>, sizes array<int>, counts array<long>")


def totals(told: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, size, f): the exact sums of each hash partition that reach ``least``, and those of size 0."""

    def add(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lang = pc.take(group.column("lang").combine_chunks(), pc.list_parent_indices(group.column("phrases").combine_chunks()))
        flat = {new: pc.list_flatten(group.column(old).combine_chunks()) for new, old in (("phrase", "phrases"), ("size", "sizes"), ("f", "counts"))}
        summed = pa.table({"lang": lang, **flat}).group_by(["lang", "phrase", "size"]).aggregate([("f", "sum")])
        keep = pc.or_(pc.greater_equal(summed.column("f_sum"), least), pc.equal(summed.column("size"), 0))
        return summed.filter(keep).rename_columns({"f_sum": "f"}).select(["lang", "phrase", "size", "f"])

    return told.groupBy("part").applyInArrow(add, "lang string, phrase string, size int, f long")


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """A written table (lang, phrase, size, f): phrases of 1 to ``longest`` words that occur ``least`` times or more
    in the texts of a language; phrase null and size 0 for the number of all words.

    Phrases do not reach across ``[.,;:!?]`` or line ends, and overlapping occurrences count. A null language
    is ``und``; null and empty texts have no words.
    """
    cut = materialise(slices(docs))
    size = cut.agg(F.sum("size")).first()[0] or 0
    partitions = max(LEAST_PARTITIONS, -(-size // PARTITION_BYTES))
    kept = materialise(survivors(summaries(cut, partitions, longest), least))
    told = exact_counts(cut.select("slice", "lang", "body"), kept, partitions, longest)
    return materialise(totals(told, least))


def _big(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 a / (left + right)), exact also where the product passes 64 bits."""
    return F.call_function("div", _big(a) * F.lit(2_000_000).cast("decimal(7,0)"), _big(left) + _big(right)).cast("long")


def collocations(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, held_percent: int = HELD_PERCENT) -> DataFrame:
    """The first ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    A phrase is cut where the score floor(2000000 a / (l + r)) is least, at the smallest such place; a, l and r are
    the occurrences of the whole, the first and the rest. Phrases within a longer one that has
    ``held_percent`` of their occurrences are left out. Ties of the score go to the larger a, then to the
    phrase that comes first by its bytes. No texts give no rows; other columns are ignored.
    """
    table = frequent_phrases(docs, least, longest)
    known = table.where("size > 0").select("lang", "phrase", "f")
    phrases = table.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    at = F.col("k")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), at), " ").alias("first"),
        F.array_join(F.slice("words", at + 1, F.col("size") - at), " ").alias("rest"))
    parted = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = parted.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(cut_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    # Every part of two or more words of a longer phrase, and the most occurrences of such a phrase.
    width, start = F.col("width"), F.col("start")
    inner = phrases.where("size > 2").withColumn("width", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn(
        "start", F.explode(F.sequence(F.lit(1), F.col("size") - width + 1))).select(
        "lang", F.array_join(F.slice("words", start, width), " ").alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    held = F.coalesce(_big(F.col("longer")) * 100 >= _big(F.col("a")) * held_percent, F.lit(False))
    left = scored.join(longer, ["lang", "phrase"], "left").where(~held).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = global_rank(left, [F.desc("score"), F.desc("a"), F.asc("phrase")], ["lang"]).where(F.col("rank") <= top)
    words = table.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two to four words of all ``documents`` that occur 30 times or more, the best 2000 of each language.

    Null texts are empty, null languages are ``und``, repeated rows count as often as they occur.
    """
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
told AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM told GROUP BY lang),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM told),
grams AS (
  SELECT lang, k AS size, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM places, (VALUES (1), (2), (3), (4)) s(k) WHERE i + k - 1 <= len(words)),
known AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM known WHERE size > 1),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:size], ' ') AS tail
  FROM candidates, (VALUES (1), (2), (3)) s(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = c.head JOIN known y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, a, array_to_string(words[i:i + w - 1], ' ') AS phrase
  FROM candidates, (VALUES (2), (3)) s(w), (VALUES (1), (2), (3)) t(i) WHERE w < size AND i + w - 1 <= size),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
