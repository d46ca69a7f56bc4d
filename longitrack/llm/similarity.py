"""N-gram Jaccard join: components of documents whose word shingle sets overlap enough.

The join is a sparse product of the incidence matrix document by shingle with its transpose, of which
only entries that can reach the threshold are ever formed:

* Texts with equal shingle sets are one class; only classes are compared.
* All shingles have one global order, by frequency and then by hash. Frequencies come from a table of
  counters of fixed size, so that the order is known to every task; a wrong count costs time, not links.
* Two linked classes share a shingle within the first ``n - ceil(t n) + 1`` of each. Only these columns
  are multiplied. The place of the first common shingle bounds the overlap, which discards most pairs.
* A column that many near copies share is not multiplied with itself. Each column is first compared with
  one pivot, the row with the fewest rarer shingles. Rows whose components then agree need no more work;
  the pairs left over in a column are those between different components.
* Surviving pairs are multiplied in full, in blocks: a task gets the texts of some pairs, builds the
  incidence rows of the block's documents over the block's shingles, and counts overlaps at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from longitrack.llm.tokens import gathered, return_memory
from longitrack.session import materialise

SHINGLE_WORDS = 4
PERCENT = 85
# Counters of the frequency table and bits of the membership table; both sizes are fixed.
COUNTERS = 1 << 24
MEMBER_BITS = 1 << 26
CHUNK_SLOTS = 1 << 16
# Bits of the table of wanted document ids.
WANTED_BITS = 1 << 23
# Pairs multiplied in one block.
BLOCK_PAIRS = 64
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _MIX[3]
    x = (x ^ (x >> np.uint64(29))) * _MIX[0]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, an empty one none.

    A-Z are lower-cased; words are separated by ASCII white space.
    """
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    width = min(words, len(own))
    out = np.full(len(own) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out + hashes[k:len(out) + k]) * _MIX[1] + _MIX[2]
    return np.unique(mixed(out))


def class_key(found: np.ndarray) -> int:
    """Signed 64-bit name of a shingle set."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least size of a set, and least overlap, that a set of size n may be linked with."""
    return -(-percent * n // 100)


def prefix(found: np.ndarray, frequency: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a link must touch, in the global order; their places are 0, 1, ..."""
    order = np.argsort((frequency[found % np.uint64(len(frequency))].astype(np.uint64) << np.uint64(56)) | (found >> np.uint64(8)), kind="stable")
    n = len(found)
    return found[order[:n - int(needed(n, percent)) + 1]] if n else found


def _table_chunks(table: np.ndarray):
    """(number, data) of the chunks of a task's table that are not all zero, compressed."""
    for at in range(0, len(table), CHUNK_SLOTS):
        part = table[at:at + CHUNK_SLOTS]
        if part.any():
            yield at // CHUNK_SLOTS, zlib.compress(part.tobytes(), 1)


def merged_table(chunks: DataFrame, size: int, dtype, add, finish=lambda table: table) -> np.ndarray:
    """The tables of all tasks as one byte table: chunks meet by number, each task adds up and finishes its own."""

    def merge(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                part = np.frombuffer(zlib.decompress(data.as_py()), dtype)
                totals[number] = add(totals[number], part) if number in totals else part
        if totals:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(totals), pa.int32()), pa.array([zlib.compress(finish(t).tobytes(), 1) for t in totals.values()], pa.binary())],
                names=["chunk", "data"])

    out = np.zeros(size, np.uint8)
    for row in chunks.select("chunk", "data").repartition(F.col("chunk")).mapInArrow(merge, "chunk int, data binary").collect():
        at = row["chunk"] * CHUNK_SLOTS
        out[at:at + CHUNK_SLOTS] = np.frombuffer(zlib.decompress(row["data"]), np.uint8)
    return out


def eighths(counts: np.ndarray) -> np.ndarray:
    """Eighths of a power of two: enough for an order, and they fit into a byte."""
    return np.minimum(255, 8 * np.log2(np.maximum(1, counts))).astype(np.uint8)


def classes_and_frequencies(docs: DataFrame, words: int, counters: int) -> DataFrame:
    """One pass: a row (doc_id, key, n) per document, and rows (chunk, data) of the counters of each task."""

    def scan(batches):
        return_memory()
        counts = np.zeros(counters, np.uint32)
        for batch in batches:
            keys, sizes, seen = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), words)
                keys.append(class_key(found))
                sizes.append(len(found))
                seen.append(found)
                if len(seen) == 256:
                    _count(counts, seen)
            _count(counts, seen)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", "key", "n", "chunk", "data"])
        for number, data in _table_chunks(counts):
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                pa.array([number], pa.int32()), pa.array([data], pa.binary())], names=["doc_id", "key", "n", "chunk", "data"])

    def _count(counts, seen):
        if seen:
            slots = (np.concatenate(seen) % np.uint64(counters)).astype(np.int64)
            np.add.at(counts, slots, np.uint32(1))
            seen.clear()

    return docs.mapInArrow(scan, "doc_id long, key long, n long, chunk int, data binary")


def postings(docs: DataFrame, frequency, words: int, percent: int) -> DataFrame:
    """(shingle, key, n, place) of every prefix shingle of every document."""

    def emit(batches):
        return_memory()
        for batch in batches:
            parts, keys, sizes, places = [], [], [], []

            def rows():
                counts = np.asarray([len(p) for p in parts])
                return pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.asarray(keys, np.int64), counts)),
                    pa.array(np.repeat(np.asarray(sizes, np.int32), counts)), pa.array(np.concatenate(places).astype(np.int32)),
                ], names=["shingle", "key", "n", "place"])

            for text in batch.column("text"):
                found = shingles(text.as_py(), words)
                if len(found):
                    parts.append(prefix(found, frequency.value, percent))
                    keys.append(class_key(found))
                    sizes.append(len(found))
                    places.append(np.arange(len(parts[-1])))
                if len(parts) >= 1000:
                    yield rows()
                    parts, keys, sizes, places = [], [], [], []
            if parts:
                yield rows()

    return docs.select("text").mapInArrow(emit, "shingle long, key long, n int, place int")


def is_member(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    slots = values % np.uint64(len(table) * 8)
    return (table[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def member_table(values: DataFrame, bits: int) -> np.ndarray:
    """Bit table of the one column of ``values`` (long, not null); other values may be taken for members."""

    def mark(batches):
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            slots = batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)
            np.bitwise_or.at(table, (slots >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slots & np.uint64(7)).astype(np.uint8))
        for number, data in _table_chunks(table):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([data], pa.binary())], names=["chunk", "data"])

    return merged_table(values.mapInArrow(mark, "chunk int, data binary"), bits // 8, np.uint8, np.bitwise_or)


def candidates(docs: DataFrame, frequency, members, words: int, percent: int) -> DataFrame:
    """Documents with prefix shingles among ``members``: (doc_id, key, n, shingles, places)."""

    def emit(batches):
        return_memory()
        for batch in batches:
            out = {k: [] for k in ("row", "key", "n", "shingles", "places")}
            for row, text in enumerate(batch.column("text")):
                found = shingles(text.as_py(), words)
                if not len(found):
                    continue
                first = prefix(found, frequency.value, percent)
                hit = np.flatnonzero(is_member(members.value, first))
                if len(hit):
                    for k, v in zip(out, (row, class_key(found), len(found), first[hit].view(np.int64), hit.astype(np.int32))):
                        out[k].append(v)
            if out["row"]:
                rows = pa.array(out["row"])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(rows), pa.array(out["key"], pa.int64()), pa.array(out["n"], pa.int32()),
                    pa.array(out["shingles"], pa.list_(pa.int64())), pa.array(out["places"], pa.list_(pa.int32())),
                ], names=["doc_id", "key", "n", "shingles", "places"])

    return docs.mapInArrow(emit, "doc_id long, key long, n int, shingles array<long>, places array<int>")


def texts_of(docs: DataFrame, pairs: DataFrame, heads: DataFrame, words: int) -> DataFrame:
    """(key, text): one text for every class in ``pairs`` (a, b).

    The texts are found by the doc_ids of ``heads``, through a bit table of fixed size, so that few others
    are shuffled; the name of the set decides.
    """
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = materialise(heads.select("key", "doc_id").join(keys, "key"))
    table = docs.sparkSession.sparkContext.broadcast(member_table(wanted.where("doc_id is not null").select("doc_id"), WANTED_BITS))

    def fetch(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            hit = np.flatnonzero(is_member(table.value, ids.fill_null(0).to_numpy().view(np.uint64)) | ids.is_null().to_numpy(zero_copy_only=False))
            if len(hit):
                own = texts.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([pa.array([class_key(shingles(t.as_py(), words)) for t in own], pa.int64()), own], names=["key", "text"])

    return materialise(docs.mapInArrow(fetch, "key long, text string").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]))




def may_link(n_a: Column, place_a: Column, n_b: Column, place_b: Column, percent: int) -> Column:
    """Whether two sets whose first common shingle has these places can overlap enough."""
    return F.least(n_a - place_a, n_b - place_b) * (100 + percent) >= (n_a + n_b) * percent


def linked_pairs(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are linked; ``texts`` has (key, text) of every class."""

    def multiply(batches):
        return_memory()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_PAIRS):
                own = batch.slice(at, BLOCK_PAIRS)
                a, b = own.column("a").to_pylist(), own.column("b").to_pylist()
                rows: dict[int, int] = {}
                sets: list[np.ndarray] = []
                for keys, column in ((a, "text_a"), (b, "text_b")):
                    for key, text in zip(keys, own.column(column)):
                        if key not in rows:
                            rows[key] = len(sets)
                            sets.append(shingles(text.as_py(), words))
                overlap = masked_product(sets, [rows[k] for k in a], [rows[k] for k in b])
                n = np.asarray([len(s) for s in sets])
                n_a, n_b = n[[rows[k] for k in a]], n[[rows[k] for k in b]]
                hit = pa.array(100 * overlap >= percent * (n_a + n_b - overlap))
                yield pa.RecordBatch.from_arrays([own.column("a").filter(hit), own.column("b").filter(hit)], names=["a", "b"])

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(multiply, "a long, b long")


def masked_product(sets: list[np.ndarray], a: list[int], b: list[int]) -> np.ndarray:
    """Overlap counts of the pairs (a[i], b[i]): entries of the sparse product of the block's incidence matrix.

    Row b[i] is scattered over the block's columns once; the columns of the rows a[i] paired with it are
    gathered and added up.
    """
    columns, which = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
    sizes = np.asarray([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(len(a), np.int64)
    line = np.zeros(len(columns), np.int64)
    a, b = np.asarray(a), np.asarray(b)
    for row in np.unique(b):
        own = which[starts[row]:starts[row] + sizes[row]]
        line[own] = 1
        at = np.flatnonzero(b == row)
        counts = sizes[a[at]]
        values = np.concatenate([[0], np.cumsum(line[which[gathered(starts[a[at]], counts)]])])
        ends = np.cumsum(counts)
        out[at] = values[ends] - values[ends - counts]
        line[own] = 0
    return out


def connected(links: DataFrame) -> DataFrame:
    """(key, component) of every key in ``links`` (a, b): the least key reachable.

    Every key takes the least label among its neighbours, then the label of its label, until no label
    changes. A round is one aggregation with partial sums and one join; it is written before the next.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = materialise(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "component"), "b").groupBy(F.col("a").alias("key")).agg(F.min("component").alias("near"))
        stepped = materialise(labels.join(near, "key").select("key", F.col("component").alias("old"), F.least("component", "near").alias("new")))
        jumped = stepped.alias("s").join(stepped.select(F.col("key").alias("at"), F.col("new").alias("next")), F.col("s.new") == F.col("at"))
        after = materialise(jumped.select("s.key", "s.old", F.least("s.new", "next").alias("component")))
        labels = after.select("key", "component")
        if after.where("component <> old").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, counters: int = COUNTERS, member_bits: int = MEMBER_BITS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text); other columns are ignored.

    Null and empty texts have no shingles and are linked with nothing, so their component is their own
    doc_id. Rows with a null doc_id take part and get the least doc_id that is not null, or null. Set
    names are 64-bit hashes; together with the set's size they stand for the set.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    scanned = materialise(classes_and_frequencies(docs, words, counters))
    frequency = spark.sparkContext.broadcast(
        merged_table(scanned.where("chunk is not null"), counters, np.uint32, np.add, eighths))
    rows = scanned.where("chunk is null").select("doc_id", "key", "n")

    posted = postings(docs, frequency, words, percent)
    # min and max tell whether a column has two classes; repeated rows and copies cost nothing.
    columns = materialise(
        posted.groupBy("shingle").agg(
            F.min("key").alias("low"), F.max("key").alias("high"),
            F.min(F.struct("place", "n", "key")).alias("pivot"))
        .where("low <> high").select("shingle", "pivot"))
    members = spark.sparkContext.broadcast(member_table(columns.select("shingle"), member_bits))
    found = materialise(candidates(docs, frequency, members, words, percent))
    # One row stands for a class: all its texts have the same set. Copies collapse before the shuffle.
    heads = materialise(found.dropDuplicates(["key"]))
    entries = materialise(
        heads.select("key", "n", F.explode(F.arrays_zip("shingles", "places")).alias("e"))
        .select(F.col("e.shingles").alias("shingle"), "key", "n", F.col("e.places").alias("place"))
        .join(columns, "shingle"))

    star = entries.where(
        (F.col("key") != F.col("pivot.key")) & may_link(F.col("n"), F.col("place"), F.col("pivot.n"), F.col("pivot.place"), percent)
    ).select(F.col("key").alias("a"), F.col("pivot.key").alias("b")).distinct()
    star = materialise(star)
    links = materialise(linked_pairs(star, texts_of(docs, star, heads, words), words, percent))
    labels = connected(links)

    labelled = entries.join(labels, "key", "left").select(
        "shingle", "key", "n", "place", F.coalesce("component", "key").alias("component"))
    open_ = labelled.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
    left = materialise(labelled.join(open_, "shingle"))
    a, b = left.alias("a"), left.alias("b")
    crossing = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.key") < F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & may_link(
        F.col("a.n"), F.col("a.place"), F.col("b.n"), F.col("b.place"), percent)).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = materialise(crossing.join(tried, ["a", "b"], "left_anti"))
    more = linked_pairs(crossing, texts_of(docs, crossing, heads, words), words, percent)
    labels = connected(materialise(links.union(more)))

    # From classes to documents: the least doc_id of all classes of a component.
    named = rows.where("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("least")).join(labels, "key", "left")
    named = materialise(named.select("key", "n", "least", F.coalesce("component", "key").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "component").select("key", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").join(of_class, ["key", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The row of ``docs`` with the least doc_id of every component; all columns are kept.

    Of rows alike in doc_id and text one stays; rows with a null doc_id all stay.
    """
    kept = near_duplicates(docs, **options).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Every pair that shares a shingle is counted, so this is for small tables.
OP10_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM sets),
flat AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT o.a, o.b FROM shared o JOIN sizes x ON x.doc_id = o.a JOIN sizes y ON y.doc_id = o.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY 1, 2
"""
