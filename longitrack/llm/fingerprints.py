"""Threshold-scaled document fingerprints, in DataFrame functions only.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range. Whatever their sizes,
two documents keep the same part of what they share, so fingerprints estimate containment and likeness,
and the fingerprint of a union is made of the two fingerprints. A text whose hashes all lie above the
limit keeps its least one, which a union respects as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from longitrack.llm.wordcount import hashes, let, windows, words
from longitrack.operators.ordering import global_rank
from longitrack.session import materialise

SHINGLE_WORDS = 5
# One hash in so many is kept.
SCALE = 8


def _limit(scale: int) -> int:
    """Hashes are signed; those up to this value are the lowest 1 / scale."""
    return -(1 << 63) + (1 << 64) // scale - 1


def _thinned(found: Column, scale: int) -> Column:
    """Sorted distinct hashes below the limit, or the least hash if none is."""
    def thin(own: Column) -> Column:
        return let(F.filter(own, lambda h: h <= F.lit(_limit(scale))), lambda low: F.when(
            F.size(low) > 0, F.sort_array(F.array_distinct(low))).when(F.size(own) > 0, F.array(F.array_min(own))).otherwise(low))

    return let(found, thin)


def sketch(text: Column, k: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """The kept hashes of ``text``, ascending. Fewer than ``k`` words are one shingle; no words, no hash."""
    def shingled(own: Column) -> Column:
        return F.when(F.size(own) >= k, windows(own, k)).when(F.size(own) > 0, F.array(F.xxhash64(own))).otherwise(
            F.array().cast("array<bigint>"))

    return _thinned(let(hashes(words(text)), shingled), scale)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of a set that holds the shingles of both."""
    return _thinned(F.array_union(a, b), scale)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches, 0 if only one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 if ``a`` is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def fingerprint(kept: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(kept, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(docs: DataFrame, text: str = "text", k: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """Adds ``sketch`` and ``fingerprint`` of column ``text`` to ``docs``."""
    return docs.withColumn("sketch", sketch(F.col(text), k, scale)).withColumn("fingerprint", fingerprint(F.col("sketch")))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next lower id, or the highest for the lowest one; null ids are left out.

    Only the ids are sorted, by ranges; repeated ids count once.
    """
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    ranked = materialise(global_rank(ids, [F.col("doc_id")], out="place"))
    top = ranked.agg(F.max("place").alias("place"))
    first = ranked.join(top, "place").select(F.lit(1).cast("long").alias("place"), F.col("doc_id").alias("next_id"))
    after = ranked.select((F.col("place") + 1).alias("place"), F.col("doc_id").alias("next_id")).unionByName(first)
    return materialise(ranked.join(after, "place").select("doc_id", "next_id"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness, per row of ``docs``.

    The edited text ends with the beginning of the next document instead of its own last third. Null
    texts are empty; a row with a null doc_id has no next document, so nothing replaces its end. Of
    rows with one doc_id any may stand for the next document.
    """
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    # A cast that does nothing would leave an alias in one join only, and the texts would be shuffled for each.
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known, unknown = own.where("doc_id is not null"), own.where("doc_id is null")
    n_chars = F.char_length("text").cast("long")
    cut = F.floor(n_chars / 3).cast("int")
    # What a document needs of the next one: the most characters that any of its rows replaces.
    need = materialise(known.groupBy("doc_id").agg(F.max(cut).alias("cut")).join(neighbours(known), "doc_id"))
    # Both joins deal the texts by doc_id in the same form, so that they are shuffled once.
    heads = known.join(need.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("of"), "cut"), "doc_id")
    heads = heads.select(F.col("of").alias("doc_id"), F.substring("text", F.lit(1), F.col("cut")).alias("head"), sketch(F.col("text")).alias("next_sketch"))
    heads = heads.groupBy("doc_id").agg(F.min_by(F.struct("head", "next_sketch"), "head").alias("next"))
    joined = known.join(heads, "doc_id", "left").unionByName(unknown, allowMissingColumns=True)
    joined = joined.withColumn("n_chars", n_chars).withColumn("cut", cut)
    stem = F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int"))
    edited = F.concat(stem, F.coalesce(F.substring(F.col("next.head"), F.lit(1), F.col("cut")), F.lit("")))
    both = joined.select(
        "doc_id", "n_chars", edited.alias("edited"), sketch(F.col("text")).alias("own"), F.col("next.next_sketch").alias("next_sketch"))
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", sketch(F.col("edited")).alias("changed"), "next_sketch")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.coalesce("next_sketch", F.array().cast("array<bigint>"))).alias("near_next"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
