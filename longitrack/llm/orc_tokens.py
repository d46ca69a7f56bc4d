"""Token-id files: ORC with run-length encoded ids, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from longitrack.llm.tokens import row_slices, text_bytes, with_end, worker_encoder
from longitrack.session import materialise, shared_folder

SCHEMA = "shard int, row long, doc_id long, ids array<int>"
# ORC settings: rows per index entry, stripe size and false-positive rate of the Bloom filters.
ROWS_PER_INDEX = 1_000
STRIPE_BYTES = 16 << 20
BLOOM_FPP = 0.01


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """(shard, row, doc_id, ids) of rows that lie range-partitioned and sorted; null text is empty.

    ``shard`` is the partition, ``row`` the place in it; ids end with ``end_id``.
    """

    def encode(batches):
        encoder, row = worker_encoder(tokenizer), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for first, last in row_slices(offsets):
                own = offsets[first:last + 1]
                ids, cuts = with_end(*encoder.encode(data[own[0]:own[-1]], own - own[0]), end_id)
                yield pa.RecordBatch.from_arrays([
                    batch.column("shard").slice(first, last - first),
                    pa.array(np.arange(row, row + last - first)),
                    batch.column("doc_id").slice(first, last - first),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.view(np.int32))),
                ], names=["shard", "row", "doc_id", "ids"])
                row += last - first

    return docs.select(F.spark_partition_id().alias("shard"), F.col("doc_id").cast("long"), "text").mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``path`` in ascending doc_id order.

    One file per range of ids. Rows of one id are ordered by text; a null id comes first, a null
    text has no ids but the end id. Other columns are ignored.
    """
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        encode_documents(ranged, tokenizer, end_id).write.mode("errorifexists")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("orc.row.index.stride", str(ROWS_PER_INDEX)).option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.compress", "ZSTD").orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """(shard, row, doc_id, ids); given ids reach the scan, which skips files, stripes and row groups."""
    tokens = spark.read.schema(SCHEMA).orc(path)
    return tokens if doc_ids is None else tokens.where(F.col("doc_id").isin(*doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            values = np.ascontiguousarray(values, "<i4")
            yield pa.RecordBatch.from_arrays([
                batch.column("shard"), batch.column("row"), batch.column("doc_id"),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.array([zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.int64()),
            ], names=["shard", "row", "doc_id", "n_tokens", "ids_crc32"])

    rows = materialise(read_tokens(spark, path).mapInArrow(
        digest, "shard int, row long, doc_id long, n_tokens long, ids_crc32 long"))
    # One row per file meets in the unpartitioned window.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = W.partitionBy("shard").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(shards, "shard").select(
        "doc_id", (F.col("base") + F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op3_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_index(spark, path)
