"""Byte-level BPE by rank files: padded numpy matrices in length buckets, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from longitrack.llm.tokens import ChunkEncoder, cut_counts, gathered, process_wide, row_slices, text_bytes

MULTI_BPE = "byte_bpe_multi_50k.tiktoken"
NO_RANK = np.int64(1 << 40)
# Longer pieces would cost a round of the matrix per merge; they are merged through a heap instead.
LONGEST_ROW = 1024
# Rows decoded at a time.
DECODED_ROWS = 500
# Cells of one matrix.
CELLS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is also the id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Open-addressing hash table from (left id, right id) to the id of the joined token."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[token[:i]], ranks[token[i:]], rank) for token, rank in ranks.items()
                 for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        self.width = np.int64(max(ranks.values()) + 1)
        table = np.asarray(pairs, np.int64).reshape(-1, 3)
        keys, joined = table[:, 0] * self.width + table[:, 1], table[:, 2]
        self.bits = np.uint64(64 - max(4, int(len(keys) * 2).bit_length()))
        size = 1 << (64 - int(self.bits))
        self.mask = np.int64(size - 1)
        self.keys, self.joined = np.full(size, -1, np.int64), np.full(size, NO_RANK)
        slot = self._slot(keys)
        while len(keys):  # every round places one key per free slot, the others move on
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            placed = np.zeros(len(slot), bool)
            placed[first] = True
            placed &= free
            self.keys[slot[placed]], self.joined[slot[placed]] = keys[placed], joined[placed]
            keys, joined, slot = keys[~placed], joined[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Joined ids, ``NO_RANK`` where the pair is none or a side is padding (negative)."""
        shape = np.shape(left)
        left, right = np.ravel(left).astype(np.int64), np.ravel(right).astype(np.int64)
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left * self.width + right)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.joined[slot], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.joined[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out.reshape(shape)


class MatrixBPE:
    """Encoder of pieces: a piece is a row of byte ids, padded with -1 to its bucket's width."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.table = ranks, PairTable(ranks)
        self.bytes_to_id = np.asarray([ranks[bytes([b])] for b in range(256)], np.int64)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if piece in self.ranks:
                out[i] = np.asarray([self.ranks[piece]], "<u4")
            elif len(piece) > LONGEST_ROW:
                out[i] = self._merge_long(piece)
            elif piece:
                buckets.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
            else:
                out[i] = np.zeros(0, "<u4")
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(members), step):
                own = members[at:at + step]
                for i, ids in zip(own, self._merge_rows([pieces[i] for i in own], width)):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        lengths = np.asarray([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.bytes_to_id[raw], -1)
        rank = np.full(ids.shape, NO_RANK)
        rank[:, :-1] = self.table.lookup(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        columns = np.arange(width)
        while len(rows):
            at = rank.argmin(1)  # the leftmost of the least
            k = np.arange(len(rows))
            least = rank[k, at]
            done = least == NO_RANK
            if done.any():
                for j in np.flatnonzero(done):
                    out[rows[j]] = ids[j, :lengths[j]].astype("<u4")
                rows, ids, rank, lengths, at, least = (x[~done] for x in (rows, ids, rank, lengths, at, least))
                used = int(lengths.max(initial=1))  # compaction: finished rows and empty columns go
                ids, rank, columns, k = ids[:, :used], rank[:, :used], columns[:used], k[:len(rows)]
                if not len(rows):
                    break
            source = columns + (columns > at[:, None])
            source[:, -1] = np.minimum(source[:, -1], len(columns) - 1)
            ids[k, at] = least
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            lengths = lengths - 1
            pad = columns >= lengths[:, None]
            ids[pad] = -1
            rank[columns >= (lengths - 1)[:, None]] = NO_RANK
            after = np.minimum(at + 1, len(columns) - 1)
            right = np.where(at + 1 < lengths, ids[k, after], -1)
            rank[k, at] = self.table.lookup(least, right)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.table.lookup(ids[left, at[left] - 1], least[left])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, with a heap of (rank, place) and linked places."""
        ids = self.bytes_to_id[np.frombuffer(piece, np.uint8)]
        first = self.table.lookup(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        ids, n = ids.tolist(), len(ids)
        token = [piece[i:i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (r := self.ranks.get(token[i] + token[after[i]])) is not None:
                heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if token[i] is None or (j := after[i]) >= n or self.ranks.get(token[i] + token[j]) != r:
                continue  # one of the two has been merged meanwhile
            ids[i], token[i], token[j], after[i] = r, token[i] + token[j], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(before[i])
            push(i)
        return np.asarray([ids[i] for i in range(n) if token[i] is not None], "<u4")


def rank_encoder(path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> ChunkEncoder:
    """Each match of ``pattern`` is merged separately; no special tokens."""
    ranks = read_ranks(path or public_tokenizers.path(MULTI_BPE))
    bpe, split = MatrixBPE(ranks), regex.compile(pattern)
    token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        token_bytes[rank] = len(token)

    def encode_chunks(data: bytes, lengths: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        if spaced:  # no match reaches across the border of such chunks
            pieces = split.findall(data.decode())
        else:
            ends = np.cumsum(lengths)
            pieces = [p for a, b in zip((ends - lengths).tolist(), ends.tolist()) for p in split.findall(data[a:b].decode())]
        number: dict[str, int] = {}
        which = np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int64, len(pieces))
        found = bpe.encode([p.encode() for p in number])
        counts = np.asarray([len(f) for f in found], np.int64)
        ids = np.concatenate(found)[gathered((np.cumsum(counts) - counts)[which], counts[which])]
        return ids, cut_counts(token_bytes[ids], lengths)

    return ChunkEncoder(encode_chunks)


def encode_texts(texts: pa.Array, path: str | None = None) -> pa.Array:
    """Ids of every text as little-endian unsigned 32-bit binary; null and empty texts have none."""
    encoder = process_wide(f"ranks {path}", lambda: rank_encoder(path))
    data, offsets = text_bytes(texts)
    out = []
    for first, last in row_slices(offsets):
        own = offsets[first:last + 1]
        ids, counts = encoder.encode(data[own[0]:own[-1]], own - own[0])
        cuts = np.concatenate([[0], np.cumsum(counts)]) * 4
        out.append(pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(counts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]))
    return pa.concat_arrays(out).cast(pa.binary()) if out else pa.array([], pa.binary())


def decode_ids(ids: list[bytes | None], tokens: dict[int, bytes]) -> list[bytes | None]:
    """The bytes of ids in binary form; an unknown id is an error, null stays null."""
    get = tokens.__getitem__
    return [None if b is None else b"".join(map(get, np.frombuffer(b, "<u4").tolist())) for b in ids]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every text; other columns are ignored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), encode_texts(batch.column("text"), path)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``ids_text`` (decimal ids joined by commas) and ``decoded`` (binary) to (doc_id, ids)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = process_wide(f"tokens {path}", lambda: {
            rank: token for token, rank in read_ranks(path or public_tokenizers.path(MULTI_BPE)).items()})
        decimal = process_wide(f"decimals {path}", lambda: {i: str(i) for i in tokens}).__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                own = batch.slice(at, DECODED_ROWS)
                ids = own.column("ids").to_pylist()
                texts = [None if b is None else ",".join(map(decimal, np.frombuffer(b, "<u4").tolist())) for b in ids]
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("ids"), pa.array(texts, pa.string()), pa.array(decode_ids(ids, tokens), pa.binary())],
                    names=["doc_id", "ids", "ids_text", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids binary, ids_text string, decoded binary")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, its ids decoded again, and both hashed.

    One Python worker does all of it slice by slice, so that it never holds the ids of more than about
    ``SLICE_BYTES`` of text (a longer text is a slice of its own). A null text is empty; rows alike
    are treated each for itself, a null doc_id stays null, and other columns are ignored.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = process_wide(f"ranks {path}", lambda: rank_encoder(path))
        tokens = process_wide(f"tokens {path}", lambda: {
            rank: token for token, rank in read_ranks(path or public_tokenizers.path(MULTI_BPE)).items()})
        decimal = process_wide(f"decimals {path}", lambda: {i: str(i) for i in tokens}).__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                own_rows = batch.slice(at, DECODED_ROWS)
                data, offsets = text_bytes(own_rows.column("text"))
                n_tokens, ids_hash, decoded_hash = [], [], []
                for first, last in row_slices(offsets):
                    own = offsets[first:last + 1]
                    ids, counts = encoder.encode(data[own[0]:own[-1]], own - own[0])
                    cuts = np.concatenate([[0], np.cumsum(counts)])
                    for a, b in zip(cuts, cuts[1:]):
                        row = ids[a:b].tolist()
                        n_tokens.append(len(row))
                        ids_hash.append(hashlib.sha256(",".join(map(decimal, row)).encode()).hexdigest())
                        decoded_hash.append(hashlib.sha256(b"".join(map(tokens.__getitem__, row))).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [own_rows.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every whole text of ``documents``; an empty table gives no rows."""
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
