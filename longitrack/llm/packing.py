"""Best-fit packing of token pieces into sequences by bin completion.

Only lengths matter for a packing, and there are at most as many different lengths as a sequence has
tokens. The search therefore runs over the histogram of lengths, whose size does not depend on the
corpus: a filling (the lengths that share a sequence) is chosen once and used as often as the counts
allow. Every such step exhausts a length, so a packing has at most ``size`` different fillings. Spark
counts the lengths, ranks the pieces of each length and looks up their places.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from longitrack.llm.tokens import return_memory, row_slices, text_bytes, with_end, worker_encoder
from longitrack.operators.ordering import global_rank
from longitrack.session import materialise

SEQUENCE_TOKENS = 1024
END_ID = 2
# Branch-and-bound: fillings generated by the whole search, and steps between two tries of best-fit on the rest.
MAX_STEPS = 3_000
TAIL_STEPS = 16

Filling = tuple[int, ...]
Packing = list[tuple[Filling, int]]  # lengths in one sequence, largest first, and the number of sequences


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Least number of sequences: for every k, the lengths over size - k admit none of k or more."""
    lengths = np.arange(len(counts))
    half = size // 2
    best = -(-int((counts * lengths).sum()) // size)
    n_over, total = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * lengths)[::-1])[::-1]
    for k in range(half + 1):
        alone = int(n_over[size - k + 1]) if size - k + 1 < len(counts) else 0
        middle = int(n_over[half + 1]) - alone
        room = middle * size - (int(total[half + 1]) - (int(total[size - k + 1]) if size - k + 1 < len(counts) else 0))
        small = int(total[k] - total[half + 1])
        best = max(best, alone + middle + max(0, -(-(small - room) // size)))
    return best


def best_fit(counts: np.ndarray, size: int) -> Packing:
    """Best-fit decreasing over a histogram: sequences of one filling are handled together."""
    open_: dict[int, list[list]] = {}  # room left: [filling, number]
    rooms: list[int] = []

    def put(room: int, filling: Filling, number: int) -> None:
        if not number:
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([filling, number])

    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = size // length
                put(size - each * length, (length,) * each, left // each)
                put(size - left % each * length, (length,) * (left % each), 1 if left % each else 0)
                break
            room = rooms[at]
            filling, number = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // length
            full = min(number, left // each)
            put(room - each * length, filling + (length,) * each, full)
            left -= full * each
            number -= full
            if number and left:  # fewer than would fill one sequence
                put(room - left * length, filling + (length,) * left, 1)
                number, left = number - 1, 0
            put(room, filling, number)
    merged: dict[Filling, int] = {}
    for group in open_.values():
        for filling, number in group:
            merged[filling] = merged.get(filling, 0) + number
    return list(merged.items())


def dominated(a: Filling, b: Filling) -> bool:
    """Whether ``b`` is seen to fit into the places of ``a``, largest first (then ``a`` is at least as good)."""
    if sum(a) < sum(b):
        return False
    free = sorted(a, reverse=True)
    for length in b:
        for i, room in enumerate(free):
            if room >= length:
                free[i] -= length
                break
        else:
            return False
    return True


def reachable(lengths: list[int], counts: np.ndarray, room: int, used: Filling = ()) -> list[int]:
    """Entry i is the set of sums up to ``room`` that the first i ``lengths`` reach, as bits of one number.

    Every length may be taken as often as it occurs, less the times it is in ``used``.
    """
    mask, sums, out = (1 << room + 1) - 1, 1, [1]
    for length in lengths:
        left, block = min(int(counts[length]) - used.count(length), room // length), 1
        while left > 0:  # blocks of 1, 2, 4, ... of the same length
            block = min(block, left)
            sums |= sums << block * length & mask
            left, block = left - block, block * 2
        out.append(sums)
    return out


def completions(present: list[int], counts: np.ndarray, largest: int, size: int) -> Iterator[Filling | None]:
    """Fillings of a sequence that holds ``largest``, one at a time, the fullest first; None for one that an earlier
    filling dominates, so that the caller can count it.

    ``present`` are the lengths still to be packed, ascending. Only sums that can be reached are followed, so no
    time goes into dead ends and none of the fillings is left out. A single length that fills the rest
    exactly dominates all others.
    """
    room = size - largest
    spare = int(counts[room]) - (room == largest) if 0 < room < len(counts) else 0
    if spare > 0:
        yield (largest, room)
        return
    lengths = present[:bisect.bisect_right(present, min(room, largest))]
    sums = reachable(lengths, counts, room, (largest,))

    def parts(upto: int, target: int) -> Iterator[Filling]:
        """Choices among the first ``upto`` lengths with sum ``target``, larger lengths first."""
        if not target:
            yield ()
            return
        for i in range(upto - 1, -1, -1):
            if not sums[i + 1] >> target & 1:
                return
            length = lengths[i]
            for times in range(min(int(counts[length]) - (length == largest), target // length), 0, -1):
                if sums[i] >> target - times * length & 1:
                    for rest in parts(i, target - times * length):
                        yield (length,) * times + rest

    told: list[Filling] = []
    for target in range(room, -1, -1):
        if sums[-1] >> target & 1:
            for own in parts(len(lengths), target):
                if any(dominated(better, own) for better in told):
                    yield None
                else:
                    told.append(own)
                    yield (largest, *own)


def complete_bins(counts: np.ndarray, size: int, max_steps: int = MAX_STEPS) -> Packing:
    """A packing of ``counts[length]`` pieces of every length into few sequences of ``size`` tokens.

    Depth-first over the undominated fillings of the largest length left, each used as often as the counts
    allow. A branch ends when its waste exceeds what any better packing may waste. The incumbent starts as
    best-fit decreasing, and every ``TAIL_STEPS``-th step tries best-fit on what it leaves. The search stops at the
    lower bound, or after ``max_steps`` fillings, dominated ones included; nothing else cuts it. As a filling is
    never used fewer times than it could be, an exhausted search is no proof of the optimum.
    """
    counts = np.asarray(counts, np.int64)
    best = best_fit(counts, size)
    total, bound = int((counts * np.arange(len(counts))).sum()), lower_bound(counts, size)
    n_best = sum(n for _, n in best)
    steps = 0
    # Frames of an explicit stack: remaining fillings of the frame, counts before it, waste, sequences so far.
    packing: Packing = []

    def frame(own: np.ndarray, waste: int, used: int) -> tuple:
        present = np.flatnonzero(own).tolist()
        return completions(present, own, present[-1], size) if present else iter(()), own, waste, used

    stack = [frame(counts, 0, 0)]
    while stack and n_best > bound and steps < max_steps:
        options, own, waste, used = stack[-1]
        filling = next(options, False)
        if filling is False:
            stack.pop()
            if packing:
                packing.pop()
            continue
        steps += 1
        if filling is None:
            continue
        lengths, each = np.unique(filling, return_counts=True)
        number = int((own[lengths] // each).min())
        rest = own.copy()
        rest[lengths] -= number * each
        more = waste + number * (size - sum(filling))
        if more > (n_best - 1) * size - total or used + number + lower_bound_fast(rest, size) >= n_best:
            continue
        if not rest.any():
            n_best, best = used + number, [*packing, (filling, number)]
            continue
        if steps % TAIL_STEPS == 1:
            tail = best_fit(rest, size)
            n_tail = used + number + sum(n for _, n in tail)
            if n_tail < n_best:
                n_best, best = n_tail, [*packing, (filling, number), *tail]
        packing.append((filling, number))
        stack.append(frame(rest, more, used + number))
    return best


def lower_bound_fast(counts: np.ndarray, size: int) -> int:
    """The larger of the volume bound and the number of lengths over one half."""
    return max(-(-int(counts @ np.arange(len(counts))) // size), int(counts[size // 2 + 1:].sum()))


def token_pieces(docs: DataFrame, size: int = SEQUENCE_TOKENS, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids with the end id, as little-endian unsigned 32-bit binary.

    Documents longer than ``size`` are cut into pieces of ``size`` tokens, of which the first may be
    shorter. A null text is empty and still has its end id. Other columns are ignored.
    """

    def cut(batches):
        encoder = worker_encoder(tokenizer)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for first, last in row_slices(offsets):
                return_memory()
                own = offsets[first:last + 1]
                ids, cuts = with_end(*encoder.encode(data[own[0]:own[-1]], own - own[0]), end_id)
                n = np.diff(cuts)
                pieces = -(-n // size)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = np.where(n % size, n % size, size)[row]
                start = np.where(piece, head + (piece - 1) * size, 0)
                length = np.where(piece, size, head)
                bounds = np.concatenate([[0], np.cumsum(length)]) * 4
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, last - first).take(pa.array(row)),
                    pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [
                        None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary()),
                ], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids binary")


def placement(packing: Packing) -> dict[int, tuple[np.ndarray, ...]]:
    """For every length: first rank, first sequence, pieces per sequence and first offset, by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for filling, number in packing:
        offset = 0
        for length in sorted(set(filling), reverse=True):
            each = filling.count(length)
            rows.setdefault(length, []).append((ranks.get(length, 0), sequence, each, offset))
            ranks[length] = ranks.get(length, 0) + each * number
            offset += each * length
        sequence += number
    return {length: tuple(np.asarray(own, np.int64).T) for length, own in rows.items()}


def pack(pieces: DataFrame, size: int = SEQUENCE_TOKENS, max_steps: int = MAX_STEPS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (doc_id, piece, length, other columns).

    Rows alike in doc_id and piece are packed each for itself. An empty table gives an empty one. A
    length below 1 or over ``size`` is an error. ``pieces`` is read twice, so pass a written table.
    """
    if {"rank", "sequence_id", "offset"} & set(pieces.columns):
        raise ValueError("rank, sequence_id and offset must be free names")
    # At most one row for each length, and one for all lengths out of range.
    valid = F.when(F.col("length").between(1, size), F.col("length"))
    found = pieces.groupBy(valid.alias("length")).count().collect()
    if any(r["length"] is None for r in found):
        raise ValueError(f"lengths must lie in 1 .. {size}")
    counts = np.zeros(size + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["count"]
    places = placement(complete_bins(counts, size, max_steps))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() - 1
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for own in np.unique(length):
                at = length == own
                first, base, each, start = places[int(own)]
                k = np.searchsorted(first, rank[at], "right") - 1
                local = rank[at] - first[k]
                sequence[at], offset[at] = base[k] + local // each[k], start[k] + local % each[k] * own
            keep = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(sequence), pa.array(offset)],
                                             names=[*keep.schema.names, "sequence_id", "offset"])

    ranked = global_rank(pieces, [F.col("doc_id"), F.col("piece")], ["length"], out="rank")
    ranked = ranked.select(*pieces.columns, "rank")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, size: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Per piece of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, size, end_id)
    return pack(materialise(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))), size)


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
