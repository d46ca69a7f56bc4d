"""Token ids of whole texts, by way of a bounded memo of text chunks.

A text is cut before every space that a non-space follows. Byte-level BPE with the usual splitting
pattern never merges across such a place, so the ids of a text are the ids of its chunks in order.
Chunks repeat far more often than texts, hence each one is encoded once and remembered. Finding,
hashing and looking up chunks are numpy operations over the UTF-8 bytes of many texts. Where the
tokenizer is known to split by that pattern, texts are also cut between words, digits, signs and line
breaks, so that a word is learnt once and not again with every sign that may follow it.
"""

from __future__ import annotations

import ctypes
import os
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

# Most chunks remembered by one Python worker; the memo then starts anew.
MEMO_LIMIT = 1_500_000
# The same where texts are also cut between words and signs: fewer chunks then hold as much text.
WORDS_LIMIT = 1_000_000
# Bytes of text per row slice, bytes looked up at a time, and bytes hashed at a time. A byte being hashed takes
# about 70 bytes of memory, powers included.
SLICE_BYTES = 2 << 20
LOOKUP_BYTES = (1 << 20) + (1 << 16)
HASH_BYTES = 1 << 17
# Chunks encoded in one string, and bytes of strings encoded in one call: the library's results take many times the text.
STRUNG = 1_000
CALL_BYTES = 1 << 16
BYTE_BPE = "byte_bpe_50k.json"

# Bytes that may follow a space at a cut: no ASCII control or white space, and no first byte of a
# wider white-space character. Not cutting is always safe.
_AFTER_CUT = np.ones(256, bool)
_AFTER_CUT[:33] = False
_AFTER_CUT[[0xC2, 0xE1, 0xE2, 0xE3]] = False
# Kinds of bytes. The pattern never puts a letter, digit or sign and what follows it into one match if
# that is of another of these kinds. Other bytes, the apostrophe of "'s" and the space have no kind.
_LETTER, _DIGIT, _SIGN, _BREAK = 1, 2, 3, 4
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127] = _SIGN
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[[9, 10, 13]] = _BREAK
_KINDS[39] = 0
# Two polynomial hashes modulo 2^64: odd bases and a random value for every byte.
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, (2, 256), np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def process_wide(name: str, make: Callable):
    """One object per Python worker, kept between the tasks which that worker runs."""
    holder = sys.modules.setdefault("_longitrack_worker", types.ModuleType("_longitrack_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def return_memory() -> None:
    """Give freed memory back to the system, where the C library can. The memo's arrays grow by copies, and Python workers
    go on from one stage to the next, so what is free between other blocks would otherwise stay theirs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the row offsets; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def row_slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``SLICE_BYTES``; a longer text is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes starts[0] .. starts[0] + counts[0] - 1, then those of the next range, and so on."""
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(counts) else starts
    return shift + np.arange(len(shift))


def kind_cuts(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether the usual splitting pattern begins a match at a byte, as far as the kinds of bytes tell."""
    own = kinds[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))  # Latin letters up to U+017F, but for two signs
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
    own[lead] = own[lead + 1] = _LETTER
    solid = (own > 0) & (own < _BREAK)
    cut = np.zeros(len(data), bool)
    cut[1:] = solid[:-1] & (own[1:] != own[:-1]) & (own[1:] > 0)
    # Behind one break; of several, the last is a match of its own only if more text follows.
    cut[2:] |= solid[:-2] & (own[1:-1] == _BREAK) & solid[2:]
    return cut


def distinct_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each and the number of every key among them: ``np.unique`` without its stable sort."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(first) - 1
    return ordered[first], order[first], which


class ChunkEncoder:
    """Ids of texts. ``encode_chunks(data, lengths, spaced)`` encodes chunks that lie end to end in
    ``data`` and returns their ids end to end and the number of ids of each; ``spaced`` tells that every
    chunk begins with a space. Given ``kinds`` of bytes, texts are cut between them too."""

    def __init__(self, encode_chunks: Callable, limit: int = MEMO_LIMIT, kinds: np.ndarray | None = None):
        self.encode_chunks, self.limit, self.kinds = encode_chunks, limit, kinds
        self._powers: list[tuple[np.ndarray, np.ndarray]] = []
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.n_ids = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each row."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cut = np.zeros(n, bool)
        cut[:-1] = (data[:-1] == 32) & _AFTER_CUT[data[1:]]
        if self.kinds is not None:
            cut |= kind_cuts(data, self.kinds)
        filled = np.diff(offsets) > 0
        cut[offsets[1:][filled] - 1] = False
        cut[offsets[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        ids, counts, first = [], [], 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + LOOKUP_BYTES, "right")))
            got = self._encode_some(data, starts[first:last], ends[first:last])
            ids.append(got[0])
            counts.append(got[1])
            first = last
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), np.diff(upto[np.searchsorted(starts, offsets)])

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Two hashes of every chunk; the bytes of some chunks at a time, which lie end to end."""
        out, first = [np.empty(len(starts), np.uint64) for _ in _BASES], 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + HASH_BYTES, "right")))
            base = starts[first]
            own = self._hash_some(data[base:ends[last - 1]], starts[first:last] - base, ends[first:last] - base)
            for whole, part in zip(out, own):
                whole[first:last] = part
            first = last
        return out

    def _hash_some(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        n = len(data)
        if not self._powers or len(self._powers[0][0]) < n:
            size = max(n, HASH_BYTES)
            self._powers = []
            for base in _BASES:
                both = []
                for b in (base, pow(base, -1, 1 << 64)):
                    power = np.full(size, b, np.uint64)
                    power[0] = 1
                    both.append(np.cumprod(power))
                self._powers.append(tuple(both))
        out = []
        for values, (power, inverse) in zip(_VALUES, self._powers):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(values[data] * power[:n], out=total[1:])
            out.append((total[ends] - total[starts]) * inverse[starts])
        if len(self._powers[0][0]) > HASH_BYTES:  # the tables of a giant chunk do not stay
            self._powers = []
        return out

    def _encode_some(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = starts[0]
        data, starts, ends = data[base:ends[-1]], starts - base, ends - base
        key, check = self._hashes(data, starts, ends)
        distinct, at, which = distinct_of(key)
        place = self._find(distinct, check[at])
        if len(missing := np.flatnonzero(place < 0)):
            if len(self.keys) and len(self.keys) + len(missing) > self.limit:
                self._forget()
                missing = np.arange(len(distinct))
            self._learn(data, distinct[missing], check[at[missing]], starts[at[missing]], ends[at[missing]])
            return_memory()
            place = self._find(distinct, check[at])
        place = place[which]
        counts = self.counts[place].astype(np.int64)
        return self.ids[gathered(self.starts[place], counts)], counts

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[place] == keys) & (self.checks[place] == checks), place, -1)

    def _learn(self, data: np.ndarray, keys: np.ndarray, checks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        spaced = data[starts] == 32
        for own, kind in ((spaced, True), (~spaced, False)):
            if not own.any():
                continue
            lengths = (ends - starts)[own]
            ids, counts = self.encode_chunks(data[gathered(starts[own], lengths)].tobytes(), lengths, kind)
            k, c = keys[own], checks[own]
            place = np.searchsorted(self.keys, k)
            if len(self.keys):  # a key whose check differs gives way to the newer chunk
                same = self.keys[np.minimum(place, len(self.keys) - 1)] == k
                if same.any():
                    keep = np.ones(len(self.keys), bool)
                    keep[place[same]] = False
                    self.keys, self.checks = self.keys[keep], self.checks[keep]
                    self.starts, self.counts = self.starts[keep], self.counts[keep]
                    place = np.searchsorted(self.keys, k)
            new = self.n_ids + np.cumsum(counts) - counts
            self.keys, self.checks = np.insert(self.keys, place, k), np.insert(self.checks, place, c)
            self.starts, self.counts = np.insert(self.starts, place, new), np.insert(self.counts, place, counts.astype(np.int32))
            room = self.ids
            if self.n_ids + len(ids) > len(room):  # grows by half, so that adding stays cheap
                room = np.zeros(max(self.n_ids + len(ids), len(room) * 3 // 2, 1 << 16), np.uint32)
                room[:self.n_ids] = self.ids[:self.n_ids]
                self.ids = room
            room[self.n_ids:self.n_ids + len(ids)] = ids
            self.n_ids += len(ids)


def cut_counts(ids_bytes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of ids of each chunk, from the byte lengths of all ids and of all chunks."""
    upto = np.searchsorted(np.cumsum(ids_bytes), np.cumsum(lengths)) + 1
    return np.diff(upto, prepend=0)


def library_encoder(path: str | None = None) -> ChunkEncoder:
    """Chunks go to the tokenizers library, as a plain call with ``add_special_tokens=False`` would: the string of an
    added token in a text is that token.

    A call for every chunk would cost more than its ids. Chunks that begin with a space are strung
    together, since nothing merges across their borders, and the ids are cut where the bytes of the
    tokens reach the end of a chunk. Others are strung together with line breaks between them, if the
    tokenizer is known to cut there.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path or public_tokenizers.path(BYTE_BPE))
    added = tokenizer.get_added_tokens_decoder()
    if any(" " in t.content or t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
        raise ValueError("texts are cut at spaces, which added tokens may not hold or look at")
    # The vocabulary writes every byte as one character, but for added tokens, which stand as they are.
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        token_bytes[i] = len(token.encode()) if i in added else len(token)

    split, kinds = tokenizer.pre_tokenizer, None
    usual = tokenizer.normalizer is None and isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space
    if usual and vocabulary.keys() >= set(ByteLevel.alphabet()):
        kinds = _KINDS.copy()  # no cut within an added token
        held = np.frombuffer("".join(t.content for t in added.values()).encode(), np.uint8)
        kinds[held[kinds[held] != _LETTER]] = 0

    def encode_chunks(data: bytes, lengths: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        if spaced or kinds is None or not kinds[10]:
            return encode_strings(data, lengths, spaced)
        of, ends = kinds[np.frombuffer(data, np.uint8)], np.cumsum(lengths)
        solid = (of > 0) & (of < _BREAK)
        between = solid[ends - lengths] & solid[ends - 1]
        joined, single = np.flatnonzero(between), np.flatnonzero(~between)

        def bytes_of(own):
            return np.frombuffer(data, np.uint8)[gathered((ends - lengths)[own], lengths[own])]

        parts = []
        if len(joined):  # a break behind every chunk, whose id goes again
            n = lengths[joined]
            ids, counts = encode_strings(
                np.insert(bytes_of(joined), np.cumsum(n), 10).tobytes(), np.stack([n, np.ones_like(n)], 1).ravel(), True)
            parts.append((np.delete(ids, np.cumsum(counts)[1::2] - 1), counts[::2]))
        if len(single):
            parts.append(encode_strings(bytes_of(single).tobytes(), lengths[single], False))
        ids, found = (np.concatenate(x) for x in zip(*parts))
        starts, counts = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        order = np.concatenate([joined, single])
        starts[order], counts[order] = np.cumsum(found) - found, found
        return ids[gathered(starts, counts)], counts

    def encode_strings(data: bytes, lengths: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(lengths)
        ends = ends[STRUNG - 1::STRUNG].tolist() if spaced else ends.tolist()
        cuts = [0, *ends, *([len(data)] if not ends or ends[-1] < len(data) else [])]
        strings = [data[a:b].decode() for a, b in zip(cuts, cuts[1:])]
        groups = np.asarray(cuts[:-1]) // CALL_BYTES
        calls = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(strings)]
        found = [
            np.asarray(e.ids, np.uint32) for a, b in zip(calls, calls[1:])
            for e in tokenizer.encode_batch_fast(strings[a:b], add_special_tokens=False)
        ]
        ids = np.concatenate(found)
        return ids, cut_counts(token_bytes[ids], lengths) if spaced else np.asarray([len(f) for f in found])

    return ChunkEncoder(encode_chunks, MEMO_LIMIT if kinds is None else WORDS_LIMIT, kinds)


def worker_encoder(path: str | None = None) -> ChunkEncoder:
    """The library encoder of this Python worker."""
    return process_wide(f"library {path}", lambda: library_encoder(path))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``end_id`` behind the ids of every row; also returns the row offsets."""
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(offsets[-1], end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = ids
    return out, offsets
