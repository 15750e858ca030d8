"""Token ids of whole texts by a public tokenizer file, one library call per distinct chunk.

Texts are cut at places where no pre-token can cross, whatever surrounds them: before a
space that follows a visible ASCII character or a Latin-1 letter, and before ASCII punctuation that follows
such a letter. The library encodes each distinct chunk once; ids of a text are the ids of
its chunks end to end. Apostrophes (contractions) and the characters of special
strings are never cut at, so special strings act as in the whole text.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm.common import byte_buffer, cut, kept_by_worker, ranges

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[np.frombuffer(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~', np.uint8)] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = True
#: Distinct chunks a worker remembers; beyond, it starts anew.
CACHE_CHUNKS = 1_500_000
ENCODE_AT_ONCE = 10_000


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions in ``data`` where a text or a chunk of one begins."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    before = np.zeros_like(data)
    before[1:] = data[:-1]
    lead = np.zeros_like(data)
    lead[2:] = data[:-2]
    latin = (lead == 0xC3) & (before >= 0x80)  # U+00C0 to U+00FF
    letter = _ASCII_LETTER[before] | (latin & (before != 0x97) & (before != 0xB7))
    first = (data == 0x20) & (((before > 0x20) & (before < 0x7F)) | latin)
    first |= _PUNCTUATION[data] & letter
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


class Chunks:
    """Chunks of a slice: ``distinct`` byte strings, ``codes`` by position, ``bounds`` by text (rows + 1)."""

    def __init__(self, column: pa.ChunkedArray):
        data, offsets = byte_buffer(column)
        starts = chunk_starts(data, offsets)
        self.distinct, self.codes = cut(data, starts)
        self.bounds = np.searchsorted(starts, offsets).astype(np.int64)
        self.bytes = np.diff(offsets)

    def sums(self, by_chunk: np.ndarray) -> np.ndarray:
        """Sum of a value of the distinct chunks over each text."""
        total = np.zeros(len(self.codes) + 1, np.int64)
        np.cumsum(by_chunk[self.codes], out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


class Seen:
    """Rows of the chunks a worker has met, by a 128-bit hash; 24 bytes for each."""

    def __init__(self) -> None:
        self.high, self.low, self.row = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Row of each chunk, and the positions of those that are new (numbered on from the last)."""
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chunks)), ">u8").astype(np.uint64).reshape(-1, 2)
        return self._found(keys[:, 0], keys[:, 1])

    def places(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for 128-bit names that may repeat: row of each, and one position of each new name in the order of their rows."""
        order = np.lexsort((low, high))
        first = np.ones(len(order), bool)
        first[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        one = order[first]
        rows, new = self._found(high[one], low[one])
        out = np.empty(len(order), np.int64)
        out[order] = rows[np.cumsum(first) - 1]
        return out, one[new]

    def _found(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.high, high)
        near = np.minimum(at, max(0, len(self.high) - 1))
        rows = np.full(len(high), -1, np.int64)
        if len(self.high):
            found = (self.high[near] == high) & (self.low[near] == low)
            rows[found] = self.row[near[found]]
        new = np.flatnonzero(rows < 0)
        rows[new] = len(self.row) + np.arange(len(new))
        order = new[np.argsort(high[new], kind="stable")]
        self.high, self.low, self.row = (np.insert(old, at[order], values[order]) for old, values in ((self.high, high), (self.low, low), (self.row, rows)))
        return rows, new


class Encoder:
    """A tokenizer of this worker with the ids of chunks it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        return kept_by_worker(("encoder", path), lambda: cls(path))

    def _forget(self) -> None:
        self.seen = Seen()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.counts, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    @staticmethod
    def _room(array: np.ndarray, need: int) -> np.ndarray:
        return array if need <= len(array) else np.concatenate([array, np.zeros(max(need - len(array), len(array) // 2), array.dtype)])

    def rows(self, chunks: list[bytes]) -> np.ndarray:
        """Row of each chunk in ``starts`` and ``counts``; chunks not met before are encoded."""
        if self.known > CACHE_CHUNKS:
            self._forget()
        rows, new = self.seen.rows(chunks)
        for begin in range(0, len(new), ENCODE_AT_ONCE):
            texts = [chunks[i].decode("utf-8", "replace") for i in new[begin:begin + ENCODE_AT_ONCE]]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            total, known = int(counts.sum()), self.known + len(ids)
            self.pool = self._room(self.pool, self.used + total)
            self.pool[self.used:self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
            self.starts, self.counts = self._room(self.starts, known), self._room(self.counts, known)
            self.starts[self.known:known] = self.used + np.cumsum(counts) - counts
            self.counts[self.known:known] = counts
            self.used, self.known = self.used + total, known
        return rows

    def encode(self, column: pa.ChunkedArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with ``end_id`` after it, and their offsets (rows + 1)."""
        chunks = Chunks(column)
        rows = self.rows(chunks.distinct)
        starts, counts = self.starts[rows][chunks.codes], self.counts[rows][chunks.codes]
        flat = self.pool[ranges(starts, counts)]
        offsets = np.zeros(len(chunks.bounds), np.int64)
        np.cumsum(chunks.sums(self.counts[rows]), out=offsets[1:])
        ids = np.insert(flat, offsets[1:], np.uint32(end_id)).astype("<u4")
        return ids, offsets + np.arange(len(offsets))


def binary(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary values of ``ids`` (little-endian unsigned 32 bits) between ``offsets``."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
