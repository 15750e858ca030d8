"""Cross-tokenizer alignment by anchors at white space.

Every text is tokenised in full by two tokenizers, A (byte-level BPE) and B (sentence pieces), over the same bytes: a space and the
text. Where a token of A and one of B end together, and both next tokens begin with a space, lies an
anchor. Anchors cut a document into windows, each known by its two tuples of token ids. What a window
holds follows from its ids alone: byte ends common to A and B cut it into groups, and every A token of a group is
linked with every B token of it. So each distinct window is aligned once and remembered.

A pair's count is the number of documents that hold it linked. Slices of documents keep their
distinct pairs in tables: slices send each pair once, counts come back to the slices that hold the pair, and a document's sums are made
there.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_buffer, cut, kept_by_worker, mix, ranges, slices, stored
from tessera.llm.linking import join_unique
from tessera.llm.tokencount import _byte_symbols
from tessera.llm.tokens import Seen

#: Bytes of text aligned together; documents of such a slice share one table of pairs.
PART_BYTES = 2 << 20
#: What a worker remembers: distinct chunks and windows, ids of chunks, bytes of aligned windows. Beyond, it starts anew.
CACHE_ITEMS, CACHE_IDS, CACHE_BYTES = 1_000_000, 8_000_000, 64 << 20
ENCODE_AT_ONCE, JOINED = 20_000, 500
SPACE = 0x20


def spaced(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a space and each text, end to end, and offsets (rows + 1); a null or empty text has none."""
    data, offsets = byte_buffer(column)
    heads = offsets[:-1][np.diff(offsets) > 0]
    more = np.zeros(len(offsets), np.int64)
    more[1:] = np.cumsum(np.diff(offsets) > 0)
    return np.insert(data, heads, np.uint8(SPACE)), offsets + more


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where no token of either tokenizer can cross: text starts, and spaces after a visible ASCII character or a Latin-1 letter."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    before, lead = np.zeros_like(data), np.zeros_like(data)
    before[1:], lead[2:] = data[:-1], data[:-2]
    first = (data == SPACE) & (((before > 0x20) & (before < 0x7F)) | ((lead == 0xC3) & (before >= 0x80)))
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


class ByteLevel:
    """A byte-level BPE file: ids of chunks, and the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        byte_of = {s: b for b, s in _byte_symbols().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

    def encode(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each text; a text may be several chunks end to end."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)]


class Pieces:
    """A sentence-piece file: ids of chunks that begin with the space the model itself would add, and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.whole = any("▁" in n.lstrip("▁") for n in names)  # then a piece may cross the start of a chunk
        self.space = self.model.piece_to_id("▁")

    def encode(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each text; a text may be several chunks end to end."""
        found = self.model.encode([c[1:].decode("utf-8", "replace") for c in chunks], num_threads=1)
        return [ids if ids else [self.space] for ids in found]


class Remembered:
    """Rows of variable length, found again by a 128-bit hash of a byte key."""

    def __init__(self, columns: dict[str, type]):
        self.seen, self.size = Seen(), 0
        self.flat = {c: [np.zeros(0, t)] for c, t in columns.items()}
        self.counts = {c: [np.zeros(0, np.int64)] for c in columns}

    def rows(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.seen.rows(keys)

    def add(self, column: str, flat: np.ndarray, counts: np.ndarray) -> None:
        self.flat[column].append(flat)
        self.counts[column].append(counts)
        self.size += flat.nbytes

    def column(self, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values end to end, start and count of each row."""
        if len(self.flat[column]) > 1:
            self.flat[column], self.counts[column] = [np.concatenate(self.flat[column])], [np.concatenate(self.counts[column])]
        counts = self.counts[column][0]
        return self.flat[column][0], np.cumsum(counts) - counts, counts


def gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return flat[ranges(starts[rows], counts[rows])]


class Side:
    """One tokenizer of a worker, with the ids of the chunks it has met."""

    def __init__(self, tokenizer: ByteLevel | Pieces):
        self.tokenizer = tokenizer
        self.sizes = np.array([len(p) for p in tokenizer.pieces], np.int64)
        self.spelling = np.frombuffer(b"".join(tokenizer.pieces), np.uint8)
        self.spelling_at = np.cumsum(self.sizes) - self.sizes
        self.spaced = np.array([p[:1] == b" " for p in tokenizer.pieces])
        digits = [str(i).encode() for i in range(len(self.sizes))]
        self.digits, self.digit_counts = np.frombuffer(b"".join(digits), np.uint8), np.array(list(map(len, digits)), np.int64)
        self.digits_at = np.cumsum(self.digit_counts) - self.digit_counts
        self._forget()

    def _forget(self) -> None:
        self.held = Remembered({"ids": np.int32, "same": np.bool_})

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids, end to end."""
        return self.spelling[ranges(self.spelling_at[ids], self.sizes[ids])]

    def tokens(self, chunks: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks end to end, their number by chunk, and whether the ids spell the chunk."""
        if len(self.held.seen.row) > CACHE_ITEMS or self.held.size > 4 * CACHE_IDS:
            self._forget()
        rows, new = self.held.rows(chunks)
        for at in range(0, len(new), ENCODE_AT_ONCE):
            ids, counts, same = self._encode([chunks[i] for i in new[at:at + ENCODE_AT_ONCE]])
            self.held.add("ids", ids, counts)
            self.held.add("same", same, np.ones(len(counts), np.int64))
        flat, starts, counts = self.held.column("ids")
        at = rows[codes]
        return gathered(flat, starts, counts, at), counts[at], self.held.column("same")[0][at]

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids end to end, number and whether they spell it, of each chunk.

        Chunks go to the library many at a time, as one text, since no token crosses the start of one that follows a visible
        character; the ids are cut where chunks end. Where the library spells a joined text otherwise, its chunks go one by one.
        """
        safe = [0x20 < c[-1] < 0x7F for c in chunks]
        texts, members, open_ = [], [], False
        for i, chunk in enumerate(chunks):
            if open_ and len(members[-1]) < JOINED:
                members[-1].append(i)
            else:
                members.append([i])
            open_ = safe[i]
        texts = [b"".join([chunks[i] for i in m]) for m in members]
        found = self.tokenizer.encode(texts)
        again = [len(m) > 1 and b"".join(map(self.tokenizer.pieces.__getitem__, ids)) != t for m, ids, t in zip(members, found, texts)]
        if any(again):
            single = [i for m, bad in zip(members, again) if bad for i in m]
            by_one = iter(self.tokenizer.encode([chunks[i] for i in single]))
            found = [ids for m, old, bad in zip(members, found, again) for ids in ([next(by_one) for _ in m] if bad else [old])]
            members = [part for m, bad in zip(members, again) for part in ([[i] for i in m] if bad else [m])]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(counts.sum()))
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        alone = np.fromiter((len(m) == 1 for m in members), bool, len(members))
        first = np.fromiter((m[0] for m in members), np.int64, len(members))
        # by joined text: tokens up to the end of each chunk
        ends = np.cumsum(self.sizes[ids])
        start = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
        owner = np.repeat(np.arange(len(members)), np.fromiter(map(len, members), np.int64, len(members)))
        chunk_ends = np.cumsum(sizes) - (np.cumsum(sizes) - sizes)[first][owner] + start[owner]
        upto = np.searchsorted(ends, chunk_ends, side="right")
        upto[first[alone]] = np.cumsum(counts)[alone]  # a text of its own has all its ids, whatever they spell
        held = np.diff(upto, prepend=0)
        spelt = np.add.reduceat(self.sizes[ids], np.minimum(upto - held, max(0, len(ids) - 1))) if len(ids) else np.zeros(len(chunks), np.int64)
        same = (spelt == sizes) & (held > 0)
        stay = np.repeat(same, held)
        equal = np.frombuffer(b"".join([c for c, s in zip(chunks, same.tolist()) if s]), np.uint8) == self.spell(ids[stay])
        if len(equal):
            at = np.flatnonzero(same)
            same[at] = np.logical_and.reduceat(equal, np.cumsum(sizes[at]) - sizes[at])
        return ids, held, same


class Aligner:
    """Both tokenizers and the alignments of windows that this worker has met."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Side(ByteLevel(a_path)), Side(Pieces(b_path))
        self.width = len(self.b.sizes)
        self._forget()

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        return kept_by_worker(("aligner", a_path, b_path), lambda: cls(a_path, b_path))

    def _forget(self) -> None:
        self.windows = Remembered({"pairs": np.int64, "times": np.int64, "groups": np.int64, "links": np.int64, "text": np.uint8})

    def align(self, column: pa.ChunkedArray) -> Aligned:
        """Alignments of all texts of a slice."""
        data, offsets = spaced(column)
        starts = offsets[:-1][np.diff(offsets) > 0] if self.b.tokenizer.whole else chunk_starts(data, offsets)
        chunks, codes = cut(data, starts)
        (a_ids, a_counts, a_same), (b_ids, b_counts, b_same) = self.a.tokens(chunks, codes), self.b.tokens(chunks, codes)
        # documents that either tokenizer does not spell byte by byte have no tokens
        bounds = np.searchsorted(starts, offsets)
        wrong = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(~(a_same & b_same), out=wrong[1:])
        good = (wrong[bounds[1:]] == wrong[bounds[:-1]]) & (np.diff(offsets) > 0)
        stay = np.repeat(good, np.diff(bounds))
        a_ids, b_ids = a_ids[np.repeat(stay, a_counts)], b_ids[np.repeat(stay, b_counts)]
        sizes = np.where(good, np.diff(offsets), 0)
        heads = np.cumsum(sizes) - sizes
        a_ends, b_ends = np.cumsum(self.a.sizes[a_ids]), np.cumsum(self.b.sizes[b_ids])
        anchors = self._anchors(a_ids, a_ends, b_ids, b_ends, heads[good])
        a_first = np.searchsorted(a_ends, anchors, side="right")
        b_first = np.searchsorted(b_ends, anchors, side="right")
        rows = self._windows(a_ids, np.append(a_first, len(a_ids)), b_ids, np.append(b_first, len(b_ids)))
        by_doc = np.searchsorted(anchors, np.append(heads, int(sizes.sum())))
        n_a, n_b = (np.diff(np.searchsorted(ends, np.append(heads, int(sizes.sum())), side="right")) for ends in (a_ends, b_ends))
        return Aligned(self.windows, rows, by_doc, n_a, n_b)

    def _anchors(self, a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Byte places where documents begin, or tokens of both end and both next tokens begin with a space."""
        a_starts, b_starts = a_ends - self.a.sizes[a_ids], b_ends - self.b.sizes[b_ids]
        shared = np.intersect1d(a_starts[self.a.spaced[a_ids]], b_starts[self.b.spaced[b_ids]], assume_unique=True)
        return np.union1d(shared, heads)

    def _windows(self, a_ids: np.ndarray, a_bounds: np.ndarray, b_ids: np.ndarray, b_bounds: np.ndarray) -> np.ndarray:
        """Row of each window among those remembered; new ones, by their id tuples, are aligned."""
        if len(self.windows.seen.row) > CACHE_ITEMS or self.windows.size > CACHE_BYTES:
            self._forget()
        n_a, n_b = np.diff(a_bounds), np.diff(b_bounds)
        if len(n_a) == 0:
            return n_a
        names = [tuple_hash(a_ids, n_a, 2 * seed) + tuple_hash(b_ids, n_b, 2 * seed + 1) for seed in range(2)]
        rows, new = self.windows.seen.places(*names)
        if len(new):
            self._align(a_ids[ranges(a_bounds[new], n_a[new])], n_a[new], b_ids[ranges(b_bounds[new], n_b[new])], n_b[new])
        return rows

    def _align(self, a_ids: np.ndarray, n_a: np.ndarray, b_ids: np.ndarray, n_b: np.ndarray) -> None:
        """Groups and links of windows."""
        count = len(n_a)
        a_ends, b_ends = np.cumsum(self.a.sizes[a_ids]), np.cumsum(self.b.sizes[b_ids])
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)  # ends of groups; windows end together
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        window = np.repeat(np.arange(count), n_a)
        of_group = np.zeros(len(shared), np.int64)
        of_group[a_group] = window
        groups = np.bincount(of_group, minlength=count)
        links = np.bincount(a_group, minlength=len(shared)) * np.bincount(b_group, minlength=len(shared))
        per_window = np.zeros(count, np.int64)
        np.add.at(per_window, of_group, links)
        # distinct ids of each group and side with their numbers; links of a group are the products
        (ga, ida, ta), (gb, idb, tb) = counted(a_group, a_ids, len(self.a.sizes)), counted(b_group, b_ids, self.width)
        first = np.searchsorted(gb, np.arange(len(shared) + 1))
        partners = np.diff(first)[ga]
        other = ranges(first[ga], partners)
        pair = np.repeat(ida, partners) * self.width + idb[other]
        times = np.repeat(ta, partners) * tb[other]
        owner = np.repeat(of_group[ga], partners)
        order = np.lexsort((pair, owner))
        pair, times, owner = pair[order], times[order], owner[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(new)
        held = np.bincount(owner[heads], minlength=count)
        text, text_counts = self._texts(a_ids, a_group, b_ids, b_group, of_group, count)
        ones = np.ones(count, np.int64)
        for column, flat, counts in (("pairs", pair[heads], held), ("times", np.add.reduceat(times, heads), held), ("groups", groups, ones),
                                     ("links", per_window, ones), ("text", text, text_counts)):
            self.windows.add(column, flat, counts)

    def _texts(self, a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray, of_group: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` of the windows end to end, and the bytes of each.

        Every id is written with the sign that follows it: a comma within its side of the group, else a bar after A's side and a semicolon after B's.
        """
        group = np.concatenate([a_group, b_group])
        order = np.argsort(group, kind="stable")  # within a group A's ids come first
        sizes = np.concatenate([self.a.digit_counts[a_ids], self.b.digit_counts[b_ids]])[order] + 1
        starts = np.concatenate([self.a.digits_at[a_ids], self.b.digits_at[b_ids] + len(self.a.digits)])[order]
        sign = np.full(len(group), ord(","), np.uint8)
        sign[np.searchsorted(a_group, np.arange(len(of_group)), side="right") - 1] = ord("|")
        sign[len(a_group) + np.searchsorted(b_group, np.arange(len(of_group)), side="right") - 1] = ord(";")
        digits = np.concatenate([self.a.digits, self.b.digits, [0]])
        out = digits[ranges(starts, sizes)].astype(np.uint8)  # one byte too many for each id, where its sign goes
        out[np.cumsum(sizes) - 1] = sign[order]
        return out, np.bincount(of_group[group[order]], weights=sizes, minlength=count).astype(np.int64)


def tuple_hash(ids: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each run of ids and their places."""
    if len(ids) == 0:
        return np.zeros(len(counts), np.uint64)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    mixed = mix(mix(ids.astype(np.uint64) + np.uint64(1), place.astype(np.uint64)), np.full(len(ids), seed + 1, np.uint64))
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mixed, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def counted(group: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and number of the distinct ids of each group, by group."""
    keys, times = np.unique(group * width + ids, return_counts=True)
    return keys // width, keys % width, times


class Aligned:
    """Windows of a slice's documents, by their rows in what the worker remembers."""

    def __init__(self, windows: Remembered, rows: np.ndarray, bounds: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.windows, self.rows, self.bounds, self.n_a, self.n_b = windows, rows, bounds, n_a, n_b

    def sums(self, column: str) -> np.ndarray:
        """Sum of a window's value over each document."""
        total = np.zeros(len(self.rows) + 1, np.int64)
        np.cumsum(self.windows.column(column)[0][self.rows], out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def texts(self) -> Iterator[bytes]:
        """Groups of each document as text; empty without tokens."""
        flat, starts, counts = self.windows.column("text")
        data = gathered(flat, starts, counts, self.rows).tobytes()
        ends = np.zeros(len(self.rows) + 1, np.int64)
        np.cumsum(counts[self.rows], out=ends[1:])
        places = ends[self.bounds].tolist()
        for i, j in zip(places, places[1:]):
            yield data[i:max(i, j - 1)]  # without the last semicolon

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair and number of links, distinct, by document."""
        flat, starts, counts = self.windows.column("pairs")
        pair = gathered(flat, starts, counts, self.rows)
        times = gathered(self.windows.column("times")[0], starts, counts, self.rows)
        doc = np.repeat(np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds)), counts[self.rows])
        # pairs by number in the slice, so that document and pair fit one sorted key
        distinct, number = np.unique(pair, return_inverse=True)
        order = np.argsort(doc * max(1, len(distinct)) + number, kind="stable")
        doc, pair, times = doc[order], pair[order], times[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        return doc[heads], pair[heads], np.add.reduceat(times, heads) if len(heads) else times


def _longs(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<i8").tobytes()


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, groups``: the groups of every text as ``a1,a2|b1;a3|b2,b3``, ids of A and B in order.

    Texts that are null, empty or not spelt byte by byte by both tokenizers have no tokens and an empty string. Nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(a_path, b_path)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                found = aligner.align(part["text"])
                texts = pa.array([t.decode() for t in found.texts()], pa.string())
                yield from pa.table([part["doc_id"], pa.array(found.n_a), pa.array(found.n_b), texts], names=["doc_id", "n_a", "n_b", "groups"]).to_batches()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, groups string")


def aligned_slices(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per slice of documents: its rows, its distinct pairs with the number of documents that link them, and who holds which.

    ``rows`` are the documents' own results; ``pairs`` and ``docs`` list the slice's pairs; ``ends``, ``held`` and ``times`` (binary)
    give, document by document, the places in ``pairs`` and the numbers of links.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = "n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner.of(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                found = aligner.align(part["text"])
                doc, pair, times = found.pairs()
                distinct, place, docs_of = np.unique(pair, return_inverse=True, return_counts=True)
                ends = np.searchsorted(doc, np.arange(1, part.num_rows + 1))
                digests = [hashlib.sha256(t).hexdigest() if t else "" for t in found.texts()]
                values = [part["doc_id"].combine_chunks(), pa.array(found.n_a), pa.array(found.n_b), pa.array(found.sums("groups")), pa.array(found.sums("links")), pa.array(digests, pa.string())]
                values[0] = pa.concat_arrays(values[0].chunks) if isinstance(values[0], pa.ChunkedArray) else values[0]
                items = pa.StructArray.from_arrays(values, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])

                def one(array: pa.Array) -> pa.ListArray:
                    return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)

                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), one(items), one(pa.array(distinct)), one(pa.array(docs_of.astype(np.int64))),
                     pa.array([_longs(ends)]), pa.array([place.astype("<i4").tobytes()]), pa.array([_longs(times)])],
                    names=["slice", "rows", "pairs", "docs", "ends", "held", "times"])
                number += 1

    schema = f"slice long, rows array<struct<doc_id: {kind}, {fields}>>, pairs array<long>, docs array<long>, ends binary, held binary, times binary"
    return stored(rows.mapInArrow(run, schema), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, a_id, count``: documents that hold each pair linked, over all slices (``pair`` is A's id times B's vocabulary plus B's id)."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select(F.col("p.pairs").alias("pair"), "p.docs")
    return each.groupBy("pair").agg(F.sum("docs").alias("count"))


def vocabulary_size(path: str) -> int:
    """Number of ids of a tokenizer file."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            return max(json.load(file)["model"]["vocab"].values()) + 1
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()


def linked_pairs(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``a_id, b_id, count``: every linked pair of ids and the number of documents that hold it; a table from one vocabulary to the other."""
    width = vocabulary_size(b_path)
    counts = pair_counts(aligned_slices(docs, a_path, b_path, id_column, text_column))
    return counts.select(F.expr(f"cast(pair div {width} as int)").alias("a_id"), (F.col("pair") % width).cast("int").alias("b_id"), "count")


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every whole text.

    A is a byte-level BPE file, given a space and the text; B a sentence-piece file, given the text. Strings of special tokens are ordinary
    text. ``n_links`` are the pairs of an A and a B token of one group, ``count_sum`` adds up over them the number of documents that
    hold the pair linked, ``n_best`` are those whose count is the highest of their A id. ``groups_sha256`` is the digest of ``token_groups``.

    Texts that are null, empty or whose tokens do not spell a space and the text byte by byte (for one, texts with U+2581) have no tokens: zeros
    and an empty digest. Texts are never cut, however long. Rows are documents, repeated or not, with or without an id; an empty table
    gives no rows; other columns are not looked at.
    """
    width = vocabulary_size(b_path)
    aligned = aligned_slices(docs, a_path, b_path, id_column, text_column)
    counts = stored(pair_counts(aligned).withColumn("a_id", F.expr(f"pair div {width}")), "pair-counts")
    best = F.broadcast(counts.groupBy("a_id").agg(F.max("count").alias("best")))  # one row for each id of a vocabulary at most
    known = counts.join(best, "a_id").select("pair", "count", (F.col("count") == F.col("best")).alias("top"))
    asked = stored(aligned.select("slice", F.posexplode("pairs").alias("place", "pair")), "slice-pairs")
    answers = join_unique(asked, known, ["pair"], "inner").select("slice", "place", "count", "top")
    kind = aligned.schema["rows"].dataType.elementType["doc_id"].dataType.simpleString()
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def answer(blocks: pa.Table, pairs: pa.Table) -> pa.Table:
        count, top = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        place = pairs["place"].to_numpy()
        count[place], top[place] = pairs["count"].to_numpy(), pairs["top"].to_numpy()
        rows = blocks["rows"].combine_chunks()
        rows = (pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) else rows).flatten()
        found = dict(zip([f.name for f in rows.type], rows.flatten()))
        held, times, ends = (np.frombuffer(blocks[c][0].as_py(), t) for c, t in (("held", "<i4"), ("times", "<i8"), ("ends", "<i8")))
        for name, value in (("n_best", top), ("count_sum", count)):
            total = np.zeros(len(held) + 1, np.int64)
            np.cumsum(value[held] * times, out=total[1:])
            found[name] = pa.array(np.diff(total[np.append(0, ends)]))
        return pa.table([found[c] for c in columns], names=columns)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return aligned.select("slice", "rows", "ends", "held", "times").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(answer, schema)
