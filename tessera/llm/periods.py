"""Periodic runs of words by seed-and-extend along diagonals.

A run of period q and length at least ``max(least, exponent * q)`` holds, on the diagonal of lag q,
at least ``max(least, exponent * q) - q`` places in a row where a word equals the one q words on.
So every run of a lag in ``[k / (exponent - 1), k]`` shows a pair of equal k-grams q words apart, for a
k no longer than that overlap: this is the seed. Lags are served by a ladder of such k.

A k-gram meets only its next occurrence in the same document, at most k words on. That loses
nothing: a nearer occurrence inside a run of period q <= k would, with q, give the run a smaller period
(Fine and Wilf). For the same reason a seed's lag is the smallest period of what grows
from it. Seeds of one lag are taken from the left; those that the furthest place covered on their lag
already includes are not extended again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, byte_buffer, mix, slices

#: Bytes of text looked at together; a word takes some 200 bytes of arrays.
PART_BYTES = 2 << 20


def ladder(least: int, exponent: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """``k, first, last``: seed lengths and the lags each serves, for texts of up to ``longest`` words.

    ``k`` is the least overlap of any lag from ``first`` on; lags beyond k need longer seeds.
    """
    def overlap(q: int) -> int:
        return max(least, exponent * q) - q

    first, turn = 1, -(-least // exponent)  # the overlap falls up to about the turn and grows from there
    while max(least, exponent * first) <= longest:
        k = min(overlap(q) for q in {first, max(first, turn - 1), max(first, turn)})
        yield k, first, k
        first = k + 1


def repeated(owner: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether another position of the same owner has the same name."""
    if len(name) == 0:
        return np.zeros(0, bool)
    order = np.lexsort((name, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (name[order][1:] == name[order][:-1])
    out = np.zeros(len(name), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def named(*columns: np.ndarray) -> np.ndarray:
    """Equal numbers for positions that agree in every column, and only for those."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Grams:
    """Names of the k-grams that occur more than once in their document; ``at`` are their positions, ascending."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray, last: np.ndarray):
        self.codes, self.owner, self.last = codes, owner, last  # last: end of the document, by position
        self.k, self.at = 0, np.arange(len(codes))
        self.name = np.zeros(len(codes), np.int64)

    def grow(self, k: int) -> None:
        """Go on to k-grams; a longer gram can only repeat where the shorter one does."""
        if self.k == 0:
            self._first(k)
        while self.k < k:
            step = min(self.k, k - self.k)
            slot = np.searchsorted(self.at, self.at + step)
            slot = np.minimum(slot, max(0, len(self.at) - 1))
            good = (self.at[slot] == self.at + step) & (self.at + self.k + step <= self.last[self.at]) if len(self.at) else np.zeros(0, bool)
            here, then = self.name[good], self.name[slot[good]]
            self.at, self.k = self.at[good], self.k + step
            self._keep(here, then)

    def _first(self, k: int) -> None:
        """Hashes leave out grams that cannot repeat; what stays is named exactly."""
        n = len(self.codes)
        hashed = self.codes[:max(0, n - k + 1)].astype(np.uint64)
        for i in range(1, k):
            hashed = mix(hashed, self.codes[i:n - k + 1 + i].astype(np.uint64))
        at = np.flatnonzero(np.arange(len(hashed)) + k <= self.last[:len(hashed)])
        key = mix(hashed[at], self.owner[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        many = np.zeros(len(at), bool)
        many[order[1:]] |= same
        many[order[:-1]] |= same
        self.at, self.k = at[many], k
        self._keep(*[self.codes[self.at + i] for i in range(k)])

    def _keep(self, *columns: np.ndarray) -> None:
        name = named(*columns)
        many = repeated(self.owner[self.at], name)
        self.at, self.name = self.at[many], name[many]

    def seeds(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and lags of the grams whose next occurrence in the document lies ``first`` to ``last`` words on."""
        if len(self.at) == 0:
            return self.at, self.at
        order = np.lexsort((self.at, self.name, self.owner[self.at]))
        at, name, owner = self.at[order], self.name[order], self.owner[self.at[order]]
        lag = at[1:] - at[:-1]
        good = (name[1:] == name[:-1]) & (owner[1:] == owner[:-1]) & (lag >= first) & (lag <= last)
        return at[:-1][good], lag[good]


def extended(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs ``start, length, lag`` that grow from the seeds.

    The furthest place covered on each (document, lag) suppresses seeds inside a stretch that is
    known already; the first seed of a stretch is extended to both sides word by word. ``begin`` and
    ``end`` are the bounds of each position's document.
    """
    if len(at) == 0:
        return at, at, at
    order = np.lexsort((at, lag, begin[at]))
    at, lag = at[order], lag[order]
    fresh = np.ones(len(at), bool)  # stretches of seeds one word apart cover each other
    fresh[1:] = (lag[1:] != lag[:-1]) | (begin[at[1:]] != begin[at[:-1]]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(fresh)
    left, q = at[heads].copy(), lag[heads]
    covered = at[np.append(heads[1:], len(at)) - 1] + k  # words left .. covered equal those q on
    low, high = begin[left], end[left]
    going = np.arange(len(left))
    while len(going):
        going = going[left[going] > low[going]]
        going = going[codes[left[going] - 1] == codes[left[going] - 1 + q[going]]]
        left[going] -= 1
    going = np.arange(len(left))
    while len(going):
        going = going[covered[going] + q[going] < high[going]]
        going = going[codes[covered[going]] == codes[covered[going] + q[going]]]
        covered[going] += 1
    found = np.unique(np.stack([left, covered + q - left, q]), axis=1)
    return found[0], found[1], found[2]


def runs_of(codes: np.ndarray, bounds: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs ``start, length, period`` of several documents; ``codes`` are their words end to end, ``bounds`` (rows + 1) theirs.

    Starts count from the beginning of ``codes``; rows are ordered by start, then period.
    """
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin, end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    grams = Grams(codes, owner, end)
    parts = [np.zeros((3, 0), np.int64)]
    for k, first, last in ladder(least, exponent, int(sizes.max()) if len(sizes) else 0):
        grams.grow(k)
        if len(grams.at) == 0:
            break
        at, lag = grams.seeds(first, last)
        start, length, period = extended(codes, begin, end, at, lag, k)
        good = length >= np.maximum(least, exponent * period)
        parts.append(np.stack([start, length, period])[:, good])
    found = np.concatenate(parts, axis=1)
    return tuple(found[:, np.lexsort((found[2], found[0]))])


def word_codes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the word at each position, bounds by text (rows + 1), and where each word begins and ends in the bytes."""
    data, offsets = byte_buffer(column)
    inside = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    heads = offsets[:-1][np.diff(offsets) > 0]
    edge = np.zeros(len(data) + 1, bool)
    edge[heads] = True
    edge[len(data)] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    final = inside.copy()
    final[:-1] &= ~inside[1:] | edge[1:-1]
    stops = np.flatnonzero(final) + 1
    cuts = np.unique(np.concatenate([starts, stops]))  # words and the white space between them by turns
    cuts = cuts[cuts < len(data)]
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    codes = pieces.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes[np.searchsorted(cuts, starts)], np.searchsorted(starts, offsets).astype(np.int64), starts, stops


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, text``: every periodic run of a text's words, and the text with each run cut to its first period.

    ``runs`` is an array of ``start, length, period`` (longs, words from 0) by start, then period: the maximal stretches whose
    smallest period q satisfies ``length >= max(least, exponent * q)``. Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by
    byte. ``text`` holds the words that no run contains after its first q words, joined by one space.

    A null text has no words and, like an empty one, no runs and an empty ``text``. Texts are never cut, however long; a long one
    takes memory in proportion to its words. Rows are taken one by one, repeated or not and with or without an id; an
    empty table gives no rows; other columns are not looked at. Nothing is shuffled.
    """
    if exponent < 3:
        raise ValueError("a run must hold its period at least three times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                codes, bounds, starts, stops = word_codes(part["text"])
                start, length, period = runs_of(codes, bounds, least, exponent)
                row = np.searchsorted(bounds, start, side="right") - 1
                by_row = np.searchsorted(row, np.arange(part.num_rows + 1))
                change = np.zeros(len(codes) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                kept = np.cumsum(change[:-1]) == 0
                items = pa.StructArray.from_arrays([pa.array(v) for v in (start - bounds[row], length, period)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(by_row, pa.int32()), items)
                yield from pa.table([part["doc_id"], pa.array(np.diff(bounds)), runs, joined(part["text"], kept, bounds, starts, stops)],
                                    names=["doc_id", "n_words", "runs", "text"]).to_batches()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, text string")


def joined(column: pa.ChunkedArray, kept: np.ndarray, bounds: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    data, _ = byte_buffer(column)
    held = np.flatnonzero(kept)
    sizes = stops[held] - starts[held]
    counts = np.diff(np.searchsorted(held, bounds))
    final = np.zeros(len(held), bool)
    final[np.cumsum(counts)[counts > 0] - 1] = True
    room = sizes + ~final
    ends = np.cumsum(room)
    source = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[held] - (ends - room), room)
    out = data[np.minimum(source, max(0, len(data) - 1))] if len(source) else data[:0]
    out[(ends - 1)[~final]] = 0x20
    offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out)))


def repeating(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text`` with every tenth document (by crc32 of its id) made periodic from some word on.

    With h the crc32 of the decimal id, g = h div 10 and n words: where h mod 10 is 0, word i >= a becomes word
    a + (i - a) mod p, for a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A document without an id or without words stays as it is.
    """
    due = F.coalesce(F.col("_h") % 10 == 0, F.lit(False))
    rows = (docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.crc32(F.col(id_column).cast("string")).alias("_h"))
            .withColumn("_words", F.when(due, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
            .withColumn("_n", F.size("_words").cast("long"))
            .withColumn("_a", F.when(F.col("_n") > 0, F.expr("(_h div 10) % _n")))
            .withColumn("_p", F.expr("1 + (_n - _a) div (3 + (_h div 10) % 8)")))
    place = lambda i: (F.col("_a") + (i - F.col("_a")) % F.col("_p") + 1).cast("int")
    turned = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.element_at("_words", place(i))))
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """One row per document of ``periodic_runs``: number of runs, the run of greatest exponent, and digests of runs and text.

    Exponents (length over period) are compared exactly; of equal ones the smallest start, then period, is taken. Without a run the four
    columns of that run are null.
    """
    higher = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    top = F.reduce("runs", F.element_at("runs", 1), lambda best, r: F.when(higher(r, best), r).otherwise(best))
    line = lambda r: F.concat(*[x for c in ("start", "length", "period") for x in (r[c].cast("string"), F.lit("\n" if c == "period" else ","))])
    return (found.withColumn("top", F.when(F.size("runs") > 0, top))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
                    F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
                    F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256")))
