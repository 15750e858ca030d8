"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one ragged array of symbols. In every round each pre-token applies
its lowest-ranked pair, at all its places at once; the symbols that survive are
the tokens. A merge creates symbols whose own merges rank later, so the simultaneous
merge equals the one-by-one order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import kept_by_worker, slices
from tessera.llm.tokens import CACHE_CHUNKS, Chunks, Seen

_NONE = np.int64(1) << 40
#: Distinct chunks whose pre-tokens are merged in one array.
COUNT_AT_ONCE = 100_000


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merger:
    """Merge table of a byte-level BPE file, for counting."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, merges = content["model"]["vocab"], content["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.width = np.int64(max(vocabulary.values()) + 1)
        keys = np.fromiter((vocabulary[a] * int(self.width) + vocabulary[b] for a, b in pairs), np.int64, len(pairs))
        self.merged = np.fromiter((vocabulary[a + b] for a, b in pairs), np.int64, len(pairs))
        symbols = _byte_symbols()
        self.byte_ids = np.array([vocabulary[symbols[b]] for b in range(256)], np.int64)
        self.table_bits = np.uint64(64 - 18)
        self._build(keys)
        self.pattern = regex.compile(pattern)
        special = sorted((t["content"] for t in content["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.seen, self.totals = Seen(), np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str, pattern: str) -> Merger:
        return kept_by_worker(("merger", path, pattern), lambda: cls(path, pattern))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.table_bits).astype(np.int64)

    def _build(self, keys: np.ndarray) -> None:
        """Open-addressing table from pair key to rank."""
        size = 1 << 18
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, size + np.arange(len(slot))), return_index=True)
            take = first[free[first]]
            self.keys[slot[take]], self.ranks[slot[take]] = keys[left[take]], left[take]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, slot = left[rest], (slot[rest] + 1) % size

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; a large number where the pair never merges."""
        keys = left * self.width + right
        slot = self._slot(keys)
        found = self.ranks[slot]
        held = self.keys[slot]
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            held = self.keys[slot[open_]]
            found[open_] = self.ranks[slot[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
        return found

    def count(self, pretokens: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        counts = sizes.copy()
        ids = self.byte_ids[np.frombuffer(b"".join(pretokens), np.uint8)]
        owner = np.repeat(np.arange(len(pretokens)), sizes)
        ranks = np.full(len(ids), _NONE, np.int64)
        if len(ids) > 1:
            same = np.flatnonzero(owner[:-1] == owner[1:])
            ranks[same] = self.rank(ids[same], ids[same + 1])
        while len(ids):
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(ranks, heads)
            going = low < _NONE
            spans = np.diff(np.append(heads, len(ids)))
            if not going.all():  # these pre-tokens are done
                done = owner[heads[~going]]
                counts[done] = spans[~going]
                stay = np.repeat(going, spans)
                ids, owner, ranks = ids[stay], owner[stay], ranks[stay]
                low, spans = low[going], spans[going]
                if not len(ids):
                    break
            at = np.flatnonzero(ranks == np.repeat(low, spans))
            # overlapping places (a run of one symbol): every other one, from the left
            run = np.cumsum(np.r_[True, np.diff(at) != 1])
            begin = at[np.searchsorted(run, run)]
            at = at[(at - begin) % 2 == 0]
            ids[at] = self.merged[ranks[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))
            ids, owner = ids[stay], owner[stay]
            ranks = ranks[stay]
            touched = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            ranks[touched] = _NONE
            touched = touched[touched + 1 < len(ids)]
            touched = touched[owner[touched] == owner[touched + 1]]
            ranks[touched] = self.rank(ids[touched], ids[touched + 1])
        return counts

    def _count_new(self, chunks: list[bytes]) -> np.ndarray:
        totals = np.zeros(len(chunks), np.int64)
        pretokens: dict[str, int] = {}
        owners: list[int] = []
        codes: list[int] = []
        for i, chunk in enumerate(chunks):
            text = chunk.decode("utf-8", "replace")
            parts = [text]
            if self.special is not None and "<" in text:
                totals[i] += len(self.special.findall(text))
                parts = self.special.split(text)
            for part in parts:
                for token in self.pattern.findall(part):
                    owners.append(i)
                    codes.append(pretokens.setdefault(token, len(pretokens)))
        by_token = self.count([t.encode() for t in pretokens])
        np.add.at(totals, np.array(owners, np.int64), by_token[np.array(codes, np.int64)])
        return totals

    def count_chunks(self, chunks: list[bytes]) -> np.ndarray:
        """Tokens of each chunk, special strings one token each; chunks met before are remembered."""
        if len(self.totals) > CACHE_CHUNKS:
            self.seen, self.totals = Seen(), np.zeros(0, np.int64)
        rows, new = self.seen.rows(chunks)
        counted = [self._count_new([chunks[i] for i in new[at:at + COUNT_AT_ONCE]]) for at in range(0, len(new), COUNT_AT_ONCE)]
        self.totals = np.concatenate([self.totals, *counted])
        return self.totals[rows]


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, as the library counts with default settings.

    ``path`` names a byte-level BPE file and ``pattern`` the expression that splits its pre-tokens. A null text is
    empty and has no token. Rows are counted one by one, repeated or not; an empty table gives
    no rows; other columns are not looked at. Nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger.of(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                chunks = Chunks(part["text"])
                tokens = chunks.sums(merger.count_chunks(chunks.distinct))
                yield from pa.table([part["doc_id"], pa.array(chunks.bytes), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]).to_batches()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
