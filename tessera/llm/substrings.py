"""Removal of repeated passages by level-wise doubling of window lengths.

A window of ``4b`` words is looked for by levels of b, 2b and 4b words. Its b-word window
of smallest hash, the anchor, is the same wherever the window occurs. Consecutive
windows with one anchor form a stretch, the unit that travels.

1. Each slice of documents keeps, of equal stretches, the earliest; the others are
   repeats without further ado. What is kept goes to a bucket by its anchor, as arrays.
2. In a bucket, stretches whose anchor occurs alone end (level b), then those whose
   anchor extended to 2b words occurs alone (level 2b). Of equal stretches that are left all but the
   first are repeats. Where different stretches share an anchor, their windows are to be
   compared one by one.
3. Those windows, rare ones at the edges of copied passages, are looked up in the texts and
   compared at full length (level 4b) by an aggregation and a join on 128 bits.

A key that a large part of all documents holds sends one row per slice in step 1 if its
surroundings agree. If they do not, and a slice has many of them, it sends
them to step 3 at once and leaves a note in the bucket. So no bucket grows with the frequency of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, mix, slices, stored

#: Different stretches of one anchor that a slice sends to the bucket; more go to the window level.
MANY = 64
#: Least buckets for each shuffle partition, so that partitions even out, and bytes of text whose stretches share a bucket, about.
BUCKETS_EACH, BUCKET_BYTES = 4, 4 << 20
NULL_ID = -(1 << 63)

_SENT = "bucket int, kind byte, anchor array<long>, digest array<long>, extended array<long>, doc array<long>, version array<long>, start array<int>, n array<int>"
_KEPT = "doc long, version long, start int, n int, compare boolean"


def fold(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` items from each position on."""
    out = hashes[:max(0, len(hashes) - n + 1)]
    for j in range(1, n):
        out = mix(out, hashes[j:j + len(out)])
    return out


def double(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of ``2n`` items from the hashes of ``n``."""
    return mix(hashes[:-n], hashes[n:]) if len(hashes) > n else hashes[:0]


def first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of ``values[s:s + width]`` for each s."""
    where = np.arange(len(values))
    low, span = values, 1
    while span < width:
        step = min(span, width - span)
        right = low[step:] < low[:-step]
        where = np.where(right, where[step:], where[:-step])
        low = np.where(right, low[step:], low[:-step])
        span += step
    return where


class Stretches:
    """Stretches of a slice of texts as parallel arrays; starts count words from the text's first."""

    def __init__(self, words: Words, base: int):
        window = 4 * base
        hashes = words.hashes()
        owner = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
        total = len(hashes)
        self.row = self.start = self.n = np.zeros(0, np.int64)
        self.anchor = self.digest = self.extended = np.zeros(0, np.uint64)
        if total < window:
            return
        one = fold(hashes, base)
        two = double(one, base)
        four = double(two, 2 * base)
        at = first_minimum(one, window - base + 1)[:len(four)]
        valid = owner[:len(four)] == owner[window - 1:]
        s = np.flatnonzero(valid)
        if not len(s):
            return
        head = np.r_[True, (np.diff(at[s]) != 0) | (np.diff(s) != 1)]
        first = s[head]
        n = np.diff(np.append(np.flatnonzero(head), len(s)))
        last, anchor = first + n - 1, at[first]
        begin = words.bounds[owner[first]]
        left = np.where(first <= anchor - base, two[np.maximum(anchor - base, 0)] >> np.uint64(32) | np.uint64(1), np.uint64(0))
        right = np.where(last >= anchor - 2 * base, two[np.minimum(anchor, len(two) - 1)] >> np.uint64(32) | np.uint64(1), np.uint64(0))
        right[anchor + 2 * base > words.bounds[owner[first] + 1]] = 0
        self.row, self.start, self.n = owner[first], first - begin, n
        self.anchor = one[anchor]
        self.digest = mix(mix(four[first], four[last]), n.astype(np.uint64))
        self.extended = (left << np.uint64(32)) | right


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Group number of each row of sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def _arrays(rows: list[dict]) -> pa.RecordBatch:
    schema = {"bucket": pa.int32(), "kind": pa.int8(), **{c: pa.list_(pa.int64()) for c in ("anchor", "digest", "extended", "doc", "version")},
              **{c: pa.list_(pa.int32()) for c in ("start", "n")}}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in schema.items()], names=list(schema))


def _send(part: pa.Table, base: int, buckets: int) -> pa.RecordBatch:
    """Step 1 for a slice: kept stretches by bucket (kind 0), repeats (kind 1), windows to compare (kind 2)."""
    s = Stretches(Words(part["text"]), base)
    doc = part["doc"].to_numpy()[s.row]
    version = part["version"].to_numpy()[s.row]
    order = np.lexsort((s.start, version, doc, s.digest, s.anchor))
    anchor, digest, extended, doc, version, start, n = (x[order] for x in (s.anchor, s.digest, s.extended, doc, version, s.start, s.n))
    rows: list[dict] = []
    if not len(anchor):
        return _arrays(rows)
    equal = _groups(anchor, digest)
    first = np.r_[True, np.diff(equal) > 0]
    heads = np.flatnonzero(first)[equal]
    repeat = (doc != doc[heads]) | (version != version[heads]) | (start != start[heads])
    by_anchor = _groups(anchor)
    hot = np.bincount(by_anchor, weights=first)[by_anchor] > MANY
    empty = np.zeros(0, np.int64)

    def add(kind: int, bucket: int, rows_: np.ndarray, note: bool = False) -> None:
        if len(rows_):
            values = (anchor, digest, extended) if kind == 0 else (empty.astype(np.uint64),) * 3
            rows.append(dict(zip(("anchor", "digest", "extended"), (v[rows_].view(np.int64) if len(v) else empty for v in values)),
                             bucket=bucket, kind=kind, doc=doc[rows_], version=version[rows_], start=start[rows_], n=np.full(len(rows_), -1) if note else n[rows_]))

    spread = int(np.uint64(doc[0]) % np.uint64(buckets))
    add(1, spread, np.flatnonzero(repeat))
    add(2, spread, np.flatnonzero(first & hot))
    where = (anchor % np.uint64(buckets)).astype(np.int64)
    for note, chosen in ((False, np.flatnonzero(first & ~hot)), (True, np.flatnonzero(hot & np.r_[True, np.diff(by_anchor) > 0]))):
        chosen = chosen[np.argsort(where[chosen], kind="stable")]
        cuts = np.searchsorted(where[chosen], np.arange(buckets + 1))
        for bucket in np.flatnonzero(np.diff(cuts)):
            add(0, int(bucket), chosen[cuts[bucket]:cuts[bucket + 1]], note)
    return _arrays(rows)


def _decide(group: pa.Table) -> pa.Table:
    """Step 2 for a bucket."""
    import pyarrow.compute as pc

    def flat(table: pa.Table, column: str) -> np.ndarray:
        return pc.list_flatten(table[column]).to_numpy().astype(np.int64)

    out = []
    for kind in (1, 2):
        passed = group.filter(pc.equal(group["kind"], kind))
        rows = [flat(passed, c) for c in ("doc", "version", "start", "n")]
        out.append((*rows, np.full(len(rows[0]), kind == 2)))
    asked = group.filter(pc.equal(group["kind"], 0))
    anchor, digest, extended, doc, version, start, n = (flat(asked, c) for c in ("anchor", "digest", "extended", "doc", "version", "start", "n"))
    order = np.lexsort((start, version, doc, digest, anchor))
    anchor, digest, extended, doc, version, start, n = (x[order] for x in (anchor, digest, extended, doc, version, start, n))
    if len(anchor):
        by_anchor = _groups(anchor)
        noted = np.bincount(by_anchor, weights=n < 0)[by_anchor] > 0
        stay = (n >= 0) & ((np.bincount(by_anchor)[by_anchor] > 1) | noted)
        anchor, digest, extended, doc, version, start, n, noted = (x[stay] for x in (anchor, digest, extended, doc, version, start, n, noted))
        longer = noted.copy()
        code = extended.view(np.uint64)
        for side in (code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)):
            _, inverse, counts = np.unique(mix(anchor.view(np.uint64), side), return_inverse=True, return_counts=True)
            longer |= (side != 0) & (counts[inverse] > 1)
        anchor, digest, doc, version, start, n, noted = (x[longer] for x in (anchor, digest, doc, version, start, n, noted))
    if len(anchor):
        equal = _groups(anchor, digest)
        first = np.r_[True, np.diff(equal) > 0]
        heads = np.flatnonzero(first)[equal]
        repeat = (doc != doc[heads]) | (version != version[heads]) | (start != start[heads])
        by_anchor = _groups(anchor)
        compare = first & ((np.bincount(by_anchor, weights=first)[by_anchor] > 1) | noted)
        for chosen, flag in ((repeat, False), (compare, True)):
            out.append((doc[chosen], version[chosen], start[chosen], n[chosen], np.full(int(chosen.sum()), flag)))
    doc, version, start, n, flag = (np.concatenate(c) for c in zip(*out))
    return pa.table({"doc": doc, "version": version, "start": start.astype(np.int32), "n": n.astype(np.int32), "compare": flag})


def _spans(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and count of each entry of a column of (start, n) lists; null is none."""
    import pyarrow.compute as pc

    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    entries = pc.list_flatten(lists)
    return np.repeat(np.arange(len(counts)), counts), pc.struct_field(entries, "start").to_numpy().astype(np.int64), pc.struct_field(entries, "n").to_numpy().astype(np.int64)


def remove_repeats(docs: DataFrame, window: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Remove every word that a repeated window covers; ``doc_id, n_words, n_removed, spans, text``.

    A window (``window`` words, a multiple of 4) is repeated if its words also start earlier: in a document of smaller id, or
    earlier in the same one. ``spans`` are the removed ranges of words, ``text`` the kept
    words joined by one space. Windows are judged on the input.

    Null and empty texts have no words. Documents shorter than a window lose
    nothing. A null id counts as the smallest. Rows that share an id are ordered by a 64-bit hash of their text, and rows equal in both are
    one document with a result each. An empty table gives no rows. Other columns are not looked at.
    """
    base = window // 4
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("version"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(BUCKETS_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _send(part, base, buckets)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"])
                row, start, n = _spans(part["spans"])
                starts = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                row = np.repeat(row, n)
                place = words.bounds[row] + starts
                keys = [double(double(fold(words.hashes(seed), base), base), 2 * base)[place].view(np.int64) for seed in (0, 1)]
                held = [part[c].to_numpy()[row] for c in ("doc", "version")]
                yield from pa.table([*keys, *held, starts.astype(np.int32)], names=["k1", "k2", "doc", "version", "start"]).to_batches()

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"])
                row, start, n = _spans(part["spans"])
                edge = np.zeros(len(words.codes) + 1, np.int64)
                np.add.at(edge, words.bounds[row] + start, 1)
                np.add.at(edge, words.bounds[row] + start + n + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                texts, spans, removed = [], [], []
                for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
                    inside = gone[a:b]
                    kept = words.codes[a:b][~inside] if inside.any() else words.codes[a:b]
                    texts.append(b" ".join([words.distinct[c] for c in kept.tolist()]))
                    turns = np.flatnonzero(np.diff(np.r_[False, inside, False])).tolist()
                    spans.append([{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2])])
                    removed.append(b - a - len(kept))
                yield from pa.table([
                    part["doc_id"], pa.array(np.diff(words.bounds)), pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "text"]).to_batches()

    def by_document(marks: DataFrame) -> DataFrame:
        return marks.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "n")).alias("spans")).hint("shuffle_hash")

    place = ["doc", "version", "start"]
    judged = stored(rows.mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(_decide, _KEPT), "stretches")
    asked = by_document(judged.filter("compare"))
    compared = stored(rows.join(asked, ["doc", "version"]).select("doc", "version", "text", "spans")
                      .mapInArrow(windows, "k1 long, k2 long, doc long, version long, start int"), "windows")
    firsts = compared.groupBy("k1", "k2").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    later = compared.join(firsts, ["k1", "k2"]).filter(F.struct(*place) != F.col("first")).select(*place, F.lit(1).alias("n"))
    marks = by_document(judged.filter(~F.col("compare")).select(*place, "n").unionByName(later))
    return (rows.join(marks, ["doc", "version"], "left").select("doc_id", "text", "spans")
            .mapInArrow(clear, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, text string"))
