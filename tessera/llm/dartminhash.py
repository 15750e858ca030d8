"""Near-duplicate groups by DartMinHash signatures, banded joining and exact verification.

Every element of the universe owns random darts: points (weight, rank) with one dart expected for
each unit of area. A document hits the darts of its elements that lie below its weight
for them and below a rank limit, chosen so that about ``k ln k + 2k`` are hit
whatever its size. Darts fall on ``k`` coordinates; the earliest on each makes the signature, and
two documents agree on a coordinate with probability equal to their weighted Jaccard similarity.

Weights are real numbers. Darts are drawn from cells of the (weight, rank) plane by hashing. The weight axis is cut at
0, 1, 2, 4, 8 ... (times a unit), so an element of weight w takes part in about log2(w) cells, not in w; a dart of
the last one counts if it lies below w. The rank axis is cut the finer the wider the weight cell. A short document draws many cells
for each element and a long one a few low cells: the work is about the number of darts plus the number of elements.

For texts an element is a word shingle and its weight the number of times it occurs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, mix, ranges, slices, stored
from tessera.llm.linking import component_labels, join_unique
from tessera.llm.substrings import NULL_ID, fold

#: Rank limits of the cells below rank 1; above, cells have height 1.
LOW_CELLS = [(0.0, 4.0 ** -8), *((4.0 ** -j, 4.0 ** -(j - 1)) for j in range(8, 0, -1))]
#: Darts of the documents that are drawn together, about.
DARTS_AT_ONCE = 1 << 20
#: Buckets up to this size compare the members of different groups as pairs, larger ones block by block.
SMALL_BUCKET = 32
#: Members of one block of a large bucket, on either side.
BLOCK_FEW, BLOCK_MANY = 256, 1024
#: Pairs whose elements are sorted together.
PAIRS_AT_ONCE = 1000


def _uniform(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def _poisson(area: float, u: np.ndarray) -> np.ndarray:
    """Poisson counts with mean ``area`` from uniforms."""
    steps, term, total, i = [], math.exp(-area), 0.0, 0
    while total < 1 - 1e-15 and i < 40:
        total += term
        steps.append(total)
        i += 1
        term *= area / i
    return np.searchsorted(np.array(steps), u, side="right")


class Shingles:
    """Distinct shingles of a slice, ordered by text and hash: ``element`` (64 bits), ``weight`` (occurrences), ``bounds`` (rows + 1)."""

    def __init__(self, words: Words, size: int):
        hashes, counts = words.hashes(), np.diff(words.bounds)
        starts, kept = [], []
        for n in range(1, size + 1):  # a text of fewer words is one shingle
            rows = np.flatnonzero(counts >= size if n == size else counts == n)
            many = counts[rows] - n + 1
            at = ranges(words.bounds[rows], many)
            kept.append(mix(fold(hashes, n)[at], np.full(len(at), n, np.uint64)) if len(at) else np.zeros(0, np.uint64))
            starts.append(np.repeat(rows, many))
        row, shingle = np.concatenate(starts), np.concatenate(kept)
        order = np.lexsort((shingle, row))
        row, shingle = row[order], shingle[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
        head = np.flatnonzero(new)
        self.element = shingle[head]
        self.weight = np.diff(np.append(head, len(row))).astype(np.float64)
        self.bounds = np.searchsorted(row[head], np.arange(len(counts) + 1))


class Cells:
    """Weight cells of elements: cell 0 is [0, unit), cell c > 0 is [unit 2^(c-1), unit 2^c); each element has those that begin below its weight."""

    def __init__(self, element: np.ndarray, weight: np.ndarray, unit: float):
        over = np.maximum(weight / unit, 1.0)
        last = np.ceil(np.log2(over)).astype(np.int64)
        last -= (last > 0) & (2.0 ** (last - 1) >= over)  # no cell that begins at the weight itself, whatever the logarithm rounds to
        self.at = np.repeat(np.arange(len(element)), last + 1)
        cell = ranges(np.zeros(len(element), np.int64), last + 1)
        self.low = np.where(cell > 0, unit * 2.0 ** (cell - 1.0), 0.0)
        self.width = np.where(cell > 0, self.low, unit)
        self.weight = weight[self.at]
        self.whole = self.low + self.width <= self.weight
        self.key = mix(element[self.at], (cell + (1 << 20)).astype(np.uint64))


def _draw(cells: Cells, row: np.ndarray, limit: np.ndarray, k: int, best: np.ndarray) -> None:
    """Throw the darts of all cells below their row's rank limit; ``best`` keeps the earliest of each coordinate.

    Ranks are stretched by the width of the weight cell, so that areas are those of cells of width 1.
    """
    top = limit[row] * cells.width

    def throw(cell: np.ndarray, low: np.ndarray | float, height: float, at: np.ndarray) -> None:
        key = mix(cells.key[at], cell)
        darts = _poisson(height, _uniform(key))
        hit = np.repeat(np.arange(len(at)), darts)
        turn = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(key[hit], (turn + 1).astype(np.uint64))
        stretched = (low[hit] if isinstance(low, np.ndarray) else low) + height * _uniform(dart)
        own = at[hit]
        below = stretched < top[own]
        partial = np.flatnonzero(below & ~cells.whole[own])
        if len(partial):
            part = own[partial]
            weight = cells.low[part] + cells.width[part] * _uniform(mix(dart[partial], np.full(1, 9, np.uint64)))
            below[partial] = weight < cells.weight[part]
        dart, rank, where = mix(dart[below], np.full(1, 5, np.uint64)), (stretched / cells.width[own])[below], row[own[below]]
        coordinate = where * k + (dart % np.uint64(k)).astype(np.int64)
        packed = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart >> np.uint64(32))
        np.minimum.at(best, coordinate, packed)

    for i, (low, high) in enumerate(LOW_CELLS):
        at = np.flatnonzero(top > low)
        throw(np.full(len(at), i, np.uint64), low, high - low, at)
    at = np.flatnonzero(top > 1)
    high = np.ceil(top[at]).astype(np.int64) - 1
    unit = ranges(np.ones(len(at), np.int64), high)
    throw((unit + len(LOW_CELLS)).astype(np.uint64), unit.astype(np.float64), 1.0, np.repeat(at, high))


def signatures(elements: Shingles, k: int, unit: float = 1.0) -> np.ndarray:
    """``k`` 32-bit dart names for each row of weighted elements (zeros where it has none).

    Weights are positive reals; ``unit`` is the width of the first weight cell, the same for all that are to be compared. Weights far below it cost
    darts that do not count.
    """
    held = np.diff(elements.bounds)
    out = np.zeros((len(held), k), np.uint64)
    darts = k * math.log(k) + 2 * k
    for at in range(0, len(held), max(1, int(DARTS_AT_ONCE / darts))):
        rows = np.arange(at, min(len(held), at + max(1, int(DARTS_AT_ONCE / darts))))
        rows = rows[held[rows] > 0]
        wanted = darts
        while len(rows):  # again, with twice the darts, where a coordinate is without one
            best = np.full(len(rows) * k, np.uint64(0xFFFFFFFFFFFFFFFF))
            place = ranges(elements.bounds[rows], held[rows])
            owner, weight = np.repeat(np.arange(len(rows)), held[rows]), elements.weight[place]
            cells = Cells(elements.element[place], weight, unit)
            _draw(cells, owner[cells.at], wanted / np.bincount(owner, weights=weight, minlength=len(rows)), k, best)
            full = (best.reshape(-1, k) != np.uint64(0xFFFFFFFFFFFFFFFF)).all(axis=1)
            out[rows[full]] = best.reshape(-1, k)[full] & np.uint64(0xFFFFFFFF)
            rows, wanted = rows[~full], wanted * 2
    return out


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc, key, text``: the id (null is the smallest), a hash of the text and the text."""
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text_column).alias("key"), F.col(text_column).alias("text"))


def sketches(rows: DataFrame, size: int, bands: int, each: int) -> DataFrame:
    """``doc, key, high, low, bands``: a 128-bit digest of the word sequence and the band keys of every text that has words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"])
                held = np.flatnonzero(np.diff(words.bounds))
                if not len(held):
                    continue
                place = np.arange(len(words.codes)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))
                digests = [np.add.reduceat(mix(words.hashes(seed), place.astype(np.uint64)), words.bounds[held]).view(np.int64) for seed in (0, 1)]
                found = signatures(Shingles(words, size), bands * each)[held].reshape(len(held), bands, each)
                keys = np.tile(np.arange(bands, dtype=np.uint64), (len(held), 1))
                for i in range(each):
                    keys = mix(keys, found[:, :, i])
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.reshape(-1).view(np.int64))
                own = [part[c].take(pa.array(held)) for c in ("doc", "key")]
                yield from pa.table([*own, *map(pa.array, digests), lists], names=["doc", "key", "high", "low", "bands"]).to_batches()

    return rows.mapInArrow(run, "doc long, key long, high long, low long, bands array<long>")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """``doc, elements, weights``: the 64-bit names of a text's shingles in order, and how often each occurs (exact up to 2^24)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                shingles = Shingles(Words(part["text"]), size)
                bounds = pa.array(shingles.bounds.astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (shingles.element.view(np.int64), shingles.weight.astype(np.float32))]
                yield from pa.table([part["doc"], *lists], names=["doc", "elements", "weights"]).to_batches()

    return rows.mapInArrow(run, "doc long, elements array<long>, weights array<float>")


def _flat(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values end to end and bounds (rows + 1) of a list column."""
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks != 1 else lists.chunk(0)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(), offsets - offsets[0]


def shared_weights(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> np.ndarray:
    """Sum of the lesser weights of common elements, pair by pair; each side is ``elements, weights, bounds`` (pairs + 1)."""
    pairs = len(left[2]) - 1
    pair = np.concatenate([np.repeat(np.arange(pairs), np.diff(side[2])) for side in (left, right)])
    element, weight = (np.concatenate([left[i], right[i]]) for i in (0, 1))
    order = np.lexsort((element, pair))
    pair, element, weight = pair[order], element[order], weight[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (element[1:] == element[:-1]))  # each side has an element once
    return np.bincount(pair[both], weights=np.minimum(weight[both], weight[both + 1]), minlength=pairs)


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (``doc, hub``; a written table) whose weighted Jaccard similarity reaches ``threshold``."""
    hubs = sets.select(F.col("doc").alias("hub"), F.col("elements").alias("right"), F.col("weights").alias("right_weights"))
    both = (join_unique(pairs, hubs, ["hub"], "inner")
            .join(sets.select("doc", F.col("elements").alias("left"), F.col("weights").alias("left_weights")), "doc")
            .select("doc", "hub", "left", "left_weights", "right", "right_weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(at, PAIRS_AT_ONCE)
                sides = [(_flat(part.column(c))[0], *_flat(part.column(f"{c}_weights"))) for c in ("left", "right")]
                one, other = (np.add.reduceat(weights.astype(np.float64), bounds[:-1]) for _, weights, bounds in sides)
                shared = shared_weights(*sides)
                keep = (shared > 0) & (shared >= threshold * (one + other - shared))
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("hub")], names=["doc", "hub"]).filter(pa.array(keep))

    return both.mapInArrow(run, "doc long, hub long")


def cross_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between groups inside large buckets (``band, doc, label``); pairs never become rows.

    Every pair of different groups has a side outside the bucket's largest group. Those members, in blocks,
    meet all members, in blocks; a task counts shared shingles array by array and returns the
    links that join groups it has not joined yet.
    """
    sizes = members.groupBy("band", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("n"), F.max("n").alias("largest"))
    held = (join_unique(members.select("band", "doc", "label"), main, ["band"], "inner").join(sets, "doc")
            .withColumn("many", F.ceil(F.col("n") / BLOCK_MANY).cast("int"))
            .withColumn("few", F.ceil((F.col("n") - F.col("largest")) / BLOCK_FEW).cast("int")))

    def block(count: str, seed: int):
        return F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    columns = ["band", "i", "j", "doc", "label", "elements", "weights"]
    few = held.filter("label <> main").withColumn("i", block("few", 1)).withColumn("j", every("many")).select(*columns).toDF(*columns)
    many = held.withColumn("i", every("few")).withColumn("j", block("many", 2)).select(*columns).toDF(*columns)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        found: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            docs, labels = right["doc"].to_pylist(), right["label"].to_numpy()
            elements, _ = _flat(right["elements"])
            weights, bounds = _flat(right["weights"])
            totals = np.add.reduceat(weights.astype(np.float64), bounds[:-1])
            names, codes = np.unique(elements, return_inverse=True)
            present = np.zeros(len(names))
            for doc, label, own, own_weights in zip(left["doc"].to_pylist(), left["label"].to_pylist(), left["elements"], left["weights"]):
                own, own_weights = own.values.to_numpy(), own_weights.values.to_numpy().astype(np.float64)
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                known = names[at] == own
                present[at[known]] = own_weights[known]
                shared = np.add.reduceat(np.minimum(present[codes], weights), bounds[:-1])
                present[at[known]] = 0.0
                near = (shared >= threshold * (own_weights.sum() + totals - shared)) & (labels != label)
                for i in np.flatnonzero(near).tolist():
                    a, b = root(label), root(int(labels[i]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        found.append((max(doc, docs[i]), min(doc, docs[i])))
        return pa.table({"doc": pa.array([f[0] for f in found], pa.int64()), "hub": pa.array([f[1] for f in found], pa.int64())})

    cells = ["band", "i", "j"]
    return few.groupBy(*cells).cogroup(many.groupBy(*cells)).applyInArrow(compare, "doc long, hub long")


def text_groups(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 20, each: int = 6,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc, key, label``: the group of near duplicates of every distinct pair of id and text that has words.

    ``doc`` is the id (``NULL_ID`` for null), ``key`` is ``xxhash64`` of the text. Texts of one id are compared
    like those of different ids: what they share is the id only. Equal word sequences (by a 128-bit digest) are one node, of
    which one text takes part. Shingles are compared by 64-bit names. First, all members of a band bucket are compared with one of
    them, its hub. Then, where a bucket still spans several groups, its members of different groups
    are compared with each other: as pairs in small buckets, in large ones block by block
    within tasks. So every link in a bucket that joins two groups is found.
    """
    rows = _keyed(docs, id_column, text_column)
    sketched = stored(sketches(rows, size, bands, each), "sketches")
    # one node for each word sequence, with the text that stands for it
    alike = sketched.groupBy("high", "low").agg(F.min(F.struct("doc", "key")).alias("one"), F.first("bands").alias("bands"))
    nodes = stored(alike.select(F.monotonically_increasing_id().alias("node"), "high", "low", "one", "bands"), "nodes")
    buckets = stored(nodes.select(F.col("node").alias("doc"), F.explode("bands").alias("band")).distinct(), "buckets")
    shared = buckets.groupBy("band").agg(F.min("doc").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = stored(join_unique(buckets, shared, ["band"], "inner"), "members")
    taking = nodes.join(members.select(F.col("doc").alias("node")).distinct(), "node").select("node", "one.doc", "one.key")
    texts = rows.join(taking.hint("shuffle_hash"), ["doc", "key"]).select(F.col("node").alias("doc"), "text")
    sets = stored(shingle_sets(texts, size).groupBy("doc").agg(F.first(F.struct("elements", "weights")).alias("s")).select("doc", "s.*"), "shingles")
    tried = stored(members.filter("doc <> hub").select("doc", "hub").distinct(), "pairs")
    links = stored(similar(tried, sets, threshold), "links")
    labels = _labels(links)
    named = stored(members.join(labels, "doc", "left").select("band", "doc", "n", F.coalesce("label", "doc").alias("label")), "named")
    mixed = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band")
    still = stored(join_unique(named, mixed, ["band"], "inner"), "mixed")
    small = still.filter(F.col("n") <= SMALL_BUCKET)
    other = small.select("band", F.col("doc").alias("hub"), F.col("label").alias("hub_label"))
    pairs = stored(small.join(other, "band").filter((F.col("label") != F.col("hub_label")) & (F.col("doc") > F.col("hub")))
                   .select("doc", "hub").distinct().join(tried, ["doc", "hub"], "left_anti"), "pairs")
    crossing = stored(similar(pairs, sets, threshold).unionByName(cross_links(still.filter(F.col("n") > SMALL_BUCKET), sets, threshold)), "links")
    if not crossing.isEmpty():
        labels = _labels(links.unionByName(crossing))
    held = stored(join_unique(sketched.select("doc", "key", "high", "low"), nodes.select("high", "low", "node"), ["high", "low"], "inner").select("doc", "key", "node").distinct(), "held")
    grouped = join_unique(held, labels.select(F.col("doc").alias("node"), "label"), ["node"])
    return stored(grouped.select("doc", "key", F.coalesce("label", "node").alias("label")), "groups")


def _labels(links: DataFrame) -> DataFrame:
    """``doc, label``: the smallest node of each component of ``links`` (``doc, hub``)."""
    return component_labels(links.select(F.col("doc").alias("node"), "hub")).withColumnRenamed("node", "doc")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 20, each: int = 6,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, class_id``: one row per id, with the smallest id of its group of near duplicates.

    Two texts are linked if the weighted Jaccard similarity of their shingles of ``size`` words is at least ``threshold``
    (``text_groups``), two ids if any of their texts are; groups are the connected
    components. A link of similarity s is found with probability ``1 - (1 - s**each)**bands``.

    A text of fewer words than a shingle is one shingle. Texts without words (null, empty) are linked to nothing. Rows that
    share an id (null is an id) are one document, linked by any of their texts, each with a signature and shingles of
    its own. Texts are never cut, however long. An empty table gives no rows. Other columns are not looked at.
    """
    held = text_groups(docs, threshold, size, bands, each, id_column, text_column).select("doc", "label")
    several = held.groupBy("doc").agg(F.min("label").alias("hub"), F.max("label").alias("high")).filter("hub <> high").drop("high")
    ties = join_unique(held, several, ["doc"], "inner").filter("label <> hub").select(F.col("label").alias("doc"), "hub").distinct()
    ties = stored(ties, "ties")
    if not ties.isEmpty():
        whole = _labels(ties).select(F.col("doc").alias("label"), F.col("label").alias("whole"))
        held = stored(join_unique(held, whole, ["label"]).select("doc", F.coalesce("whole", "label").alias("label")), "held")
    least = held.groupBy("label").agg(F.min("doc").alias("class"), F.max("doc").alias("last")).filter("class <> last").drop("last")
    own = _keyed(docs, id_column, text_column).select("doc", F.col("doc").alias("class"))
    classes = own.unionByName(join_unique(held, least, ["label"], "inner").select("doc", "class")).groupBy("doc").agg(F.min("class").alias("class"))
    return classes.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), F.when(F.col("class") != NULL_ID, F.col("class")).alias("class_id"))
