"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors of cosine c or more lie within ``epsilon = sqrt(2 - 2c)`` of each other, and no rotation changes
that. The leading principal directions of a sample span a grid of that cell width; vectors are sorted by
their cells, first direction first. Intervals of this sequence have bounding boxes on the leading
directions. Two intervals whose boxes lie further apart than epsilon hold no link and are
skipped; two that lie within epsilon as a whole (centres and radii) are all links and need no comparison either;
otherwise the longer one is halved, down to short intervals that are compared by one matrix product.

The sequence is cut into blocks by range. Pairs of blocks that may hold links are found by their boxes, and each pair
is joined by one task. Equal vectors are one node with a weight, links are counted and joined
into trees inside the task, so no pair of vectors is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stored
from tessera.llm.linking import component_labels, join_unique
from tessera.llm.vectors import finite

#: Directions that order the sequence, and those that bound intervals.
ORDER_BY, BOUND_BY = 8, 16
#: Nodes of a block (the most, about), least blocks of a table of some size, and nodes of an interval that is compared whole.
BLOCK_NODES, LEAST_BLOCKS, LEAF = 16_384, 8, 128
#: The basis is fitted on at most this many vectors, and bytes of them; any basis gives right results.
FIT_ROWS, FIT_BYTES = 20_000, 32 << 20
#: Guard of geometric tests against rounding, and the width of the band around the threshold that is computed again pair by pair.
GUARD, BAND = 1e-7, 1e-9
#: Links of a component leave a task as a tree of this fan-out, so that no node has very many.
FAN = 64


def unit_rows(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and unit vectors (doubles) of the lists of each length."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        x = flat[starts[at][:, None] + np.arange(size)]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
        yield at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cell_width(epsilon: float) -> float:
    """Width of grid cells: epsilon, but for the narrowest thresholds."""
    return max(epsilon, 0.01) + GUARD


class Basis:
    """Leading directions: principal ones for the length they were fitted on, the first components for others."""

    def __init__(self, sample: np.ndarray):
        centred = sample - sample.mean(axis=0) if len(sample) else sample
        _, _, axes = np.linalg.svd(centred.T @ centred)
        self.axes = axes[:BOUND_BY].T

    def leading(self, unit: np.ndarray) -> np.ndarray:
        """``BOUND_BY`` coordinates of each row; missing ones are 0."""
        p = unit @ self.axes if unit.shape[1] == len(self.axes) else unit[:, :BOUND_BY]
        return np.pad(p, ((0, 0), (0, BOUND_BY - p.shape[1])))


class Forest:
    """Union-find over the nodes of a task; the smallest position is the root."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while True:
            onward = self.parent[root]
            if (onward == root).all():
                self.parent[at] = root
                return root
            root = onward

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        apart = a != b
        if apart.any():
            ends = np.unique(np.minimum(a, b)[apart] * len(self.parent) + np.maximum(a, b)[apart])
            for x, y in zip((ends // len(self.parent)).tolist(), (ends % len(self.parent)).tolist()):
                x, y = self._root(x), self._root(y)
                self.parent[max(x, y)] = min(x, y)


class Interval:
    """A run of leaves of a sequence: bounds on the leading directions, centre and radius, weight."""

    def __init__(self, sequence: Sequence, first: int, last: int):
        self.sequence, self.first, self.last = sequence, first, last
        self.a, self.b = first * LEAF, min(last * LEAF, len(sequence.unit))
        self.low, self.high = sequence.lows[first:last].min(axis=0), sequence.highs[first:last].max(axis=0)
        unit = sequence.unit[self.a:self.b]
        self.centre = unit.mean(axis=0)
        self.radius = float(np.sqrt(((unit - self.centre) ** 2).sum(axis=1).max()))
        self.weight = int(sequence.weight[self.a:self.b].sum())

    @property
    def leaf(self) -> bool:
        return self.last - self.first == 1

    def halves(self) -> tuple[Interval, Interval]:
        middle = (self.first + self.last) // 2
        return self.sequence.interval(self.first, middle), self.sequence.interval(middle, self.last)


class Sequence:
    """Nodes of a block in epsilon grid order; ``offset`` places them among all nodes of the task."""

    def __init__(self, unit: np.ndarray, weight: np.ndarray, basis: Basis, epsilon: float, offset: int):
        leading = basis.leading(unit)
        cells = np.floor(leading[:, :ORDER_BY] / cell_width(epsilon))
        self.order = np.lexsort([leading[:, 0], *cells.T[::-1]])
        self.unit, self.weight, self.offset = unit[self.order], weight[self.order], offset
        starts = np.arange(0, len(unit), LEAF)
        self.lows = np.minimum.reduceat(leading[self.order], starts, axis=0)
        self.highs = np.maximum.reduceat(leading[self.order], starts, axis=0)
        self.held: dict[tuple[int, int], Interval] = {}

    def interval(self, first: int, last: int) -> Interval:
        if (first, last) not in self.held:
            self.held[first, last] = Interval(self, first, last)
        return self.held[first, last]

    def whole(self) -> Interval:
        return self.interval(0, len(self.lows))


class Joiner:
    """Counts links of two sequences, or of one with itself, and joins linked nodes."""

    def __init__(self, size: int, threshold: float, epsilon: float):
        self.links, self.forest = np.zeros(size, np.int64), Forest(size)
        self.threshold, self.epsilon, self.compared = threshold, epsilon, 0

    def within(self, node: Interval) -> None:
        """Links inside one interval."""
        if 2 * node.radius < self.epsilon - GUARD:
            at = np.arange(node.a, node.b) + node.sequence.offset
            self.links[at] += node.weight - node.sequence.weight[node.a:node.b]
            self.forest.join(at, np.full(len(at), at[0]))
        elif node.leaf:
            self._compare(node, node)
        else:
            left, right = node.halves()
            self.within(left)
            self.within(right)
            self.between(left, right)

    def between(self, one: Interval, other: Interval) -> None:
        """Links between two intervals."""
        gap = np.maximum(0.0, np.maximum(one.low - other.high, other.low - one.high))
        if float((gap * gap).sum()) > (self.epsilon + GUARD) ** 2:
            return
        apart = float(np.sqrt(((one.centre - other.centre) ** 2).sum()))
        if apart - one.radius - other.radius > self.epsilon + GUARD:
            return
        if apart + one.radius + other.radius < self.epsilon - GUARD:
            left, right = (np.arange(n.a, n.b) + n.sequence.offset for n in (one, other))
            self.links[left] += other.weight
            self.links[right] += one.weight
            self.forest.join(np.concatenate([left, right]), np.full(len(left) + len(right), left[0]))
        elif one.leaf and other.leaf:
            self._compare(one, other)
        elif other.leaf or (not one.leaf and one.last - one.first >= other.last - other.first):
            for part in one.halves():
                self.between(part, other)
        else:
            for part in other.halves():
                self.between(one, part)

    def _compare(self, one: Interval, other: Interval) -> None:
        self.compared += 1
        left, right = one.sequence.unit[one.a:one.b], other.sequence.unit[other.a:other.b]
        cosine = left @ right.T
        for i, j in np.argwhere(np.abs(cosine - self.threshold) < BAND):
            cosine[i, j] = float((left[i] * right[j]).sum())
        linked = cosine >= self.threshold
        if one is other:
            np.fill_diagonal(linked, False)
        rows, columns = np.nonzero(linked)
        if len(rows) == 0:
            return
        self.links[one.a + one.sequence.offset:one.b + one.sequence.offset] += linked @ other.sequence.weight[other.a:other.b]
        if one is not other:
            self.links[other.a + other.sequence.offset:other.b + other.sequence.offset] += linked.T @ one.sequence.weight[one.a:one.b]
        self.forest.join(rows + one.a + one.sequence.offset, columns + other.a + other.sequence.offset)


def tree_hubs(nodes: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For each node another of the same root, such that all of a root are joined and none has more than ``FAN + 1`` links."""
    order = np.lexsort((nodes, root))
    first = np.ones(len(order), bool)
    first[1:] = root[order][1:] != root[order][:-1]
    starts = np.flatnonzero(first)
    start = np.repeat(starts, np.diff(np.append(starts, len(order))))
    place = np.arange(len(order)) - start
    hubs = np.empty_like(nodes)
    hubs[order] = nodes[order][start + np.maximum(0, place - 1) // FAN]
    return hubs


def linked_nodes(left: pa.Table, right: pa.Table, basis: Basis, threshold: float, epsilon: float) -> pa.Table:
    """``node, links, hub`` of the linked nodes of a pair of blocks; an empty ``right`` joins ``left`` with itself."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
    sides = [{unit.shape[1]: (t["node"].to_numpy()[at], unit, t["n"].to_numpy()[at]) for at, unit in unit_rows(t["vec"])} if t.num_rows else {} for t in (left, right)]
    for size in sorted(sides[0]):
        found = [side[size] for side in sides if size in side]
        if right.num_rows and len(found) < 2:
            continue
        joiner = Joiner(sum(len(ids) for ids, _, _ in found), threshold, epsilon)
        sequences, nodes, offset = [], [], 0
        for ids, unit, weight in found:
            sequences.append(Sequence(unit, weight, basis, epsilon, offset))
            nodes.append(ids[sequences[-1].order])
            offset += len(ids)
        if right.num_rows:
            joiner.between(sequences[0].whole(), sequences[1].whole())
        else:
            joiner.within(sequences[0].whole())
        at = np.flatnonzero(joiner.links)
        ids = np.concatenate(nodes)[at]
        for column, values in zip(out, (ids, joiner.links[at], tree_hubs(ids, joiner.forest.roots(at)))):
            column.append(values)
    return pa.table([np.concatenate(c).astype(np.int64) for c in out], names=["node", "links", "hub"])


def _taking_part(vec: Column) -> Column:
    return finite(vec) & F.exists(vec, lambda x: x != 0)


def fitted_basis(nodes: DataFrame) -> Basis:
    """Principal directions of at most ``FIT_ROWS`` vectors of the most frequent length, those of smallest hash."""
    common = nodes.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return Basis(np.zeros((0, 1)))
    rows = max(2, min(FIT_ROWS, FIT_BYTES // (8 * common["size"])))
    sample = nodes.filter(F.size("vec") == common["size"]).orderBy("low", "high").limit(rows).select("vec").toArrow()
    return Basis(next(unit_rows(sample["vec"]))[1])


def ordered_blocks(nodes: DataFrame, basis: Basis, epsilon: float, blocks: int, block_nodes: int) -> DataFrame:
    """``nodes`` with ``node`` and ``block``: ranges of the epsilon grid order (lengths apart), equal cells split by hash.

    Spark deals the order to ranges; ranges are counted, and those next to each other make a block of about ``block_nodes``, however many
    ranges there are.
    """
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            out = np.zeros((table.num_rows, ORDER_BY), np.int32)
            for at, unit in unit_rows(table["vec"]) if table.num_rows else ():
                out[at] = np.floor(basis.leading(unit)[:, :ORDER_BY] / cell_width(epsilon))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), ORDER_BY).cast(pa.list_(pa.int32()))
            yield from table.append_column("cells", lists).to_batches()

    schema = T.StructType([*nodes.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    dealt = nodes.mapInArrow(cells, schema).repartitionByRange(blocks, F.size("vec"), "cells", "low")
    ranged = stored(dealt.select(F.monotonically_increasing_id().alias("node"), F.spark_partition_id().alias("range"), "low", "high", "n", "least", "vec"), "ranges")
    counts = ranged.groupBy("range").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(W.orderBy("range")) - F.col("rows")
    block = F.floor((before + F.col("rows") / 2) / block_nodes).cast("int").alias("block")
    return ranged.join(counts.select("range", block), "range").drop("range")


def block_pairs(blocks: DataFrame, basis: Basis, epsilon: float) -> DataFrame:
    """``i, j`` (i <= j): the pairs of blocks whose bounding boxes lie within epsilon.

    Boxes, one for thousands of nodes, meet by the grid cells they span on the first direction.
    """
    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block, p = batch["block"].to_numpy(), np.zeros((batch.num_rows, BOUND_BY))
            for at, unit in unit_rows(pa.chunked_array([batch["vec"]])):
                p[at] = basis.leading(unit)
            for b in np.unique(block):
                low, high = p[block == b].min(axis=0), p[block == b].max(axis=0)
                yield pa.RecordBatch.from_pydict({"block": np.full(BOUND_BY, b, np.int32), "d": np.arange(BOUND_BY, dtype=np.int32), "low": low, "high": high})

    parts = blocks.select("block", "vec").mapInArrow(boxes, "block int, d int, low double, high double")
    box = (parts.groupBy("block", "d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
           .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("d", "low", "high"))).alias("box")))
    box = stored(box, "boxes")
    reach, width = epsilon + GUARD, cell_width(epsilon)

    def spans(name: str, number: str, more: int) -> DataFrame:
        ends = [F.floor(F.element_at("box", 1)[side] / width) for side in ("low", "high")]
        return box.select(F.col("block").alias(number), F.col("box").alias(name), F.explode(F.sequence(ends[0] - more, ends[1] + more)).alias("cell"))

    one, other = spans("one", "i", 1), spans("other", "j", 0)
    gap = F.aggregate(F.zip_with("one", "other", lambda a, b: F.greatest(F.lit(0.0), a["low"] - b["high"], b["low"] - a["high"])), F.lit(0.0), lambda s, x: s + x * x)
    return one.join(other, "cell").filter((F.col("i") <= F.col("j")) & (gap <= reach * reach)).select("i", "j").distinct()


def near_vectors(table: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", block_nodes: int = BLOCK_NODES) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per vector, all linked whose cosine is ``threshold`` or more.

    ``n_links`` counts the other rows a row is linked with, ``component_id`` is the smallest id reachable by links, its own included, and
    ``kept`` tells whether that is the row's own. Cosines are double precision; only vectors of equal
    length are compared. Vectors that are null, empty, zero or hold null or non-finite components link with nothing: 0 links, their own
    component, kept. Rows are taken one by one: rows that share an id, with one vector or several, are linked only if their
    vectors are. A null id is larger than any other; a component without an id has a null one and its rows are kept. An empty table
    gives no rows. Other columns are not looked at.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    spark = table.sparkSession
    epsilon = float(np.sqrt(2 - 2 * threshold))
    rows = table.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vec")).withColumn("good", _taking_part(F.col("vec")))
    # equal vectors are one node; two independent 64-bit hashes name them
    keyed = rows.filter("good").select("vec_id", F.xxhash64("vec").alias("low"), F.xxhash64(F.lit(1), "vec").alias("high"), "vec")
    nodes = stored(keyed.groupBy("low", "high").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vec").alias("vec")), "nodes")
    count = nodes.count()
    parts = max(1, -(-count // block_nodes), min(LEAST_BLOCKS, count // 500))
    basis = fitted_basis(nodes)
    blocks = stored(ordered_blocks(nodes, basis, epsilon, parts, max(1, -(-count // parts))), "blocks")
    pairs = stored(block_pairs(blocks, basis, epsilon), "block-pairs")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        return linked_nodes(left, right, basis, threshold, epsilon)

    cells = stored(pairs.select(F.col("i").alias("block"), F.struct(F.lit(True).alias("left"), "i", "j").alias("cell"))
                   .unionByName(pairs.filter("i < j").select(F.col("j").alias("block"), F.struct(F.lit(False).alias("left"), "i", "j").alias("cell")))
                   .groupBy("block").agg(F.collect_list("cell").alias("cells")), "cells")
    def dealt(side: bool) -> DataFrame:
        own = F.explode(F.filter("cells", lambda c: c["left"] == side)).alias("cell")
        return blocks.join(cells, "block").select("node", "n", "vec", own).select("cell.i", "cell.j", "node", "n", "vec").toDF("i", "j", "node", "n", "vec")

    left, right = dealt(True), dealt(False)
    found = stored(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(answer, "node long, links long, hub long"), "links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = component_labels(found.filter("node <> hub").select("node", "hub"))
    named = stored(blocks.select("node", "low", "high", "n", "least").join(sums, "node", "left").join(labels, "node", "left")
                   .select("low", "high", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = stored(join_unique(named, least, ["label"]).select("low", "high", "n_links", "component_id"), "classes")
    joined = join_unique(stored(keyed.select("vec_id", "low", "high"), "keys"), classes, ["low", "high"], "inner").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
