"""Iterative fits that share their passes: many models, one scan of the data for each iteration.

The data hold a group (int) and a vector ``x`` of the group's length. Every open model belongs to a group; a
pass gives each model its weighted sums over the rows of its group. Sums are made per partition and, if they
are many, added up on executors, so what reaches the driver does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import from_matrix, to_matrix

DIRECT_BYTES = 64 << 20
#: Bytes of a packed block (an Arrow batch holds up to 10,000 of them) and of the rows that are worked on at once.
PACK_BYTES, STRIP_BYTES = 2 << 10, 256 << 10
SEED_ROWS = 4096
#: A pass over kept blocks has at least this many tasks for each core; one task reads at most so many partitions.
TASKS_PER_CORE, GATHERED = 2, 8
_BLOCK_SCHEMA = "g int, d int, x binary"
_SCHEMA = "run int, comp int, n double, value double, rows double, sx array<double>, sxx array<double>"

#: Weights of the rows of ``x`` for each component (rows by components), and a number to add up.
Assign = Callable[[np.ndarray], tuple[np.ndarray, float]]


@dataclass
class Sums:
    """Weighted sums of one model: by component weight, vectors and squares; the added number; rows."""

    n: np.ndarray
    sx: np.ndarray
    sxx: np.ndarray
    value: float = 0.0
    rows: float = 0.0


def grouped_vectors(df: DataFrame, vec: str, group: Column | None = None, *more: Column) -> DataFrame:
    """``g, x`` (and further columns) of the rows that have a vector and a group."""
    rows = df.select((F.lit(0) if group is None else group).cast("int").alias("g"), F.col(vec).cast("array<double>").alias("x"), *more)
    return rows.filter(F.col("x").isNotNull() & F.col("g").isNotNull())


def _blocks(g: int, x: np.ndarray) -> pa.RecordBatch:
    """Rows of a group as packed blocks."""
    step = max(1, PACK_BYTES // max(1, 8 * x.shape[1]))
    ends = np.append(np.arange(0, len(x), step), len(x)) * (8 * x.shape[1])
    blocks = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    n = len(blocks)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, g, np.int32)), pa.array(np.full(n, x.shape[1], np.int32)), blocks], names=["g", "d", "x"])


def packed(data: DataFrame, change: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``g, d, x`` of ``data`` (``g, x``): a few rows of a group, as wide as ``d``, end to end as binary doubles; ``change`` turns rows into others on the way.

    Passes over blocks neither take vectors apart nor build them anew, so a row costs little more than its arithmetic.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            for g in np.unique(groups).tolist():
                x = to_matrix(batch.column(1).filter(pa.array(groups == g)))[0]
                yield _blocks(g, x if change is None else change(x))

    return data.select("g", "x").mapInArrow(pack, _BLOCK_SCHEMA)


def mapped(blocks: DataFrame, change: Mapping[int, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Blocks of the rows that ``change`` makes of a group's rows; groups it does not name are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, x in (part for batch in batches for part in matrices(batch)):
            if g in change:
                yield _blocks(g, change[g](x))

    return blocks.mapInArrow(run, _BLOCK_SCHEMA)


def gathered(blocks: DataFrame) -> DataFrame:
    """Kept blocks with several partitions to a task (they are computed first, if they are not yet); nothing is shuffled or kept anew, other tables come back as they are.

    A task over a few megabytes costs its start, not its rows, and a fit has many passes. The number of tasks still
    follows that of the partitions.
    """
    if not blocks.storageLevel.useMemory:
        return blocks
    parts = blocks.rdd.getNumPartitions()
    fewer = max(TASKS_PER_CORE * blocks.sparkSession.sparkContext.defaultParallelism, -(-parts // GATHERED))
    return blocks.coalesce(fewer) if fewer < parts else blocks


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Group and rows of a batch of vectors or of packed blocks, a strip of bounded bytes at a time."""
    groups = batch.column(0).to_numpy(zero_copy_only=False)
    for g in np.unique(groups).tolist():
        mine = batch.filter(pa.array(groups == g)) if (groups != g).any() else batch
        if pa.types.is_list(mine.column(1).type):
            x = to_matrix(mine.column(1))[0]
        else:
            widths, blocks = mine.column(1).to_numpy(), mine.column(2).cast(pa.large_binary())
            if (widths != widths[0]).any():
                raise ValueError(f"vectors of unequal length: {widths.min()} to {widths.max()}")
            ends = np.frombuffer(blocks.buffers()[1], np.int64)[blocks.offset:blocks.offset + len(blocks) + 1]
            x = np.frombuffer(blocks.buffers()[2], np.float64, (ends[-1] - ends[0]) // 8, ends[0]).reshape(-1, widths[0]) if widths[0] else np.zeros((0, 0))
        step = max(1, STRIP_BYTES // max(1, 8 * x.shape[1]))
        for at in range(0, len(x), step):
            yield g, x[at:at + step]


def weighted_sums(data: DataFrame, models: Mapping[int, tuple[int, Assign]], shapes: Mapping[int, tuple[int, int]], parts: int, squares: bool = True) -> dict[int, Sums]:
    """One pass over vectors or :func:`packed` blocks: sums of every model (run -> group and assignment; ``shapes`` are components and width)."""
    by_group: dict[int, list[int]] = {}
    for run, (g, _) in models.items():
        by_group.setdefault(g, []).append(run)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for g, x in matrices(batch):
                if g not in by_group:
                    continue
                xx = x * x if squares else None
                for run in by_group[g]:
                    weight, value = models[run][1](x)
                    sx = weight.T @ x
                    part = [weight.sum(axis=0), sx, weight.T @ xx if squares else sx[:, :0], value, float(len(x))]
                    held[run] = part if run not in held else [a + b for a, b in zip(held[run], part)]
        for run, (n, sx, sxx, value, rows) in held.items():
            k, every = len(n), np.ones(len(n), bool)
            first = (np.arange(k) == 0).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, run, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(first * value), pa.array(first * rows),
                                              from_matrix(sx, every), from_matrix(sxx, every)], names=["run", "comp", "n", "value", "rows", "sx", "sxx"])

    stats = data.select(*_columns(data)).mapInArrow(body, _SCHEMA)
    if parts * sum(16 * shapes[run][0] * shapes[run][1] for run in models) > DIRECT_BYTES:
        def total(c: str) -> Column:
            return vector_to_array(Summarizer.sum(array_to_vector(c))).alias(c)

        stats = stats.groupBy("run", "comp").agg(F.sum("n").alias("n"), F.sum("value").alias("value"), F.sum("rows").alias("rows"),
                                                 total("sx"), total("sxx") if squares else F.array().cast("array<double>").alias("sxx"))
    got = stats.toArrow()
    run = got.column("run").to_numpy()
    out = {}
    for r in models:
        mine = got.filter(pa.array(run == r))
        k, width = shapes[r]
        sums = Sums(np.zeros(k), np.zeros((k, width)), np.zeros((k, width if squares else 0)))
        if mine.num_rows:
            comp = mine.column("comp").to_numpy()
            np.add.at(sums.n, comp, mine.column("n").to_numpy())
            np.add.at(sums.sx, comp, to_matrix(mine.column("sx"))[0])
            if squares:
                np.add.at(sums.sxx, comp, to_matrix(mine.column("sxx"))[0])
            sums.value, sums.rows = float(mine.column("value").to_numpy().sum()), float(mine.column("rows").to_numpy().sum())
        out[r] = sums
    return out


def drawn_rows(data: DataFrame, seed: int) -> dict[int, np.ndarray]:
    """A bounded draw over all rows of each group, wherever they lie: those of smallest random number, in one pass over vectors or blocks.

    Numbers go to rows, not to values, so copies are drawn as often as they occur.
    """
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, held = np.random.default_rng([seed, TaskContext.get().partitionId()]), {}
        for g, x in (part for batch in batches for part in matrices(batch)):
            u = rng.random(len(x))
            if g in held:
                near = u < held[g][0].max() if len(held[g][0]) == SEED_ROWS else np.ones(len(u), bool)
                u, x = np.concatenate([held[g][0], u[near]]), np.concatenate([held[g][1], x[near]])
            if len(u) > SEED_ROWS:
                least = np.argpartition(u, SEED_ROWS)[:SEED_ROWS]
                u, x = u[least], x[least]
            held[g] = u, np.array(x)
        for g, (u, x) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), g, np.int32)), pa.array(u), from_matrix(x, np.ones(len(u), bool))], names=["g", "u", "x"])

    drawn = data.select(*_columns(data)).mapInArrow(draw, "g int, u double, x array<double>")
    first = F.row_number().over(Window.partitionBy("g").orderBy("u"))
    got = drawn.withColumn("r", first).filter(F.col("r") <= SEED_ROWS).drop("r").toArrow().sort_by("u")
    return {g: to_matrix(got.filter(pc.equal(got["g"], g))["x"])[0] for g in sorted(pc.unique(got["g"]).to_pylist())}


@contextmanager
def kept_blocks(data: DataFrame, seed: int) -> Iterator[tuple[dict[int, np.ndarray], DataFrame]]:
    """The draw of :func:`drawn_rows` and the :func:`packed` blocks of ``data`` (vectors or blocks), persisted and :func:`gathered` for the passes of a fit.

    ``data`` is computed once: the draw comes from the blocks, and its pass fills the cache.
    """
    blocks = (data if "d" in data.columns else packed(data)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield drawn_rows(blocks, seed), gathered(blocks)
    finally:
        blocks.unpersist()


def block_sums(blocks: DataFrame, means: Mapping[int, np.ndarray] | None = None) -> dict[int, tuple[int, np.ndarray]]:
    """Rows and sum of each group of vectors or blocks or, with ``means``, rows and sum of centred outer products; one pass.

    Sums are made per partition and added up on executors.
    """
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for g, x in (part for batch in batches for part in matrices(batch)):
            z = x if means is None else x - means[g]
            part = [len(x), z.sum(axis=0)[None] if means is None else z.T @ z]
            held[g] = part if g not in held else [a + b for a, b in zip(held[g], part)]
        for g, (n, s) in held.items():
            i = np.arange(len(s), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), g, np.int32)), pa.array(i), pa.array(np.where(i == 0, n, 0)), from_matrix(s, np.ones(len(s), bool))], names=["g", "i", "n", "s"])

    parts = blocks.select(*_columns(blocks)).mapInArrow(body, "g int, i int, n long, s array<double>")
    total = parts.groupBy("g", "i").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    out: dict[int, tuple[int, list]] = {}
    for r in sorted(total.toArrow().to_pylist(), key=lambda r: (r["g"], r["i"])):
        n, rows = out.get(r["g"], (0, []))
        out[r["g"]] = n + r["n"], [*rows, r["s"]]
    return {g: (n, np.array(rows)) for g, (n, rows) in out.items()}


def _columns(data: DataFrame) -> list[str]:
    return [c for c in ("g", "d", "x") if c in data.columns]


def spread_seeds(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` seeds from a bounded draw of rows, each far from those before it."""
    picked = [rows[rng.integers(len(rows))]]
    gap = ((rows - picked[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = gap.sum()
        at = rng.choice(len(rows), p=gap / total) if total > 0 else rng.integers(len(rows))
        picked.append(rows[at])
        gap = np.minimum(gap, ((rows - rows[at]) ** 2).sum(axis=1))
    return np.array(picked)


def closest(centres: np.ndarray) -> Assign:
    """Each row to its closest centre, the lowest on ties; the number added up is the squared distance."""
    squares = (centres * centres).sum(axis=1)

    def assign(x: np.ndarray) -> tuple[np.ndarray, float]:
        gap = centres @ x.T  # components by rows: whole rows of the matrix are compared, not a few cells of each
        gap *= -2.0
        gap += squares[:, None]
        at = gap.argmin(axis=0)
        cost = np.maximum(gap.min(axis=0) + np.einsum("ij,ij->i", x, x), 0.0).sum()
        return (np.arange(len(centres))[:, None] == at).astype(np.float64).T, float(cost)

    return assign


def lloyd(data: DataFrame, seeds: Mapping[int, tuple[int, np.ndarray]], max_iter: int, tol: float, parts: int) -> dict[int, tuple[np.ndarray, int, bool]]:
    """Lloyd iterations of all runs (run -> group and centres), one pass for each until no centre of a run moves by ``tol``.

    Returns centres, iterations and whether the run settled. A centre without rows stays where it is.
    """
    out = {run: (centres, 0, False) for run, (_, centres) in seeds.items()}
    for step in range(1, max_iter + 1):
        going = {run: (seeds[run][0], closest(centres)) for run, (centres, _, still) in out.items() if not still}
        if not going:
            break
        sums = weighted_sums(data, going, {run: out[run][0].shape for run in going}, parts, squares=False)
        for run, s in sums.items():
            old = out[run][0]
            moved = np.where(s.n[:, None] > 0, s.sx / np.maximum(s.n, 1.0)[:, None], old)
            out[run] = (moved, step, bool(np.abs(moved - old).max() < tol))
    return out


def costs(data: DataFrame, centres: Mapping[int, tuple[int, np.ndarray]], parts: int) -> dict[int, float]:
    """Sum of squared distances to the closest centre, for all runs in one pass."""
    sums = weighted_sums(data, {run: (g, closest(c)) for run, (g, c) in centres.items()}, {run: c.shape for run, (_, c) in centres.items()}, parts, squares=False)
    return {run: s.value for run, s in sums.items()}
