"""Mixture and k-means clustering of vector columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import append_position, from_matrix, l2_normalize, scatter, to_matrix, unit_rows
from tessera.functions.grid import grid_col, grid_row
from tessera.functions.hashing import seeded_pick
from tessera.operators.metrics import seeded_sample
from tessera.operators.moments import block_moments
from tessera.operators.passes import (Assign, Sums, closest, costs, drawn_rows, gathered, grouped_vectors, kept_blocks,
                                      lloyd, mapped, packed, spread_seeds, weighted_sums)
from tessera.operators.vectors import Projection, fit_projection, projection_of


@dataclass(frozen=True)
class DiagonalMixture:
    """Gaussian mixture with diagonal covariances."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    bound: float = float("nan")
    iterations: int = 0
    converged: bool = False

    @property
    def k(self) -> int:
        return len(self.weights)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, rows by components."""
        return self._joint(x).T

    def _joint(self, x: np.ndarray) -> np.ndarray:
        """The same, components by rows: maxima and sums over a few components run along whole rows of the matrix."""
        prec = 1.0 / self.variances
        const = np.log(2.0 * np.pi * self.variances).sum(axis=1) + (self.means ** 2 * prec).sum(axis=1)
        joint = (-0.5 * prec) @ (x * x).T
        joint += (self.means * prec) @ x.T
        joint += (np.log(self.weights) - 0.5 * const)[:, None]
        return joint

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self._joint(x)
        top = e.max(axis=0)
        e -= top
        np.exp(e, out=e)
        total = e.sum(axis=0)
        e /= total
        return e.T, top + np.log(total)

    def expectation(self) -> Assign:
        """Responsibilities of rows, and the sum of their log-likelihoods."""
        def soft(x: np.ndarray) -> tuple[np.ndarray, float]:
            weight, ll = self.responsibilities(x)
            return weight, float(ll.sum())

        return soft

    def membership(self, vec: str | Column) -> Column:
        """Posterior of every component, as an array."""
        @F.arrow_udf("array<double>")
        def soft(v: pa.Array) -> pa.Array:
            m, valid = to_matrix(v)
            return from_matrix(self.responsibilities(m)[0] if len(m) else m, valid)

        return soft(vec)

    def predict(self, vec: str | Column) -> Column:
        @F.arrow_udf("int")
        def hard(v: pa.Array) -> pa.Array:
            m, valid = to_matrix(v)
            best = self.log_joint(m).argmax(axis=1) if len(m) else np.zeros(0)
            return scatter(best.astype(np.int32), valid)

        return hard(vec)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(w), m.tolist(), v.tolist(), float(self.bound))
                for i, (w, m, v) in enumerate(zip(self.weights, self.means, self.variances))]
        return spark.createDataFrame(rows, "component int, weight double, mean array<double>, "
                                           "variance array<double>, bound double")

    @classmethod
    def from_frame(cls, df: DataFrame) -> DiagonalMixture:
        rows = df.orderBy("component").collect()
        return cls(np.array([r["weight"] for r in rows]), np.array([r["mean"] for r in rows]),
                   np.array([r["variance"] for r in rows]), rows[0]["bound"])


def _maximise(sums: Sums, floor: float) -> DiagonalMixture:
    n = sums.n + 10 * np.finfo(float).eps
    means = sums.sx / n[:, None]
    variances = np.maximum(sums.sxx / n[:, None] - means ** 2, 0.0) + floor
    return DiagonalMixture(n / n.sum(), means, variances)


def fit_mixtures(data: DataFrame, k: Mapping[int, int], *, n_init: int = 3, max_iter: int = 200, tol: float = 1e-3,
                 floor: float = 1e-6, lloyd_steps: int = 5, seed: int = 42) -> dict[int, DiagonalMixture]:
    """Diagonal Gaussian mixtures of all groups of ``data`` (``g, x``) by distributed expectation maximisation.

    ``data`` may also be packed blocks. Every iteration is one pass for all groups and restarts that are still open: executors compute responsibilities per Arrow batch
    and keep only weighted sums, ``k`` rows for each of them. Of a group's restarts the one
    with the best mean log-likelihood wins. Restarts begin from partitions around
    spread-out seeds, refined by a few shared k-means passes. Vectors of a group have one length.
    """
    with kept_blocks(data, seed) as (draw, blocks):
        parts = blocks.rdd.getNumPartitions()
        seeds = {g * n_init + r: (g, spread_seeds(draw[g], k[g], np.random.default_rng(seed + r))) for g in k for r in range(n_init)}
        shapes = {run: c.shape for run, (_, c) in seeds.items()}
        refined = lloyd(blocks, seeds, lloyd_steps, 1e-4, parts)
        hard = weighted_sums(blocks, {run: (seeds[run][0], closest(c)) for run, (c, _, _) in refined.items()}, shapes, parts)
        models = {run: _maximise(s, floor) for run, s in hard.items()}
        bounds, active = dict.fromkeys(seeds, -np.inf), list(seeds)
        for step in range(1, max_iter + 1):
            sums = weighted_sums(blocks, {run: (seeds[run][0], models[run].expectation()) for run in active}, shapes, parts)
            still = []
            for run in active:
                bound = sums[run].value / sums[run].rows
                new, settled = _maximise(sums[run], floor), bool(abs(bound - bounds[run]) < tol)
                models[run] = replace(new, bound=bound, iterations=step, converged=settled)
                if not settled:
                    still.append(run)
                bounds[run] = bound
            active = still
            if not active:
                break
    return {g: max((models[g * n_init + r] for r in range(n_init)), key=lambda m: m.bound) for g in k}


def fit_mixture(df: DataFrame, vec: str, k: int, *, row_id: str | None = None,
                fit_sample: int | None = None, seed: int = 42, **options) -> DiagonalMixture:
    """Diagonal Gaussian mixture of one table (see :func:`fit_mixtures`); ``fit_sample`` asks for a seeded sample."""
    rows = df if fit_sample is None else seeded_sample(df.select(row_id, vec), row_id, fit_sample, seed)
    return fit_mixtures(grouped_vectors(rows, vec), {0: k}, seed=seed, **options)[0]


def mixture_step(df: DataFrame, vec: str, mix: DiagonalMixture, floor: float = 1e-6) -> DiagonalMixture:
    """One expectation and maximisation step over all rows; ``bound`` is the mean log-likelihood before it."""
    data = grouped_vectors(df, vec)
    sums = weighted_sums(data, {0: (0, mix.expectation())}, {0: mix.means.shape}, data.rdd.getNumPartitions())[0]
    return replace(_maximise(sums, floor), bound=sums.value / sums.rows, iterations=mix.iterations + 1)


@dataclass(frozen=True)
class CentreFit:
    """Centres of a k-means fit, their cost over all rows, and whether the iterations settled."""

    centres: np.ndarray
    cost: float
    iterations: int
    converged: bool


def fit_centres(data: DataFrame, ks: Sequence[int], *, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, seed: int = 42) -> dict[int, CentreFit]:
    """k-means for every ``k`` with ``n_init`` seeds each, all in shared passes over ``data`` (``g, x``, one group).

    The fit of lowest cost over all rows is kept for each ``k``.
    """
    with kept_blocks(data, seed) as (draw, blocks):
        parts = blocks.rdd.getNumPartitions()
        seeds = {i * n_init + r: (0, spread_seeds(draw[0], k, np.random.default_rng(seed + r))) for i, k in enumerate(ks) for r in range(n_init)}
        found = lloyd(blocks, seeds, max_iter, tol, parts)
        cost = costs(blocks, {run: (0, c) for run, (c, _, _) in found.items()}, parts)
    best = {k: min(range(i * n_init, (i + 1) * n_init), key=cost.__getitem__) for i, k in enumerate(ks)}
    return {k: CentreFit(found[run][0], cost[run], *found[run][1:]) for k, run in best.items()}


def fit_kmeans(df: DataFrame, vec: str, k: int, seed: int = 42, n_init: int = 10, max_iter: int = 300) -> CentreFit:
    """k-means with the lowest cost over ``n_init`` seeds; all restarts share their passes."""
    return fit_centres(grouped_vectors(df, vec), [k], n_init=n_init, max_iter=max_iter, seed=seed)[k]


def batch_number(key: str, batches: int, seed: int | str) -> Column:
    """The mini-batch of a row, by the seeded digest of its key."""
    return seeded_pick(key, seed, batches)


def mini_batch_update(centres: np.ndarray, counts: np.ndarray, sums: Sums) -> tuple[np.ndarray, np.ndarray]:
    """Centres after one batch, each moved by its own learning rate (the batch's share of all rows it has seen), and new counts."""
    total = counts + sums.n
    rate = np.where(sums.n > 0, 1.0 / np.maximum(total, 1.0), 0.0)
    return centres + rate[:, None] * (sums.sx - sums.n[:, None] * centres), total


def mini_batch_step(df: DataFrame, vec: str, key: str, centres: np.ndarray, counts: np.ndarray, batch: int, batches: int, seed: int | str) -> tuple[np.ndarray, np.ndarray]:
    """One update of given centres from one batch of ``df``."""
    data = grouped_vectors(df.filter(batch_number(key, batches, seed) == batch), vec)
    sums = weighted_sums(data, {0: (0, closest(centres))}, {0: centres.shape}, data.rdd.getNumPartitions(), squares=False)[0]
    return mini_batch_update(centres, counts, sums)


def fit_mini_batch(df: DataFrame, vec: str, key: str, k: int, *, batch_rows: int = 4096, n_init: int = 10, max_iter: int = 300,
                   patience: int = 10, tol: float = 1e-4, seed: int = 42) -> CentreFit:
    """Mini-batch k-means: batches of about ``batch_rows`` rows drawn by the digest of ``key``, all restarts in one pass for each batch.

    Every centre moves by its own learning rate, one over the rows it has seen. A restart stops once its cost per row, smoothed
    over batches, has not fallen by a share of ``tol`` for ``patience`` batches, or after ``max_iter`` rounds of all
    batches. The restart of lowest cost over all rows wins. Rows lie sorted by batch in the cache, so a batch reads little else.
    """
    rows = df.filter(F.col(vec).isNotNull() & F.col(key).isNotNull())
    count = rows.count()
    batches = max(1, -(-count // batch_rows))
    dealt = grouped_vectors(rows, vec, None, batch_number(key, batches, seed).alias("b"))
    data = (dealt.repartitionByRange("b").sortWithinPartitions("b") if batches > 1 else dealt).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        parts, draw = data.rdd.getNumPartitions(), drawn_rows(data, seed)[0]
        state = {r: (spread_seeds(draw, k, np.random.default_rng(seed + r)), np.zeros(k)) for r in range(n_init)}
        shapes = {r: c.shape for r, (c, _) in state.items()}
        smooth, lowest, waited, steps = {}, dict.fromkeys(state, np.inf), dict.fromkeys(state, 0), dict.fromkeys(state, 0)
        share = min(1.0, 2.0 * batch_rows / (count + 1))
        order = np.random.default_rng(seed)
        active = list(state)
        for _ in range(max_iter):
            for b in order.permutation(batches).tolist():
                if not active:
                    break
                part = data.filter(F.col("b") == b)
                for r, s in weighted_sums(part, {r: (0, closest(state[r][0])) for r in active}, shapes, parts, squares=False).items():
                    if s.rows == 0:
                        continue
                    state[r] = mini_batch_update(*state[r], s)
                    cost = s.value / s.rows
                    smooth[r] = cost if r not in smooth else share * cost + (1 - share) * smooth[r]
                    waited[r] = 0 if smooth[r] < lowest[r] * (1 - tol) else waited[r] + 1
                    lowest[r], steps[r] = min(lowest[r], smooth[r]), steps[r] + 1
                active = [r for r in active if waited[r] < patience]
        cost = costs(data, {r: (0, c) for r, (c, _) in state.items()}, parts)
        best = min(cost, key=cost.__getitem__)
        return CentreFit(state[best][0], cost[best], steps[best], best not in active)
    finally:
        data.unpersist()


def nearest_centre(centres: np.ndarray, vec: str | Column) -> Column:
    """Index of the closest centre, the lowest on ties."""
    @F.arrow_udf("int")
    def closest(v: pa.Array) -> pa.Array:
        m, valid = to_matrix(v)
        d = (centres * centres).sum(axis=1) - 2.0 * (m @ centres.T) if len(m) else np.zeros((0, 1))
        return scatter(d.argmin(axis=1).astype(np.int32) if len(m) else np.zeros(0, np.int32), valid)

    return closest(vec)


@dataclass(frozen=True)
class FeaturePrep:
    """Normalise, project, optionally append the grid position: fitted chain."""

    projection: Projection | None
    grid: int | None = None
    weight: float = 0.4

    def apply(self, vec: str | Column, patch: str | None = None) -> Column:
        out = l2_normalize(vec)
        if self.projection is not None:
            out = self.projection.apply(out)
        if self.grid is not None and patch is not None:
            out = append_position(out, grid_row(patch, self.grid), grid_col(patch, self.grid),
                                  self.grid, self.weight)
        return out


def fit_prep(df: DataFrame, vec: str, dims: int | None, grid: int | None = None,
             weight: float = 0.4) -> FeaturePrep:
    if dims is None:
        return FeaturePrep(None, grid, weight)
    units = df.select(l2_normalize(vec).alias("_u"))
    return FeaturePrep(fit_projection(units, "_u", dims), grid, weight)


PanelModel = tuple[FeaturePrep, DiagonalMixture]


def fit_panel(rows: DataFrame, vec: str, width: int, k: int, *, dims: int = 50, row_id: str | None = None,
              fit_sample: int | None = None, n_init: int = 3, max_iter: int = 200, seed: int = 42) -> PanelModel:
    """Projection to at most ``width - 1`` dimensions and mixture of one panel's vectors."""
    prep = fit_prep(rows, vec, min(dims, max(1, width - 1)))
    ready = rows.withColumn("_x", prep.apply(vec))
    return prep, fit_mixture(ready, "_x", k, row_id=row_id, fit_sample=fit_sample, n_init=n_init,
                             max_iter=max_iter, seed=seed)


def fit_panels(long: DataFrame, panel: str, vec: str, widths: dict[str, int], k: int, *, dims: int = 50, row_id: str | None = None,
               fit_sample: int | None = None, seed: int = 42, **options) -> dict[str, PanelModel]:
    """One model per panel (``widths``: panel -> vector length), as :func:`fit_panel` would fit it, in passes that all panels share.

    Moments of all panels come from one pair of passes, and every iteration of the mixtures is one pass
    for all panels and restarts, though their vectors differ in length.
    """
    names = list(widths)
    rows = long.filter(F.col(panel).isin(names))
    if fit_sample is not None:
        kept = [seeded_sample(rows.filter(F.col(panel) == p), row_id, fit_sample, seed) for p in names]
        rows = reduce(DataFrame.unionByName, kept)
    number = F.coalesce(*[F.when(F.col(panel) == p, i) for i, p in enumerate(names)])
    units = packed(grouped_vectors(rows, vec, number), unit_rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        preps = {i: FeaturePrep(projection_of(m, min(dims, max(1, widths[names[i]] - 1)))) for i, m in block_moments(units).items()}
        found = fit_mixtures(mapped(gathered(units), {i: p.projection.rows for i, p in preps.items()}), {i: k for i in preps}, seed=seed, **options)
        return {p: (preps[i], found[i]) for i, p in enumerate(names) if i in preps}
    finally:
        units.unpersist()


def assign_panels(long: DataFrame, panel: str, vec: str,
                  models: dict[str, PanelModel]) -> DataFrame:
    """Membership array and cluster of each (entity, panel) row."""
    # Panels differ in width: each model sees NULL for the rows of other panels.
    parts = [mix.membership(prep.apply(F.when(F.col(panel) == p, F.col(vec))))
             for p, (prep, mix) in models.items()]
    out = long.withColumn("membership", F.coalesce(*parts))
    return out.withColumn("cluster_id", (F.array_position(
        "membership", F.array_max("membership")) - 1).cast("int"))


def save_mixture(spark: SparkSession, path: str, prep: FeaturePrep, mix: DiagonalMixture) -> None:
    """Model parameters as parquet tables under a new path."""
    mix.to_frame(spark).coalesce(1).write.parquet(f"{path}/mixture")
    meta = [(prep.projection is not None, prep.grid, float(prep.weight))]
    spark.createDataFrame(meta, "projected boolean, grid int, weight double").write.parquet(f"{path}/prep")
    if prep.projection is not None:
        prep.projection.to_frame(spark).coalesce(1).write.parquet(f"{path}/projection")


def load_mixture(spark: SparkSession, path: str) -> tuple[FeaturePrep, DiagonalMixture]:
    meta = spark.read.parquet(f"{path}/prep").first()
    proj = Projection.from_frame(spark.read.parquet(f"{path}/projection")) if meta["projected"] else None
    return (FeaturePrep(proj, meta["grid"], meta["weight"]),
            DiagonalMixture.from_frame(spark.read.parquet(f"{path}/mixture")))
