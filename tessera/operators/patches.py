"""Attention, foreground and grid operators on sub-vectors of images."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.grid import grid_col, grid_row
from tessera.functions.vectors import scatter, segment_sums, to_matrix, to_segments
from tessera.session import checkpoint

# Names of the gate's verdicts, in the order of the checks.
REASONS = ("high_entropy_uniform", "low_max_over_mean", "low_peakiness", "low_fg_ratio", "ok")

STATS = "struct<fg_ratio:double,peakiness:double,entropy:double,max_over_mean:double>"


def attention_stats(frac: float = 0.2):
    """Column function: quality measures of an attention map.

    Share of cells at or above ``frac`` of the maximum; relative gap of maximum and
    lower median; entropy of the softmax relative to the uniform one; maximum over
    mean. Maps without signal give 0.
    """
    @F.arrow_udf(STATS)
    def stats(maps: pa.Array) -> pa.Array:
        m, valid = to_matrix(maps)
        if len(m) == 0:
            zero = scatter(np.zeros(0), valid)
            return pa.StructArray.from_arrays([zero] * 4, names=["fg_ratio", "peakiness", "entropy", "max_over_mean"])
        n = m.shape[1]
        top, mean = m.max(axis=1), m.mean(axis=1)
        fg = (m >= (frac * np.maximum(top, 1e-12))[:, None]).mean(axis=1)
        median = np.partition(m, (n - 1) // 2, axis=1)[:, (n - 1) // 2]
        live = top > 1e-12
        peak = np.where(live, (top - median) / np.where(live, top, 1.0), 0.0)
        e = np.exp(m - top[:, None])
        p = np.maximum(e / e.sum(axis=1, keepdims=True), 1e-12)
        entropy = -(p * np.log(p)).sum(axis=1) / (np.log(n) if n > 1 else 1.0)
        some = mean > 1e-12
        ratio = np.where(some, top / np.where(some, mean, 1.0), 0.0)
        return pa.StructArray.from_arrays(
            [scatter(x, valid) for x in (fg, peak, entropy, ratio)],
            names=["fg_ratio", "peakiness", "entropy", "max_over_mean"])

    return stats


def quality_score(stats: Column) -> Column:
    """Product of foreground share, peakiness and (1 - entropy), never negative."""
    return (stats.getField("fg_ratio") * stats.getField("peakiness")
            * F.greatest(F.lit(0.0), F.lit(1.0) - stats.getField("entropy")))


def gate_reason(stats: Column, max_entropy: float, min_max_over_mean: float,
                min_peakiness: float, min_fg_ratio: float) -> Column:
    """First failing check, or ``ok``."""
    return (F.when(stats.getField("entropy") > max_entropy, REASONS[0])
            .when(stats.getField("max_over_mean") < min_max_over_mean, REASONS[1])
            .when(stats.getField("peakiness") < min_peakiness, REASONS[2])
            .when(stats.getField("fg_ratio") < min_fg_ratio, REASONS[3]).otherwise(REASONS[4]))


def fraction_above(threshold: float, inclusive: bool = False):
    """Column function: share of a mask array above (or at) a threshold; masks may differ in size, an empty one has share 0."""
    @F.arrow_udf("double")
    def share(mask: pa.Array) -> pa.Array:
        flat, sizes, valid = to_segments(mask)
        hit = flat >= threshold if inclusive else flat > threshold
        return scatter(segment_sums(hit.astype(np.float64), sizes) / np.maximum(sizes, 1), valid)

    return share


def foreground_patches(df: DataFrame, image: str, patch: str, attn: str, q: float | None,
                       min_keep: int = 10, inclusive: bool = False) -> DataFrame:
    """Keep the patches whose attention exceeds the quantile of their image.

    If fewer than ``min_keep`` remain, the best ``max(min_keep, n // 4)`` are kept. An
    image has at most one row per grid cell, so a window per image is bounded; all
    windows share one shuffle.
    """
    if q is None:
        return df
    w = Window.partitionBy(image)
    d = df.withColumn("_thr", F.percentile(attn, q).over(w))
    over = F.col(attn) >= F.col("_thr") if inclusive else F.col(attn) > F.col("_thr")
    d = (d.withColumn("_over", over)
         .withColumn("_kept", F.sum(F.col("_over").cast("int")).over(w))
         .withColumn("_n", F.count(F.lit(1)).over(w))
         .withColumn("_rank", F.row_number().over(w.orderBy(F.col(attn).desc(), patch))))
    keep = F.when(F.col("_kept") >= min_keep, F.col("_over")).otherwise(
        F.col("_rank") <= F.greatest(F.lit(min_keep), F.floor(F.col("_n") / 4)))
    return d.filter(keep).drop("_thr", "_over", "_kept", "_n", "_rank")


def head_mean(df: DataFrame, keys: Sequence[str], attn: str) -> DataFrame:
    """Attention averaged over heads for each (entity, position)."""
    return df.groupBy(*keys).agg(F.avg(attn).alias(attn))


def patch_quality(pixels: DataFrame, image: str, patch: str, value: str, scale: float = 255.0) -> DataFrame:
    """Mean brightness (0..1) and population spread of the pixels of each patch."""
    return pixels.groupBy(image, patch).agg(
        (F.avg(value) / scale).alias("brightness"), F.stddev_pop(value).alias("variance"))


def _vote_once(df: DataFrame, image: str, label: str, grid: int, share: float, mode: str) -> DataFrame:
    """One synchronous vote of all neighbours; rows are already grouped by image."""
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"))
                      for dr, dc in product((-1, 0, 1), repeat=2)])
    votes = (df.select(image, "_r", "_c", label, "_orig", F.explode(steps).alias("s"))
             .select(image, (F.col("_r") + F.col("s.dr")).alias("_r"),
                     (F.col("_c") + F.col("s.dc")).alias("_c"), F.col(label).alias("_vote"),
                     ((F.col("s.dr") == 0) & (F.col("s.dc") == 0)).alias("_self"), "_orig")
             .filter(F.col("_r").between(0, grid - 1) & F.col("_c").between(0, grid - 1)))
    per_label = votes.groupBy(image, "_r", "_c", "_vote").agg(
        F.count_if(~F.col("_self")).alias("_n"), F.bool_or("_self").alias("_own"),
        F.max(F.when(F.col("_self"), F.col("_orig"))).alias("_orig"))
    # Highest count first, lowest label on ties; the cell's own label does not compete.
    ballot = F.struct(F.col("_n").alias("n"), (-F.col("_vote")).alias("neg"))
    cell = per_label.groupBy(image, "_r", "_c").agg(
        F.max(F.when(F.col("_own"), F.col("_vote"))).alias("_old"),
        F.max(F.when(~F.col("_own"), ballot)).alias("_best"),
        F.sum(F.when(~F.col("_own"), F.col("_n")).otherwise(0)).alias("_differ"),
        F.sum("_n").alias("_all"), F.max("_orig").alias("_orig"))
    need = F.col("_differ") if mode == "reference" else F.col("_all")
    flips = F.col("_best").isNotNull() & (F.col("_best.n") >= need * F.lit(share))
    return (cell.filter(F.col("_old").isNotNull())
            .withColumn(label, F.when(flips, -F.col("_best.neg")).otherwise(F.col("_old")))
            .select(image, "_r", "_c", label, "_orig"))


def smooth_labels(df: DataFrame, image: str, patch: str, label: str, grid: int = 28,
                  n_iter: int = 1, share: float = 0.67, mode: str = "reference",
                  checkpoint_every: int = 5) -> DataFrame:
    """Majority smoothing of cluster labels on each image's grid.

    A patch takes the most frequent label among its neighbours with a different
    label when that label reaches ``share`` of them (``mode='reference'``) or of all
    its neighbours (``mode='majority'``). Patches are moved once to the task of their
    image (at most ``grid ** 2`` rows each); voting and counting then stay there for
    all iterations. Returns image, patch, label and ``smoothed``.
    """
    state = (df.select(image, F.col(patch).alias("_p"), F.col(label).cast("int").alias("smoothed"),
                       F.col(label).cast("int").alias("_orig"))
             .repartition(image)
             .withColumn("_r", grid_row("_p", grid)).withColumn("_c", grid_col("_p", grid)).drop("_p"))
    for i in range(n_iter):
        state = _vote_once(state, image, "smoothed", grid, share, mode)
        if (i + 1) % checkpoint_every == 0 and i + 1 < n_iter:
            state = checkpoint(state)
    return state.select(image, (F.col("_r") * grid + F.col("_c")).cast("int").alias(patch),
                        F.col("_orig").alias(label), "smoothed")


def part_map(df: DataFrame, image: str, patch: str, label: str, grid: int) -> DataFrame:
    """One row per image and grid row with the labels as columns; gaps stay NULL."""
    return (df.select(image, grid_row(patch, grid).alias("grid_row"),
                      grid_col(patch, grid).alias("_c"), label)
            .groupBy(image, "grid_row")
            .agg(*[F.max(F.when(F.col("_c") == c, F.col(label))).alias(f"c{c}") for c in range(grid)]))


def gate_report(df: DataFrame, by: Sequence[str], kept: str = "kept", passed: str = "passed") -> DataFrame:
    """Raw, gated and kept counts per group, with totals at every level."""
    return df.rollup(*by).agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(F.col(passed)).alias("pool"),
        F.count_if(~F.col(passed)).alias("rejected"), F.count_if(F.col(kept)).alias("kept"))
