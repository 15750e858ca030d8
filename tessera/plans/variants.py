"""Ablation over clustering variants and the search for the number of clusters."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.blocks import silhouettes_of
from tessera.operators.clustering import fit_centres, fit_mixture, fit_prep, nearest_centre
from tessera.operators.metrics import (class_purity, intra_inter, mutual_information, seeded_sample,
                                       silhouette)
from tessera.sources.sinks import upsert, write_table


@dataclass(frozen=True)
class Variant:
    """One ablation setting: a vector expression, a row filter and the clustering."""

    name: str
    vector: Column
    keep: Column | None = None
    k: int = 30
    dims: int | None = 128
    grid: int | None = None
    weight: float = 0.4


def run_variant(df: DataFrame, v: Variant, row_id: str, label: str, patch: str | None = None, *,
                fit_sample: int | None = None, silhouette_sample: int | None = None, n_init: int = 3,
                max_iter: int = 200, seed: int = 42) -> DataFrame:
    """Cluster one variant and measure it; one row of metrics.

    The assignment is computed once and kept for the four metrics. ``converged`` tells whether the mixture's bound settled.
    """
    rows = df if v.keep is None else df.filter(v.keep)
    rows = rows.withColumn("_vec", v.vector)
    prep = fit_prep(rows, "_vec", v.dims, v.grid, v.weight)
    ready = rows.select(row_id, label, prep.apply("_vec", patch).alias("x"))
    mix = fit_mixture(ready, "x", v.k, row_id=row_id, fit_sample=fit_sample, n_init=n_init,
                      max_iter=max_iter, seed=seed)
    assigned = ready.withColumn("cluster_id", mix.predict("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        values: dict[str, object] = {}
        for part in (silhouette(assigned, "cluster_id", "x", row_id, silhouette_sample, seed),
                     class_purity(assigned, "cluster_id", label, v.k),
                     mutual_information(assigned, "cluster_id", label),
                     intra_inter(assigned, "cluster_id", "x"),
                     assigned.agg(F.count(F.lit(1)).alias("n_patches"))):
            values.update(part.first().asDict())
    finally:
        assigned.unpersist()
    order = ["silhouette", "class_purity", "nmi", "intra_mean", "inter_mean", "intra_inter_ratio"]
    row = (v.name, *[round(float(values[m]), 4) for m in order], int(values["n_patches"]), v.k, bool(mix.converged))
    return df.sparkSession.createDataFrame([row], ", ".join(
        ["variant string", *[f"{m} double" for m in order], "n_patches long", "n_clusters int", "converged boolean"]))


def run_variants(df: DataFrame, variants: Sequence[Variant], row_id: str, label: str,
                 patch: str | None = None, **options) -> DataFrame:
    """Metrics of all variants, one row each. Each fit uses the whole cluster."""
    out = None
    for v in variants:
        row = run_variant(df, v, row_id, label, patch, **options)
        out = row if out is None else out.unionByName(row)
    return out


def variant_grid(spark: SparkSession, variants: Sequence[str], **parameters: Sequence) -> DataFrame:
    """``key, variant`` and one column per parameter: every combination of the listed settings, a row each.

    The lists are part of the experiment's configuration. ``key`` names the combination and is what results are stored under.
    """
    names = ["variant", *parameters]
    rows = [(";".join(f"{n}={v}" for n, v in zip(names, combination)), *combination) for combination in itertools.product(variants, *parameters.values())]
    return spark.createDataFrame(rows, ["key", *names])


def open_cells(grid: DataFrame, done: DataFrame | None) -> DataFrame:
    """Rows of the grid whose key has no result yet."""
    return grid if done is None else grid.join(done.select("key"), "key", "left_anti")


def run_grid(df: DataFrame, grid: DataFrame, variants: Mapping[str, Variant], path: str, row_id: str, label: str,
             patch: str | None = None, **options) -> DataFrame:
    """Results of every cell of ``grid``, kept under ``path`` so that a rerun fits only what is missing.

    A cell is the variant of its name with the row's ``k``, ``dims`` and ``weight`` where the grid has them. Each result is upserted by
    key into a new version of the table as soon as it is there; the newest complete version counts, so a run that stops in between
    loses the cell it was at and no other.
    """
    spark = df.sparkSession
    done, version = stored_results(spark, path)
    for cell in open_cells(grid, done).orderBy("key").collect():  # a configuration's rows, not data
        own = {n: cell[n] for n in ("k", "dims", "weight") if n in grid.columns}
        row = run_variant(df, replace(variants[cell["variant"]], **own), row_id, label, patch, **options).withColumn("key", F.lit(cell["key"]))
        whole = row if done is None else upsert(done, row, "key")
        version += 1
        place = f"{path}/version={version}/{uuid.uuid4().hex}"
        write_table(whole.coalesce(1), place)  # one file, which appears as a whole
        done = spark.read.parquet(place)
    return grid.select("key") if done is None else done.join(grid.select("key"), "key", "left_semi")


def stored_results(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The newest complete version of a result table and its number; none and 0 if there is none."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        number = F.regexp_extract("path", r"/version=(\d+)/[^/]+/[^/]+$", 1)
        newest = files.filter(number != "").agg(F.max(F.struct(number.cast("int").alias("version"), "path")).alias("f")).first()["f"]
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None, 0
        raise
    return (None, 0) if newest is None else (spark.read.parquet(newest["path"]), newest["version"])


def k_sweep(df: DataFrame, vec: str, row_id: str, ks: Sequence[int], *, sample: int | None = None,
            n_init: int = 10, max_iter: int = 300, seed: int = 42) -> DataFrame:
    """Cost and silhouette (of all rows or a seeded sample) for each number of clusters, with a quality band.

    All numbers and restarts share their passes: one scan of the rows for each iteration, and one computation of distances for all
    silhouettes. Each ``k`` has the lowest cost over ``n_init`` seeds; ``converged`` tells whether that fit settled within
    ``max_iter``. ``best`` marks the first ``k`` with the highest silhouette.
    """
    data = df.select(row_id, F.col(vec).cast("array<double>").alias("x")).filter(F.col("x").isNotNull()).withColumn("g", F.lit(0)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits = fit_centres(data, ks, n_init=n_init, max_iter=max_iter, seed=seed)
        drawn = data if sample is None else seeded_sample(data, row_id, sample, seed)
        labelled = drawn.select(row_id, "x", *[nearest_centre(fits[k].centres, "x").alias(f"k{k}") for k in ks]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            groups = labelled.agg(*[F.count_distinct(f"k{k}").alias(f"k{k}") for k in ks]).first()
            means = silhouettes_of(labelled, row_id, [f"k{k}" for k in ks], "x").groupBy("labelling").agg(F.avg("silhouette").alias("s")).collect()
        finally:
            labelled.unpersist()
    finally:
        data.unpersist()
    mean = {r["labelling"]: r["s"] for r in means}
    rows = []
    for k in ks:
        sil = mean[f"k{k}"] if groups[f"k{k}"] > 1 else -1.0
        rows.append((k, float(fits[k].cost), float(sil), "good" if sil > 0.25 else "fair" if sil > 0.15 else "weak", fits[k].converged))
    top = max(r[2] for r in rows)
    best = next(r[0] for r in rows if r[2] == top)
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows],
                                           "k int, inertia double, silhouette double, quality string, converged boolean, best boolean")
