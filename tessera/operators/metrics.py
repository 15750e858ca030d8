"""Cluster-quality, enrichment and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import seeded_hash
from tessera.functions.vectors import cosine, scatter
from tessera.operators.ordering import exclusive_sums, hash_buckets, rank_rows, take_first
from tessera.session import small_side
from tessera.operators.blocks import silhouettes
from tessera.operators.vectors import (centre_gaps, mean_vectors,
                                       own_distance)


def enrichment(assigned: DataFrame, clusters: Sequence[str], flags: Sequence[str],
               means: Sequence[str] = (), high: float = 2.0, k: int | None = None) -> DataFrame:
    """Outcome rates per cluster against the base rate of all records.

    ``assigned`` is one row per record with one cluster column per panel and the
    joined outcomes. It is turned to (panel, cluster) rows inside the aggregation,
    which is combined on the map side; base rates are sums over a panel's clusters,
    so the records are read once. With ``k`` every cluster id below it is listed.
    """
    panels = F.array(*[F.struct(F.lit(c).alias("panel"), F.col(c).cast("int").alias("cluster_id"))
                       for c in clusters])
    out = (assigned.select(F.explode(panels).alias("_cell"), *flags, *means)
           .select("_cell.*", *flags, *means).groupBy("panel", "cluster_id")
           .agg(F.count(F.lit(1)).alias("n"),
                *[F.count_if(F.col(f).eqNullSafe(F.lit(1))).alias(f"_{f}") for f in flags],
                *[F.avg(m).alias(f"mean_{m}") for m in means]))
    if k is not None:
        grid = assigned.sparkSession.createDataFrame([(c,) for c in clusters], "panel string").select(
            "panel", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cluster_id"))
        out = grid.join(out, ["panel", "cluster_id"], "left").fillna(0, subset=["n", *[f"_{f}" for f in flags]])
    whole = Window.partitionBy("panel")
    for f in flags:
        base = F.sum(f"_{f}").over(whole) / F.sum("n").over(whole)
        rate = F.when(F.col("n") > 0, F.col(f"_{f}") / F.col("n"))
        out = (out.withColumn(f"{f}_rate", rate).withColumn("_base", base)
               .withColumn(f"{f}_enrichment", F.when(F.col("_base") > 0, rate / F.col("_base")).otherwise(0.0)))
    ratios = [F.coalesce(F.col(f"{f}_enrichment"), F.lit(0.0)) for f in flags]
    top = ratios[0] if len(ratios) == 1 else F.greatest(*ratios)
    return (out.withColumn("flag", F.when(top >= high, "HIGH").otherwise(""))
            .drop("_base", *[f"_{f}" for f in flags]))


def contingency(df: DataFrame, cluster: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(cluster).alias("c"), F.col(label).alias("y")).agg(
        F.count(F.lit(1)).alias("n"))


def class_purity(df: DataFrame, cluster: str, label: str, k: int | None = None,
                 weighted: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Mean over clusters of the largest class share.

    Unweighted by default; with ``k`` empty clusters stay in the divisor.
    """
    per = contingency(df, cluster, label, by).groupBy(*by, "c").agg(
        F.max("n").alias("top"), F.sum("n").alias("size"))
    if weighted:
        value = F.sum("top") / F.sum("size")
    else:
        value = F.sum(F.col("top") / F.col("size")) / (F.lit(k) if k else F.count(F.lit(1)))
    return per.groupBy(*by).agg(value.alias("class_purity"))


def mutual_information(df: DataFrame, cluster: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Normalised mutual information, arithmetic mean of the entropies.

    The contingency table is summed to both marginals and the total by one cube, so
    with ``h(S) = sum n log n`` everything is one more aggregation over a few rows.
    """
    cells = contingency(df, cluster, label, by)
    sets = [[*by, "c", "y"], [*by, "c"], [*by, "y"], list(by)]
    cube = cells.groupingSets([[F.col(x) for x in s] for s in sets], *by, "c", "y").agg(
        F.sum("n").cast("double").alias("n"), F.grouping("c").alias("gc"), F.grouping("y").alias("gy"))
    h = F.col("n") * F.log("n")

    def part(gc: int, gy: int, col: Column) -> Column:
        return F.sum(F.when((F.col("gc") == gc) & (F.col("gy") == gy), col).otherwise(0.0))

    t = cube.groupBy(*by).agg(part(1, 1, F.col("n")).alias("n"), part(0, 0, h).alias("ij"),
                              part(0, 1, h).alias("i"), part(1, 0, h).alias("j"),
                              part(0, 1, F.lit(1.0)).alias("nc"), part(1, 0, F.lit(1.0)).alias("ny"))
    n, log_n = F.col("n"), F.log("n")
    mi = (F.col("ij") - F.col("i") - F.col("j")) / n + log_n
    mean_h = ((log_n - F.col("i") / n) + (log_n - F.col("j") / n)) / 2.0
    nmi = (F.when((F.col("nc") <= 1) & (F.col("ny") <= 1), 1.0)
           .when(mi <= 1e-12, 0.0).otherwise(mi / mean_h))
    return t.select(*by, nmi.alias("nmi"))


def intra_inter(df: DataFrame, cluster: str, vec: str, centres: DataFrame | None = None) -> DataFrame:
    """Mean distance to the own centre over mean distance between centres; one row."""
    centres = small_side(mean_vectors(df, [cluster], vec) if centres is None else centres)
    inter = centre_gaps(centres, cluster).select("inter_mean").scalar()
    intra = own_distance(df, vec, cluster, centres, "_d").agg(F.avg("_d").alias("intra_mean"))
    return (intra.withColumn("inter_mean", inter)
            .withColumn("intra_inter_ratio",
                        F.col("intra_mean") / F.greatest(F.col("inter_mean"), F.lit(1e-9))))


def silhouette(df: DataFrame, cluster: str, vec: str, row_id: str, sample: int | None = None,
               seed: int = 42) -> DataFrame:
    """Mean Euclidean silhouette over all rows, or over a seeded sample if one is asked for; one row."""
    rows = df.select(row_id, cluster, vec)
    drawn = rows if sample is None else seeded_sample(rows, row_id, sample, seed)
    return silhouettes(drawn, row_id, cluster, vec).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_squared(df: DataFrame, cluster: str, vec: str) -> float:
    """Squared-Euclidean silhouette of all rows from cluster sums; a different number."""
    data = df.select(F.col(cluster).cast("int").alias("prediction"),
                     array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(data)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """The first ``n`` rows (or all) in seeded random order.

    The order key of the n-th row is found from bucket counts; the rows are then
    filtered where they are, however large ``n`` is.
    """
    return take_first(hash_buckets(df, key, seed), [], F.lit(n))


def seeded_pairs(df: DataFrame, key: str, cluster: str, vec: str, n_pairs: int, seed: int) -> DataFrame:
    """``n_pairs`` row pairs drawn with replacement.

    Rows are numbered by the seeded order; each pair is two seeded numbers, matched
    by two equi-joins of the small pair table with the rows.
    """
    rows = rank_rows(hash_buckets(df.select(key, cluster, vec), key, seed), [], "_pos")
    total = F.lit(df.count())

    def draw(tag: str) -> Column:
        head = F.conv(F.substring(seeded_hash("pair", f"{seed}{tag}"), 1, 12), 16, 10).cast("long")
        return F.pmod(head, total) + 1

    pairs = (df.sparkSession.range(n_pairs).withColumnRenamed("id", "pair")
             .withColumn("_a", draw("a")).withColumn("_b", draw("b")))
    a = rows.select(F.col("_pos").alias("_a"), F.col(cluster).alias("cluster_a"), F.col(vec).alias("vec_a"))
    b = rows.select(F.col("_pos").alias("_b"), F.col(cluster).alias("cluster_b"), F.col(vec).alias("vec_b"))
    return pairs.join(a, "_a").join(b, "_b").drop("_a", "_b")


def pair_consistency(pairs: DataFrame, margin: float = 0.5) -> DataFrame:
    """Mean of ``1 - cos`` over equal-cluster and of ``relu(cos - margin)`` over other pairs."""
    sim = pairs.withColumn("_s", cosine("vec_a", "vec_b"))
    loss = F.when(F.col("cluster_a") == F.col("cluster_b"), 1.0 - F.col("_s")).otherwise(
        F.greatest(F.col("_s") - margin, F.lit(0.0)))
    return sim.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(loss).alias("loss"))


def _incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by Lentz's continued fraction, over arrays, for x below the turning point."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    f = d.copy()
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = np.ones_like(x)
        for coef in (even, odd):
            d = 1.0 / guard(1.0 + coef * d)
            c = guard(1.0 + coef / c)
            step = c * d
            f = f * step
        if (np.abs(step - 1.0) < 1e-15).all():
            break
    log_beta = np.array([lgamma(p + b) - lgamma(p) for p in np.unique(a)])[np.unique(a, return_inverse=True)[1]] - lgamma(b)
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.exp(log_beta + a * np.log(np.maximum(x, tiny)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) / a * f, 0.0)


@F.arrow_udf(T.DoubleType())
def pearson_p(r: pa.Array, n: pa.Array) -> pa.Array:
    """Two-sided p-value of a correlation, a whole batch at once; NULL below three pairs."""
    rs, ns = (c.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in (r, n))
    known = (ns >= 3) & np.isfinite(rs)
    a, x = (ns[known] - 2) / 2.0, np.maximum(0.0, 1.0 - rs[known] ** 2)
    near = x <= (a + 1.0) / (a + 2.5)
    p = np.empty(len(x))
    p[near] = _incomplete_beta(a[near], 0.5, x[near])
    # Beyond the turning point the mirrored fraction converges: I_x(a, b) = 1 - I_(1-x)(b, a).
    p[~near] = 1.0 - _mirrored_beta(a[~near], 1.0 - x[~near])
    return scatter(np.clip(p, 0.0, 1.0), known)


def _mirrored_beta(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``I_x(1/2, b)`` for arrays of ``b``, by the series of positive terms."""
    term, total = np.ones_like(x), np.ones_like(x)
    for i in range(1, 20_000):
        term = term * x * (0.5 + b + i - 1) / (0.5 + i)
        total = total + term
        if not len(x) or (term < 1e-17 * total).all():
            break
    log_front = np.array([lgamma(0.5 + v) - lgamma(v) for v in b]) - lgamma(0.5)
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.exp(log_front + 0.5 * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) * 2.0 * total, 0.0)


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation, number of complete pairs and p-value; NULL for a constant side."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                F.try_divide(F.covar_pop(x, y), spread).alias("r"))
    return out.withColumn("p_value", pearson_p("r", "n"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per-class precision, recall, F1 and support, with accuracy and averages.

    Rows are reduced to the confusion table first; the rest is over class counts.
    Undefined ratios are 0.
    """
    conf = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = conf.select(F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("prd"), hit.alias("tp")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("prd"),
                 F.lit(0).cast("long").alias("tp")))).alias("_cell")).select("_cell.*")
    per = (sides.groupBy("class").agg(F.sum("sup").alias("support"), F.sum("prd").alias("_prd"),
                                      F.sum("tp").alias("_tp"))
           .withColumn("precision", _ratio(F.col("_tp"), F.col("_prd")))
           .withColumn("recall", _ratio(F.col("_tp"), F.col("support")))
           .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"),
                                    F.col("precision") + F.col("recall"))))
    # One row per class: kept, so that the averages do not count the rows again.
    per = small_side(per)
    s = F.sum("support")
    acc = F.sum("_tp") / s
    total = per.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * F.col("support")) / s).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        acc.alias("acc"), s.alias("support"))
    rows = total.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.col("acc").alias("precision"),
                 F.col("acc").alias("recall"), F.col("acc").alias("f1"), "support"),
        F.struct(F.lit("macro avg").alias("class"), F.col("macro_precision").alias("precision"),
                 F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"), "support"),
        F.struct(F.lit("weighted avg").alias("class"), F.col("weighted_precision").alias("precision"),
                 F.col("weighted_recall").alias("recall"), F.col("weighted_f1").alias("f1"), "support"),
    )).alias("_cell")).select("_cell.*")
    cols = ["class", "precision", "recall", "f1", "support"]
    return per.select(*cols).unionByName(rows.select(*cols))


def one_vs_rest_auc(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """Exact ROC area per class (``scores``: class -> score column), ties counted half.

    Equal scores are merged first, then positives meet the number of negatives
    below them by bucketed running sums; no class is sorted in one task. The merged
    scores are scanned three times and stay persisted.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("class"), F.col(col).cast("double").alias("score"),
                               (F.col(truth).cast("string") == F.lit(c)).alias("hit"))
                      for c, col in scores.items()])
    merged = (df.select(F.explode(cells).alias("_cell")).select("_cell.*").groupBy("class", "score")
              .agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
              .persist(StorageLevel.MEMORY_AND_DISK))
    below = exclusive_sums(merged, ["class"], "score", ["neg"])
    won = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0))
    return below.groupBy("class").agg(
        F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), won / F.sum("pos") / F.sum("neg")).alias("auc"))


def macro_auc(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    return one_vs_rest_auc(df, truth, scores).agg(F.avg("auc").alias("macro_auc"))


def lift_over_chance(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy, chance ``1 / k`` and their difference, with the classes' base rates."""
    conf = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per = conf.groupBy("t").agg(F.sum("n").alias("n"),
                                F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("ok"))
    acc, chance = F.sum("ok") / F.sum("n"), 1.0 / F.count(F.lit(1))
    return per.agg(acc.alias("accuracy"), chance.alias("chance"), (acc - chance).alias("lift"),
                   (F.max("n") / F.sum("n")).alias("majority_rate"))


def compare_runs(left: DataFrame, right: DataFrame, keys: Sequence[str],
                 metrics: dict[str, bool], tie: float = 0.001) -> DataFrame:
    """Metric by metric difference of two runs; ``metrics`` says if higher is better."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot(list(keys), list(metrics), "metric", name)

    both = long(left, "left_value").join(long(right, "right_value"), [*keys, "metric"])
    delta = F.col("left_value") - F.col("right_value")
    up = F.col("metric").isin(*[m for m, higher in metrics.items() if higher])
    gain = F.when(up, delta).otherwise(-delta)
    return (both.filter(delta.isNotNull()).withColumn("delta", delta)
            .withColumn("better", F.when(gain > tie, "left").when(gain < -tie, "right").otherwise("tie")))


def against_baseline(results: DataFrame, variant: str, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """Baseline minus variant for every metric and every other variant."""
    base = results.filter(F.col(variant) == baseline).select(F.struct(*metrics)).scalar()
    return (results.filter(F.col(variant) != baseline)
            .select(variant, *[F.round(base.getField(m) - F.col(m), 4).alias(f"delta_{m}") for m in metrics]))


def separation_gap(df: DataFrame, group: str, first: str, second: str, score: str) -> DataFrame:
    """Difference of the mean scores of two groups."""
    return df.agg((F.avg(F.when(F.col(group) == first, F.col(score)))
                   - F.avg(F.when(F.col(group) == second, F.col(score)))).alias("gap"))


def reduction(df: DataFrame, kept: Column) -> DataFrame:
    """Rows before and after a filter and the reduction in percent."""
    return df.agg(F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after")).withColumn(
        "reduction_pct", 100.0 * (1.0 - F.try_divide("after", "before")))
