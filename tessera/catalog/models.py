"""Queries that fit models; their SQL states what holds for every right fit."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.fixtures import FEATURES, GRID, PANELS, RANGES, lab, outcome_of, patches, sql, table, with_outcomes
from tessera.catalog.records import _scratch
from tessera.catalog.subvectors import CONCEPTS, _scores
from tessera.functions.bands import three_class_outcome
from tessera.functions.vectors import euclidean, last_block
from tessera.operators import classify, metrics
from tessera.operators.clustering import (assign_panels, fit_kmeans, fit_mixture, fit_panels, fit_prep,
                                          load_mixture, mixture_step, nearest_centre, save_mixture)
from tessera.operators.concepts import cube_rows
from tessera.operators.sampling import stratified_split
from tessera.operators.vectors import fit_projection, mean_vectors, model_column
from tessera.plans.records import RecordScorer, deviation_table, fit_scorer
from tessera.plans.variants import Variant, k_sweep, run_variants

CLASSES = ("first", "second", "neither")


@query("pca_embed")
def pca_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows projected to 8 dimensions and normalised; ``pca_components`` checks the projection."""
    p = patches(spark, sf)
    return p.select("vec_id", fit_projection(p, "f", 8).apply("f").alias("x"))


@query("feature_prep")
def feature_prep(spark: SparkSession, sf: str) -> DataFrame:
    """Normalise, project to 8 dimensions, append the grid position, normalise; ``feature_cosines`` checks the chain."""
    p = patches(spark, sf)
    return p.select("vec_id", fit_prep(p, "f", 8, GRID, 0.4).apply("f", "patch_id").alias("x"))


@query("kmeans_fit", "SELECT cast(range AS int) AS cluster_id, true AS settled FROM range(6)")
def kmeans_fit(spark: SparkSession, sf: str) -> DataFrame:
    """At the end each centre is the mean of its rows."""
    p = patches(spark, sf)
    model = fit_kmeans(p, "f", 6)
    centres = model.centres
    means = mean_vectors(p.withColumn("cluster_id", nearest_centre(centres, "f")), ["cluster_id"], "f")
    held = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster_id int, centre array<double>")
    return means.join(held, "cluster_id").select("cluster_id", (euclidean("vector", "centre") < 0.02).alias("settled"))


@query("gmm_fit", "SELECT true AS converged, true AS settled, count(*) AS n FROM embeddings")
def gmm_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The bound has settled: one more step raises it by less than the tolerance."""
    p = patches(spark, sf)
    prep = fit_prep(p, "f", 8)
    x = p.select("vec_id", prep.apply("f").alias("x"))
    mix = fit_mixture(x, "x", 5)
    gain = mixture_step(x, "x", mix).bound - mix.bound
    return x.withColumn("cluster_id", mix.predict("x")).filter("cluster_id between 0 and 4").agg(
        F.lit(mix.converged).alias("converged"), F.lit(bool(-1e-9 < gain < 1e-3)).alias("settled"), F.count(F.lit(1)).alias("n"))


def _panel_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cube_rows(deviation_table(lab(spark, sf), FEATURES, RANGES, 0.5), "record_id", PANELS)


@query("panel_gmm")
def panel_gmm(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of both panels, their sizes, and whether the fit settled; ``panel_mixtures`` checks the fits."""
    long = _panel_rows(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    models = fit_panels(long, "panel", "vector", {p: len(fs) for p, fs in PANELS.items()}, 4)
    settled = F.coalesce(*[F.when(F.col("panel") == p, F.lit(mix.converged)) for p, (_, mix) in models.items()])
    return (assign_panels(long, "panel", "vector", models).groupBy("panel", "cluster_id")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_max("membership")).alias("mean_membership")).withColumn("converged", settled))


@query("logreg_fit")
def logreg_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome from deviations: split, fit on the training part, report on the test part."""
    known = with_outcomes(spark, sf, deviation_table(lab(spark, sf), FEATURES, RANGES, 0.5))
    rows = known.select("record_id", "cycle_year", *FEATURES, three_class_outcome("diq", "bpq").alias("y")).filter("y >= 0")
    data = stratified_split(rows.persist(StorageLevel.MEMORY_AND_DISK), "y", "record_id", 42)
    model = classify.fit_linear(data.filter(~F.col("is_test")), "y", FEATURES, CLASSES, balanced=True, standardize=True)
    names = F.array(*[F.lit(c) for c in CLASSES])
    scored = model.score(data.filter("is_test")).withColumn("truth", names[F.col("y")])
    return metrics.classification_report(scored, "truth", "prediction")


@query("one_vs_rest_one_class")
def one_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    """Raw-vector baseline: projection, then one scorer per class, highest score wins."""
    p = patches(spark, sf).withColumn("cls", (F.col("label") % 3).cast("string"))
    x = p.select("vec_id", "cls", fit_projection(p, "f", 6).apply("f", normalize=False).alias("x"))
    cols = [f"x{i}" for i in range(6)]
    wide = x.select("vec_id", "cls", *[F.col("x")[i].alias(c) for i, c in enumerate(cols)])
    split = stratified_split(wide, "cls", "vec_id", 42)
    out = classify.one_vs_rest_one_class(split.filter("not is_test"), split.filter("is_test"), "cls", cols, ["0", "1", "2"])
    return metrics.classification_report(out, "cls", "predicted")


@query("k_sweep")
def sweep(spark: SparkSession, sf: str) -> DataFrame:
    return k_sweep(patches(spark, sf), "f", "vec_id", [2, 4, 6])


@query("ablation")
def ablation(spark: SparkSession, sf: str) -> DataFrame:
    """All layers, the last layer alone, and all layers with the grid position."""
    f = F.col("f")
    variants = [Variant("A", f, k=5, dims=8), Variant("B", last_block("f", 16), k=5, dims=8),
                Variant("C", f, keep=F.col("patch_id") != 12, k=5, dims=8, grid=GRID)]
    return run_variants(patches(spark, sf), variants, "vec_id", "label", "patch_id")


@query("variant_correlation")
def variant_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of silhouette and purity over the ablation's variants."""
    return metrics.pearson(ablation(spark, sf), "silhouette", "class_purity")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """The record table and the customer of each record, kept: it is scanned to fit, to learn outcomes and to be scored."""
    return lab(spark, sf, F.col("_c").cast("long").alias("custkey")).persist(StorageLevel.MEMORY_AND_DISK)


def _scorer(spark: SparkSession, sf: str, records: DataFrame) -> RecordScorer:
    y = outcome_of(table(spark, sf, "customer")).select("custkey", three_class_outcome("diq", "bpq").alias("label")).filter("label >= 0")
    return fit_scorer(records, PANELS, RANGES, 3, min_ratio=0.5, outcome=y, outcome_on="custkey", classes=CLASSES)


@query("score_records")
def score_records(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on complete enough records, then score all of them, gaps included; ``score_facts`` and ``scorer_fits`` check the scorer."""
    records = _records(spark, sf)
    return _scorer(spark, sf, records).apply(records).select("record_id", "scores", "proba", "prediction", "confidence")


@query("score_facts", sql("SELECT record_id, 2.0::double AS total, 6 AS concepts, 1.0::double AS chance, true AS known FROM lab", "lab"))
def score_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Memberships of each panel and class probabilities add up to one, the most probable class is predicted."""
    records = _records(spark, sf)
    scored = _scorer(spark, sf, records).apply(records)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 9)
    named = F.array(*[F.lit(c) for c in CLASSES])[(F.array_position("proba", F.array_max("proba")) - 1).cast("int")]
    return scored.select("record_id", total("scores").alias("total"), F.size("scores").alias("concepts"), total("proba").alias("chance"),
                         ((F.col("prediction") == named) & (F.col("confidence") == F.array_max("proba"))).alias("known"))


@query("model_round_trip", "SELECT vec_id, true AS same FROM embeddings")
def model_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Saved and reloaded parameters score as the fitted ones do."""
    p = patches(spark, sf)
    prep = fit_prep(p, "f", 8)
    mix = fit_mixture(p.select(prep.apply("f").alias("x")), "x", 4)
    path = _scratch(spark)
    save_mixture(spark, path, prep, mix)
    prep2, mix2 = load_mixture(spark, path)
    both = p.select("vec_id", mix.predict(prep.apply("f")).alias("before"), mix2.predict(prep2.apply("f")).alias("after"))
    return both.select("vec_id", (F.col("before") == F.col("after")).alias("same"))


@query("embed_hook", """
    SELECT doc_id, [cast(n AS double), cast(v AS double)] AS embedding FROM (
        SELECT doc_id, length(text) AS n, length(regexp_replace(lower(text), '[^aeiou]', '', 'g')) AS v FROM documents)""")
def embed_hook(spark: SparkSession, sf: str) -> DataFrame:
    """A user model over whole texts; here it counts characters and vowels."""
    def model(texts):
        low = texts.str.lower()
        return [[float(len(t)), float(n)] for t, n in zip(texts, sum(low.str.count(v) for v in "aeiou"))]

    embed = model_column(model, "array<double>")
    return table(spark, sf, "documents").select("doc_id", embed("text").alias("embedding"))
