"""Queries over awkward data: masks of unequal length, NULL classes and clusters, single steps of iterative fits."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.fixtures import FEATURES, KEYS, lab, patches, sql, table
from tessera.functions.bands import title_name
from tessera.functions.vectors import softmax, vector_norm
from tessera.operators import classify, concepts, labelling, metrics, prepare
from tessera.operators.clustering import DiagonalMixture, mixture_step, nearest_centre
from tessera.operators.patches import fraction_above
from tessera.operators.sampling import stratified_split
from tessera.operators.vectors import fit_projection, mean_vectors
from tessera.sources import tables

_LENGTHS = "list_transform(string_split(text, ' '), lambda w: length(w) / 10.0::double)"


@query("text_mask_fraction", f"""
    SELECT doc_id, round(len(list_filter(m, lambda x: x > 0.5::double)) / len(m)::double, 6) AS share,
           round(sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS norm
    FROM (SELECT doc_id, {_LENGTHS} AS m FROM documents)""")
def text_mask_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """Masks of very different length: word lengths of a text."""
    mask = F.transform(F.split("text", " "), lambda w: F.char_length(w) / F.lit(10.0))
    rows = table(spark, sf, "documents").select("doc_id", mask.alias("m"))
    return rows.select("doc_id", F.round(fraction_above(0.5)("m"), 6).alias("share"), F.round(vector_norm("m"), 6).alias("norm"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id", "left")


@query("class_distribution_nulls", """
    SELECT lang, n, round(g, 6) AS frac_1, round(b, 6) AS frac_0, CASE WHEN g >= b THEN '1' ELSE '0' END AS dominant, greatest(g, b) < 0.7 AS is_mixed
    FROM (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) / count(*)::double AS g, count(*) FILTER (quality = 0) / count(*)::double AS b
          FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)""")
def class_distribution_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a label count in the divisor."""
    d = labelling.class_distribution(_judged(spark, sf), "lang", "quality", [1, 0])
    return d.select("lang", "n", F.round("frac_1", 6).alias("frac_1"), F.round("frac_0", 6).alias("frac_0"), "dominant", "is_mixed")


@query("concept_scores_nulls", """
    SELECT source, count(*) AS n_patches, round(count(*) FILTER (quality = 1) / count(*)::double, 6) AS good,
           round(count(*) FILTER (quality = 0) / count(*)::double, 6) AS bad
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def concept_scores_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a cluster count in the divisor."""
    s = concepts.score_columns(_judged(spark, sf), "source", "quality", {"good": 1, "bad": 0})
    return s.select("source", "n_patches", F.round("good", 6).alias("good"), F.round("bad", 6).alias("bad"))


@query("group_impute", sql("SELECT record_id, cycle_year, " + ", ".join(
    f"round(coalesce({f}, median({f}) OVER (PARTITION BY cycle_year)), 6) AS {f}" for f in FEATURES) + " FROM lab", "lab"))
def group_impute(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps filled with the median of the cycle."""
    out = prepare.impute_by_group(lab(spark, sf).persist(StorageLevel.MEMORY_AND_DISK), FEATURES, ["cycle_year"])
    return out.select(*KEYS, *[F.round(f, 6).alias(f) for f in FEATURES])


@query("title_names", """
    SELECT DISTINCT event_type, list_aggregate(list_transform(string_split(event_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS title,
           substr(list_aggregate(list_transform(string_split(event_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' '), 1, 4) AS short
    FROM events""")
def title_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_type").distinct().select(
        "event_type", title_name("event_type").alias("title"), title_name("event_type", 4).alias("short"))


@query("bad_row_list", """
    SELECT c_mktsegment, c_custkey, c_acctbal, rank FROM (
        SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rank
        FROM customer WHERE NOT coalesce(c_acctbal >= 0, false)) WHERE rank <= 5""")
def bad_row_list(spark: SparkSession, sf: str) -> DataFrame:
    """Quarantine of the rows that fail a check, the first five of each segment."""
    rows = table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return tables.first_failures(rows, F.col("c_acctbal") >= 0, ["c_mktsegment"], "c_custkey", 5)


@query("region_labels", """
    SELECT r_name, cast(n_nationkey AS varchar) AS key, trim(n_name) AS label, n_nationkey % 4 <> 1 AS include, CASE WHEN n_nationkey % 3 = 0 THEN 3 ELSE 2 END AS confidence, '' AS notes
    FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 1""")
def region_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A label dictionary per region as JSON text, built from the table and parsed again."""
    meta = F.struct(F.concat(F.lit(" "), "n_name", F.lit("  ")).alias("label"), (F.col("n_nationkey") % 4 != 1).alias("include"),
                    F.when(F.col("n_nationkey") % 3 == 0, 3).alias("confidence"))
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    texts = rows.groupBy("r_name").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), meta)))).alias("j"))
    return tables.label_rows(texts, "j", keep=["r_name"])


@query("ranked_probabilities", sql("""
    SELECT vec_id, r AS rank, c AS class, round(p, 6) AS probability FROM (
        SELECT vec_id, c, p, cast(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS int) AS r FROM (
            SELECT vec_id, unnest(['first', 'neither', 'second']) AS c,
                   unnest([exp(f[1]) / t, exp(f[2]) / t, exp(f[3]) / t]) AS p
            FROM (SELECT vec_id, f, exp(f[1]) + exp(f[2]) + exp(f[3]) AS t FROM patches)))""", "patches"))
def ranked_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    p = patches(spark, sf).select("vec_id", softmax(F.slice("f", 1, 3)).alias("p"))
    rows = p.select("vec_id", F.posexplode(labelling.ranked_probabilities("p", ["first", "neither", "second"])).alias("r", "c"))
    return rows.select("vec_id", (F.col("r") + 1).alias("rank"), "c.class", F.round("c.probability", 6).alias("probability"))


@query("one_vs_rest_projected")
def one_vs_rest_projected(spark: SparkSession, sf: str) -> DataFrame:
    """Raw-vector baseline: scaler, projection and one-class model of each class, and the report of its predictions."""
    rows = patches(spark, sf).select("vec_id", (F.col("label") % 3).cast("string").alias("y"), "f")
    split = stratified_split(rows, "y", "vec_id", 42)
    out = classify.one_vs_rest_projected(split.filter("not is_test"), split.filter("is_test"), "y", "f", ["0", "1", "2"], dims=6)
    return metrics.classification_report(out, "y", "predicted")


# --- single steps of iterative fits, from fixed parameters ------------------------------------------

@query("pca_norms", sql("""
    SELECT vec_id, round(sum((x - m) * (x - m)), 6) AS squared FROM px JOIN (SELECT d, avg(x) AS m FROM px GROUP BY 1) USING (d) GROUP BY 1""", "px"))
def pca_norms(spark: SparkSession, sf: str) -> DataFrame:
    """A projection to all dimensions keeps the length of every centred row."""
    p = patches(spark, sf)
    x = fit_projection(p, "f", 64).apply("f", normalize=False)
    return p.select("vec_id", F.round(F.pow(vector_norm(x), 2), 6).alias("squared"))


@query("kmeans_step", sql("""
    SELECT k AS cid, d, round(avg(x), 6) AS m FROM px JOIN (
        SELECT vec_id, k FROM (SELECT a.vec_id, b.vec_id AS k, sum((a.x - b.x) * (a.x - b.x)) AS g FROM px a JOIN px b ON a.d = b.d AND b.vec_id < 6 GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(g, 9), k) = 1) USING (vec_id) GROUP BY 1, 2""", "px"))
def kmeans_step(spark: SparkSession, sf: str) -> DataFrame:
    """One Lloyd step from the first six vectors as centres."""
    p = patches(spark, sf)
    first = np.array([r["f"] for r in p.filter("vec_id < 6").orderBy("vec_id").collect()])
    moved = mean_vectors(p.withColumn("k", nearest_centre(first, "f")), ["k"], "f")
    cells = moved.select(F.col("k").cast("long").alias("cid"), F.posexplode("vector").alias("d", "m"))
    return cells.select("cid", (F.col("d") + 1).cast("long").alias("d"), F.round("m", 6).alias("m"))


@query("mixture_step", sql("""
    SELECT k AS component, d, round(any_value(n) / any_value(total), 6) AS weight, round(sum(r * x) / any_value(n), 6) AS mean,
           round(sum(r * x * x) / any_value(n) - pow(sum(r * x) / any_value(n), 2), 6) AS variance
    FROM resp JOIN low USING (vec_id) JOIN (SELECT k, sum(r) AS n FROM resp GROUP BY 1) USING (k), (SELECT count(*)::double AS total FROM patches) GROUP BY 1, 2""",
    "px", low="SELECT vec_id, d, x FROM px WHERE d <= 8",
    joint="""SELECT a.vec_id, b.vec_id AS k, sum(-0.5::double * ((a.x - b.x) * (a.x - b.x) / 0.02::double)) AS g
             FROM low a JOIN low b ON a.d = b.d AND b.vec_id < 4 GROUP BY 1, 2""",
    resp="SELECT vec_id, k, exp(g - mx) / sum(exp(g - mx)) OVER (PARTITION BY vec_id) AS r FROM (SELECT *, max(g) OVER (PARTITION BY vec_id) AS mx FROM joint)"))
def mixture_update(spark: SparkSession, sf: str) -> DataFrame:
    """One expectation and maximisation step from four fixed components of equal weight."""
    p = patches(spark, sf).select("vec_id", F.slice("f", 1, 8).alias("x"))
    means = np.array([r["x"] for r in p.filter("vec_id < 4").orderBy("vec_id").collect()])
    new = mixture_step(p, "x", DiagonalMixture(np.full(4, 0.25), means, np.full(means.shape, 0.02)), floor=0.0)
    rows = new.to_frame(spark).select("component", "weight", F.posexplode(F.arrays_zip("mean", "variance")).alias("d", "c"))
    return rows.select(F.col("component").cast("long").alias("component"), (F.col("d") + 1).cast("long").alias("d"), F.round("weight", 6).alias("weight"),
                       F.round("c.mean", 6).alias("mean"), F.round("c.variance", 6).alias("variance"))
