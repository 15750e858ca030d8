"""Queries over cluster quality, classification quality and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.fixtures import clustered, patches, sql, table
from tessera.catalog.subvectors import CONCEPTS, _r6, _scores
from tessera.operators import classify, metrics
from tessera.operators.clustering import DiagonalMixture
from tessera.operators.concepts import membership_matrix, score_rows
from tessera.operators.labelling import parse_answer


def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- cluster quality ---------------------------------------------------------------------------

@query("class_purity", sql("""
    SELECT round(sum(top / size) / 8, 6) AS class_purity FROM (SELECT cid, max(n) AS top, sum(n) AS size FROM (
        SELECT cid, label, count(*) AS n FROM patches GROUP BY 1, 2) GROUP BY 1)""", "patches"))
def class_purity(spark: SparkSession, sf: str) -> DataFrame:
    """Eight clusters of which two are empty: they stay in the divisor."""
    return _round(metrics.class_purity(patches(spark, sf), "cid", "label", 8), "class_purity")


@query("class_purity_weighted", sql("""
    SELECT round(sum(top) / sum(size), 6) AS class_purity FROM (SELECT cid, max(n) AS top, sum(n) AS size FROM (
        SELECT cid, label, count(*) AS n FROM patches GROUP BY 1, 2) GROUP BY 1)""", "patches"))
def class_purity_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.class_purity(patches(spark, sf), "cid", "label", weighted=True), "class_purity")


_NMI = """SELECT {by} round(mi / ((hc + hy) / 2), 6) AS nmi FROM (
    SELECT {by} sum(n / t * ln(n * t / (c * y))) AS mi FROM cell GROUP BY ALL) {j1}
    (SELECT {by} -sum(c / t * ln(c / t)) AS hc FROM (SELECT DISTINCT {by} cc, c, t FROM cell) GROUP BY ALL) h1 {j2}
    (SELECT {by} -sum(y / t * ln(y / t)) AS hy FROM (SELECT DISTINCT {by} yy, y, t FROM cell) GROUP BY ALL) h2 {j3}"""


@query("nmi", sql(_NMI.format(by="", j1=",", j2=",", j3=""), "patches", cell="""
    SELECT cid AS cc, label AS yy, count(*) AS n, sum(count(*)) OVER (PARTITION BY cid) AS c,
           sum(count(*)) OVER (PARTITION BY label) AS y, sum(count(*)) OVER () AS t FROM patches GROUP BY 1, 2"""))
def nmi(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.mutual_information(patches(spark, sf), "cid", "label"), "nmi")


@query("panel_nmi", sql(_NMI.format(by="p,", j1="JOIN", j2="USING (p) JOIN", j3="USING (p)"), "clustered", "outcomes", cell="""
    SELECT p, cc, yy, count(*) AS n, sum(count(*)) OVER (PARTITION BY p, cc) AS c,
           sum(count(*)) OVER (PARTITION BY p, yy) AS y, sum(count(*)) OVER (PARTITION BY p) AS t
    FROM (SELECT 'panel_a' AS p, panel_a AS cc, diq AS yy FROM clustered JOIN outcomes USING (record_id) WHERE diq IN (1, 2)
          UNION ALL SELECT 'panel_b', panel_b, diq FROM clustered JOIN outcomes USING (record_id) WHERE diq IN (1, 2)) GROUP BY 1, 2, 3"""))
def panel_nmi(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of each panel's clusters with a known outcome."""
    from tessera.catalog.fixtures import PANELS, with_outcomes
    rows = with_outcomes(spark, sf, clustered(spark, sf).select("record_id", *PANELS)).filter("diq in (1, 2)")
    long = rows.select("diq", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(p).alias("cc")) for p in PANELS])).alias("s"))
    return _round(metrics.mutual_information(long.select("diq", "s.*"), "cc", "diq", ["p"]), "nmi")


_INTRA = """SELECT avg(d) AS intra_mean FROM (
    SELECT p.vec_id, sqrt(sum((p.x - c.m) * (p.x - c.m))) AS d FROM px p JOIN cmean c ON p.cid = c.cid AND p.d = c.d GROUP BY 1)"""
_INTER = """SELECT avg(d) AS inter_mean FROM (
    SELECT a.cid, b.cid AS o, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM cmean a JOIN cmean b ON a.d = b.d AND a.cid < b.cid GROUP BY 1, 2)"""


@query("intra_inter", sql("""
    SELECT round(intra_mean, 6) AS intra_mean, round(inter_mean, 6) AS inter_mean,
           round(intra_mean / greatest(inter_mean, 1e-9), 6) AS intra_inter_ratio FROM i1, i2""", "cmean", i1=_INTRA, i2=_INTER))
def intra_inter(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.intra_inter(patches(spark, sf), "cid", "f"), "intra_mean", "inter_mean", "intra_inter_ratio")


def _sil_sql(dist: str) -> str:
    return f"""
    SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (
        SELECT vec_id, any_value(size) AS size, sum(CASE WHEN own THEN s END) / greatest(any_value(CASE WHEN own THEN cnt END) - 1, 1) AS a,
               min(CASE WHEN NOT own THEN s / cnt END) AS b
        FROM (SELECT a.vec_id, a.cid = b.cid AS own, b.cid, sum({dist}) AS s, count(*) AS cnt,
                     any_value((SELECT count(*) FROM smp z WHERE z.cid = a.cid)) AS size
              FROM smp a, smp b GROUP BY 1, 2, 3) GROUP BY 1)"""


_EUC = "list_distance(a.f, b.f)"


@query("silhouette_exact", sql(_sil_sql(_EUC), "patches", smp="SELECT vec_id, cid, f FROM patches"))
def silhouette_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Euclidean silhouette over all rows."""
    return _round(metrics.silhouette(patches(spark, sf), "cid", "f", "vec_id"), "silhouette")


@query("silhouette_squared", sql(_sil_sql(f"{_EUC} * {_EUC}"), "patches", smp="SELECT vec_id, cid, f FROM patches"))
def silhouette_squared(spark: SparkSession, sf: str) -> DataFrame:
    """Squared-Euclidean silhouette of all rows from cluster sums."""
    value = metrics.silhouette_squared(patches(spark, sf), "cid", "f")
    return spark.createDataFrame([(round(value, 6),)], "silhouette double")


@query("pair_consistency", sql("""
    SELECT count(*) AS n_pairs, round(avg(CASE WHEN ca = cb THEN 1 - s ELSE greatest(s - 0.5::double, 0) END), 6) AS loss FROM (
        SELECT a.cid AS ca, b.cid AS cb, list_inner_product(a.f, b.f) / sqrt(list_inner_product(a.f, a.f)) / sqrt(list_inner_product(b.f, b.f)) AS s
        FROM patches a JOIN patches b ON a.vec_id // 2 = b.vec_id // 2 AND a.vec_id < b.vec_id)""", "patches"))
def pair_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed pairs: each even row with its successor."""
    p = patches(spark, sf).select("vec_id", "cid", "f")
    a = p.filter("vec_id % 2 = 0").select((F.col("vec_id") + 1).alias("k"), F.col("cid").alias("cluster_a"), F.col("f").alias("vec_a"))
    b = p.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("k"), F.col("cid").alias("cluster_b"), F.col("f").alias("vec_b"))
    return _round(metrics.pair_consistency(a.join(b, "k")), "loss")


@query("sampled_pair_consistency", sql("""
    SELECT count(*) AS n_pairs, round(avg(CASE WHEN a.cid = b.cid THEN 1 - s ELSE greatest(s - 0.5::double, 0) END), 6) AS loss FROM (
        SELECT a.cid, b.cid AS cb, list_inner_product(a.f, b.f) / sqrt(list_inner_product(a.f, a.f)) / sqrt(list_inner_product(b.f, b.f)) AS s
        FROM draws JOIN rk a ON a.pos = pa JOIN rk b ON b.pos = pb)""".replace("a.cid = b.cid THEN", "cid = cb THEN"), "patches",
    rk="SELECT *, row_number() OVER (ORDER BY md5(concat(cast(vec_id AS varchar), '|42'))) AS pos FROM patches",
    draws="""SELECT 1 + ('0x' || substr(md5(concat(cast(range AS varchar), '|42a')), 1, 12))::bigint % n AS pa,
                    1 + ('0x' || substr(md5(concat(cast(range AS varchar), '|42b')), 1, 12))::bigint % n AS pb
             FROM range(512), (SELECT count(*) AS n FROM patches)"""))
def sampled_pair_consistency(spark: SparkSession, sf: str) -> DataFrame:
    pairs = metrics.seeded_pairs(patches(spark, sf), "vec_id", "cid", "f", 512, 42)
    return _round(metrics.pair_consistency(pairs), "loss")


@query("seeded_sample", """
    SELECT o_orderkey FROM orders ORDER BY md5(concat(cast(o_orderkey AS varchar), '|42')), o_orderkey LIMIT 500""")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.seeded_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 500, 42)


_BY_LABEL = """SELECT label AS variant, count(*) AS n, avg(e) AS mean_len, avg(x) AS mean_first FROM (
    SELECT label, vec_id, sqrt(sum(x * x) FILTER (d <= {0})) AS e, any_value(x) FILTER (d = 1) AS x FROM px GROUP BY 1, 2) GROUP BY 1"""


def _run(spark: SparkSession, sf: str, width: int) -> DataFrame:
    """A run report per label: mean length of the first block and mean first value."""
    from tessera.functions.vectors import vector_norm
    return patches(spark, sf).groupBy(F.col("label").alias("variant")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(vector_norm(F.slice("f", 1, width))).alias("mean_len"),
        F.avg(F.col("f")[0]).alias("mean_first"))


@query("compare_runs", sql("""
    SELECT variant, metric, round(l, 6) AS left_value, round(r, 6) AS right_value, round(l - r, 6) AS delta,
           CASE WHEN g > 0.001 THEN 'left' WHEN g < -0.001 THEN 'right' ELSE 'tie' END AS better
    FROM (SELECT a.variant, 'mean_len' AS metric, a.mean_len AS l, b.mean_len AS r, b.mean_len - a.mean_len AS g FROM ra a JOIN rb b USING (variant)
          UNION ALL SELECT a.variant, 'mean_first', a.mean_first, b.mean_first, a.mean_first - b.mean_first FROM ra a JOIN rb b USING (variant))""",
    "px", ra=_BY_LABEL.format(16), rb=_BY_LABEL.format(17)))
def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two block widths as two runs; shorter is better, a larger first value is better."""
    out = metrics.compare_runs(_run(spark, sf, 16), _run(spark, sf, 17), ["variant"], {"mean_len": False, "mean_first": True})
    return _round(out, "left_value", "right_value", "delta")


@query("baseline_deltas", sql("""
    SELECT variant, round(b.mean_len - r.mean_len, 4) AS delta_mean_len, round(b.mean_first - r.mean_first, 4) AS delta_mean_first
    FROM ra r, (SELECT mean_len, mean_first FROM ra WHERE variant = 0) b WHERE variant <> 0""", "px", ra=_BY_LABEL.format(16)))
def baseline_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.against_baseline(_run(spark, sf, 16), "variant", 0, ["mean_len", "mean_first"])


@query("pearson_corr", """
    SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_discount), 6) AS r FROM lineitem GROUP BY 1""")
def pearson_corr(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"]), "r").drop("p_value")


@query("pearson_p_value", """
    SELECT g, n, CASE WHEN ok THEN r END AS r, round(CASE WHEN NOT ok THEN NULL WHEN n < 3 THEN NULL ELSE CASE n % 2 WHEN 0
        THEN 1 - a * list_sum(list_transform(generate_series(0, (n - 4) // 2), lambda k: factorial(cast(2 * k AS int)) / (pow(4, k) * pow(factorial(cast(k AS int)), 2)) * pow(1 - a * a, k)))
        ELSE 1 - 2 / pi() * (asin(a) + a * sqrt(1 - a * a) * coalesce(list_sum(list_transform(generate_series(0, (n - 5) // 2),
             lambda k: pow(4, k) * pow(factorial(cast(k AS int)), 2) / factorial(cast(2 * k + 1 AS int)) * pow(1 - a * a, k))), 0)) END END, 4) AS p_value FROM (
        SELECT l_orderkey AS g, count(*) AS n, round(corr(l_quantity, l_extendedprice), 4) AS r,
               least(abs(corr(l_quantity, l_extendedprice)), 1.0::double) AS a,
               stddev_pop(l_quantity) > 0 AND stddev_pop(l_extendedprice) > 0 AS ok FROM lineitem GROUP BY 1)""")
def pearson_p_value(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation per order; for whole numbers of pairs the p-value is a finite sum."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), "l_quantity", "l_extendedprice")
    out = metrics.pearson(rows, "l_quantity", "l_extendedprice", ["g"])
    return _round(out, "r", "p_value", places=4)


# --- classification quality --------------------------------------------------------------------

_PRED = """SELECT y, CASE WHEN panel_b = 0 THEN 2 WHEN panel_a = 0 THEN 1 WHEN avg_tax > 0 THEN 0 ELSE 2 END AS yp,
    round(avg_qty, 6) AS s0, round(avg_tax, 6) AS s1, round(n_orders, 2) AS s2
    FROM clustered JOIN (SELECT record_id, CASE WHEN diq IS NOT DISTINCT FROM 1 THEN 0 WHEN bpq IS NOT DISTINCT FROM 1 THEN 1 ELSE 2 END AS y
                         FROM outcomes) USING (record_id)"""


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome classes with a rule-based prediction and three scores."""
    from tessera.catalog.fixtures import with_outcomes
    one = F.lit(1)
    rows = with_outcomes(spark, sf, clustered(spark, sf))
    y = F.when(F.col("diq").eqNullSafe(one), 0).when(F.col("bpq").eqNullSafe(one), 1).otherwise(2)
    yp = (F.when(F.col("panel_b") == 0, 2).when(F.col("panel_a") == 0, 1).when(F.col("avg_tax") > 0, 0).otherwise(2))
    return rows.select("record_id", y.alias("y"), yp.alias("yp"), F.round("avg_qty", 6).alias("s0"),
                       F.round("avg_tax", 6).alias("s1"), F.round("n_orders", 2).alias("s2"))


@query("classification_report", sql("""
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
        SELECT cast(class AS varchar) AS class, precision, recall, f1, support FROM pc
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) AS bigint) FROM pc
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                         sum(f1 * support) / sum(support), cast(sum(support) AS bigint) FROM pc
        UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT avg(CASE WHEN y = yp THEN 1.0::double ELSE 0.0::double END) AS a, count(*) AS n FROM pr))""",
    "clustered", "outcomes", pr=_PRED, pc="""
    SELECT class, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, support FROM (
        SELECT class, CASE WHEN prd > 0 THEN tp / prd ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r, support FROM (
            SELECT k.class, count(*) FILTER (y = class) AS support, count(*) FILTER (yp = class) AS prd,
                   count(*) FILTER (y = class AND yp = class) AS tp
            FROM pr, (SELECT DISTINCT y AS class FROM pr UNION SELECT DISTINCT yp FROM pr) k GROUP BY 1))"""))
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.classification_report(_predicted(spark, sf), "y", "yp"), "precision", "recall", "f1")


def _auc_sql() -> str:
    return " UNION ALL ".join(f"""
    SELECT '{i}' AS class, round(sum(pos * (below + neg / 2.0::double)) / sum(pos) / sum(neg), 6) AS auc FROM (
        SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT s{i} AS s, count(*) FILTER (y = {i}) AS pos, count(*) FILTER (y <> {i}) AS neg FROM pr GROUP BY 1))"""
                              for i in range(3))


_AUC = {str(i): f"s{i}" for i in range(3)}


@query("one_vs_rest_auc", sql(_auc_sql(), "clustered", "outcomes", pr=_PRED))
def one_vs_rest_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.one_vs_rest_auc(_predicted(spark, sf), "y", _AUC), "auc")


@query("macro_auc", sql(f"SELECT round(avg(auc), 5) AS macro_auc FROM ({_auc_sql()})", "clustered", "outcomes", pr=_PRED))
def macro_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.macro_auc(_predicted(spark, sf), "y", _AUC), "macro_auc", places=5)


@query("lift_over_chance", sql("""
    SELECT round(a, 6) AS accuracy, round(1 / k, 6) AS chance, round(a - 1 / k, 6) AS lift, round(m / n, 6) AS majority_rate FROM
        (SELECT avg(CASE WHEN y = yp THEN 1.0::double ELSE 0.0::double END) AS a, count(*) AS n FROM pr),
        (SELECT count(*) AS k, max(c) AS m FROM (SELECT y, count(*) AS c FROM pr GROUP BY 1))""", "clustered", "outcomes", pr=_PRED))
def lift_over_chance(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.lift_over_chance(_predicted(spark, sf), "y", "yp"), "accuracy", "chance", "lift", "majority_rate")


@query("split_accuracy", """
    SELECT CASE WHEN r <= round(0.2::double * n) THEN 'test' ELSE 'train' END AS split, round(avg(ok), 6) AS accuracy FROM (
        SELECT CASE WHEN quality = toxic THEN 0.0::double ELSE 1.0::double END AS ok,
               row_number() OVER (PARTITION BY quality ORDER BY md5(concat(cast(doc_id AS varchar), '|42'))) AS r,
               count(*) OVER (PARTITION BY quality) AS n FROM labels) GROUP BY 1""")
def split_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Train and test accuracy of the rule "not toxic means good"."""
    from tessera.operators.sampling import stratified_split
    s = stratified_split(table(spark, sf, "labels"), "quality", "doc_id", 42)
    ok = (F.col("quality") != F.col("toxic")).cast("double")
    return s.groupBy(F.when(F.col("is_test"), "test").otherwise("train").alias("split")).agg(F.round(F.avg(ok), 6).alias("accuracy"))


@query("judged_accuracy", """
    SELECT lang, count(quality) AS judged, count(*) - count(quality) AS unjudged, round(avg(quality), 6) AS accuracy
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def judged_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Share of judged items found right; unjudged items are counted, not scored."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("quality").alias("judged"), F.count_if(F.col("quality").isNull()).alias("unjudged"),
                                 F.round(F.avg("quality"), 6).alias("accuracy"))


@query("separation_gap", sql("""
    SELECT round(avg(edge) FILTER (image_id % 2 = 0) - avg(edge) FILTER (image_id % 2 = 1), 6) AS gap FROM scores""", "scores"))
def separation_gap(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf).withColumn("g", F.when(F.col("image_id") % 2 == 0, "a").otherwise("b"))
    return _round(metrics.separation_gap(s, "g", "a", "b", "edge"), "gap")


# --- explanations with fixed parameters --------------------------------------------------------

# Parameters of a small three-class model, made up for the check.
_W = [[2.0, -1.0, 0.5], [-0.5, 1.5, -2.0], [0.25, -0.75, 1.0]]
_B = [0.1, -0.2, 0.05]


def _model() -> classify.LinearModel:
    import numpy as np
    return classify.LinearModel(("cat", "car", "bird"), ("edge", "core_1", "core_4", "gone"),
                                np.array([[*w, 9.0] for w in _W]), np.array(_B))


_LOGITS = "SELECT image_id, edge, core_1, core_4, [" + ", ".join(
    f"{b}::double + edge * {w[0]}::double + core_1 * {w[1]}::double + core_4 * {w[2]}::double" for w, b in zip(_W, _B)) + "] AS z FROM scores"
_CLASSED = """SELECT image_id, edge, core_1, core_4, z, cast(list_position(z, list_max(z)) - 1 AS int) AS k,
    list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM lg"""


@query("linear_score", sql("""
    SELECT image_id, ['cat', 'car', 'bird'][k + 1] AS prediction, round(e[k + 1] / list_sum(e), 6) AS confidence,
           list_transform(e, lambda x: round(x / list_sum(e), 6)) AS proba FROM cl""", "scores", lg=_LOGITS, cl=_CLASSED))
def linear_score(spark: SparkSession, sf: str) -> DataFrame:
    """The model knows a concept that the scores lack: it counts as 0."""
    out = _model().score(_scores(spark, sf))
    return out.select("image_id", "prediction", F.round("confidence", 6).alias("confidence"), _r6("proba").alias("proba"))


def _contrib_sql(kind: str) -> str:
    parts = []
    for j, c in enumerate(CONCEPTS):
        w = "[" + ", ".join(f"{_W[i][j]}::double" for i in range(3)) + "][k + 1]"
        base = c if kind == "product" else f"({c} - (edge + core_1 + core_4) / 4)"
        parts.append(f"SELECT image_id, '{c}' AS concept, {c} AS score, {w} * {base} AS contribution FROM cl")
    base = "0.0::double" if kind == "product" else "(0 - (edge + core_1 + core_4) / 4)"
    parts.append(f"SELECT image_id, 'gone', 0.0::double, 9.0::double * {base} FROM cl")
    return " UNION ALL ".join(parts)


@query("contributions_product", sql(f"""
    SELECT image_id, concept, round(score, 6) AS score, round(contribution, 6) AS contribution FROM ({_contrib_sql('product')})""",
    "scores", lg=_LOGITS, cl=_CLASSED))
def contributions_product(spark: SparkSession, sf: str) -> DataFrame:
    m = _model()
    return _round(classify.contributions(m.score(_scores(spark, sf)), "image_id", list(CONCEPTS), m, "product"), "score", "contribution")


@query("contributions_centred", sql(f"""
    SELECT image_id, concept, round(score, 6) AS score, c AS contribution,
           row_number() OVER (PARTITION BY image_id ORDER BY abs(c) DESC, concept) AS rank
    FROM (SELECT *, round(contribution, 6) AS c FROM ({_contrib_sql('centred')}))""", "scores", lg=_LOGITS, cl=_CLASSED))
def contributions_centred(spark: SparkSession, sf: str) -> DataFrame:
    m = _model()
    rows = _round(classify.contributions(m.score(_scores(spark, sf)), "image_id", list(CONCEPTS), m), "score", "contribution")
    return classify.ranked_contributions(rows, "image_id")


@query("top_weights", sql("""
    SELECT class, concept, round(weight, 6) AS weight, r AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY class ORDER BY abs(weight) DESC, concept) AS r FROM w) WHERE r <= 2""",
    "scores", w=" UNION ALL ".join(f"SELECT cast(image_id % 3 AS varchar) AS class, '{c}' AS concept, round(avg({c}), 6) AS weight FROM scores GROUP BY 1"
                                   for c in CONCEPTS)))
def top_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Mean scores per group stand in for the weights of a class."""
    names = sorted(CONCEPTS)
    s = _scores(spark, sf).groupBy((F.col("image_id") % 3).cast("string").alias("class")).agg(*[F.avg(c).alias(c) for c in names])
    rows = score_rows(s, "class", names).select("class", "concept", "concept_idx", F.round("score", 6).alias("weight"))
    return classify.top_weights(rows, 2).select("class", "concept", "weight", "rank")


_OC = {
    "tr": "SELECT * FROM scores WHERE image_id % 4 <> 0",
    "st": "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in CONCEPTS) + " FROM tr",
    "ds": "SELECT image_id, " + " + ".join(f"(({c} - m_{c}) / s_{c}) ** 2" for c in CONCEPTS) + " AS d2, "
          + ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}, {c}" for c in CONCEPTS) + " FROM scores, st",
}


def _one_class(spark: SparkSession, sf: str, diagonal: bool = True) -> tuple[DataFrame, classify.OneClassModel]:
    s = _scores(spark, sf)
    return s, classify.fit_one_class(s.filter("image_id % 4 <> 0"), list(CONCEPTS), 0.1, diagonal)


@query("one_class_diag", sql("""
    SELECT image_id, round(s, 6) AS score, CASE WHEN s > 0 THEN 'target' ELSE 'not_target' END AS prediction,
           round(least(abs(s), 1), 6) AS confidence FROM (
        SELECT image_id, tanh((cut - d2) / sd) AS s FROM ds,
            (SELECT quantile_cont(d2, 0.9) AS cut, stddev_pop(d2) AS sd FROM ds WHERE image_id % 4 <> 0))""", "scores", **_OC))
def one_class_diag(spark: SparkSession, sf: str) -> DataFrame:
    s, model = _one_class(spark, sf)
    return _round(model.score(s), "score", "confidence").select("image_id", "score", "prediction", "confidence")


@query("one_class_explain", sql("""
    SELECT image_id, concept, round(a, 6) AS activation, z AS deviation,
           CASE WHEN z < -0.5 THEN 'not_target' WHEN z > 0.5 THEN 'target' ELSE 'neutral' END AS pushes FROM (
        """ + " UNION ALL ".join(f"SELECT image_id, '{c}' AS concept, {c} AS a, round(z_{c}, 6) AS z FROM ds" for c in CONCEPTS) + ")",
    "scores", **_OC))
def one_class_explain(spark: SparkSession, sf: str) -> DataFrame:
    s, model = _one_class(spark, sf)
    return _round(model.explain(s, "image_id"), "activation", "deviation").drop("rank")


@query("nu_sweep", sql("""
    SELECT nu, round(avg(s) FILTER (t), 6) AS target_mean, round(avg(s) FILTER (NOT t), 6) AS other_mean,
           round(avg(CASE WHEN s > 0 THEN 1.0::double ELSE 0.0::double END) FILTER (t), 6) AS target_accuracy,
           round(avg(CASE WHEN s <= 0 THEN 1.0::double ELSE 0.0::double END) FILTER (NOT t), 6) AS other_accuracy,
           round(avg(abs(s)) FILTER (t), 6) AS target_confidence, round(avg(abs(s)) FILTER (NOT t), 6) AS other_confidence,
           round(avg(s) FILTER (t) - avg(s) FILTER (NOT t), 6) AS gap
    FROM (SELECT nu, image_id % 4 <> 0 AS t, tanh((cut - d2) / sd) AS s FROM ds, (
              SELECT unnest([0.05::double, 0.1, 0.15, 0.2]) AS nu, unnest(quantile_cont(d2, [0.95, 0.9, 0.85, 0.8])) AS cut, stddev_pop(d2) AS sd
              FROM ds WHERE image_id % 4 <> 0)) GROUP BY 1""", "scores", **_OC))
def nu_sweep(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf).withColumn("g", F.when(F.col("image_id") % 4 != 0, "in").otherwise("out"))
    out = classify.nu_sweep(s, "g", "in", "out", list(CONCEPTS), diagonal=True)
    return _round(out, *[c for c in out.columns if c != "nu"])


@query("best_setting", sql("""
    SELECT cid, size FROM (SELECT cid, count(*) AS size FROM patches GROUP BY 1) ORDER BY size DESC, cid LIMIT 1""", "patches"))
def best_setting(spark: SparkSession, sf: str) -> DataFrame:
    """First row with the highest score, as for the best number of clusters or the best nu."""
    n = patches(spark, sf).groupBy("cid").agg(F.count(F.lit(1)).alias("size"))
    return classify.best_row(n, "size", "cid")


# --- memberships with fixed parameters ---------------------------------------------------------

def _mixture(width: int) -> DiagonalMixture:
    """Three components whose parameters follow a rule."""
    import numpy as np
    c, d = np.arange(3)[:, None], np.arange(1, width + 1)[None, :]
    return DiagonalMixture(np.array([0.5, 0.3, 0.2]), ((c * 7 + d * 3) % 5 - 2) / 40.0, 0.01 + ((c + d) % 3) / 100.0)


def _member_view(lo: int, width: int) -> str:
    joint = ", ".join(f"""ln({w}::double) - 0.5::double * list_sum(list_transform(generate_series(1, {width}), lambda i:
        (f[{lo - 1} + i] - (({c * 7} + i * 3) % 5 - 2) / 40.0::double) ** 2 / (0.01::double + (({c} + i) % 3) / 100.0::double)
        + ln(2 * pi() * (0.01::double + (({c} + i) % 3) / 100.0::double))))""" for c, w in enumerate((0.5, 0.3, 0.2)))
    return f"""SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (
        SELECT vec_id, list_transform(j, lambda x: exp(x - list_max(j))) AS e FROM (SELECT vec_id, [{joint}] AS j FROM patches))"""


@query("soft_membership", sql("""
    SELECT vec_id, list_transform(p, lambda x: round(x, 6)) AS p, cast(list_position(p, list_max(p)) - 1 AS int) AS cluster_id FROM m""",
    "patches", m=_member_view(1, 64)))
def soft_membership(spark: SparkSession, sf: str) -> DataFrame:
    mix = _mixture(64)
    return patches(spark, sf).select("vec_id", _r6(mix.membership("f")).alias("p"), mix.predict("f").alias("cluster_id"))


@query("membership_matrix", sql("""
    SELECT vec_id, list_transform(list_concat(a.p, b.p), lambda x: round(x, 6)) AS scores FROM ma a JOIN mb b USING (vec_id)""",
    "patches", ma=_member_view(1, 32), mb=_member_view(33, 32)))
def membership_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The two halves of the vectors play two panels of one record."""
    mix = _mixture(32)
    p = patches(spark, sf)
    blocks = [p.select("vec_id", mix.membership(F.slice("f", s, 32)).alias("p")) for s in (1, 33)]
    return membership_matrix(blocks, "vec_id", ["p", "p"]).select("vec_id", _r6("scores").alias("scores"))


# --- answers of a language model ---------------------------------------------------------------

@query("answer_parse", """
    SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN event_type END AS "PRIMARY_LABEL",
           CASE WHEN event_id % 4 <> 3 THEN json_extract_string(props, '$.k') END AS "CONFIDENCE",
           CASE WHEN event_id % 4 = 3 THEN 'unparsable answer' END AS error FROM events""")
def answer_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Answers built from the events: plain, fenced, fenced with a tag, and broken."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    body = F.concat(F.lit('{"PRIMARY_LABEL": "'), "event_type", F.lit('", "CONFIDENCE": "'), "k",
                    F.lit('", "KEY_FINDINGS": "x", "DIFFERENTIALS": "y", "SME_NOTE": "z"}'))
    m = F.col("event_id") % 4
    text = (F.when(m == 0, body).when(m == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")))
            .when(m == 2, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(F.substring(body, 1, 30)))
    return e.select("event_id", parse_answer(text).alias("a")).select("event_id", "a.PRIMARY_LABEL", "a.CONFIDENCE", "a.error")
