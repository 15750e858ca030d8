"""Queries over sub-vectors of images: encoding, attention, grids, concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.fixtures import GRID, attn, attn_rows, labels, patches, sql, table
from tessera.functions import bands, grid
from tessera.functions.vectors import (append_position, argmax, cosine, l2_normalize, last_block,
                                       softmax)
from tessera.operators import concepts, labelling, patches as ops, sampling
from tessera.operators.vectors import (layer_concat, mean_vectors, nearest, pool_layers)

CONCEPTS = {"edge": 0, "core_1": 1, "core_4": 4}


def _r6(col: str | F.Column):
    """Vector rounded element by element."""
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda x: F.round(x, 6))


def _small(spark: SparkSession, included_only: bool = True) -> DataFrame:
    return labels(spark, included_only)


# --- vector encoding ---------------------------------------------------------------------------

@query("l2_normalize", sql("""
    SELECT vec_id, list_transform(f, lambda x: round(x / s, 6)) AS u
    FROM (SELECT vec_id, list_transform(f, lambda x: x * 3) AS f, 3 * sqrt(list_sum(list_transform(f, lambda x: x * x))) AS s
          FROM patches)""", "patches"))
def l2(spark: SparkSession, sf: str) -> DataFrame:
    tripled = F.transform("f", lambda x: x * 3)
    return patches(spark, sf).select("vec_id", _r6(l2_normalize(tripled)).alias("u"))


@query("spatial_augment", sql("""
    SELECT vec_id, list_transform(g, lambda x: round(x / sqrt(list_sum(list_transform(g, lambda y: y * y))), 6)) AS u
    FROM (SELECT vec_id, list_concat(f, [(patch_id // 5) / 5.0::double * 0.4::double,
                                         (patch_id % 5) / 5.0::double * 0.4::double]) AS g FROM patches)""", "patches"))
def spatial_augment(spark: SparkSession, sf: str) -> DataFrame:
    out = append_position("f", grid.grid_row("patch_id", GRID), grid.grid_col("patch_id", GRID), GRID, 0.4)
    return patches(spark, sf).select("vec_id", _r6(out).alias("u"))


@query("layer_slice", sql("SELECT vec_id, list_transform(f[49:64], lambda x: round(x, 6)) AS last FROM patches", "patches"))
def layer_slice(spark: SparkSession, sf: str) -> DataFrame:
    return patches(spark, sf).select("vec_id", _r6(last_block("f", 16)).alias("last"))


@query("layer_concat", sql("""
    SELECT vec_id, list_transform(list_concat(list_concat(f[49:64], f[1:16]), f[17:20]), lambda x: round(x, 6)) AS f
    FROM patches""", "patches"))
def layers(spark: SparkSession, sf: str) -> DataFrame:
    p = patches(spark, sf)
    parts = [p.select("vec_id", F.slice("f", *s).alias("f")) for s in ((49, 16), (1, 16), (17, 4))]
    return layer_concat(parts, ["vec_id"], "f").select("vec_id", _r6("f").alias("f"))


@query("softmax_argmax", sql("""
    SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS p,
           cast(list_position(e, list_max(e)) - 1 AS int) AS best
    FROM (SELECT vec_id, list_transform(f[1:6], lambda x: exp(x - list_max(f[1:6]))) AS e FROM patches)""", "patches"))
def softmax_argmax(spark: SparkSession, sf: str) -> DataFrame:
    s = patches(spark, sf).select("vec_id", softmax(F.slice("f", 1, 6)).alias("p"))
    return s.select("vec_id", _r6("p").alias("p"), argmax("p").alias("best"))


@query("cosine_halves", sql("""
    SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2]))
        / sqrt(list_sum(list_transform(a, lambda x: x * x))) / sqrt(list_sum(list_transform(b, lambda x: x * x))), 6) AS sim
    FROM (SELECT vec_id, f[1:32] AS a, f[33:64] AS b FROM patches)""", "patches"))
def cosine_halves(spark: SparkSession, sf: str) -> DataFrame:
    return patches(spark, sf).select(
        "vec_id", F.round(cosine(F.slice("f", 1, 32), F.slice("f", 33, 32)), 6).alias("sim"))


@query("mean_pool", sql("""
    SELECT image_id, n, list(round(m, 6) ORDER BY d) AS vector FROM (
        SELECT image_id, d, avg(x) AS m, count(*) AS n FROM px GROUP BY 1, 2) GROUP BY 1, 2""", "px"))
def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    return mean_vectors(patches(spark, sf), ["image_id"], "f").select(
        "image_id", "n", _r6("vector").alias("vector"))


@query("panel_pool", sql("""
    SELECT image_id, list(round(m, 6) ORDER BY layer, d) AS v FROM (
        SELECT image_id, patch_id % 3 AS layer, d, avg(x) AS m FROM px GROUP BY 1, 2, 3) GROUP BY 1""", "px"))
def panel_pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = patches(spark, sf).select("image_id", (F.col("patch_id") % 3).alias("layer"), F.col("f").alias("v"))
    return pool_layers(rows, ["image_id"], "layer", [0, 1, 2], "v").select("image_id", _r6("v").alias("v"))


# --- attention ---------------------------------------------------------------------------------

@query("foreground_mask", sql("""
    SELECT vec_id, cell, round(attn, 6) AS attn FROM (
        SELECT *, count(*) FILTER (attn > thr) OVER (PARTITION BY vec_id) AS kept FROM (
            SELECT vec_id, cell, attn, quantile_cont(attn, 0.9) OVER (PARTITION BY vec_id) AS thr,
                   count(*) OVER (PARTITION BY vec_id) AS n,
                   row_number() OVER (PARTITION BY vec_id ORDER BY attn DESC, cell) AS r FROM cells))
    WHERE CASE WHEN kept >= 10 THEN attn > thr ELSE r <= greatest(10, n // 4) END
    UNION ALL
    SELECT vec_id + 1000000000, cell, round(attn, 6) FROM (
        SELECT vec_id, cell, attn, quantile_cont(attn, 0.75) OVER (PARTITION BY vec_id) AS thr FROM cells)
    WHERE attn > thr""", "cells"))
def foreground_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Two thresholds: a strict one that falls back to the best quarter, a usual one."""
    c = attn_rows(spark, sf)
    strict = ops.foreground_patches(c, "vec_id", "cell", "attn", 0.9)
    usual = ops.foreground_patches(c, "vec_id", "cell", "attn", 0.75)
    out = strict.unionByName(usual.withColumn("vec_id", F.col("vec_id") + 1_000_000_000))
    return out.select("vec_id", F.col("cell").cast("long").alias("cell"), F.round("attn", 6).alias("attn"))


@query("patch_reduction", sql("""
    SELECT count(*) AS before, count(*) FILTER (attn > thr) AS after,
           round(100.0::double * (1 - count(*) FILTER (attn > thr) / count(*)), 6) AS reduction_pct
    FROM (SELECT attn, quantile_cont(attn, 0.75) OVER (PARTITION BY vec_id) AS thr FROM cells)""", "cells"))
def patch_reduction(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    from tessera.operators.metrics import reduction
    thr = F.percentile("attn", 0.75).over(Window.partitionBy("vec_id"))
    out = reduction(attn_rows(spark, sf).withColumn("thr", thr), F.col("attn") > F.col("thr"))
    return out.withColumn("reduction_pct", F.round("reduction_pct", 6))


_STATS = """
    SELECT vec_id, label, list_avg(list_transform(a, lambda x: CASE WHEN x >= 0.2::double * greatest(list_max(a), 1e-12) THEN 1 ELSE 0 END)) AS fg_ratio,
           (list_max(a) - list_sort(a)[32]) / list_max(a) AS peakiness,
           -list_sum(list_transform(e, lambda x: x / list_sum(e) * ln(x / list_sum(e)))) / ln(64) AS entropy,
           list_max(a) / list_avg(a) AS max_over_mean
    FROM (SELECT vec_id, label, a, list_transform(a, lambda x: exp(x - list_max(a))) AS e FROM attn)"""


@query("attention_quality", sql("""
    SELECT vec_id, round(fg_ratio, 6) AS fg_ratio, round(peakiness, 6) AS peakiness, round(entropy, 6) AS entropy,
           round(max_over_mean, 6) AS max_over_mean,
           round(fg_ratio * peakiness * greatest(0.0::double, 1 - entropy), 8) AS quality, round(1 - fg_ratio, 6) AS background
    FROM st""", "attn", st=_STATS))
def attention_quality(spark: SparkSession, sf: str) -> DataFrame:
    d = attn(spark, sf).withColumn("s", ops.attention_stats(0.2)("a"))
    return d.select("vec_id", *[F.round(f"s.{m}", 6).alias(m) for m in (
        "fg_ratio", "peakiness", "entropy", "max_over_mean")],
        F.round(ops.quality_score(F.col("s")), 8).alias("quality"),
        F.round(1.0 - F.col("s.fg_ratio"), 6).alias("background"))


_GATE = dict(max_entropy=0.999, min_max_over_mean=2.6, min_peakiness=0.7, min_fg_ratio=0.7)
_REASON = """CASE WHEN round(entropy, 9) > 0.999::double THEN 'high_entropy_uniform'
    WHEN round(max_over_mean, 9) < 2.6::double THEN 'low_max_over_mean' WHEN round(peakiness, 9) < 0.7::double THEN 'low_peakiness'
    WHEN round(fg_ratio, 9) < 0.7::double THEN 'low_fg_ratio' ELSE 'ok' END"""


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    s = ops.attention_stats(0.2)("a")
    d = attn(spark, sf).withColumn("s", s)
    rounded = F.struct(*[F.round(F.col(f"s.{m}"), 9).alias(m) for m in (
        "fg_ratio", "peakiness", "entropy", "max_over_mean")])
    return d.withColumn("reason", ops.gate_reason(rounded, **_GATE))


@query("quality_gate", sql(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM st) GROUP BY 1",
                           "attn", st=_STATS))
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_FRACTION = """
    SELECT vec_id, split, label, q, passed, passed AND r <= least(pool, greatest(1, ceil(pool * 0.3::double))) AS kept FROM (
        SELECT *, row_number() OVER (PARTITION BY split, label, passed ORDER BY q DESC, md5(concat(cast(vec_id AS varchar), '|0'))) AS r,
               count(*) OVER (PARTITION BY split, label, passed) AS pool FROM (
            SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, label,
                   round(list_max(a), 6) AS q, list_max(a) >= 0.25 AS passed FROM attn))"""


def _fractions(spark: SparkSession, sf: str) -> DataFrame:
    d = attn(spark, sf).select(
        "vec_id", F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train").alias("split"), "label",
        F.round(F.array_max("a"), 6).alias("q"), (F.array_max("a") >= 0.25).alias("ok"))
    return sampling.flag_top_fraction(d, ["split", "label"], "q", "vec_id", 0.3, F.col("ok")).drop("ok")


@query("top_fraction", sql("SELECT vec_id, split, label, q FROM fr WHERE kept", "attn", fr=_FRACTION))
def top_fraction(spark: SparkSession, sf: str) -> DataFrame:
    d = attn(spark, sf).select(
        "vec_id", F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train").alias("split"), "label",
        F.round(F.array_max("a"), 6).alias("q"), (F.array_max("a") >= 0.25).alias("ok"))
    return sampling.top_fraction(d, ["split", "label"], "q", "vec_id", 0.3, F.col("ok")).drop("ok")


@query("gate_report", sql("""
    SELECT split, label, count(*) AS raw, count(*) FILTER (passed) AS pool, count(*) FILTER (NOT passed) AS rejected,
           count(*) FILTER (kept) AS kept FROM fr GROUP BY ROLLUP (split, label)""", "attn", fr=_FRACTION))
def gate_report(spark: SparkSession, sf: str) -> DataFrame:
    return ops.gate_report(_fractions(spark, sf), ["split", "label"])


@query("foreground_fraction", sql("""
    SELECT vec_id, round(len(list_filter(a, lambda x: x > 0.1::double)) / len(a), 6) AS above,
           round(len(list_filter(a, lambda x: x >= 0.2::double)) / len(a), 6) AS at_least FROM attn""", "attn"))
def foreground_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return attn(spark, sf).select("vec_id", F.round(ops.fraction_above(0.1)("a"), 6).alias("above"),
                                  F.round(ops.fraction_above(0.2, inclusive=True)("a"), 6).alias("at_least"))


@query("head_mean", sql("""
    SELECT vec_id // 4 AS grp, cell, round(avg(attn), 6) AS attn FROM cells GROUP BY 1, 2""", "cells"))
def head_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Four maps of a group play the heads of one entity."""
    rows = attn_rows(spark, sf).withColumn("grp", F.floor(F.col("vec_id") / 4))
    return ops.head_mean(rows, ["grp", "cell"], "attn").select(
        "grp", F.col("cell").cast("long").alias("cell"), F.round("attn", 6).alias("attn"))


@query("two_prompt_gate", sql("""
    SELECT vec_id, label, round(p, 6) AS p_first FROM (
        SELECT vec_id, label, 1 / (1 + exp(20 * (f[2] - f[1]))) AS p FROM patches) WHERE label <> 3 OR p >= 0.55""", "patches"))
def two_prompt_gate(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.classify import two_prompt_gate as gate
    p = patches(spark, sf).select("vec_id", "label", (F.col("f")[0] * 20).alias("a"), (F.col("f")[1] * 20).alias("b"))
    return gate(p, "label", 3, "a", "b").select("vec_id", "label", F.round("p_first", 6).alias("p_first"))


# --- grids and boxes ---------------------------------------------------------------------------

@query("grid_centrality", sql("""
    SELECT vec_id, cast(patch_id // 5 AS int) AS grid_row, cast(patch_id % 5 AS int) AS grid_col,
           round(sqrt((patch_id // 5 - 2) * (patch_id // 5 - 2) + (patch_id % 5 - 2) * (patch_id % 5 - 2)), 6) AS dist,
           round(1 / (1 + sqrt((patch_id // 5 - 2) * (patch_id // 5 - 2) + (patch_id % 5 - 2) * (patch_id % 5 - 2)) / 10), 6) AS central
    FROM patches""", "patches"))
def grid_centrality(spark: SparkSession, sf: str) -> DataFrame:
    return patches(spark, sf).select(
        "vec_id", grid.grid_row("patch_id", GRID).alias("grid_row"), grid.grid_col("patch_id", GRID).alias("grid_col"),
        F.round(grid.centre_distance("patch_id", GRID), 6).alias("dist"),
        F.round(grid.centrality("patch_id", GRID), 6).alias("central"))


def _smooth_sql(need: str) -> str:
    return f"""
    SELECT image_id, patch_id, cid, coalesce(CASE WHEN n >= {need} * 0.67::double THEN best END, cid) AS smoothed FROM (
        SELECT q.image_id, q.patch_id, q.cid, max(v.n) AS n, arg_min(v.ncid, -v.n * 1000 + v.ncid) AS best,
               sum(v.n) AS differ, any_value(t.alln) AS alln
        FROM patches q LEFT JOIN votes v ON v.vec_id = q.vec_id AND v.ncid <> q.cid
             LEFT JOIN (SELECT vec_id, sum(n) AS alln FROM votes GROUP BY 1) t ON t.vec_id = q.vec_id
        GROUP BY 1, 2, 3)"""


_VOTES = """
    SELECT a.vec_id, b.cid AS ncid, count(*) AS n FROM patches a JOIN patches b ON a.image_id = b.image_id
        AND a.vec_id <> b.vec_id AND abs(a.patch_id // 5 - b.patch_id // 5) <= 1 AND abs(a.patch_id % 5 - b.patch_id % 5) <= 1
    GROUP BY 1, 2"""


@query("majority_smoothing", sql(_smooth_sql("differ"), "patches", votes=_VOTES))
def majority_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    return ops.smooth_labels(patches(spark, sf), "image_id", "patch_id", "cid", GRID)


@query("majority_smoothing_all", sql(_smooth_sql("alln"), "patches", votes=_VOTES))
def majority_smoothing_all(spark: SparkSession, sf: str) -> DataFrame:
    return ops.smooth_labels(patches(spark, sf), "image_id", "patch_id", "cid", GRID, mode="majority")


@query("part_map", sql("""
    SELECT image_id, cast(patch_id // 5 AS int) AS grid_row, """ + ", ".join(
        f"max(cid) FILTER (patch_id % 5 = {c}) AS c{c}" for c in range(5)) + """
    FROM patches WHERE abs(f[1]) >= 0.05::double GROUP BY 1, 2""", "patches"))
def part_map(spark: SparkSession, sf: str) -> DataFrame:
    """Only foreground patches have a cell; the others stay NULL."""
    fg = patches(spark, sf).filter(F.abs(F.col("f")[0]) >= 0.05)
    return ops.part_map(fg, "image_id", "patch_id", "cid", GRID)


@query("square_box", sql("""
    SELECT vec_id, l, t, r2 AS r, b2 AS b FROM (
      SELECT *, least(64, l + side) AS r2, least(64, t + side) AS b2 FROM (
        SELECT vec_id, side, CASE WHEN r0 - l0 < side THEN greatest(0, r0 - side) ELSE l0 END AS l,
               CASE WHEN b0 - t0 < side THEN greatest(0, b0 - side) ELSE t0 END AS t FROM (
          SELECT *, least(64, l0 + side) AS r0, least(64, t0 + side) AS b0 FROM (
            SELECT vec_id, side, greatest(0, (x0 + x1) // 2 - side // 2) AS l0, greatest(0, (y0 + y1) // 2 - side // 2) AS t0 FROM (
              SELECT vec_id, min(cell % 8) * 8 AS x0, (max(cell % 8) + 1) * 8 AS x1, min(cell // 8) * 8 AS y0,
                     (max(cell // 8) + 1) * 8 AS y1,
                     cast(floor(greatest((max(cell % 8) + 1) * 8 - min(cell % 8) * 8,
                                         (max(cell // 8) + 1) * 8 - min(cell // 8) * 8) * 1.08::double) AS bigint) AS side
              FROM cells WHERE attn > 0.25::double GROUP BY 1)))))""", "cells"))
def square_box(spark: SparkSession, sf: str) -> DataFrame:
    """Square around the cells of high attention of an 8 x 8 map in a 64 pixel frame."""
    c = attn_rows(spark, sf).filter(F.col("attn") > 0.25).select(
        "vec_id", grid.grid_row("cell", 8).alias("r"), grid.grid_col("cell", 8).alias("c"))
    ext = c.groupBy("vec_id").agg(F.min("r").cast("long").alias("r0"), F.max("r").cast("long").alias("r1"),
                                  F.min("c").cast("long").alias("c0"), F.max("c").cast("long").alias("c1"))
    frame = F.lit(64).cast("long")
    box = grid.square_box(F.col("r0"), F.col("r1"), F.col("c0"), F.col("c1"), frame, frame, 8)
    return ext.select("vec_id", box.alias("box")).select("vec_id", "box.*")


@query("padded_box", """
    SELECT page_id, greatest(0, x - floor(w * 0.05::double)) AS l, greatest(0, y - floor(h * 0.05::double)) AS t,
           least(640, x + w + floor(w * 0.05::double)) AS r, least(480, y + h + floor(h * 0.05::double)) AS b
    FROM (SELECT page_id, length(url) % 60 AS x, length(html) % 60 AS y, 100 + length(html) % 540 AS w, 50 + length(url) * 7 % 420 AS h FROM pages)
    """.replace("greatest(0, x -", "cast(greatest(0, x -").replace("greatest(0, y -", "cast(greatest(0, y -")
       .replace("least(640,", "cast(least(640,").replace("least(480,", "cast(least(480,")
       .replace(") AS l", ") AS bigint) AS l").replace(") AS t,", ") AS bigint) AS t,")
       .replace(") AS r,", ") AS bigint) AS r,").replace(") AS b\n", ") AS bigint) AS b\n"))
def padded_box(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(
        "page_id", (F.length("url") % 60).cast("long").alias("x"), (F.length("html") % 60).cast("long").alias("y"),
        (100 + F.length("html") % 540).cast("long").alias("w"), (50 + F.length("url") * 7 % 420).cast("long").alias("h"))
    box = grid.padded_box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"),
                          F.lit(640).cast("long"), F.lit(480).cast("long"))
    return p.select("page_id", box.alias("box")).select("page_id", "box.*")


_PIXELS = """
    SELECT o_custkey AS image_id, cast(l_linenumber AS int) AS patch_id, l_quantity * 5 AS px
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query("patch_quality", sql("""
    SELECT image_id, patch_id, round(avg(px) / 255.0::double, 6) AS brightness, round(stddev_pop(px), 6) AS variance,
           round(1 / (1 + sqrt((patch_id // 3 - 1) * (patch_id // 3 - 1) + (patch_id % 3 - 1) * (patch_id % 3 - 1)) / 10.0::double), 6) AS central
    FROM px GROUP BY 1, 2""", px=_PIXELS))
def patch_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Line items of a customer play the pixels of its patches."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    px = (table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
          .select(F.col("o_custkey").alias("image_id"), F.col("l_linenumber").alias("patch_id"),
                  (F.col("l_quantity") * 5).alias("px")))
    q = ops.patch_quality(px, "image_id", "patch_id", "px")
    return q.select("image_id", "patch_id", F.round("brightness", 6).alias("brightness"),
                    F.round("variance", 6).alias("variance"), F.round(grid.centrality("patch_id", 3), 6).alias("central"))


# --- concepts ----------------------------------------------------------------------------------

@query("name_lookup", sql("""
    SELECT vec_id, p.cid, coalesce(CASE WHEN include AND label <> '' THEN label END, concat('cluster_', p.cid)) AS concept
    FROM (SELECT vec_id, cid FROM patches) p LEFT JOIN dict d ON p.cid = d.cid""", "patches", "dict"))
def name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = patches(spark, sf).select("vec_id", "cid")
    return concepts.name_clusters(rows, _small(spark, False), "cid").select("vec_id", "cid", "concept")


@query("label_rows", sql("""
    SELECT d.cid, label, confidence, n FROM dict d JOIN (SELECT cid, count(*) AS n FROM patches GROUP BY 1) USING (cid)
    WHERE include AND label <> ''""", "patches", "dict"))
def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = patches(spark, sf).groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    return _small(spark).select(F.col("key").cast("int").alias("cid"), "label", "confidence").join(n, "cid")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return concepts.concept_vectors(patches(spark, sf), _small(spark), "cid", "f")


@query("concept_vectors", sql("""
    SELECT cid, label AS concept, confidence, n, list(round(m / nm, 6) ORDER BY d) AS vector
    FROM cmean JOIN cnorm USING (cid) JOIN dict USING (cid)
         JOIN (SELECT cid, count(*) AS n FROM patches GROUP BY 1) USING (cid)
    WHERE include AND label <> '' GROUP BY 1, 2, 3, 4""", "cmean", "cnorm", "dict"))
def concept_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("cid", "concept", "confidence", "n", _r6("vector").alias("vector"))


@query("last_per_name", sql("""
    SELECT label AS concept, max(cid) AS cid, arg_max(n, cid) AS n
    FROM dict JOIN (SELECT cid, count(*) AS n FROM patches GROUP BY 1) USING (cid)
    WHERE include AND label <> '' GROUP BY 1""", "patches", "dict"))
def last_per_name(spark: SparkSession, sf: str) -> DataFrame:
    named = label_rows(spark, sf).select(F.col("label").alias("concept"), "cid", "n")
    return concepts.last_per_name(named, "concept", "cid")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return concepts.score_columns(patches(spark, sf), "image_id", "cid", CONCEPTS)


@query("concept_scores", sql("""
    SELECT image_id, coalesce(n_patches, 0) AS n_patches, round(coalesce(edge, 0), 6) AS edge,
           round(coalesce(core_1, 0), 6) AS core_1, round(coalesce(core_4, 0), 6) AS core_4
    FROM (SELECT DISTINCT vec_id // 20 AS image_id FROM embeddings) LEFT JOIN scores USING (image_id)""", "scores"))
def concept_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The entity table holds ids without sub-vectors: they score 0."""
    ids = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("image_id")).distinct()
    s = concepts.score_columns(patches(spark, sf), "image_id", "cid", CONCEPTS, ids)
    return s.select("image_id", "n_patches", *[F.round(c, 6).alias(c) for c in CONCEPTS])


@query("score_ranges", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS concept, round(min({c}), 6) AS min_score, round(max({c}), 6) AS max_score FROM scores"
    for c in CONCEPTS), "scores"))
def score_ranges(spark: SparkSession, sf: str) -> DataFrame:
    rows = concepts.score_rows(_scores(spark, sf), "image_id", list(CONCEPTS))
    return concepts.score_ranges(rows).select("concept", F.round("min_score", 6).alias("min_score"),
                                              F.round("max_score", 6).alias("max_score"))


@query("nearest_concept", sql("""
    SELECT vec_id, cast(patch_id // 5 AS int) AS grid_row, cast(patch_id % 5 AS int) AS grid_col,
           arg_min(cid, -sim) AS concept_id, round(max(sim), 6) AS similarity FROM csim GROUP BY 1, 2, 3""", "csim"))
def nearest_concept(spark: SparkSession, sf: str) -> DataFrame:
    out = nearest(patches(spark, sf), "f", _vectors(spark, sf), "cid", "concept_id")
    return out.select("vec_id", grid.grid_row("patch_id", GRID).alias("grid_row"),
                      grid.grid_col("patch_id", GRID).alias("grid_col"),
                      F.col("concept_id").cast("int").alias("concept_id"), F.round("similarity", 6).alias("similarity"))


@query("topk_cosine", sql("""
    SELECT image_id, cid, round(avg(sim), 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY image_id, cid ORDER BY sim DESC, vec_id) AS r FROM csim)
    WHERE r <= 10 GROUP BY 1, 2""", "csim"))
def topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    s = concepts.similarity_scores(patches(spark, sf), "image_id", "f", _vectors(spark, sf), "cid")
    return s.select("image_id", "cid", F.round("score", 6).alias("score"))


@query("max_cosine", sql("SELECT image_id, cid, round(max(sim), 6) AS score FROM csim GROUP BY 1, 2", "csim"))
def max_cosine(spark: SparkSession, sf: str) -> DataFrame:
    s = concepts.similarity_scores(patches(spark, sf), "image_id", "f", _vectors(spark, sf), "cid", how="max")
    return s.select("image_id", "cid", F.round("score", 6).alias("score"))


@query("activation_sentence", sql("""
    SELECT image_id, string_agg(replace(concept, '_', ' '), ', ' ORDER BY score DESC, concept) AS sentence FROM (
        SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, concept) AS r FROM (
            SELECT image_id, unnest(['edge', 'core_1', 'core_4']) AS concept,
                   unnest([round(edge, 6), round(core_1, 6), round(core_4, 6)]) AS score FROM scores) WHERE score > 0.15)
    WHERE r <= 2 GROUP BY 1""", "scores"))
def activation_sentence(spark: SparkSession, sf: str) -> DataFrame:
    rows = concepts.score_rows(_scores(spark, sf), "image_id", list(CONCEPTS)).withColumn("score", F.round("score", 6))
    return labelling.activation_sentence(rows, "image_id", 0.15, 2)


# --- label assistance --------------------------------------------------------------------------

@query("representatives", sql("""
    SELECT cid, vec_id, r AS rank, round(sim, 3) AS similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY cid ORDER BY sim DESC, vec_id) AS r FROM ownsim) WHERE r <= 10""", "ownsim"))
def representatives(spark: SparkSession, sf: str) -> DataFrame:
    return labelling.representatives(patches(spark, sf), ["cid"], "f", "vec_id")


@query("ranked_lookup", sql("""
    SELECT vec_id, cid, r AS rank, label FROM (
        SELECT *, row_number() OVER (PARTITION BY cid ORDER BY sim DESC, vec_id) AS r FROM ownsim)
    JOIN embeddings USING (vec_id) WHERE r <= 3""", "ownsim"))
def ranked_lookup(spark: SparkSession, sf: str) -> DataFrame:
    best = labelling.representatives(patches(spark, sf), ["cid"], "f", "vec_id", 3).drop("similarity")
    return labelling.ranked_lookup(best, table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")


_GOOD = "abs(f[7]) >= 0.02 AND abs(f[8]) >= 0.02"


@query("core_boundary", sql(f"""
    SELECT cid, vec_id, round(sim, 6) AS similarity, up AS rank, false AS is_boundary FROM g WHERE up <= 6
    UNION ALL SELECT cid, vec_id, round(sim, 6), down, true FROM g WHERE down <= 3 AND n > 6""", "ownsim",
    g=f"""SELECT o.*, row_number() OVER (PARTITION BY o.cid ORDER BY sim DESC, o.vec_id) AS up,
              row_number() OVER (PARTITION BY o.cid ORDER BY sim, o.vec_id DESC) AS down, count(*) OVER (PARTITION BY o.cid) AS n
          FROM ownsim o JOIN patches p ON o.vec_id = p.vec_id WHERE {_GOOD}"""))
def core_boundary(spark: SparkSession, sf: str) -> DataFrame:
    good = (F.abs(F.col("f")[6]) >= 0.02) & (F.abs(F.col("f")[7]) >= 0.02)
    out = labelling.core_and_boundary(patches(spark, sf), "cid", "f", "vec_id", 9, good)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("class_distribution", sql("""
    SELECT cid, n, """ + ", ".join(f"round(fr[{i + 1}], 6) AS frac_{i}" for i in range(10)) + """,
           cast(list_position(fr, list_max(fr)) - 1 AS varchar) AS dominant, list_max(fr) < 0.7 AS is_mixed
    FROM (SELECT cid, count(*) AS n, [""" + ", ".join(
        f"avg(CASE WHEN label = {i} THEN 1.0::double ELSE 0.0::double END)" for i in range(10)) + """] AS fr
          FROM patches GROUP BY 1)""", "patches"))
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    p = patches(spark, sf)
    classes = [r["label"] for r in p.select("label").distinct().orderBy("label").collect()]
    d = labelling.class_distribution(p, "cid", "label", classes)
    return d.select("cid", "n", *[F.round(f"frac_{i}", 6).alias(f"frac_{i}") for i in classes], "dominant", "is_mixed")


_DIST = """
    SELECT a.cid, 1 - (sum(cs) - 1) / count(*) AS distinctiveness,
           (1 - (sum(cs) - 1) / count(*)) * 0.6::double + least(any_value(nm) / 10.0::double, 1.0::double) * 0.4::double AS fg_score
    FROM (SELECT a.cid, b.cid AS other, sum(a.m * b.m) / any_value(na.nm) / any_value(nb.nm) AS cs, any_value(na.nm) AS nm
          FROM cmean a JOIN cmean b ON a.d = b.d JOIN cnorm na ON na.cid = a.cid JOIN cnorm nb ON nb.cid = b.cid GROUP BY 1, 2) a
    GROUP BY 1"""


def _distinct(spark: SparkSession, sf: str) -> DataFrame:
    return labelling.distinctiveness(mean_vectors(patches(spark, sf), ["cid"], "f"), "cid")


@query("distinctiveness", sql("SELECT cid, round(distinctiveness, 6) AS distinctiveness, round(fg_score, 6) AS fg_score FROM dd",
                              "cmean", "cnorm", dd=_DIST))
def distinctiveness(spark: SparkSession, sf: str) -> DataFrame:
    return _distinct(spark, sf).select("cid", F.round("distinctiveness", 6).alias("distinctiveness"),
                                       F.round("fg_score", 6).alias("fg_score"))


_SPATIAL = """SELECT k.cid, coalesce(m, 1.0::double) AS mean_distance FROM (SELECT cast(range AS int) AS cid FROM range(8)) k LEFT JOIN (
    SELECT cid, avg(sqrt((patch_id // 5 - 2) * (patch_id // 5 - 2) + (patch_id % 5 - 2) * (patch_id % 5 - 2))) AS m
    FROM patches GROUP BY 1) USING (cid)"""


def _ids(spark: SparkSession, n: int = 8) -> DataFrame:
    """All cluster ids of the model; two of them have no member."""
    return spark.range(n).select(F.col("id").cast("int").alias("cid"))


@query("cluster_spatial_mean", sql("SELECT cid, round(mean_distance, 6) AS mean_distance FROM sp", "patches", sp=_SPATIAL))
def cluster_spatial_mean(spark: SparkSession, sf: str) -> DataFrame:
    return labelling.spatial_means(patches(spark, sf), "cid", "patch_id", GRID, _ids(spark)).select(
        "cid", F.round("mean_distance", 6).alias("mean_distance"))


@query("keep_advice", sql("""
    SELECT cid, CASE WHEN round(fg_score, 6) > 0.5 AND mean_distance * 5 < 8 THEN 'part'
                     WHEN round(fg_score, 6) < 0.4 OR mean_distance * 5 > 12 THEN 'background' ELSE 'uncertain' END AS advice
    FROM dd JOIN sp USING (cid)""", "cmean", "cnorm", dd=_DIST, sp=_SPATIAL))
def keep_advice(spark: SparkSession, sf: str) -> DataFrame:
    sp = labelling.spatial_means(patches(spark, sf), "cid", "patch_id", GRID)
    d = _distinct(spark, sf).join(sp, "cid")
    return d.select("cid", bands.keep_advice(F.round("fg_score", 6), F.col("mean_distance") * 5).alias("advice"))


@query("cluster_sizes", sql("""
    SELECT k.cid, coalesce(n, 0) AS n, round(coalesce(n, 0) / t, 6) AS share, coalesce(n, 0) > 80 AS large_enough
    FROM (SELECT cast(range AS int) AS cid FROM range(8)) k LEFT JOIN (SELECT cid, count(*) AS n FROM patches GROUP BY 1) USING (cid),
         (SELECT count(*) AS t FROM patches)""", "patches"))
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return labelling.cluster_sizes(patches(spark, sf), "cid", _ids(spark), 80).withColumn("share", F.round("share", 6))


@query("cluster_order", sql("""
    SELECT cid, label, n, noise AS is_noise, row_number() OVER (ORDER BY noise, CASE WHEN NOT noise THEN lower(label) END, cid) AS position,
           min(CASE WHEN coalesce(label, '') = '' THEN cid END) OVER () AS next_unlabelled
    FROM (SELECT cid, label, n, lower(coalesce(label, '')) IN ('noise', 'background', 'bg', '—', '') AS noise
          FROM (SELECT cid, count(*) AS n FROM patches GROUP BY 1) LEFT JOIN dict USING (cid))""", "patches", "dict"))
def cluster_order(spark: SparkSession, sf: str) -> DataFrame:
    n = patches(spark, sf).groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    names = _small(spark, False).select(F.col("key").cast("int").alias("cid"), "label")
    return labelling.cluster_order(n.join(names, "cid", "left"), "cid")


@query("labelling_progress", sql("""
    SELECT count(*) AS clusters, count(*) FILTER (coalesce(label, '') <> '') AS labelled,
           round(count(*) FILTER (coalesce(label, '') <> '') / count(*), 6) AS progress
    FROM (SELECT DISTINCT cid FROM patches) LEFT JOIN dict USING (cid)""", "patches", "dict"))
def labelling_progress(spark: SparkSession, sf: str) -> DataFrame:
    ids = patches(spark, sf).select("cid").distinct()
    names = _small(spark, False).select(F.col("key").cast("int").alias("cid"), "label")
    named = F.coalesce(F.col("label"), F.lit("")) != ""
    return ids.join(names, "cid", "left").agg(F.count(F.lit(1)).alias("clusters"), F.count_if(named).alias("labelled"),
                                              F.round(F.avg(named.cast("double")), 6).alias("progress"))
