"""Views over the test tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import argmax
from tessera.operators.prepare import deviations, impute, keep_complete, medians
from tessera.sources.tables import label_rows, outer_fold

PANELS = {"panel_a": ["n_orders", "avg_total", "max_total"],
          "panel_b": ["avg_qty", "avg_disc", "avg_tax", "avg_ext"]}
FEATURES = [f for fs in PANELS.values() for f in fs]
RANGES = {"n_orders": (1.0, 3.0), "avg_total": (100000.0, 250000.0),
          "avg_qty": (20.0, 30.0), "avg_disc": (0.03, 0.07)}
DISPLAY = {"n_orders": "Orders (count)", "avg_total": "Average total (USD)",
           "max_total": "Largest total (USD)", "avg_qty": "Quantity (units)",
           "avg_disc": "Discount (share)", "avg_tax": "Tax (share)", "avg_ext": "Price (USD)"}
KEYS = ["record_id", "cycle_year"]
GRID = 5
LABELS_JSON = ('{"0":{"label":"alpha: edge","include":true,"confidence":3,"notes":""},'
               '"1":{"label":"alpha: core","include":true},"2":{"label":" noise ","include":false},'
               '"3":{"label":"","include":true},"4":{"label":"alpha: core","include":true}}')


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _orders_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("_y"), F.col("o_custkey").alias("_c"))
            .agg(F.count(F.lit(1)).cast("double").alias("n_orders"),
                 F.avg("o_totalprice").alias("avg_total"), F.max("o_totalprice").alias("max_total")))


def _items_by_year(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf, "lineitem").select("l_orderkey", F.year("l_shipdate").alias("_y"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return (rows.groupBy("_y", F.col("o_custkey").alias("_c"))
            .agg(F.avg("l_quantity").alias("avg_qty"), F.avg("l_discount").alias("avg_disc"),
                 F.avg("l_tax").alias("avg_tax"), F.avg("l_extendedprice").alias("avg_ext")))


def _named(df: DataFrame, *more: Column) -> DataFrame:
    """Text keys from the numeric ones, after all grouping and joining."""
    return df.select(F.concat_ws("_", "_y", "_c").alias("record_id"), F.col("_y").cast("string").alias("cycle_year"),
                     *[c for c in df.columns if c not in ("_y", "_c")], *more)


def panel_a(spark: SparkSession, sf: str) -> DataFrame:
    return _named(_orders_by_year(spark, sf))


def panel_b(spark: SparkSession, sf: str) -> DataFrame:
    return _named(_items_by_year(spark, sf))


def lab(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    """Both panels merged; the join reuses the shuffles of the two aggregations. ``more`` columns may use the keys ``_y`` and ``_c``."""
    return _named(outer_fold([_orders_by_year(spark, sf), _items_by_year(spark, sf)], ["_y", "_c"]), *more)


def outcome_of(cust: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return cust.select(
        key.alias("custkey"),
        F.when(F.col("c_acctbal") < 0, 1).when(key % 10 == 3, 3).when(key % 10 == 7, None)
        .otherwise(2).alias("diq"),
        F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "HOUSEHOLD", None)
        .otherwise(2).alias("bpq"),
        F.when(key % 6 != 0, F.col("c_acctbal") / 1000.0).alias("hba1c"))


def with_outcomes(spark: SparkSession, sf: str, records: DataFrame) -> DataFrame:
    out = outcome_of(table(spark, sf, "customer"))
    key = F.split_part("record_id", F.lit("_"), F.lit(2)).cast("long")
    return records.withColumn("custkey", key).join(out, "custkey", "left").drop("custkey")


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return with_outcomes(spark, sf, lab(spark, sf).select("record_id"))


def kept(spark: SparkSession, sf: str) -> DataFrame:
    """Complete enough records; persisted, since fitting scans them several times."""
    return keep_complete(lab(spark, sf), FEATURES, 0.50).persist(StorageLevel.MEMORY_AND_DISK)


def filled(spark: SparkSession, sf: str) -> DataFrame:
    rows = kept(spark, sf)
    return impute(rows, FEATURES, medians(rows, FEATURES))


def dev(spark: SparkSession, sf: str) -> DataFrame:
    return deviations(filled(spark, sf), FEATURES, RANGES)


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    """Deviations with a rule-based cluster per panel: its highest deviation."""
    d = dev(spark, sf)
    for p, fs in PANELS.items():
        d = d.withColumn(p, argmax(F.array(*[F.round(f, 9) for f in fs])))
    return d


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """25 sub-vectors per image on a 5 x 5 grid with a rule-based cluster 0..5."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.floor(F.col("vec_id") / 25).alias("image_id"),
                    (F.col("vec_id") % 25).cast("int").alias("patch_id"), "label",
                    F.col("embedding").cast("array<double>").alias("f"),
                    argmax(F.slice("embedding", 1, 6)).alias("cid"))


def attn(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))


def attn_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per cell of each attention map."""
    return attn(spark, sf).select("vec_id", F.posexplode("a").alias("cell", "attn"))


def labels(spark: SparkSession, included_only: bool = True) -> DataFrame:
    return label_rows(spark.createDataFrame([(LABELS_JSON,)], "j string"), "j", included_only)


_SQL = {
    "panel_a": ([], """
        SELECT cast(year(o_orderdate) AS varchar) AS cycle_year,
               concat(cast(year(o_orderdate) AS varchar), '_', cast(o_custkey AS varchar)) AS record_id,
               cast(count(*) AS double) AS n_orders, avg(o_totalprice) AS avg_total,
               max(o_totalprice) AS max_total
        FROM orders GROUP BY 1, 2"""),
    "panel_b": ([], """
        SELECT cast(year(l_shipdate) AS varchar) AS cycle_year,
               concat(cast(year(l_shipdate) AS varchar), '_', cast(o_custkey AS varchar)) AS record_id,
               avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, avg(l_tax) AS avg_tax,
               avg(l_extendedprice) AS avg_ext
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""),
    "lab": (["panel_a", "panel_b"], """
        SELECT record_id, cycle_year, n_orders, avg_total, max_total, avg_qty, avg_disc, avg_tax, avg_ext
        FROM panel_a FULL OUTER JOIN panel_b USING (record_id, cycle_year)"""),
    "cust": ([], """
        SELECT c_custkey,
               CASE WHEN c_acctbal < 0 THEN 1 WHEN c_custkey % 10 = 3 THEN 3
                    WHEN c_custkey % 10 = 7 THEN NULL ELSE 2 END AS diq,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL
                    ELSE 2 END AS bpq,
               CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal / 1000.0 END AS hba1c
        FROM customer"""),
    "outcomes": (["lab", "cust"], """
        SELECT record_id, diq, bpq, hba1c FROM lab
        LEFT JOIN cust ON cast(split_part(record_id, '_', 2) AS bigint) = c_custkey"""),
    "kept": (["lab"], """
        SELECT * FROM lab WHERE (
            (CASE WHEN n_orders IS NULL THEN 0 ELSE 1 END) + (CASE WHEN avg_total IS NULL THEN 0 ELSE 1 END)
          + (CASE WHEN max_total IS NULL THEN 0 ELSE 1 END) + (CASE WHEN avg_qty IS NULL THEN 0 ELSE 1 END)
          + (CASE WHEN avg_disc IS NULL THEN 0 ELSE 1 END) + (CASE WHEN avg_tax IS NULL THEN 0 ELSE 1 END)
          + (CASE WHEN avg_ext IS NULL THEN 0 ELSE 1 END)) / cast(7 AS double) >= 0.5"""),
    "med": (["kept"], "SELECT " + ", ".join(f"median({f}) AS {f}" for f in FEATURES) + " FROM kept"),
    "filled": (["kept", "med"], "SELECT record_id, cycle_year, " + ", ".join(
        f"coalesce(k.{f}, med.{f}) AS {f}" for f in FEATURES) + " FROM kept k, med"),
    "zstat": (["filled"], "SELECT " + ", ".join(
        f"avg({f}) AS mu_{f}, greatest(stddev_pop({f}), 1e-6) AS sd_{f}"
        for f in FEATURES if f not in RANGES) + " FROM filled"),
    "dev": (["filled", "zstat"], "SELECT record_id, cycle_year, " + ", ".join(
        (f"least(greatest(({f} - {(RANGES[f][0] + RANGES[f][1]) / 2!r}::double)"
         f" / {max((RANGES[f][1] - RANGES[f][0]) / 2, 1e-6)!r}::double, -4.0::double), 4.0::double) AS {f}")
        if f in RANGES else
        f"least(greatest(({f} - mu_{f}) / sd_{f}, -4.0::double), 4.0::double) AS {f}"
        for f in FEATURES) + " FROM filled, zstat"),
    "clustered": (["dev"], "SELECT *, " + ", ".join(
        "cast(list_position([{0}], list_max([{0}])) - 1 AS int) AS {1}".format(
            ", ".join(f"round({f}, 9)" for f in fs), p) for p, fs in PANELS.items()) + " FROM dev"),
    "patches": ([], """
        SELECT vec_id, vec_id // 25 AS image_id, cast(vec_id % 25 AS int) AS patch_id, label,
               list_transform(embedding, lambda x: cast(x AS double)) AS f,
               cast(list_position(embedding[1:6], list_max(embedding[1:6])) - 1 AS int) AS cid
        FROM embeddings"""),
    "attn": ([], """
        SELECT vec_id, label, list_transform(embedding, lambda x: abs(cast(x AS double))) AS a
        FROM embeddings"""),
    "cells": (["attn"], """
        SELECT vec_id, unnest(generate_series(0, len(a) - 1)) AS cell, unnest(a) AS attn FROM attn"""),
    "dict": ([], """
        SELECT * FROM (VALUES (0, 'alpha: edge', true, 3), (1, 'alpha: core', true, 2),
            (2, 'noise', false, 2), (3, '', true, 2), (4, 'alpha: core', true, 2))
            AS t(cid, label, include, confidence)"""),
    # Sub-vectors in long form, and per-cluster mean vectors.
    "px": (["patches"], """
        SELECT vec_id, image_id, patch_id, label, cid,
               unnest(generate_series(1, len(f))) AS d, unnest(f) AS x FROM patches"""),
    "cmean": (["px"], "SELECT cid, d, avg(x) AS m FROM px GROUP BY 1, 2"),
    "cnorm": (["cmean"], "SELECT cid, sqrt(sum(m * m)) AS nm FROM cmean GROUP BY 1"),
    "pnorm": (["px"], "SELECT vec_id, sqrt(sum(x * x)) AS nx FROM px GROUP BY 1"),
    "ownsim": (["px", "cmean", "cnorm", "pnorm"], """
        SELECT p.vec_id, p.cid, sum(p.x * c.m) / (any_value(n.nm) * any_value(q.nx)) AS sim
        FROM px p JOIN cmean c ON p.cid = c.cid AND p.d = c.d JOIN cnorm n ON p.cid = n.cid
             JOIN pnorm q ON p.vec_id = q.vec_id
        GROUP BY 1, 2"""),
    # Cosine of every sub-vector to the named concepts' centres.
    "csim": (["px", "cmean", "cnorm", "pnorm", "dict"], """
        SELECT p.vec_id, p.image_id, p.patch_id, c.cid, sum(p.x * c.m) / (any_value(n.nm) * any_value(q.nx)) AS sim
        FROM px p JOIN cmean c ON p.d = c.d JOIN cnorm n ON c.cid = n.cid
             JOIN pnorm q ON p.vec_id = q.vec_id JOIN dict k ON k.cid = c.cid AND k.include AND k.label <> ''
        GROUP BY 1, 2, 3, 4"""),
    "scores": (["patches"], """
        SELECT image_id, count(*) AS n_patches,
               avg(CASE WHEN cid = 0 THEN 1.0::double ELSE 0.0::double END) AS edge,
               avg(CASE WHEN cid = 1 THEN 1.0::double ELSE 0.0::double END) AS core_1,
               avg(CASE WHEN cid = 4 THEN 1.0::double ELSE 0.0::double END) AS core_4
        FROM patches GROUP BY 1"""),
}


def sql(body: str, *views: str, **extra: str) -> str:
    """Prefix a query with the views it names (and theirs), then local ones."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in _SQL[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for v in views:
        visit(v)
    parts = [f"{n} AS ({_SQL[n][1].strip()})" for n in order]
    parts += [f"{n} AS ({q.strip()})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
