"""Queries over wide measurement records."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.fixtures import (DISPLAY, FEATURES, KEYS, PANELS, RANGES, clustered, dev, filled,
                                      kept, lab, outcomes, panel_a, panel_b, sql, table, with_outcomes)
from tessera.functions import bands
from tessera.operators import labelling, plan_rows, prepare, sampling
from tessera.operators.concepts import concept_profiles, cube_rows, melt
from tessera.operators.metrics import enrichment
from tessera.session import shared_folder
from tessera.sources import settings, sinks, tables

R6 = ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES)


def _rounded(df: DataFrame, columns=FEATURES, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- sources and joins -------------------------------------------------------------------------

@query("panel_outer_join", sql(f"SELECT record_id, cycle_year, {R6} FROM lab", "lab"))
def panel_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(lab(spark, sf))


def _scratch(spark: SparkSession) -> str:
    """New folder below the session's shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"


@query("cycle_load", sql("""
    SELECT record_id, cycle_year, round(avg_total, 6) AS avg_total, round(avg_qty, 6) AS avg_qty,
           c_nationkey AS nation, CASE WHEN cycle_year >= '1998' THEN diq END AS diq
    FROM lab LEFT JOIN cust ON cast(split_part(record_id, '_', 2) AS bigint) = cust.c_custkey
         LEFT JOIN customer ON customer.c_custkey = cust.c_custkey""", "lab", "cust"))
def cycle_load(spark: SparkSession, sf: str) -> DataFrame:
    """Panel files written per cycle (some missing), then read, merged and joined.

    The panels are spread to files by cycle in one write per panel.
    """
    root = _scratch(spark)
    number = F.split_part("record_id", F.lit("_"), F.lit(2)).cast("double")
    a = panel_a(spark, sf).withColumn("seqn", number)
    b = panel_b(spark, sf).withColumn("seqn", number)
    cust = table(spark, sf, "customer")
    base = (a.select("seqn", "cycle_year").union(b.select("seqn", "cycle_year")).distinct())
    demo = base.join(cust.select(F.col("c_custkey").cast("double").alias("seqn"),
                                 F.col("c_nationkey").alias("nation")), "seqn")
    from tessera.catalog.fixtures import outcome_of
    quest = (base.filter(F.col("cycle_year") >= "1998").withColumn("custkey", F.col("seqn").cast("long"))
             .join(outcome_of(cust), "custkey").select("seqn", "diq", "cycle_year"))
    for name, df in {"orders": a.select("seqn", "avg_total", "cycle_year"),
                     "items": b.select("seqn", "avg_qty", "cycle_year"),
                     "DEMO": demo, "DIQ": quest}.items():
        df.write.partitionBy("cycle_year").parquet(f"{root}/{name}")
    # A cycle's file of a panel is the partition folder of that cycle.
    bases = {"orders": "orders/cycle_year=", "items": "items/cycle_year=", "demographics": "DEMO/cycle_year="}
    years = [r["cycle_year"] for r in base.select("cycle_year").distinct().orderBy("cycle_year").collect()]
    cycles = [{"year": y, "suffix": y} for y in years]
    features = ["AVG_TOTAL", "AVG_QTY", "ABSENT"]
    lab_df, demo_df, val_df = tables.load_cycles(
        spark, cycles, root, bases, features, ["NATION"],
        {"diq": ("DIQ/cycle_year=", ["DIQ"])}, suffix="")
    out = tables.attach_context(lab_df, demo_df, val_df)
    return out.select(*KEYS, F.round("AVG_TOTAL", 6).alias("avg_total"),
                      F.round("AVG_QTY", 6).alias("avg_qty"), F.col("NATION").alias("nation"),
                      F.col("DIQ").alias("diq"))


@query("scoring_csv", sql(f"""
    SELECT record_id, round(avg_total, 4) AS avg_total, round(avg_qty, 4) AS avg_qty,
           cast(NULL AS double) AS absent FROM lab""", "lab"))
def scoring_csv(spark: SparkSession, sf: str) -> DataFrame:
    """CSV written with lower-case header and read back for scoring."""
    path = _scratch(spark)
    sinks.write_csv(lab(spark, sf).select("record_id", "avg_total", "avg_qty"), path)
    got = tables.read_scoring_csv(spark, path, ["AVG_TOTAL", "AVG_QTY", "ABSENT"])
    return got.select(F.col("RECORD_ID").alias("record_id"), F.round("AVG_TOTAL", 4).alias("avg_total"),
                      F.round("AVG_QTY", 4).alias("avg_qty"), F.col("ABSENT").alias("absent"))


@query("context_join", """
    WITH first AS MATERIALIZED (
        SELECT year(o_orderdate) AS y, o_custkey AS c, max(o_totalprice) AS m FROM orders GROUP BY 1, 2),
    second AS MATERIALIZED (
        SELECT DISTINCT year(l_shipdate) AS y, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    keys AS MATERIALIZED (
        SELECT coalesce(a.y, b.y) AS y, coalesce(a.c, b.c) AS c, a.m FROM first a FULL OUTER JOIN second b ON a.y = b.y AND a.c = b.c)
    SELECT concat(cast(y AS varchar), '_', cast(c AS varchar)) AS record_id, cast(y AS varchar) AS cycle_year, round(m, 4) AS first_total,
           CASE WHEN c_acctbal < 0 THEN 1 WHEN c_custkey % 10 = 3 THEN 3 WHEN c_custkey % 10 = 7 THEN NULL ELSE 2 END AS diq,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE 2 END AS bpq
    FROM keys LEFT JOIN customer ON c = c_custkey""")
def context_join(spark: SparkSession, sf: str) -> DataFrame:
    out = outcomes(spark, sf)
    val = tables.outer_fold([out.filter("diq is not null").select("record_id", "diq"),
                             out.filter("bpq is not null").select("record_id", "bpq")], ["record_id"])
    demo = panel_a(spark, sf).select(*KEYS, F.round("max_total", 4).alias("first_total"))
    return tables.attach_context(lab(spark, sf).select(*KEYS), demo, val)


@query("cycle_union", sql("""
    SELECT record_id, cycle_year, round(avg_total, 6) AS avg_total, cast(NULL AS double) AS avg_qty
    FROM panel_a WHERE cycle_year < '1998'
    UNION ALL SELECT record_id, cycle_year, NULL, round(avg_qty, 6) FROM panel_b WHERE cycle_year >= '1998'""",
    "panel_a", "panel_b"))
def cycle_union(spark: SparkSession, sf: str) -> DataFrame:
    early = tables.present(panel_a(spark, sf).filter("cycle_year < '1998'"), KEYS, ["avg_total", "avg_qty"])
    late = tables.present(panel_b(spark, sf).filter("cycle_year >= '1998'"), KEYS, ["avg_total", "avg_qty"])
    return _rounded(tables.stack_cycles([early, late]))


@query("fetch_manifest", sql("""
    SELECT c.year, b.base, concat(b.base, c.suffix, '.xpt') AS file_name,
           concat(rtrim(c.url_base, '/'), '/', b.base, c.suffix, '.xpt') AS url
    FROM cyc c, bases b""",
    cyc="""SELECT DISTINCT cast(year(o_orderdate) AS varchar) AS year,
                  concat('_', cast(year(o_orderdate) AS varchar)) AS suffix,
                  concat('https://example.org/', cast(year(o_orderdate) AS varchar), '//') AS url_base FROM orders""",
    bases="SELECT DISTINCT upper(event_type) AS base FROM events"))
def fetch_manifest(spark: SparkSession, sf: str) -> DataFrame:
    year = F.year("o_orderdate").cast("string")
    cycles = table(spark, sf, "orders").select(year.alias("year")).distinct().select(
        "year", F.concat(F.lit("_"), "year").alias("suffix"),
        F.concat(F.lit("https://example.org/"), "year", F.lit("//")).alias("url_base"))
    bases = table(spark, sf, "events").select(F.upper("event_type").alias("base")).distinct()
    return tables.fetch_manifest(cycles, bases)


@query("feature_dimension", sql("""
    SELECT d.panel, d.panel_idx, d.feature, d.ord, d.display, d.lo, d.hi, m.n_known, m.n_high
    FROM dims d JOIN m USING (feature)""", "lab",
    dims="SELECT * FROM (VALUES " + ", ".join(
        f"('{p}', {pi}, '{f}', {i}, '{DISPLAY[f]}', "
        + (f"{RANGES[f][0]!r}::double, {RANGES[f][1]!r}::double)" if f in RANGES else "NULL::double, NULL::double)")
        for pi, (p, fs) in enumerate(PANELS.items()) for i, f in enumerate(fs))
        + ") AS t(panel, panel_idx, feature, ord, display, lo, hi)",
    m=" UNION ALL ".join(
        f"SELECT '{f}' AS feature, count({f}) AS n_known, "
        + (f"cast(count(*) FILTER ({f} > {RANGES[f][1]}) AS bigint)" if f in RANGES else "cast(0 AS bigint)")
        + " AS n_high FROM lab" for f in FEATURES)))
def feature_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Configured features with what the records hold of them."""
    cfg = settings.PanelConfig({p: {f: (DISPLAY[f], *RANGES.get(f, (None, None))) for f in fs}
                                for p, fs in PANELS.items()})
    cells = [F.struct(F.lit(f).alias("feature"), F.count(f).alias("n_known"), (
        F.count_if(F.col(f) > RANGES[f][1]) if f in RANGES else F.lit(0).cast("long")).alias("n_high"))
        for f in FEATURES]
    seen = lab(spark, sf).agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return settings.feature_dimension(spark, cfg).join(seen, "feature")


@query("panel_order", sql("""
    SELECT panel, feature, cast(dense_rank() OVER (ORDER BY md5(concat(panel, '|7')), panel) - 1 AS int) AS panel_pos,
           cast(row_number() OVER (ORDER BY md5(concat(panel, '|7')), panel, feature) - 1 AS int) AS col_pos
    FROM d""", d="SELECT DISTINCT p_brand AS panel, p_type AS feature FROM part"))
def panel_order(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "part").select(F.col("p_brand").alias("panel"), F.col("p_type").alias("feature"),
                                        F.col("p_type").alias("ord"), F.lit(0).alias("panel_idx")).distinct()
    return settings.panel_order(d, 7).select("panel", "feature", "panel_pos", "col_pos")


@query("unseen_classes", """
    SELECT * FROM (SELECT DISTINCT event_type AS class_name FROM events
                   UNION SELECT DISTINCT concat(event_type, '_x') FROM events)
    EXCEPT SELECT DISTINCT event_type FROM events""")
def unseen_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Expected classes that the data lacks."""
    have = table(spark, sf, "events").select(F.col("event_type").alias("class_name")).distinct()
    want = have.union(have.select(F.concat("class_name", F.lit("_x")))).distinct()
    return want.exceptAll(have)


@query("bad_row_split", """
    WITH g AS (SELECT source, try_cast(nullif(regexp_extract(text, '[0-9]{1,9}', 0), '') AS int) AS num FROM documents)
    SELECT source, count(num) AS good, count(*) - count(num) AS bad FROM g GROUP BY 1""")
def bad_row_split(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose field cannot be read are counted apart, none stops the query."""
    num = F.expr("try_cast(nullif(regexp_extract(text, '[0-9]{1,9}', 0), '') AS int)")
    tagged = tables.split_bad_rows(table(spark, sf, "documents").select("source", num.alias("num")),
                                   F.col("num").isNotNull())
    return tagged.groupBy("source").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))


@query("upsert_results", """
    WITH old AS (SELECT event_type AS variant, count(*) AS n, round(avg(value), 4) AS score FROM events GROUP BY 1),
         new AS (SELECT CASE WHEN event_type >= 'm' THEN event_type ELSE concat(event_type, '_v2') END AS variant, count(*) AS n,
                        round(max(value), 4) AS score FROM events GROUP BY 1)
    SELECT * FROM old WHERE variant NOT IN (SELECT variant FROM new) UNION ALL SELECT * FROM new""")
def upsert_results(spark: SparkSession, sf: str) -> DataFrame:
    """Two reports of one table: some variants are measured again, others are new."""
    def report(name, score) -> DataFrame:
        return table(spark, sf, "events").groupBy(name.alias("variant")).agg(
            F.count(F.lit(1)).alias("n"), F.round(score, 4).alias("score"))
    kind = F.col("event_type")
    again = F.when(kind >= "m", kind).otherwise(F.concat(kind, F.lit("_v2")))
    return sinks.upsert(report(kind, F.avg("value")), report(again, F.max("value")), "variant")


# --- preparation and encoding ------------------------------------------------------------------

@query("valid_ratio_filter", sql("""
    SELECT record_id, round(((CASE WHEN n_orders IS NULL THEN 0 ELSE 3 END)
        + (CASE WHEN avg_qty IS NULL THEN 0 ELSE 4 END)) / cast(7 AS double), 6) AS ratio
    FROM lab WHERE ((CASE WHEN n_orders IS NULL THEN 0 ELSE 3 END)
        + (CASE WHEN avg_qty IS NULL THEN 0 ELSE 4 END)) / cast(7 AS double) >= 0.7""", "lab"))
def valid_ratio_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = prepare.keep_complete(lab(spark, sf), FEATURES, 0.70)
    return rows.select("record_id", F.round(prepare.valid_ratio(FEATURES), 6).alias("ratio"))


@query("median_impute", sql(f"""
    SELECT f.record_id, f.cycle_year, {", ".join(f"round(f.{c}, 6) AS {c}" for c in FEATURES)},
           cast(CASE WHEN k.n_orders IS NULL THEN 3 ELSE 0 END + CASE WHEN k.avg_qty IS NULL THEN 4 ELSE 0 END AS int)
           AS n_filled
    FROM filled f JOIN kept k USING (record_id, cycle_year)""", "filled"))
def median_impute(spark: SparkSession, sf: str) -> DataFrame:
    rows = kept(spark, sf)
    return _rounded(prepare.impute(rows, FEATURES, prepare.medians(rows, FEATURES), "n_filled"))


@query("scoring_impute", sql("""
    SELECT record_id, round(coalesce(l.n_orders, m.n_orders), 6) AS n_orders,
           round(coalesce(l.avg_qty, m.avg_qty), 6) AS avg_qty, round(m.avg_ext, 6) AS avg_ext
    FROM lab l, m WHERE cycle_year >= '2000'""", "lab",
    m="SELECT median(n_orders) AS n_orders, median(avg_qty) AS avg_qty, median(avg_ext) AS avg_ext "
      "FROM lab WHERE cycle_year < '2000'"))
def scoring_impute(spark: SparkSession, sf: str) -> DataFrame:
    """New records filled with training medians; a missing column is created."""
    rows, cols = lab(spark, sf).persist(StorageLevel.MEMORY_AND_DISK), ["n_orders", "avg_qty", "avg_ext"]
    train = prepare.medians(rows.filter("cycle_year < '2000'"), cols)
    new = rows.filter("cycle_year >= '2000'").select("record_id", "n_orders", "avg_qty")
    return _rounded(prepare.impute(new, cols, train))


@query("cycle_medians", sql(f"""
    SELECT cycle_year, {", ".join(f"round(median({f}), 6) AS {f}" for f in FEATURES)} FROM lab GROUP BY 1""", "lab"))
def cycle_medians(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(prepare.group_medians(lab(spark, sf).persist(StorageLevel.MEMORY_AND_DISK), FEATURES, ["cycle_year"]))


@query("cycle_counts", sql("SELECT cycle_year, count(*) AS n FROM lab GROUP BY 1", "lab"))
def cycle_counts(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.feature_counts(lab(spark, sf), ["cycle_year"])


@query("range_deviation", sql(f"SELECT record_id, cycle_year, {R6} FROM dev", "dev"))
def range_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(dev(spark, sf))


@query("zscore_transfer", """
    WITH first AS MATERIALIZED (
        SELECT year(o_orderdate) AS y, o_custkey AS c, max(o_totalprice) AS m FROM orders GROUP BY 1, 2),
    second AS MATERIALIZED (
        SELECT year(l_shipdate) AS y, o_custkey AS c, avg(l_tax) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    joined AS MATERIALIZED (
        SELECT coalesce(a.y, b.y) AS y, coalesce(a.c, b.c) AS c, m, t FROM first a FULL OUTER JOIN second b ON a.y = b.y AND a.c = b.c),
    st AS MATERIALIZED (SELECT avg(m) AS mu, greatest(stddev_pop(m), 1e-6) AS sd FROM joined WHERE y < 2000)
    SELECT concat(cast(y AS varchar), '_', cast(c AS varchar)) AS record_id,
           CASE WHEN m IS NOT NULL THEN round(least(greatest((m - mu) / sd, -4.0::double), 4.0::double), 6) END AS max_total,
           CASE WHEN t IS NOT NULL THEN round(least(greatest(t, -4.0::double), 4.0::double), 6) END AS avg_tax
    FROM joined CROSS JOIN st WHERE y >= 2000""")
def zscore_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics stored at fit, reused on new records; a feature unknown to the fit is kept."""
    rows = lab(spark, sf)
    stats = prepare.fallback_stats(rows.filter("cycle_year < '2000'"), ["max_total"], RANGES)
    new = rows.filter("cycle_year >= '2000'").select("record_id", "max_total", "avg_tax")
    return _rounded(prepare.deviations(new, ["max_total", "avg_tax"], RANGES, stats))


@query("robust_scale", sql(f"""
    SELECT record_id, {", ".join(f"round(({f} - q_{f}[2]) / CASE WHEN q_{f}[3] = q_{f}[1] THEN 1 ELSE q_{f}[3] - q_{f}[1] END, 6) AS {f}" for f in FEATURES)}
    FROM lab, q""", "lab",
    q="SELECT " + ", ".join(f"quantile_cont({f}, [0.25, 0.5, 0.75]) AS q_{f}" for f in FEATURES) + " FROM lab"))
def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = lab(spark, sf).drop("cycle_year").persist(StorageLevel.MEMORY_AND_DISK)
    return _rounded(prepare.robust_scale(rows, FEATURES))


@query("range_flag", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN ' (HIGH)' WHEN l_quantity < 10 THEN ' (LOW)' ELSE '' END AS qty_flag,
           CASE WHEN l_discount > 0.07::double THEN ' (HIGH)' WHEN l_discount < 0.03::double THEN ' (LOW)' ELSE '' END AS disc_flag
    FROM lineitem""")
def range_flag(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", bands.range_flag("l_quantity", 10.0, 40.0).alias("qty_flag"),
        bands.range_flag("l_discount", 0.03, 0.07).alias("disc_flag"))


def _sentence_sql() -> str:
    parts = []
    for f in FEATURES:
        flag = (f"CASE WHEN {f} > {RANGES[f][1]!r}::double THEN ' (HIGH)' "
                f"WHEN {f} < {RANGES[f][0]!r}::double THEN ' (LOW)' ELSE '' END") if f in RANGES else "''"
        parts.append(f"CASE WHEN {f} IS NOT NULL THEN concat('{DISPLAY[f]}: ', printf('%.1f', {f}), {flag}) END")
    return f"SELECT record_id, concat_ws('. ', {', '.join(parts)}) AS sentence FROM r"


@query("record_sentence", sql(_sentence_sql(), "lab", r="SELECT record_id, " + ", ".join(
    f"round({f}, 3) AS {f}" for f in FEATURES) + " FROM lab"))
def record_sentence(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rounded(lab(spark, sf), places=3)
    return rows.select("record_id", prepare.record_sentence(FEATURES, DISPLAY, RANGES).alias("sentence"))


@query("deviation_bands", sql("""
    SELECT record_id,
           CASE WHEN abs(d) < 0.75 THEN 'normal' WHEN d >= 2 THEN 'significantly_high' WHEN d >= 0.75 THEN 'mildly_high'
                WHEN d <= -2 THEN 'significantly_low' ELSE 'mildly_low' END AS severity,
           CASE WHEN d IS NULL THEN '' WHEN abs(d) < 1 THEN 'green' WHEN abs(d) < 2 THEN 'amber' ELSE 'red' END AS colour,
           CASE WHEN d > 0.3 THEN 'strong' WHEN d > 0.1 THEN 'partial' ELSE 'weak' END AS signal,
           d > 0.05 AS active,
           CASE WHEN d < -0.5 THEN 'not_target' WHEN d > 0.5 THEN 'target' ELSE 'neutral' END AS push
    FROM r""", "dev", r="SELECT record_id, round(avg_qty, 6) AS d FROM dev"))
def deviation_bands(spark: SparkSession, sf: str) -> DataFrame:
    d = dev(spark, sf).select("record_id", F.round("avg_qty", 6).alias("d"))
    return d.select("record_id", bands.severity_band("d").alias("severity"), bands.colour_band("d").alias("colour"),
                    bands.signal_band("d").alias("signal"), bands.is_active("d").alias("active"),
                    bands.push_label("d").alias("push"))


@query("display_names", """
    SELECT p_partkey, trim(split_part(concat(p_type, ' (', p_brand, ')'), ' (', 1)) AS short_name,
           upper(substr(trim(p_brand), 1, 6)) AS code,
           replace(concat(p_brand, '_', p_size), '_', ' ') AS spaced
    FROM part""")
def display_names(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf, "part").select(
        "p_partkey", bands.short_name(label).alias("short_name"),
        F.upper(F.substring(F.trim("p_brand"), 1, 6)).alias("code"),
        F.replace(F.concat_ws("_", "p_brand", "p_size"), F.lit("_"), F.lit(" ")).alias("spaced"))


@query("cube_rows", sql("""
    SELECT record_id, 0 AS panel_idx, 'panel_a' AS panel, [round(n_orders, 6), round(avg_total, 6), round(max_total, 6)] AS vector FROM filled
    UNION ALL SELECT record_id, 1, 'panel_b', [round(avg_qty, 6), round(avg_disc, 6), round(avg_tax, 6), round(avg_ext, 6)] FROM filled""",
    "filled"))
def cube(spark: SparkSession, sf: str) -> DataFrame:
    return cube_rows(_rounded(filled(spark, sf)), "record_id", PANELS)


@query("feature_melt", sql("""
    SELECT record_id, feature, round(value, 6) AS value FROM (
        SELECT record_id, unnest(['n_orders', 'avg_qty', 'avg_tax']) AS feature,
               unnest([n_orders, avg_qty, avg_tax]) AS value FROM lab)""", "lab"))
def feature_melt(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(melt(lab(spark, sf), ["record_id"], ["n_orders", "avg_qty", "avg_tax"]), ["value"])


# --- outcomes, splits and selections -----------------------------------------------------------

_THREE = """CASE WHEN diq IS NOT DISTINCT FROM 1 THEN 0 WHEN bpq IS NOT DISTINCT FROM 1 THEN 1
                 WHEN diq IS NOT DISTINCT FROM 2 AND bpq IS NOT DISTINCT FROM 2 THEN 2 ELSE -1 END"""


def _three_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = outcomes(spark, sf).withColumn("y", bands.three_class_outcome("diq", "bpq"))
    return rows.filter("y >= 0").select("record_id", "y").persist(StorageLevel.MEMORY_AND_DISK)


_Y = f"SELECT record_id, y FROM (SELECT record_id, {_THREE} AS y FROM outcomes) WHERE y >= 0"


@query("outcome_three_class", sql("SELECT record_id, y FROM ys", "outcomes", ys=_Y))
def outcome_three_class(spark: SparkSession, sf: str) -> DataFrame:
    return _three_class(spark, sf)


@query("outcome_binary", sql("""
    SELECT y, count(*) AS n, count(*) > 100 AS enough FROM (
        SELECT CASE WHEN diq IS NOT DISTINCT FROM 1 THEN 1 WHEN diq IS NOT DISTINCT FROM 2 THEN 0 ELSE -1 END AS y
        FROM outcomes) WHERE y >= 0 GROUP BY 1""", "outcomes"))
def outcome_binary(spark: SparkSession, sf: str) -> DataFrame:
    y = outcomes(spark, sf).select(bands.binary_outcome("diq").alias("y")).filter("y >= 0")
    return y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).withColumn("enough", F.col("n") > 100)


@query("class_cap_sample", sql("""
    SELECT record_id, y FROM (
        SELECT record_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(concat(record_id, '|42'))) AS r FROM ys),
        cap WHERE r <= c""", "outcomes", ys=_Y,
    cap="SELECT least(3 * min(n), max(n)) AS c FROM (SELECT y, count(*) AS n FROM ys GROUP BY 1)"))
def class_cap_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.class_cap(_three_class(spark, sf), "y", "record_id", 42)


@query("stratified_split", sql("""
    SELECT record_id, y, r <= round(0.2::double * n) AS is_test FROM (
        SELECT record_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(concat(record_id, '|42'))) AS r,
               count(*) OVER (PARTITION BY y) AS n FROM ys)""", "outcomes", ys=_Y))
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_split(_three_class(spark, sf), "y", "record_id", 42)


@query("random_split", """
    SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat(cast(o_orderkey AS varchar), '|42')))
           <= floor(0.2::double * count(*) OVER ()) AS is_val FROM orders""")
def random_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.random_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 42)


@query("every_nth_split", """
    SELECT o_orderkey, o_orderstatus, pos, CASE WHEN pos % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM (
        SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus
               ORDER BY md5(concat(cast(o_orderkey AS varchar), '|0'))) - 1 AS pos FROM orders)""")
def every_nth_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.every_nth_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"),
                                    "o_orderstatus", "o_orderkey")


@query("class_pull", """
    SELECT o_orderkey, o_orderstatus, pos, CASE WHEN pos % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM (
        SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS pos
        FROM orders WHERE o_totalprice > 1000) WHERE pos < 1500""")
def class_pull(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sampling.first_per_class(rows, "o_orderstatus", "o_orderkey", 1500,
                                    F.col("o_totalprice") > 1000).drop("o_totalprice")


@query("gated_candidates", """
    SELECT o_orderkey, o_orderstatus, rank FROM (
        SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS c FROM orders)
        WHERE c <= 300 AND o_totalprice > 100000) WHERE rank <= 100""")
def gated_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sampling.gated_candidates(rows, "o_orderstatus", "o_orderkey", 100,
                                     F.col("o_totalprice") > 100000).drop("o_totalprice")


@query("class_sample", """
    SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank
    FROM documents WHERE n_chars > 200) WHERE rank <= 5""")
def class_sample(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.ordering import top_k
    docs = table(spark, sf, "documents").filter("n_chars > 200").select("doc_id", "lang")
    return top_k(docs, ["lang"], [F.col("doc_id")], 5)


# --- cluster description -----------------------------------------------------------------------

def _enrich_sql() -> str:
    rate = "avg(CASE WHEN {0} IS NOT DISTINCT FROM 1 THEN 1.0::double ELSE 0.0::double END)"
    return f"""
    SELECT panel, cluster_id, n, round(dr, 6) AS diq_rate, round(br, 6) AS bpq_rate, round(h, 6) AS mean_hba1c,
           round(dr / d0, 6) AS diq_enrichment, round(br / b0, 6) AS bpq_enrichment,
           CASE WHEN greatest(dr / d0, br / b0) >= 2 THEN 'HIGH' ELSE '' END AS flag
    FROM (SELECT panel, cluster_id, count(*) AS n, {rate.format('diq')} AS dr, {rate.format('bpq')} AS br,
                 avg(hba1c) AS h
          FROM (SELECT 'panel_a' AS panel, panel_a AS cluster_id, record_id FROM clustered
                UNION ALL SELECT 'panel_b', panel_b, record_id FROM clustered) JOIN outcomes USING (record_id)
          GROUP BY 1, 2),
         (SELECT {rate.format('diq')} AS d0, {rate.format('bpq')} AS b0 FROM clustered JOIN outcomes USING (record_id))"""


def _enrichment(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_outcomes(spark, sf, clustered(spark, sf).select("record_id", *PANELS))
    return enrichment(rows, list(PANELS), ["diq", "bpq"], ["hba1c"])


@query("cluster_enrichment", sql(_enrich_sql(), "clustered", "outcomes"))
def cluster_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    e = _enrichment(spark, sf)
    return e.select("panel", "cluster_id", "n", *[F.round(c, 6).alias(c) for c in (
        "diq_rate", "bpq_rate", "mean_hba1c", "diq_enrichment", "bpq_enrichment")], "flag")


@query("top_enrichment", f"""
    SELECT panel, cluster_id, diq_enrichment FROM ({sql(_enrich_sql(), "clustered", "outcomes")})
    ORDER BY diq_enrichment DESC, panel, cluster_id LIMIT 1""")
def top_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    e = _enrichment(spark, sf)
    return (e.orderBy(F.round("diq_enrichment", 6).desc(), "panel", "cluster_id").limit(1)
            .select("panel", "cluster_id", F.round("diq_enrichment", 6).alias("diq_enrichment")))


@query("concept_profiles", sql(f"""
    SELECT panel_b, count(*) AS n, {", ".join(f"round(avg({f}), 6) AS {f}" for f in FEATURES)}
    FROM clustered GROUP BY 1""", "clustered"))
def profiles(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(concept_profiles(clustered(spark, sf), ["panel_b"], FEATURES))


_PROFILE = """
    SELECT m.panel_b, m.n_records, m.ord, m.code, m.label, round(m.d, 2) AS deviation, round(m.d - p.d, 2) AS vs_pop,
           CASE WHEN abs(m.d) < 0.75 THEN 'normal' WHEN m.d >= 2 THEN 'significantly_high' WHEN m.d >= 0.75 THEN 'mildly_high'
                WHEN m.d <= -2 THEN 'significantly_low' ELSE 'mildly_low' END AS band
    FROM m JOIN p USING (code)"""
_PROFILE_VIEWS = {
    "m": " UNION ALL ".join(
        f"SELECT panel_b, count(*) AS n_records, {i} AS ord, '{f}' AS code, "
        f"'{DISPLAY[f].split(' (')[0]}' AS label, avg({f}) AS d FROM clustered GROUP BY 1"
        for i, f in enumerate(FEATURES)),
    "p": " UNION ALL ".join(f"SELECT '{f}' AS code, avg({f}) AS d FROM clustered" for f in FEATURES),
}


@query("cluster_profile", sql(_PROFILE, "clustered", **_PROFILE_VIEWS))
def cluster_profile(spark: SparkSession, sf: str) -> DataFrame:
    return labelling.deviation_profile(clustered(spark, sf), "panel_b", FEATURES, DISPLAY)


def _text_sql() -> str:
    line = "concat('    • ', label, '  (deviation ', printf('%+.1f', deviation), ' from normal midpoint)')"
    sections = ", ".join(
        f"(SELECT '  {head}:' || chr(10) || string_agg({line}, chr(10) ORDER BY -abs(deviation), ord) "
        f"FROM pr WHERE pr.panel_b = g.panel_b AND band = '{band}')"
        for band, head in labelling.SECTIONS.items())
    return f"""SELECT panel_b, concat_ws(chr(10), concat('Cluster of ', n_records,
               ' patients with the following lab pattern:', chr(10)), {sections},
               (SELECT chr(10) || '  WITHIN NORMAL RANGE: ' ||
                       array_to_string((list(label ORDER BY ord))[1:6], ', ')
                       || CASE WHEN count(*) > 6 THEN ', +' || (count(*) - 6) || ' more' ELSE '' END
                FROM pr WHERE pr.panel_b = g.panel_b AND band = 'normal' HAVING count(*) > 0)) AS profile
               FROM (SELECT DISTINCT panel_b, n_records FROM pr) g"""


@query("profile_text", sql(_text_sql(), "clustered", **_PROFILE_VIEWS, pr=_PROFILE))
def profile_text(spark: SparkSession, sf: str) -> DataFrame:
    return labelling.profile_text(cluster_profile(spark, sf), "panel_b")


def _prompt_sql() -> str:
    keys = ", ".join(labelling.ANSWER_KEYS)
    head, tail = labelling.PROMPT_HEAD.replace("'", "''"), (labelling.PROMPT_TAIL + keys + ".").replace("'", "''")
    return f"SELECT panel_b, concat('{head}', profile, '{tail}') AS prompt FROM tx"


@query("label_prompt", sql(_prompt_sql(), "clustered", **_PROFILE_VIEWS, pr=_PROFILE, tx=_text_sql()))
def label_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return profile_text(spark, sf).select("panel_b", labelling.label_prompt().alias("prompt"))


# --- training-sample plans ---------------------------------------------------------------------

_PICK = "CASE WHEN ('0x' || substr(md5(concat(record_id, '|{0}')), 1, 8))::bigint % 2 = 0 THEN 'panel_a' ELSE 'panel_b' END"


@query("mask_plan", sql("""
    SELECT record_id, panel, feature, round(target, 6) AS target FROM (
        SELECT record_id, panel, feature, target, row_number() OVER (PARTITION BY record_id
               ORDER BY md5(concat(record_id, '|', feature, '|11'))) AS r FROM c JOIN pick USING (record_id, panel))
    WHERE r <= 1""", "dev",
    pick=f"SELECT record_id, {_PICK.format('11p')} AS panel FROM dev",
    c=" UNION ALL ".join(f"SELECT record_id, '{p}' AS panel, '{f}' AS feature, {f} AS target FROM dev"
                         for p, fs in PANELS.items() for f in fs)))
def mask_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(plan_rows.masked_features(dev(spark, sf), "record_id", PANELS, 11), ["target"])


@query("panel_dropout", sql("""
    SELECT record_id, panel, round(CASE WHEN panel = 'panel_a' THEN (n_orders + avg_total + max_total) / 3
           ELSE (avg_qty + avg_disc + avg_tax + avg_ext) / 4 END, 6) AS target FROM dev JOIN pick USING (record_id)""",
    "dev", pick=f"SELECT record_id, {_PICK.format('11d')} AS panel FROM dev"))
def panel_dropout(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(plan_rows.dropped_panel(dev(spark, sf), "record_id", PANELS, 11), ["target"])


@query("augment_plan", """
    SELECT page_id, url, -1 AS variant, cast(NULL AS bigint) AS seed, url AS out_name FROM p
    UNION ALL SELECT page_id, url, v, 42 + pos * 1000 + v * 17,
           concat(regexp_replace(url, '\\.[^.]*$', ''), '_aug', v + 1, lower(regexp_extract(url, '(\\.[^.]*)$', 1)))
    FROM p, (SELECT cast(range AS int) AS v FROM range(3))""".replace("FROM p\n", "FROM (SELECT page_id, url FROM pages) p\n")
       .replace("FROM p,", "FROM (SELECT page_id, url, row_number() OVER (ORDER BY md5(concat(cast(page_id AS varchar), '|0'))) AS pos FROM pages) p,"))
def augment_plan(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.ordering import hash_buckets, rank_rows
    pages = table(spark, sf, "pages").select("page_id", "url")
    numbered = rank_rows(hash_buckets(pages, "page_id", 0), [], "pos")
    return plan_rows.augmentation_plan(numbered, "pos", "url", 3, 42).drop("pos")
