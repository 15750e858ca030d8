"""Published numbers: each literal is a known result of the operator."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import bands
from tessera.operators import metrics, prepare
from tessera.sources.settings import SURVEY_PANELS

VARIANTS = [("A", .0521, .8914, .3260), ("B", .0297, .8757, .2977), ("C", .0347, .8634, .2669), ("D", .0450, .9350, .3633)]


def test_panel_configuration():
    assert [len(p) for p in SURVEY_PANELS.panels.values()] == [14, 16, 4]
    assert len(SURVEY_PANELS.ranges) == 34


@pytest.mark.parametrize("feature, value, want", [
    ("LBXSGL", 285.0, 4.0), ("LBXHGB", 13.5, -.455), ("LBXTR", 368.0, 3.907), ("LBXSCR", 1.12, .733),
    ("LBXSNASI", 139.0, -.333), ("LBXSCR", 1.45, 1.833), ("LBXSGL", 88.0, .2)])
def test_deviation(spark, feature, value, want):
    df = spark.createDataFrame([(value,)], f"{feature} double")
    got = prepare.deviations(df, [feature], SURVEY_PANELS.ranges).first()[0]
    assert round(got, 3) == want


def test_pearson(spark):
    df = spark.createDataFrame(VARIANTS, "v string, sil double, pur double, nmi double")
    got = metrics.pearson(df, "sil", "pur").first()
    assert round(got["r"], 7) == .5585276 and round(got["p_value"], 4) == .4415


def test_pearson_p_matches_student_t(spark):
    # Two-sided p of r = .3 with n = 30, by integrating Student's density with 28
    # degrees of freedom beyond t = r * sqrt(28 / (1 - r * r)).
    t = np.linspace(0.3 * math.sqrt(28 / (1 - .09)), 200, 2_000_001)
    density = math.gamma(14.5) / (math.sqrt(28 * math.pi) * math.gamma(14)) * (1 + t * t / 28) ** -14.5
    want = 2 * np.trapezoid(density, t)
    df = spark.createDataFrame([(0.3, 30), (0.0, 10), (1.0, 5), (None, 5)], "r double, n long")
    got = [r[0] for r in df.select(metrics.pearson_p("r", "n")).collect()]
    assert got[0] == pytest.approx(want, abs=1e-8) and got[1] == pytest.approx(1.0)
    assert got[2] == pytest.approx(0.0) and got[3] is None


def test_variant_deltas(spark):
    df = spark.createDataFrame(VARIANTS, "variant string, sil double, pur double, nmi double")
    got = {r["variant"]: r for r in metrics.against_baseline(df, "variant", "A", ["sil", "nmi"]).collect()}
    assert [got[v]["delta_sil"] for v in "BCD"] == [.0224, .0174, .0071]
    assert got["D"]["delta_nmi"] == -.0373


def test_enrichment_identity(spark):
    """Base 2,242 of 18,673: a cluster with 19.1 % has 1.5906 times the base rate."""
    rows = [(i, 0 if i < 1000 else 1, 1 if (i < 191 or 1000 <= i < 3051) else 2, None) for i in range(18673)]
    df = spark.createDataFrame(rows, "id long, lipid int, diq int, hba1c double")
    got = {r["cluster_id"]: r for r in metrics.enrichment(df, ["lipid"], ["diq"], ["hba1c"], k=3).collect()}
    assert got[0]["diq_rate"] / got[0]["diq_enrichment"] == pytest.approx(.120066406, abs=1e-8)
    assert sum(r["n"] * (r["diq_rate"] or 0) for r in got.values()) == pytest.approx(2242)
    assert got[2]["n"] == 0 and got[2]["diq_rate"] is None and got[0]["mean_hba1c"] is None
    assert round(got[0]["diq_enrichment"], 4) == 1.5908


def test_report_macro_is_mean_of_classes(spark):
    rows = [("a", "a")] * 5 + [("a", "b")] * 5 + [("b", "b")] * 9 + [("b", "a")] + [("c", "a")] * 2
    got = {r["class"]: r for r in metrics.classification_report(
        spark.createDataFrame(rows, "t string, p string"), "t", "p").collect()}
    assert got["c"]["precision"] == 0 and got["c"]["recall"] == 0 and got["c"]["f1"] == 0
    assert got["a"]["precision"] == pytest.approx(5 / 8) and got["a"]["recall"] == .5
    assert got["macro avg"]["recall"] == pytest.approx((.5 + .9 + 0) / 3)
    assert got["accuracy"]["f1"] == pytest.approx(14 / 22) and got["accuracy"]["support"] == 22


def test_human_evaluation(spark):
    df = spark.range(50).select((F.col("id") < 43).cast("double").alias("ok"))
    assert df.agg(F.avg("ok")).first()[0] == .86


def test_chance_lift(spark):
    df = spark.createDataFrame([(i % 3, i % 3 if i < 150 else 0) for i in range(300)], "t int, p int")
    got = metrics.lift_over_chance(df, "t", "p").first()
    assert got["chance"] == pytest.approx(1 / 3) and got["lift"] == pytest.approx(got["accuracy"] - 1 / 3)


@pytest.mark.parametrize("dev, want", [(.74, "normal"), (.75, "mildly_high"), (2.0, "significantly_high"),
                                       (-.75, "mildly_low"), (-2.0, "significantly_low")])
def test_severity(spark, dev, want):
    assert spark.range(1).select(bands.severity_band(F.lit(dev))).first()[0] == want


def test_one_decimal_rounds_like_binary(spark):
    vals = [0.25, 0.35, -0.04, 0.05, 1234.56]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double").select(bands.one_decimal(F.col("v"))).collect()]
    assert got == [f"{v:.1f}" for v in vals]
    signed = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double").select(bands.one_decimal(F.col("v"), True)).collect()]
    assert signed == [f"{v:+.1f}" for v in vals]
    assert math.isclose(float(got[-1]), 1234.6)
