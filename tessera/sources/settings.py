"""Panel configuration and the frames derived from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.hashing import seeded_hash
from pyspark.sql import functions as F

# Survey measurements by panel (column: display name) and the
# standard adult reference interval of each measurement.
BLOOD_COUNT = {
    "LBXWBCSI": ("WBC (×10³/μL)", 4.5, 11.0),
    "LBXRBCSI": ("RBC (×10⁶/μL)", 4.0, 5.5),
    "LBXHGB": ("Hemoglobin (g/dL)", 12.0, 17.5),
    "LBXHCT": ("Hematocrit (%)", 36.0, 53.0),
    "LBXMCVSI": ("MCV (fL)", 80.0, 100.0),
    "LBXMCHSI": ("MCH (pg)", 27.0, 33.0),
    "LBXMC": ("MCHC (g/dL)", 33.0, 36.0),
    "LBXRDW": ("RDW (%)", 11.5, 14.5),
    "LBXPLTSI": ("Platelets (×10³/μL)", 150.0, 400.0),
    "LBXMPSI": ("MPV (fL)", 7.5, 12.5),
    "LBDLYMNO": ("Lymphocytes (×10³/μL)", 1.0, 4.8),
    "LBDMONO": ("Monocytes (×10³/μL)", 0.2, 0.8),
    "LBDEONO": ("Eosinophils (×10³/μL)", 0.0, 0.5),
    "LBDNENO": ("Neutrophils (×10³/μL)", 1.8, 7.7),
}
METABOLIC = {
    "LBXSGL": ("Glucose (mg/dL)", 70.0, 100.0),
    "LBXSBU": ("BUN (mg/dL)", 7.0, 20.0),
    "LBXSCR": ("Creatinine (mg/dL)", 0.6, 1.2),
    "LBXSNASI": ("Sodium (mEq/L)", 136.0, 145.0),
    "LBXSKSI": ("Potassium (mEq/L)", 3.5, 5.0),
    "LBXSCLSI": ("Chloride (mEq/L)", 98.0, 107.0),
    "LBXSC3SI": ("Bicarbonate (mEq/L)", 22.0, 29.0),
    "LBXSCA": ("Calcium (mg/dL)", 8.5, 10.5),
    "LBXSAL": ("Albumin (g/dL)", 3.4, 5.0),
    "LBXSTP": ("Total Protein (g/dL)", 6.3, 8.2),
    "LBXSGB": ("Globulin (g/dL)", 2.0, 3.5),
    "LBXSTB": ("Total Bilirubin (mg/dL)", 0.2, 1.2),
    "LBXSATSI": ("ALT (U/L)", 7.0, 56.0),
    "LBXSASSI": ("AST (U/L)", 10.0, 40.0),
    "LBXSAPSI": ("Alk Phosphatase (U/L)", 44.0, 147.0),
    "LBXSUA": ("Uric Acid (mg/dL)", 2.6, 7.2),
}
LIPID = {
    "LBXTC": ("Total Cholesterol (mg/dL)", 0.0, 200.0),
    "LBDHDD": ("HDL (mg/dL)", 40.0, 80.0),
    "LBDLDL": ("LDL (mg/dL)", 0.0, 100.0),
    "LBXTR": ("Triglycerides (mg/dL)", 0.0, 150.0),
}


@dataclass(frozen=True)
class PanelConfig:
    """Panels in order, each a map of feature -> (display name, lo, hi)."""

    panels: dict[str, dict[str, tuple[str, float | None, float | None]]]
    keys: tuple[str, ...] = ("record_id", "cycle_year")
    display: dict[str, str] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [f for p in self.panels.values() for f in p]

    @property
    def ranges(self) -> dict[str, tuple[float, float]]:
        return {f: (lo, hi) for p in self.panels.values()
                for f, (_, lo, hi) in p.items() if lo is not None and hi is not None}

    @property
    def labels(self) -> dict[str, str]:
        return {f: name for p in self.panels.values() for f, (name, _, _) in p.items()}


SURVEY_PANELS = PanelConfig(
    panels={"cbc": BLOOD_COUNT, "biochem": METABOLIC, "lipid": LIPID},
    display={"cbc": "Complete Blood Count", "biochem": "Basic Metabolic Panel",
             "lipid": "Lipid Panel"})


def feature_dimension(spark: SparkSession, cfg: PanelConfig) -> DataFrame:
    """One row per feature: panel, order, display name and reference range."""
    rows = [(panel, p, feature, i, name, lo, hi)
            for p, (panel, feats) in enumerate(cfg.panels.items())
            for i, (feature, (name, lo, hi)) in enumerate(feats.items())]
    return spark.createDataFrame(
        rows, "panel string, panel_idx int, feature string, ord int, "
              "display string, lo double, hi double")


def panel_order(dimension: DataFrame, seed: int | None = None) -> DataFrame:
    """Features in panel order; a seed permutes the panels, not their features.

    Adds ``panel_pos`` (new panel index) and ``col_pos`` (new column index). The
    frame has one row per configured feature, so one ordered pass is enough.
    """
    from pyspark.sql import Window

    key = F.col("panel_idx").cast("string") if seed is None else seeded_hash("panel", seed)
    by_panel = Window.orderBy("_k", "panel")
    return (dimension.withColumn("_k", key)
            .withColumn("panel_pos", (F.dense_rank().over(by_panel) - 1).cast("int"))
            .withColumn("col_pos", (F.row_number().over(Window.orderBy("_k", "panel", "ord")) - 1)
                        .cast("int"))
            .drop("_k"))
