"""Plans of masked training samples and of augmentation variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import seeded_hash, seeded_pick


def _panel_cells(df: DataFrame, key: str, panels: Mapping[str, Sequence[str]], pick: Column) -> DataFrame:
    """Features of the picked panel as an array of (feature, value)."""
    chosen = None
    for i, (panel, cols) in enumerate(panels.items()):
        cells = F.struct(F.lit(panel).alias("panel"), F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("target"))
            for c in cols]).alias("cells"))
        chosen = F.when(pick == i, cells) if chosen is None else chosen.when(pick == i, cells)
    return df.select(key, chosen.alias("_p")).select(key, "_p.panel", "_p.cells")


def masked_features(df: DataFrame, key: str, panels: Mapping[str, Sequence[str]], seed: int | str,
                    share: float = 0.4) -> DataFrame:
    """Per record one panel and a random ``max(1, int(share * size))`` of its features.

    All choices depend on hashes of the record alone, so nothing is shuffled.
    """
    rows = _panel_cells(df, key, panels, seeded_pick(key, f"{seed}p", len(panels)))
    keyed = F.array_sort(F.transform("cells", lambda c: F.struct(
        seeded_hash(F.concat_ws("|", F.col(key).cast("string"), c["feature"]), seed).alias("h"),
        c["feature"].alias("feature"), c["target"].alias("target"))))
    n = F.greatest(F.lit(1), F.floor(F.size("cells") * F.lit(share)).cast("int"))
    return (rows.select(key, "panel", F.explode(F.slice(keyed, F.lit(1), n)).alias("m"))
            .select(key, "panel", "m.feature", "m.target"))


def dropped_panel(df: DataFrame, key: str, panels: Mapping[str, Sequence[str]], seed: int | str) -> DataFrame:
    """Per record one whole panel to hide; the target is its mean value."""
    rows = _panel_cells(df, key, panels, seeded_pick(key, f"{seed}d", len(panels)))
    known = F.filter(F.transform("cells", lambda c: c["target"]), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x) / F.size(known)
    return rows.select(key, "panel", F.when(F.size(known) > 0, mean).alias("target"))


def augmentation_plan(df: DataFrame, position: str, name: str, variants: int, seed: int) -> DataFrame:
    """Each source row with one row per variant: derived seed and file name.

    ``position`` numbers the source rows from 1.
    """
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    original = F.struct(F.lit(-1).alias("variant"), F.lit(None).cast("long").alias("seed"),
                        F.col(name).alias("out_name"))
    made = F.transform(F.sequence(F.lit(0), F.lit(variants - 1)), lambda v: F.struct(
        v.alias("variant"), (F.lit(seed) + F.col(position) * 1000 + v * 17).cast("long").alias("seed"),
        F.concat(stem, F.lit("_aug"), (v + 1).cast("string"), suffix).alias("out_name")))
    return (df.withColumn("_v", F.explode(F.concat(F.array(original), made)))
            .select(*df.columns, "_v.*"))
