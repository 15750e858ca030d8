"""Concept discovery and scoring of wide measurement records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.classify import LinearModel, fit_linear
from tessera.operators.clustering import (DiagonalMixture, FeaturePrep, fit_panels, load_mixture,
                                          save_mixture)
from tessera.operators.concepts import cube_rows
from tessera.operators.prepare import (deviation_column, deviations, fallback_stats, impute,
                                       keep_complete, medians, stats_map)


@dataclass
class RecordScorer:
    """Everything needed to score records: fitted parameters only, no data.

    ``apply`` is one chain of projections: impute with the training medians, encode
    deviations, compute every panel's membership, classify. Nothing is shuffled or
    joined, so it serves batches and streams alike.
    """

    panels: dict[str, list[str]]
    ranges: dict[str, tuple[float, float]]
    fills: dict[str, float]
    stats: dict[str, tuple[float, float]]
    models: dict[str, tuple[FeaturePrep, DiagonalMixture]]
    names: dict[str, str] = field(default_factory=dict)
    linear: LinearModel | None = None

    @property
    def features(self) -> list[str]:
        return [f for fs in self.panels.values() for f in fs]

    def concept_names(self) -> list[str]:
        """``panel: label`` of every membership, in score order."""
        return [f"{p}: {self.names.get(f'{p}:{c}') or f'cluster_{c}'}"
                for p, (_, mix) in self.models.items() for c in range(mix.k)]

    def score_columns(self) -> list[str]:
        return [f"{p}_{c}" for p, (_, mix) in self.models.items() for c in range(mix.k)]

    def _encode(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        filled = df.select(*[c for c in df.columns if c not in self.features], *[
            (F.coalesce(F.col(f).cast("double"), F.lit(self.fills[f])) if f in have
             else F.lit(self.fills[f])).alias(f) for f in self.features])
        return filled.select(*[c for c in filled.columns if c not in self.features], *[
            deviation_column(f, self.ranges, self.stats).alias(f) for f in self.features])

    def _membership(self, panel: str) -> Column:
        prep, mix = self.models[panel]
        return mix.membership(prep.apply(F.array(*[F.col(f) for f in self.panels[panel]])))

    def memberships(self, df: DataFrame) -> DataFrame:
        """Record keys with one membership array per panel and the chained scores."""
        enc = self._encode(df)
        keys = [c for c in enc.columns if c not in self.features]
        out = enc.select(*keys, *[self._membership(p).alias(f"m_{p}") for p in self.models])
        return out.withColumn("scores", F.concat(*[F.col(f"m_{p}") for p in self.models]))

    def apply(self, df: DataFrame) -> DataFrame:
        out = self.memberships(df)
        cols = [F.col(f"m_{p}")[c].alias(f"{p}_{c}") for p, (_, mix) in self.models.items()
                for c in range(mix.k)]
        wide = out.select("*", *cols)
        if self.linear is None:
            return wide
        return self.linear.score(wide)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(p, i, f, *self.ranges.get(f, (None, None)), float(self.fills[f]),
                 *self.stats.get(f, (None, None))) for p, fs in self.panels.items()
                for i, f in enumerate(fs)]
        ordered = [(n, *r) for n, r in enumerate(rows)]
        spark.createDataFrame(ordered, "pos int, panel string, ord int, feature string, lo double, hi double, "
                                       "fill double, mu double, sigma double").write.parquet(f"{path}/features")
        if self.names:
            spark.createDataFrame(list(self.names.items()), "key string, label string").write.parquet(
                f"{path}/names")
        for p, (prep, mix) in self.models.items():
            save_mixture(spark, f"{path}/panel={p}", prep, mix)
        if self.linear is not None:
            self.linear.to_frame(spark).write.parquet(f"{path}/linear")

    @classmethod
    def load(cls, spark: SparkSession, path: str, has_linear: bool = True,
             has_names: bool = False) -> RecordScorer:
        rows = spark.read.parquet(f"{path}/features").orderBy("pos").collect()
        panels: dict[str, list[str]] = {}
        for r in rows:
            panels.setdefault(r["panel"], []).append(r["feature"])
        names = {r["key"]: r["label"] for r in spark.read.parquet(f"{path}/names").collect()} \
            if has_names else {}
        return cls(
            panels, {r["feature"]: (r["lo"], r["hi"]) for r in rows if r["lo"] is not None},
            {r["feature"]: r["fill"] for r in rows},
            {r["feature"]: (r["mu"], r["sigma"]) for r in rows if r["mu"] is not None},
            {p: load_mixture(spark, f"{path}/panel={p}") for p in panels}, names,
            LinearModel.from_frame(spark.read.parquet(f"{path}/linear")) if has_linear else None)


def _complete(lab: DataFrame, features: Sequence[str], min_ratio: float) -> DataFrame:
    """Complete enough records, persisted unless ``lab`` is: a filter of a kept table need not be kept once more."""
    kept = keep_complete(lab, features, min_ratio)
    return kept if lab.storageLevel.useMemory else kept.persist(StorageLevel.MEMORY_AND_DISK)


def prepare_records(lab: DataFrame, features: Sequence[str], min_ratio: float = 0.70) -> DataFrame:
    """Complete enough records with the remaining gaps filled by global medians.

    Medians and imputation scan them several times.
    """
    kept = _complete(lab, features, min_ratio)
    return impute(kept, features, medians(kept, features))


def fit_scorer(lab: DataFrame, panels: Mapping[str, Sequence[str]], ranges: Mapping, k: int, *,
               entity: str = "record_id", min_ratio: float = 0.70, dims: int = 50,
               fit_sample: int | None = None, n_init: int = 3, max_iter: int = 200,
               seed: int = 42, names: dict[str, str] | None = None,
               outcome: DataFrame | None = None, label: str = "label", outcome_on: str | None = None,
               classes: Sequence[str] = ()) -> RecordScorer:
    """Fit medians, deviations, panel mixtures and, with outcomes, the linear model.

    Outcomes meet the records by ``outcome_on``, a column of both tables; by default it is ``entity``.
    """
    panels = {p: list(fs) for p, fs in panels.items()}
    features = [f for fs in panels.values() for f in fs]
    kept = _complete(lab, features, min_ratio)
    fill_frame = medians(kept, features)
    fills = fill_frame.first().asDict()
    filled = impute(kept, features, kept.sparkSession.createDataFrame([fills], fill_frame.schema))
    stats = stats_map(fallback_stats(filled, features, ranges))
    scorer = RecordScorer(panels, dict(ranges), fills, stats, {}, names or {})
    encoded = scorer._encode(filled)
    fitted = fit_panels(cube_rows(encoded, entity, panels), "panel", "vector", {p: len(fs) for p, fs in panels.items()}, k, dims=dims,
                        row_id=entity, fit_sample=fit_sample, n_init=n_init, max_iter=max_iter, seed=seed)
    scorer.models.update({p: fitted[p] for p in panels})
    if outcome is not None:
        on = outcome_on or entity
        train = scorer.apply(kept).join(outcome.select(on, label), on)
        scorer.linear = fit_linear(train, label, scorer.score_columns(), classes)
    return scorer


def deviation_table(lab: DataFrame, features: Sequence[str], ranges: Mapping,
                    min_ratio: float = 0.70) -> DataFrame:
    """Filter, impute and encode in one lazy plan."""
    return deviations(prepare_records(lab, features, min_ratio), features, ranges)
