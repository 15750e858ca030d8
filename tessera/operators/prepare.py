"""Completeness filter, imputation and deviation encoding of wide records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bands import one_decimal, range_flag
from tessera.operators.ordering import exact_group_medians, exact_quantiles, null_safe_join
from tessera.session import small_side

Ranges = Mapping[str, tuple[float, float]]


def valid_ratio(features: Sequence[str]) -> Column:
    """Share of the features that are not NULL."""
    known = sum((F.col(f).isNotNull().cast("int") for f in features[1:]),
                F.col(features[0]).isNotNull().cast("int"))
    return known / F.lit(len(features))


def keep_complete(df: DataFrame, features: Sequence[str], min_ratio: float = 0.70) -> DataFrame:
    return df.filter(valid_ratio(features) >= min_ratio)


def medians(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact median of every feature, NULLs skipped; one row."""
    return exact_quantiles(df, features, [0.5]).select(
        *[F.col(f)[0].alias(f) for f in features])


def group_medians(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Exact median per group (e.g. per cycle), NULLs skipped; a group without values gets NULL.

    The two middle values are found inside brackets from sketches, so a large group is neither shuffled nor
    sorted. A NULL group is a group. The input is scanned twice: persist it if it is costly.
    """
    return exact_group_medians(df.select(*by, *[F.col(f).cast("double").alias(f) for f in features]), by, features)


def impute_by_group(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Fill NULLs with the median of the row's group; a group without values stays NULL."""
    fill = group_medians(df, features, by).withColumnsRenamed({f: f"_fill_{f}" for f in features})
    joined = null_safe_join(df, small_side(fill), by)
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_fill_{c}")).alias(c) if c in features else F.col(c) for c in df.columns])


def impute(df: DataFrame, features: Sequence[str], fill: DataFrame,
           count_as: str | None = None) -> DataFrame:
    """Fill NULLs from a one-row frame; absent columns are created.

    The row is read once and becomes constants of the plan. ``count_as`` names a
    column with the number of cells filled in the row.
    """
    fills = {f: F.lit(v).cast("double") for f, v in fill.select(*features).first().asDict().items()}
    have = set(df.columns)
    out = [c for c in df.columns if c not in features]
    cells = [F.coalesce(F.col(f), fills[f]) if f in have else fills[f]
             for f in features]
    cols = [*out, *[c.alias(f) for c, f in zip(cells, features)]]
    if count_as:
        gaps = [F.col(f).isNull().cast("int") if f in have else F.lit(1) for f in features]
        cols.append(sum(gaps[1:], gaps[0]).alias(count_as))
    return df.select(*cols)


def fallback_stats(df: DataFrame, features: Sequence[str], ranges: Ranges) -> DataFrame:
    """Mean and population deviation of the features without a range; one row."""
    free = [f for f in features if f not in ranges]
    if not free:
        return df.sparkSession.createDataFrame([(0,)], "_none int")
    return df.agg(*[F.struct(F.avg(f).alias("mu"), F.stddev_pop(f).alias("sigma")).alias(f)
                    for f in free])


def stats_map(frame: DataFrame) -> dict[str, tuple[float, float]]:
    """The one row of :func:`fallback_stats` as constants."""
    row = frame.first().asDict(recursive=True)
    return {f: (v["mu"], v["sigma"]) for f, v in row.items()
            if isinstance(v, dict) and v["mu"] is not None}


def deviation_column(feature: str, ranges: Ranges, stats: Mapping[str, tuple[float, float]],
                     cap: float = 4.0) -> Column:
    """Signed distance from the middle of the range in half-ranges, capped.

    Without a range the feature is standardised by its mean and deviation in
    ``stats``; a feature unknown to the fit keeps its value.
    """
    x = F.col(feature)
    if feature in ranges:
        lo, hi = ranges[feature]
        mid, half = (lo + hi) / 2.0, max((hi - lo) / 2.0, 1e-6)
        z = (x - F.lit(mid)) / F.lit(half)
    elif feature in stats:
        mu, sigma = stats[feature]
        z = (x - F.lit(mu)) / F.lit(max(sigma, 1e-6))
    else:
        z = x
    return F.when(x.isNotNull(), F.least(F.greatest(z, F.lit(-cap)), F.lit(cap)))


def deviations(df: DataFrame, features: Sequence[str], ranges: Ranges,
               stats: DataFrame | None = None, cap: float = 4.0) -> DataFrame:
    """Replace the features by their deviations; other columns stay.

    ``stats`` is the stored frame of :func:`fallback_stats`; by default it is
    fitted on ``df``.
    """
    frame = fallback_stats(df, features, ranges) if stats is None else stats
    known = stats_map(frame)
    return df.select(*[c for c in df.columns if c not in features],
                     *[deviation_column(f, ranges, known, cap).alias(f) for f in features])


def robust_scale(df: DataFrame, features: Sequence[str], quartiles: DataFrame | None = None) -> DataFrame:
    """``(x - median) / IQR`` with exact quartiles; a zero IQR divides by one."""
    q = exact_quantiles(df, features, [0.25, 0.5, 0.75]) if quartiles is None else quartiles
    row = q.select(*features).first()

    def scaled(f: str) -> Column:
        low, mid, high = row[f]
        return ((F.col(f) - mid) / ((high - low) or 1.0)).alias(f)

    return df.select(*[c for c in df.columns if c not in features], *[scaled(f) for f in features])


def record_sentence(features: Sequence[str], labels: Mapping[str, str], ranges: Ranges) -> Column:
    """Record as text: ``name: value(flag)`` parts, NULLs skipped."""
    parts = []
    for f in features:
        flag = range_flag(f, *map(F.lit, ranges[f])) if f in ranges else F.lit("")
        parts.append(F.when(F.col(f).isNotNull(), F.concat(
            F.lit(f"{labels.get(f, f)}: "), one_decimal(F.col(f)), flag)))
    return F.concat_ws(". ", *parts)


def feature_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
