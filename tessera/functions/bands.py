"""Threshold bands, outcome codes and display texts as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# All thresholds and texts of the bands below.


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_decimal(value: Column, signed: bool = False) -> Column:
    """Number with one decimal, halves to even on the exact binary value."""
    text = F.call_function("format_number", value, F.lit("0.0"))
    return F.concat(F.when(value >= 0, "+").otherwise(""), text) if signed else text


def range_flag(value: str | Column, lo: float | Column, hi: float | Column) -> Column:
    """Text suffix for a value outside its reference range, else empty."""
    v = _c(value)
    return F.when(v > hi, " (HIGH)").when(v < lo, " (LOW)").otherwise("")


def severity_band(dev: str | Column, mild: float = 0.75, strong: float = 2.0) -> Column:
    d = _c(dev)
    return (F.when(F.abs(d) < mild, "normal")
            .when(d >= strong, "significantly_high").when(d >= mild, "mildly_high")
            .when(d <= -strong, "significantly_low").otherwise("mildly_low"))


def colour_band(dev: str | Column) -> Column:
    """Traffic-light band of an absolute deviation; NULL has no colour."""
    d = F.abs(_c(dev))
    return F.when(d.isNull(), "").when(d < 1, "green").when(d < 2, "amber").otherwise("red")


def signal_band(score: str | Column) -> Column:
    s = _c(score)
    return F.when(s > 0.3, "strong").when(s > 0.1, "partial").otherwise("weak")


def is_active(score: str | Column) -> Column:
    return _c(score) > 0.05


def keep_advice(fg_score: str | Column, distance: str | Column) -> Column:
    """Whether a cluster looks like an object part or like background."""
    fg, d = _c(fg_score), _c(distance)
    return (F.when((fg > 0.5) & (d < 8), "part")
            .when((fg < 0.4) | (d > 12), "background").otherwise("uncertain"))


def push_label(dev: str | Column, target: str = "target") -> Column:
    d = _c(dev)
    return F.when(d < -0.5, f"not_{target}").when(d > 0.5, target).otherwise("neutral")


def three_class_outcome(first: str | Column, second: str | Column) -> Column:
    """0: first is 1; 1: only second is 1; 2: both are 2; -1: unknown."""
    a, b = _c(first), _c(second)
    one, two = F.lit(1), F.lit(2)
    return (F.when(a.eqNullSafe(one), 0).when(b.eqNullSafe(one), 1)
            .when(a.eqNullSafe(two) & b.eqNullSafe(two), 2).otherwise(-1))


def binary_outcome(flag: str | Column) -> Column:
    """1 -> 1, 2 -> 0, anything else (also NULL) -> -1."""
    f = _c(flag)
    return F.when(f.eqNullSafe(F.lit(1)), 1).when(f.eqNullSafe(F.lit(2)), 0).otherwise(-1)


def short_name(label: str | Column) -> Column:
    """Label text before its unit in brackets."""
    return F.trim(F.substring_index(_c(label), " (", 1))


def title_name(name: str | Column, width: int | None = None) -> Column:
    """``snake_case`` name as spaced title, optionally cut for a display column."""
    text = F.initcap(F.replace(_c(name), F.lit("_"), F.lit(" ")))
    return F.substring(text, 1, width) if width else text


def dimension_label(label: str | Column, include: str | Column, cluster_id: str | Column) -> Column:
    """Given label if it is non-blank and included, else ``cluster_<id>``."""
    text = F.when(F.coalesce(_c(include), F.lit(True)), F.trim(_c(label)))
    return F.coalesce(F.nullif(text, F.lit("")),
                      F.concat(F.lit("cluster_"), _c(cluster_id).cast("string")))
