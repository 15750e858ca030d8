"""Splits, caps and per-class selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import (first_n, flag_first, hash_buckets, rank_rows, take_first,
                                        value_buckets)


def first_per_class(df: DataFrame, label: str, key: str, n: int, keep: Column | None = None,
                    val_every: int = 5) -> DataFrame:
    """First ``n`` rows of each class that pass a filter; every fifth goes to ``val``.

    Adds ``pos`` (from 0) and ``split``.
    """
    rows = df if keep is None else df.filter(keep)
    best = first_n(rows, [label], key, n, "pos")
    return (best.withColumn("pos", F.col("pos") - 1)
            .withColumn("split", F.when(F.col("pos") % val_every == 0, "val").otherwise("train")))


def gated_candidates(df: DataFrame, label: str, key: str, n: int, gate: Column,
                     oversample: int = 3) -> DataFrame:
    """First ``n`` rows per class that pass the gate among its first ``oversample * n``."""
    pool = first_n(df, [label], key, oversample * n, "_pos").drop("_pos")
    return first_n(pool.filter(gate), [label], key, n)


def top_fraction(df: DataFrame, by: Sequence[str], score: str, key: str, fraction: float,
                 gate: Column | None = None) -> DataFrame:
    """Best ``ceil(pool * fraction)`` rows (at least one) of each group after a gate."""
    pool = df if gate is None else df.filter(gate)
    pool = pool.filter(F.col(score).isNotNull())
    k = F.least(F.col("_total"), F.greatest(F.lit(1), F.ceil(F.col("_total") * F.lit(fraction))))
    return take_first(value_buckets(pool, by, score, key, descending=True), by, k)


def flag_top_fraction(df: DataFrame, by: Sequence[str], score: str, key: str, fraction: float,
                      gate: Column, passed: str = "passed", kept: str = "kept") -> DataFrame:
    """All rows with two flags: gate passed, and among the best fraction of the passed."""
    tagged = df.withColumn(passed, F.coalesce(gate, F.lit(False)))
    by_gate = [*by, passed]
    k = F.when(F.col(passed), F.least(F.col("_total"), F.greatest(
        F.lit(1), F.ceil(F.col("_total") * F.lit(fraction))))).otherwise(0)
    return flag_first(value_buckets(tagged, by_gate, score, key, descending=True), by_gate, k, kept)


def class_cap(df: DataFrame, label: str, key: str, seed: int | str, factor: int = 3) -> DataFrame:
    """Random rows of each class up to ``min(factor * smallest, largest)``."""
    def cap(table: DataFrame) -> DataFrame:
        whole = Window.partitionBy()
        return table.withColumn("_cap", F.least(F.min("_total").over(whole) * factor,
                                                F.max("_total").over(whole)))
    return take_first(hash_buckets(df, key, seed), [label], F.col("_cap"), cap).drop("_cap")


def stratified_split(df: DataFrame, label: str, key: str, seed: int | str,
                     test_size: float = 0.2) -> DataFrame:
    """Adds ``is_test``: a seeded share of every class, exact up to rounding."""
    return flag_first(hash_buckets(df, key, seed), [label],
                      F.round(F.col("_total") * test_size), "is_test")


def random_split(df: DataFrame, key: str, seed: int | str, val_size: float = 0.2) -> DataFrame:
    """Adds ``is_val``: the first share of a random permutation of all rows."""
    return flag_first(hash_buckets(df, key, seed), [], F.floor(F.col("_total") * val_size), "is_val")


def every_nth_split(df: DataFrame, label: str, key: str, n: int = 5, seed: int | str = 0) -> DataFrame:
    """Adds ``pos`` and ``split``: every ``n``-th row of each class goes to ``val``."""
    ranked = rank_rows(hash_buckets(df, key, seed), [label], "pos")
    return (ranked.withColumn("pos", F.col("pos") - 1)
            .withColumn("split", F.when(F.col("pos") % n == 0, "val").otherwise("train")))
