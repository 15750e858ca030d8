"""Seeded, portable pseudo-random order: md5 of key and seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(key: str | Column, seed: int | str) -> Column:
    """Hex digest that orders keys like a random permutation of the given seed."""
    col = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(col.cast("string"), F.lit(f"|{seed}")))


def seeded_pick(key: str | Column, seed: int | str, n: int) -> Column:
    """Uniform integer in ``[0, n)`` from the first 8 hex digits of the hash."""
    head = F.substring(seeded_hash(key, seed), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(n)).cast("int")
