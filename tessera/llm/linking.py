"""Joins to tables with one row per key that stay balanced under hot keys, and components of links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: At most this many keys can each hold more than a share of 1 / HEAVY_KEYS of all rows; keys of few rows are never heavy.
HEAVY_KEYS, LIGHT_ROWS = 20_000, 100
#: Parts that rows without a key are dealt to.
NULL_PARTS = 1024


def heavy_keys(left: DataFrame, on: Sequence[str]) -> DataFrame | None:
    """The keys with more than ``rows / HEAVY_KEYS`` rows of ``left`` and the parts each is dealt to (``_parts``); None if there are none.

    Their number is below ``HEAVY_KEYS`` whatever the rows, so they may be broadcast. Rows are counted with partial sums.
    """
    total = left.count()
    light = max(LIGHT_ROWS, total // HEAVY_KEYS)
    counts = left.groupBy(*on).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > light)
    keys = counts.select(*on, F.ceil(F.col("_rows") / light).cast("int").alias("_parts")).dropna()
    rows = keys.toArrow()
    return F.broadcast(left.sparkSession.createDataFrame(rows, keys.schema)) if rows.num_rows else None


def join_unique(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", heavy: DataFrame | bool | None = True) -> DataFrame:
    """``left`` joined to ``right``, which has at most one row per key; ``how`` is left or inner.

    Rows of a heavy key are dealt to parts by a hash, and its row of ``right`` goes to each of them, so no
    task holds more than a ``HEAVY_KEYS``-th of the rows for one key. ``right`` grows by less than twice ``HEAVY_KEYS`` rows. ``left`` is read
    to count its keys and again to be joined, so it should be a written table; ``heavy`` may give what ``heavy_keys`` found before.
    """
    on = list(on)
    keys = heavy_keys(left, on) if heavy is True else heavy
    if keys is None:
        return left.join(right, on, how)
    rest = [c for c in left.columns if c not in on]
    hashed = F.xxhash64(*rest) if rest else F.monotonically_increasing_id()
    absent = sum((F.col(c).isNull().cast("int") for c in on), F.lit(0)) > 0
    parts = F.when(absent, F.lit(NULL_PARTS)).otherwise(F.coalesce("_parts", F.lit(1)))
    dealt = left.join(keys, on, "left").withColumn("_part", F.pmod(hashed, parts).cast("int")).drop("_parts")
    copied = right.join(keys, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [*on, "_part"], how).drop("_part")


def component_labels(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each connected component of ``links`` (``node, hub``, longs).

    Every round takes the smallest label among a node and its neighbours, then the label of that label, until
    nothing changes. Nodes with very many links and labels with very many nodes are dealt to many tasks.
    Without links there are no rows.
    """
    back = links.select(F.col("hub").alias("node"), F.col("node").alias("hub"))
    both = stored(links.select("node", "hub").unionByName(back).distinct(), "links")
    heavy = heavy_keys(both, ["hub"])
    labels = both.groupBy("node").agg(F.least(F.min("hub"), F.col("node")).alias("label"))
    labels = stored(labels, "labels")
    while True:
        near = (join_unique(both, labels.select(F.col("node").alias("hub"), "label"), ["hub"], "inner", heavy)
                .groupBy("node").agg(F.min("label").alias("near")))
        hooked = stored(labels.join(near, "node", "left").select("node", F.col("label").alias("before"), F.least("label", F.coalesce("near", "label")).alias("label")), "hooked")
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        moved = stored(join_unique(hooked, onward, ["label"]).select("node", "before", F.least("label", F.coalesce("onward", "label")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("label <> before").isEmpty():
            return labels
