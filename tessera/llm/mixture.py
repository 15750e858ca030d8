"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 48-bit hash of its id and text. Words are summed by source and by
the first 12 bits of the hash; the bucket in which a source's budget ends is the
only one that is looked at again, by the next 12 bits, and so on. What comes out
is one threshold per source, and a document is taken once more if its hash lies
below. Nothing is sorted, and a rerun takes the same documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, stored
from tessera.session import small_side

BITS, LEVELS = 12, 4


def words(text: str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: int) -> DataFrame:
    """``source, source_size, target``; one row per source (null is a source of its own, and the last).

    Sources by code point get ``weights`` in turn and share ``share`` of all
    words. A target stops at ``max_repeat`` times its source's words; what is left goes to
    the others by weight. With sources ordered by cap over weight, those before the
    first that stays below its cap are the capped ones.
    """
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("weight", weight)
            .withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
            .withColumn("ratio", F.col("cap") / F.col("weight")))
    level = (caps
             .withColumn("wanted", F.sum("source_size").over(every) * F.lit(float(share)))
             .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
             .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
             .withColumn("level", (F.col("wanted") - F.col("cap_before")) / F.col("weight_left"))
             .withColumn("free", F.col("ratio") >= F.col("level"))
             .withColumn("position", F.row_number().over(by_ratio))
             .withColumn("level", F.min(F.when(F.col("free"), F.struct("position", "level"))).over(every)["level"]))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return level.select("source", "source_size", target.alias("target"))


def _digits(level: int) -> Column:
    """The hash without the bits of later levels."""
    return F.shiftright("hash", BITS * (LEVELS - level))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, last, taken_below, also`` from ``budgets`` (``source, rest``): the hash in which the budget ends.

    Documents with a smaller hash are taken; those with the hash ``last`` itself
    only if that brings the sum nearer to ``rest``.
    """
    bound = budgets.filter("rest > 0").select("source", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), "rest")
    for level in range(1, LEVELS + 1):
        side = small_side(bound).withColumnRenamed("source", "_source")
        inside = sizes.join(side, F.col("source").eqNullSafe(F.col("_source")) & (_digits(level - 1) == F.col("prefix")))
        sums = (inside.groupBy("source", _digits(level).alias("bucket"))
                .agg(F.sum("size").alias("size"), F.first("below").alias("below"), F.first("rest").alias("rest")))
        upto = F.sum("size").over(W.partitionBy("source").orderBy("bucket"))
        crossing = sums.withColumn("upto", F.col("below") + upto).filter(F.col("upto") > F.col("rest"))
        bound = (crossing.groupBy("source")
                 .agg(F.min(F.struct(F.col("bucket").alias("prefix"), (F.col("upto") - F.col("size")).alias("below"), "rest", "size")).alias("b"))
                 .select("source", "b.prefix", "b.below", "b.rest", "b.size"))
        if level < LEVELS:
            bound = bound.drop("size")
    return bound.select("source", F.col("prefix").alias("last"), F.col("below").alias("taken_below"), (2 * (F.col("rest") - F.col("below")) >= F.col("size")).alias("also"))


def document_hash(id_column: str, text_column: str) -> Column:
    """48 bits of a digest of id and text; null and empty are alike."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_column, text_column)]
    return F.conv(F.substring(F.md5(F.concat_ws(" ", *parts)), 1, 12), 16, 10).cast("long")


def document_sizes(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """``doc_id, source, size, hash`` of every row, written once."""
    return stored(docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), words(text_column).alias("size"),
                              document_hash(id_column, text_column).alias("hash")), "mixture-sizes")


def source_plan(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: int) -> DataFrame:
    """``source, source_size, target, full, last, also``: one row per source.

    Its documents are taken ``full`` times, and once more if their hash lies below ``last``, or equals it and ``also`` is true.
    """
    targets = source_targets(sizes, weights, share, max_repeat)
    whole = F.least(F.round("target").cast("long"), F.col("source_size") * max_repeat)
    budgets = (targets.withColumn("whole", whole)
               .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("whole") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
               .withColumn("rest", F.col("whole") - F.col("full") * F.col("source_size")))
    budgets = stored(budgets, "mixture-budgets")
    cuts = thresholds(sizes, budgets).withColumnRenamed("source", "_source")
    return (budgets.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left")
            .select("source", "source_size", "target", "full", "last", "also"))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with ``source`` and ``hash``) joined to the plan of their source, and ``copies``."""
    side = small_side(plan.withColumnRenamed("source", "_source"))
    once_more = F.coalesce((F.col("hash") < F.col("last")) | ((F.col("hash") == F.col("last")) & F.col("also")), F.lit(False))
    return rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", F.col("full") + once_more.cast("long"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.0, max_repeat: int = 3,
                id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """How often each document is taken so that every source comes near its target.

    Returns ``doc_id, source, size, source_size, target, copies, taken``. Size is the
    number of words of the whole text. A target of ``f`` times a source takes every document ``floor(f)``
    times and those below the source's hash threshold once more. Rows of a source that are equal in
    id and text share a hash and are taken alike; different texts that share an id, or have none, are not tied. Null and empty
    texts have size 0 and add nothing; they are taken with the others below the threshold. A null source is one source,
    sorted last. An empty table gives no rows. Other columns are not looked at.
    """
    sizes = document_sizes(docs, id_column, text_column, source_column)
    return (with_copies(sizes, source_plan(sizes, weights, share, max_repeat))
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.0, max_repeat: int = 3,
                    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Rows of ``docs`` as often as ``mix_sources`` takes them.

    Every row is judged by its own source, id and text, so nothing but the plan of the sources is joined. Columns are those of ``docs``, whatever
    their names; edges are those of ``mix_sources``.
    """
    plan = source_plan(document_sizes(docs, id_column, text_column, source_column), weights, share, max_repeat)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_column).alias("source"), document_hash(id_column, text_column).alias("hash"))
    taken = with_copies(rows, plan).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return taken.select("row.*")
