"""Concept vectors and concept scores from cluster assignments and named clusters."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.bands import dimension_label
from tessera.functions.vectors import l2_normalize, to_matrix, unit_rows
from tessera.operators.blocks import best_scores, coded, meet_blocks
from tessera.operators.vectors import VectorTable, mean_vectors
from tessera.session import small_side


def name_clusters(assigned: DataFrame, labels: DataFrame, cluster: str = "cluster_id",
                  name: str = "concept") -> DataFrame:
    """Look up the label of each row's cluster; ``cluster_<id>`` without one."""
    dim = labels.select(F.col("key").cast("int").alias(cluster), "label", "include")
    return (assigned.join(small_side(dim), cluster, "left")
            .withColumn(name, dimension_label("label", "include", cluster)).drop("label", "include"))


def entity_rows(rows: DataFrame, entities: DataFrame, entity: str, how: str = "inner") -> DataFrame:
    """Rows of an entity (patches of an image) with the columns of the entity table, which has one row per entity.

    The table is broadcast if it is measured to be small. ``how`` is inner (rows of unknown entities go) or left.
    """
    return rows.join(small_side(entities), entity, how)


def concept_vectors(assigned: DataFrame, labels: DataFrame, cluster: str, vec: str,
                    normalize: bool = True) -> DataFrame:
    """Mean vector of every named, included, non-empty cluster.

    The means are taken per cluster first; the (few) results then meet the label
    rows, so the large table is joined with nothing. Clusters that share a label
    stay apart (see :func:`last_per_name`).
    """
    means = mean_vectors(assigned, [cluster], vec)
    dim = labels.select(F.col("key").cast("int").alias(cluster), F.col("label").alias("concept"),
                        "confidence", "notes")
    out = means.join(dim, cluster)
    return out.withColumn("vector", l2_normalize("vector")) if normalize else out


def last_per_name(df: DataFrame, name: str, order: str) -> DataFrame:
    """Key-wise merge in which the last row of a name wins."""
    rest = [c for c in df.columns if c != name]
    return (df.groupBy(name).agg(F.max_by(F.struct(*rest), order).alias("_r"))
            .select(name, *[F.col("_r")[c].alias(c) for c in rest]))


def concept_profiles(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Mean deviation profile per cluster, not normalised."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               *[F.avg(f).alias(f) for f in features])


def score_columns(assigned: DataFrame, entity: str, cluster: str, concepts: Mapping[str, int],
                  entities: DataFrame | None = None) -> DataFrame:
    """Share of each entity's rows in every concept's cluster; one column each.

    One aggregation with partial sums; no pivot over discovered values. Rows without a
    cluster count among the entity's rows. Entities
    without rows get zeros when an entity table is given.
    """
    out = assigned.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_patches"),
        *[(F.count_if(F.col(cluster) == cid) / F.count(F.lit(1))).alias(name) for name, cid in concepts.items()])
    if entities is not None:
        out = (entities.select(entity).join(out, entity, "left")
               .fillna(0, subset=["n_patches"]).fillna(0.0, subset=list(concepts)))
    return out


def score_rows(scores: DataFrame, entity: str, concepts: Sequence[str]) -> DataFrame:
    """Score columns -> rows (entity, concept index, concept, score)."""
    cells = F.array(*[F.struct(F.lit(i).alias("concept_idx"), F.lit(c).alias("concept"),
                               F.col(c).cast("double").alias("score")) for i, c in enumerate(concepts)])
    return scores.select(entity, F.explode(cells).alias("_cell")).select(entity, "_cell.*")


def score_ranges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("concept").agg(F.min("score").alias("min_score"),
                                       F.max("score").alias("max_score"))


def similarity_scores(df: DataFrame, entity: str, vec: str, targets: DataFrame, key: str,
                      how: str = "top", k: int = 10) -> DataFrame:
    """Cosine-based concept score per entity: mean of the ``k`` best rows, or the best.

    Every batch (or, with many targets, every block of rows and targets) keeps the ``k`` best scores of each entity in it to each
    target; those states merge by entity and target, so an entity's rows never have to meet. Rows without a vector do not count; entities
    without any have no scores.
    """
    k = 1 if how == "max" else k
    result = T.StructType([T.StructField(entity, df.schema[entity].dataType), T.StructField(key, targets.schema[key].dataType),
                           T.StructField("score", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in result.fields]

    def state(rows: pa.Table, ids: pa.Array, units: np.ndarray) -> pa.Table:
        names, code = coded(rows["_entity"])
        who, which, score = best_scores(code, unit_rows(to_matrix(rows["_vec"])[0]) @ units.T, k)
        columns = [names.take(pa.array(who)), ids.take(pa.array(which)), pa.array(score)]
        return pa.table([c.cast(t) for c, t in zip(columns, kinds)], names=result.names)

    rows = df.filter(F.col(vec).isNotNull()).select(F.col(entity).alias("_entity"), F.col(vec).cast("array<double>").alias("_vec"))
    table = VectorTable.of(targets, key, "vector")
    if table is None:
        def cell(part: pa.Table, block: pa.Table) -> pa.Table:
            block = block.filter(block["_vector"].is_valid())
            return state(part, block["_key"].combine_chunks(), unit_rows(to_matrix(block["_vector"])[0]))

        states = meet_blocks(rows.withColumn("_row", F.monotonically_increasing_id()), "_row", "_vec", targets, key, "vector", cell, result)
    else:
        ids, units = pa.array(table.ids, kinds[1]), unit_rows(table.matrix)

        def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(ids):
                    yield from state(pa.Table.from_batches([batch]), ids, units).to_batches()

        states = rows.mapInArrow(batchwise, result)
    if k > 1:
        place = F.row_number().over(W.partitionBy(entity, key).orderBy(F.desc("score")))
        states = states.withColumn("_place", place).filter(F.col("_place") <= k)
    return states.groupBy(entity, key).agg((F.max if k == 1 else F.avg)("score").alias("score"))


def membership_matrix(blocks: Sequence[DataFrame], entity: str, names: Sequence[str]) -> DataFrame:
    """Join per-panel membership arrays of the same entity and chain them."""
    out = blocks[0].select(entity, F.col(names[0]).alias("_b0"))
    for i, b in enumerate(blocks[1:], 1):
        out = out.join(b.select(entity, F.col(names[i]).alias(f"_b{i}")), entity)
    return out.select(entity, F.concat(*[F.col(f"_b{i}") for i in range(len(blocks))]).alias("scores"))


def cube_rows(df: DataFrame, entity: str, panels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Wide record -> one row per panel with the panel's features as a vector."""
    parts = F.array(*[F.struct(F.lit(i).alias("panel_idx"), F.lit(p).alias("panel"),
                               F.array(*[F.col(c).cast("double") for c in cols]).alias("vector"))
                      for i, (p, cols) in enumerate(panels.items())])
    return df.select(entity, F.explode(parts).alias("_cell")).select(entity, "_cell.*")


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature",
         value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def fill_model_order(df: DataFrame, model_concepts: Sequence[str]) -> list[Column]:
    """Model concepts in model order; a concept the frame lacks scores 0."""
    have = set(df.columns)
    return [(F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c)
            for c in model_concepts]
