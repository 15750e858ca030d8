"""Operators over tables of vectors: means, own-centre measures, nearest rows, projection."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.vectors import (cosine, euclidean, from_matrix, l2_normalize, scatter,
                                       to_matrix, unit_rows)
from tessera.operators.moments import Moments, co_moments
from tessera.operators.blocks import mean_gap, nearest_in_blocks, silhouettes

TABLE_ROWS = 4096
TABLE_BYTES = 64 << 20


def mean_vectors(df: DataFrame, by: Sequence[str], vec: str, name: str = "vector",
                 normalize: bool = False) -> DataFrame:
    """Mean vector and row count per group, with partial sums on the map side."""
    out = (df.groupBy(*by)
           .agg(F.count(F.lit(1)).alias("n"),
                Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))).alias("_m"))
           .withColumn(name, vector_to_array("_m")).drop("_m"))
    return out.withColumn(name, l2_normalize(name)) if normalize else out


@dataclass(frozen=True)
class VectorTable:
    """A small, measured table of vectors held as one matrix."""

    ids: np.ndarray
    matrix: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, key: str, vec: str, max_rows: int | None = None,
           max_bytes: int | None = None) -> VectorTable | None:
        """Read the table, or ``None`` when it exceeds the bound."""
        max_rows, max_bytes = max_rows or TABLE_ROWS, max_bytes or TABLE_BYTES
        rows = df.select(key, vec).limit(max_rows + 1).toArrow()
        if rows.num_rows > max_rows or rows.nbytes > max_bytes:
            return None
        return cls.from_rows(rows, key, vec)

    @classmethod
    def from_rows(cls, rows: pa.Table, key: str, vec: str) -> VectorTable:
        rows = rows.sort_by(key)
        matrix, valid = to_matrix(rows.column(vec).combine_chunks())
        ids = rows.column(key).combine_chunks().filter(pa.array(valid)).to_numpy(zero_copy_only=False)
        return cls(ids, matrix)


def _own(df: DataFrame, vec: str, cluster: str, centres: DataFrame, name: str, kind: str) -> DataFrame:
    """Cosine or distance of each row to the centre of its own cluster."""
    table = VectorTable.of(centres, cluster, "vector")
    if table is None:
        pair = cosine if kind == "cosine" else euclidean
        joined = df.join(centres.select(cluster, F.col("vector").alias("_c")), cluster, "left")
        return joined.withColumn(name, pair(vec, "_c")).drop("_c")
    ids, matrix = table.ids, table.matrix
    units = unit_rows(matrix)

    @F.arrow_udf("double")
    def measure(v: pa.Array, c: pa.Array) -> pa.Array:
        cid = c.to_numpy(zero_copy_only=False)
        at = np.clip(np.searchsorted(ids, cid), 0, max(len(ids) - 1, 0))
        known = (ids[at] == cid) if len(ids) else np.zeros(len(cid), dtype=bool)
        if v.null_count:
            known = known & v.is_valid().to_numpy(zero_copy_only=False)
            v = v.filter(pa.array(known))
        m, _ = to_matrix(v)
        m = m if len(m) == known.sum() else m[known]
        at = at[known]
        if kind == "cosine":
            values = (unit_rows(m) * units[at]).sum(axis=1)
        else:
            values = np.sqrt(((m - matrix[at]) ** 2).sum(axis=1))
        return scatter(values, known)

    return df.withColumn(name, measure(vec, cluster))


def own_similarity(df: DataFrame, vec: str, cluster: str, centres: DataFrame,
                   name: str = "similarity") -> DataFrame:
    return _own(df, vec, cluster, centres, name, "cosine")


def own_distance(df: DataFrame, vec: str, cluster: str, centres: DataFrame,
                 name: str = "distance") -> DataFrame:
    return _own(df, vec, cluster, centres, name, "euclidean")


def nearest(df: DataFrame, vec: str, targets: DataFrame, key: str,
            id_name: str = "nearest", sim_name: str = "similarity") -> DataFrame:
    """Most similar row of ``targets`` for each row; the lowest key wins ties.

    Few targets (named clusters, measured) travel as one matrix and nothing is shuffled. Beyond the
    bound, blocks of rows meet blocks of targets on the executors and the best of each row is kept. Similarities that agree in
    twelve places tie. Keys may have any ordered type. Rows without a vector, and all rows if there are no targets, get NULL.
    """
    kind = targets.schema[key].dataType
    table = VectorTable.of(targets, key, "vector")
    if table is None:
        return nearest_in_blocks(df, vec, targets, key, "vector", id_name, sim_name)
    kept = [F.col(c) for c in df.columns if c not in (id_name, sim_name)]
    if not len(table.ids):
        return df.select(*kept, F.lit(None).cast(kind).alias(id_name), F.lit(None).cast("double").alias(sim_name))
    name = f"_near_{uuid.uuid4().hex}"
    return df.withColumn(name, _nearest_in(table, kind)(vec)).select(*kept, F.col(name)["id"].alias(id_name), F.col(name)["sim"].alias(sim_name))


def _nearest_in(table: VectorTable, kind: T.DataType):
    units, ids = unit_rows(table.matrix), table.ids
    result = T.StructType([T.StructField("id", kind), T.StructField("sim", T.DoubleType())])
    arrow = to_arrow_type(kind)

    @F.arrow_udf(result)
    def pick(v: pa.Array) -> pa.Array:
        m, valid = to_matrix(v)
        sims = unit_rows(m) @ units.T if len(m) else np.zeros((0, len(ids)))
        # Equal similarities may differ in the last bit between matrix layouts.
        arg = np.round(sims, 12).argmax(axis=1) if len(m) else np.zeros(0, dtype=int)
        rows = np.arange(len(arg))
        at = np.full(len(valid), -1)
        at[valid] = arg
        picked = pa.array(ids).take(pa.array(at, mask=~valid)).cast(arrow)
        return pa.StructArray.from_arrays([picked, scatter(sims[rows, arg], valid)], names=["id", "sim"])

    return pick


def centre_gaps(centres: DataFrame, key: str) -> DataFrame:
    """Mean distance between distinct centres; one row ``inter_mean``.

    Blocks of centres meet pairwise on the executors; no pair is ever a row.
    """
    return mean_gap(centres, key, "vector")


@dataclass(frozen=True)
class Scaler:
    """Mean and population spread of every component; a constant component divides by one."""

    mean: np.ndarray
    spread: np.ndarray

    def apply(self, vec: str | Column) -> Column:
        mean, spread = self.mean, self.spread

        @F.arrow_udf("array<double>")
        def scaled(v: pa.Array) -> pa.Array:
            m, valid = to_matrix(v)
            return from_matrix((m - mean) / spread if len(m) else m, valid)

        return scaled(vec)


def fit_scaler(df: DataFrame, vec: str) -> Scaler:
    """Moments of a vector column in one pass."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    head = df.agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")).first()["s"]
    n = max(1, head["count"])
    spread = np.sqrt(head["variance"].toArray() * (n - 1) / n)
    return Scaler(head["mean"].toArray(), np.where(spread > 0, spread, 1.0))


@dataclass(frozen=True)
class Projection:
    """Centred principal components; results are normalised again."""

    mean: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def rows(self, x: np.ndarray, normalize: bool = True) -> np.ndarray:
        """Projected rows of a matrix."""
        out = (x - self.mean) @ self.components if len(x) else x
        return unit_rows(out) if normalize else out

    def apply(self, vec: str | Column, normalize: bool = True) -> Column:
        @F.arrow_udf("array<double>")
        def project(v: pa.Array) -> pa.Array:
            m, valid = to_matrix(v)
            return from_matrix(self.rows(m, normalize), valid)

        return project(vec)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(-1, self.mean.tolist(), 0.0)]
        rows += [(i, self.components[:, i].tolist(), float(e)) for i, e in enumerate(self.explained)]
        return spark.createDataFrame(rows, "component int, vector array<double>, explained double")

    @classmethod
    def from_frame(cls, df: DataFrame) -> Projection:
        rows = df.orderBy("component").collect()
        return cls(np.array(rows[0]["vector"]), np.array([r["vector"] for r in rows[1:]]).T,
                   np.array([r["explained"] for r in rows[1:]]))


def projection_of(moments: Moments, dims: int) -> Projection:
    """Principal components from the moments of a table, at most ``min(dims, D, N - 1)``; ``explained`` are shares of the variance."""
    k = max(1, min(dims, len(moments.mean), moments.count - 1))
    components, values = moments.principal(k)
    total = values.sum()
    return Projection(moments.mean, components, values[:k] / total if total > 0 else values[:k])


def fit_projection(df: DataFrame, vec: str, dims: int) -> Projection:
    """Principal components of a vector column, at most ``min(dims, D, N - 1)``; two passes over the rows."""
    vectors = df.select(F.col(vec).cast("array<double>").alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return projection_of(co_moments(vectors, "x")[None], dims)
    finally:
        vectors.unpersist()


def component_checks(df: DataFrame, vec: str, projection: Projection) -> DataFrame:
    """``component, variance, residual, overlap``: how well each component is an eigenvector of the covariance of ``df``.

    ``variance`` is that of the rows along the component, ``residual`` the length of ``C v - (v'C v) v``, ``overlap`` the largest
    deviation of its inner products with all components from those of an orthonormal set.
    """
    c, v = co_moments(df, vec)[None].covariance, projection.components
    values = np.einsum("ij,ij->j", v, c @ v)
    residual = np.sqrt(((c @ v - v * values) ** 2).sum(axis=0))
    overlap = np.abs(v.T @ v - np.eye(v.shape[1])).max(axis=1)
    rows = [(i, float(a), float(r), float(o)) for i, (a, r, o) in enumerate(zip(values, residual, overlap))]
    return df.sparkSession.createDataFrame(rows, "component int, variance double, residual double, overlap double")


def layer_concat(layers: Sequence[DataFrame], keys: Sequence[str], vec: str) -> DataFrame:
    """Join per-layer vectors of the same entity and chain them in layer order."""
    out = layers[0].select(*keys, F.col(vec).alias("_l0"))
    for i, layer in enumerate(layers[1:], 1):
        out = out.join(layer.select(*keys, F.col(vec).alias(f"_l{i}")), list(keys))
    return out.select(*keys, F.concat(*[F.col(f"_l{i}") for i in range(len(layers))]).alias(vec))


def pool_layers(df: DataFrame, keys: Sequence[str], layer: str, layers: Sequence[int], vec: str) -> DataFrame:
    """Mean of a group's vectors within each layer, chained over the given layers.

    The layer list is part of the model configuration, so every layer is one
    conditional mean in a single aggregation.
    """
    v = array_to_vector(F.col(vec).cast("array<double>"))
    means = [vector_to_array(Summarizer.mean(v, F.when(F.col(layer) == l, 1.0).otherwise(0.0)))
             for l in layers]
    return df.groupBy(*keys).agg(F.concat(*means).alias(vec))


def euclidean_silhouette(rows: DataFrame, vec: str, cluster: str, row_id: str) -> DataFrame:
    """``rows`` with ``silhouette``, the Euclidean one over all of them; row ids are unique.

    Blocks of rows meet pairwise and add up distances by row and cluster, so nothing passes through the driver and
    no size is refused. Members of single-row clusters get 0, and so does every row if
    there is one cluster only; rows without a vector or cluster take no part and get NULL.
    """
    return rows.join(silhouettes(rows, row_id, cluster, vec), row_id, "left")


def model_column(model: Callable, ddl: str):
    """Column function around a user model, applied batch by batch on executors.

    ``model`` maps a pandas Series (texts, prompts, encoded images) to a list-like of
    results of the given type. Only the input column is sent to Python.
    """
    @F.pandas_udf(ddl)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(list(model(values)))

    return run
