"""Vector rows for the search operators, and the grid that brings query and row blocks together."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one shard and queries of one block, about; they bound what a task holds.
SHARD_ROWS, BLOCK_QUERIES, LEAST_SHARDS = 20_000, 20_000, 24


def finite(vec: Column) -> Column:
    """Whether a vector has components, all of them numbers."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~bad, F.lit(False))


def usable(table: DataFrame, id_column: str, vector_column: str, drop_zero: bool) -> DataFrame:
    """``vec_id, vec`` (doubles) of the vectors that take part.

    Null vectors, vectors with null or non-finite components, empty ones and (on
    request) zero vectors do not, nor do rows without an id.
    """
    rows = (table.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vec"))
            .filter(F.col("vec_id").isNotNull() & finite(F.col("vec"))))
    return rows.filter(F.exists("vec", lambda x: x != 0)) if drop_zero else rows


def common_length(rows: DataFrame) -> int:
    """The most frequent length of ``vec`` (the longest of equals); 0 without rows."""
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return common["n"] if common else 0


def search(rows: DataFrame, is_query: Column, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, k: int) -> DataFrame:
    """Best ``k`` rows of every query over all rows; ``fn`` answers a block of queries from a shard of rows.

    Rows are dealt to shards and queries to blocks by hash; each (length, shard, block) cell is one
    group, so that vectors meet those of their own length only. Rows travel once for each block and queries once for each shard, never pairs.
    ``fn`` returns at most ``k`` rows for each query (``query_id, vec_id, score``).
    """
    n = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(is_query.cast("long")), F.lit(0)).alias("queries")).first()
    shards = max(LEAST_SHARDS, -(-n["rows"] // SHARD_ROWS))
    blocks = max(1, -(-n["queries"] // BLOCK_QUERIES))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = rows.withColumn("length", F.size("vec"))
    left = rows.withColumn("shard", shard).withColumn("block", every(blocks))
    right = rows.filter(is_query).withColumn("block", block).withColumn("shard", every(shards))
    cell = ["length", "shard", "block"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(fn, schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (rows of equal length) of a group, ordered by id."""
    ids = table["vec_id"].to_numpy()
    if len(ids) == 0:
        return ids.astype(np.int64), np.zeros((0, 1))
    flat = table["vec"].combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    vectors = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order].astype(np.int64), vectors[order]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]
