"""Exact top-k search with block-at-a-time pruning.

Rows of a shard, in the order of their ids, form blocks of consecutive documents. Each block
has a forward index (its vectors) and, per term (component), the largest and the smallest
weight. A query sums what its terms can add at most in a block, visits the blocks
in falling order of that bound, scores whole blocks, and stops as soon as the next bound
lies below its kth score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import best, matrix, search, usable

BLOCK_ROWS, BLOCKS_AT_ONCE = 64, 8


class BlockIndex:
    """Blocks of consecutive rows with their term bounds."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, rows: int = BLOCK_ROWS):
        starts = np.arange(0, len(ids), rows)
        self.ids, self.weights = ids, weights
        self.spans = np.stack([starts, np.minimum(starts + rows, len(ids))], axis=1)
        self.high = np.maximum.reduceat(weights, starts, axis=0)
        self.low = np.minimum.reduceat(weights, starts, axis=0)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """Largest possible score in each block."""
        return np.maximum(self.high * query, self.low * query).sum(axis=1)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows other than ``query_id``; equal scores by id."""
        bounds = self.bounds(query)
        order = np.argsort(-bounds, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(order), BLOCKS_AT_ONCE):
            if len(scores) >= k and bounds[order[at]] < scores[-1]:
                break
            blocks = order[at:at + BLOCKS_AT_ONCE]
            if len(scores) >= k:
                blocks = blocks[bounds[blocks] >= scores[-1]]
            rows = np.concatenate([np.arange(*self.spans[b]) for b in blocks])
            rows = rows[self.ids[rows] != query_id]
            ids = np.concatenate([ids, self.ids[rows]])
            scores = np.concatenate([scores, self.weights[rows] @ query])
            keep = best(ids, scores, k)
            ids, scores = ids[keep], scores[keep]
        return ids, scores


def exact_top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id",
                vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest integer inner product for each query.

    Components become ``floor(scale * x)``. ``is_query`` is a condition on ``vec_id``. A
    query's own id is no candidate; rows that share an id count one by one. Equal
    scores go to the smaller id. Vectors are compared with those of their own length. Vectors that are null, empty or hold null
    or non-finite components and rows without an id take no part; an empty table gives no rows. Scores are 64-bit integers: where
    components are so large that a score could exceed them, the query fails and says so.
    """
    def whole(vectors: np.ndarray) -> np.ndarray:
        scaled = np.floor(vectors * scale)
        if scaled.size and float((scaled * scaled).sum(axis=1).max()) >= 2.0 ** 62:
            raise ValueError("components are too large: an inner product could exceed 64 bits")
        return scaled.astype(np.int64)

    def answer(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, vectors = matrix(rows)
        query_ids, wanted = matrix(queries)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        if len(ids) and len(query_ids):
            index = BlockIndex(ids, whole(vectors))
            for query_id, query in zip(query_ids, whole(wanted)):
                found, scores = index.top(query_id, query, k)
                for column, values in zip(out, (np.full(len(found), query_id), found, scores)):
                    column.append(values)
        return pa.table([np.concatenate(c).astype(np.int64) for c in out], names=["query_id", "vec_id", "score"])

    rows = usable(table, id_column, vector_column, drop_zero=False)
    return search(rows, is_query, answer, "query_id long, vec_id long, score long", k)


def multiples(of: int) -> Column:
    """Query condition: ids divisible by ``of``."""
    return F.pmod(F.col("vec_id"), F.lit(of)) == 0
