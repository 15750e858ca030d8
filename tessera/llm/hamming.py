"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

The rotation is fitted on a bounded sample (iterative quantisation after
centring), every row is coded. Codes are split into substrings of eight bits and each
substring has an index. Two codes within a Hamming radius agree, by the
pigeonhole principle, within a smaller radius in at least one substring, so probing
the near keys of each substring index retrieves every code within the radius.
Those are reranked by the inner product of the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import best, common_length, matrix, search, usable

SUBSTRING = 8
KEYS = np.arange(1 << SUBSTRING, dtype=np.uint8)
DISTANCE = np.bitwise_count(KEYS[:, None] ^ KEYS[None, :])


@dataclass
class Coder:
    """Centre, norm bound, rotation and radius; its size depends on dimension and bits only."""

    centre: np.ndarray
    largest: float
    rotation: np.ndarray
    radius: int = 0

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """Rows with one more component that gives all of them the same norm: inner product becomes angle."""
        x = rows / self.largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def codes(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        """Bytes (substrings) of each row's code; a query's lifted component is 0."""
        if query:
            x = np.concatenate([rows / np.linalg.norm(rows, axis=1, keepdims=True), np.zeros((len(rows), 1))], axis=1)
        else:
            x = self.lifted(rows)
        return np.packbits((x - self.centre) @ self.rotation > 0, axis=1)


def fit_coder(sample: np.ndarray, largest: float, k: int, bits: int = 64, rounds: int = 30, coverage: float = 0.97, trials: int = 512, seed: int = 7) -> Coder:
    """Learn a rotation by iterative quantisation, then the radius that holds ``coverage`` of the sample's true neighbours.

    ``largest`` is the largest norm of all rows, in the sample or not.
    """
    rng = np.random.default_rng(seed)
    coder = Coder(np.zeros(sample.shape[1] + 1), largest, np.zeros((sample.shape[1] + 1, bits)))
    lifted = coder.lifted(sample)
    coder.centre = lifted.mean(axis=0)
    centred = lifted - coder.centre
    _, _, axes = np.linalg.svd(centred.T @ centred)
    blocks, width = [], min(bits, sample.shape[1])
    for start in range(0, bits, width):  # fewer dimensions than bits: several rotations side by side
        base = axes[:width].T
        rotation, _ = np.linalg.qr(rng.standard_normal((width, width)))
        projected = centred @ base
        for _ in range(rounds):
            left, _, right = np.linalg.svd(projected.T @ np.where(projected @ rotation > 0, 1.0, -1.0))
            rotation = left @ right
        blocks.append((base @ rotation)[:, :bits - start])
    coder.rotation = np.concatenate(blocks, axis=1)
    chosen = rng.permutation(len(sample))[:trials]
    codes, asked = coder.codes(sample), coder.codes(sample[chosen], query=True)
    scores = sample[chosen] @ sample.T
    scores[np.arange(len(chosen)), chosen] = -np.inf
    near = np.argpartition(-scores, min(k, len(sample) - 1) - 1, axis=1)[:, :k] if len(sample) > 1 else np.zeros((len(chosen), 0), int)
    gaps = np.bitwise_count(codes[near] ^ asked[:, None, :]).sum(axis=2)
    coder.radius = int(np.quantile(gaps, coverage, method="higher")) if gaps.size else bits
    return coder


class SubstringIndex:
    """One posting list per substring and key."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.bounds = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within ``radius`` of ``code``, all of them.

        With m substrings and ``radius = m * a + b``, one of the first b + 1 lies within
        a or one of the others within a - 1.
        """
        m = len(self.order)
        near, spare = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for j in range(m):
            reach = near if j <= spare else near - 1
            for key in np.flatnonzero(DISTANCE[code[j]] <= reach):
                seen[self.order[j][self.bounds[j][key]:self.bounds[j][key + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def hamming_search(table: DataFrame, is_query: Column, k: int = 20, bits: int = 64, fit_rows: int = 20_000, coverage: float = 0.97,
                   id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` rows of largest inner product found for each query.

    The coder is fitted on at most ``fit_rows`` rows (those of smallest id hash); the index
    holds all rows. The radius covers ``coverage`` of the neighbours within that
    sample; neighbours among more rows are nearer still. A query for which fewer than
    ``k`` codes of a shard lie within the radius takes a doubled radius there, up to all rows,
    so a small table is answered in full. A query's own id is no candidate, equal scores go to the smaller id, rows
    that share an id count one by one. Vectors are compared with those of their own length; where that is not the
    most frequent one, a shard is scored in full. Vectors that are null, zero, empty or hold null or non-finite components
    and rows without an id take no part. An empty table gives no rows.
    """
    rows = usable(table, id_column, vector_column, drop_zero=True)
    length = common_length(rows)
    usual = rows.filter(F.size("vec") == length)
    sample = usual.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(fit_rows).toArrow()
    schema = "query_id long, vec_id long, score double"
    if sample.num_rows == 0:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest = usual.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    coder = fit_coder(matrix(sample)[1], largest, k, bits, coverage=coverage)

    def answer(shard: pa.Table, queries: pa.Table) -> pa.Table:
        ids, vectors = matrix(shard)
        query_ids, wanted = matrix(queries)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(ids) and len(query_ids):
            coded = vectors.shape[1] == length
            index = SubstringIndex(coder.codes(vectors)) if coded else None
            codes = coder.codes(wanted, query=True) if coded else [None] * len(wanted)
            for query_id, query, code in zip(query_ids, wanted, codes):
                radius = coder.radius
                found = index.within(code, radius) if coded else np.arange(len(ids))
                found = found[ids[found] != query_id]
                while coded and len(found) < k and radius < bits:
                    radius = min(bits, 2 * radius + 1)
                    found = index.within(code, radius)
                    found = found[ids[found] != query_id]
                scores = (vectors[found] * query).sum(axis=1)
                keep = best(ids[found], scores, k)
                for column, values in zip(out, (np.full(len(keep), query_id), ids[found][keep], scores[keep])):
                    column.append(values)
        return pa.table([np.concatenate(c) for c in out], names=["query_id", "vec_id", "score"])

    return search(rows, is_query, answer, schema, k)
