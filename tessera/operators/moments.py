"""Means and co-moments of vector columns, for all groups at once, and principal directions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import from_matrix, to_matrix
from tessera.operators.passes import block_sums, gathered


@dataclass(frozen=True)
class Moments:
    """Rows, mean and sum of centred outer products of the vectors of a group."""

    count: int
    mean: np.ndarray
    scatter: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        """With ``count - 1`` in the divisor."""
        return self.scatter / max(1, self.count - 1)

    @property
    def spread(self) -> np.ndarray:
        """Population deviation of each component; 1 where it is constant."""
        s = np.sqrt(np.diag(self.scatter) / max(1, self.count))
        return np.where(s > 0, s, 1.0)

    def correlation(self) -> np.ndarray:
        """Correlation matrix; constant components correlate with themselves only."""
        s = self.spread
        c = self.scatter / max(1, self.count) / np.outer(s, s)
        flat = np.diag(self.scatter) <= 0
        c[flat, flat] = 1.0
        return c

    def principal(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """Leading eigenvectors (columns) of the covariance and all eigenvalues, falling; the largest entry of a vector is positive."""
        values, vectors = np.linalg.eigh(self.covariance)
        values, vectors = values[::-1], vectors[:, ::-1][:, :dims]
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        return vectors * np.where(signs == 0, 1.0, signs), np.maximum(values, 0.0)


def block_moments(blocks: DataFrame) -> dict[int, Moments]:
    """Moments of each group of vectors or packed blocks (see :mod:`tessera.operators.passes`), in two passes."""
    means = {g: s[0] / n for g, (n, s) in block_sums(gathered(blocks)).items()}
    return {g: Moments(n, means[g], (s + s.T) / 2) for g, (n, s) in (block_sums(gathered(blocks), means) if means else {}).items()}


def co_moments(df: DataFrame, vec: str, group: str | None = None) -> dict[object, Moments]:
    """Moments of each group (of the whole table under the key None without ``group``).

    Two passes over the rows, whatever the number of groups: means, then products of centred rows, summed per partition and
    added up on executors. One matrix per group reaches the driver. Vectors of a group have one length, NULL ones do not count.
    """
    rows = df.select((F.lit(None).cast("string") if group is None else F.col(group)).alias("g"), F.col(vec).cast("array<double>").alias("x"))
    rows = rows.filter(F.col("x").isNotNull())
    heads = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("m")).collect()
    means = [np.array(h["m"]) for h in heads]
    names = {h["g"]: i for i, h in enumerate(heads)}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            for at, name in enumerate(coded.dictionary.to_pylist()):
                g = names[name]
                x = to_matrix(batch.column(1).filter(pa.array(codes == at)))[0] - means[g]
                sums[g] = sums.get(g, 0.0) + x.T @ x
        for g, s in sums.items():
            d = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, g, np.int32)), pa.array(np.arange(d, dtype=np.int32)), from_matrix(s, np.ones(d, bool))], names=["g", "i", "s"])

    parts = rows.mapInArrow(products, "g int, i int, s array<double>")
    total = parts.groupBy("g", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    scatter = [np.zeros((len(m), len(m))) for m in means]
    for r in total.toArrow().to_pylist() if heads else ():
        scatter[r["g"]][r["i"]] = r["s"]
    return {h["g"]: Moments(h["n"], means[i], (scatter[i] + scatter[i].T) / 2) for i, h in enumerate(heads)}
