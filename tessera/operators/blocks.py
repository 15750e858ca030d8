"""Tables compared with tables in blocks of bounded bytes.

Rows are dealt to blocks by hash. Every pair of blocks that has to meet is one group on the executors, which
returns a small partial result for each row or key; partial results are merged by ordinary aggregations. Neither
table passes through the driver, no pair of rows is ever a row, and a group holds two blocks, however large the tables are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.vectors import to_matrix, unit_rows
from tessera.session import checkpoint, small_side

#: Bytes of a block's vectors as doubles and its rows, and bytes of the part of a distance matrix held at once (which stays in a core's cache).
BLOCK_BYTES, BLOCK_ROWS, STRIP_BYTES = 16 << 20, 16 << 10, 2 << 20


def block_count(df: DataFrame, vec: str, least_rows: int = 2_000) -> int:
    """Blocks of about ``BLOCK_BYTES`` and ``BLOCK_ROWS`` at most, as keys and partial results of short vectors take more room than these; small
    tables still get a few, so that cores share the work."""
    head = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(vec).cast("long")), F.lit(0)).alias("cells")).first()
    return max(1, -(-head["cells"] * 8 // BLOCK_BYTES), -(-head["n"] // BLOCK_ROWS), min(4, head["n"] // least_rows))


def dealt(key: str | Column, blocks: int, seed: int = 0) -> Column:
    """Block of a row, by a hash of its key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(blocks)).cast("int")


def _every(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def pair_blocks(df: DataFrame, key: str, vec: str, fn: Callable[[pa.Table, pa.Table], Iterator[pa.Table]], schema: T.StructType) -> DataFrame:
    """``fn`` applied to each unordered pair of blocks of one table, and to each block with itself (the same object twice).

    Each row goes to as many groups as there are blocks.
    """
    blocks = block_count(df, vec)
    rows = df.withColumn("_own", dealt(key, blocks)).withColumn("_other", _every(blocks))
    rows = rows.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))

    def run(group: pa.Table) -> pa.Table:
        own, i, j = group["_own"].to_numpy(), group["_i"][0].as_py(), group["_j"][0].as_py()
        first = group.filter(pa.array(own == i))
        parts = list(fn(first, first if i == j else group.filter(pa.array(own == j))))
        arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
        return pa.concat_tables([p.cast(arrow) for p in parts]) if parts else arrow.empty_table()

    return rows.drop("_other").groupBy("_i", "_j").applyInArrow(run, schema)


def meet_blocks(rows: DataFrame, row_key: str, vec: str, targets: DataFrame, key: str, target_vec: str,
                fn: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """``fn`` applied to each pair of a block of rows and a block of targets.

    Rows travel once for each block of targets and targets once for each block of rows.
    """
    shards, blocks = block_count(rows, vec), block_count(targets, target_vec)
    left = rows.withColumn("_shard", dealt(row_key, shards)).withColumn("_block", _every(blocks))
    right = targets.select(F.col(key).alias("_key"), F.col(target_vec).cast("array<double>").alias("_vector"))
    right = right.withColumn("_block", dealt("_key", blocks, 1)).withColumn("_shard", _every(shards))
    empty = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields]).empty_table()

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        return fn(one, other).cast(empty.schema) if one.num_rows and other.num_rows else empty

    cell = ["_shard", "_block"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, schema)


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a number for each row, fixed by a reliable checkpoint."""
    return checkpoint(df.withColumn(name, F.monotonically_increasing_id()))


def strip(columns: int) -> int:
    """Rows of a matrix of so many columns that are worked on at once."""
    return max(1, min(512, STRIP_BYTES // max(1, 8 * columns)))


def distances(x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Euclidean distances of all rows of ``x`` to all of ``y``, a strip of rows at a time; a row's own is 0."""
    squares, step = (y * y).sum(axis=1), strip(len(y))
    for at in range(0, len(x), step):
        part = x[at:at + step]
        d = part @ y.T
        d *= 2.0
        np.subtract((part * part).sum(axis=1)[:, None] + squares, d, out=d)
        np.sqrt(np.maximum(d, 0.0, out=d), out=d)
        if same:
            d[np.arange(len(part)), np.arange(at, at + len(part))] = 0.0
        yield at, d


def coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values (null is one) and the place of each row's value among them."""
    coded = column.combine_chunks()
    coded = pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded
    coded = coded.dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def cluster_distances(df: DataFrame, row_id: str, clusters: Sequence[str], vec: str) -> DataFrame:
    """``row_id, labelling, own, cluster, total``: sum of the distances of each row to all rows of each cluster, its own included.

    ``clusters`` are one or more labellings of the rows, of one type; ``labelling`` is the column's name. Distances are computed once for all of them.
    Blocks meet pairwise; each pair of blocks gives partial sums for the rows of both, which are added up by row and
    cluster.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    kind = kinds[clusters[0]]
    schema = T.StructType([T.StructField("_id", kinds[row_id]), T.StructField("labelling", T.StringType()), T.StructField("own", kind), T.StructField("cluster", kind),
                           T.StructField("total", T.DoubleType())])
    rows = df.select(F.col(row_id).alias("_id"), F.col(vec).cast("array<double>").alias("_vec"), *[F.col(c).cast(kind).alias(f"_c{i}") for i, c in enumerate(clusters)])

    def partial(of: pa.Table, place: int, values: pa.Array, sums: np.ndarray) -> pa.Table:
        n, k = sums.shape
        pick = pa.array(np.repeat(np.arange(n), k))
        return pa.table([of["_id"].take(pick), pa.repeat(clusters[place], n * k), of[f"_c{place}"].take(pick), values.take(pa.array(np.tile(np.arange(k), n))), pa.array(sums.ravel())],
                        names=schema.names)

    def compare(one: pa.Table, other: pa.Table) -> Iterator[pa.Table]:
        if not one.num_rows or not other.num_rows:
            return
        x, same = to_matrix(one["_vec"])[0], one is other
        y = x if same else to_matrix(other["_vec"])[0]
        coded_one = [coded(one[f"_c{i}"]) for i in range(len(clusters))]
        coded_other = [coded(other[f"_c{i}"]) for i in range(len(clusters))]
        hot_one, hot_other = ([np.eye(len(names))[code] for names, code in side] for side in (coded_one, coded_other))
        left = [np.zeros((len(x), h.shape[1])) for h in hot_other]
        right = [np.zeros((len(y), h.shape[1])) for h in hot_one]
        for at, d in distances(x, y, same):
            for i in range(len(clusters)):
                left[i][at:at + len(d)] = d @ hot_other[i]
                if not same:
                    right[i] += d.T @ hot_one[i][at:at + len(d)]
        for i in range(len(clusters)):
            yield partial(one, i, coded_other[i][0], left[i])
            if not same:
                yield partial(other, i, coded_one[i][0], right[i])

    parts = pair_blocks(rows, "_id", "_vec", compare, schema)
    return parts.groupBy("_id", "labelling", "own", "cluster").agg(F.sum("total").alias("total")).withColumnRenamed("_id", row_id)


def silhouettes_of(df: DataFrame, row_id: str, clusters: Sequence[str], vec: str) -> DataFrame:
    """``row_id, labelling, silhouette`` of every row with a vector, for each labelling that gives it a cluster; by Euclidean distance over all rows.

    Members of clusters of one row get 0, and so does every row if there is one cluster only. Row ids are unique.
    """
    rows = df.select(row_id, *clusters, vec).filter(F.col(vec).isNotNull())
    labelled = F.explode(F.array(*[F.struct(F.lit(c).alias("labelling"), F.col(c).cast(df.schema[clusters[0]].dataType).alias("cluster")) for c in clusters]))
    sizes = rows.select(labelled.alias("_l")).select("_l.*").filter(F.col("cluster").isNotNull()).groupBy("labelling", "cluster").agg(F.count(F.lit(1)).alias("_n"))
    sums = cluster_distances(rows, row_id, clusters, vec).filter(F.col("own").isNotNull())
    inside = F.col("own") == F.col("cluster")
    means = (sums.join(small_side(sizes), ["labelling", "cluster"]).groupBy(row_id, "labelling")
             .agg(F.max(F.when(inside & (F.col("_n") > 1), F.col("total") / (F.col("_n") - 1))).alias("_a"),
                  F.min(F.when(~inside, F.col("total") / F.col("_n"))).alias("_b")))
    top = F.greatest("_a", "_b")
    value = F.when(F.col("_a").isNull() | F.col("_b").isNull() | (top <= 0), 0.0).otherwise((F.col("_b") - F.col("_a")) / top)
    return means.select(row_id, "labelling", value.alias("silhouette"))


def silhouettes(df: DataFrame, row_id: str, cluster: str, vec: str) -> DataFrame:
    """``row_id, silhouette`` of every row with a vector and a cluster (see :func:`silhouettes_of`)."""
    return silhouettes_of(df, row_id, [cluster], vec).drop("labelling")


def mean_gap(centres: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean distance between distinct rows; one row ``inter_mean``, null for fewer than two."""
    schema = T.StructType([T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    rows = centres.select(F.col(key).alias("_id"), F.col(vec).cast("array<double>").alias("_vec")).filter(F.col("_vec").isNotNull())

    def compare(one: pa.Table, other: pa.Table) -> Iterator[pa.Table]:
        if one.num_rows and other.num_rows:
            x, same = to_matrix(one["_vec"])[0], one is other
            total = sum(float(d.sum()) for _, d in distances(x, x if same else to_matrix(other["_vec"])[0], same))
            pairs = len(x) * (len(x) - 1) // 2 if same else len(x) * other.num_rows
            yield pa.table({"s": [total / 2 if same else total], "n": [pairs]})

    return pair_blocks(rows, "_id", "_vec", compare, schema).agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("inter_mean"))


def nearest_in_blocks(df: DataFrame, vec: str, targets: DataFrame, key: str, target_vec: str, id_name: str, sim_name: str) -> DataFrame:
    """Most similar target of each row, blocks of rows against blocks of targets; equal to twelve places, the lowest key wins."""
    kind = targets.schema[key].dataType
    base = numbered(df)
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("loss", T.DoubleType()), T.StructField("id", kind), T.StructField("sim", T.DoubleType())])

    def best(rows: pa.Table, block: pa.Table) -> pa.Table:
        block = block.filter(block["_vector"].is_valid()).sort_by("_key")
        units, x = unit_rows(to_matrix(block["_vector"])[0]), unit_rows(to_matrix(rows["_vec"])[0])
        at, sim = np.zeros(len(x), np.int64), np.zeros(len(x))
        step = strip(len(units))
        for start in range(0, len(x) if len(units) else 0, step):
            sims = x[start:start + step] @ units.T
            found = np.round(sims, 12).argmax(axis=1)
            at[start:start + step], sim[start:start + step] = found, sims[np.arange(len(found)), found]
        rows = rows if len(units) else rows.slice(0, 0)
        n = rows.num_rows
        return pa.table([rows["_row"], pa.array(-np.round(sim[:n], 12)), block["_key"].take(pa.array(at[:n])), pa.array(sim[:n])], names=schema.names)

    rows = base.filter(F.col(vec).isNotNull()).select("_row", F.col(vec).cast("array<double>").alias("_vec"))
    found = meet_blocks(rows, "_row", "_vec", targets, key, target_vec, best, schema)
    top = found.groupBy("_row").agg(F.min(F.struct("loss", "id", "sim")).alias("_best"))
    kept = [c for c in df.columns if c not in (id_name, sim_name)]
    return base.join(top, "_row", "left").select(*kept, F.col("_best.id").alias(id_name), F.col("_best.sim").alias(sim_name))


def best_scores(entities: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest similarities (fewer, if there are fewer) of each entity to each target: entity, target, value."""
    order = np.argsort(entities, kind="stable")
    entities, sims = entities[order], sims[order]
    heads = np.flatnonzero(np.append(True, entities[1:] != entities[:-1])) if len(entities) else np.zeros(0, np.int64)
    if k == 1:
        top, owner = np.maximum.reduceat(sims, heads, axis=0) if len(heads) else sims, entities[heads]
    else:
        sizes = np.diff(np.append(heads, len(entities)))
        large = np.flatnonzero(sizes > k)
        stay = np.repeat(sizes <= k, sizes)
        parts, owners = [sims[stay]], [entities[stay]]
        for i in large:
            part = sims[heads[i]:heads[i] + sizes[i]]
            parts.append(np.partition(part, len(part) - k, axis=0)[len(part) - k:])
            owners.append(np.full(k, entities[heads[i]]))
        top, owner = np.concatenate(parts), np.concatenate(owners)
    n, t = top.shape if top.size else (0, 0)
    return np.repeat(owner[:n], t), np.tile(np.arange(t), n), top.ravel()
