"""Exact order statistics, ranks and running sums that never put a group in one task.

A plain ``row_number() over (partition by class)`` sorts a class in one task, which
fails once a class holds a large share of the rows. Here rows first get a bucket
whose order agrees with the wanted order; buckets are counted (with map-side
combine), and the counts, a small table, are accumulated. A row's rank is the
offset of its bucket plus its rank inside the bucket, so a task only ever sees one
bucket. Cutting at rank k sorts nothing but the one bucket with the k-th row.

* Pseudo-random order: the bucket is a prefix of the seeded md5 digest.
* Order by value: buckets lie between approximate quantiles of the group. A value
  that is itself a quantile gets a bucket of its own, which is split further by the
  digest, since all its rows tie. Ties are ordered by the digest everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import seeded_hash
from tessera.session import checkpoint, small_side

_ORDER = ["_v", "_h"]
GROUP_LIMIT = 1000
#: Rows that a task sketches, unless there are fewer than two such tasks for each core.
SKETCH_ROWS = 1_000_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet; the keys of the right side are dropped."""
    named = {k: f"_right_{i}" for i, k in enumerate(keys)}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()]
    return left.join(right.withColumnsRenamed(named), on, how).drop(*named.values())


def bucket_rows(df: DataFrame) -> int:
    """Buckets for a table, so that one holds about 50,000 rows; 64 to 4,096."""
    return min(4096, max(64, df.count() // 50_000))


def hash_buckets(df: DataFrame, key: str | Column, seed: int | str, digits: int | None = None) -> DataFrame:
    """Buckets for the seeded random order; ``16 ** digits`` of them per group, by default as the rows need."""
    digits = digits or max(3, math.ceil(math.log(bucket_rows(df), 16)) + 1)
    return (df.withColumn("_h", seeded_hash(key, seed)).withColumn("_v", F.lit(0.0))
            .withColumn("_b", F.lit(0)).withColumn("_s", F.substring("_h", 1, digits)))


def value_buckets(df: DataFrame, by: Sequence[str], value: str, key: str | Column,
                  descending: bool = False, buckets: int | None = None, seed: int | str = 0,
                  digits: int = 2) -> DataFrame:
    """Buckets for the order by ``value`` (not NULL), ties by the digest of ``key``.

    Their number follows the rows of the table unless it is given. Rows of a NULL group are a group.
    """
    buckets = buckets or bucket_rows(df)
    v = F.col(value).cast("double")
    df = df.withColumn("_v", -v if descending else v).withColumn("_h", seeded_hash(key, seed))
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = F.array_sort(F.array_distinct(F.percentile_approx("_v", probs, F.lit(20 * buckets))))
    if by:
        splits = df.groupBy(*by).agg(cuts.alias("_cuts"))
        df = null_safe_join(df, small_side(splits), by)
    else:
        df = df.withColumn("_cuts", df.agg(cuts.alias("_cuts")).scalar())
    df = df.withColumn("_at", _cuts_below(buckets))
    df = df.withColumn("_on", F.coalesce(F.get("_cuts", F.col("_at")) == F.col("_v"), F.lit(False)))
    return (df.withColumn("_b", F.col("_at") * 2 + F.col("_on").cast("int"))
            .withColumn("_s", F.when(F.col("_on"), F.substring("_h", 1, digits)).otherwise(F.lit("")))
            .drop("_cuts", "_at", "_on"))


def _cuts_below(buckets: int) -> Column:
    """How many of the sorted ``_cuts`` (fewer than ``buckets``) are below ``_v``, by halving: their number follows the rows."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col("_v"), at + step).otherwise(at))


def _offsets(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per bucket: rows in it, rows before it, rows of its group."""
    counts = df.groupBy(*by, "_b", "_s").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*by).orderBy("_b", "_s") if by else Window.orderBy("_b", "_s")
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    return (counts.withColumn("_before", F.sum("_n").over(run) - F.col("_n"))
            .withColumn("_total", F.sum("_n").over(whole)))


def _clean(df: DataFrame) -> DataFrame:
    return df.drop("_v", "_h", "_b", "_s", "_n", "_before", "_total", "_k", "_r")


def rank_rows(bucketed: DataFrame, by: Sequence[str], name: str = "rank") -> DataFrame:
    """Exact 1-based rank of every row in its group, in bucket order."""
    inside = Window.partitionBy(*by, "_b", "_s").orderBy(*_ORDER)
    joined = null_safe_join(bucketed, small_side(_offsets(bucketed, by), 500_000), [*by, "_b", "_s"])
    return _clean(joined.withColumn(
        name, (F.col("_before") + F.row_number().over(inside)).cast("long")))


def _cuts(bucketed: DataFrame, by: Sequence[str], k: Column,
          totals: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Order key of the k-th row of each group (groups with ``k < 1`` are absent)."""
    table = _offsets(bucketed, by)
    if totals is not None:
        table = totals(table)
    table = table.withColumn("_k", F.least(k.cast("long"), F.col("_total")))
    holds = (F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_n") >= F.col("_k"))
    cut = small_side(table.filter(holds).select(*by, "_b", "_s", "_before", "_k"), 500_000)
    inside = Window.partitionBy(*by, "_b", "_s").orderBy(*_ORDER)
    edge = null_safe_join(bucketed.select(*by, "_b", "_s", *_ORDER), cut, [*by, "_b", "_s"])
    return (edge.withColumn("_r", F.col("_before") + F.row_number().over(inside))
            .filter(F.col("_r") == F.col("_k")).select(*by, F.col("_v").alias("_cv"), F.col("_h").alias("_ch")))


def order_statistic(bucketed: DataFrame, by: Sequence[str], k: Column) -> DataFrame:
    """``value`` of the k-th row of each group by ascending value (``k`` may use ``_total``)."""
    return _cuts(bucketed, by, k, None).select(*by, F.col("_cv").alias("value"))


def flag_first(bucketed: DataFrame, by: Sequence[str], k: Column, name: str = "picked",
               totals: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Flag the first ``k`` rows of each group; row keys must be unique.

    ``k`` may use ``_total``, the size of the group, and whatever ``totals`` adds to
    the small bucket table. Only the bucket with the k-th row is sorted, to find that
    row's order key; all rows are then compared with the key of their group, without
    a shuffle. The input is scanned four times: persist it if it is costly.
    """
    cuts = _cuts(bucketed, by, k, totals)
    if by:
        joined = null_safe_join(bucketed, small_side(cuts, 500_000), by, "left")
    else:
        cut = cuts.first()
        joined = (bucketed.withColumn("_cv", F.lit(cut["_cv"] if cut else None).cast("double"))
                  .withColumn("_ch", F.lit(cut["_ch"] if cut else None).cast("string")))
    first = (F.col("_v") < F.col("_cv")) | ((F.col("_v") == F.col("_cv")) & (F.col("_h") <= F.col("_ch")))
    return _clean(joined.withColumn(name, F.coalesce(first, F.lit(False))).drop("_cv", "_ch"))


def take_first(bucketed: DataFrame, by: Sequence[str], k: Column,
               totals: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    return flag_first(bucketed, by, k, "_pick", totals).filter("_pick").drop("_pick")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
          name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    Up to 1000 Spark cuts each map task to ``k`` rows per group before the shuffle
    (window group limit), so no task sorts a whole hot group. For more, rows are dealt to
    ranges of (group, order), which split a hot group; ranges are counted, and a
    row's rank is the rows of its group in earlier ranges plus its rank in its own. Both compare in
    the own types of the columns and give the same rows.
    """
    if k <= GROUP_LIMIT:
        return (df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
                .filter(F.col(name) <= k).withColumn(name, F.col(name).cast("long")))
    dealt = checkpoint(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*by).orderBy("_p") if by else Window.orderBy("_p")
    early = counts.withColumn("_before", F.sum("_n").over(run) - F.col("_n")).filter(F.col("_before") < k).drop("_n")
    inside = Window.partitionBy(*by, "_p").orderBy(*order)
    return (null_safe_join(dealt, small_side(early, 500_000), [*by, "_p"])
            .withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("long"))
            .filter(F.col(name) <= k).drop("_p", "_before"))


def first_n(df: DataFrame, by: Sequence[str], key: str, n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows of each group by a unique key of any ordered type."""
    return top_k(df, by, [F.col(key)], n, name)


def number_rows(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers from ``start`` in the order of the columns, without sorting the table in one task."""
    dealt = checkpoint(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("_p").orderBy(*order)
    return (dealt.join(small_side(before, 500_000), "_p")
            .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1 + start).drop("_p", "_before"))


def exclusive_sums(df: DataFrame, by: Sequence[str], value: str, columns: Sequence[str],
                   buckets: int | None = None) -> DataFrame:
    """Sum of ``columns`` over all rows of the group with a smaller ``value``.

    ``value`` must be distinct within a group (aggregate ties first). Adds
    ``below_<column>``.
    """
    b = value_buckets(df, by, value, F.col(value), buckets=buckets, digits=0)
    sums = b.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    run = Window.partitionBy(*by).orderBy("_b") if by else Window.orderBy("_b")
    for c in columns:
        sums = sums.withColumn(f"_o_{c}", F.sum(f"_t_{c}").over(run) - F.col(f"_t_{c}"))
    joined = null_safe_join(b, small_side(sums), [*by, "_b"])
    inside = (Window.partitionBy(*by, "_b").orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for c in columns:
        joined = joined.withColumn(f"below_{c}",
                                   F.col(f"_o_{c}") + F.sum(c).over(inside) - F.col(c))
    return _clean(joined.drop(*[f"_t_{c}" for c in columns], *[f"_o_{c}" for c in columns]))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    accuracy: int = 2_000) -> DataFrame:
    """Exact interpolated quantiles of whole columns; one row, arrays by column.

    A scan brackets each wanted order statistic with a mergeable sketch of bounded size;
    then the values below each bracket are counted and only those inside it (about
    ``4 / accuracy`` of the rows) are combined by value and shuffled. A bracket of one value that is counted often enough
    is that value, so frequent values are not taken out of their rows. One task merges the sketches of all tasks,
    so they are coarse and made by few tasks; ``accuracy`` trades their size for rows inside the brackets and changes no result. A bracket that
    should miss its statistic fails the query. Columns without a value give NULLs. The input is
    scanned four times: persist it if it is costly to compute.
    """
    margin = 2.0 / accuracy
    sizes = df.agg(*[F.count(c).alias(c) for c in columns]).first()

    def edges(n: int) -> Column:
        """Shares of ``n`` values that hold both neighbours of every wanted position between them."""
        spots = [((n - 1) * float(p), float(p)) for p in probs]
        return F.array(*[F.lit(min(1.0, max(0.0, e))) for at, _ in spots
                         for e in ((math.floor(at) - 1) / n - margin, (math.ceil(at) + 2) / n + margin)])

    some = [c for c in columns if sizes[c]]
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, max(sizes) // SKETCH_ROWS)
    sketch = df.coalesce(tasks).agg(*[F.percentile_approx(c, edges(sizes[c]), F.lit(accuracy)).alias(c) for c in some]).first() if some else {}
    cells, counts = [], []
    for ci, c in enumerate(columns):
        x = F.col(c).cast("double")
        for pi, p in enumerate(probs):
            if c not in some:
                continue
            least, most = (float(v) for v in sketch[c][2 * pi:2 * pi + 2])
            # A little wider: an input that is computed anew may differ in its last bits.
            lo, hi = (v + side * 1e-9 * (abs(v) + 1e-9) for side, v in zip((-1, 1), (least, most)))
            pos = (sizes[c] - 1) * float(p)
            counts += [count.alias(f"{name}{len(cells)}") for name, count in (
                ("b", F.count_if(x < lo)), ("u", F.count_if(x < least)), ("s", F.count_if(x == least))) if name == "b" or least == most]
            inside = (x >= lo) & (x <= hi)
            cells.append((inside, F.when(inside, F.struct(F.lit(ci).alias("ci"), F.lit(pi).alias("pi"), x.alias("x"))), ci, pi, pos, least if least == most else None))
    if not cells:
        return df.sparkSession.createDataFrame([([None] * len(probs),) * len(columns)], ", ".join(f"`{c}` array<double>" for c in columns))
    below = df.agg(*counts).first()
    known = {c[2] for c in cells}
    sure = {i for i, c in enumerate(cells) if c[5] is not None and below[f"u{i}"] <= math.floor(c[4]) and math.ceil(c[4]) < below[f"u{i}"] + below[f"s{i}"]}
    settled = df.sparkSession.createDataFrame([(cells[i][2], cells[i][3], cells[i][5], cells[i][5], 0.0) for i in sorted(sure)], "ci int, pi int, xf double, xc double, w double")
    lookup = df.sparkSession.createDataFrame(
        [(c[2], c[3], c[4], int(below[f"b{i}"])) for i, c in enumerate(cells) if i not in sure],
        "ci int, pi int, pos double, below long")
    open_cells = [c for i, c in enumerate(cells) if i not in sure]
    hit = reduce(or_, [c[0] for c in open_cells], F.lit(False))
    inside = F.array(*[c[1] for c in open_cells]) if open_cells else F.lit(None).cast("array<struct<ci:int,pi:int,x:double>>")
    counted = (df.filter(hit).select(F.explode(F.array_compact(inside)).alias("m"))
               .groupBy("m.ci", "m.pi", "m.x").agg(F.count(F.lit(1)).alias("n")))
    order = (Window.partitionBy("ci", "pi").orderBy("x")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (counted.join(F.broadcast(lookup), ["ci", "pi"])
              .withColumn("end", F.col("below") + F.sum("n").over(order))
              .withColumn("start", F.col("end") - F.col("n")))

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("start") <= index) & (index < F.col("end")), F.col("x")))

    f, c = F.floor("pos"), F.ceil("pos")
    found = ranked.groupBy("ci", "pi").agg(at(f).alias("xf"), at(c).alias("xc"),
                                           F.max(F.col("pos") - f).alias("w")).unionByName(settled)
    held = F.col("xf").isNotNull() & F.col("xc").isNotNull()
    value = F.when(held, F.col("xf") + (F.col("xc") - F.col("xf")) * F.col("w")).otherwise(
        F.raise_error(F.lit("quantile bracket missed its order statistic")).cast("double"))
    by_col = found.select("ci", F.struct("pi", value.alias("q")).alias("s"))
    none = F.array(*[F.lit(None).cast("double") for _ in probs])
    return by_col.groupBy().agg(*[
        (F.transform(F.array_sort(F.collect_list(F.when(F.col("ci") == ci, F.col("s")))),
                     lambda s: s["q"]) if ci in known else none).alias(c) for ci, c in enumerate(columns)])


def exact_group_medians(df: DataFrame, by: Sequence[str], columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Exact median of each column (double) in each group, NULLs skipped; a row for each group, a NULL group is one.

    As in :func:`exact_quantiles`, a sketch for each group and column brackets both middle values. Values beyond their bracket
    are only counted, by side, before anything is shuffled; those inside (about ``4 / accuracy`` of the rows) are
    combined by value. A bracket that should miss fails the query. The input is scanned twice.
    """
    margin = 2.0 / accuracy
    edges = F.array(F.lit(0.5 - margin), F.lit(0.5 + margin))
    groups = small_side(df.groupBy(*by).agg(*[F.percentile_approx(c, edges, F.lit(accuracy)).alias(f"_e{i}") for i, c in enumerate(columns)]))

    def wider(edge: Column, side: int) -> Column:
        # An input that is computed anew may differ in its last bits.
        return F.when(F.abs(edge) < float("inf"), edge + side * 1e-9 * (F.abs(edge) + 1e-9)).otherwise(edge)

    def cell(i: int, x: Column) -> Column:
        side = F.when(x < wider(F.col(f"_e{i}")[0], -1), -1).when(x > wider(F.col(f"_e{i}")[1], 1), 1).otherwise(0)
        return F.when(x.isNotNull(), F.struct(F.lit(i).alias("_f"), side.alias("_side"), F.when(side == 0, x).alias("_x")))

    cells = F.explode(F.array_compact(F.array(*[cell(i, F.col(c)) for i, c in enumerate(columns)]))).alias("_m")
    counted = (null_safe_join(df, groups, by).select(*by, cells).groupBy(*by, "_m._f", "_m._side", "_m._x")
               .agg(F.count(F.lit(1)).alias("_n")))
    whole = Window.partitionBy(*by, "_f")
    run = whole.orderBy("_side", "_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_total", F.sum("_n").over(whole)).withColumn("_end", F.sum("_n").over(run))
    value = F.when(F.col("_side") == 0, F.col("_x")).otherwise(F.raise_error(F.lit("median bracket missed its order statistic")).cast("double"))

    def at(i: int, k: Column) -> Column:
        holds = (F.col("_f") == i) & (F.col("_end") >= k) & (F.col("_end") - F.col("_n") < k)
        return F.max(F.when(holds, value))

    first, second = (F.floor((F.col("_total") + i) / 2) for i in (1, 2))
    wide = ranked.groupBy(*by).agg(*[((at(i, first) + at(i, second)) / 2).alias(c) for i, c in enumerate(columns)])
    return null_safe_join(groups.select(*by), wide, by, "left")
