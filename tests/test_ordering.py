"""Ranks, cuts, sums and quantiles against brute force, with hot groups and ties."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import ordering as o
from tessera.operators.sampling import (class_cap, first_per_class, flag_top_fraction, stratified_split,
                                        top_fraction)


def _digest(key, seed):
    return hashlib.md5(f"{key}|{seed}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds most rows, one value repeats in a third of them."""
    rng = np.random.default_rng(5)
    rows = [(i, "hot" if i % 10 < 7 else ("warm" if i % 10 < 9 else "cold"),
             0.5 if i % 3 == 0 else float(np.round(rng.normal(), 2))) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, cls string, v double"), rows


def test_rank_by_value_with_ties(skewed):
    df, rows = skewed
    got = {r["id"]: r["rank"] for r in o.rank_rows(
        o.value_buckets(df, ["cls"], "v", "id", descending=True, buckets=16), ["cls"]).collect()}
    for cls in ("hot", "warm", "cold"):
        want = sorted((r for r in rows if r[1] == cls), key=lambda r: (-r[2], _digest(r[0], 0)))
        assert [got[r[0]] for r in want] == list(range(1, len(want) + 1))


def test_rank_of_whole_table(skewed):
    df, rows = skewed
    got = {r["id"]: r["rank"] for r in o.rank_rows(o.hash_buckets(df, "id", 3, digits=1), []).collect()}
    want = sorted((r[0] for r in rows), key=lambda i: _digest(i, 3))
    assert [got[i] for i in want] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("k", [0, 1, 17, 699, 3000])
def test_take_first(skewed, k):
    df, rows = skewed
    got = {r["id"] for r in o.take_first(o.value_buckets(df, ["cls"], "v", "id", buckets=8), ["cls"], F.lit(k)).collect()}
    want = set()
    for cls in ("hot", "warm", "cold"):
        want |= {r[0] for r in sorted((r for r in rows if r[1] == cls), key=lambda r: (r[2], _digest(r[0], 0)))[:k]}
    assert got == want


def test_hot_value_is_split_over_buckets(skewed):
    df, rows = skewed
    b = o.value_buckets(df, ["cls"], "v", "id", buckets=16)
    largest = b.groupBy("cls", "_b", "_s").count().agg(F.max("count")).first()[0]
    assert largest < 300


def test_exclusive_sums(spark):
    rows = [("a", float(i), i % 7) for i in range(500)] + [("b", 1.0, 3)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = {(r["g"], r["v"]): r["below_n"] for r in o.exclusive_sums(df, ["g"], "v", ["n"], buckets=10).collect()}
    for g, v, _ in rows:
        assert got[(g, v)] == sum(n for h, w, n in rows if h == g and w < v)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, 1.0, 1.0, 2.5]), st.floats(-1e3, 1e3)), min_size=60, max_size=300))
def test_quantiles_by_bracket_are_exact(spark, values):
    if sum(v is not None for v in values) < 45:
        return
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = o.exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.9, 1.0], accuracy=20).first()["v"]
    want = np.quantile([v for v in values if v is not None], [0.0, 0.25, 0.5, 0.9, 1.0])
    assert np.allclose(got, want)


def test_quantiles_of_large_columns(spark):
    rng = np.random.default_rng(1)
    data = np.column_stack([rng.normal(size=20000), np.where(rng.random(20000) < 0.4, 7.0, rng.random(20000))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double")
    got = o.exact_quantiles(df, ["a", "b"], [0.1, 0.5, 0.75], accuracy=200).first()
    for i, c in enumerate("ab"):
        assert np.allclose(got[c], np.quantile(data[:, i], [0.1, 0.5, 0.75]))


def test_quantiles_of_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    got = o.exact_quantiles(df, ["a", "b"], [0.5]).first()
    assert got["b"] == [1.0] and got["a"] == [None]


def test_top_k_above_window_limit(skewed):
    df, rows = skewed
    got = o.first_n(df, ["cls"], "id", 1200)
    hot = sorted(r[0] for r in rows if r[1] == "hot")[:1200]
    assert {r["id"]: r["rank"] for r in got.filter("cls = 'hot'").collect()} == {i: n + 1 for n, i in enumerate(hot)}


@pytest.mark.parametrize("n", [900, 1500])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_first_n_in_the_keys_own_type(spark, n, kind):
    base = spark.range(4000).select(F.when(F.col("id") % 10 < 8, F.lit("hot")).alias("cls"), ((1 << 60) + F.col("id")).cast(kind).alias("k"))
    got = {(r["cls"], r["k"]): r["rank"] for r in o.first_n(base, ["cls"], "k", n).collect()}
    want = {}
    for cls in ("hot", None):
        keys = sorted(r["k"] for r in base.collect() if r["cls"] == cls)
        want |= {(cls, k): i + 1 for i, k in enumerate(keys[:n])}
    assert got == want


def test_null_group_keeps_its_rows(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 4 > 0, F.lit("a")).alias("cls"), F.col("id").cast("double").alias("v"))
    ranked = o.rank_rows(o.value_buckets(df, ["cls"], "v", "id"), ["cls"])
    assert ranked.count() == 40 and ranked.filter("cls is null").agg(F.max("rank")).first()[0] == 10
    assert flag_top_fraction(df, ["cls"], "v", "id", 0.5, F.col("v") >= 0).groupBy("kept").count().count() == 2
    assert class_cap(df, "cls", "id", 1).filter("cls is null").count() == 10


def test_group_medians_of_a_hot_and_a_null_group(spark):
    from tessera.operators.prepare import group_medians, impute_by_group
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 10 else None, float(rng.integers(0, 50)) if i % 7 else None, None if i % 10 else 1.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    got = {r["g"]: (r["a"], r["b"]) for r in group_medians(df, ["a", "b"], ["g"]).collect()}
    for g, b in (("hot", None), (None, 1.0)):
        assert got[g] == (np.median([r[1] for r in rows if r[0] == g and r[1] is not None]), b)
    assert impute_by_group(df, ["a", "b"], ["g"]).filter("a is null").count() == 0


def test_quantile_of_a_null_column_beside_a_long_one(spark):
    df = spark.range(150_000).select(F.col("id").cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    got = o.exact_quantiles(df, ["a", "b"], [0.5]).first()
    assert got["a"] == [74999.5] and got["b"] == [None]


def test_no_task_holds_a_large_share_of_a_group(spark):
    df = spark.range(200_000).select("id", F.lit("one").alias("cls"), (F.col("id") % 3).cast("double").alias("v"))
    b = o.value_buckets(df, ["cls"], "v", "id")
    assert b.groupBy("cls", "_b", "_s").count().agg(F.max("count")).first()[0] < 4000
    big = o.top_k(df, ["cls"], [F.col("id").desc()], 150_000)
    assert big.count() == 150_000 and big.agg(F.min("id")).first()[0] == 50_000


def test_class_cap_golden(spark):
    """2,242 rows of the smallest class cap the others at 6,726."""
    df = (spark.range(2242).select("id", F.lit("d").alias("y"))
          .unionAll(spark.range(10000, 18000).select("id", F.lit("n").alias("y"))))
    got = {r["y"]: r["count"] for r in class_cap(df, "y", "id", 42).groupBy("y").count().collect()}
    assert got == {"d": 2242, "n": 6726}
    test = {r["y"]: r["count"] for r in stratified_split(class_cap(df, "y", "id", 42), "y", "id", 1)
            .filter("is_test").groupBy("y").count().collect()}
    assert test == {"d": 448, "n": 1345}


def test_top_fraction_keeps_at_least_one(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", 99, 1.0)], "g string, id long, s double")
    got = top_fraction(df, ["g"], "s", "id", 0.25)
    assert sorted(r["id"] for r in got.collect()) == [7, 8, 9, 99]
    flags = flag_top_fraction(df, ["g"], "s", "id", 0.25, F.col("s") > 100)
    assert flags.filter("kept").count() == 0 and flags.count() == 11


def test_first_per_class_numbers_rows(spark):
    df = spark.createDataFrame([(i, "x") for i in range(12)], "id long, cls string")
    got = first_per_class(df, "cls", "id", 11, F.col("id") != 0).orderBy("id").collect()
    assert [r["split"] for r in got][:6] == ["val", "train", "train", "train", "train", "val"] and len(got) == 11


def test_group_medians_count_what_lies_beyond_the_bracket(spark, monkeypatch):
    """No row is numbered or given a bucket; what is shuffled are counts and the values around the middle."""
    from tessera.operators import prepare

    rng = np.random.default_rng(8)
    inf, nan = float("inf"), float("nan")
    rows = [(None if i % 7 == 0 else i % 3, None if i % 5 == 0 else float(np.round(rng.normal(), 3)), 1.5 if i % 2 else float(i), [inf, -inf, nan, 2.0][i % 4]) for i in range(40_000)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double").repartition(8)
    monkeypatch.setattr(o, "value_buckets", None)
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in prepare.group_medians(df, ["a", "b", "c"], ["g"]).collect()}
    for g in (None, 0, 1, 2):
        mine = [r for r in rows if r[0] == g]
        for place in (1, 2, 3):
            want = sorted((r[place] for r in mine if r[place] is not None), key=lambda v: (v != v, v))
            mid = (want[(len(want) - 1) // 2] + want[len(want) // 2]) / 2
            assert got[g][place - 1] == pytest.approx(mid, rel=1e-12, nan_ok=True)
    shuffled = o.exact_group_medians(df, ["g"], ["a"], 1000)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in shuffled and "md5" not in shuffled


@pytest.mark.parametrize("buckets", [2, 3, 64])
def test_buckets_are_found_by_halving(spark, buckets):
    """Bucket numbers equal those of a comparison with every cut, which the plan no longer makes."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, float(np.round(rng.normal(), 1)) if i % 50 else float("nan")) for i in range(2000)], "id long, v double")
    b = o.value_buckets(df, [], "v", "id", buckets=buckets)
    rows = sorted(((r["_v"], r["_b"], r["_s"]) for r in b.collect()), key=lambda r: (r[0] != r[0], r[0]))
    numbers = [r[1] for r in rows]
    assert numbers == sorted(numbers) and len(set(numbers)) > 1 and max(numbers) <= 2 * buckets
    for odd in {n for n in numbers if n % 2}:  # a value that is a cut has a bucket of its own, split by digest
        assert len({str(r[0] + 0.0) for r in rows if r[1] == odd}) == 1 and all(len(r[2]) == 2 for r in rows if r[1] == odd)
    assert "filter(" not in b._jdf.queryExecution().optimizedPlan().toString()


def test_the_sketches_to_merge_do_not_follow_the_partitions(spark, monkeypatch):
    """One task merges the sketches of all tasks: a few tasks for each core make them, more only as the rows need; the quantiles are exact."""
    import numpy as np

    from tessera.operators import ordering

    x = np.random.default_rng(12).normal(size=3_001)
    df = spark.createDataFrame([(float(v), float(v) if i % 3 else None) for i, v in enumerate(x)], "a double, b double").repartition(60)
    seen, coalesce = [], type(df).coalesce
    monkeypatch.setattr(type(df), "coalesce", lambda self, n: seen.append(n) or coalesce(self, n))
    got = ordering.exact_quantiles(df, ["a", "b"], [0.25, 0.5]).first()
    assert np.allclose(got["a"], np.quantile(x, [0.25, 0.5])) and np.allclose(got["b"], np.quantile(x[np.arange(3_001) % 3 > 0], [0.25, 0.5]))
    monkeypatch.setattr(ordering, "SKETCH_ROWS", 100)
    assert np.allclose(ordering.exact_quantiles(df, ["a"], [0.5]).first()["a"], np.median(x))
    assert seen == [2 * spark.sparkContext.defaultParallelism, 30]


def test_frequent_values_are_settled_by_counting(spark, monkeypatch):
    """A bracket of one value needs no rows: only columns without such a value are taken apart, and all quantiles are exact."""
    rng = np.random.default_rng(17)
    data = np.column_stack([rng.integers(1, 4, 9000), rng.normal(size=9000), np.where(np.arange(9000) < 4500, 1.0, 2.0)]).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")
    taken, array = [], F.array
    monkeypatch.setattr(o.F, "array", lambda *cols: taken.append(str(cols)) or array(*cols))
    got = o.exact_quantiles(df, ["a", "b", "c"], [0.5], accuracy=100).first()
    cells = [t for t in taken if "AS ci" in t and "AS pi" in t]
    assert len(cells) == 1 and "0 AS ci" not in cells[0] and "1 AS ci" in cells[0] and "2 AS ci" in cells[0]
    assert all(np.isclose(got[c][0], np.median(data[:, i])) for i, c in enumerate("abc"))
    ties = df.select("a")
    assert o.exact_quantiles(ties, ["a"], [0.1, 0.5, 0.9], accuracy=100).first()["a"] == np.quantile(data[:, 0], [0.1, 0.5, 0.9]).tolist()
