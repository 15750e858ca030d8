"""Operators on blocks against plain versions, in one block and in many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, concepts, vectors
from tessera.operators.metrics import silhouette


def plain_silhouettes(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = np.zeros(len(x))
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() < 2 or own.all():
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels.tolist()) - {labels[i]})
        out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def points(n=300, d=5, seed=1):
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 4, n)
    x = rng.normal(size=(n, d)) + 2.0 * labels[:, None]
    x[10:40] = x[10]  # copies
    labels[0] = 9  # a cluster of one row
    return x, labels


@pytest.mark.parametrize("wanted", [1, 20])
def test_silhouette_in_blocks(spark, monkeypatch, wanted):
    x, labels = points()
    df = spark.createDataFrame([(f"r{i}", v.tolist(), int(c), int(c) % 2) for i, (v, c) in enumerate(zip(x, labels))], "id string, v array<double>, c int, c2 int")
    monkeypatch.setattr(blocks, "block_count", lambda *a, **k: wanted)
    got = {r["id"]: r["silhouette"] for r in blocks.silhouettes(df, "id", "c", "v").collect()}
    want = plain_silhouettes(x, labels)
    assert len(got) == 300 and all(got[f"r{i}"] == pytest.approx(want[i], abs=1e-7) for i in range(300))
    both = {(r["id"], r["labelling"]): r["silhouette"] for r in blocks.silhouettes_of(df, "id", ["c", "c2"], "v").collect()}
    other = plain_silhouettes(x, labels % 2)
    assert all(both[f"r{i}", "c"] == pytest.approx(want[i], abs=1e-7) and both[f"r{i}", "c2"] == pytest.approx(other[i], abs=1e-7) for i in range(300))
    assert silhouette(df, "c", "v", "id").first()[0] == pytest.approx(want.mean(), abs=1e-7)
    one = blocks.silhouettes(df.withColumn("c", F.lit("all")), "id", "c", "v").agg(F.min("silhouette"), F.max("silhouette"), F.count("*")).first()
    assert tuple(one) == (0.0, 0.0, 300)
    gap = blocks.mean_gap(df, "id", "v").first()[0]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert gap == pytest.approx(d[np.triu_indices(300, 1)].mean())


def test_block_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, [1.0, 0.0], None), (3, [0.0, 1.0], 1), (4, [0.0, 1.0], 1), (5, [2.0, 1.0], 2)], "id int, v array<double>, c int")
    got = {r["id"]: r["silhouette"] for r in vectors.euclidean_silhouette(df, "v", "c", "id").collect()}
    assert got == {1: None, 2: None, 3: 1.0, 4: 1.0, 5: 0.0}
    assert blocks.silhouettes(df.limit(0), "id", "c", "v").count() == 0
    assert blocks.mean_gap(df.filter("id = 3"), "id", "v").first()[0] is None
    targets = spark.createDataFrame([], "k int, vector array<double>")
    assert blocks.nearest_in_blocks(df, "v", targets, "k", "vector", "n", "s").filter("n is not null").count() == 0


@pytest.mark.parametrize("wanted", [1, 7])
def test_nearest_and_best_scores_in_blocks(spark, monkeypatch, wanted):
    rng = np.random.default_rng(2)
    x, t = rng.normal(size=(400, 6)), rng.normal(size=(90, 6))
    t[50] = t[3]  # a tie: the lower key wins
    entities = np.where(np.arange(400) % 3 == 0, 0, np.arange(400) % 23)  # one holds a third of the rows
    df = spark.createDataFrame([(i, int(e), v.tolist()) for i, (e, v) in enumerate(zip(entities, x))] + [(400, 77, None)], "id int, e int, v array<double>").repartition(5)
    targets = spark.createDataFrame([(f"k{i:02d}", v.tolist()) for i, v in enumerate(t)] + [("k99", None)], "k string, vector array<double>")
    sims = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (t / np.linalg.norm(t, axis=1, keepdims=True)).T
    monkeypatch.setattr(vectors, "TABLE_ROWS", 4)
    monkeypatch.setattr(blocks, "block_count", lambda *a, **k: wanted)
    near = {r["id"]: (r["n"], r["s"]) for r in vectors.nearest(df, "v", targets, "k", "n", "s").collect()}
    best = np.round(sims, 12).argmax(axis=1)
    assert near.pop(400) == (None, None)
    assert all(near[i] == (f"k{best[i]:02d}", pytest.approx(sims[i, best[i]])) for i in range(400))
    for how, k in (("top", 10), ("max", 10), ("top", 3)):
        want = {(int(e), f"k{j:02d}"): np.sort(sims[entities == e][:, j])[::-1][:1 if how == "max" else k].mean() for e in set(entities.tolist()) for j in range(90)}
        for bound in (4, 4096):
            monkeypatch.setattr(vectors, "TABLE_ROWS", bound)
            got = {(r["e"], r["k"]): r["score"] for r in concepts.similarity_scores(df, "e", "v", targets, "k", how, k).collect()}
            assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


def test_a_hot_entity_is_spread_over_tasks(spark):
    df = spark.range(0, 4000, 1, 8).select((F.col("id") % 3).alias("e"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    targets = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "k int, vector array<double>")
    plan = concepts.similarity_scores(df, "e", "v", targets, "k", k=2)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "WindowGroupLimit" in plan  # states shrink to k before they are shuffled


def test_distances_hold_bounded_strips():
    """A strip of the distance matrix has bounded bytes, however many rows the other block has."""
    from tessera.operators import blocks

    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(300, 2)), rng.normal(size=(50_000, 2))
    whole = np.concatenate([d for at, d in blocks.distances(x, y, False) if d.nbytes <= blocks.STRIP_BYTES])
    assert whole.shape == (300, 50_000)
    assert np.allclose(whole[:, 7], np.sqrt(((x - y[7]) ** 2).sum(axis=1)))


def test_blocks_of_short_vectors_hold_bounded_rows(spark):
    """Keys, clusters and partial results of a row take more room than a short vector, so rows are bounded as well as bytes."""
    rows = spark.range(100_000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    wanted = blocks.block_count(rows, "v")
    assert wanted == 7
    most = rows.groupBy(blocks.dealt("id", wanted)).count().agg(F.max("count")).first()[0]
    assert most < 1.1 * blocks.BLOCK_ROWS
    assert blocks.block_count(rows.limit(100), "v") == 1
