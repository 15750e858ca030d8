"""Shared passes give what separate fits give, and fits are optima."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import classify, clustering, passes
from tessera.operators.moments import co_moments
from tessera.operators.vectors import component_checks, fit_projection


def blobs(seed=3, n=600, d=4, k=3):
    rng = np.random.default_rng(seed)
    c = rng.integers(0, k, n)
    return rng.normal(size=(n, d)) + 6.0 * np.eye(k, d)[c], c


def frame(spark, x, **more):
    rows = [(i, v.tolist(), *[m[i].item() if hasattr(m[i], "item") else m[i] for m in more.values()]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ["id", "v", *more]).repartition(4)


def test_moments_of_groups(spark):
    x, c = blobs()
    got = co_moments(frame(spark, x, c=c), "v", "c")
    for g in range(3):
        part = x[c == g]
        assert got[g].count == len(part) and np.allclose(got[g].mean, part.mean(axis=0)) and np.allclose(got[g].covariance, np.cov(part.T))
        assert np.allclose(got[g].correlation(), np.corrcoef(part.T)) and np.allclose(got[g].spread, part.std(axis=0))
    flat = np.concatenate([x, np.full((len(x), 1), 1e6)], axis=1)  # a constant component, far from 0
    m = co_moments(frame(spark, flat), "v")[None]
    assert np.allclose(m.covariance[:4, :4], np.cov(x.T)) and m.spread[4] == 1.0 and m.correlation()[4, 4] == 1.0


def test_principal_components(spark):
    x, _ = blobs(d=5)
    df = frame(spark, x)
    p = fit_projection(df, "v", 5)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    checks = component_checks(df, "v", p).orderBy("component").collect()
    assert np.allclose([r["variance"] for r in checks], values) and all(r["residual"] < 1e-9 and r["overlap"] < 1e-9 for r in checks)
    assert np.allclose(p.explained, values / values.sum())
    assert fit_projection(df.limit(3), "v", 5).components.shape[1] == 2


def test_panels_fitted_together_equal_those_fitted_alone(spark):
    a, _ = blobs(1, d=4)
    b, _ = blobs(2, d=3)
    long = frame(spark, a).select("id", F.lit("a").alias("panel"), "v").unionByName(frame(spark, b).select("id", F.lit("b").alias("panel"), "v"))
    together = clustering.fit_panels(long, "panel", "v", {"a": 4, "b": 3}, 3)
    for p, w in (("a", 4), ("b", 3)):
        _, alone = clustering.fit_panel(long.filter(F.col("panel") == p), "v", w, 3)
        assert together[p][1].bound == pytest.approx(alone.bound, abs=2e-3) and together[p][1].converged


def test_sums_added_up_on_executors_are_the_same(spark, monkeypatch):
    x, _ = blobs()
    df = frame(spark, x)
    want = clustering.fit_mixture(df, "v", 3)
    monkeypatch.setattr(passes, "DIRECT_BYTES", 1)
    got = clustering.fit_mixture(df, "v", 3)
    assert got.bound == pytest.approx(want.bound) and np.allclose(sorted(got.means.tolist()), sorted(want.means.tolist()))
    assert clustering.fit_kmeans(df, "v", 3).cost == pytest.approx(clustering.fit_kmeans(df, "v", 3).cost)


def test_kmeans_finds_the_blobs(spark):
    x, c = blobs()
    fit = clustering.fit_kmeans(frame(spark, x), "v", 3)
    assert fit.converged and fit.cost == pytest.approx(sum(((x[c == g] - x[c == g].mean(axis=0)) ** 2).sum() for g in range(3)), rel=0.05)
    many = clustering.fit_centres(passes.grouped_vectors(frame(spark, x), "v").persist(), [1, 3, 700], n_init=2, max_iter=20)
    assert many[1].cost == pytest.approx(((x - x.mean(axis=0)) ** 2).sum()) and many[3].cost < many[1].cost and many[700].cost < 1e-6


def test_mini_batches(spark):
    x, c = blobs(n=3000)
    df = frame(spark, x)
    best = clustering.fit_kmeans(df, "v", 3).cost
    fit = clustering.fit_mini_batch(df, "v", "id", 3, batch_rows=256, n_init=4)
    assert fit.converged and best <= fit.cost * 1.0000001 and fit.cost < 1.1 * best
    centres, seen = clustering.mini_batch_update(np.array([[0.0], [5.0]]), np.array([0.0, 3.0]), passes.Sums(np.array([2.0, 0.0]), np.array([[6.0], [0.0]]), np.zeros((2, 0))))
    assert centres.tolist() == [[3.0], [5.0]] and seen.tolist() == [2.0, 3.0]


@pytest.mark.parametrize("standardize, balanced", [(False, False), (True, True)])
def test_linear_fit_is_the_optimum(spark, monkeypatch, standardize, balanced):
    x, c = blobs(5, 400)
    c[:250] = 0
    df = spark.createDataFrame([(int(y), *v.tolist()) for y, v in zip(c, x + np.random.default_rng(1).normal(size=x.shape) * 3)], "y int, a double, b double, c double, d double")
    options = {"standardize": standardize, "balanced": balanced}
    model = classify.fit_linear(df, "y", ["a", "b", "c", "d"], ["p", "q", "r"], **options)
    slopes = classify.linear_gradient(df, "y", model, **options)
    assert slopes.agg(F.max(F.abs("gradient"))).first()[0] < 1e-8 and slopes.count() == 15
    monkeypatch.setattr(classify, "NEWTON_WEIGHTS", 0)
    other = classify.fit_linear(df, "y", ["a", "b", "c", "d"], ["p", "q", "r"], **options)
    assert np.allclose(other.weights, model.weights, atol=2e-3)


def test_checked_inverse_leaves_out_flat_directions():
    full, rank, condition = classify.checked_inverse(np.array([[1.0, 0.5], [0.5, 1.0]]))
    assert np.allclose(full, np.linalg.inv([[1.0, 0.5], [0.5, 1.0]])) and rank == 2 and condition == pytest.approx(3.0)
    same, rank, condition = classify.checked_inverse(np.ones((2, 2)))
    assert np.allclose(same, np.full((2, 2), 0.25)) and rank == 1 and condition > 1e12


def test_one_class_models_of_all_classes_equal_those_fitted_alone(spark):
    x, c = blobs(7)
    df = spark.createDataFrame([(f"g{y}", *v.tolist()) for y, v in zip(c, x)], "y string, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    together = classify.fit_one_class_by(df, "y", cols, ["g0", "g1", "g2"], 0.1)
    for g, m in together.items():
        alone = classify.fit_one_class(df.filter(F.col("y") == g), cols, 0.1)
        part = x[[f"g{y}" == g for y in c]]
        z = (part - part.mean(axis=0)) / part.std(axis=0)
        d2 = np.einsum("ij,jk,ik->i", z, np.linalg.inv(np.corrcoef(part.T)), z)
        assert m.cut == pytest.approx(alone.cut) == pytest.approx(np.quantile(d2, 0.9)) and m.scale == pytest.approx(alone.scale) == pytest.approx(d2.std())
        assert m.rank == 4 and np.allclose(m.precision, alone.precision)


def test_packed_blocks_give_the_sums_of_their_rows(spark):
    """Passes over packed blocks see every row of every group once, also where groups differ in width; unequal widths are refused."""
    rng = np.random.default_rng(4)
    rows = [(g, rng.normal(size=2 + 3 * g).tolist()) for g in rng.integers(0, 2, 5000).tolist()]
    data = spark.createDataFrame(rows, "g int, x array<double>").repartition(3)
    centres = {0: (0, rng.normal(size=(3, 2))), 1: (1, rng.normal(size=(4, 5)))}
    models, shapes = {r: (g, passes.closest(c)) for r, (g, c) in centres.items()}, {r: c.shape for r, (_, c) in centres.items()}
    blocks = passes.packed(data)
    assert blocks.count() < 5000 / 10
    plain, got = passes.weighted_sums(data, models, shapes, 3), passes.weighted_sums(blocks, models, shapes, 3)
    for r in centres:
        assert got[r].rows == plain[r].rows == sum(1 for g, _ in rows if g == r)
        for a, b in ((got[r].n, plain[r].n), (got[r].sx, plain[r].sx), (got[r].sxx, plain[r].sxx), (got[r].value, plain[r].value)):
            assert np.allclose(a, b, rtol=1e-12, atol=1e-9)
    uneven = spark.createDataFrame([(0, [1.0]), (0, [1.0, 2.0])], "g int, x array<double>")
    with pytest.raises(Exception, match="unequal length"):
        passes.weighted_sums(passes.packed(uneven.repartition(1)), {0: (0, passes.closest(np.zeros((1, 1))))}, {0: (1, 1)}, 1)


def test_fits_run_over_packed_blocks(spark, monkeypatch):
    """Neither mixtures nor k-means nor the linear model read vectors one by one in their passes."""
    seen, sums = [], passes.weighted_sums
    for module in (passes, clustering):
        monkeypatch.setattr(module, "weighted_sums", lambda d, *a, **k: seen.append(dict(d.dtypes)["x"]) or sums(d, *a, **k))
    x = np.random.default_rng(5).normal(size=(300, 3))
    df = frame(spark, x)
    clustering.fit_mixture(df, "v", 2, n_init=1, max_iter=3)
    clustering.fit_kmeans(df, "v", 2, n_init=1, max_iter=3)
    assert len(seen) > 4 and set(seen) == {"binary"}
    rows = spark.createDataFrame([(i % 2, float(i % 5), float(i % 3)) for i in range(60)], "y int, a double, b double")
    loss = classify.linear_loss(rows, "y", ["a", "b"], ["p", "q"])
    assert dict(loss.rows.dtypes)["x"] == "binary" and loss.n == 60
    loss.rows.unpersist()


def test_softmax_computes_its_scores_once(spark):
    from tessera.functions.vectors import softmax

    df = spark.createDataFrame([([1.0, 2.0, 3.0],), (None,), ([1000.0, 1000.0],)], "a array<double>")
    scores = F.transform("a", lambda v: v * 2.5)
    out = df.select(softmax(scores).alias("p"))
    got = [r["p"] for r in out.collect()]
    e = np.exp(np.array([2.5, 5.0, 7.5]) - 7.5)
    assert np.allclose(got[0], e / e.sum(), rtol=1e-15) and got[1] is None and got[2] == [0.5, 0.5]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("2.5") == 1
