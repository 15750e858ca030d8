"""The registered model queries fit with all restarts and say whether the fit settled."""

import pytest

from tessera import catalog
from tessera.operators import clustering
from tessera.plans import variants

SF = "/root/testdata/sf0.001"


class Fitted(Exception):
    pass


@pytest.mark.parametrize("name", ["panel_gmm", "ablation", "score_records", "model_round_trip"])
def test_queries_fit_with_all_restarts(spark, monkeypatch, name):
    def stop(data, k, *, n_init=3, **options):
        raise Fitted(n_init)

    catalog.load_all()
    monkeypatch.setattr(clustering, "fit_mixtures", stop)
    with pytest.raises(Fitted) as seen:
        catalog.QUERIES[name](spark, SF)
    assert seen.value.args == (3,)


def test_sweep_fits_with_all_restarts(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(60)], "i int, v array<double>")
    seen = []
    fit = variants.fit_centres
    monkeypatch.setattr(variants, "fit_centres", lambda d, ks, *, n_init, max_iter, seed: seen.append((n_init, max_iter)) or fit(d, ks, n_init=n_init, max_iter=max_iter, seed=seed))
    assert all(r["converged"] is True for r in variants.k_sweep(df, "v", "i", [2, 3]).collect()) and seen == [(10, 300)]


def test_ablation_returns_converged(spark):
    df = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0], i % 2) for i in range(60)], "i int, v array<double>, y int")
    one = variants.Variant("A", df["v"], k=2, dims=None)
    assert [r["converged"] for r in variants.run_variants(df, [one], "i", "y").collect()] == [True]
    assert [r["converged"] for r in variants.run_variants(df, [one], "i", "y", max_iter=1).collect()] == [False]
