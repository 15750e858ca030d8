"""Fits over packed blocks: moments, draws and projections without plain rows."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import clustering, moments, passes
from tessera.operators.vectors import projection_of


def test_draws_take_rows_not_values(spark):
    """A vector that half of the rows share makes up half of the draw, however large the table is."""
    many = spark.range(0, 40_000, 1, 4).select(F.lit(0).alias("g"), F.when(F.col("id") % 2 == 0, F.array(F.lit(-1.0), F.lit(0.0)))
                                               .otherwise(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("x"))
    few = spark.createDataFrame([(1, [float(i)]) for i in range(10)], "g int, x array<double>")
    for data in (many.unionByName(few), passes.packed(many.unionByName(few))):
        draw = passes.drawn_rows(data, 42)
        assert draw[0].shape == (passes.SEED_ROWS, 2) and 0.45 < (draw[0][:, 0] == -1.0).mean() < 0.55
        assert sorted(draw[1][:, 0].tolist()) == [float(i) for i in range(10)]


def test_moments_and_projections_of_blocks(spark):
    rng = np.random.default_rng(8)
    x = {0: rng.normal(size=(700, 2)) + 5.0, 1: rng.normal(size=(900, 5))}
    data = spark.createDataFrame([(g, v.tolist()) for g in x for v in x[g]], "g int, x array<double>").repartition(3)
    got = moments.block_moments(passes.packed(data))
    for g in x:
        assert got[g].count == len(x[g]) and np.allclose(got[g].mean, x[g].mean(axis=0)) and np.allclose(got[g].covariance, np.cov(x[g].T))
    assert moments.block_moments(passes.packed(data.limit(0))) == {}
    p = projection_of(got[1], 3)
    rows = [v for b in passes.mapped(passes.packed(data), {1: p.rows}).toArrow().to_batches() for _, m in passes.matrices(b) for v in m]
    assert len(rows) == 900 and np.allclose(np.sort(np.array(rows)[:, 0]), np.sort(p.rows(x[1])[:, 0]))


def test_responsibilities_equal_the_density_formula():
    rng = np.random.default_rng(9)
    x, mix = rng.normal(size=(50, 3)), clustering.DiagonalMixture(np.array([0.2, 0.8]), rng.normal(size=(2, 3)), np.array([[1.0, 0.5, 2.0], [0.1, 3.0, 1.0]]))
    joint = np.log(mix.weights) - 0.5 * (((x[:, None] - mix.means) ** 2 / mix.variances) + np.log(2 * np.pi * mix.variances)).sum(axis=2)
    weight, ll = mix.responsibilities(x)
    assert np.allclose(mix.log_joint(x), joint) and np.allclose(ll, np.log(np.exp(joint).sum(axis=1))) and np.allclose(weight, np.exp(joint - ll[:, None]))


def test_panels_are_fitted_without_plain_vectors_in_the_cache(spark, monkeypatch):
    """Between the records and the passes lie blocks only."""
    kinds, fit = [], clustering.fit_mixtures
    monkeypatch.setattr(clustering, "fit_mixtures", lambda data, *a, **k: kinds.append(dict(data.dtypes)["x"]) or fit(data, *a, **k))
    x = np.random.default_rng(10).normal(size=(400, 3))
    long = spark.createDataFrame([(i, "ab"[i % 2], v[:2 + i % 2].tolist()) for i, v in enumerate(x)], "id int, panel string, v array<double>")
    models = clustering.fit_panels(long, "panel", "v", {"a": 2, "b": 3, "none": 4}, 2, n_init=1, max_iter=3)
    assert kinds == ["binary"] and set(models) == {"a", "b"} and models["b"][0].projection.components.shape == (3, 2)


def test_a_kept_table_is_not_kept_twice(spark):
    from tessera.plans.records import _complete

    rows = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "id int, a double, b double")
    assert _complete(rows, ["a", "b"], 0.5).storageLevel.useMemory
    kept = rows.filter("id < 5").persist()
    assert not _complete(kept, ["a", "b"], 0.5).storageLevel.useMemory and [r["id"] for r in _complete(kept, ["a", "b"], 0.5).collect()] == [1]
    kept.unpersist()


def test_the_outcomes_of_logreg_optimum_come_with_its_records(spark, monkeypatch):
    """The record table is built once; its rows get their outcome by customer, the same rows as by a second record table."""
    from tessera.catalog import fits, fixtures
    from tessera.functions.bands import three_class_outcome
    from tessera.plans.records import deviation_table

    class Stop(Exception):
        pass

    seen, built, lab = [], [], fits.lab

    def build(*args):
        built.append(1)
        return lab(*args)

    def split(rows, *args):
        seen.append(rows)
        raise Stop

    monkeypatch.setattr(fits, "lab", build)
    monkeypatch.setattr(fixtures, "lab", build)
    monkeypatch.setattr(fits, "stratified_split", split)
    sf = "/root/testdata/sf0.001"
    try:
        fits.logreg_optimum(spark, sf)
    except Stop:
        pass
    out = fixtures.with_outcomes(spark, sf, lab(spark, sf).select("record_id")).select("record_id", three_class_outcome("diq", "bpq").alias("y")).filter("y >= 0")
    want = deviation_table(lab(spark, sf), fixtures.FEATURES, fixtures.RANGES, 0.5).join(out, "record_id")
    rows = [sorted((r["record_id"], r["y"], *[round(r[f], 9) for f in fixtures.FEATURES]) for r in d.collect()) for d in (seen[0], want)]
    assert len(built) == 1 and rows[0] == rows[1] and rows[0]


def test_passes_read_several_partitions_in_a_task(spark, monkeypatch):
    """Passes over kept blocks of many small partitions start a few tasks for each core, with the sums of all rows; plain tables stay as they are."""
    x = np.random.default_rng(11).normal(size=(640, 3))
    data = passes.grouped_vectors(spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(80), "x")
    few = passes.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert passes.gathered(data) is data
    with passes.kept_blocks(data, 42) as (draw, blocks):
        assert blocks.rdd.getNumPartitions() == few < 80 and len(draw[0]) == 640
        (n, total), = passes.block_sums(blocks).values()
        assert n == 640 and np.allclose(total[0], x.sum(axis=0))
    kept = passes.packed(data).persist()
    assert kept.count() and passes.gathered(passes.gathered(kept)).rdd.getNumPartitions() == few
    monkeypatch.setattr(passes, "TASKS_PER_CORE", 0)
    assert passes.gathered(kept).rdd.getNumPartitions() == 80 // passes.GATHERED
    kept.unpersist()


def test_newton_passes_read_several_partitions_in_a_task(spark, monkeypatch):
    """Every pass of the linear fit reads the kept blocks gathered, and the fit is the optimum."""
    from tessera.operators import classify

    seen, gathered = [], passes.gathered
    monkeypatch.setattr(classify, "gathered", lambda rows: seen.append(gathered(rows).rdd.getNumPartitions()) or gathered(rows))
    x = np.random.default_rng(13).normal(size=(300, 2))
    df = spark.createDataFrame([(int(v[0] + 0.5 * v[1] > 0.3 * (i % 3)), *v.tolist()) for i, v in enumerate(x)], "y int, a double, b double").repartition(40)
    model = classify.fit_linear(df, "y", ["a", "b"], ["no", "yes"], standardize=True)
    slopes = classify.linear_gradient(df, "y", model, standardize=True).collect()
    assert max(abs(r["gradient"]) for r in slopes) < 1e-6
    assert len(seen) > 3 and set(seen) == {passes.TASKS_PER_CORE * spark.sparkContext.defaultParallelism}


def test_first_passes_over_blocks_are_gathered(spark, monkeypatch):
    """Moments and row counts read several partitions of the kept blocks in a task from their first pass on."""
    from tessera.operators import classify

    seen, sums = [], passes.block_sums
    for module in (moments, classify):
        monkeypatch.setattr(module, "block_sums", lambda blocks, *args: seen.append(blocks.rdd.getNumPartitions()) or sums(blocks, *args))
    x = np.random.default_rng(14).normal(size=(640, 3))
    df = spark.createDataFrame([(i % 2, *v.tolist()) for i, v in enumerate(x)], "y int, a double, b double, c double").repartition(80)
    blocks = passes.packed(df.select(F.lit(0).alias("g"), F.array("a", "b", "c").alias("x"))).persist()
    got = moments.block_moments(blocks)[0]
    blocks.unpersist()
    assert got.count == 640 and np.allclose(got.mean, x.mean(axis=0)) and np.allclose(got.covariance, np.cov(x.T))
    classify.linear_loss(df, "y", ["a", "b"], ["no", "yes"], standardize=True).rows.unpersist()
    assert len(seen) == 4 and set(seen) == {passes.TASKS_PER_CORE * spark.sparkContext.defaultParallelism}


def test_class_probabilities_are_plain_expressions(spark):
    """The softmax of a linear model has no lambda, does not overflow and equals the formula."""
    from tessera.operators.classify import LinearModel

    rng = np.random.default_rng(15)
    for k in (1, 2, 3):
        model = LinearModel(tuple("abc"[:k]), ("x", "y"), rng.normal(size=(k, 2)) * 300.0, rng.normal(size=k))
        x = rng.normal(size=(50, 2))
        out = model.score(spark.createDataFrame(x.tolist(), "x double, y double"))
        z = x @ model.weights.T + model.intercepts
        want = np.exp(z - z.max(axis=1, keepdims=True))
        want /= want.sum(axis=1, keepdims=True)
        rows = out.collect()
        assert out.columns == ["x", "y", "proba", "class_idx", "prediction", "confidence"]
        assert np.allclose([r["proba"] for r in rows], want) and [r["class_idx"] for r in rows] == want.argmax(axis=1).tolist()
        assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()


def test_outcomes_meet_the_records_by_customer(spark, monkeypatch):
    """The scorer learns from the rows that a join by record id would give; the records are not joined to themselves."""
    from tessera.catalog import fixtures, models
    from tessera.functions.bands import three_class_outcome
    from tessera.plans import records as plans

    class Stop(Exception):
        pass

    seen = []

    def learn(train, label, columns, classes):
        seen.append((train, columns))
        raise Stop

    monkeypatch.setattr(plans, "fit_linear", learn)
    sf = "/root/testdata/sf0.001"
    records, apply = models._records(spark, sf), plans.RecordScorer.apply
    scorers = []
    monkeypatch.setattr(plans.RecordScorer, "apply", lambda self, df: scorers.append(self) or apply(self, df))
    try:
        models._scorer(spark, sf, records)
    except Stop:
        pass
    (train, columns), out = seen[0], fixtures.with_outcomes(spark, sf, fixtures.lab(spark, sf).select("record_id"))
    y = out.select("record_id", three_class_outcome("diq", "bpq").alias("label")).filter("label >= 0")
    want = apply(scorers[0], plans._complete(records, fixtures.FEATURES, 0.5)).join(y, "record_id")
    rows = [sorted((r["record_id"], r["label"], *[round(r[c], 9) for c in columns]) for r in d.collect()) for d in (train, want)]
    assert rows[0] == rows[1] and rows[0]
    assert train._jdf.queryExecution().executedPlan().toString().count("Join") < want._jdf.queryExecution().executedPlan().toString().count("Join")
