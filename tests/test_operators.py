"""Edge frames and invariants."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import argmax, cosine, l2_normalize, softmax
from tessera.operators import classify, concepts, labelling, metrics, patches, plan_rows, prepare, vectors
from tessera.operators.clustering import DiagonalMixture, fit_kmeans, fit_mixture, fit_prep
from tessera.sources import sinks, tables


def test_vectors_edge_rows(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(l2_normalize("v")).collect()] == [[0.0, 0.0], [0.6, 0.8], None]
    got = [r[0] for r in df.select(cosine("v", F.array(F.lit(3.0), F.lit(4.0)))).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(1.0) and got[2] is None
    tie = spark.createDataFrame([([1.0, 5.0, 5.0],)], "v array<double>").select(argmax("v"), softmax("v")).first()
    assert tie[0] == 1 and sum(tie[1]) == pytest.approx(1.0)


def test_nmi_degenerate(spark):
    def nmi(rows):
        return metrics.mutual_information(spark.createDataFrame(rows, "c int, y int"), "c", "y").first()[0]
    assert nmi([(0, 0)] * 4) == 1.0
    assert nmi([(0, 0), (0, 1)]) == 0.0
    assert nmi([(0, 1), (1, 0)]) == pytest.approx(1.0)
    a = [(0, 1), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert nmi(a) == pytest.approx(nmi([(y, c) for c, y in a]))


def test_constant_attention_falls_back(spark):
    df = spark.createDataFrame([(1, i, 0.5) for i in range(64)] + [(2, i, float(i)) for i in range(8)], "im int, p int, a double")
    got = patches.foreground_patches(df, "im", "p", "a", 0.75)
    counts = {r["im"]: r["count"] for r in got.groupBy("im").count().collect()}
    assert counts == {1: 16, 2: 8}
    assert patches.foreground_patches(df, "im", "p", "a", None).count() == 72
    flat = spark.createDataFrame([([0.5] * 9,), ([0.0] * 9,)], "a array<double>").select(patches.attention_stats()("a").alias("s"))
    flat, zero = [r["s"] for r in flat.collect()]
    assert flat["entropy"] == pytest.approx(1.0) and flat["peakiness"] == 0.0
    assert zero["max_over_mean"] == 0.0 and zero["peakiness"] == 0.0


def _smooth_brute(cells, grid, share):
    out = {}
    for (r, c), lab in cells.items():
        near = [cells[(r + a, c + b)] for a in (-1, 0, 1) for b in (-1, 0, 1)
                if (a or b) and (r + a, c + b) in cells]
        near = [x for x in near if x != lab]
        out[(r, c)] = lab
        if near:
            best = min(set(near), key=lambda x: (-near.count(x), x))
            if near.count(best) >= share * len(near):
                out[(r, c)] = best
    return out


def test_smoothing_iterates_like_brute_force(spark):
    rng = np.random.default_rng(3)
    cells = {(r, c): int(rng.integers(0, 4)) for r in range(6) for c in range(6) if rng.random() < 0.8}
    df = spark.createDataFrame([(7, r * 6 + c, lab) for (r, c), lab in cells.items()], "im int, p int, lab int")
    want = cells
    for _ in range(3):
        want = _smooth_brute(want, 6, 0.67)
    got = patches.smooth_labels(df, "im", "p", "lab", 6, n_iter=3, checkpoint_every=2).collect()
    assert {(r["p"] // 6, r["p"] % 6): r["smoothed"] for r in got} == want
    assert {(r["p"] // 6, r["p"] % 6): r["lab"] for r in got} == cells


def test_smoothing_fixed_point(spark):
    df = spark.createDataFrame([(1, p, 3) for p in range(25)], "im int, p int, lab int")
    assert patches.smooth_labels(df, "im", "p", "lab", 5).filter("smoothed <> 3").count() == 0


def test_smoothing_moves_rows_once(spark):
    df = spark.range(100).select(F.col("id").alias("im"), F.lit(0).alias("p"), F.lit(1).alias("lab"))
    plan = patches.smooth_labels(df, "im", "p", "lab", 5, n_iter=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_gate_reason_order(spark):
    df = spark.createDataFrame([((0.1, 0.1, 0.9, 1.0),), ((0.1, 0.1, 0.5, 1.0),), ((0.1, 0.1, 0.5, 3.0),), ((0.1, 0.9, 0.5, 3.0),),
                                ((0.9, 0.9, 0.5, 3.0),)], "s struct<fg_ratio:double,peakiness:double,entropy:double,max_over_mean:double>")
    got = [r[0] for r in df.select(patches.gate_reason(F.col("s"), 0.8, 2.0, 0.5, 0.5)).collect()]
    assert got == ["high_entropy_uniform", "low_max_over_mean", "low_peakiness", "low_fg_ratio", "ok"]


def test_dominant_class_tie_takes_first(spark):
    df = spark.createDataFrame([(0, "b"), (0, "a"), (1, "b")], "c int, y string")
    got = {r["c"]: r for r in labelling.class_distribution(df, "c", "y", ["a", "b"]).collect()}
    assert got[0]["dominant"] == "a" and got[0]["is_mixed"] and got[1]["dominant"] == "b" and not got[1]["is_mixed"]


def test_label_dictionary_and_scores_of_empty_entity(spark):
    text = '{"0": {"label": " x "}, "1": {"label": "y", "include": false}, "2": {"label": ""}}'
    rows = tables.label_rows(spark.createDataFrame([(text,)], "j string"), "j").collect()
    assert [(r["key"], r["label"], r["confidence"]) for r in rows] == [("0", "x", 2)]
    assigned = spark.createDataFrame([(1, 0), (1, 5)], "im int, c int")
    ids = spark.createDataFrame([(1,), (2,)], "im int")
    got = {r["im"]: r for r in concepts.score_columns(assigned, "im", "c", {"x": 0}, ids).collect()}
    assert got[1]["x"] == 0.5 and got[2]["x"] == 0.0 and got[2]["n_patches"] == 0


def test_nearest_in_blocks_equals_one_block(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pts = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)], "id int, v array<double>")
    targets = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "k int, vector array<double>")
    want = {r["id"]: (r["nearest"], round(r["similarity"], 9)) for r in vectors.nearest(pts, "v", targets, "k").collect()}
    monkeypatch.setattr(vectors, "TABLE_ROWS", 8)
    got = {r["id"]: (r["nearest"], round(r["similarity"], 9)) for r in vectors.nearest(pts, "v", targets, "k").collect()}
    assert got == want


def test_own_similarity_join_path(spark, monkeypatch):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (9, [1.0, 1.0])], "c int, v array<double>")
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "c int, vector array<double>")
    want = sorted(map(str, vectors.own_similarity(df, "v", "c", centres).collect()))
    monkeypatch.setattr(vectors.VectorTable, "of", classmethod(lambda *a, **k: None))
    got = sorted(map(str, vectors.own_similarity(df, "v", "c", centres).select("c", "v", "similarity").collect()))
    assert [g.split("similarity=")[1][:8] for g in got] == [w.split("similarity=")[1][:8] for w in want]


def test_projection_is_orthonormal_and_round_trips(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)) * [5, 3, 1, 1, .5, .1] + 2
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    p = vectors.fit_projection(df, "v", 3)
    assert np.allclose(p.components.T @ p.components, np.eye(3), atol=1e-8)
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(p.components.T @ vt[:3].T), np.eye(3), atol=1e-6)
    assert np.allclose(p.explained, (s[:3] ** 2) / (s ** 2).sum(), atol=1e-8)
    q = vectors.Projection.from_frame(p.to_frame(spark))
    assert np.allclose(q.components, p.components) and np.allclose(q.mean, p.mean)
    assert vectors.fit_projection(df.limit(3), "v", 50).components.shape[1] == 2


def test_mixture_finds_groups_and_bound_rises(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(m, s, size=(150, 2)) for m, s in (([0, 0], .3), ([5, 5], 1.0), ([0, 6], .5))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    bounds = [fit_mixture(df, "v", 3, n_init=1, max_iter=n, tol=0.0).bound for n in (1, 2, 6)]
    assert bounds[0] <= bounds[1] + 1e-9 <= bounds[2] + 2e-9
    mix = fit_mixture(df, "v", 3, n_init=2)
    got = np.array([r["c"] for r in df.select("id", mix.predict("v").alias("c")).orderBy("id").collect()])
    assert all(len(set(got[i * 150:(i + 1) * 150])) == 1 for i in range(3)) and len(set(got)) == 3
    soft = df.select(mix.membership("v").alias("m")).collect()
    assert np.allclose([sum(r["m"]) for r in soft], 1.0)
    same = DiagonalMixture.from_frame(mix.to_frame(spark))
    assert np.allclose(same.log_joint(x), mix.log_joint(x))


def test_mixture_density_by_hand():
    mix = DiagonalMixture(np.array([.25, .75]), np.array([[0.], [2.]]), np.array([[1.], [4.]]))
    x = 1.0
    a = .25 * np.exp(-.5) / np.sqrt(2 * np.pi)
    b = .75 * np.exp(-.125) / np.sqrt(8 * np.pi)
    r, ll = mix.responsibilities(np.array([[x]]))
    assert r[0, 0] == pytest.approx(a / (a + b)) and ll[0] == pytest.approx(np.log(a + b))


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x, lab = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    x[5] = x[6]
    lab[59] = 9
    df = spark.createDataFrame([(i, int(c), r.tolist()) for i, (c, r) in enumerate(zip(lab, x))], "id int, c int, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(60):
        own = (lab == lab[i]) & (np.arange(60) != i)
        if not own.any():
            want.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, lab == k].mean() for k in set(lab) if k != lab[i])
        want.append((b - a) / max(a, b))
    assert metrics.silhouette(df, "c", "v", "id").first()[0] == pytest.approx(np.mean(want), abs=1e-9)


def test_linear_model_solves_penalised_objective(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3)) * [1, 4, .5] + [0, 1, 2]
    y = (x @ [1, -.3, 1] + rng.normal(size=200) > 2).astype(int) + (x[:, 0] > 1)
    df = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(y, x)], "y int, a double, b double, c double")
    for std in (False, True):
        for bal in (False, True):
            m = classify.fit_linear(df, "y", ["a", "b", "c"], ["0", "1", "2"], c=.7, standardize=std, balanced=bal)
            sd = x.std(axis=0) if std else np.ones(3)
            z = x @ m.weights.T + m.intercepts
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w = (200 / (3 * np.bincount(y)))[y] if bal else np.ones(200)
            grad = ((p - np.eye(3)[y]) * w[:, None]).T @ (x / sd) + m.weights * sd / .7
            if std:
                grad = ((p - np.eye(3)[y]) * w[:, None]).T @ ((x - x.mean(0)) / sd) + m.weights * sd / .7
            assert np.abs(grad).max() < 2e-2
    back = classify.LinearModel.from_frame(m.to_frame(spark))
    assert np.allclose(back.weights, m.weights) and back.concepts == m.concepts
    scored = back.score(df.drop("b")).first()
    assert sum(scored["proba"]) == pytest.approx(1.0)


def test_answer_parsing(spark):
    good = json.dumps({k: "v" for k in labelling.ANSWER_KEYS})
    rows = [good, f"```json\n{good}\n```", f"text\n```\n{good}\n``` more", "{broken", "", "no json", None]
    got = [r["a"] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(labelling.parse_answer("t").alias("a")).collect()]
    assert [a["PRIMARY_LABEL"] for a in got] == ["v", "v", "v", None, None, None, None]
    assert [a["error"] is None for a in got][:3] == [True] * 3
    assert all(a["error"] for a in got[3:6])


def test_profile_text_layout(spark):
    df = spark.createDataFrame([(0, 3.0, -1.0, *[0.1] * 8), (1, 0.0, 0.0, *[0.0] * 8)], "c int, a double, b double, " + ", ".join(f"f{i} double" for i in range(8)))
    feats = ["a", "b", *[f"f{i}" for i in range(8)]]
    prof = labelling.deviation_profile(df, "c", feats, {"a": "Alpha (mg)"})
    text = {r["c"]: r["profile"] for r in labelling.profile_text(prof, "c").collect()}
    assert text[0].split("\n") == [
        "Cluster of 1 patients with the following lab pattern:", "", "  SIGNIFICANTLY ELEVATED:",
        "    • Alpha  (deviation +3.0 from normal midpoint)", "  MILDLY LOW:",
        "    • b  (deviation -1.0 from normal midpoint)", "", "  WITHIN NORMAL RANGE: f0, f1, f2, f3, f4, f5, +2 more"]
    assert "Alpha" in text[1] and "LOW" not in text[1]


def test_all_null_feature_in_cluster(spark):
    df = spark.createDataFrame([(0, None, 1.0), (1, 2.0, 1.0)], "c int, a double, b double")
    got = {(r["c"], r["code"]): r["deviation"] for r in labelling.deviation_profile(df, "c", ["a", "b"]).collect()}
    assert got[(0, "a")] is None and got[(1, "a")] == 2.0


def test_degenerate_range_and_constant_feature(spark):
    df = spark.createDataFrame([(1.0, 5.0), (1.0, 5.0)], "a double, b double")
    got = prepare.deviations(df, ["a", "b"], {"a": (1.0, 1.0)}).first()
    assert tuple(got) == (0.0, 0.0)


def test_mask_size_and_panels(spark):
    df = spark.range(50).select("id", *[F.lit(float(i)).alias(f"f{i}") for i in range(7)])
    panels = {"p": ["f0", "f1", "f2", "f3", "f4"], "q": ["f5", "f6"]}
    got = plan_rows.masked_features(df, "id", panels, 1).groupBy("id", "panel").count().collect()
    assert {(r["panel"], r["count"]) for r in got} == {("p", 2), ("q", 1)} and len(got) == 50


def test_one_class_separates(spark):
    rng = np.random.default_rng(9)
    rows = [("in", *map(float, r)) for r in rng.normal(size=(300, 2))] + [("out", *map(float, r)) for r in rng.normal(6, 1, size=(50, 2))]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    model = classify.fit_one_class(df.filter("g = 'in'"), ["a", "b"], 0.1)
    got = {(r["g"], r["prediction"]): r["count"] for r in model.score(df).groupBy("g", "prediction").count().collect()}
    assert got[("in", "not_target")] == 30 and got[("out", "not_target")] == 50
    sweep = classify.nu_sweep(df, "g", "in", "out", ["a", "b"]).orderBy("nu").collect()
    assert len(sweep) == 4 and all(r["gap"] > 0 for r in sweep)
    best = classify.best_row(spark.createDataFrame(sweep), "gap", "nu").first()
    assert best["gap"] == max(r["gap"] for r in sweep)


def test_files_missing_cycle_and_csv(spark, tmp_path):
    a = pd.DataFrame({"seqn": [1.0, 2.0], "x": [1.0, float("nan")]})
    b = pd.DataFrame({"seqn": [2.0, 3.0], "y": [5.0, 6.0]})
    a.to_parquet(tmp_path / "CBC_J.parquet")
    b.to_parquet(tmp_path / "BIO_J.parquet")
    a.to_parquet(tmp_path / "CBC_I.parquet")
    lab, demo, val = tables.load_cycles(spark, [{"year": "2017", "suffix": "_J"}, {"year": "2015", "suffix": "_I"}, {"year": "2013", "suffix": "_H"}],
                                        str(tmp_path), {"cbc": "CBC", "bio": "BIO"}, ["X", "Y", "Z"])
    got = {r["record_id"]: (r["X"], r["Y"]) for r in lab.collect()}
    assert got == {"2017_1": (1.0, None), "2017_2": (None, 5.0), "2017_3": (None, 6.0), "2015_1": (1.0, None), "2015_2": (None, None)}
    assert demo.count() == 0 and val is None
    (tmp_path / "new.csv").write_text("id,x\n7,1.5\n8,bad\n")
    rows = tables.read_scoring_csv(spark, str(tmp_path / "new.csv"), ["X", "Y"]).collect()
    assert [(r["ID"], r["X"], r["Y"]) for r in rows] == [("7", 1.5, None), ("8", None, None)]
    assert [r[0] for r in tables.missing_columns(lab, ["X", "Z"]).collect()] == ["Z"]


def test_image_catalogue(spark, tmp_path):
    for cls, names in {"dog": ["b.JPG", "a.png"], "ant": ["x.webp", "notes.txt"]}.items():
        (tmp_path / cls).mkdir()
        for n in names:
            (tmp_path / cls / n).write_bytes(b"x")
    got = sorted((r["class_name"], r["label"], r["path"].rsplit("/", 1)[1]) for r in tables.image_catalogue(spark, str(tmp_path)).collect())
    assert got == [("ant", 0, "x.webp"), ("dog", 1, "a.png"), ("dog", 1, "b.JPG")]
    only = tables.image_catalogue(spark, str(tmp_path), ["dog"]).collect()
    assert {r["label"] for r in only} == {0}


def test_sinks_round_trip(spark, tmp_path):
    old = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "variant string, x double")
    new = spark.createDataFrame([("B", 3.0), ("C", 4.0)], "variant string, x double")
    sinks.write_json(sinks.upsert(old, new, "variant"), str(tmp_path / "r"))
    got = {r["variant"]: r["x"] for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert got == {"A": 1.0, "B": 3.0, "C": 4.0}
    sinks.write_table(old, str(tmp_path / "t"), ["variant"])
    assert spark.read.parquet(str(tmp_path / "t")).filter("variant = 'A'").count() == 1


def test_scorer_round_trip_and_stream(spark, tmp_path):
    from tessera.plans.records import RecordScorer, fit_scorer
    from tessera.streaming.score import score_files
    rng = np.random.default_rng(11)
    rows = [(f"r{i}", *[None if rng.random() < .1 else float(v) for v in rng.normal(size=4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "record_id string, a double, b double, c double, d double")
    y = df.select("record_id", (F.coalesce("a", F.lit(0.0)) > 0).cast("int").alias("label"))
    scorer = fit_scorer(df, {"p": ["a", "b"], "q": ["c", "d"]}, {"a": (-1.0, 1.0)}, 2, min_ratio=.5, n_init=1, max_iter=10,
                        outcome=y, classes=["no", "yes"], names={"p:0": "low"})
    scorer.save(spark, str(tmp_path / "m"))
    again = RecordScorer.load(spark, str(tmp_path / "m"), has_names=True)
    assert again.concept_names()[:2] == ["p: low", "p: cluster_1"]
    part = df.drop("d")
    want = {r["record_id"]: r["confidence"] for r in scorer.apply(part).collect()}
    part.write.parquet(str(tmp_path / "in"))
    score_files(spark, str(tmp_path / "in"), part.schema, again, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {r["record_id"]: r["confidence"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert "Exchange" not in scorer.apply(df)._jdf.queryExecution().executedPlan().toString()


def test_prep_of_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], 0), ([0.0, 1.0, 0.0], 1), ([0.0, 0.0, 0.0], 2), ([1.0, 1.0, 0.0], 3)], "v array<double>, p int")
    got = df.select(fit_prep(df, "v", 2, 2, .4).apply("v", "p").alias("x")).collect()
    assert all(len(r["x"]) == 4 for r in got)


def test_kmeans_restarts(spark):
    df = spark.createDataFrame([([float(i // 10 * 10 + i % 3), 0.0],) for i in range(30)], "v array<double>")
    assert fit_kmeans(df, "v", 3, n_init=3).cost < 40


def _ibm(x):
    """IBM hexadecimal double of a number; a point marks a missing value."""
    if x is None:
        return b"." + bytes(7)
    if x == 0:
        return bytes(8)
    sign, x, e = (0x80 if x < 0 else 0), abs(x), 64
    while x >= 1:
        x, e = x / 16, e + 1
    while x < 1 / 16:
        x, e = x * 16, e - 1
    return bytes([sign | e]) + int(x * 2 ** 56).to_bytes(7, "big")


def _transport(names, rows):
    """Minimal SAS transport file with numeric columns."""
    import struct

    def head(kind, tail="0" * 30):
        return f"HEADER RECORD*******{kind:8s}HEADER RECORD!!!!!!!{tail}  ".encode()
    when = b"01JAN20:00:00:00"
    out = head("LIBRARY ") + b"SAS     SAS     SASLIB  9.1     LINUX   ".ljust(64) + when + when.ljust(80)
    out += head("MEMBER  ", "000000000000000001600000000140") + head("DSCRPTR ")
    out += b"SAS     TEST    SASDATA 9.1     LINUX   ".ljust(64) + when + when.ljust(80)
    out += head("NAMESTR ", f"000000{len(names):04d}00000000000000000000")
    body = b"".join(struct.pack(">hhhh8s40s8shhh2s8shhl52s", 1, 0, 8, i + 1, n.encode().ljust(8), b" " * 40, b" " * 8, 0, 0, 0,
                                b"  ", b" " * 8, 0, 0, i * 8, bytes(52)) for i, n in enumerate(names))
    out += body + b" " * (-len(body) % 80) + head("OBS     ")
    data = b"".join(_ibm(v) for r in rows for v in r)
    return out + data + b" " * (-len(data) % 80)


def test_transport_files(spark, tmp_path):
    for i, name in enumerate(("CBC_J", "CBC_I")):
        (tmp_path / f"{name}.xpt").write_bytes(_transport(["SEQN", "LBXHGB"], [(1.0 + i, 13.5), (7.0, None), (9.0, -0.25)]))
    (tmp_path / "HDL_J.xpt").write_bytes(_transport(["SEQN", "LBDHDD"], [(7.0, 50.0)]))
    lab, _, _ = tables.load_cycles(spark, [{"year": "2017", "suffix": "_J"}, {"year": "2015", "suffix": "_I"}], str(tmp_path),
                                   {"cbc": "CBC", "hdl": "HDL"}, ["LBXHGB", "LBDHDD"], suffix=".xpt")
    got = {r["record_id"]: (r["LBXHGB"], r["LBDHDD"]) for r in lab.collect()}
    assert got == {"2017_1": (13.5, None), "2017_7": (None, 50.0), "2017_9": (-.25, None),
                   "2015_2": (13.5, None), "2015_7": (None, None), "2015_9": (-.25, None)}


def test_similarities_move_one_row_per_vector(spark):
    df = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(5)], "im int, id int, v array<double>")
    targets = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "k int, vector array<double>")
    out = concepts.similarity_scores(df, "im", "v", targets, "k", k=2)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["score"] for r in out.collect()}
    unit = [(i / (i * i + 1) ** .5, 1 / (i * i + 1) ** .5) for i in range(5)]
    assert got[0] == pytest.approx((unit[3][0] + unit[4][0]) / 2) and got[1] == pytest.approx((unit[0][1] + unit[1][1]) / 2)


def test_title_name(spark):
    from tessera.functions.bands import title_name
    got = spark.createDataFrame([("cat_left_ear",)], "n string").select(title_name("n"), title_name("n", 8)).first()
    assert tuple(got) == ("Cat Left Ear", "Cat Left")
