"""Linear classification of concept scores, explanations and one-class scoring."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.bands import push_label
from tessera.functions.vectors import argmax, from_matrix, scatter, to_matrix
from tessera.operators.concepts import fill_model_order
from tessera.operators.moments import Moments, co_moments
from tessera.operators.ordering import exact_quantiles, top_k
from tessera.operators.passes import block_sums, gathered, matrices, packed
from tessera.operators.vectors import Projection, Scaler, projection_of


@dataclass(frozen=True)
class LinearModel:
    """Multinomial linear model over named concepts."""

    classes: tuple[str, ...]
    concepts: tuple[str, ...]
    weights: np.ndarray
    intercepts: np.ndarray

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """Rows (class, concept, weight); the intercept has concept NULL."""
        rows = [(i, c, j, n, float(self.weights[i, j])) for i, c in enumerate(self.classes)
                for j, n in enumerate(self.concepts)]
        rows += [(i, c, -1, None, float(self.intercepts[i])) for i, c in enumerate(self.classes)]
        return spark.createDataFrame(rows, "class_idx int, class string, concept_idx int, "
                                           "concept string, weight double")

    @classmethod
    def from_frame(cls, df: DataFrame) -> LinearModel:
        rows = df.collect()
        classes = [c for _, c in sorted({(r["class_idx"], r["class"]) for r in rows})]
        concepts = [c for _, c in sorted({(r["concept_idx"], r["concept"]) for r in rows
                                          if r["concept_idx"] >= 0})]
        w, b = np.zeros((len(classes), len(concepts))), np.zeros(len(classes))
        for r in rows:
            if r["concept_idx"] < 0:
                b[r["class_idx"]] = r["weight"]
            else:
                w[r["class_idx"], r["concept_idx"]] = r["weight"]
        return cls(tuple(classes), tuple(concepts), w, b)

    def logits(self, df: DataFrame) -> Column:
        """Array of class scores; concepts the frame lacks count as 0."""
        return F.array(*self._class_scores(df))

    def _class_scores(self, df: DataFrame) -> list[Column]:
        have = set(df.columns)
        out = []
        for i in range(len(self.classes)):
            z = F.lit(float(self.intercepts[i]))
            for j, c in enumerate(self.concepts):
                if c in have:
                    z = z + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(self.weights[i, j])
            out.append(z)
        return out

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``proba`` (by class), ``class_idx``, ``prediction`` and ``confidence``.

        The softmax, shifted by the largest score, has a column for each class: lambdas over arrays are interpreted.
        """
        names = F.array(*[F.lit(c) for c in self.classes])
        z, e = ([f"_{c}{i}" for i in range(len(self.classes))] for c in "ze")
        top = F.greatest(*z) if len(z) > 1 else F.col(z[0])
        total = sum((F.col(c) for c in e[1:]), F.col(e[0]))
        exps = df.select("*", *[x.alias(c) for x, c in zip(self._class_scores(df), z)]).select("*", *[F.exp(F.col(a) - top).alias(b) for a, b in zip(z, e)])
        return (exps.withColumn("proba", F.array(*[F.col(c) / total for c in e])).drop(*z, *e)
                .withColumn("class_idx", argmax("proba"))
                .withColumn("prediction", names[F.col("class_idx")])
                .withColumn("confidence", F.array_max("proba")))


def balanced_weights(df: DataFrame, label: str) -> Column:
    """Row weight ``n / (classes * class size)`` as an expression over the class label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"),
                       F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("m"))
    one = total.select(F.struct("*")).scalar()
    return one.getField("t") / (one.getField("k") * one.getField("m")[F.col(label)])


#: Up to this many weights the fit takes Newton steps; beyond, the matrix of second derivatives would be too large.
NEWTON_WEIGHTS = 2000


@dataclass(frozen=True)
class Loss:
    """Penalised multinomial loss over rows of a table: scores, label index and row weight, as :func:`passes.packed` blocks.

    With n rows, strength c and weights V of the scaled scores ``(x - mean) / std`` it is the mean of ``w`` times the cross entropy, plus
    ``|V|^2 / (2 c n)``; intercepts are not penalised.
    """

    rows: DataFrame
    n: int
    classes: int
    mean: np.ndarray
    std: np.ndarray
    c: float

    @property
    def width(self) -> int:
        return len(self.mean) + 1

    def at(self, theta: np.ndarray, second: bool) -> tuple[float, np.ndarray, np.ndarray | None]:
        """Value, gradient and (on request) matrix of second derivatives at ``theta`` (classes by scaled weights and intercept); one pass.

        Partial sums are made per partition and added up on executors.
        """
        k, d, mean, std = self.classes, self.width, self.mean, self.std

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, gradient, matrix = 0.0, np.zeros((k, d)), np.zeros((k * d, k * d) if second else (0, 0))
            for _, m in (part for batch in batches for part in matrices(batch)):
                x, y, w = m[:, :-2], m[:, -2], m[:, -1]
                z = np.concatenate([(x - mean) / std, np.ones((len(x), 1))], axis=1)
                logit = z @ theta.T
                logit -= logit.max(axis=1, keepdims=True)
                p = np.exp(logit)
                total = p.sum(axis=1, keepdims=True)
                p /= total
                at = np.arange(len(x)), y.astype(np.int64)
                loss -= float((w * (logit[at] - np.log(total[:, 0]))).sum())
                if second:
                    for i in range(k):
                        for j in range(i, k):
                            part = (z * (w * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ z
                            matrix[i * d:i * d + d, j * d:j * d + d] += part
                            if i != j:
                                matrix[j * d:j * d + d, i * d:i * d + d] += part.T
                p[at] -= 1.0
                gradient += (p * w[:, None]).T @ z
            cells = np.concatenate([[loss], gradient.ravel()])[None]
            for i, part in ((np.full(1, -1, np.int32), cells), (np.arange(len(matrix), dtype=np.int32), matrix)):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(i), from_matrix(part, np.ones(len(i), bool))], names=["i", "s"])

        parts = gathered(self.rows).mapInArrow(sums, "i int, s array<double>")
        total = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).toArrow().to_pylist()
        found = {r["i"]: np.array(r["s"]) for r in total}
        penalty = np.append(np.ones(d - 1), 0.0) / (self.c * self.n)
        value = found[-1][0] / self.n + float((theta * theta * penalty).sum()) / 2
        gradient = found[-1][1:].reshape(k, d) / self.n + theta * penalty
        matrix = np.stack([found[i] for i in range(k * d)]) / self.n + np.diag(np.tile(penalty, k)) if second else None
        return value, gradient, matrix

    def weights(self, model: LinearModel) -> np.ndarray:
        """``theta`` of a model."""
        return np.concatenate([model.weights * self.std, (model.intercepts + model.weights @ self.mean)[:, None]], axis=1)

    def model(self, theta: np.ndarray, classes: Sequence[str], concepts: Sequence[str]) -> LinearModel:
        w = theta[:, :-1] / self.std
        return LinearModel(tuple(classes), tuple(concepts), w, theta[:, -1] - w @ self.mean)


def linear_loss(df: DataFrame, label: str, concepts: Sequence[str], classes: Sequence[str], *, c: float = 1.0,
                standardize: bool = False, balanced: bool = False, blocks: bool = True) -> Loss:
    """The loss that :func:`fit_linear` minimises over ``df``; its blocks (rows ``y, x, w`` without ``blocks``) are persisted, the caller unpersists them."""
    cols = [F.col(x).cast("double") for x in concepts]
    weight = balanced_weights(df, label) if balanced else F.lit(1.0)
    rows = df.select(F.col(label).cast("int").alias("y"), F.array(*cols).alias("x"), weight.alias("w"))
    if blocks:
        flat = F.concat("x", F.array(F.col("y").cast("double"), F.col("w").cast("double")))
        rows = packed(rows.select(F.lit(0).alias("g"), flat.alias("x"))).persist(StorageLevel.MEMORY_AND_DISK)
        n, mean, std = 0, np.zeros(len(cols)), np.ones(len(cols))
        for n, total in block_sums(gathered(rows)).values():
            if standardize:
                mean = total[0] / n
                std = np.sqrt(np.diag(block_sums(gathered(rows), {0: mean})[0][1]) / n)[:-2]
                mean, std = mean[:-2], np.where(std > 0, std, 1.0)
        return Loss(rows, n, len(classes), mean, std, c)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    if standardize:
        v = array_to_vector(F.col("x"))
        head = rows.agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")).first()["s"]
        n, mean = head["count"], head["mean"].toArray()
        std = np.sqrt(head["variance"].toArray() * (n - 1) / n)
        std = np.where(std > 0, std, 1.0)
    else:
        n, mean, std = rows.count(), np.zeros(len(cols)), np.ones(len(cols))
    return Loss(rows, n, len(classes), mean, std, c)


def fit_linear(df: DataFrame, label: str, concepts: Sequence[str], classes: Sequence[str], *,
               c: float = 1.0, max_iter: int = 1000, tol: float = 1e-8, standardize: bool = False,
               balanced: bool = False) -> LinearModel:
    """Multinomial logistic regression with an L2 penalty of strength ``1 / c``.

    ``label`` holds class indices. With ``standardize`` the scores are scaled first and
    the weights are turned back to the raw scale. Newton steps, one pass each and halved while the loss would rise, end once no entry of the gradient
    exceeds ``tol``; a model of very many weights is fitted by a quasi-Newton method instead, to the same optimum.
    """
    small = len(classes) * (len(concepts) + 1) <= NEWTON_WEIGHTS
    loss = linear_loss(df, label, concepts, classes, c=c, standardize=standardize, balanced=balanced, blocks=small)
    try:
        if not small:
            return loss.model(_quasi_newton(loss, max_iter), classes, concepts)
        theta = np.zeros((loss.classes, loss.width))
        value, gradient, second = loss.at(theta, True)
        for _ in range(max_iter):
            if np.abs(gradient).max() <= tol:
                break
            # Adding one number to all intercepts changes nothing: the least step of the many.
            step = np.linalg.lstsq(second, -gradient.ravel(), rcond=1e-12)[0].reshape(theta.shape)
            size = 1.0
            while True:
                tried = loss.at(theta + size * step, True)
                if tried[0] <= value + 1e-12 * abs(value) or size < 1e-6:
                    break
                size /= 2
            if size < 1e-6:
                break
            theta = theta + size * step
            value, gradient, second = tried
        return loss.model(theta, classes, concepts)
    finally:
        loss.rows.unpersist()


def _quasi_newton(loss: Loss, max_iter: int) -> np.ndarray:
    mean, std = loss.mean, loss.std

    @F.arrow_udf("array<double>")
    def scaled(v: pa.Array) -> pa.Array:
        m, valid = to_matrix(v)
        return from_matrix((m - mean) / std if len(m) else m, valid)

    data = loss.rows.select(F.col("y").cast("double").alias("label"), array_to_vector(scaled("x")).alias("features"), "w")
    fit = LogisticRegression(family="multinomial", regParam=1.0 / (loss.c * loss.n), standardization=False, maxIter=max_iter, tol=1e-9, weightCol="w").fit(data)
    return np.concatenate([fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()[:, None]], axis=1)


def linear_gradient(df: DataFrame, label: str, model: LinearModel, *, c: float = 1.0, standardize: bool = False, balanced: bool = False) -> DataFrame:
    """``class, concept, weight, gradient``: slope of the penalised loss of :func:`fit_linear` in every coefficient (concept NULL: intercept).

    Zero everywhere means that the model is the optimum, since the loss is convex. Slopes are by scaled weights if ``standardize``.
    """
    loss = linear_loss(df, label, model.concepts, model.classes, c=c, standardize=standardize, balanced=balanced)
    try:
        theta = loss.weights(model)
        _, gradient, _ = loss.at(theta, False)
    finally:
        loss.rows.unpersist()
    names = [*model.concepts, None]
    rows = [(k, n, float(theta[i, j]), float(gradient[i, j])) for i, k in enumerate(model.classes) for j, n in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "class string, concept string, weight double, gradient double")


def top_weights(coefs: DataFrame, k: int = 5) -> DataFrame:
    """Largest absolute weights of each class."""
    rows = coefs.filter(F.col("concept").isNotNull())
    return top_k(rows, ["class"], [F.abs("weight").desc(), F.col("concept_idx")], k)


def contributions(scored: DataFrame, entity: str, concepts: Sequence[str], model: LinearModel,
                  kind: str = "centred") -> DataFrame:
    """Contribution of each concept to the predicted class, one row each.

    ``product``: score times weight. ``centred``: weight times the score's distance
    from the entity's own mean score. The weights of the few classes are literals
    indexed by the predicted class, so nothing is joined.
    """
    order = fill_model_order(scored, model.concepts)
    values = [c for c in order]
    row = scored.select(entity, "class_idx", *values)
    mean = sum((F.col(c) for c in model.concepts[1:]), F.col(model.concepts[0])) / len(model.concepts)
    cells = []
    for j, name in enumerate(model.concepts):
        by_class = F.array(*[F.lit(float(model.weights[i, j])) for i in range(len(model.classes))])
        w = by_class[F.col("class_idx")]
        base = F.col(name) if kind == "product" else F.col(name) - mean
        cells.append(F.struct(F.lit(name).alias("concept"), F.col(name).alias("score"),
                              (w * base).alias("contribution")))
    return row.select(entity, F.explode(F.array(*cells)).alias("_cell")).select(entity, "_cell.*")


def ranked_contributions(rows: DataFrame, entity: str, name: str = "rank") -> DataFrame:
    """Contributions ordered by absolute size; one entity has one row per concept."""
    order = Window.partitionBy(entity).orderBy(F.abs("contribution").desc(), "concept")
    return rows.withColumn(name, F.row_number().over(order).cast("long"))


@dataclass(frozen=True)
class OneClassModel:
    """Elliptic one-class scorer of standardised concept scores."""

    concepts: tuple[str, ...]
    mean: np.ndarray
    std: np.ndarray
    precision: np.ndarray
    cut: float
    scale: float
    rank: int = 0
    condition: float = float("nan")

    def _expr(self, which: str, vec: Column | None = None) -> Column:
        mean, std, prec, cut, scale = self.mean, self.std, self.precision, self.cut, self.scale

        @F.arrow_udf("double")
        def value(v: pa.Array) -> pa.Array:
            m, valid = to_matrix(v)
            if len(m) == 0:
                return scatter(np.zeros(0), valid)
            z = (m - mean) / std
            d2 = ((z @ prec) * z).sum(axis=1)
            return scatter(d2 if which == "distance" else np.tanh((cut - d2) / scale), valid)

        return value(F.array(*[F.col(c).cast("double") for c in self.concepts]) if vec is None else vec)

    def distance(self) -> Column:
        """Squared Mahalanobis distance."""
        return self._expr("distance")

    def distance_of(self, vec: Column) -> Column:
        """The same of an array of the concepts' scores."""
        return self._expr("distance", vec)

    def score(self, df: DataFrame, target: str = "target") -> DataFrame:
        """Adds ``score`` in (-1, 1), ``prediction`` and ``confidence``."""
        return (df.withColumn("score", self._expr("score"))
                .withColumn("prediction", F.when(F.col("score") > 0, target).otherwise(f"not_{target}"))
                .withColumn("confidence", F.least(F.abs("score"), F.lit(1.0))))

    def explain(self, df: DataFrame, entity: str, target: str = "target") -> DataFrame:
        """Standardised deviation from the class centroid per concept, largest first."""
        cells = [F.struct(F.lit(c).alias("concept"), F.col(c).cast("double").alias("activation"),
                          ((F.col(c) - float(self.mean[i])) / float(self.std[i])).alias("deviation"))
                 for i, c in enumerate(self.concepts)]
        rows = df.select(entity, F.explode(F.array(*cells)).alias("_cell")).select(entity, "_cell.*")
        order = Window.partitionBy(entity).orderBy(F.abs("deviation").desc(), "concept")
        return (rows.withColumn("pushes", push_label("deviation", target))
                .withColumn("rank", F.row_number().over(order).cast("long")))


def checked_inverse(correlation: np.ndarray, limit: float = 1e12) -> tuple[np.ndarray, int, float]:
    """Inverse of a correlation matrix, its rank and condition number; directions beyond ``limit`` are left out, not blown up."""
    values, vectors = np.linalg.eigh(correlation)
    top = values.max()
    kept = values > top / limit
    return (vectors[:, kept] / values[kept]) @ vectors[:, kept].T, int(kept.sum()), float(top / max(values.min(), top / limit / 10))


def fit_one_class_by(df: DataFrame, label: str | None, concepts: Sequence[str], classes: Sequence, nu: float = 0.1,
                     diagonal: bool = False) -> dict[object, OneClassModel]:
    """One model per class; ``label`` None takes the whole table as the one class given.

    The moments of all classes come from one pair of passes, the squared Mahalanobis distances of all rows to their own class from another,
    and the cuts, exact quantiles, from one job over a column for each class.
    """
    cols = list(concepts)
    group = F.lit(0) if label is None else F.coalesce(*[F.when(F.col(label) == c, i) for i, c in enumerate(classes)])
    rows = df.select(group.alias("_g"), F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")).filter("_g is not null").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        moments, raw = co_moments(rows, "_x", "_g"), {}
        for g, m in moments.items():
            inverse, rank, condition = (np.eye(len(cols)), len(cols), 1.0) if diagonal else checked_inverse(m.correlation())
            raw[g] = OneClassModel(tuple(cols), m.mean, m.spread, inverse, 0.0, 1.0, rank, condition)
        distances = rows.select(*[F.when(F.col("_g") == g, m.distance_of(F.when(F.col("_g") == g, F.col("_x")))).alias(f"d{g}") for g, m in raw.items()]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            names = [f"d{g}" for g in raw]
            cuts = exact_quantiles(distances, names, [1.0 - nu]).first()
            spreads = distances.agg(*[F.stddev_pop(n).alias(n) for n in names]).first()
        finally:
            distances.unpersist()
    finally:
        rows.unpersist()
    out = {}
    for g, m in raw.items():
        spread = spreads[f"d{g}"] or 0.0
        out[classes[g]] = replace(m, cut=float(cuts[f"d{g}"][0]), scale=spread if spread > 1e-6 else 1.0)
    return out


def fit_one_class(df: DataFrame, concepts: Sequence[str], nu: float = 0.1,
                  diagonal: bool = False) -> OneClassModel:
    """Mean, spread and correlation of one class; the cut leaves a share ``nu`` outside.

    The cut is the exact quantile of the squared Mahalanobis distance; ``tanh`` is scaled by the training spread of the decision.
    ``rank`` and ``condition`` tell whether the correlation could be inverted in full.
    """
    return fit_one_class_by(df, None, concepts, ["target"], nu, diagonal)["target"]


def nu_sweep(df: DataFrame, group: str, target: str, other: str, concepts: Sequence[str],
             nus: Sequence[float] = (0.05, 0.1, 0.15, 0.2), diagonal: bool = False) -> DataFrame:
    """Separation, accuracy and confidence of both groups for several ``nu``.

    Only the cut differs between the fits: the model is fitted once, all cuts come
    from one quantile job and all rows are scored once for every ``nu``.
    """
    train = df.filter(F.col(group) == target)
    base = fit_one_class(train, concepts, nus[0], diagonal)
    dist = df.filter(F.col(group).isin(target, other)).withColumn("_d2", base.distance())
    cuts = exact_quantiles(dist.filter(F.col(group) == target), ["_d2"], [1.0 - n for n in nus]).first()["_d2"]
    cells = F.array(*[F.struct(F.lit(float(n)).alias("nu"), F.lit(float(c)).alias("cut"))
                      for n, c in zip(nus, cuts)])
    rows = (dist.select(group, "_d2", F.explode(cells).alias("x"))
            .select(group, "x.nu", F.tanh((F.col("x.cut") - F.col("_d2")) / F.lit(base.scale)).alias("s")))
    is_t = F.col(group) == target

    def mean_of(cond: Column, v: Column) -> Column:
        return F.avg(F.when(cond, v))

    return (rows.groupBy("nu").agg(
        mean_of(is_t, F.col("s")).alias("target_mean"), mean_of(~is_t, F.col("s")).alias("other_mean"),
        mean_of(is_t, (F.col("s") > 0).cast("double")).alias("target_accuracy"),
        mean_of(~is_t, (F.col("s") <= 0).cast("double")).alias("other_accuracy"),
        mean_of(is_t, F.abs("s")).alias("target_confidence"),
        mean_of(~is_t, F.abs("s")).alias("other_confidence"))
        .withColumn("gap", F.col("target_mean") - F.col("other_mean")))


def best_row(df: DataFrame, score: str, tie: str, ascending_tie: bool = True) -> DataFrame:
    """Row with the highest score; the first key on ties."""
    return df.orderBy(F.col(score).desc(), F.col(tie).asc() if ascending_tie else F.col(tie).desc()).limit(1)


def one_vs_rest_scores(test: DataFrame, models: Mapping[object, OneClassModel]) -> DataFrame:
    """``score_<i>`` of every class and ``predicted``, the class with the highest score (the first one on ties)."""
    out = test.select("*", *[m._expr("score").alias(f"score_{i}") for i, m in enumerate(models.values())])
    scores = F.array(*[F.col(f"score_{i}") for i in range(len(models))])
    return out.withColumn("predicted", F.array(*[F.lit(c) for c in models])[argmax(scores)])


def one_vs_rest_one_class(train: DataFrame, test: DataFrame, label: str, concepts: Sequence[str],
                          classes: Sequence[str], nu: float = 0.1) -> DataFrame:
    """One one-class model per class, fitted in shared passes; the class with the highest score is predicted.

    The class list is part of the task, so each class contributes one score column.
    """
    models = fit_one_class_by(train, label, concepts, classes, nu)
    return one_vs_rest_scores(test, {c: models[c] for c in classes})


def one_vs_rest_projected(train: DataFrame, test: DataFrame, label: str, vec: str, classes: Sequence[str],
                          dims: int = 50, nu: float = 0.1) -> DataFrame:
    """One-class model per class over raw vectors, each with a scaler and a projection of its own class.

    Scalers and projections of all classes follow from one pair of passes over the training rows (the principal directions of
    scaled rows are those of the correlation), and the models share theirs. The class with the highest score is ``predicted``, the first one on ties.
    """
    inside = train.filter(F.col(label).isin(list(classes)))
    moments = co_moments(inside, vec, label)

    def chain(m: Moments) -> tuple[Scaler, Projection]:
        scaled = Moments(m.count, np.zeros(len(m.mean)), m.scatter / np.outer(m.spread, m.spread))
        return Scaler(m.mean, m.spread), projection_of(scaled, dims)

    chains = {c: chain(moments[c]) for c in classes}
    width = {c: p.components.shape[1] for c, (_, p) in chains.items()}

    def project(c: str, source: Column) -> Column:
        scaler, projection = chains[c]
        return projection.apply(scaler.apply(source), normalize=False)

    own = F.coalesce(*[project(c, F.when(F.col(label) == c, F.col(vec))) for c in classes])
    spread = inside.select(F.col(label).alias("_label"), own.alias("_x"))
    out = test
    for w in sorted(set(width.values())):  # classes of few rows have fewer directions
        same = [c for c in classes if width[c] == w]
        names = [f"_x{j}" for j in range(w)]
        models = fit_one_class_by(spread.filter(F.col("_label").isin(same)).select("_label", *[F.col("_x")[j].alias(n) for j, n in enumerate(names)]), "_label", names, same, nu)
        for c in same:
            out = out.withColumn(f"score_{list(classes).index(c)}", models[c]._expr("score", project(c, F.col(vec))))
    scores = F.array(*[F.col(f"score_{i}") for i in range(len(classes))])
    return out.withColumn("predicted", F.array(*[F.lit(c) for c in classes])[argmax(scores)])


def two_prompt_gate(df: DataFrame, label: str, gated: str, logit_a: str | Column, logit_b: str | Column,
                    threshold: float = 0.55) -> DataFrame:
    """Keep rows of one class whose softmax share of the first logit is high enough.

    Rows of other classes pass. Adds ``p_first``.
    """
    a = F.col(logit_a) if isinstance(logit_a, str) else logit_a
    b = F.col(logit_b) if isinstance(logit_b, str) else logit_b
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(b - a))
    return df.withColumn("p_first", p).filter((F.col(label) != gated) | (F.col("p_first") >= threshold))
