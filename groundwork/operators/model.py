"""Per-task logistic models: Newton steps on aggregated moments, closed-form scoring, imputation, nested folds.

Every step is one aggregation to a gradient and a Hessian of a few numbers; rows never leave the executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.constants import FEATURES, REGULARIZATION, RISK_THRESHOLD
from groundwork.contracts import ContractError
from groundwork.functions.text import sigmoid


@dataclass
class Logistic:
    """Coefficients of standardised features, with the means and scales they were learned on."""

    features: list[str]
    means: list[float]
    scales: list[float]
    weights: list[float]
    intercept: float
    history: list[float] = field(default_factory=list)

    def z(self, i: int) -> Column:
        return (F.col(self.features[i]).cast("double") - self.means[i]) / self.scales[i]

    def logit(self) -> Column:
        out = F.lit(self.intercept)
        for i, w in enumerate(self.weights):
            out = out + w * self.z(i)
        return out

    def probability(self) -> Column:
        return sigmoid(self.logit())


def standardise(df: DataFrame, features: Sequence[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations; a constant feature has scale 1."""
    row = df.agg(*[f(F.col(x).cast("double")).alias(f"{n}{i}") for i, x in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [row[f"m{i}"] or 0.0 for i in range(len(features))], [row[f"s{i}"] or 1.0 for i in range(len(features))]


def _moments(df: DataFrame, columns: list[Column], y: Column, weight: Column, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient, Hessian and loss of the weighted logistic loss at theta, by one aggregation."""
    k = len(columns)
    names = [f"__x{i}" for i in range(k)]
    d = df.select(*[c.alias(n) for c, n in zip(columns, names)], y.cast("double").alias("__y"), weight.cast("double").alias("__w"))
    z = F.lit(0.0)
    for n, t in zip(names, theta):
        z = z + float(t) * F.col(n)
    d = d.withColumn("__z", z).withColumn("__p", sigmoid(F.col("__z")))
    gradient = [F.sum(F.col("__w") * (F.col("__p") - F.col("__y")) * F.col(n)) for n in names]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    hessian = [F.sum(F.col("__w") * F.col("__p") * (1 - F.col("__p")) * F.col(names[i]) * F.col(names[j])) for i, j in pairs]
    loss = F.sum(F.col("__w") * (F.log1p(F.exp(-F.abs(F.col("__z")))) + F.greatest(F.col("__z"), F.lit(0.0)) - F.col("__y") * F.col("__z")))
    row = d.agg(*[c.alias(str(i)) for i, c in enumerate([*gradient, *hessian, loss])]).first()
    v = [x or 0.0 for x in row]
    h = np.zeros((k, k))
    for (i, j), x in zip(pairs, v[k:-1]):
        h[i, j] = h[j, i] = x
    return np.array(v[:k]), h, v[-1]


def fit_balanced(df: DataFrame, features: Sequence[str], label: str, c: float, steps: int = 30, tolerance: float = 1e-9) -> Logistic:
    """L2 logistic regression on standardised features with balanced class weights; like liblinear's, the
    penalty covers the intercept: half the squared norm plus c times the weighted loss."""
    means, scales = standardise(df, features)
    model = Logistic(list(features), means, scales, [0.0] * len(features), 0.0)
    n, pos = df.agg(F.count("*"), F.sum(F.col(label).cast("long"))).first()
    pos = pos or 0
    if not 0 < pos < n:
        raise ContractError("both classes are needed to fit a model")
    weight = F.when(F.col(label) == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))) * c
    columns = [*[model.z(i) for i in range(len(features))], F.lit(1.0)]
    theta, used = np.zeros(len(columns)), df.select(*features, label).cache()
    try:
        for _ in range(steps):
            g, h, loss = _moments(used, columns, F.col(label), weight, theta)
            model.history.append(float(loss + theta @ theta / 2))
            step = np.linalg.solve(h + np.eye(len(theta)), g + theta)
            theta = theta - step
            if np.abs(step).max() < tolerance:
                break
    finally:
        used.unpersist()
    model.weights, model.intercept = theta[:-1].tolist(), float(theta[-1])
    return model


def fit_tasks(features: DataFrame, label: str = "hallucinated") -> dict[str, Logistic]:
    """A model for each task, on its predictable rows; tasks with one class have none."""
    out = {}
    for task, names in FEATURES.items():
        part = features.filter((F.col("task_type") == task) & (F.col("can_predict") == 1))
        if part.select(label).distinct().count() == 2:
            out[task] = fit_balanced(part, names, label, REGULARIZATION[task])
    return out


def predict(features: DataFrame, models: dict[str, Logistic]) -> DataFrame:
    """features with risk_score and prediction; null where a row can't be predicted or its task has no model."""
    risk = F.lit(None).cast("double")
    for task, m in models.items():
        risk = F.when((F.col("task_type") == task) & (F.col("can_predict") == 1), m.probability()).otherwise(risk)
    return features.withColumn("risk_score", risk).withColumn("prediction", (F.col("risk_score") >= RISK_THRESHOLD).cast("int"))


def coefficients(spark: SparkSession, models: dict[str, Logistic]) -> DataFrame:
    rows = [(t, f, float(w)) for t, m in models.items() for f, w in zip(m.features, m.weights)]
    return spark.createDataFrame(rows, "task_type string, feature string, standardized_coefficient double")


def by_coefficient(coefs: DataFrame) -> DataFrame:
    """Coefficients by task and rising value, as a bar chart lists them."""
    return coefs.orderBy("task_type", "standardized_coefficient", "feature")


def for_each(df: DataFrame, by: Sequence[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run on the rows of every combination of these columns, such as task and model, and what it gives together
    with them. Each run fits a model with Spark jobs of its own; there are as many as combinations."""
    out = None
    for key in df.select(*by).distinct().orderBy(*by).collect():
        own = df
        for c in by:
            own = own.filter(F.col(c).eqNullSafe(F.lit(key[c])))
        part = run(own).withColumns({c: F.lit(key[c]) for c in by})
        out = part if out is None else out.unionByName(part)
    return df.limit(0) if out is None else out


def save_models(spark: SparkSession, models: dict[str, Logistic], path: str) -> None:
    """Models as one JSON line for each task."""
    rows = [(t, json.dumps({"features": m.features, "means": m.means, "scales": m.scales, "weights": m.weights, "intercept": m.intercept})) for t, m in models.items()]
    spark.createDataFrame(rows, "task_type string, model string").coalesce(1).write.mode("overwrite").json(path)


def load_models(spark: SparkSession, path: str) -> dict[str, Logistic]:
    """Models as saved; features other than the task's raise."""
    out = {r["task_type"]: Logistic(**json.loads(r["model"])) for r in spark.read.schema("task_type string, model string").json(path).collect()}
    for task, m in out.items():
        if tuple(m.features) != FEATURES.get(task):
            raise ContractError(f"{task}: the saved model has other features")
    return out


RISKS = ("eg", "rp", "sc")
DETECTOR_FEATURES = [f"risk_{x}" for x in RISKS] + [f"missing_{x}" for x in RISKS]


def impute_medians(df: DataFrame) -> dict[str, float]:
    """Median of 1 - x for eg, rp and sc, 0.5 for one that is always missing."""
    row = df.agg(*[F.median(1 - F.col(x)).alias(x) for x in RISKS]).first()
    return {x: 0.5 if row[x] is None else row[x] for x in RISKS}


def detector_features(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """risk_x = 1 - x with missing ones at the median, and missing_x."""
    risks = {f"risk_{x}": F.coalesce(1 - F.col(x), F.lit(medians[x])) for x in RISKS}
    return df.withColumns(risks | {f"missing_{x}": F.col(x).isNull().cast("int") for x in RISKS})


def fit_nonnegative(df: DataFrame, features: Sequence[str], label: str, l2: float, steps: int = 60) -> Logistic:
    """Mean logistic loss + l2 * |slopes|^2 / n with slopes of 0 or more and a free intercept: projected Newton
    steps with halving."""
    n = max(1, df.count())
    model = Logistic(list(features), [0.0] * len(features), [1.0] * len(features), [0.0] * len(features), 0.0)
    columns = [*[F.col(x).cast("double") for x in features], F.lit(1.0)]
    k, used = len(features), df.select(*features, label).cache()
    ridge = np.append(np.full(k, 2 * l2 / n), 0.0)

    def at(theta):
        g, h, loss = _moments(used, columns, F.col(label), F.lit(1.0 / n), theta)
        return g + ridge * theta, h + np.diag(ridge) + 1e-10 * np.eye(k + 1), loss + float(ridge @ theta**2) / 2

    try:
        theta = np.zeros(k + 1)
        g, h, value = at(theta)
        for _ in range(steps):
            held = np.append((theta[:k] <= 0) & (g[:k] > 0), False)
            free = ~held
            step = np.zeros(k + 1)
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            size = 1.0
            while True:
                new = theta - size * step
                new[:k] = np.maximum(new[:k], 0)
                ng, nh, nv = at(new)
                if nv <= value + 1e-12 or size < 1e-4:
                    break
                size /= 2
            moved = np.abs(new - theta).max()
            theta, g, h, value = new, ng, nh, nv
            if moved < 1e-8:
                break
    finally:
        used.unpersist()
    model.weights, model.intercept, model.history = theta[:k].tolist(), float(theta[k]), [value]
    return model


def nested_oof(df: DataFrame, key: str = "sample_id", group: str = "source_id", label: str = "hallucinated", outer: int = 5, inner: int = 3, grid: Sequence[float] = (0.01, 0.1, 1.0, 10.0)) -> tuple[DataFrame, list[dict]]:
    """Out-of-fold probabilities and predictions: for each outer fold, the penalty with the least inner log
    loss (the first of equals) and the threshold of best inner F1. Folds hold whole groups."""
    from . import metrics, sampling

    columns = list(dict.fromkeys([key, group, "task_type", label, *RISKS]))
    folded = sampling.group_folds(df.select(*[c for c in columns if c in df.columns]), group, label, outer).cache()
    parts, rows = [], []
    loss = lambda p, y: F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))
    for fold in range(outer):
        train, test = folded.filter(F.col("fold") != fold).drop("fold"), folded.filter(F.col("fold") == fold).drop("fold")
        split = sampling.group_folds(train, group, label, inner, seed=42 + fold).withColumnRenamed("fold", "inner").cache()
        prepared = []
        for k in range(inner):
            fit_part = split.filter(F.col("inner") != k)
            medians = impute_medians(fit_part)
            prepared.append((detector_features(fit_part, medians), detector_features(split.filter(F.col("inner") == k), medians)))
        best = None
        for l2 in grid:
            scored = None
            for fit_part, held in prepared:
                one = held.withColumn("probability", fit_nonnegative(fit_part, DETECTOR_FEATURES, label, l2).probability())
                scored = one if scored is None else scored.unionByName(one)
            p = F.greatest(F.lit(1e-8), F.least(F.lit(1 - 1e-8), F.col("probability")))
            value = scored.agg(loss(p, F.col(label)).alias("v")).first()["v"]
            if value is not None and (best is None or value < best[0]):
                best = (value, l2, scored)
        cut = metrics.best_f1_threshold(best[2], [], label, "probability").first()
        medians = impute_medians(train)
        model = fit_nonnegative(detector_features(train, medians), DETECTOR_FEATURES, label, best[1])
        parts.append(detector_features(test, medians).withColumn("probability", model.probability()).withColumn("prediction", (F.col("probability") >= cut["threshold"]).cast("int")))
        rows.append({"fold": fold, "l2": best[1], "threshold": cut["threshold"], "intercept": model.intercept} | dict(zip(DETECTOR_FEATURES, model.weights)))
        split.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*[c for c in (key, group, "task_type", label) if c in df.columns], "probability", "prediction"), rows
