"""Positive-unlabelled classifiers, one per split, and combined scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written


def z_scores(df: DataFrame, keys: Sequence[str], columns: Sequence[str], over: DataFrame | None = None) -> DataFrame:
    """df with z_<column>: (x - mean) / population deviation within the key, a deviation of 0 counting as 1.

    Means and deviations are aggregated first and joined back, one row per key. over: the rows that they are of, df's by default.
    """
    stats = (df if over is None else over).groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("_m", F.avg), ("_s", F.stddev_pop))])
    joined = df.join(stats, list(keys))
    out = joined.withColumns({f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns})
    return out.select(*df.columns, *[f"z_{c}" for c in columns])


def reliable_negatives(df: DataFrame, keys: Sequence[str], score: str, m: int | str) -> DataFrame:
    """The m rows of the lowest score per key, ties by word. m: a number, or a column with each key's.

    The largest m is a constant of the plan, so that tasks pass on no more than that of a key.
    """
    order = Window.partitionBy(*keys).orderBy(score, "word")
    most = m if isinstance(m, int) else int(df.agg(F.max(m)).first()[0] or 0)
    first = df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most)
    return (first if isinstance(m, int) else first.filter(F.col("_rn") <= F.col(m))).drop("_rn")


def newton_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, balanced: bool = True, rounds: int = 50) -> np.ndarray:
    """Weights, then the intercept, of L2-penalised logistic regression (penalty |w|^2 / 2 + c * loss)."""
    n = len(y)
    weight = np.where(y > 0, n / (2 * max(1, y.sum())), n / (2 * max(1, n - y.sum()))) if balanced else np.ones(n)
    a = np.c_[x, np.ones(n)]
    ridge = np.r_[np.ones(x.shape[1]), 0.0]
    w = np.zeros(a.shape[1])

    def loss(v: np.ndarray) -> float:
        return c * float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ v))).sum()) + 0.5 * float((ridge * v * v).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        grad = c * (a.T @ (weight * (p - y))) + ridge * w
        hess = c * (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-12)
        step = np.linalg.solve(hess, grad)
        scale = next((s for s in (1.0, 0.5, 0.25, 0.1, 0.01) if loss(w - s * step) <= loss(w)), 0.0)
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-10:
            break
    return w


def fit_per_key(training: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "label", c: float = 1.0, balanced: bool = True) -> DataFrame:
    """(keys, weights array<double>, intercept, means, deviations): one classifier per key, trained in its own task.

    Training sets are small (a few rows per known term), so that a key fits one task; for a set that grows
    with the vocabulary see fit_large. Features are standardised with the mean and the population
    deviation (0 counts as 1) of their values that are numbers; after that NaN and null count as 0.
    """
    types = {f.name: f.dataType.simpleString() for f in training.schema}
    names, keys = list(features), list(keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[names].to_numpy(float)
        known = ~np.isnan(x).all(0)
        mean, dev = np.zeros(len(names)), np.ones(len(names))
        mean[known], dev[known] = np.nanmean(x[:, known], 0), np.nanstd(x[:, known], 0)
        dev[dev == 0] = 1
        w = newton_logistic(np.nan_to_num((x - mean) / dev, nan=0.0), pdf[label].to_numpy(float), c, balanced)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "weights": [w[:-1].tolist()], "intercept": [w[-1]], "means": [mean.tolist()], "deviations": [dev.tolist()]})

    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["weights array<double>, intercept double, means array<double>, deviations array<double>"])
    return training.select(*keys, label, *names).groupBy(*keys).applyInPandas(fit, schema)


def fit_large(training: DataFrame, features: Sequence[str], label: str = "label", c: float = 1.0, balanced: bool = True, standardise: bool = True) -> DataFrame:
    """One row (weights, intercept, means, deviations), as of fit_per_key, of one classifier fitted by all tasks together (MLlib)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    stats = training.agg(F.count("*"), F.sum(F.col(label).cast("double")), *[f(F.when(~F.isnan(x), F.col(x))) for x in features for f in (F.avg, F.stddev_pop)]).first()
    n, positive = stats[0], stats[1]
    means, devs = ([x or 0.0 for x in stats[2::2]], [x or 1.0 for x in stats[3::2]]) if standardise else ([0.0] * len(features), [1.0] * len(features))
    scaled = [F.nanvl(F.coalesce((F.col(x).cast("double") - m) / d, F.lit(0.0)), F.lit(0.0)) for x, m, d in zip(features, means, devs, strict=True)]
    weight = F.when(F.col(label) == 1, n / (2 * max(1.0, positive))).otherwise(n / (2 * max(1.0, n - positive))) if balanced else F.lit(1.0)
    rows = training.select(array_to_vector(F.array(*scaled)).alias("features"), F.col(label).cast("double").alias("label"), weight.alias("weight"))
    # MLlib divides the loss by the sum of the weights, which is n
    model = LogisticRegression(regParam=1.0 / (c * n), standardization=False, weightCol="weight", maxIter=200, tol=1e-10).fit(rows)
    schema = "weights array<double>, intercept double, means array<double>, deviations array<double>"
    return training.sparkSession.createDataFrame([(model.coefficients.toArray().tolist(), float(model.intercept), means, devs)], schema)


def predict(df: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str], name: str = "score") -> DataFrame:
    """df with the probability of class 1 by its key's classifier; a feature that is NaN or null has no part in it."""
    if keys:
        joined = df.join(models, list(keys))
    else:  # one row
        joined = df.withColumn("_model", models.select(F.struct(*models.columns)).scalar()).select(*df.columns, "_model.*")
    terms = [F.nanvl(F.coalesce((F.col(f).cast("double") - F.col("means")[i]) / F.col("deviations")[i], F.lit(0.0)), F.lit(0.0)) * F.col("weights")[i] for i, f in enumerate(features)]
    z = sum(terms, F.col("intercept"))
    return joined.withColumn(name, 1 / (1 + F.exp(-z))).select(*df.columns, name)


def fit_gaps(training: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "label", c: float = 1.0, balanced: bool = True) -> DataFrame:
    """(keys, positives, negatives, gap): the largest component of the loss's gradient at each key's classifier, 0 at the optimum.

    Features are standardised by the classifier's means and deviations, as in predict. All sums are over rows,
    so that a classifier of fit_large can be judged as well as those of fit_per_key.
    """
    # written, so that Spark knows how few they are: training rows would be moved to meet them
    models, sizes = written(models), written(training.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("double")).alias("_p")))
    rows = training.select(*keys, label, *features).join(models, list(keys)).join(sizes, list(keys))
    x = [F.nanvl(F.coalesce((F.col(f).cast("double") - F.col("means")[i]) / F.col("deviations")[i], F.lit(0.0)), F.lit(0.0)) for i, f in enumerate(features)]
    rows = rows.select(*keys, label, "weights", "intercept", "_n", "_p", *[v.alias(f"_x{i}") for i, v in enumerate(x)])
    z = sum((F.col(f"_x{i}") * F.col("weights")[i] for i in range(len(x))), F.col("intercept"))
    y = F.col(label).cast("double")
    weight = F.when(y > 0, F.col("_n") / (2 * F.greatest(F.lit(1.0), "_p"))).otherwise(F.col("_n") / (2 * F.greatest(F.lit(1.0), F.col("_n") - F.col("_p")))) if balanced else F.lit(1.0)
    error = c * weight * (1 / (1 + F.exp(-z)) - y)
    sums = rows.groupBy(*keys).agg(F.count_if(y > 0).alias("positives"), F.count_if(y <= 0).alias("negatives"), F.first("weights").alias("w"), F.abs(F.sum(error)).alias("_g"), *[F.sum(error * F.col(f"_x{i}")).alias(f"_g{i}") for i in range(len(x))])
    return sums.select(*keys, "positives", "negatives", F.greatest("_g", *[F.abs(F.col(f"_g{i}") + F.col("w")[i]) for i in range(len(x))]).alias("gap"))


def weight_table(models: DataFrame, features: Sequence[str], clf: str = "clf") -> DataFrame:
    """(feature, <clf>_weight_mean, <clf>_weight_std, ...): each classifier's mean weights and their population deviations over keys."""
    names = F.array(*map(F.lit, features))
    long = models.select(clf, F.posexplode("weights").alias("at", "w")).select(clf, F.element_at(names, F.col("at") + 1).alias("feature"), "w")
    kinds = [r[0] for r in models.select(clf).distinct().orderBy(clf).limit(100).collect()]
    own = {k: F.when(F.col(clf) == k, F.col("w")) for k in kinds}
    return long.groupBy("feature").agg(*[f(x).alias(f"{k}_weight_{n}") for k, x in own.items() for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
