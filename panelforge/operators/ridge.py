"""Walk-forward ridge regression on a normalised feature matrix.

The table is read once: one aggregate per fold gives the Gram matrix and the
moments, a solve on the driver of features × features numbers gives the
coefficients, and the leave-one-out error that picks the penalty is a column
expression summed in one more pass, for all penalties at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from .panel import cs_zscore

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)


@dataclass(frozen=True)
class Fold:
    name: str
    train_end: str
    test_start: str
    test_end: str


@dataclass(frozen=True)
class Fit:
    fold: str
    alpha: float
    coef: tuple[float, ...]


def matrix(wide: DataFrame, features: list[str], target: str) -> DataFrame:
    """asset, d, ``features`` as cross-sectional scores and ``target``, complete rows only."""
    scored = wide.select("asset", "d", *[cs_zscore(F.col(f)).alias(f) for f in features], target)
    return scored.dropna(subset=[*features, target])


def expanding_folds(first: str, last: str, n: int = 3) -> list[Fold]:
    """n folds that split the dates after the first part evenly; each trains on all before its test."""
    import datetime as dt

    a, z = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    step = (z - a).days // (n + 1)
    cut = [a + dt.timedelta(days=step * (i + 1)) for i in range(n)] + [z]
    day = dt.timedelta(days=1)
    return [Fold(f"fold{i + 1}", cut[i].isoformat(), (cut[i] + day).isoformat(), cut[i + 1].isoformat()) for i in range(n)]


def _between(a: str | None, z: str) -> Column:
    upto = F.col("d") <= F.lit(z).cast("date")
    return upto if a is None else upto & (F.col("d") >= F.lit(a).cast("date"))


def fit(data: DataFrame, features: list[str], target: str, fold: Fold, alphas: tuple[float, ...] = ALPHAS) -> Fit | None:
    """The penalty of least leave-one-out error and its coefficients, without intercept; None if there is nothing to fit."""
    train = data.filter(_between(None, fold.train_end))
    n = len(features)
    cells = [F.sum(F.col(features[i]) * F.col(features[j])) for i in range(n) for j in range(i, n)]
    row = train.agg(F.count("*"), *cells, *[F.sum(F.col(f) * F.col(target)) for f in features]).first()
    if not row[0]:
        return None
    gram, at = np.zeros((n, n)), 1
    for i in range(n):
        for j in range(i, n):
            gram[i, j] = gram[j, i] = row[at]
            at += 1
    xy = np.array(row[at:])
    errors, coefs = [], []
    for a in alphas:
        inv = np.linalg.inv(gram + a * np.eye(n))
        coefs.append(inv @ xy)
        guess = sum((F.col(f) * float(c) for f, c in zip(features, coefs[-1], strict=True)), F.lit(0.0))
        # leverage: the row's quadratic form in the inverse
        lever = sum((F.col(features[i]) * F.col(features[j]) * float(inv[i, j] * (1 if i == j else 2)) for i in range(n) for j in range(i, n)), F.lit(0.0))
        errors.append(F.avg(F.pow(F.try_divide(F.col(target) - guess, 1 - lever), 2)))
    scores = train.agg(*errors).first()
    best = int(np.argmin([s if s is not None else np.inf for s in scores]))
    return Fit(fold.name, alphas[best], tuple(map(float, coefs[best])))


def predict(data: DataFrame, features: list[str], fitted: Fit, fold: Fold) -> DataFrame:
    test = data.filter(_between(fold.test_start, fold.test_end))
    guess = sum((F.col(f) * c for f, c in zip(features, fitted.coef, strict=True)), F.lit(0.0))
    return test.withColumn("prediction", guess).withColumn("fold", F.lit(fitted.fold))


def walk_forward(data: DataFrame, features: list[str], target: str, folds: list[Fold]) -> tuple[DataFrame, list[Fit]]:
    """Out-of-sample predictions of all folds, and the fits."""
    from ..session import materialize

    data = materialize(data.select("asset", "d", *features, target), "ridge")  # read twice a fold
    fits, parts = [], []
    for f in folds:
        if (x := fit(data, features, target, f)) is not None:
            fits.append(x)
            parts.append(predict(data, features, x, f))
    out = parts[0] if parts else data.limit(0).withColumns({"prediction": F.lit(0.0), "fold": F.lit("")})
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, fits


def oos_ic(predictions: DataFrame, target: str) -> DataFrame:
    """(fold, n_dates, ic_mean, icir, positive_share): daily rank correlations of prediction and outcome, per fold and over all."""
    both = predictions.select("d", "prediction", target, F.explode(F.array("fold", F.lit("all"))).alias("fold"))
    by = ["fold", "d"]
    r = both.select(*by, k.average_rank(F.col("prediction"), by).alias("a"), k.average_rank(F.col(target), by).alias("b"))
    daily = r.groupBy(*by).agg(F.when(F.count("*") >= 3, k.pearson(F.col("a"), F.col("b"))).alias("ic"))
    sd = F.stddev_samp("ic")
    return daily.groupBy("fold").agg(F.count("ic").alias("n_dates"), F.avg("ic").alias("ic_mean"), F.when(sd > 0, F.avg("ic") / sd).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"))
