"""Quality checks of features: distribution, coverage, lookahead, explosion, stationarity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.features import FeatureSpec, compute, to_long

MIN_ROWS, OUTLIER_SIGMAS, OUTLIER_SHARE, MAX_MISSING, EXPLOSION_ROWS, EXPLOSION_TIMES = 30, 10, 0.01, 0.20, 504, 5


def distribution(values: DataFrame) -> DataFrame:
    """Per feature: n, mean, std, min, max, lag-1 autocorrelation, share of values beyond 10 deviations, and whether that passes.

    :param values: (asset, d, feature_id, value) of one reference asset; nulls
        are dropped first. Fewer than MIN_ROWS values fail.
    """
    have = values.filter(F.col("value").isNotNull())
    w = Window.partitionBy("feature_id", "asset").orderBy("d")
    lagged = have.withColumn("prev", F.lag("value").over(w))
    pair = lambda c: F.when(F.col("prev").isNotNull(), F.col(c))
    stats = lagged.groupBy("feature_id").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        k.pearson(pair("value"), pair("prev")).alias("ac1"),
    )
    far = have.join(stats.select("feature_id", F.col("mean").alias("_m"), F.col("std").alias("_s")), "feature_id")
    out = far.groupBy("feature_id").agg(F.avg(F.when(F.abs(F.col("value") - F.col("_m")) > OUTLIER_SIGMAS * F.col("_s"), 1.0).otherwise(0.0)).alias("outlier_share"))
    return stats.join(out, "feature_id").withColumn("passed", (F.col("n") >= MIN_ROWS) & (F.col("outlier_share") < OUTLIER_SHARE))


def coverage(values: DataFrame, warmup: dict[str, int]) -> DataFrame:
    """Per feature and asset: share of missing values after the warm-up rows; at most MAX_MISSING passes, none at all left fails."""
    w = Window.partitionBy("feature_id", "asset").orderBy("d")
    bars = F.create_map(*[x for f, n in warmup.items() for x in (F.lit(f), F.lit(n))])
    rest = values.withColumn("_i", F.row_number().over(w)).withColumn("_late", F.col("_i") > F.coalesce(bars[F.col("feature_id")], F.lit(1)))
    out = rest.groupBy("feature_id", "asset").agg(
        F.count(F.when(F.col("_late"), 1)).alias("n"), F.try_divide(F.count(F.when(F.col("_late") & F.col("value").isNull(), 1)).cast("double"), F.count(F.when(F.col("_late"), 1)).cast("double")).alias("missing_share"),
    )
    return out.withColumn("passed", F.coalesce(F.col("missing_share") <= MAX_MISSING, F.lit(False)))


def qa_warmup(spec: FeatureSpec) -> int:
    """The warm-up the checks allow: the window, else the lookback, else one row."""
    return spec.params.get("window_d") or spec.params.get("lookback_d") or 1


def explosion(values: DataFrame, n: int = 252, least: int = 126) -> DataFrame:
    """Per feature and asset: last over first rolling deviation of the values that are there; below EXPLOSION_TIMES, or too short, passes."""
    w = Window.partitionBy("feature_id", "asset").orderBy("d")
    have = values.filter(F.col("value").isNotNull()).withColumn("_sd", k.roll(F.col("value"), n, F.stddev_samp, least, w))
    valid = F.when(F.col("_sd").isNotNull(), F.col("d"))
    out = have.groupBy("feature_id", "asset").agg(F.count("*").alias("n"), k.div(F.max_by("_sd", valid), k.spread(F.min_by("_sd", valid))).alias("ratio"))
    return out.withColumn("passed", (F.col("n") < EXPLOSION_ROWS) | F.coalesce(F.col("ratio") < EXPLOSION_TIMES, F.lit(False)))


def spots(panel: DataFrame, n: int = 10) -> list[str]:
    """``n`` dates of the panel, evenly spaced among those it has (all if there are fewer); ``n`` rows come to the driver."""
    dates = panel.select("d").distinct()
    total = F.count("*").over(Window.partitionBy(F.lit(1)))  # one row a date
    at = dates.withColumns({"_i": F.row_number().over(Window.orderBy("d")) - 1, "_n": total})
    slot = lambda i: F.floor((i * n + F.floor(F.lit(n) / 2)) / F.col("_n"))
    return [str(r.d) for r in at.filter((F.col("_n") <= n) | (slot(F.col("_i")) != slot(F.col("_i") - 1))).orderBy("d").limit(n).collect()]


def lookahead(panel: DataFrame, wanted: list[FeatureSpec], spots: list[str], atol: float = 1e-10, rtol: float = 1e-5) -> DataFrame:
    """(feature_id, spot, n, n_bad): values of each spot date recomputed from rows up to it, compared with the full run.

    ``spots`` are ISO dates. All are recomputed in one run: of each asset and
    spot, the spot's row and the rows before it that the features need are a
    series of their own.
    """
    ids = [s.id for s in wanted]
    full = to_long(compute(panel, wanted), ids, drop_null=False)
    rows = max(s.warmup_rows for s in wanted) + 1
    at = F.explode(F.array(*[F.lit(s).cast("date") for s in spots])).alias("_spot")
    cut = panel.select("*", at).filter(F.col("d") <= F.col("_spot"))
    back = F.row_number().over(Window.partitionBy("asset", "_spot").orderBy(F.col("d").desc()))
    cut = cut.withColumn("_k", back).filter(F.col("_k") <= rows).withColumn("asset", F.concat(F.col("_spot").cast("string"), F.lit("|"), F.col("asset"))).drop("_k", "_spot")
    again = to_long(compute(cut, wanted), ids, drop_null=False).filter(F.substring("asset", 1, 10) == F.col("d").cast("string"))
    again = again.select(F.expr("substring(asset, 12)").alias("asset"), "d", "feature_id", F.col("value").alias("again"))
    both = full.filter(F.col("d").isin([F.lit(s).cast("date") for s in spots])).join(again, ["asset", "d", "feature_id"])
    a, b = F.col("value"), F.col("again")
    close = (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False))
    return both.groupBy("feature_id", F.date_format("d", "yyyy-MM-dd").alias("spot")).agg(F.count("*").alias("n"), F.count(F.when(~close, 1)).alias("n_bad"))


#: Response surface for the p-value of a unit-root statistic with a constant (published, fixed values): coefficients of powers of the
#: statistic for its small-p and its large-p part, the statistic that parts them, and the range outside which p is 0 or 1.
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74


def adf(x: np.ndarray, lags: int = 5) -> tuple[float, float]:
    """Augmented Dickey-Fuller statistic and p-value with a constant and a fixed number of lags; NaN where it can't be fitted."""
    dx = np.diff(x)
    n = len(dx) - lags
    if n <= lags + 3:
        return math.nan, math.nan
    design = np.column_stack([x[lags:-1], *[dx[lags - i : len(dx) - i] for i in range(1, lags + 1)], np.ones(n)])
    y = dx[lags:]
    gram = design.T @ design
    if np.linalg.matrix_rank(gram) < gram.shape[0]:
        return math.nan, math.nan
    beta = np.linalg.solve(gram, design.T @ y)
    resid = y - design @ beta
    var = resid @ resid / (n - design.shape[1]) * np.linalg.inv(gram)[0, 0]
    if not var > 0:
        return math.nan, math.nan
    stat = float(beta[0] / math.sqrt(var))
    if stat >= ADF_MAX:
        return stat, 1.0
    if stat <= ADF_MIN:
        return stat, 0.0
    poly = ADF_SMALL if stat <= ADF_STAR else ADF_LARGE
    z = sum(c * stat**i for i, c in enumerate(poly))
    return stat, 0.5 * math.erfc(-z / math.sqrt(2))


def stationarity(values: DataFrame, lags: int = 5, level: float = 0.05) -> DataFrame:
    """(feature_id, asset, n, adf, p, stationary); series are at most a row a calendar day, so each is one grouped call."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("d")["value"].dropna().to_numpy(float)
        stat, p = adf(x, lags) if len(x) >= MIN_ROWS else (math.nan, math.nan)
        row = {"feature_id": pdf["feature_id"].iloc[0], "asset": pdf["asset"].iloc[0], "n": len(x), "adf": None if stat != stat else stat, "p": None if p != p else p, "stationary": bool(p < level)}
        return pd.DataFrame([row])

    out = "feature_id string, asset string, n bigint, adf double, p double, stationary boolean"
    return values.select("feature_id", "asset", "d", "value").groupBy("feature_id", "asset").applyInPandas(one, out)
