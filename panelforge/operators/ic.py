"""Information coefficients: daily rank correlations of a signal with what follows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as k

#: Assets a date needs, rows a regime needs, rows a regression needs.
MIN_ASSETS, MIN_REGIME, MIN_FIT = 3, 10, 30


def daily(signals: DataFrame, forward: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(feature_id, h, d, ic): Spearman correlation over the assets of a date.

    :param signals: (asset, d, feature_id, value) without null values.
    :param forward: (asset, d, h, fwd) of the ``horizons``.

    Dates of a signal with fewer than MIN_ASSETS pairs keep a row with a null
    ic; so do dates on which one side does not vary. Ties share average ranks,
    taken after pairs are formed.
    """
    pairs = signals.join(forward, ["asset", "d"])
    by = ["feature_id", "h", "d"]
    ranked = pairs.select(*by, k.average_rank(F.col("value"), by).alias("_a"), k.average_rank(F.col("fwd"), by).alias("_b"))
    ic = ranked.groupBy(*by).agg(F.when(F.count("*") >= MIN_ASSETS, k.pearson(F.col("_a"), F.col("_b"))).alias("ic"))
    dates = signals.select("feature_id", "d").distinct().select("feature_id", F.explode(F.array(*map(F.lit, horizons))).alias("h"), "d")
    return dates.join(ic, by, "left")


def _average_ranks(x: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def _doubles(t: pa.Table, c: str) -> np.ndarray:
    return t.column(c).to_numpy().astype(float)


def daily_wide(wide: DataFrame, horizons: dict[str, tuple[int, ...]]) -> DataFrame:
    """``daily`` from sibling columns: (asset, d, a column a feature, ``fwd_{h}``), in one exchange by date.

    :param horizons: the features, and the horizons of each.

    A date holds a row an asset at most, so its ranks, of all features and
    horizons, are one call; no row is written out once a feature and horizon.
    """

    def one(t: pa.Table) -> pa.Table:
        d, out = t.column("d")[0].as_py(), []
        forward = {h: _doubles(t, f"fwd_{h}") for h in {h for hs in horizons.values() for h in hs}}
        for f, hs in horizons.items():
            x = _doubles(t, f)
            there = ~np.isnan(x)
            if not there.any():
                continue
            for h in hs:
                both = there & ~np.isnan(forward[h])
                ic = None
                if both.sum() >= MIN_ASSETS:
                    a, b = _average_ranks(x[both]), _average_ranks(forward[h][both])
                    a, b = a - a.mean(), b - b.mean()
                    size = math.sqrt(float(a @ a) * float(b @ b))
                    ic = float(a @ b) / size if size else None
                out.append((f, h, d, ic))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.date32(), pa.float64()), strict=True)], names=["feature_id", "h", "d", "ic"])

    need = ["d", *horizons, *sorted({f"fwd_{h}" for hs in horizons.values() for h in hs})]
    return wide.select(*need).groupBy("d").applyInArrow(one, "feature_id string, h int, d date, ic double")


def residuals_wide(wide: DataFrame, controls: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """asset, d, ``keep`` and each target of ``controls`` less what its controls explain, all in one pass over each asset.

    The fit is that of ``orthogonalize``. An asset has a row a calendar day at
    most, and the rows lie by asset already where windows made the columns.
    """
    names = list(controls)

    def one(t: pa.Table) -> pa.Table:
        col = {c: _doubles(t, c) for c in {*names, *(c for cs in controls.values() for c in cs)}}
        out = {c: t.column(c) for c in ("asset", "d", *keep)}
        for y, cs in controls.items():
            full = ~np.isnan(np.column_stack([col[y], *[col[c] for c in cs]])).any(axis=1)
            value = col[y]
            if cs and full.sum() >= MIN_FIT:
                mean = {c: col[c][full].mean() for c in (y, *cs)}
                x = np.column_stack([col[c] - mean[c] for c in cs])
                gram = x[full].T @ x[full]
                apart = gram[0, 0] > 0 if len(cs) == 1 else gram[0, 0] * gram[1, 1] - gram[0, 1] ** 2 > 1e-12 * gram[0, 0] * gram[1, 1]
                if apart:
                    value = col[y] - mean[y] - x @ np.linalg.solve(gram, x[full].T @ (col[y][full] - mean[y]))
            out[y] = pa.array(value, pa.float64(), from_pandas=True)
        return pa.table(out)

    kinds = ", ".join(f"{c} {wide.schema[c].dataType.simpleString()}" for c in ("asset", "d", *keep)) + "".join(f", {y} double" for y in names)
    need = dict.fromkeys(["asset", "d", *keep, *names, *(c for cs in controls.values() for c in cs)])
    return wide.select(*need).groupBy("asset").applyInArrow(one, kinds)


def summary(ic: DataFrame, by: tuple[str, ...] = ("feature_id", "h")) -> DataFrame:
    """Mean, ratio of mean to deviation, valid dates and standard error of the mean."""
    sd = F.stddev_samp("ic")
    return ic.groupBy(*by).agg(
        F.avg("ic").alias("ic_mean"), F.when(sd > 0, F.avg("ic") / sd).alias("icir"), F.count("ic").alias("n"),
        F.try_divide(sd, F.sqrt(F.count("ic").cast("double"))).alias("stderr"),
    )


def rolling(ic: DataFrame, n: int = 63, least: int = 20) -> DataFrame:
    """Rolling mean and ratio over the dates that have an ic."""
    w = Window.partitionBy("feature_id", "h").orderBy("d")
    have = ic.filter(F.col("ic").isNotNull())
    mean, sd = k.roll(F.col("ic"), n, F.avg, least, w), k.roll(F.col("ic"), n, F.stddev_samp, least, w)
    return have.select("feature_id", "h", "d", mean.alias("ic_roll"), k.div(mean, k.spread(sd)).alias("icir_roll"))


def monthly(ic: DataFrame) -> DataFrame:
    """Mean ic of each calendar month between a series' first and last, months without any kept."""
    m = ic.groupBy("feature_id", "h", F.trunc("d", "month").alias("month")).agg(F.avg("ic").alias("ic"))
    spine = m.groupBy("feature_id", "h").agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return spine.join(m, ["feature_id", "h", "month"], "left")


def histogram(ic: DataFrame, bins: int = 40) -> DataFrame:
    """(feature_id, h, bin, n): equal bins between the smallest and greatest ic, the last one closed."""
    have = ic.filter(F.col("ic").isNotNull())
    w = Window.partitionBy("feature_id", "h")
    lo, hi = F.min("ic").over(w), F.max("ic").over(w)
    at = F.least(F.lit(bins), F.floor(F.coalesce(F.try_divide(F.col("ic") - lo, hi - lo), F.lit(0.0)) * bins) + 1).cast("int")
    return have.select("feature_id", "h", at.alias("bin")).groupBy("feature_id", "h", "bin").agg(F.count("*").alias("n"))


def orthogonalize(panel: DataFrame, target: str, controls: list[str]) -> DataFrame:
    """(asset, d, value): ``target`` less what one or two controls explain of it, per asset.

    A least-squares fit with intercept over all complete rows of an asset (in
    sample by design), in closed form from one aggregate of covariances. Assets
    with fewer than MIN_FIT complete rows, and a fit whose controls do not vary
    apart, keep the target. Rows without target or, where there is a fit,
    without controls have no value.
    """
    if not controls:
        return panel.select("asset", "d", F.col(target).alias("value"))
    y, a = F.col(target), F.col(controls[0])
    b = F.col(controls[1]) if len(controls) > 1 else F.lit(0.0)
    full = y.isNotNull() & a.isNotNull() & b.isNotNull()
    on = lambda x: F.when(full, x)
    fit = panel.groupBy("asset").agg(
        F.count(on(y)).alias("_n"), F.avg(on(y)).alias("_my"), F.avg(on(a)).alias("_ma"), F.avg(on(b)).alias("_mb"),
        F.covar_pop(on(a), on(a)).alias("_aa"), F.covar_pop(on(b), on(b)).alias("_bb"), F.covar_pop(on(a), on(b)).alias("_ab"),
        F.covar_pop(on(a), on(y)).alias("_ay"), F.covar_pop(on(b), on(y)).alias("_by"),
    )
    if len(controls) > 1:
        det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
        ok = det > 1e-12 * F.col("_aa") * F.col("_bb")
        slope_a = F.try_divide(F.col("_ay") * F.col("_bb") - F.col("_by") * F.col("_ab"), det)
        slope_b = F.try_divide(F.col("_by") * F.col("_aa") - F.col("_ay") * F.col("_ab"), det)
    else:
        ok, slope_a, slope_b = F.col("_aa") > 0, F.try_divide(F.col("_ay"), F.col("_aa")), F.lit(0.0)
    fit = fit.select("asset", ((F.col("_n") >= MIN_FIT) & F.coalesce(ok, F.lit(False))).alias("_ok"), "_my", "_ma", "_mb", slope_a.alias("_sa"), slope_b.alias("_sb"))
    residual = y - F.col("_my") - F.col("_sa") * (a - F.col("_ma")) - F.col("_sb") * (b - F.col("_mb"))
    return panel.join(fit, "asset").select("asset", "d", F.when(F.col("_ok"), residual).otherwise(y).alias("value"))


def regimes(panel: DataFrame, asset: str, window: int = 30) -> DataFrame:
    """(d, regime): high_vol where the reference asset's realised volatility is at least its full-sample median, null in warm-up."""
    one = panel.filter(F.col("asset") == asset).withColumn("_lr", k.log_change(F.col("close")))
    rv = one.select("d", (k.roll(F.col("_lr"), window, F.stddev_samp) * math.sqrt(365)).alias("rv"))
    rv = rv.withColumn("_t", F.expr("percentile(rv, 0.5) OVER (PARTITION BY 1)"))  # one asset: a row a calendar day
    return rv.select("d", F.when(F.col("rv") >= F.col("_t"), "high_vol").when(F.col("rv").isNotNull(), "low_vol").alias("regime"))


def by_regime(ic: DataFrame, labels: DataFrame, least: int = MIN_REGIME) -> DataFrame:
    """(feature_id, h, regime, mean_ic, std_ic, icir, n), a row for either regime; one with fewer than ``least`` dates is null with n 0.

    With ``least`` 0 these are the plain bars, n being the dates there are.
    """
    both = ic.join(labels, "d", "left")
    cells = ic.select("feature_id", "h").distinct().select("feature_id", "h", F.explode(F.array(F.lit("high_vol"), F.lit("low_vol"))).alias("regime"))
    s = both.filter(F.col("ic").isNotNull() & F.col("regime").isNotNull()).groupBy("feature_id", "h", "regime").agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), F.count("*").alias("c"))
    s = cells.join(s, ["feature_id", "h", "regime"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    enough = F.col("c") >= least
    return s.select(
        "feature_id", "h", "regime", F.when(enough, F.round("m", 4)).alias("mean_ic"), F.when(enough, F.round("s", 4)).alias("std_ic"),
        F.when(enough & (F.col("s") > 0), F.round(F.col("m") / F.col("s"), 3)).alias("icir"), F.when(enough, F.col("c")).otherwise(0).alias("n"),
    )


def pooled(predictions: DataFrame, by: list[str], x: str, y: str, least: int = 30) -> DataFrame:
    """(by, n, ic): one Spearman coefficient over all complete rows of a group; null below ``least`` rows.

    Groups may be of any size: ranks are exact by range partitions.
    """
    from .ranks import exact_ranks

    rows = predictions.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).cast("double").alias("v")) for n, c in (("a", x), ("b", y))])).alias("s")
    long = rows.select(F.xxhash64("asset", "d", *by).alias("id"), key.alias("k"), sides).select("id", F.concat("s.side", "k").alias("g"), "s.v")
    ranked = exact_ranks(long, "g", "v", "id").select("id", F.substring("g", 1, 1).alias("side"), F.expr("substring(g, 2)").alias("k"), ((F.col("below") + F.col("upto") + 1) / 2).alias("r"))
    pair = ranked.groupBy("id", "k").agg(F.max(F.when(F.col("side") == "a", F.col("r"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("r"))).alias("b"))
    out = pair.groupBy("k").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, k.pearson(F.col("a"), F.col("b"))).alias("ic"))
    fields = [F.get_json_object("k", f"$.{c}").alias(c) for c in by]
    return out.select(*fields, "n", "ic")
