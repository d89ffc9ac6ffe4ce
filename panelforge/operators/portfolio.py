"""Backtest statistics: signals to returns, returns to curves and ratios."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as k

TRADING_DAYS, CALENDAR_DAYS = 252, 365


def binary_signal(x: Column, direction: int = 1) -> Column:
    """``direction`` where x is above zero, its opposite elsewhere, nulls included."""
    return F.when(x > 0, direction).otherwise(-direction)


def returns(panel: DataFrame) -> DataFrame:
    """The panel with ``r``, the simple return of a row, and ``fwd``, that of the next."""
    r = panel.withColumn("r", k.change(F.col("close")))
    return r.withColumn("fwd", F.lead("r", 1).over(k.series()))


def equity(df: DataFrame, ret: str, by: str = "asset") -> DataFrame:
    """``df`` with ``equity``, the running product of 1 + return (missing returns earn nothing), and ``drawdown`` from its running high."""
    w = Window.partitionBy(by).orderBy("d")
    out = df.withColumn("equity", k.running_product(1 + F.coalesce(F.col(ret), F.lit(0.0)), w))
    return out.withColumn("drawdown", F.try_divide(F.col("equity"), k.running_max(F.col("equity"), w)) - 1)


def sharpe(x: Column, days: int = TRADING_DAYS) -> Column:
    """Aggregate: mean over deviation, a year of it."""
    return k.div(F.avg(x), k.spread(F.stddev_samp(x))) * math.sqrt(days)


def win_rate(x: Column) -> Column:
    """Aggregate: share of returns above zero among those that are there."""
    return F.try_divide(F.count(F.when(x > 0, 1)).cast("double"), F.count(x).cast("double"))


def rolling_sharpe(x: Column, n: int = 63, least: int = 20, days: int = TRADING_DAYS, w=None) -> Column:
    mean, sd = k.roll(x, n, F.avg, least, w), k.roll(x, n, F.stddev_samp, least, w)
    return k.div(mean, k.spread(sd)) * math.sqrt(days)


def summary(df: DataFrame, ret: str) -> DataFrame:
    """(asset, sharpe, max_drawdown, win_rate, total_return, n) per asset."""
    curve = equity(df, ret)
    return curve.groupBy("asset").agg(
        sharpe(F.col(ret)).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), win_rate(F.col(ret)).alias("win_rate"),
        (F.max_by("equity", "d") - 1).alias("total_return"), F.count(ret).alias("n"),
    )


def descriptives(panel: DataFrame) -> DataFrame:
    """Per asset: annual return and volatility, Sharpe ratio, maximal drawdown and total return of close, mean volume, skew and kurtosis."""
    w = k.series()
    p = panel.withColumn("lr", k.log_change(F.col("close")))
    p = p.withColumn("dd", F.try_divide(F.col("close"), k.running_max(F.col("close"), w)) - 1)
    n, g1, g2 = F.count("lr").cast("double"), F.skewness("lr"), F.kurtosis("lr")
    have = F.col("close").isNotNull()
    return p.groupBy("asset").agg(
        (F.avg("lr") * CALENDAR_DAYS).alias("ann_return"), (F.stddev_samp("lr") * math.sqrt(CALENDAR_DAYS)).alias("ann_vol"), sharpe(F.col("lr"), CALENDAR_DAYS).alias("sharpe"),
        F.min("dd").alias("max_drawdown"),
        (F.try_divide(F.max_by("close", F.when(have, F.col("d"))), F.min_by("close", F.when(have, F.col("d")))) - 1).alias("total_return"),
        F.avg("volume").alias("avg_volume"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, F.try_divide((n - 1), (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
    )
