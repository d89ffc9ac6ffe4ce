"""Cross-sectional operators: what happens between the assets of one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as k


def _date(by: tuple[str, ...] = ("d",)):
    return Window.partitionBy(*by)


def cs_zscore(x: Column, by: tuple[str, ...] = ("d",)) -> Column:
    """Standard score among the assets of a date; null where they do not differ."""
    w = _date(by)
    return k.div(x - F.avg(x).over(w), k.spread(F.stddev_samp(x).over(w)))


def demean(x: Column, by: tuple[str, ...] = ("d",)) -> Column:
    return x - F.avg(x).over(_date(by))


def gross_weights(x: Column, by: tuple[str, ...] = ("d",)) -> Column:
    """Weights whose absolute values sum to one on each date."""
    return k.div(x, F.nullif(F.sum(F.abs(x)).over(_date(by)), F.lit(0.0)))


def portfolio_return(df: DataFrame, weight: str, forward: str) -> DataFrame:
    """(d, ret): sum of weight times forward return; a date on which nothing is known earns 0."""
    return df.groupBy("d").agg(F.coalesce(F.sum(F.col(weight) * F.col(forward)), F.lit(0.0)).alias("ret"))


def equal_weight(df: DataFrame, x: str) -> DataFrame:
    """(d, value): plain mean over the assets."""
    return df.groupBy("d").agg(F.avg(x).alias("value"))


def neutrality(df: DataFrame, weight: str) -> DataFrame:
    """(mean_net, mean_gross): averages over dates of the weights' sum and absolute sum."""
    daily = df.groupBy("d").agg(F.sum(weight).alias("net"), F.sum(F.abs(weight)).alias("gross"))
    return daily.agg(F.avg("net").alias("mean_net"), F.avg("gross").alias("mean_gross"))


def forward_columns(panel: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """The panel with ``fwd_{h}``: sum of the log returns of the next h rows.

    Row t + h must exist; missing returns in between are skipped, all missing
    sum to 0. To be taken from the whole price panel, before any filter.
    """
    w = k.series()
    lr = panel.withColumn("_flr", k.log_change(F.col("close")))
    total = lambda h: F.coalesce(F.sum("_flr").over(w.rowsBetween(1, h)), F.lit(0.0))
    return lr.withColumns({f"fwd_{h}": F.when(F.lead(F.lit(1), h).over(w) == 1, total(h)) for h in horizons}).drop("_flr")


def forward_returns(panel: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(asset, d, h, fwd): ``forward_columns`` in rows, without those that have no row t + h."""
    cells = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"fwd_{h}").alias("fwd")) for h in horizons])
    return forward_columns(panel, horizons).select("asset", "d", F.inline(cells)).filter(F.col("fwd").isNotNull())
