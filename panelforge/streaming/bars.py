"""Bars from a stream of ticks (an extension; the batch operators do not need it).

Event-time windows with a watermark: ticks later than ``late`` are dropped by
the engine, every window is emitted once, when it can no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(asset, start, open, high, low, close, volume, n_trades) of a streaming or batch table (ts, asset, price, amount).

    Ticks without a price are no trades; a null amount adds nothing. Ties in ts
    are broken by price.
    """
    order = F.struct("ts", "price")
    out = (
        ticks.filter(F.col("price").isNotNull() & ~F.isnan("price"))
        .withWatermark("ts", late)
        .groupBy("asset", F.window("ts", width).alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("amount").alias("volume"), F.count("*").alias("n_trades"))
    )
    return out.select("asset", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "n_trades")
