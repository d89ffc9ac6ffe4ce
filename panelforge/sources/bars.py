"""Bar sources: dirty stored bars to typed, deduplicated panels.

Times are stored as microseconds, but some feeds deliver milliseconds or
seconds; the unit is told by magnitude. null and NaN both mean missing and come
out as null. A bar belongs to the UTC day of its open time plus ten seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
CLOCK_SLACK_US = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Epoch microseconds from an epoch number in seconds, milliseconds or microseconds."""
    size = F.abs(ts)
    return F.when(size < F.lit(100_000_000_000), ts * F.lit(1_000_000)).when(size < F.lit(100_000_000_000_000), ts * F.lit(1_000)).otherwise(ts)


def bar_day(ts: Column) -> Column:
    """The UTC date a bar belongs to."""
    return F.date_from_unix_date(F.floor((micros(ts) + F.lit(CLOCK_SLACK_US)) / F.lit(MICROS_PER_DAY)).cast("int"))


def clean(x: Column) -> Column:
    """NaN to null."""
    return F.when(~F.isnan(x), x)


def symbol_key(s: Column) -> Column:
    return F.upper(F.trim(s))


def asset_key(exchange: Column, symbol: Column) -> Column:
    """exchange:symbol; a missing part is empty, so it keeps its side."""
    return F.concat(F.coalesce(exchange, F.lit("")), F.lit(":"), F.coalesce(symbol, F.lit("")))


def keyed(bars: DataFrame, *keep: str, undated: bool = False) -> DataFrame:
    """(exchange, symbol, day) and the columns ``keep``, doubles with NaN as null; rows without a time have no day and fall out unless ``undated``."""
    doubles = {f.name for f in bars.schema if f.dataType.typeName() == "double"}
    out = bars.select(
        "exchange",
        symbol_key(F.col("symbol")).alias("symbol"),
        bar_day(F.col("ts_open")).alias("day"),
        *[(clean(F.col(c)) if c in doubles else F.col(c)).alias(c) for c in keep],
    )
    return out if undated else out.filter(F.col("day").isNotNull())


def latest_per_day(bars: DataFrame, *values: str) -> DataFrame:
    """One row per series and day: that of the greatest load_id, then bar_id (the last revision).

    The aggregate combines map-side, so a day with very many copies never
    gathers in one task. Null load or bar ids rank lowest.
    """
    rank = F.struct(F.coalesce("load_id", F.lit(-(2**31))).alias("l"), F.coalesce("bar_id", F.lit(-(2**63) + 1)).alias("b"))
    rows = keyed(bars, "load_id", "bar_id", *values)
    best = rows.groupBy("exchange", "symbol", "day").agg(F.max_by(F.struct(*values), rank).alias("v"))
    return best.select("exchange", "symbol", "day", *[F.col(f"v.{v}").alias(v) for v in values])


def first_per_day(bars: DataFrame, *values: str) -> DataFrame:
    """One row per series and day: the earliest ts_open, ties broken by bar_id (the notebook reader's rule, made deterministic)."""
    rank = F.struct(micros(F.col("ts_open")).alias("t"), F.col("bar_id").alias("b"))
    doubles = {f.name for f in bars.schema if f.dataType.typeName() == "double"}
    rows = bars.select(
        "exchange", symbol_key(F.col("symbol")).alias("symbol"), bar_day(F.col("ts_open")).alias("day"), rank.alias("rank"),
        *[(clean(F.col(v)) if v in doubles else F.col(v)).alias(v) for v in values],
    ).filter(F.col("day").isNotNull())
    best = rows.groupBy("exchange", "symbol", "day").agg(F.min_by(F.struct(*values), "rank").alias("v"))
    return best.select("exchange", "symbol", "day", *[F.col(f"v.{v}").alias(v) for v in values])


def daily_panel(spark: SparkSession, sf_dir: str, exchange: str | None = None) -> DataFrame:
    """The research panel: asset, d, open … taker_buy_vol, one row per asset and day (last revision).

    ``asset`` is ``exchange:symbol`` so equal symbols of different exchanges
    never collide; ``exchange`` prunes to one venue at the scan.
    """
    values = ["open", "high", "low", "close", "volume", "quote_vol", "n_trades", "taker_buy_vol"]
    bars = table(spark, sf_dir, "ohlcv_1d")
    if exchange is not None:
        bars = bars.filter(F.col("exchange") == exchange)
    return latest_per_day(bars, *values).select(asset_key(F.col("exchange"), F.col("symbol")).alias("asset"), F.col("day").alias("d"), *values)
