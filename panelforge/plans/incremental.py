"""What is to be computed, and which rows that needs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import FeatureSpec, compute, to_long


def days(spark: SparkSession, d0: str, d1: str) -> DataFrame:
    """(day) from d0 to d1, both included; none if d1 is earlier."""
    both = spark.createDataFrame([(d0, d1)], "a string, b string").filter("a <= b")
    return both.select(F.explode(F.sequence(F.col("a").cast("date"), F.col("b").cast("date"))).alias("day"))


def plan(spark: SparkSession, assets: list[str], d0: str, d1: str, features: list[FeatureSpec] | None = None) -> DataFrame:
    """Every asset and day, and every feature if given: (feature_id, version, asset, day)."""
    cells = days(spark, d0, d1).withColumn("asset", F.explode(F.array(*map(F.lit, assets))))
    if features is None:
        return cells.select("asset", "day")
    ids = F.explode(F.array(*[F.struct(F.lit(s.id).alias("feature_id"), F.lit(s.version).alias("version")) for s in features])).alias("f")
    return cells.select("asset", "day", ids).select("f.feature_id", "f.version", "asset", "day")


def missing(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def coverage(planned: DataFrame, done: DataFrame, keys: list[str], examples: int = 20) -> tuple[int, int, list]:
    """How many cells are planned and missing, and the first few missing ones."""
    gaps = missing(planned, done, keys)
    return planned.count(), gaps.count(), [tuple(r) for r in gaps.orderBy(*keys).limit(examples).collect()]


def spans(done: DataFrame) -> DataFrame:
    """(asset, day): every day of the table, from its first to its last, for every asset of (asset, day)."""
    first, last = done.agg(F.min("day"), F.max("day")).first()
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return done.select("asset").distinct().select("asset", F.explode(days).alias("day"))


def gate(planned: DataFrame, done: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, planned, missing, complete): how many cells of each ``by`` are planned and missing, and whether none is."""
    have = done.select(*keys).distinct().withColumn("_have", F.lit(1))
    both = planned.join(have, keys, "left").groupBy(by)
    return both.agg(F.count("*").alias("planned"), F.count(F.when(F.col("_have").isNull(), 1)).alias("missing")).withColumn("complete", F.col("missing") == 0)


def extra_days(params: dict) -> int:
    """Days of history by parameter name: window_d, lookback_d, window ("7d", "24h"), window_min, in this order."""
    for name in ("window_d", "lookback_d"):
        if name in params:
            return int(params[name])
    if (m := re.fullmatch(r"(\d+)([dh])", str(params.get("window", "")))) is not None:
        return int(m[1]) if m[2] == "d" else 1
    if "window_min" in params:
        return max(1, int(params["window_min"]) // 1440)
    return 0


def with_warmup(panel: DataFrame, d0: str, d1: str, rows: int) -> DataFrame:
    """The rows of the days d0 to d1 and, of each asset, the ``rows`` rows before them.

    Features count rows, so days that are missing make no difference. The date
    where each asset's history starts is found from its keys alone.
    """
    lo, hi = F.lit(d0).cast("date"), F.lit(d1).cast("date")
    if not rows:
        return panel.filter((F.col("d") >= lo) & (F.col("d") <= hi))
    back = F.row_number().over(Window.partitionBy("asset").orderBy(F.col("d").desc()))
    start = panel.filter(F.col("d") < lo).select("asset", "d").withColumn("_k", back).filter(F.col("_k") <= rows).groupBy(F.col("asset").alias("_a")).agg(F.min("d").alias("_from"))
    part = panel.filter(F.col("d") <= hi).join(start, F.col("asset").eqNullSafe(F.col("_a")), "left")
    return part.filter(F.col("d") >= F.coalesce("_from", lo)).drop("_a", "_from")


def compute_range(panel: DataFrame, wanted: list[FeatureSpec], d0: str, d1: str) -> DataFrame:
    """(ts, feature_id, version, asset, value) of the days d0 to d1, reading the rows before them that the features need.

    A time filter can't pass below a window, so the rows are widened by the
    greatest warm-up of ``wanted`` and trimmed after. Null values are dropped.
    """
    part = with_warmup(panel, d0, d1, max((s.warmup_rows for s in wanted), default=0))
    long = to_long(compute(part, wanted), [s.id for s in wanted]).filter(F.col("d") >= F.lit(d0).cast("date"))
    version = F.create_map(*[x for s in wanted for x in (F.lit(s.id), F.lit(s.version))])
    return long.select(F.unix_micros(F.col("d").cast("timestamp")).alias("ts"), "feature_id", version[F.col("feature_id")].alias("version"), "asset", "value")
