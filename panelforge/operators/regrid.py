"""Irregular readings onto a regular daily grid.

Shape-preserving monotone cubic interpolation per segment of a series; a
segment ends where readings are more than ``max_gap`` days apart, and the days
of such a gap are marked, not filled. Series are cut into time shards, so a long
or hot series spreads over tasks; each shard gets the neighbouring shards' edge
readings as a halo, which is all the cubic of its intervals depends on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_DAYS = 256
MAX_GAP = 14
_KEYS = ["exchange", "symbol"]


def _slopes(d: Column, h: Column) -> Column:
    """Secant slope; null outside the segment."""
    return F.when(h.isNotNull(), d / h)


def _inner(h0: Column, s0: Column, h1: Column, s1: Column) -> Column:
    """Slope at a knot inside a segment: the weighted harmonic mean of the secants, zero at an extremum."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(F.signum(s0) * F.signum(s1) <= 0, 0.0).otherwise(F.try_divide(w0 + w1, F.try_divide(w0, s0) + F.try_divide(w1, s1)))


def _end(h0: Column, s0: Column, h1: Column, s1: Column) -> Column:
    """One-sided slope at a segment's end, kept monotone; the secant itself if there is but one interval."""
    three = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
    return (
        F.when(s1.isNull(), s0)
        .when(F.signum(three) != F.signum(s0), 0.0)
        .when((F.signum(s0) != F.signum(s1)) & (F.abs(three) > 3 * F.abs(s0)), 3 * s0)
        .otherwise(three)
    )


def _with_halo(readings: DataFrame, value: str) -> DataFrame:
    """Every reading in its own shard and, where it is an edge the next shard over depends on, there too.

    A shard needs one reading before it and two after it. Edges are at most
    three readings a shard, so the exchange between shards is small: per series
    it holds one row a shard, not one a reading.
    """
    r = readings.withColumn("shard", F.floor(F.col("x") / SHARD_DAYS).cast("int"))
    in_shard = Window.partitionBy(*_KEYS, "shard").orderBy("x")
    point = F.struct("x", value)
    edges = (
        r.select(*_KEYS, "shard", point.alias("p"), F.row_number().over(in_shard).alias("i"), F.lead("x").over(in_shard).isNull().alias("last"))
        .filter((F.col("i") <= 2) | F.col("last"))
        .groupBy(*_KEYS, "shard")
        .agg(F.min(F.when(F.col("i") == 1, F.col("p"))).alias("first"), F.min(F.when(F.col("i") == 2, F.col("p"))).alias("second"), F.max(F.when(F.col("last"), F.col("p"))).alias("last"))
    )
    w = Window.partitionBy(*_KEYS).orderBy("shard")
    nxt = F.coalesce(F.lead("second").over(w), F.lead("first", 2).over(w))
    near = edges.select(*_KEYS, "shard", F.array_compact(F.array(F.lag("last").over(w), F.lead("first").over(w), nxt)).alias("near"))
    halo = near.select(*_KEYS, "shard", F.explode("near").alias("p"))
    halo = halo.select(*_KEYS, "shard", F.col("p.x").alias("x"), F.col(f"p.{value}").alias(value), F.lit(True).alias("halo"))
    return r.withColumn("halo", F.lit(False)).select(halo.columns).unionByName(halo)


def regrid(readings: DataFrame, value: str, max_gap: int = MAX_GAP) -> DataFrame:
    """One row per series and calendar day from its first to its last reading.

    :param readings: (exchange, symbol, day, ``value``), at most one row per
        series and day; rows whose value is null are no readings.
    :param max_gap: the longest stretch between two readings, in days, that is
        interpolated.
    :return: (exchange, symbol, day, ``value``, status), status ``observed``,
        ``filled`` or ``gap`` (a missing day of a long outage, value null).

    Null exchanges and symbols form series of their own. A series with a single
    reading gives that one row, an empty table none. Further columns, whatever
    their names, are not carried.
    """
    r = readings.filter(F.col(value).isNotNull()).select(*_KEYS, F.unix_date("day").alias("x"), F.col(value).alias("_y"))
    w = Window.partitionBy(*_KEYS, "shard").orderBy("x")
    at = lambda c, k: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)
    k = _with_halo(r, "_y").select(
        *_KEYS, "x", "_y", "halo",
        *[(F.lag(c, 1).over(w)).alias(f"{c}_p") for c in ("x", "_y")],
        *[at(c, i).alias(f"{c}_{i}") for c in ("x", "_y") for i in (1, 2)],
    ).filter(~F.col("halo"))
    step = lambda a, b: F.when((F.col(b) - F.col(a)) <= max_gap, (F.col(b) - F.col(a)).cast("double"))
    k = k.withColumns({"hp": step("x_p", "x"), "h0": step("x", "x_1"), "h1": step("x_1", "x_2")})
    k = k.withColumns({"sp": _slopes(F.col("_y") - F.col("_y_p"), F.col("hp")), "s0": _slopes(F.col("_y_1") - F.col("_y"), F.col("h0")), "s1": _slopes(F.col("_y_2") - F.col("_y_1"), F.col("h1"))})
    c = F.col
    left = F.when(c("sp").isNull(), _end(c("h0"), c("s0"), c("h1"), c("s1"))).otherwise(_inner(c("hp"), c("sp"), c("h0"), c("s0")))
    right = F.when(c("s1").isNull(), _end(c("h0"), c("s0"), c("hp"), c("sp"))).otherwise(_inner(c("h0"), c("s0"), c("h1"), c("s1")))
    k = k.select(*_KEYS, "x", "_y", "x_1", "_y_1", "h0", left.alias("dl"), right.alias("dr"))
    days = F.explode(F.sequence(c("x"), F.greatest(c("x"), F.coalesce(c("x_1"), c("x")) - F.when(c("x_1").isNull(), 0).otherwise(1))))
    g = k.withColumn("day_no", days)
    t = (c("day_no") - c("x")) / c("h0")
    y = (
        c("_y") * (1 + 2 * t) * (1 - t) * (1 - t)
        + c("h0") * c("dl") * t * (1 - t) * (1 - t)
        + c("_y_1") * t * t * (3 - 2 * t)
        - c("h0") * c("dr") * t * t * (1 - t)
    )
    seen = c("day_no") == c("x")
    return g.select(
        *_KEYS, F.date_from_unix_date("day_no").alias("day"),
        F.when(seen, c("_y")).otherwise(y).alias(value),
        F.when(seen, "observed").when(c("h0").isNull(), "gap").otherwise("filled").alias("status"),
    )
