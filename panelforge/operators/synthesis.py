"""From coefficients to conclusions: ranking, collinearity, composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import placed, rank_sums

MIN_PAIRS, COLLINEAR, GOOD_ICIR, EXPLOITABLE = 30, 0.70, 0.05, 0.10


def rank_features(summary: DataFrame, regime: DataFrame, horizon: int) -> DataFrame:
    """(feature_id, ic_mean, icir, best_regime, exploitable, position) at one horizon, the largest \\|icir\\| first.

    The best regime is that of the largest \\|mean ic\\|, ties by name; features
    without an icir come last, ties by id.
    """
    s = summary.filter(F.col("h") == horizon)
    size = F.struct(F.abs("mean_ic"), F.col("regime"))
    best = regime.filter((F.col("h") == horizon) & F.col("mean_ic").isNotNull()).groupBy("feature_id").agg(F.max_by("regime", size).alias("best_regime"))
    strength = F.coalesce(F.abs("icir"), F.lit(0.0))
    order = Window.orderBy(strength.desc(), "feature_id")  # one row a feature
    return s.join(best, "feature_id", "left").select(
        "feature_id", F.round("ic_mean", 4).alias("ic_mean"), F.round("icir", 3).alias("icir"), "best_regime",
        F.coalesce(F.abs("icir") >= EXPLOITABLE, F.lit(False)).alias("exploitable"), F.row_number().over(order).alias("position"),
    )


def correlations_placed(table: DataFrame, ids: list[str]) -> DataFrame:
    """``correlations_wide`` of a table that is ``placed`` already."""
    ids = sorted(ids)
    if len(ids) > 63:
        raise ValueError("more than 63 features; study them in parts")
    names = F.array(*map(F.lit, ids))
    out = rank_sums(table, ids).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "ij", "ii", "jj")])
    rho = F.when((F.col("ii") > 0) & (F.col("jj") > 0), F.col("ij") / F.sqrt(F.col("ii")) / F.sqrt(F.col("jj")))
    return out.select(F.get(names, F.col("i")).alias("f1"), F.get(names, F.col("j")).alias("f2"), "n", rho.alias("rho"))


def correlations_wide(wide: DataFrame, ids: list[str]) -> DataFrame:
    """(f1, f2, n, rho): pooled Spearman correlation of each two features over all (asset, d) both have.

    Ranks are taken per pair, among the rows that have both features, and are
    exact (see ``pairs``); no feature gathers in a task. The features are
    computed once and written.
    """
    return correlations_placed(placed(wide.select(*ids)), ids)


def correlations(values: DataFrame) -> DataFrame:
    """``correlations_wide`` of (asset, d, feature_id, value); a row a feature comes to the driver."""
    ids = sorted(r[0] for r in values.select("feature_id").distinct().collect())
    wide = values.groupBy("asset", "d").agg(*[F.max(F.when(F.col("feature_id") == f, F.col("value"))).alias(f) for f in ids])
    return correlations_wide(wide, ids)


def collinear(corr: DataFrame, at: float = COLLINEAR) -> DataFrame:
    """(f1, f2, rho, flagged) of the pairs with at least MIN_PAIRS observations."""
    return corr.filter((F.col("n") >= MIN_PAIRS) & F.col("rho").isNotNull()).select("f1", "f2", F.round("rho", 3).alias("rho"), (F.abs("rho") >= at).alias("flagged"))


def composites(summary: DataFrame, pairs: DataFrame, horizon: int) -> DataFrame:
    """(feature_id, equal_weight, icir_weight): features with \\|icir\\| >= GOOD_ICIR, without the weaker of each collinear pair (the second at a tie).

    Fewer than two features left give no composite, so no rows.
    """
    s = summary.filter(F.col("h") == horizon).select("feature_id", F.coalesce(F.abs("icir"), F.lit(0.0)).alias("strength"))
    flagged = pairs.filter("flagged").join(s.select(F.col("feature_id").alias("f1"), F.col("strength").alias("s1")), "f1", "left")
    flagged = flagged.join(s.select(F.col("feature_id").alias("f2"), F.col("strength").alias("s2")), "f2", "left")
    weaker = flagged.select(F.when(F.coalesce("s1", F.lit(0.0)) >= F.coalesce("s2", F.lit(0.0)), F.col("f2")).otherwise(F.col("f1")).alias("feature_id")).distinct()
    left = s.filter(F.col("strength") >= GOOD_ICIR).join(weaker, "feature_id", "left_anti")
    every = Window.partitionBy(F.lit(1))  # one row a feature
    out = left.withColumns({"_n": F.count("*").over(every), "_s": F.sum("strength").over(every)}).filter(F.col("_n") >= 2)
    return out.select("feature_id", F.round(1 / F.col("_n"), 3).alias("equal_weight"), F.round(F.col("strength") / F.col("_s"), 3).alias("icir_weight"))


def leaderboard(summary: DataFrame, passed: DataFrame) -> DataFrame:
    """(feature_id, best_h, ic_mean, icir, qa_passed): each feature at the horizon of its largest \\|ic\\| (the smaller one at a tie)."""
    size = F.struct(F.abs("ic_mean").alias("a"), (-F.col("h")).alias("b"))
    best = summary.filter(F.col("ic_mean").isNotNull()).groupBy("feature_id").agg(F.max_by(F.struct("h", "ic_mean", "icir"), size).alias("v"))
    qa = passed.groupBy("feature_id").agg(F.min("passed").alias("qa_passed"))
    return best.join(qa, "feature_id", "left").select("feature_id", F.col("v.h").alias("best_h"), F.round("v.ic_mean", 4).alias("ic_mean"), F.round("v.icir", 3).alias("icir"), "qa_passed")
