"""Queries of the research engine over ohlcv_1d, derivative_ticker, book_snapshot_25 and features, and their SQL.

The panel is the last revision of each bar; an asset is ``exchange:symbol``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.features import DEFAULT_COMPOSITE_WINDOWS, PRICE_FEATURES, REGISTRY, FeatureSpec, compute, ewm_composite, specs, to_long
from ..operators import ic, panel, portfolio, qa, ridge, synthesis
from ..plans import incremental, pipeline
from ..sources import store
from ..sources.bars import bar_day, clean, daily_panel, first_per_day, micros, symbol_key, table

Query = Callable[[SparkSession, str], DataFrame]

HORIZONS = (1, 3, 5, 7)
#: Features whose coefficients are studied, and those of the smaller ridge model (all thirteen are hardly ever there in one row).
STUDIED = list(PRICE_FEATURES)
MODEL = ["mom_20d", "rv_30d", "reversal_5d", "taker_ratio_20d", "trades_zscore_20d"]


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("d", F.date_format("d", "yyyy-MM-dd"))


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _reference(bars: DataFrame) -> str | None:
    """The first asset by name is the reference of regimes and checks."""
    return bars.agg(F.min("asset")).first()[0]


# --- bars -------------------------------------------------------------------


def bars_daily(spark: SparkSession, d: str) -> DataFrame:
    return _day(daily_panel(spark, d))


def bars_dedupe(spark: SparkSession, d: str) -> DataFrame:
    out = first_per_day(table(spark, d, "ohlcv_1d"), "close", "volume")
    return _day(out.withColumnRenamed("day", "d"))


def bars_log_return(spark: SparkSession, d: str) -> DataFrame:
    bars = daily_panel(spark, d)
    return _rounded(_day(bars.select("asset", "d", k.log_change(F.col("close")).alias("log_ret"), k.change(F.col("close")).alias("ret"))), "log_ret", "ret")


def bars_hourly_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    key = F.struct("ts", "event_id")
    hour = F.date_format(F.date_trunc("HOUR", "ts"), "yyyy-MM-dd HH:mm:ss")
    out = e.groupBy(F.col("event_type").alias("asset"), hour.alias("hour")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.sum("value").alias("volume"), F.count("*").alias("n_trades")
    )
    return _rounded(out, "volume", digits=4)


def bars_klines(spark: SparkSession, d: str) -> DataFrame:
    """Bars rendered as positional string arrays and parsed back."""
    b = table(spark, d, "ohlcv_1d")
    ms = lambda c: F.floor(micros(F.col(c)) / 1000).cast("bigint").cast("string")
    cells = [ms("ts_open"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")], ms("ts_close"), F.col("quote_vol").cast("string"), F.col("n_trades").cast("string"), F.col("taker_buy_vol").cast("string")]
    lines = b.filter(F.col("ts_open").isNotNull() & F.col("ts_close").isNotNull()).select("exchange", "symbol", F.array(*cells).alias("kline"))
    parsed = store.from_klines(lines)
    return parsed.groupBy("exchange", symbol_key(F.col("symbol")).alias("symbol")).agg(
        F.count("*").alias("n"), F.sum("n_trades").alias("n_trades"), F.min("ts_open").alias("ts_open"), F.max(clean(F.col("close"))).alias("close")
    )


# --- features ---------------------------------------------------------------


def _funding_panel(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "derivative_ticker")
    rank = F.struct("received_at", "ts", F.col("funding_rate").alias("f"))
    t = t.select(F.concat_ws(":", "exchange", symbol_key(F.col("symbol"))).alias("asset"), bar_day(F.col("ts")).alias("d"), clean(F.col("funding_rate")).alias("funding_rate"), "received_at", "ts")
    return t.filter(F.col("d").isNotNull()).groupBy("asset", "d").agg(F.max_by("funding_rate", rank).alias("funding_rate"))


def _feature(name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        spec = REGISTRY[name]
        if spec.source == "book_snapshot_25":
            b = table(spark, d, "book_snapshot_25")
            b = b.select(F.concat_ws(":", "exchange", symbol_key(F.col("symbol"))).alias("asset"), F.col("ts").alias("d"), *[clean(F.col(c)).alias(c) for c in spec.requires])
            out = compute(b, [spec]).withColumnRenamed("d", "ts")
        else:
            bars = _funding_panel(spark, d) if spec.source == "derivative_ticker" else daily_panel(spark, d)
            out = _day(compute(bars, [spec]))
        return _rounded(out.withColumnRenamed(name, "value"), "value")

    query.__name__ = f"feat_{name}"
    query.__doc__ = f"The feature {name} of every row."
    return query


def feat_composite_ewm(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_day(ewm_composite(daily_panel(spark, d), DEFAULT_COMPOSITE_WINDOWS)), "value")


def feat_long_store(spark: SparkSession, d: str) -> DataFrame:
    """All price features side by side, in the long layout of the store, as counts and means."""
    long = to_long(compute(daily_panel(spark, d), specs()), PRICE_FEATURES)
    return _rounded(long.groupBy("feature_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.countDistinct("asset").alias("assets")), "mean", digits=4)


def feat_range(spark: SparkSession, d: str) -> DataFrame:
    """Features of one quarter, read with the rows their warm-up needs."""
    out = incremental.compute_range(daily_panel(spark, d), specs(["ret_1d", "mom_20d", "reversal_5d"]), "2024-04-01", "2024-06-30")
    return _rounded(out, "value")


# --- cross-section ----------------------------------------------------------


def _mom(spark: SparkSession, d: str) -> DataFrame:
    return compute(daily_panel(spark, d), specs(["mom_20d"])).withColumnRenamed("mom_20d", "s").filter(F.col("s").isNotNull())


def cs_zscore(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_day(_mom(spark, d).select("asset", "d", panel.cs_zscore(F.col("s")).alias("z"))), "z")


def cs_demean_weights(spark: SparkSession, d: str) -> DataFrame:
    x = _mom(spark, d).withColumn("m", panel.demean(F.col("s")))
    return _rounded(_day(x.select("asset", "d", "m", panel.gross_weights(F.col("m")).alias("w"))), "m", "w")


def gross_weights(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_day(_mom(spark, d).select("asset", "d", panel.gross_weights(F.col("s")).alias("w"))), "w")


def fwd_ret(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_day(panel.forward_returns(daily_panel(spark, d), HORIZONS)), "fwd")


def dollar_neutral(spark: SparkSession, d: str) -> DataFrame:
    x = _mom(spark, d).withColumn("m", panel.demean(F.col("s"))).withColumn("w", panel.gross_weights(F.col("m")))
    return _rounded(panel.neutrality(x, "w"), "mean_net", "mean_gross")


# --- coefficients -----------------------------------------------------------


def _ic(spark: SparkSession, d: str, kind: str = "raw") -> DataFrame:
    return pipeline.coefficients(daily_panel(spark, d), STUDIED, kind)


def ic_daily(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_day(_ic(spark, d)), "ic")


def ic_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ic.summary(_ic(spark, d)), "ic_mean", "icir", "stderr")


def ic_rolling63(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_day(ic.rolling(_ic(spark, d))), "ic_roll", "icir_roll", digits=9)


def ic_monthly(spark: SparkSession, d: str) -> DataFrame:
    out = ic.monthly(_ic(spark, d))
    return _rounded(out.withColumn("month", F.date_format("month", "yyyy-MM")), "ic")


def ic_hist(spark: SparkSession, d: str) -> DataFrame:
    # rounded first, so that both engines put values on an edge into one bin
    return ic.histogram(_ic(spark, d).withColumn("ic", F.round("ic", 9)))


def ic_ortho(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ic.summary(_ic(spark, d, "ortho")), "ic_mean", "icir", "stderr", digits=4)


def ortho_residuals(spark: SparkSession, d: str) -> DataFrame:
    wide = compute(daily_panel(spark, d), specs(["reversal_5d", "mom_20d", "rv_30d"]))
    return _rounded(_day(ic.orthogonalize(wide, "reversal_5d", ["mom_20d", "rv_30d"])), "value")


def regime_labels(spark: SparkSession, d: str) -> DataFrame:
    bars = daily_panel(spark, d)
    return _day(ic.regimes(bars, _reference(bars)))


def ic_by_regime(spark: SparkSession, d: str) -> DataFrame:
    bars = daily_panel(spark, d)
    return ic.by_regime(_ic(spark, d), ic.regimes(bars, _reference(bars)))


def ic_raw_ortho(spark: SparkSession, d: str) -> DataFrame:
    """Both passes of a report side by side."""
    both = [ic.summary(_ic(spark, d, kind)).withColumn("kind", F.lit(kind)) for kind in ("raw", "ortho")]
    return _rounded(both[0].unionByName(both[1]).drop("stderr"), "ic_mean", "icir", digits=4)


def ic_regime_bars(spark: SparkSession, d: str) -> DataFrame:
    """Mean coefficient by regime, however few dates it has."""
    bars = daily_panel(spark, d)
    return ic.by_regime(_ic(spark, d), ic.regimes(bars, _reference(bars)), 0).select("feature_id", "h", "regime", "mean_ic", "n")


def ic_pooled(spark: SparkSession, d: str) -> DataFrame:
    """One coefficient over all assets and dates, of each horizon, for momentum."""
    wide = pipeline.signals_wide(daily_panel(spark, d), ["mom_20d"], "raw", HORIZONS)
    cells = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"fwd_{h}").alias("fwd")) for h in HORIZONS])
    out = ic.pooled(wide.select("asset", "d", "mom_20d", F.inline(cells)), ["h"], "mom_20d", "fwd")
    return _rounded(out.withColumn("h", F.col("h").cast("int")), "ic")


# --- synthesis --------------------------------------------------------------


def _corr(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.correlations_wide(pipeline.signals_wide(daily_panel(spark, d), STUDIED), STUDIED)


def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_corr(spark, d), "rho")


def collinearity(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.collinear(_corr(spark, d))


def rank_features(spark: SparkSession, d: str) -> DataFrame:
    bars = daily_panel(spark, d)
    coefficients = _ic(spark, d)
    return synthesis.rank_features(ic.summary(coefficients), ic.by_regime(coefficients, ic.regimes(bars, _reference(bars))), 1)


def composite_weights(spark: SparkSession, d: str) -> DataFrame:
    table, coefficients = pipeline.studied(daily_panel(spark, d), STUDIED)
    return synthesis.composites(ic.summary(coefficients), synthesis.collinear(synthesis.correlations_placed(table, STUDIED)), 5)


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    bars = daily_panel(spark, d)
    values = to_long(compute(bars, specs(STUDIED)), STUDIED, drop_null=False)
    return synthesis.leaderboard(ic.summary(_ic(spark, d)), qa.explosion(values))


# --- quality ----------------------------------------------------------------


def _values(spark: SparkSession, d: str, reference: bool, features: list[str] = STUDIED) -> DataFrame:
    bars = daily_panel(spark, d)
    values = to_long(compute(bars, specs(features)), features, drop_null=False)
    return values.filter(F.col("asset") == _reference(bars)) if reference else values


def qa_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(qa.distribution(_values(spark, d, True)), "mean", "std", "min", "max", "ac1", "outlier_share")


def qa_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(qa.coverage(_values(spark, d, False), {f: qa.qa_warmup(REGISTRY[f]) for f in STUDIED}), "missing_share")


def qa_explosion(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(qa.explosion(_values(spark, d, False)), "ratio", digits=4)


def qa_lookahead(spark: SparkSession, d: str) -> DataFrame:
    bars = daily_panel(spark, d)
    return qa.lookahead(bars, specs(STUDIED), qa.spots(bars))


#: A feature that looks at the next row, to see the check find it.
PEEKING = FeatureSpec("peek", "returns", ("close",), lambda p: F.lead("close").over(k.series()), warmup=lambda p: 1)


def qa_lookahead_planted(spark: SparkSession, d: str) -> DataFrame:
    """What the check says of a feature that does look ahead."""
    bars = daily_panel(spark, d)
    return qa.lookahead(bars, [PEEKING, REGISTRY["ret_1d"]], qa.spots(bars))


def qa_adf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(qa.stationarity(_values(spark, d, False, list(PRICE_FEATURES))), "adf", "p")


# --- portfolios -------------------------------------------------------------


def _traded(spark: SparkSession, d: str, direction: int = 1) -> DataFrame:
    p = portfolio.returns(daily_panel(spark, d)).withColumn("z", k.zscore(F.col("r"), 30))
    return p.withColumn("pos", portfolio.binary_signal(F.col("z"), direction)).withColumn("strat", F.col("pos") * F.col("fwd"))


def ls_binary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_day(_traded(spark, d).select("asset", "d", "pos", "strat")), "strat")


def ls_binary_inverted(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_day(_traded(spark, d, -1).select("asset", "d", "pos", "strat")), "strat")


def _book(spark: SparkSession, d: str, centred: bool) -> DataFrame:
    x = portfolio.returns(daily_panel(spark, d)).withColumn("s", k.zscore(F.col("r"), 30))
    x = x.withColumn("s", panel.demean(F.col("s"))) if centred else x
    return panel.portfolio_return(x.withColumn("w", panel.gross_weights(F.col("s"))), "w", "fwd").withColumn("asset", F.lit("portfolio"))


def portfolio_prop(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_day(_book(spark, d, False).select("d", "ret")), "ret")


def portfolio_demeaned(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_day(_book(spark, d, True).select("d", "ret")), "ret")


def portfolio_mean_binary(spark: SparkSession, d: str) -> DataFrame:
    """Equal weights of the assets' binary strategies, and of holding them all."""
    t = _traded(spark, d)
    both = panel.equal_weight(t, "strat").withColumnRenamed("value", "ret").join(panel.equal_weight(t, "fwd").withColumnRenamed("value", "hold"), "d")
    return _rounded(_day(both), "ret", "hold")


def equity_curve(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_day(portfolio.equity(_book(spark, d, True), "ret").select("d", "equity")), "equity")


def drawdown(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_day(portfolio.equity(_book(spark, d, True), "ret").select("d", "drawdown")), "drawdown")


def portfolio_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(portfolio.summary(_book(spark, d, True), "ret"), "sharpe", "max_drawdown", "win_rate", "total_return")


def sharpe_summary(spark: SparkSession, d: str) -> DataFrame:
    out = _traded(spark, d).groupBy("asset").agg(portfolio.sharpe(F.col("strat")).alias("sharpe"), portfolio.win_rate(F.col("strat")).alias("win_rate"), F.count("strat").alias("n"))
    return _rounded(out, "sharpe", "win_rate")


def rolling_sharpe(spark: SparkSession, d: str) -> DataFrame:
    out = _traded(spark, d).select("asset", "d", portfolio.rolling_sharpe(F.col("strat")).alias("sharpe"))
    return _rounded(_day(out), "sharpe", digits=5)


def sharpe_by_window(spark: SparkSession, d: str) -> DataFrame:
    p = portfolio.returns(daily_panel(spark, d))
    cells = F.array(*[F.struct(F.lit(w).alias("w"), (portfolio.binary_signal(k.zscore(F.col("r"), w)) * F.col("fwd")).alias("strat")) for w in DEFAULT_COMPOSITE_WINDOWS])
    long = p.select("asset", cells.alias("c")).select("asset", F.inline("c"))
    return _rounded(long.groupBy("asset", "w").agg(portfolio.sharpe(F.col("strat")).alias("sharpe")), "sharpe")


def descriptives(spark: SparkSession, d: str) -> DataFrame:
    out = portfolio.descriptives(daily_panel(spark, d)).drop("skew", "kurtosis")
    return _rounded(out, "ann_return", "ann_vol", "sharpe", "max_drawdown", "total_return", "avg_volume", digits=4)


def skew_kurt(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(portfolio.descriptives(daily_panel(spark, d)).select("asset", "skew", "kurtosis"), "skew", "kurtosis", digits=4)


# --- model ------------------------------------------------------------------


def _ridge(spark: SparkSession, d: str, model: list[str] = MODEL):
    bars = portfolio.returns(daily_panel(spark, d))
    data = ridge.matrix(compute(bars, specs(model), keep=("fwd",)), model, "fwd")
    span = bars.agg(F.min("d").cast("string"), F.max("d").cast("string")).first()
    return ridge.walk_forward(data, model, "fwd", ridge.expanding_folds(*span))


def ridge_oos_ic(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ridge.oos_ic(_ridge(spark, d)[0], "fwd"), "ic_mean", "icir", "positive_share")


def ridge_coefs(spark: SparkSession, d: str) -> DataFrame:
    rows = [(f.fold, f.alpha, n, c) for f in _ridge(spark, d)[1] for n, c in zip(MODEL, f.coef, strict=True)]
    return _rounded(spark.createDataFrame(rows, "fold string, alpha double, feature_id string, coef double"), "coef")


def ridge_all_ic(spark: SparkSession, d: str) -> DataFrame:
    """The model of all thirteen features; rows that have them all are few."""
    return _rounded(ridge.oos_ic(_ridge(spark, d, list(PRICE_FEATURES))[0], "fwd"), "ic_mean", "icir", "positive_share")


def ridge_pooled_ic(spark: SparkSession, d: str) -> DataFrame:
    """One out-of-sample coefficient a fold, over all its rows."""
    return _rounded(ic.pooled(_ridge(spark, d)[0], ["fold"], "prediction", "fwd"), "ic")


# --- store and plans --------------------------------------------------------


def store_load_slice(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "features")
    first = f.filter("version = 'v1'").agg(F.min(F.struct("feature_id", "asset"))).first()[0]
    return store.load_slice(f, *(first or ("", "")), "v1", "2024-01-01", "2024-12-30").select("ts", clean(F.col("value")).alias("value"))


def store_sql_agg(spark: SparkSession, d: str) -> DataFrame:
    return store.sql_over(table(spark, d, "features"), "SELECT feature_id, asset, count(*) AS n, round(avg(CASE WHEN NOT isnan(value) THEN value END), 6) AS mean FROM features WHERE version = :v GROUP BY feature_id, asset", v="v1")


def _done_days(spark: SparkSession, d: str) -> DataFrame:
    return daily_panel(spark, d).select("asset", F.col("d").alias("day"))


def plan_missing(spark: SparkSession, d: str) -> DataFrame:
    """Days of the table without a bar, of every asset."""
    done = _done_days(spark, d)
    return incremental.missing(incremental.spans(done), done, ["asset", "day"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Planned and missing days per asset, and whether the gate opens."""
    done = _done_days(spark, d)
    return incremental.gate(incremental.spans(done), done, ["asset", "day"], "asset")


_NAMED = [
    bars_daily, bars_dedupe, bars_log_return, bars_hourly_events, bars_klines, *[_feature(f) for f in REGISTRY], feat_composite_ewm, feat_long_store, feat_range,
    cs_zscore, cs_demean_weights, gross_weights, fwd_ret, dollar_neutral, ic_daily, ic_summary, ic_rolling63, ic_monthly, ic_hist, ic_ortho, ic_raw_ortho, ic_pooled, ortho_residuals, regime_labels, ic_by_regime, ic_regime_bars,
    corr_matrix, collinearity, rank_features, composite_weights, leaderboard, qa_distribution, qa_coverage, qa_explosion, qa_lookahead, qa_lookahead_planted, qa_adf,
    ls_binary, ls_binary_inverted, portfolio_prop, portfolio_demeaned, portfolio_mean_binary, equity_curve, drawdown, portfolio_summary, sharpe_summary, rolling_sharpe, sharpe_by_window, descriptives, skew_kurt,
    ridge_oos_ic, ridge_coefs, ridge_all_ic, ridge_pooled_ic, store_load_slice, store_sql_agg, plan_missing, coverage_gate,
]
QUERIES: dict[str, Query] = {f.__name__: f for f in _NAMED}


def __getattr__(name: str):
    if name == "SQL":
        from .research_sql import SQL

        return SQL
    raise AttributeError(name)
