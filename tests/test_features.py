"""What each feature promises, on small panels: warm-up, identities, signs, bounds, missing columns, purity."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.functions import kernels as k
from panelforge.functions.features import DEFAULT_COMPOSITE_WINDOWS, PRICE_FEATURES, REGISTRY, compute, ewm_composite, specs, to_long

DAY0 = dt.date(2020, 1, 1)


def walk(n=320, seed=42, sigma=0.02):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, sigma, n)))
    vol = rng.uniform(1000, 5000, n)
    return pd.DataFrame({
        "asset": "x", "d": [DAY0 + dt.timedelta(days=i) for i in range(n)], "close": close, "high": close * (1 + rng.uniform(0, 0.03, n)), "low": close * (1 - rng.uniform(0, 0.03, n)),
        "volume": vol, "taker_buy_vol": vol * rng.uniform(0.3, 0.7, n), "n_trades": rng.integers(1000, 5000, n),
    })


def values(spark, pdf, ids):
    return compute(spark.createDataFrame(pdf), specs(ids) if isinstance(ids, list) else [ids]).orderBy("d").toPandas()


WARMUP = {
    "ret_1d": 1, "mom_20d": 20, "rv_30d": 30, "cvd_20d": 19, "rel_mom_20d": 271, "reversal_5d": 5, "taker_ratio_20d": 19, "risk_adj_ret_20d": 271, "hl_range_20d": 270, "dist_from_high_20d": 19,
    "vol_ratio_20d": 270, "trades_zscore_20d": 19, "zscore_ret_composite": 300,
}


def test_warmup_is_exact(spark):
    out = values(spark, walk(), PRICE_FEATURES)
    for f, n in WARMUP.items():
        assert out[f][:n].isna().all() and not math.isnan(out[f][n]), f
        assert REGISTRY[f].warmup_rows == n, f


def test_against_pandas(spark):
    p = walk()
    out = values(spark, p, PRICE_FEATURES)
    c, v = p.close, p.volume
    lr, r1 = np.log(c / c.shift(1)), c / c.shift(1) - 1
    z = lambda x, n: (x - x.rolling(n).mean()) / x.rolling(n).std()
    want = {
        "ret_1d": lr, "mom_20d": lr.rolling(20).sum(), "rv_30d": lr.rolling(30).std() * math.sqrt(365), "cvd_20d": (2 * p.taker_buy_vol - v).rolling(20).sum() / v.rolling(20).mean(),
        "rel_mom_20d": z(c / c.shift(20) - 1, 252), "reversal_5d": -(c / c.shift(5) - 1), "taker_ratio_20d": z(p.taker_buy_vol / v, 20), "risk_adj_ret_20d": z((c / c.shift(20) - 1) / (lr.rolling(20).std() * math.sqrt(252)), 252),
        "hl_range_20d": z(((p.high - p.low) / c).rolling(20).mean(), 252), "dist_from_high_20d": c / c.rolling(20).max() - 1, "vol_ratio_20d": z(v / v.rolling(20).mean(), 252), "trades_zscore_20d": z(p.n_trades.astype(float), 20),
        "zscore_ret_composite": sum(z(r1, w) for w in (15, 30, 60, 80, 100, 150, 200, 250, 300)) / 9,
    }
    for f, w in want.items():
        np.testing.assert_allclose(out[f].to_numpy(float), w.to_numpy(float), rtol=1e-7, atol=1e-9, err_msg=f)


def test_momentum_is_a_log_ratio(spark):
    p = walk(40)
    out = values(spark, p, ["mom_20d"])
    assert out.mom_20d[39] == pytest.approx(math.log(p.close[39] / p.close[19]))


def test_signs_and_bounds(spark):
    up = walk(60).assign(close=[100 * math.exp(0.02 * i) for i in range(60)])
    out = values(spark, up, ["mom_20d", "reversal_5d", "dist_from_high_20d", "rv_30d"])
    assert (out.mom_20d[20:] > 0).all() and (out.reversal_5d[5:] < 0).all() and (out.dist_from_high_20d[19:].abs() < 1e-12).all()
    wild = values(spark, walk(60), ["rv_30d", "dist_from_high_20d", "trades_zscore_20d"])
    assert (wild.rv_30d[30:] > 0).all() and (wild.dist_from_high_20d[19:] <= 0).all() and (wild.trades_zscore_20d[19:].abs() < 10).all()


@pytest.mark.parametrize("taker,sign", [(100.0, 1), (0.0, -1), (50.0, 0)])
def test_constant_flow(spark, taker, sign):
    p = walk(30).assign(volume=100.0, taker_buy_vol=taker)
    out = values(spark, p, ["cvd_20d", "taker_ratio_20d"])
    assert np.sign(round(out.cvd_20d[29], 9)) == sign
    assert out.taker_ratio_20d.isna().all()  # a spread of zero is none


def test_nulls_zeros_and_missing_columns(spark):
    p = walk(60)
    p.loc[30, "close"] = None
    p.loc[40, "volume"] = 0.0
    out = values(spark, p, ["ret_1d", "mom_20d", "taker_ratio_20d"])
    assert math.isnan(out.ret_1d[30]) and math.isnan(out.ret_1d[31]) and out.mom_20d[31:51].isna().all() and not math.isnan(out.mom_20d[51])
    assert out.taker_ratio_20d[40:60].isna().all()
    gone = compute(spark.createDataFrame(walk(3)[["asset", "d", "close"]]), specs(["cvd_20d", "ret_1d"])).orderBy("d").toPandas()
    assert gone.cvd_20d.isna().all() and not math.isnan(gone.ret_1d[1])
    assert compute(spark.createDataFrame(walk(3)).limit(0), specs()).count() == 0


def test_windows_are_over_rows_not_days(spark):
    p = walk(60)
    holes = p.assign(d=[DAY0 + dt.timedelta(days=3 * i) for i in range(60)])
    a, b = values(spark, p, ["mom_20d"]), values(spark, holes, ["mom_20d"])
    np.testing.assert_allclose(a.mom_20d, b.mom_20d)


def test_order_book_imbalance(spark):
    rows = [("x", 1, 100.0, 100.1, 5.0, 3.0), ("x", 2, 90.0, 110.0, 5.0, 3.0), ("x", 3, 100.0, 100.1, 0.0, 0.0), ("x", 4, None, 100.0, 1.0, 1.0), ("x", 5, 100.0, 102.0, 5.0, 3.0)]
    b = spark.createDataFrame(rows, "asset string, d bigint, bid_price_0 double, ask_price_0 double, bid_size_0 double, ask_size_0 double")
    out = [r.obi_0_5pct for r in compute(b, [REGISTRY["obi_0_5pct"]]).orderBy("d").collect()]
    assert out[0] == pytest.approx(0.25) and out[1:4] == [None, None, None] and out[4] is None


def test_ewm_composite_against_the_formula(spark):
    p = walk(140)
    out = ewm_composite(spark.createDataFrame(p), (15, 30)).orderBy("d").toPandas()
    r = (p.close / p.close.shift(1) - 1).to_numpy()

    def z(w):
        res = np.full(len(r), np.nan)
        for t in range(w, len(r)):
            age = np.arange(t - 1, -1, -1)
            wt, x = (1 - 2 / (w + 1)) ** age, r[1 : t + 1]
            m = (wt * x).sum() / wt.sum()
            var = (wt * (x - m) ** 2).sum() / wt.sum() * wt.sum() ** 2 / (wt.sum() ** 2 - (wt**2).sum())
            res[t] = (r[t] - m) / math.sqrt(var)
        return res

    np.testing.assert_allclose(out.value.to_numpy(float), (z(15) + z(30)) / 2, rtol=1e-8)
    assert DEFAULT_COMPOSITE_WINDOWS == (15, 30, 60, 80, 100)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(280, 310), st.integers(0, 10_000))
def test_the_future_changes_nothing(spark, cut, seed):
    p = walk(320, seed % 5)
    q = p.copy()
    rng = np.random.default_rng(seed)
    for c in ("close", "high", "low", "volume", "taker_buy_vol", "n_trades"):
        q.loc[cut:, c] = (q.loc[cut:, c] * rng.uniform(0.1, 9)).astype(q[c].dtype)
    a, b = values(spark, p, PRICE_FEATURES), values(spark, q, PRICE_FEATURES)
    for f in PRICE_FEATURES:
        np.testing.assert_allclose(a[f][:cut].to_numpy(float), b[f][:cut].to_numpy(float), err_msg=f)


def test_one_exchange_and_sort_for_all_features(spark):
    plan = compute(spark.createDataFrame(walk(40)), specs())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_long_layout_and_kernels(spark):
    long = to_long(compute(spark.createDataFrame(walk(25)), specs(["ret_1d", "mom_20d"])), ["ret_1d", "mom_20d"])
    assert long.groupBy("feature_id").count().orderBy("feature_id").collect() == [("mom_20d", 5), ("ret_1d", 24)]
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0), (None, None)], "a double, b double")
    got = df.select(k.mean_of([F.col("a"), F.col("b")]).alias("x"), k.mean_of([F.col("a"), F.col("b")], True).alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(None, 1.0), (3.0, 3.0), (None, None)]
    tied = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0)], "g int, v double").select(k.average_rank(F.col("v"), ["g"]).alias("r")).collect()
    assert sorted(r.r for r in tied) == [1.5, 1.5, 3.0]
