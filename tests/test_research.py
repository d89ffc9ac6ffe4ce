import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import ic, panel, portfolio, qa, ridge, synthesis
from panelforge.plans import incremental, pipeline
from panelforge.functions.features import REGISTRY, specs

DAY0 = dt.date(2020, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def bars(n=400, assets=5, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for a in range(assets):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            if rng.random() > 0.03:
                rows.append((f"a{a}", day(i), float(c[i]), float(c[i] * 1.01), float(c[i] * 0.99), float(rng.uniform(1, 9)), float(rng.uniform(0, 1)), int(rng.integers(1, 99))))
    return pd.DataFrame(rows, columns=["asset", "d", "close", "high", "low", "volume", "taker_buy_vol", "n_trades"])


def test_ic_with_ties_few_assets_and_odd_calendars(spark):
    s = spark.createDataFrame(
        [("a", day(0), "f", 1.0), ("b", day(0), "f", 1.0), ("c", day(0), "f", 3.0), ("a", day(1), "f", 1.0), ("b", day(1), "f", 2.0), ("a", day(2), "f", 1.0), ("b", day(2), "f", 1.0), ("c", day(2), "f", 1.0)],
        "asset string, d date, feature_id string, value double",
    )
    f = spark.createDataFrame([(a, day(i), 1, v) for i in range(3) for a, v in (("a", 0.1), ("b", 0.3), ("c", 0.2))], "asset string, d date, h int, fwd double")
    got = {r.d: r.ic for r in ic.daily(s, f, (1,)).collect()}
    want = np.corrcoef([1.5, 1.5, 3], [1, 3, 2])[0, 1]
    assert got[day(0)] == pytest.approx(want) and got[day(1)] is None and got[day(2)] is None


def test_forward_returns_skip_missing_but_need_the_row(spark):
    p = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), None), ("a", day(2), 2.0), ("a", day(5), 4.0)], "asset string, d date, close double")
    got = {(r.d, r.h): r.fwd for r in panel.forward_returns(p, (1, 2)).collect()}
    assert got[(day(0), 1)] == 0.0 and got[(day(0), 2)] == 0.0 and got[(day(1), 2)] == pytest.approx(math.log(2)) and got[(day(2), 1)] == pytest.approx(math.log(2))
    assert (day(5), 1) not in got and (day(2), 2) not in got


def test_cross_section(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("b", day(0), 3.0), ("a", day(1), 2.0), ("b", day(1), 2.0), ("a", day(2), None)], "asset string, d date, s double")
    out = {(r.asset, r.d): r for r in df.select("asset", "d", panel.cs_zscore(F.col("s")).alias("z"), panel.gross_weights(F.col("s")).alias("w"), panel.demean(F.col("s")).alias("m")).collect()}
    assert out[("b", day(0))].z == pytest.approx(1 / math.sqrt(2)) and out[("a", day(1))].z is None and out[("b", day(0))].w == 0.75 and out[("a", day(0))].m == -1.0
    ret = panel.portfolio_return(df.withColumn("w", F.lit(1.0)).withColumn("f", F.col("s")), "w", "f").orderBy("d").collect()
    assert [r.ret for r in ret] == [4.0, 4.0, 0.0]


@pytest.mark.parametrize("controls", [["x"], ["x", "y"]])
def test_orthogonal_residuals(spark, controls):
    rng = np.random.default_rng(1)
    n = 60
    t = pd.DataFrame({"asset": "a", "d": [day(i) for i in range(n)], "x": rng.normal(size=n), "y": rng.normal(size=n)})
    t["f"] = 2 * t.x - t.y + 0.5 + rng.normal(size=n)
    t.loc[3, "x"] = None
    short = t.head(10).assign(asset="short")
    flat = t.assign(asset="flat", x=1.0, y=1.0)
    got = ic.orthogonalize(spark.createDataFrame(pd.concat([t, short, flat]).astype(object).where(lambda v: v.notna(), None), "asset string, d date, x double, y double, f double"), "f", controls).toPandas()
    full = t.dropna()
    design = np.column_stack([np.ones(len(full)), *[full[c] for c in controls]])
    res = full.f - design @ np.linalg.lstsq(design, full.f, rcond=None)[0]
    mine = got[got.asset == "a"].sort_values("d").value.to_numpy(float)
    np.testing.assert_allclose(mine[~np.isnan(mine)], res.to_numpy(), atol=1e-9)
    for a in ("short", "flat"):
        np.testing.assert_allclose(got[got.asset == a].sort_values("d").value.to_numpy(float), (short if a == "short" else flat).f.to_numpy())


def test_regimes_and_thresholds(spark):
    b = spark.createDataFrame(bars(120, 1))
    labels = ic.regimes(b, "a0").toPandas().sort_values("d")
    assert labels.regime[:30].isna().all() and set(labels.regime.dropna()) == {"high_vol", "low_vol"}
    few = spark.createDataFrame([("f", 1, day(i), 0.1 * i) for i in range(9)], "feature_id string, h int, d date, ic double")
    lab = spark.createDataFrame([(day(i), "high_vol") for i in range(9)], "d date, regime string")
    r = ic.by_regime(few, lab).first()
    assert r.mean_ic is None and r.n == 0


def test_monthly_keeps_empty_months(spark):
    x = spark.createDataFrame([("f", 1, dt.date(2020, 1, 5), 0.5), ("f", 1, dt.date(2020, 3, 5), 0.7)], "feature_id string, h int, d date, ic double")
    assert [r.ic for r in ic.monthly(x).orderBy("month").collect()] == [0.5, None, 0.7]


def test_correlation_of_features(spark):
    rng = np.random.default_rng(2)
    n = 80
    t = pd.DataFrame({"p": rng.integers(0, 9, n).astype(float), "q": rng.normal(size=n)})
    t["r"] = t.p * 2 + rng.normal(0, 0.01, n)
    rows = [("a", day(i), c, float(t[c][i])) for c in t for i in range(n) if not (c == "q" and i % 7 == 0)]
    got = {(r.f1, r.f2): r for r in synthesis.correlations(spark.createDataFrame(rows, "asset string, d date, feature_id string, value double")).collect()}
    for (a, b), r in got.items():
        both = t[[i % 7 != 0 for i in range(n)]] if "q" in (a, b) else t
        assert r.n == len(both) and r.rho == pytest.approx(both[a].rank().corr(both[b].rank()))
    pairs = synthesis.collinear(spark.createDataFrame([(a, b, r.n, r.rho) for (a, b), r in got.items()], "f1 string, f2 string, n bigint, rho double"))
    assert [(r.f1, r.f2) for r in pairs.filter("flagged").collect()] == [("p", "r")]
    s = spark.createDataFrame([("p", 1, 0.2, 0.3), ("q", 1, 0.1, -0.2), ("r", 1, 0.1, 0.3), ("weak", 1, 0.0, 0.01)], "feature_id string, h int, ic_mean double, icir double")
    w = {r.feature_id: (r.equal_weight, r.icir_weight) for r in synthesis.composites(s, pairs, 1).collect()}
    assert w == {"p": (0.5, 0.6), "q": (0.5, 0.4)}  # r ties with p and is the second


def test_ranking_survives_missing_regimes(spark):
    s = spark.createDataFrame([("a", 1, 0.05, 0.2, 9, 0.1), ("b", 1, None, None, 0, None)], "feature_id string, h int, ic_mean double, icir double, n int, stderr double")
    reg = spark.createDataFrame([("a", 1, "high_vol", None), ("a", 1, "low_vol", -0.3)], "feature_id string, h int, regime string, mean_ic double")
    got = synthesis.rank_features(s, reg, 1).orderBy("position").collect()
    assert [(r.feature_id, r.best_regime, r.exploitable) for r in got] == [("a", "low_vol", True), ("b", None, False)]


def test_portfolio_statistics(spark):
    r = [0.1, -0.5, None, 0.2]
    df = spark.createDataFrame([("a", day(i), x) for i, x in enumerate(r)], "asset string, d date, ret double")
    s = portfolio.summary(df, "ret").first()
    assert s.max_drawdown == pytest.approx(-0.5) and s.win_rate == pytest.approx(2 / 3) and s.total_return == pytest.approx(1.1 * 0.5 * 1.2 - 1)
    x = np.array([0.1, -0.5, 0.2])
    assert s.sharpe == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252))
    sig = spark.createDataFrame([(1.0,), (0.0,), (None,), (-1.0,)], "z double").select(portfolio.binary_signal(F.col("z")).alias("p"), portfolio.binary_signal(F.col("z"), -1).alias("q")).collect()
    assert [(a.p, a.q) for a in sig] == [(1, -1), (-1, 1), (-1, 1), (-1, 1)]


def test_skew_and_kurtosis_are_bias_corrected(spark):
    b = bars(60, 1)
    lr = np.log(b.close / b.close.shift(1)).dropna()
    r = portfolio.descriptives(spark.createDataFrame(b)).first()
    assert r.skew == pytest.approx(lr.skew()) and r.kurtosis == pytest.approx(lr.kurt())


def test_quality_checks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=600)
    x[5] = 1e6
    v = spark.createDataFrame([("a", day(i), "f", float(y)) for i, y in enumerate(x)] + [("a", day(i), "g", None) for i in range(40)], "asset string, d date, feature_id string, value double")
    d = {r.feature_id: r for r in qa.distribution(v).collect()}
    assert d["f"].n == 600 and d["f"].outlier_share == pytest.approx(1 / 600) and d["f"].passed and "g" not in d
    c = {r.feature_id: r for r in qa.coverage(v, {"f": 10, "g": 40}).collect()}
    assert c["f"].passed and not c["g"].passed and c["g"].missing_share is None
    e = qa.explosion(v.filter("feature_id = 'f'")).first()
    assert e.n == 600 and e.ratio < 0.1 and e.passed
    assert all(r.n_bad == 0 for r in qa.lookahead(spark.createDataFrame(bars(80, 2)), specs(["ret_1d", "mom_20d"]), [day(40).isoformat()]).collect())


def test_unit_root_statistic():
    rng = np.random.default_rng(5)
    noise = rng.normal(size=500)
    stat, p = qa.adf(noise)
    assert stat < -5 and p < 0.001
    assert qa.adf(np.cumsum(noise))[1] > 0.05
    assert math.isnan(qa.adf(np.ones(100))[1]) and math.isnan(qa.adf(noise[:5])[0])


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(6)
    n = 150
    x = rng.normal(size=(n, 3))
    y = x @ [1.0, -2.0, 0.0] + rng.normal(0, 0.5, n)
    df = spark.createDataFrame([(f"a{i}", day(i), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "asset string, d date, p double, q double, r double, y double")
    fold = ridge.Fold("one", day(99).isoformat(), day(100).isoformat(), day(149).isoformat())
    got = ridge.fit(df, ["p", "q", "r"], "y", fold)
    errors = []
    for a in ridge.ALPHAS:
        inv = np.linalg.inv(x[:100].T @ x[:100] + a * np.eye(3))
        h = np.einsum("ij,jk,ik->i", x[:100], inv, x[:100])
        errors.append((((y[:100] - x[:100] @ inv @ x[:100].T @ y[:100]) / (1 - h)) ** 2).mean())
    best = ridge.ALPHAS[int(np.argmin(errors))]
    want = np.linalg.solve(x[:100].T @ x[:100] + best * np.eye(3), x[:100].T @ y[:100])
    assert got.alpha == best and got.coef == pytest.approx(tuple(want))
    assert ridge.predict(df, ["p", "q", "r"], got, fold).count() == 50
    assert ridge.fit(df.limit(0), ["p", "q", "r"], "y", fold) is None


def test_plans(spark):
    assert [incremental.extra_days(p) for p in ({"window_d": 20, "lookback_d": 272}, {"lookback_d": 14}, {"window": "7d"}, {"window": "24h"}, {"window_min": 2880}, {"window_min": 5}, {})] == [20, 14, 7, 1, 2, 1, 0]
    planned = incremental.plan(spark, ["a", "b"], "2024-01-01", "2024-01-03", specs(["ret_1d"]))
    assert planned.count() == 6 and incremental.days(spark, "2024-01-02", "2024-01-01").count() == 0
    done = spark.createDataFrame([("ret_1d", "v1", "a", dt.date(2024, 1, 2))], "feature_id string, version string, asset string, day date")
    assert incremental.coverage(planned, done, ["feature_id", "version", "asset", "day"])[:2] == (6, 5)


def test_a_range_equals_the_whole(spark):
    b = spark.createDataFrame(bars(400, 3, 9))
    wanted = specs(["ret_1d", "rel_mom_20d", "hl_range_20d"])
    part = incremental.compute_range(b, wanted, day(330).isoformat(), day(350).isoformat())
    whole = incremental.compute_range(b, wanted, day(0).isoformat(), day(399).isoformat())
    key = lambda r: (r.asset, r.feature_id, r.ts)
    lo, hi = (int(dt.datetime.combine(day(n), dt.time(), dt.timezone.utc).timestamp() * 1e6) for n in (330, 350))
    a, w = {key(r): r.value for r in part.collect()}, {key(r): r.value for r in whole.collect() if lo <= r.ts <= hi}
    assert a == pytest.approx(w) and a


def test_the_whole_chain(spark):
    b = spark.createDataFrame(bars(120, 5))
    r = pipeline.research(b, ["ret_1d", "mom_20d"], (1, 3), "a0")
    note = pipeline.research_note(r)
    assert "## Ranking" in note and "mom_20d" in note
    assert '"feature_id": "mom_20d"' in pipeline.ic_report(r, ["a0"])
    assert "Overall:" in pipeline.quality_report(b, "mom_20d", "a0")
    assert REGISTRY["mom_20d"].with_params(window_d=5).warmup_rows == 5


def test_stationarity_takes_all_price_features(spark):
    from panelforge.functions.features import PRICE_FEATURES
    from panelforge.queries import research

    assert {r.feature_id for r in research.qa_adf(spark, "/root/testdata/sf0.001").collect()} == set(PRICE_FEATURES)
