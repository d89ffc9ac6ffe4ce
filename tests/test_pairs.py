import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import pairs, synthesis
from panelforge.plans import pipeline
from panelforge.queries import research


def _wide(n, m=6):
    """Columns with nested and crossing gaps, hot values, ties, infinities and one that is never there."""
    rng = np.random.default_rng(n)
    t = pd.DataFrame({f"c{i}": rng.normal(size=n) for i in range(m)})
    t["c1"] = np.where(rng.random(n) < 0.6, 0.0, t.c1 + t.c0)  # a hot value
    t["c2"] = rng.integers(0, 5, n).astype(float)
    t["c4"] = np.where(rng.random(n) < 0.02, np.inf, t.c0 + 0.1 * t.c4)
    for i in range(1, m):
        t.loc[rng.random(n) < 0.15 * i, f"c{i}"] = np.nan
    t.loc[t.c1.isna(), "c3"] = np.nan  # c3 only where c1 is
    t.loc[t.c3.isna(), "c4"] = np.nan
    return t.assign(none=np.nan)


@pytest.mark.parametrize("bucket, cells", [(500_000, 1 << 24), (50, 1 << 14), (7, 64)])
def test_correlations_over_buckets_and_blocks(spark, monkeypatch, bucket, cells):
    monkeypatch.setattr(pairs, "BUCKET", bucket)
    monkeypatch.setattr(pairs, "BLOCK_CELLS", cells)
    t = _wide(1500)
    df = spark.createDataFrame(t).repartition(3)
    df = df.withColumns({c: F.when(F.col(c) != 99, F.col(c)) for c in ("c0", "c1")})  # null or NaN is missing
    got = {(r.f1, r.f2): r for r in synthesis.correlations_wide(df, list(t)).collect()}
    names = sorted(t)
    want = {(a, b): t[[a, b]].dropna() for i, a in enumerate(names) for b in names[i + 1 :]}
    assert set(got) == {p for p, both in want.items() if len(both)}
    for (a, b), r in got.items():
        assert r.n == len(want[a, b]) and r.rho == pytest.approx(want[a, b][a].rank().corr(want[a, b][b].rank()), abs=1e-12)


def test_empty_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert [(r.f1, r.f2, r.n, r.rho) for r in synthesis.correlations_wide(df, ["a", "b"]).collect()] == [("a", "b", 2, None)]
    assert synthesis.correlations_wide(df.limit(0), ["a", "b"]).count() == 0


def _moved(spark, action):
    """Bytes that stages of an action write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    ids = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None))}  # noqa: E731, B009
    before = ids()
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in ids().items() if k not in before)


def test_ranks_of_a_value_take_few_bytes(spark):
    rng = np.random.default_rng(1)
    n, m = 20_000, 13
    x = rng.normal(size=(n, m))
    x[rng.random((n, m)) < 0.05] = np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i:02}" for i in range(m)])).withColumns({"asset": F.lit("a"), "d": F.monotonically_increasing_id()})
    moved = _moved(spark, lambda: synthesis.correlations_wide(df, [f"c{i:02}" for i in range(m)]).collect())
    assert 0 < moved < 40 * (~np.isnan(x)).sum()  # of the ranks among twelve others alone there were 100 bytes a value


def test_composite_weights_compute_the_features_once(spark, monkeypatch, tmp_path):
    us = lambda i: int(dt.datetime(2022, 1, 1 + i % 28, tzinfo=dt.timezone.utc).timestamp() * 1e6) + i // 28 * 28 * 86_400_000_000
    rng, rows = np.random.default_rng(5), []
    for a in range(6):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 80)))
        rows += [(us(i), us(i), x, x * 1.01, x * 0.99, x, 5.0 + rng.random(), 1.0, int(rng.integers(5, 50)), 2.0 + rng.random(), "x", f"S{a}", a * 1000 + i, 1) for i, x in enumerate(map(float, close))]
    kinds = "ts_open bigint, ts_close bigint, open double, high double, low double, close double, volume double, quote_vol double, n_trades bigint, taker_buy_vol double, exchange string, symbol string, bar_id bigint, load_id int"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "ohlcv_1d.parquet"))
    calls, real = [], pipeline.signals_wide
    monkeypatch.setattr(pipeline, "signals_wide", lambda *a, **k: calls.append(a) or real(*a, **k))
    got = {r.feature_id: r.icir_weight for r in research.composite_weights(spark, str(tmp_path)).collect()}
    assert len(calls) == 1
    coefficients = pipeline.coefficients(research.daily_panel(spark, str(tmp_path)), research.STUDIED)
    want = synthesis.composites(research.ic.summary(coefficients), synthesis.collinear(research._corr(spark, str(tmp_path))), 5)
    assert got and got == {r.feature_id: r.icir_weight for r in want.collect()}


def test_collinear_pairs_among_many_columns_take_few_bytes(spark):
    rng = np.random.default_rng(7)
    n, m = 12_000, 12
    x = rng.normal(size=(n, m))
    x[:, 1] = x[:, 0] ** 3  # the same ranks
    x[:, 2] = 0.05 * x[:, 2] - x[:, 0]
    x[rng.random((n, m)) < 0.1] = np.nan
    names = [f"c{i:02}" for i in range(m)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).withColumns({"asset": F.lit("a"), "d": F.monotonically_increasing_id()})
    got = []
    moved = _moved(spark, lambda: got.extend(synthesis.collinear(synthesis.correlations_wide(df, names)).collect()))
    assert len(got) == m * (m - 1) // 2
    assert {(r.f1, r.f2) for r in got if r.flagged} == {("c00", "c01"), ("c00", "c02"), ("c01", "c02")}
    assert 0 < moved < 40 * (~np.isnan(x)).sum()
