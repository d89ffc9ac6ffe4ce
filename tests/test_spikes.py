import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import spikes as s

DAY0 = dt.date(2020, 1, 1)
SCHEMA = "bar_id bigint, load_id int, exchange string, symbol string, day date, high double, low double, close double, quote_vol double"


def series(seed=1, n=200, name="s"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    vol = 1e6 * np.exp(rng.normal(0, 0.1, n))
    return [[i + 1000 * seed, 1, "e", name, DAY0 + dt.timedelta(days=i), c * 1.01, c * 0.99, c, v] for i, (c, v) in enumerate(zip(close.tolist(), vol.tolist()))]


def found(spark, rows, **kw):
    return {r.bar_id: r.reasons for r in s.flagged(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), **kw).collect()}


def test_a_clean_series_has_no_case(spark):
    assert found(spark, series()) == {}


def test_spikes_up_to_three_days(spark):
    rows = series()
    for i in (50, 51, 52):
        rows[i][7], rows[i][5], rows[i][6] = rows[i][7] * 3, rows[i][5] * 3, rows[i][6] * 3
    rows[100][8] *= 1e4
    for i in range(150, 154):  # four days are no spike
        rows[i][8] *= 1e4
    assert found(spark, rows) == {1050: "spike", 1051: "spike", 1052: "spike", 1100: "spike"}


def test_a_lasting_change_is_no_case(spark):
    rows = series()
    for i in range(100, 200):
        for k in (5, 6, 7):
            rows[i][k] *= 10
    assert found(spark, rows) == {}


def test_stuck_runs_take_all_their_rows(spark):
    rows = series()
    for i in range(20, 25):
        rows[i][8] = rows[20][8]
    for i in range(60, 64):
        rows[i][8] = rows[60][8]  # four only
    copy = [9_000, 2, *rows[22][2:]]
    revised = [9_001, 3, *rows[23][2:8], 5.5e5]
    want = {1020 + i: "stuck" for i in range(5)} | {9_000: "stuck"}
    assert found(spark, [*rows, copy]) == want
    assert found(spark, [*rows, copy, revised]) == want  # the revision has a value of its own


def test_limits_and_missing(spark):
    rows = series()
    rows[10][7] = 0.0
    rows[11][8] = -1.0
    rows[12][5], rows[12][6] = rows[12][6], rows[12][5]
    rows[13][7] = rows[13][5] * 1.001
    for k in (5, 6, 7, 8):
        rows[14][k] = None
    got = found(spark, rows)
    assert set(got) == {1010, 1011, 1012, 1013} and all("impossible" in v for v in got.values())


def test_shards_do_not_change_the_outcome(spark):
    rows = series() + series(2, 90, "t")
    rows[30][8] *= 1e5
    rows += [[20_000 + i, 1, *rows[40][2:]] for i in range(500)]  # one bar, very many copies
    rows += [[30_000, 1, *rows[30][2:]]]
    one, many = found(spark, rows), found(spark, rows, shard_rows=50)
    assert one == many == {1030: "spike", 30_000: "spike"}
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    a = {r.bar_id: r.score for r in s.flag(df).collect()}
    b = {r.bar_id: r.score for r in s.flag(df, shard_rows=50).collect()}
    assert a == pytest.approx(b) and len(a) == len(rows)


def test_null_keys_tiny_series_and_empty(spark):
    assert found(spark, []) == {}
    rows = series(1, 2, "s") + [[r[0] + 500, *r[1:2], None, None, *r[4:]] for r in series(3, 1)]
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA).withColumn("score", F.lit("clash"))
    assert s.flag(df.drop("score")).count() == 3 and s.flagged(df.drop("score")).count() == 0


def test_the_forest_sees_what_stands_apart():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    x[7] = 12
    score = s.Forest(x, np.random.default_rng(1)).score(x)
    assert score.argmax() == 7 and 0 < score.min() and score.max() < 1


def test_nomination_loses_no_spike():
    """Every spike the exact check finds in noisy series is among the forest's candidates."""
    for seed in range(6):
        rng = np.random.default_rng(seed)
        n = 300
        log = np.cumsum(rng.normal(0, 0.01, n))
        at = rng.choice(np.arange(10, 290, 7), 8, replace=False)
        log2 = log.copy()
        log2[at] += rng.choice([-1, 1], 8)
        days = {"day": np.arange(n), **{f: np.exp(log2) for f in s.FIELDS}}
        days["quote_vol"] = np.exp(rng.normal(0, 0.1, n))
        days |= {f"first_{f}": days[f] for f in s.STUCK_FIELDS}
        _, _, _, spike = s.judge(days, days)
        assert set(at) <= set(np.flatnonzero(spike))
