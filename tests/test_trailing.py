import datetime as dt

import numpy as np
import pytest

from panelforge.operators import trailing as t

DAY0 = dt.date(2020, 1, 1)
SCHEMA = "exchange string, symbol string, day date, v double, n bigint"


def test_equals_window_by_window(spark):
    rng = np.random.default_rng(1)
    rows, series = [], {}
    for s in "abc":
        days = np.flatnonzero(rng.random(120) < 0.4).tolist()
        series[s] = {d: (None if rng.random() < 0.2 else float(rng.choice([rng.normal(), 1e9, 0.1])), None if rng.random() < 0.2 else int(rng.integers(0, 9))) for d in days}
        rows += [("e", s, DAY0 + dt.timedelta(days=d), *v) for d, v in series[s].items()]
    got = {(r.symbol, (r.day - DAY0).days): r for r in t.totals(spark.createDataFrame(rows, SCHEMA), ["v", "n"]).collect()}
    for s, days in series.items():
        lo, hi = min(days), max(days)
        assert {d for k, d in got if k == s} == set(range(lo, hi + 1))
        for d in range(lo, hi + 1):
            for w in (7, 30):
                for i, a in enumerate("vn"):
                    x = [days[k][i] for k in range(d - w + 1, d + 1) if k in days and days[k][i] is not None]
                    r = got[(s, d)]
                    assert r[f"{a}_n_{w}"] == len(x) and r[f"{a}_sum_{w}"] == pytest.approx(sum(x), abs=1e-8)
                    assert (r[f"{a}_avg_{w}"] is None) == (not x)


def test_what_is_added_is_taken_away_exactly(spark):
    d = lambda n: DAY0 + dt.timedelta(days=n)
    rows = [("e", "s", d(0), 1e15, 1), ("e", "s", d(1), 0.1, 1), ("e", "s", d(40), 0.3, 1)]
    got = {(r.day - DAY0).days: r for r in t.totals(spark.createDataFrame(rows, SCHEMA), ["v", "n"]).collect()}
    assert got[7].v_sum_7 == 0.1 and got[8].v_sum_7 == 0.0 and got[40].v_sum_30 == 0.3
    assert got[8].v_avg_7 is None


def test_from_day_nulls_and_empty(spark):
    assert t.totals(spark.createDataFrame([], SCHEMA), ["v"]).count() == 0
    d = lambda n: DAY0 + dt.timedelta(days=n)
    df = spark.createDataFrame([(None, None, d(0), None, None), (None, None, d(31), 2.0, None), ("e", "short", d(3), 1.0, 1), ("e", "short", d(3 + 28), 1e30, 1)], SCHEMA)
    got = t.totals(df, ["v"], from_day=30).collect()
    assert sorted((r.day - DAY0).days for r in got) == [29, 30, 31] and all(r.symbol is None for r in got)
    assert [r.v_sum_30 for r in got if r.day == d(31)] == [2.0]
    big = [r for r in t.totals(df, ["v"]).collect() if r.symbol == "short" and r.day == d(31)]
    assert (big[0].v_n_7, big[0].v_sum_7) == (1, float("inf"))  # beyond the exact sum it counts as infinite


def test_amounts_of_any_size_leave_no_trace(spark):
    values = [1e23, 1e-12, 3.25, -2e22, 1e-30, 7e15, float("inf"), 0.1, float("nan"), 2e35, -2e35, 0.3, 0.2]
    rows = [("e", "s", dt.date(2024, 1, 1) + dt.timedelta(days=3 * i), v) for i, v in enumerate(values)]
    got = {r.day: (r.x_sum_2, r.x_n_2, r.x_sum_5) for r in t.totals(spark.createDataFrame(rows, "exchange string, symbol string, day date, x double"), ["x"], (2, 5)).collect()}
    for i, v in enumerate(values):
        day = rows[i][2]
        one = None if v != v else float("inf") if v >= 1e30 else -float("inf") if v <= -1e30 else v
        assert got[day][:2] == ((one if one is not None else 0.0), int(one is not None))
        assert got.get(day + dt.timedelta(days=2), (0.0, 0))[:2] == (0.0, 0)  # exactly
    assert got[rows[1][2]][2] == 1e23 + 1e-12 and got[rows[5][2]][2] == 7e15 and got[rows[10][2]][2] is None
