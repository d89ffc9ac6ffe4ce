import datetime as dt

import numpy as np
import pytest

from panelforge.operators import regrid as g

DAY0 = dt.date(2020, 1, 1)


def monotone(x, y, at):
    """Monotone cubic interpolation of one segment, a number at a time."""
    h = [b - a for a, b in zip(x, x[1:])]
    s = [(b - a) / k for a, b, k in zip(y, y[1:], h)]
    n = len(x)

    def end(h0, s0, h1, s1):
        d = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        if np.sign(d) != np.sign(s0):
            return 0.0
        return 3 * s0 if np.sign(s0) != np.sign(s1) and abs(d) > 3 * abs(s0) else d

    d = []
    for i in range(n):
        if n == 2:
            d.append(s[0])
        elif i == 0:
            d.append(end(h[0], s[0], h[1], s[1]))
        elif i == n - 1:
            d.append(end(h[-1], s[-1], h[-2], s[-2]))
        elif s[i - 1] * s[i] <= 0:
            d.append(0.0)
        else:
            w0, w1 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            d.append((w0 + w1) / (w0 / s[i - 1] + w1 / s[i]))
    i = max(k for k in range(n - 1) if x[k] <= at)
    t = (at - x[i]) / h[i]
    return y[i] * (1 + 2 * t) * (1 - t) ** 2 + h[i] * d[i] * t * (1 - t) ** 2 + y[i + 1] * t * t * (3 - 2 * t) - h[i] * d[i + 1] * t * t * (1 - t)


def brute(points, max_gap):
    xs = sorted(points)
    out = {x: (points[x], "observed") for x in xs}
    segments, now = [], [xs[0]]
    for a, b in zip(xs, xs[1:]):
        if b - a > max_gap:
            out |= {k: (None, "gap") for k in range(a + 1, b)}
            segments.append(now)
            now = [b]
        else:
            now.append(b)
    for s in [*segments, now]:
        for a, b in zip(s, s[1:]):
            for k in range(a + 1, b):
                out[k] = (monotone(s, [points[x] for x in s], k), "filled")
    return out


@pytest.mark.parametrize("shard", [3, 16, 100_000])
def test_equals_a_number_at_a_time(spark, monkeypatch, shard):
    monkeypatch.setattr(g, "SHARD_DAYS", shard)
    rng = np.random.default_rng(shard)
    series, rows = {}, []
    for k in range(8):
        xs = np.flatnonzero(rng.random(200) < rng.choice([0.05, 0.3, 0.8])).tolist() or [3]
        series[f"s{k}"] = {x: float(np.round(rng.normal(), 1)) for x in xs}
        rows += [("e", f"s{k}", DAY0 + dt.timedelta(days=x), y, "extra", 1) for x, y in series[f"s{k}"].items()]
    df = spark.createDataFrame(rows, "exchange string, symbol string, day date, close double, x string, halo int")
    got = {}
    for r in g.regrid(df, "close", max_gap=10).collect():
        got.setdefault(r.symbol, {})[(r.day - DAY0).days] = (r.close, r.status)
    for s, points in series.items():
        want = brute(points, 10)
        assert set(got[s]) == set(want)
        for x, (y, status) in want.items():
            assert got[s][x][1] == status
            assert (y is None) == (got[s][x][0] is None) and (y is None or got[s][x][0] == pytest.approx(y, abs=1e-9))


def test_nulls_empty_and_single(spark):
    schema = "exchange string, symbol string, day date, close double"
    assert g.regrid(spark.createDataFrame([], schema), "close").count() == 0
    d = lambda n: DAY0 + dt.timedelta(days=n)
    df = spark.createDataFrame([(None, "a", d(0), 1.0), (None, "a", d(2), 3.0), ("e", None, d(5), 1.0), ("e", "b", d(1), None)], schema)
    got = {(r.exchange, r.symbol, r.day): (r.close, r.status) for r in g.regrid(df, "close").collect()}
    assert got == {(None, "a", d(0)): (1.0, "observed"), (None, "a", d(1)): (2.0, "filled"), (None, "a", d(2)): (3.0, "observed"), ("e", None, d(5)): (1.0, "observed")}


def test_filled_values_stay_between_their_readings(spark):
    rng = np.random.default_rng(5)
    pts = {int(x): float(y) for x, y in zip(np.cumsum(rng.integers(1, 6, 60)), np.cumsum(rng.exponential(1, 60)))}
    df = spark.createDataFrame([("e", "s", DAY0 + dt.timedelta(days=x), y) for x, y in pts.items()], "exchange string, symbol string, day date, close double")
    ys = [r.close for r in g.regrid(df, "close").orderBy("day").collect()]
    assert all(b >= a - 1e-12 for a, b in zip(ys, ys[1:]))
