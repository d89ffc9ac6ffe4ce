import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.operators import profile as p

NAN = float("nan")


def ks(a, b):
    grid = np.unique(np.r_[a, b])
    return np.abs(np.searchsorted(np.sort(a), grid, side="right") / len(a) - np.searchsorted(np.sort(b), grid, side="right") / len(b)).max()


def brute(values):
    """Per load: the statistics of a list of (load, value)."""
    out, prev = {}, None
    loads = sorted({l for l, v in values if v == v})
    for l in loads:
        x = np.sort([v for k, v in values if k == l and v == v])
        rest = np.array([v for k, v in values if k != l and v == v])
        q = [x[max(1, math.ceil(f * len(x))) - 1] for f in p.QUANTILES]
        u, n = np.unique(x, return_counts=True)
        out[l] = (len(x), len(u), x[0], *q, x[-1], n.max(), ks(x, rest) if len(rest) else None, ks(x, prev) if prev is not None else None)
        prev = x
    return out


@pytest.mark.parametrize("ranges", [4, 50, 10_000])
def test_numeric_profile_is_exact(spark, monkeypatch, ranges):
    monkeypatch.setattr(p, "RANGE_VALUES", ranges)
    monkeypatch.setattr(p, "PACK_ROWS", 70)
    rng = np.random.default_rng(ranges)
    rows = [(int(rng.integers(1, 6)), float(rng.choice([0.0, rng.normal(), -1e300, 5e-324, rng.integers(-3, 3)])), int(rng.integers(-5, 2**60)) if rng.random() > 0.1 else None) for _ in range(400)]
    rows += [(6, NAN, None), (1, NAN, 3), (7, -0.0, -(2**62))]
    df = spark.createDataFrame(rows, "load int, x double, n bigint").repartition(3)
    got = p.numeric_profile(df, "load", ["x", "n"], df.groupBy("load").agg(F.count("*").alias("n_rows"))).collect()
    for column, at in (("x", 1), ("n", 2)):
        want = brute([(r[0], float(r[at]) if r[at] is not None else NAN) for r in rows])
        have = {r.load: r for r in got if r.column_name == column}
        assert set(have) == set(want)
        for l, w in want.items():
            r = have[l]
            mine = (r.n_values, r.n_distinct, r.min_value, r.q25, r.median, r.q75, r.max_value, r.top_count, r.ks_rest, r.ks_prev)
            for a, b in zip(mine, w, strict=True):
                assert (a is None and b is None) or a == pytest.approx(b, rel=1e-12), (column, l, mine, w)
            top = [(k, float(v) if v is not None and v == v else 1e308) for k, v in ((q[0], q[at]) for q in rows)]
            assert r.ks_all == pytest.approx(ks(np.array([v for k, v in top if k == l]), np.array([v for k, v in top if k != l])), rel=1e-12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False)))
def test_keys_keep_the_order(xs):
    x = np.array(xs, float)
    k = p.to_keys(x)
    assert (np.argsort(x, kind="stable") == np.argsort(k, kind="stable")).all()


def test_profile_of_nulls_texts_and_odd_columns(spark):
    df = spark.createDataFrame(
        [(1, None, "a", True), (1, 2.0, "B", None), (None, 3.0, "a", False), (2, NAN, None, True), (2, None, None, True)], "load int, x double, s string, Load2 boolean"
    )
    got = {(r.load, r.column_name): r for r in p.profile(df, "load", patterns={"s": F.col("s").rlike("^[a-z]+$")}).collect()}
    assert got[(1, "x")].n_missing == 1 and got[(1, "x")].median == 2.0 and got[(1, "x")].ks_rest == 1.0
    assert got[(None, "x")].n_rows == 1 and got[(None, "x")].median == 3.0  # a null load is a load
    assert got[(2, "x")].missing_share == 1.0 and got[(2, "x")].median is None and got[(2, "x")].zero_share is None
    assert got[(1, "s")].n_distinct == 2 and got[(1, "s")].bad_share == 0.5 and got[(1, "s")].min_text == "B"
    assert got[(1, "Load2")].max_value == 1.0


def test_empty_table(spark):
    assert p.profile(spark.createDataFrame([], "load int, x double, s string"), "load").count() == 0


def test_one_load_has_no_rest(spark):
    r = p.profile(spark.createDataFrame([(1, 1.0), (1, 1.0)], "load int, x double"), "load").first()
    assert r.ks_rest is None and r.ks_prev is None and r.top_share == 1.0


def test_drift_rules(spark):
    rows = []
    for l in range(12):
        for i in range(40):
            x = 10.0 + i + 0.5
            if l == 3:
                x = x if i % 4 else None  # a quarter is missing
            if l == 5:
                x = x * 6
            if l == 7:
                x = float(math.floor(x))
            if l == 9 and i < 6:
                x = -x
            rows.append((l, x))
    df = spark.createDataFrame(rows, "load int, x double")
    profiled = p.profile(df, "load", watched=("x",))
    assert {r.load: r.ks_state for r in profiled.collect()}[7] == pytest.approx(10 / 11)  # load 5 is whole as well
    assert sorted(r.load for r in p.drifted(profiled, "load").collect()) == [3, 5, 7, 9]
    near = p.drifted(profiled.withColumns({"ks_all": F.lit(0.1), "ks_state": F.lit(0.1)}), "load")
    assert near.count() == 0  # without a distance there is no finding


def test_values_of_one_kind_fold_to_runs():
    k, l, n = p.runs(np.zeros(1000, np.int64), np.repeat([1, 2], 500))
    assert k.tolist() == [0, 0] and l.tolist() == [1, 2] and n.tolist() == [500, 500]
