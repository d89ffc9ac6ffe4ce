import numpy as np
import pytest

from panelforge.operators.ranks import exact_ranks, exact_ranks_among, offsets


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ranks_over_partitions_and_ties(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(i, str(rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1])), float(rng.choice([0.0, 0.0, 0.0, 1.0, rng.normal()]))) for i in range(600)]
    rows += [(1000, None, 1.0), (1001, None, 1.0), (1002, "solo", 5.0)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_ranks(spark.createDataFrame(rows, "k bigint, grp string, x double"), "grp", "x", "k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(rows)
    by = {}
    for k, g, x in rows:
        by.setdefault(g or "", []).append(x)
    want = {k: (g or "", x) for k, g, x in rows}
    for r in got:
        g, x = want[r.id]
        v = np.array(by[g])
        assert (r.below, r.upto, r["size"]) == ((v < x).sum(), (v <= x).sum(), len(v))


def _edge(part, values):
    v = np.array(values)
    moments = {f"s{k}": float((v**k).sum()) for k in (1, 2, 3)}
    return {"part": part, "g": "g", "n": [len(v)], "first": v[0], "first_once": 0, "w_first": 0, "n_first": [(v == v[0]).sum()], "last": v[-1], "last_once": 0, "n_last": [(v == v[-1]).sum()]} | moments


def test_a_tie_over_many_partitions():
    o = offsets([_edge(i, v) for i, v in enumerate([[0.0, 1, 1], [1.0, 1], [1.0], [1.0, 2], [2.0]])])
    assert [tuple(x[0] for x in o[(p, "g")][:4]) for p in range(5)] == [(0, 0, 4, 9), (3, 2, 2, 9), (5, 4, 1, 9), (6, 5, 1, 9), (8, 1, 0, 9)]


def test_ranks_among_many_sets_from_one_sort(spark):
    rng = np.random.default_rng(3)
    rows = [(i, str(rng.choice(["a", "b"])), float(rng.integers(0, 9)), int(rng.integers(0, 8))) for i in range(500)]
    got = exact_ranks_among(spark.createDataFrame(rows, "k bigint, grp string, x double, m bigint"), "grp", "x", "k", "m", 3).collect()
    assert len(got) == 500
    for r in got:
        _, g, x, _ = rows[r.id]
        for bit in range(3):
            v = np.array([q[2] for q in rows if q[1] == g and q[3] >> bit & 1])
            assert (r.below[bit], r.upto[bit], r["size"][bit]) == ((v < x).sum(), (v <= x).sum(), len(v))


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_ranks_among_counted_rows_with_copies_once(spark, parts):
    rng = np.random.default_rng(parts)
    kinds = [(str(rng.choice(["a", "b"])), float(rng.integers(0, 6)), int(k), bool(rng.random() < 0.6)) for k in range(60)]
    rows = [(i, *kinds[int(k)]) for i, k in enumerate(np.minimum(rng.geometric(0.05, 800) - 1, 59))]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_ranks(spark.createDataFrame(rows, "k bigint, grp string, x double, same bigint, ok boolean"), "grp", "x", "k", "ok", "same").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(rows)
    for r in got:
        _, g, x, _, _ = rows[r.id]
        v = np.array([k[1] for k in {q[1:] for q in rows} if k[0] == g and k[3]])
        assert (r.below, r.upto, r["size"]) == ((v < x).sum(), (v <= x).sum(), len(v))


def test_empty(spark):
    assert exact_ranks(spark.createDataFrame([], "k bigint, grp string, x double"), "grp", "x", "k").count() == 0
