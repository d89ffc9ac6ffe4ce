import datetime as dt
import hashlib
import os

import pytest

from panelforge.schema import OHLCV_1D, SchemaMismatch, validate
from panelforge.sources import store as s
from panelforge.sources.bars import bar_day, latest_per_day, micros

BAR = (1709251200000000, 1709337599000000, 61203.3, 62000.0, 60500.0, 61800.0, 12345.6, 7.6e8, 420000, 6200.0, "binance-futures", "BTCUSDT")


def digests(root):
    return {os.path.join(d, f): hashlib.sha256(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_raw_writes_are_idempotent(spark, tmp_path):
    root = str(tmp_path / "raw")
    df = spark.createDataFrame([BAR], OHLCV_1D)
    s.write_raw(df, root)
    before = digests(root)
    s.write_raw(df, root)
    assert digests(root) == before and len(before) == 1
    assert "exchange=binance-futures/data_type=ohlcv_1d/symbol=BTCUSDT/year=2024/month=03/day=01" in next(iter(before))
    got = s.load_raw(spark, root, "binance-futures", "BTCUSDT", "2024-03-01", "2024-03-01")
    assert got.count() == 1 and s.load_raw(spark, root, d0="2024-03-02").count() == 0 and s.load_raw(spark, str(tmp_path / "none")) is None


def test_schema_guard(spark):
    df = spark.createDataFrame([BAR], OHLCV_1D)
    assert validate(df, "ohlcv_1d") is df
    for bad, kind in ((df.drop("close"), "ohlcv_1d"), (df.withColumn("n_trades", df.n_trades.cast("int")), "ohlcv_1d"), (df, "unknown")):
        with pytest.raises(SchemaMismatch):
            validate(bad, kind)


def ts(day):
    return int(dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)


def features(spark, *rows):
    return spark.createDataFrame([(ts(d), "f", "v1", "007", v) for d, v in rows], "ts bigint, feature_id string, version string, asset string, value double")


def test_feature_store(spark, tmp_path):
    st = s.FeatureStore(spark, str(tmp_path / "store"))
    assert st.read().count() == 0
    st.write(features(spark, ("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-03", None)), "mom")
    st.write(features(spark, ("2024-01-02", 9.0), ("2025-01-01", 4.0)), "mom")  # the 2nd is done already
    got = st.load("f", "007")
    assert [r.value for r in got.collect()] == [1.0, 2.0, 4.0] and got.first()["at"].day == 1
    assert [r.value for r in st.load("f", "007", d_from="2024-01-02", d_to="2025-01-01").collect()] == [2.0, 4.0]  # both ends included
    st.write(features(spark, ("2024-01-02", 5.0)), "mom", overwrite=True)
    assert [r.value for r in st.load("f", "007").collect()] == [1.0, 5.0, 4.0]
    assert st.query("SELECT avg(value) AS m FROM features WHERE asset = :a", a="007").first().m == pytest.approx(10 / 3)
    plan = spark.createDataFrame([("f", "v1", "007", dt.date(2024, 1, d)) for d in (1, 2, 3)], "feature_id string, version string, asset string, day date")
    assert [r.day.day for r in st.missing(plan).collect()] == [3]
    assert st.signal("f", "007", lambda: None)[1] == "store" and st.signal("g", "007", lambda: "x") == ("x", "recomputed")


def test_klines_and_pages(spark):
    line = ["1709251200000", "61203.3", "62000.0", "60500.0", "61800.0", "12345.6", "1709337599000", "7.6e8", "420000", "6200.0", "0", "0"]
    df = spark.createDataFrame([("binance-futures", "BTCUSDT", line)], "exchange string, symbol string, kline array<string>")
    assert tuple(s.from_klines(df).first()) == BAR
    pages = [[[str(i * 10), *"0" * 5, str(i * 10 + 9)] for i in range(a, b)] for a, b in ((0, 3), (3, 5))]
    asked = []

    def get(start, limit):
        asked.append(start)
        return pages[len(asked) - 1]

    assert sum(map(len, s.fetch_pages(get, 0, 1000, 3))) == 5 and asked == [0, 30]


def test_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text(s.report_json({"feature_id": "f", "ic_mean": {1: 0.123456, 5: float("nan")}, "icir": {1: None, 5: 1.0}}))
    got = {r.h: (r.ic_mean, r.icir) for r in s.load_reports(spark, str(tmp_path)).collect()}
    assert got == {1: (0.1235, None), 5: (None, 1.0)}
    qa = tmp_path / "qa"
    qa.mkdir()
    (qa / "f.md").write_text("# x\nOverall: ✅ PASS\n")
    (qa / "g.md").write_text("Overall: ❌ FAIL ✅ PASS")
    assert {r.file: r.passed for r in s.load_qa(spark, str(qa)).collect()} == {"f.md": True, "g.md": False}
    assert s.time_column(["x", "ts_open", "ts"]) == "ts" and s.time_column(["x"]) is None


def test_times_and_last_revisions(spark):
    df = spark.createDataFrame(
        [(1709251200, 1, 1, "e", " btc ", 1.0), (1709251195000, 2, 1, "e", "BTC", 2.0), (1709251200000000, 3, 1, "e", "BTC", float("nan")), (None, 4, 9, "e", "BTC", 4.0), (1709337600000000, 5, None, "e", "BTC", 5.0)],
        "ts_open bigint, bar_id bigint, load_id int, exchange string, symbol string, close double",
    )
    assert {r[0] for r in df.select(micros(df.ts_open)).collect()} == {1709251200000000, 1709251195000000, 1709337600000000, None}
    assert {str(r[0]) for r in df.select(bar_day(df.ts_open)).collect()} == {"2024-03-01", "2024-03-02", "None"}
    got = {str(r.day): r.close for r in latest_per_day(df, "close").collect()}
    assert got == {"2024-03-01": None, "2024-03-02": 5.0}


def test_a_crash_between_data_and_manifest_neither_doubles_nor_loses(spark, tmp_path, monkeypatch):
    def fail(*_):
        raise RuntimeError("killed")

    root, st = str(tmp_path / "raw"), s.FeatureStore(spark, str(tmp_path / "store"))
    bars = spark.createDataFrame([BAR, (*BAR[:1], *BAR[1:-1], "ETHUSDT")], OHLCV_1D)
    s.write_raw(bars.limit(1), root)
    with monkeypatch.context() as m:
        write = s._write_raw_data
        m.setattr(s, "_write_raw_data", lambda *a: (write(*a), fail()))
        with pytest.raises(RuntimeError):
            s.write_raw(bars, root)
    assert s.load_raw(spark, root).count() == 2  # the data are there, but not known to be
    s.write_raw(bars, root)
    s.write_raw(bars, root)
    s.write_raw(bars, root)
    assert s.load_raw(spark, root).count() == 2

    with monkeypatch.context() as m:
        m.setattr(s.FeatureStore, "_commit", fail)
        with pytest.raises(RuntimeError):
            st.write(features(spark, ("2024-01-01", 1.0), ("2024-01-02", 2.0)), "mom")
    st.write(features(spark, ("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-03", 3.0)), "mom")
    assert st.read().count() == 3
    with monkeypatch.context() as m:
        m.setattr(s.FeatureStore, "_commit", fail)
        with pytest.raises(RuntimeError):
            st.write(features(spark, ("2024-01-04", 4.0)), "mom")
    st.write(features(spark, ("2024-01-04", 4.0)), "mom")
    assert [r.value for r in st.load("f", "007").collect()] == [1.0, 2.0, 3.0, 4.0]


def test_the_shared_folder_is_cleaned(spark):
    import os

    from panelforge import session

    session.materialize(spark.range(3), "x").count()
    path = f"{session.shared_dir(spark)}/panelforge".removeprefix("file:")
    assert os.listdir(path)
    session.clean(spark)
    assert not os.path.exists(path)
