import glob
import math

import pytest
from pyspark.sql import functions as F

from panelforge.operators import compaction as c

COLS = ["a", "b", "s"]
SCHEMA = "a bigint, b double, s string, id bigint, extra int, ID2 string"
NAN = float("nan")


def rows(spark, data):
    return spark.createDataFrame([(*r, 7, "x") for r in data], SCHEMA)


def run(df, tmp_path, **kw):
    done = c.compact(df, COLS, "id", ["s"], ["s", "a"], path=str(tmp_path / "out"), **kw)
    return done, df.sparkSession.read.schema("a bigint, b double, s string, id bigint").parquet(done.path)


def test_each_record_once_with_its_smallest_id(spark, tmp_path):
    df = rows(spark, [(1, 1.0, "x", 5), (1, 1.0, "x", 3), (1, 1.0, "x", 9), (2, NAN, "x", 4), (2, NAN, "x", 6), (2, None, "x", 7), (None, None, None, 8), (None, None, None, 10)])
    done, out = run(df, tmp_path)
    assert done.source_rows == 8 and done.records == 4 and done.copies == 4
    got = sorted(out.collect(), key=lambda r: r.id)
    assert [r.id for r in got] == [3, 4, 7, 8]
    assert math.isnan(got[1].b) and got[2].b is None  # NaN and null are two records
    assert {r.id for r in c.copies(df, out, "id").collect()} == {5, 6, 9, 10}


def test_a_record_that_is_a_third_of_all_rows(spark, tmp_path):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"), F.lit(1.0).alias("b"), F.lit("s").alias("s"), F.col("id"), F.lit(1).alias("extra"), F.lit("y").alias("ID2")
    )
    done, out = run(df, tmp_path)
    assert done.records == 20_001 == out.count()
    assert c.copies(df, out, "id").count() == 9_999


def test_empty_table_commits_the_schema(spark, tmp_path):
    done, out = run(rows(spark, []), tmp_path)
    assert done.source_rows == 0 and out.count() == 0


def test_files_are_merged_toward_the_target(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").alias("a"), F.rand(1).alias("b"), F.lit("s").alias("s"), "id", F.lit(1).alias("extra"), F.lit("y").alias("ID2")).repartition(40)
    done, _ = run(df, tmp_path, target_bytes=64 * 1024 * 1024)
    assert done.files == len(glob.glob(f"{done.path}/*.parquet")) <= 2


def test_a_lost_row_is_not_committed(spark, tmp_path, monkeypatch):
    df = rows(spark, [(i, 1.0, "x", i) for i in range(10)])
    keep = c.distinct_records
    monkeypatch.setattr(c, "distinct_records", lambda *a, **k: keep(*a, **k).filter("id <> 3"))
    with pytest.raises(c.ChecksumMismatch):
        run(df, tmp_path)
    assert not (tmp_path / "out").exists()


def test_commit_never_overwrites(spark, tmp_path):
    (tmp_path / "out").mkdir()
    with pytest.raises(FileExistsError):
        run(rows(spark, [(1, 1.0, "x", 1)]), tmp_path)


def test_file_report(spark):
    df = spark.createDataFrame([("e", " ab ", 10, True), ("e", "AB", 500, True), ("e", "ab", 5, None), ("e", "ab", None, True)], "exchange string, symbol string, n_bytes bigint, committed boolean")
    r = c.file_report(df, 400).first()
    assert (r.symbol, r.n_files, r.n_uncommitted, r.n_bytes, r.n_small, r.n_planned) == ("AB", 3, 1, 510, 2, 2)
