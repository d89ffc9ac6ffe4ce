"""The feature store: hive-partitioned parquet, written idempotently, read with pruning.

Spark marks a whole job, not a partition, as done, so completed partitions are
kept in a manifest table beside the data; planning is an anti-join on it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FEATURE_ROW, OHLCV_1D, validate
from ..session import materialize

#: Time columns in order of preference.
TIME_COLUMNS = ("ts_utc", "ts", "timestamp", "ts_open")
_MANIFEST = "feature_id string, version string, asset string, day date"
_PART = "feature_family string, feature_id string, version string, asset string, year int, ts bigint, value double"


def raw_partitions(bars: DataFrame, data_type: str = "ohlcv_1d") -> DataFrame:
    """Bars with their partition columns data_type, year, month and day."""
    at = F.timestamp_micros("ts_open")
    return bars.withColumns({"data_type": F.lit(data_type), "year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "dd")})


_RAW_KEYS = ["exchange", "data_type", "symbol", "year", "month", "day"]


def _manifest_of(root: str) -> str:
    return f"{root.rstrip('/')}.manifest"


def write_raw(bars: DataFrame, root: str, data_type: str = "ohlcv_1d") -> None:
    """Append-only raw layout exchange/data_type/symbol/year/month/day; a partition that is complete stays as it is.

    Complete is what the manifest beside ``root`` lists, and it lists a
    partition only after its data are written: a second write of the same bars
    changes no byte, and a write that was cut short is written anew, over
    whatever it left behind.
    """
    spark = bars.sparkSession
    bars = raw_partitions(validate(bars, data_type), data_type)
    if _exists(spark, _manifest_of(root)):
        bars = bars.join(spark.read.schema(", ".join(f"{k} string" for k in _RAW_KEYS)).parquet(_manifest_of(root)).distinct(), _RAW_KEYS, "left_anti")
    bars = materialize(bars, "raw-bars")  # the same rows for the data and for the manifest
    _write_raw_data(bars, root)
    bars.select(*_RAW_KEYS).distinct().coalesce(1).write.mode("append").parquet(_manifest_of(root))


def _write_raw_data(bars: DataFrame, root: str) -> None:
    out = bars.repartition("exchange", "symbol", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.option("compression", "zstd").partitionBy(*_RAW_KEYS).parquet(root)


def load_raw(spark: SparkSession, root: str, exchange: str | None = None, symbol: str | None = None, d0: str | None = None, d1: str | None = None) -> DataFrame | None:
    """Bars of a date range, both ends included, pruned by partition; None if there is nothing."""
    if not _exists(spark, root):
        return None
    df = spark.read.option("basePath", root).parquet(root).withColumns({c: F.col(c).cast("string") for c in ("exchange", "symbol", "data_type")})
    return prune(df, exchange, symbol, d0, d1)


def prune(df: DataFrame, exchange: str | None, symbol: str | None, d0: str | None, d1: str | None) -> DataFrame:
    if exchange is not None:
        df = df.filter(F.col("exchange") == exchange)
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    day = F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int"))
    if d0 is not None:
        df = df.filter((F.col("year").cast("int") >= int(d0[:4])) & (day >= F.lit(d0).cast("date")))
    if d1 is not None:
        df = df.filter((F.col("year").cast("int") <= int(d1[:4])) & (day <= F.lit(d1).cast("date")))
    return df


def time_column(columns: list[str]) -> str | None:
    """The preferred time column among those there are."""
    return next((c for c in TIME_COLUMNS if c in columns), None)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class FeatureStore:
    """Features under one root: ``data`` partitioned by family, feature, version, asset and year, and ``manifest``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.data, self.manifest = f"{self.root}/data", f"{self.root}/manifest"

    def write(self, features: DataFrame, family: str = "misc", overwrite: bool = False) -> None:
        """Commit rows (ts, feature_id, version, asset, value); null values are not stored.

        Days that the manifest has are left alone unless ``overwrite``. The
        years the rows fall in are rewritten as a whole by dynamic partition
        overwrite, with those rows of theirs that are done kept. Data first,
        manifest after: a crash in between repeats the work, over what it left
        behind, and neither loses nor doubles a row.
        """
        rows = features.select(*FEATURE_ROW.names).filter(F.col("value").isNotNull())
        rows = rows.withColumn("day", F.to_date(F.timestamp_micros("ts")))
        keys = ["feature_id", "version", "asset", "day"]
        done = self._done()
        if not overwrite:
            rows = rows.join(done, keys, "left_anti")
        fresh = materialize(rows.withColumns({"feature_family": F.lit(family), "year": F.year("day")}), "feature-days")
        out = fresh
        if _exists(self.spark, self.data):
            touched = fresh.select("feature_id", "version", "asset", "year").distinct()
            old = self.read().filter(F.col("feature_family") == family).withColumn("day", F.to_date(F.timestamp_micros("ts")))
            kept = old.join(touched, ["feature_id", "version", "asset", "year"], "left_semi").join(done, keys, "left_semi").join(fresh.select(*keys).distinct(), keys, "left_anti")
            out = materialize(fresh.unionByName(kept.select(fresh.columns)), "feature-rows")  # a rewrite must not read what it replaces
        self._write_data(out)
        self._commit(fresh.select(*keys).distinct().join(done, keys, "left_anti"))

    def _write_data(self, rows: DataFrame) -> None:
        out = rows.drop("day").repartition("feature_id", "asset", "year").sortWithinPartitions("feature_id", "asset", "ts")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("feature_family", "feature_id", "version", "asset", "year").parquet(self.data)

    def _commit(self, days: DataFrame) -> None:
        days.coalesce(1).write.mode("append").parquet(self.manifest)

    def _done(self) -> DataFrame:
        if not _exists(self.spark, self.manifest):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(self.manifest).distinct()

    def read(self) -> DataFrame:
        if not _exists(self.spark, self.data):
            return self.spark.createDataFrame([], _PART)
        return self.spark.read.schema(_PART).option("basePath", self.data).parquet(self.data)

    def view(self, name: str = "features") -> None:
        self.read().createOrReplaceTempView(name)

    def query(self, sql: str, **args) -> DataFrame:
        """Any SQL over the view ``features``, with bound parameters."""
        return sql_over(self.read(), sql, **args)

    def load(self, feature_id: str, asset: str, version: str = "v1", d_from: str | None = None, d_to: str | None = None) -> DataFrame:
        """(ts, value) in time order, both dates included, ts as a timestamp."""
        return load_slice(self.read(), feature_id, asset, version, d_from, d_to)

    def signal(self, feature_id: str, asset: str, recompute) -> tuple[DataFrame, str]:
        """The stored feature, or else ``recompute()``, and which of the two it is."""
        stored = self.read().filter((F.col("feature_id") == feature_id) & (F.col("asset") == asset))
        if stored.limit(1).count():
            return stored.select("ts", "value"), "store"
        return recompute(), "recomputed"

    def missing(self, plan: DataFrame) -> DataFrame:
        """What of a plan (feature_id, version, asset, day) is not done yet."""
        return plan.join(self._done(), ["feature_id", "version", "asset", "day"], "left_anti")


def sql_over(features: DataFrame, sql: str, **args) -> DataFrame:
    """Any SQL over the view ``features``, with bound parameters."""
    features.createOrReplaceTempView("features")
    return features.sparkSession.sql(sql, args=args or None)


def load_slice(features: DataFrame, feature_id: str, asset: str, version: str = "v1", d_from: str | None = None, d_to: str | None = None) -> DataFrame:
    df = features.filter((F.col("feature_id") == feature_id) & (F.col("asset") == asset) & (F.col("version") == version))
    if "year" in features.columns:  # prunes at the scan, which ts alone does not
        df = df.filter(F.col("year").between(int(d_from[:4]) if d_from else -9999, int(d_to[:4]) if d_to else 9999))
    if d_from is not None:
        df = df.filter(F.col("ts") >= F.unix_micros(F.lit(d_from).cast("timestamp")))
    if d_to is not None:
        df = df.filter(F.col("ts") < F.unix_micros(F.lit(d_to).cast("timestamp") + F.expr("interval 1 day")))
    return df.orderBy("ts").select("ts", F.timestamp_micros("ts").alias("at"), "value")


def klines(rows: Column) -> list[Column]:
    """The columns of a bar from a positional kline array of strings (times in milliseconds)."""
    at = lambda i, kind: F.get(rows, F.lit(i)).cast(kind)
    return [
        (at(0, "bigint") * 1000).alias("ts_open"), (at(6, "bigint") * 1000).alias("ts_close"),
        at(1, "double").alias("open"), at(2, "double").alias("high"), at(3, "double").alias("low"), at(4, "double").alias("close"),
        at(5, "double").alias("volume"), at(7, "double").alias("quote_vol"), at(8, "bigint").alias("n_trades"), at(9, "double").alias("taker_buy_vol"),
    ]


def from_klines(df: DataFrame, column: str = "kline") -> DataFrame:
    """Bars of the registered schema from (exchange, symbol, ``column``: array of strings)."""
    out = df.select(*klines(F.col(column)), "exchange", "symbol")
    return out.select(*[F.col(f.name).cast(f.dataType) for f in OHLCV_1D])


def fetch_pages(get, start_ms: int, end_ms: int, limit: int = 1000, pause=lambda: None):
    """All pages of a kline source: ``get(start_ms, limit)`` is asked from the last close time on, until a short or empty page."""
    cursor = start_ms
    while cursor <= end_ms:
        page = get(cursor, limit)
        if not page:
            return
        yield [r for r in page if int(r[0]) <= end_ms]
        if len(page) < limit:
            return
        cursor = int(page[-1][6]) + 1
        pause()


def report_json(summary_rows: list[dict], digits: int = 4) -> str:
    """A report as JSON: floats rounded, what is no number written as "nan"."""

    def clean(v):
        if isinstance(v, dict):
            return {str(k): clean(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [clean(x) for x in v]
        if v is None or (isinstance(v, float) and v != v):
            return "nan"
        return round(v, digits) if isinstance(v, float) else v

    return json.dumps(clean(summary_rows), indent=2)


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, h, ic_mean, icir) of the JSON reports in a folder, "nan" read as null."""
    schema = "feature_id string, ic_mean map<string,string>, icir map<string,string>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    number = lambda m: F.expr(f"try_cast(nullif({m}[h], 'nan') AS double)").alias(m)
    return df.select("feature_id", "ic_mean", "icir", F.explode(F.map_keys("ic_mean")).alias("h")).select("feature_id", F.col("h").cast("int").alias("h"), number("ic_mean"), number("icir"))


def load_qa(spark: SparkSession, path: str, mark: str = "Overall: ✅ PASS") -> DataFrame:
    """(file, passed) of the quality reports in a folder."""
    df = spark.read.option("wholetext", True).text(path)
    return df.select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), F.contains("value", F.lit(mark)).alias("passed"))
