"""Consolidating very many tiny files into few well-sized ones.

The records are deduplicated by content with a map-side combining aggregate,
shuffled under the adaptive REBALANCE hint (runtime statistics merge small
output partitions and split large ones near the target size), staged, compared
with the source by a multiset checksum, and only then committed by a rename.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import conf, shared_table


class ChecksumMismatch(RuntimeError):
    """Staged files do not hold the expected multiset of records; nothing was committed."""


@dataclass(frozen=True)
class Compaction:
    path: str
    source_rows: int
    records: int
    files: int

    @property
    def copies(self) -> int:
        return self.source_rows - self.records


def _fingerprint(columns: list[str], salt: int):
    """64 bits of a record; a bit per column tells null from value, which the hash alone would skip."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(F.lit(salt), nulls, *columns)


def _checksum(df: DataFrame, columns: list[str]) -> list:
    """Count, two sums and an exclusive-or of the records' fingerprints: equal for equal multisets, in any order."""
    big = lambda x: F.sum(x.cast("decimal(38,0)"))
    prints = df.select(_fingerprint(columns, 1).alias("a"), _fingerprint(columns, 2).alias("b"))
    return list(prints.agg(F.count("*"), big(F.col("a")), big(F.col("b")), F.expr("bit_xor(a)")).first())


def distinct_records(df: DataFrame, columns: list[str], order: str, carry: list[str] = ()) -> DataFrame:
    """Each distinct record once, with the smallest ``order`` of its copies.

    Equality is of stored values: null equals null, NaN equals NaN, null does
    not equal NaN. Partial aggregation folds copies before the shuffle, so a
    record that makes up a third of the rows costs one row a task.
    ``carry`` columns come from the kept copy.
    """
    if carry:
        kept = df.groupBy(*columns).agg(F.min_by(F.struct(order, *carry), order).alias("_kept"))
        return kept.select(*columns, *[F.col(f"_kept.{c}").alias(c) for c in [order, *carry]])
    return df.groupBy(*columns).agg(F.min(order).alias(order))


def compact(
    df: DataFrame,
    columns: list[str],
    order: str,
    cluster: list[str],
    sort: list[str],
    path: str | None = None,
    target_bytes: int | None = None,
) -> Compaction:
    """Write the distinct records of ``df`` into few well-sized files and return where they are.

    :param columns: the columns that make a record; ``order`` (unique) picks the kept copy.
    :param cluster: rows of equal keys go to the same files unless these grow past the target (then AQE splits them).
    :param sort: order inside each file, for min/max pruning.
    :param path: the committed folder; a fresh one in the shared folder by default.
    :param target_bytes: advisory partition size; the session's own when None.

    An empty table commits an empty folder with the schema. Nulls are values
    like any other. Other columns of ``df``, whatever their names, are left out.
    The expected checksum is taken from fingerprints of the source alone, on a
    plan apart from the rewrite, so a row lost or doubled on the way shows.
    """
    spark = df.sparkSession
    path = path or shared_table(spark, "compacted")
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    narrow = df.select(*columns, order)
    options = {"spark__sql__adaptive__advisoryPartitionSizeInBytes": str(target_bytes)} if target_bytes else {}
    with conf(spark, spark__sql__adaptive__enabled="true", **options):
        kept = distinct_records(narrow, columns, order)
        rebalanced = spark.sql(f"SELECT /*+ REBALANCE({', '.join(cluster)}) */ * FROM {{kept}}", kept=kept)
        rebalanced.sortWithinPartitions(*sort).write.option("compression", "zstd").parquet(staged)

    source = narrow.select(_fingerprint(columns, 1).alias("a"), _fingerprint(columns, 2).alias("b"))
    big = lambda x: F.sum(F.col(x).cast("decimal(38,0)"))
    once = source.groupBy("a", "b").agg(F.count("*").alias("n"))
    rows, *expected = once.agg(F.sum("n"), F.count("*"), big("a"), big("b"), F.expr("bit_xor(a)")).first()
    written = spark.read.schema(narrow.schema).parquet(staged)
    found = _checksum(written, columns)
    if found != expected:
        raise ChecksumMismatch(f"staged {found}, expected {expected}; left in {staged}")
    files = _rename(spark, staged, path)
    return Compaction(path, rows or 0, expected[0], files)


def _rename(spark: SparkSession, staged: str, path: str) -> int:
    """Commit by one rename; returns the number of data files."""
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(dst):
        raise FileExistsError(path)
    if not fs.rename(src, dst):
        raise OSError(f"could not rename {staged} to {path}")
    return sum(x.getPath().getName().endswith(".parquet") for x in fs.listStatus(dst))


def copies(source: DataFrame, compacted: DataFrame, order: str) -> DataFrame:
    """The rows that a compaction folded into another: ``order`` values of the source that its output lacks.

    Both sides are keyed by the unique ``order``, so neither is skewed however
    many copies a record has. A null ``order`` names no row and is left out.
    """
    return source.select(order).filter(F.col(order).isNotNull()).join(compacted.select(order), order, "left_anti")


def file_report(files: DataFrame, target_bytes: int) -> DataFrame:
    """Per exchange and symbol: how many files there are and how many there should be.

    Files that are not committed (false or null) are counted apart and not
    planned for. A null size counts as zero bytes.
    """
    size = F.coalesce("n_bytes", F.lit(0))
    done = F.coalesce("committed", F.lit(False))
    return (
        files.groupBy("exchange", F.upper(F.trim("symbol")).alias("symbol"))
        .agg(
            F.count(F.when(done, 1)).alias("n_files"),
            F.count(F.when(~done, 1)).alias("n_uncommitted"),
            F.sum(F.when(done, size).otherwise(0)).alias("n_bytes"),
            F.sum(F.when(done & (size < target_bytes / 2), 1).otherwise(0)).alias("n_small"),
        )
        .withColumn("n_planned", F.when(F.col("n_files") > 0, F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / target_bytes))).otherwise(0).cast("bigint"))
    )
