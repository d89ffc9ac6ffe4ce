"""Exact column profiles of every load of a table, and how loads drift apart.

Every value of every column is unpivoted into (column, key, load), where the key
is a 64-bit integer in the order of the values. Bounds cut each column into
ranges; a range is one sorted group. Counts of the ranges before it (the prefix
counts) turn positions inside a range into exact global positions, so quantiles,
distinct counts and the most frequent value are exact, and the merged cumulative
curves of the loads give exact Kolmogorov-Smirnov distances.

The table is read once for its numbers: tasks sort what they read into runs and
write these, and bounds, counts and ranges come from the runs.

Values travel as sorted runs (key, load, count) in array columns: a value that
fills a third of the table is one run a batch, and no row is a JVM object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Evenly spaced keys a full pack of runs gives to place the range bounds; they steer the balance of the work, never a result.
BOUND_POINTS = 64
#: Aimed-at values of a range, and rows a map task packs at once.
RANGE_VALUES, PACK_ROWS = 400_000, 400_000
#: Stands for a null load in arrays; it comes out as null again.
NO_LOAD = -(2**31)
#: No earlier load has the column.
NO_PRIOR = 2**31 - 1
QUANTILES = (0.25, 0.5, 0.75)

_NUMERIC = {"double": "f", "float": "f", "long": "i", "integer": "i", "short": "i", "byte": "i", "boolean": "i", "timestamp": "i", "date": "i"}
_RUNS = "column_name string, bucket int, keys array<bigint>, loads array<int>, counts array<bigint>"
_PACKED = "column_name string, n bigint, points array<bigint>, keys array<bigint>, loads array<int>, counts array<bigint>"
_COUNTS = "column_name string, bucket int, load int, n bigint"
_PART = "column_name string, load int, n bigint, n_distinct bigint, lo bigint, hi bigint, top bigint, q25 bigint, q50 bigint, q75 bigint, up double, down double, prev double, whole_up double, whole_down double"


def to_keys(x: np.ndarray) -> np.ndarray:
    """Order-preserving int64 keys; -0.0 and 0.0 share one."""
    if x.dtype.kind == "f":
        bits = (x.astype(np.float64) + 0.0).view(np.int64)
        return np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits)
    return x.astype(np.int64)


def _bits_to_double(bits: Column) -> Column:
    """IEEE 754 bits to a double with integer arithmetic only (no built-in exists)."""
    sign = F.when(bits < 0, -1.0).otherwise(1.0)
    exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(2047))
    mantissa = bits.bitwiseAND(F.lit((1 << 52) - 1))
    # scaled in two steps so that subnormal and the largest values stay in range
    whole = F.when(exponent == 0, mantissa).otherwise(mantissa + F.lit(1 << 52)).cast("double")
    power = F.when(exponent == 0, F.lit(1)).otherwise(exponent) - 1075
    half = F.floor(power / 2)
    return F.when(exponent == 2047, sign * F.lit(float("inf"))).otherwise(sign * whole * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half))


def _kinds(df: DataFrame, columns: list[str]) -> dict[str, str]:
    return {c: _NUMERIC[k] for c in columns if (k := df.schema[c].dataType.typeName()) in _NUMERIC}


def _flat(df: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """The load as an int without nulls and the numeric columns, times as microseconds or days, booleans as 0 and 1."""
    out = [F.coalesce(F.col(load).cast("int"), F.lit(NO_LOAD)).alias("_load")]
    for i, c in enumerate(columns):
        kind, x = df.schema[c].dataType.typeName(), F.col(c)
        x = F.unix_micros(x) if kind == "timestamp" else F.unix_date(x) if kind == "date" else x.cast("int") if kind == "boolean" else x
        out.append(x.alias(f"_c{i}"))
    return df.select(*out)


def _values(table: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and loads of the values of column i that are neither null nor NaN."""
    col = table.column(f"_c{i}")
    keep = pc.invert(col.is_null(nan_is_null=True))
    return to_keys(col.filter(keep).to_numpy()), table.column("_load").filter(keep).to_numpy()


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= PACK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def runs(keys: np.ndarray, loads: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key, then load, equal pairs folded into one with their count."""
    order = np.lexsort((loads, keys))
    keys, loads = keys[order], loads[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (loads[1:] != loads[:-1])]) if len(keys) else np.zeros(0, int)
    n = np.diff(np.r_[first, len(keys)]) if counts is None else np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
    return keys[first], loads[first], n.astype(np.int64)


def _lists(*columns: np.ndarray) -> list[pa.ListArray]:
    """Each array as the one list of its column."""
    return [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in columns]


def _packer(columns: list[str]):
    """One row a column and pack: its values as sorted runs, and some of them, evenly spaced."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _packs(batches):
            for i, c in enumerate(columns):
                keys, loads = _values(t, i)
                if not len(keys):
                    continue
                total = len(keys)
                keys, loads, n = runs(keys, loads)
                take = max(1, BOUND_POINTS * total // PACK_ROWS)
                points = keys[np.searchsorted(np.cumsum(n), (np.arange(take) + 0.5) * total / take)]
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([total], pa.int64()), *_lists(points, keys, loads.astype(np.int32), n)], names=[x.split()[0] for x in _PACKED.split(", ")])

    return pack


def _unlist(batch: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
    return [batch.column(c)[row].values.to_numpy() for c in names]


def _counter(bounds: dict[str, np.ndarray]):
    """Values by column, range and load, added up over the packs of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int, int], int] = {}
        for b in batches:
            for row, c in enumerate(b.column("column_name").to_pylist()):
                keys, loads, n = _unlist(b, row, "keys", "loads", "counts")
                both = np.searchsorted(bounds[c], keys, side="right").astype(np.int64) << 32 | (loads.astype(np.int64) - NO_LOAD)
                groups, at = np.unique(both, return_inverse=True)
                for k, m in zip(groups.tolist(), np.bincount(at, n).astype(np.int64).tolist(), strict=True):
                    where = (c, k >> 32, (k & 0xFFFFFFFF) + NO_LOAD)
                    total[where] = total.get(where, 0) + m
        if total:
            c, r, l = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(r, pa.int32()), pa.array(l, pa.int32()), pa.array(list(total.values()), pa.int64())], names=["column_name", "bucket", "load", "n"])

    return count


def _cutter(bounds: dict[str, np.ndarray]):
    """The runs of each pack, cut into ranges."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, c in enumerate(b.column("column_name").to_pylist()):
                keys, loads, n = _unlist(b, row, "keys", "loads", "counts")
                cuts = np.r_[0, np.searchsorted(keys, bounds[c], side="left"), len(keys)]
                at = [k for k in range(len(cuts) - 1) if cuts[k + 1] > cuts[k]]
                ends = pa.array(np.r_[[cuts[k] for k in at], cuts[at[-1] + 1]].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (keys, loads, n)]
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(at)), pa.array(at, pa.int32()), *lists], names=["column_name", "bucket", "keys", "loads", "counts"])

    return cut


def _bounds(packed: DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    """Keys that cut each column into ranges of about RANGE_VALUES, from the packs' points; a row a column comes to the driver."""
    out = {c: np.zeros(0, np.int64) for c in columns}
    sizes = packed.groupBy("column_name").agg(F.sum("n").alias("n")).collect()
    for ranges in {-(-r.n // RANGE_VALUES) for r in sizes} - {1}:
        wide = [r.column_name for r in sizes if -(-r.n // RANGE_VALUES) == ranges]
        points = packed.filter(F.col("column_name").isin(wide)).select("column_name", F.explode("points").alias("p"))
        at = F.percentile_approx("p", [float(k) / ranges for k in range(1, ranges)], max(10_000, 10 * ranges))
        for r in points.groupBy("column_name").agg(at.alias("cuts")).collect():
            out[r.column_name] = np.unique(np.array(r.cuts, np.int64))
    return out


def _range_profile(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """One range of one column: ``left`` its runs, ``right`` per load the values before, in and over all ranges."""
    name = key[0].as_py()
    flat = lambda c: left.column(c).combine_chunks().flatten().to_numpy() if left.num_rows else np.zeros(0, np.int64)
    keys, loads, n = runs(flat("keys"), flat("loads"), flat("counts"))
    ids = right.column("load").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    before, total, prior, rows = (right.column(c).to_numpy()[order] for c in ("before", "total", "prior", "rows"))
    all_before, all_total, all_rows = before.sum(), total.sum(), right.column("all_rows").to_numpy()[0]

    ends = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(0, int)
    group = np.searchsorted(ends, np.arange(len(keys)))
    upto = np.cumsum(n)[ends] if len(keys) else np.zeros(0, np.int64)  # values up to the end of each group of equal keys
    by = np.argsort(loads, kind="stable")
    cut = np.searchsorted(loads[by], np.r_[ids, ids[-1] + 1])
    inside = [by[cut[i] : cut[i + 1]] for i in range(len(ids))]
    curve = [before[i] + np.cumsum(n[x]) for i, x in enumerate(inside)]  # of each load, at its own runs
    where = {int(l): i for i, l in enumerate(ids)}
    all_end = (all_before + (upto[-1] if len(upto) else 0)) / all_total
    out = []
    for i, x in enumerate(inside):
        at_all = (all_before + upto[group[x]]) / all_total
        before_all = (all_before + np.where(group[x] > 0, upto[group[x] - 1], 0)) / all_total
        mine = curve[i] / total[i]
        mine_before = np.r_[before[i], curve[i][:-1]] / total[i]
        end = (curve[i][-1] if len(x) else before[i]) / total[i]
        up = (mine - at_all).max(initial=0.0)
        down = max(0.0, (before_all - mine_before).max(initial=0.0), all_end - end)
        # the same curves over all rows: missing values lie beyond the greatest
        have, have_all = total[i] / rows[i], all_total / all_rows
        whole_up = (mine * have - at_all * have_all).max(initial=end * have - all_end * have_all)
        whole_down = max((before_all * have_all - mine_before * have).max(initial=0.0), all_end * have_all - end * have)
        q = []
        for p in QUANTILES:  # the value of rank ceil(p * n), counted from one
            rank = max(1, int(np.ceil(p * total[i])))
            j = np.searchsorted(curve[i], rank)
            q.append(int(keys[x[j]]) if before[i] < rank and j < len(x) else None)
        prev, p = None, where.get(int(prior[i]))
        if p is not None:
            y = inside[p]
            a = np.r_[curve[i], before[i]]
            b = np.r_[curve[p], before[p]]
            # index -1 is "before any run of this range"
            at_x = np.abs(mine - b[np.searchsorted(group[y], group[x], side="right") - 1] / total[p]).max(initial=0.0)
            at_y = np.abs(curve[p] / total[p] - a[np.searchsorted(group[x], group[y], side="right") - 1] / total[i]).max(initial=0.0)
            prev = float(max(at_x, at_y))
        out.append((name, int(ids[i]), int(n[x].sum()), len(x), int(keys[x[0]]) if len(x) else None, int(keys[x[-1]]) if len(x) else None, int(n[x].max(initial=0)), *q, float(up), float(down), prev, float(whole_up), float(whole_down)))
    cols = list(zip(*out, strict=True))
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 8, *[pa.float64()] * 5]
    names = [f.split()[0] for f in _PART.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def numeric_profile(df: DataFrame, load: str, columns: list[str], rows: DataFrame) -> DataFrame:
    """Exact order statistics per (column, load): n, n_distinct, min, max, quartiles, most frequent count, KS distances.

    :param rows: (``load``, n_rows), one row a load.

    Quantile p is the value of rank ceil(p·n). ``ks_rest`` is the distance to
    all other loads together (null where there are none), ``ks_prev`` to the
    load with values of that column that comes before it by id; ``ks_all`` is
    that to the other loads when missing values count as well, as greater than
    any.
    """
    kinds = _kinds(df, columns)
    packed = materialize(_flat(df, load, columns).mapInArrow(_packer(columns), _PACKED), "profile-runs")
    bounds = _bounds(packed, columns)
    of_load = rows.select(F.coalesce(F.col(load).cast("int"), F.lit(NO_LOAD)).alias("load"), F.col("n_rows").alias("rows"))
    of_load = of_load.withColumn("all_rows", F.sum("rows").over(Window.partitionBy(F.lit(1))))  # one row a load
    sides = packed.select("column_name", "keys", "loads", "counts")
    counts = sides.mapInArrow(_counter(bounds), _COUNTS).groupBy("column_name", "bucket", "load").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "profile-counts")
    # every (column, load) in every range of the column: ranges and loads are few, values are not among the rows
    totals = counts.groupBy("column_name", "load").agg(F.sum("n").alias("total"))
    totals = totals.withColumn("prior", F.coalesce(F.lag("load").over(Window.partitionBy("column_name").orderBy("load")), F.lit(NO_PRIOR)))
    totals = totals.join(of_load, "load")
    grid = totals.join(counts.select("column_name", "bucket").distinct(), "column_name").join(counts, ["column_name", "bucket", "load"], "left")
    w = Window.partitionBy("column_name", "load").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = grid.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    part = sides.mapInArrow(_cutter(bounds), _RUNS).groupBy("column_name", "bucket").cogroup(prefix.groupBy("column_name", "bucket")).applyInArrow(_range_profile, _PART)
    part = part.join(of_load.select("load", F.col("rows").alias("n_load"), F.col("all_rows").alias("n_every")), "load")
    per = part.groupBy("column_name", "load").agg(
        F.sum("n").alias("n_values"), F.sum("n_distinct").alias("n_distinct"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top").alias("top"),
        *[F.max(q).alias(q) for q in ("q25", "q50", "q75")], F.greatest(F.max("up"), F.max("down")).alias("d"), F.max("prev").alias("ks_prev"),
        F.greatest(F.max("whole_up"), F.max("whole_down")).alias("w"), F.max("n_load").alias("n_load"), F.max("n_every").alias("n_every"),
    )
    per = materialize(per, "profile")  # a row a column and load; read twice from here on
    everything = per.groupBy("column_name").agg(F.sum("n_values").alias("_all"))
    per = per.join(F.broadcast(everything), "column_name")  # one row a column
    floats = [c for c in columns if kinds[c] == "f"]
    value = lambda k: F.when(F.col("column_name").isin(floats), _bits_to_double(F.when(F.col(k) < 0, F.lit(-(2**63)) - F.col(k) - 1).otherwise(F.col(k)))).otherwise(F.col(k).cast("double"))
    return per.select(
        F.when(F.col("load") != NO_LOAD, F.col("load")).alias(load), "column_name", "n_values", "n_distinct",
        value("lo").alias("min_value"), value("q25").alias("q25"), value("q50").alias("median"), value("q75").alias("q75"), value("hi").alias("max_value"),
        F.col("top").alias("top_count"),
        F.when(F.col("_all") > F.col("n_values"), F.col("d") * F.col("_all") / (F.col("_all") - F.col("n_values"))).alias("ks_rest"),
        "ks_prev",
        F.when(F.col("n_every") > F.col("n_load"), F.col("w") * F.col("n_every") / (F.col("n_every") - F.col("n_load"))).alias("ks_all"),
    )


def string_profile(df: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """n_values, n_distinct, top_count and the smallest and greatest string per (column, load); values fold map-side first."""
    pairs = df.select(F.col(load).cast("int").alias("_load"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in columns])).alias("p"))
    values = pairs.filter(F.col("p.v").isNotNull()).groupBy("_load", "p.column_name", "p.v").agg(F.count("*").alias("n"))
    return values.groupBy(F.col("_load").alias(load), "column_name").agg(
        F.sum("n").alias("n_values"), F.count("*").alias("n_distinct"), F.min("v").alias("min_text"), F.max("v").alias("max_text"), F.max("n").alias("top_count")
    )


def shares(df: DataFrame, load: str, columns: list[str], patterns: dict[str, Column] | None = None) -> DataFrame:
    """Per (column, load) in one map-side combining pass: rows, missing, zero, negative, whole and pattern-violating values.

    ``patterns`` maps a column to the condition its values must meet; a value
    for which it is null counts as meeting it.
    """
    patterns, aggs, packed = patterns or {}, [F.count("*").alias("n_rows")], []
    for i, c in enumerate(columns):
        kind, x = df.schema[c].dataType.typeName(), F.col(c)
        number = kind in ("double", "float", "long", "integer", "short", "byte", "decimal")
        have = x.isNotNull() & ~F.isnan(x) if kind in ("double", "float") else x.isNotNull()
        tests = {"missing": ~have}
        if number:
            tests |= {"zero": have & (x == 0), "negative": have & (x < 0), "whole": have & (x == F.floor(x)) if kind in ("double", "float") else have}
        if c in patterns:
            tests["bad"] = have & ~F.coalesce(patterns[c], F.lit(True))
        for k in ("missing", "zero", "negative", "whole", "bad"):
            aggs.append((F.count(F.when(tests[k], 1)) if k in tests else F.lit(None).cast("bigint")).alias(f"{k}_{i}"))
        packed.append(F.struct(F.lit(c).alias("column_name"), *[F.col(f"{k}_{i}").alias(f"n_{k}") for k in ("missing", "zero", "negative", "whole", "bad")]))
    return df.groupBy(load).agg(*aggs).select(load, "n_rows", F.inline(F.array(*packed)))


def states(df: DataFrame, column: str, pattern: Column | None = None) -> Column:
    """What a value is, as an ordered code: missing, negative, zero, broken, whole or violating its pattern."""
    x = F.col(column)
    missing = x.isNull() | F.isnan(x) if df.schema[column].dataType.typeName() in ("double", "float") else x.isNull()
    bad = F.lit(False) if pattern is None else ~F.coalesce(pattern, F.lit(True))
    return F.when(missing, 0).when(bad, 5).when(x < 0, 1).when(x == 0, 2).when(x == F.floor(x), 4).otherwise(3)


def profile(df: DataFrame, load: str, columns: list[str] | None = None, patterns: dict[str, Column] | None = None, watched: tuple[str, ...] = ()) -> DataFrame:
    """The whole profile: one row per load and column.

    null and NaN count as missing; shares are of the rows (missing) or of the
    values that are there (the rest). An empty table gives no rows; a load
    whose column is all missing keeps its row with null statistics. A null load
    is a load of its own. For the numeric columns ``watched`` there is also
    ``ks_state``, the distance of a load's ``states`` from those of the others.
    """
    columns = columns or [c for c in df.columns if c != load and not df.schema[c].dataType.typeName() in ("array", "map", "struct", "binary")]
    numeric = list(_kinds(df, columns))
    texts = [c for c in columns if c not in numeric]
    base = materialize(shares(df, load, columns, patterns), "profile-shares")  # a row a column and load; read more than once
    parts = []
    if numeric:
        hidden = {f"{c}\x00state": states(df, c, (patterns or {}).get(c)) for c in watched}
        rows = base.filter(F.col("column_name") == numeric[0]).select(load, "n_rows")
        every = numeric_profile(df.withColumns(hidden), load, [*numeric, *hidden], rows)
        if hidden:
            every = materialize(every, "profile-numbers")
            of = every.filter(F.col("column_name").isin(list(hidden))).select(F.col(load).alias("_l"), F.substring_index("column_name", "\x00", 1).alias("_c"), F.col("ks_rest").alias("ks_state"))
            every = every.filter(~F.col("column_name").isin(list(hidden))).join(of, F.col(load).eqNullSafe(F.col("_l")) & (F.col("column_name") == F.col("_c")), "left").drop("_l", "_c")
        parts.append(every)
    if texts:
        parts.append(string_profile(df, load, texts))
    stats = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    stats = stats.withColumnsRenamed({load: "_l", "column_name": "_c"})
    out = base.join(stats, F.col(load).eqNullSafe(F.col("_l")) & (F.col("column_name") == F.col("_c")), "left").drop("_l", "_c")
    share = lambda n: F.try_divide(F.col(n), F.col("n_rows") - F.col("n_missing"))
    return out.select(
        load, "column_name", "n_rows", "n_missing", (F.col("n_missing") / F.col("n_rows")).alias("missing_share"),
        *[share(f"n_{k}").alias(f"{k}_share") for k in ("zero", "negative", "whole", "bad")], share("top_count").alias("top_share"),
        *[c for c in stats.columns if c not in ("_l", "_c", "n_values", "top_count")],
    )


#: How much farther from the other loads than the usual one a load has to lie to be nominated.
NOMINATED = 0.02


def drifted(profiled: DataFrame, load: str, more: float = 0.1, more_whole: float = 0.5, times: float = 5.0) -> DataFrame:
    """Loads and columns whose profile clearly leaves the usual one, the median over all loads.

    The Kolmogorov-Smirnov distance to the other loads nominates, that of the
    values (``ks_all``) or of their states (``ks_state``): at least NOMINATED
    above the median distance, or none because the load has no value. Of those,
    a load leaves if a share of missing, negative, zero, pattern-violating or
    one same value is at least ``more`` above the usual, of whole numbers at
    least ``more_whole``, or its median more than ``times`` higher or lower.
    """
    watched = {"missing_share": more, "negative_share": more, "zero_share": more, "bad_share": more, "top_share": more, "whole_share": more_whole}
    distances = [c for c in ("ks_all", "ks_state") if c in profiled.columns]
    profiled = materialize(profiled, "profiled")  # a row a column and load; it is read twice
    usual = profiled.groupBy("column_name").agg(*[F.expr(f"percentile({k}, 0.5)").alias(f"usual_{k}") for k in [*watched, "median", *distances]])
    x = profiled.join(F.broadcast(usual), "column_name")  # one row a column
    nominated = F.col("ks_all").isNull()
    for k in distances:
        nominated = nominated | F.coalesce(F.col(k) >= F.col(f"usual_{k}") + NOMINATED, F.lit(False))
    leaves = [F.coalesce(F.col(k) >= F.coalesce(F.col(f"usual_{k}"), F.lit(0.0)) + least, F.lit(False)) for k, least in watched.items()]
    off = F.abs(F.ln(F.try_divide(F.col("median"), F.col("usual_median")))) > F.log(F.lit(times))
    leaves.append(F.coalesce(off, F.lit(False)))
    found = leaves[0]
    for c in leaves[1:]:
        found = found | c
    return x.filter(nominated & found)
