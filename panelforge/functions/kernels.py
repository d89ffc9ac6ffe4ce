"""Column kernels over a panel (asset, d): all but long rolling windows stay JVM expressions.

Windows are over rows, not calendar time. A rolling value needs a full window
of values: any null in it makes it null. Division by zero and a spread of zero
give null, never an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

ASSET, TIME = "asset", "d"


def series(asset: str = ASSET, time: str = TIME):
    """The window of one asset in time order; one spec, so that all kernels share one exchange and sort."""
    return Window.partitionBy(asset).orderBy(time)


def lag(x: Column, n: int = 1, w=None) -> Column:
    return F.lag(x, n).over(w or series())


def rows(n: int, w=None):
    return (w or series()).rowsBetween(-(n - 1), 0)


def roll(x: Column, n: int, agg, least: int | None = None, w=None) -> Column:
    """``agg`` of the last n rows where at least ``least`` (n by default) of them have a value."""
    frame = rows(n, w)
    return F.when(F.count(x).over(frame) >= (least or n), agg(x).over(frame))


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def spread(x: Column) -> Column:
    """A standard deviation of zero is none."""
    return F.nullif(x, F.lit(0.0))


def zscore(x: Column, n: int, w=None) -> Column:
    return div(x - roll(x, n, F.avg, w=w), spread(roll(x, n, F.stddev_samp, w=w)))


#: Rows whose windows are laid out at once.
_WINDOW_ROWS = 2_048


def _rolling(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each n values up to a row; NaN unless all are there. No sums are carried on, so an outlier harms no window but its own."""
    mean, sd = np.full(len(x), np.nan), np.full(len(x), np.nan)
    if len(x) < n:
        return mean, sd
    windows = np.lib.stride_tricks.sliding_window_view(x, n)
    for a in range(0, len(windows), _WINDOW_ROWS):
        w = windows[a : a + _WINDOW_ROWS]
        m = w.mean(axis=1)
        m2 = np.square(w - m[:, None]).sum(axis=1)
        at = slice(a + n - 1, a + n - 1 + len(w))
        mean[at] = m
        sd[at] = np.where(m2 <= n * np.square(1e-14 * m), 0.0, np.sqrt(m2 / (n - 1)))  # rounding of equal values is no spread
    return mean, sd


def with_moments(df: DataFrame, wanted: dict[str, set[int]]) -> DataFrame:
    """``df`` with ``_mu_{x}_{n}`` and ``_sd_{x}_{n}``, rolling mean and deviation of n rows, for the columns and lengths wanted.

    A sliding frame of the engine costs n steps a row for each aggregate. Here
    each series, a row a calendar day at most and lying together already, is one
    array call for all columns and lengths, without a further exchange or sort.
    Both columns are null unless all n rows have a value.
    """
    pairs = [(x, n) for x in sorted(wanted) for n in sorted(wanted[x])]
    if not pairs:
        return df

    def one(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column(TIME).to_numpy(), kind="stable")
        t = t.take(order)
        out = {c: t.column(c) for c in t.column_names}
        with np.errstate(all="ignore"):
            for x, n in pairs:
                for kind, v in zip(("mu", "sd"), _rolling(t.column(x).to_numpy().astype(float), n), strict=True):
                    out[f"_{kind}_{x}_{n}"] = pa.array(v, pa.float64(), from_pandas=True)
        return pa.table(out)

    schema = StructType([*df.schema.fields, *[StructField(f"_{kind}_{x}_{n}", DoubleType()) for x, n in pairs for kind in ("mu", "sd")]])
    return df.groupBy(ASSET).applyInArrow(one, schema)


def ready_zscore(x: str, n: int) -> Column:
    """``zscore`` of a column, from its moments."""
    return div(F.col(x) - F.col(f"_mu_{x}_{n}"), spread(F.col(f"_sd_{x}_{n}")))


def change(x: Column, n: int = 1, w=None) -> Column:
    return div(x, lag(x, n, w)) - 1


def log_change(x: Column, n: int = 1, w=None) -> Column:
    ratio = div(x, lag(x, n, w))
    return F.when(ratio > 0, F.ln(ratio))


def pearson(a: Column, b: Column) -> Column:
    """Correlation that is null, not an error, where one side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(x: Column, by: list) -> Column:
    """Rank from one, equal values sharing the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def mean_of(columns: list[Column], skip_null: bool = False) -> Column:
    """Mean across columns of a row; null if one is null, unless ``skip_null``."""
    if not skip_null:
        total = columns[0]
        for c in columns[1:]:
            total = total + c
        return total / len(columns)
    total, n = F.lit(0.0), F.lit(0)
    for c in columns:
        total, n = total + F.coalesce(c, F.lit(0.0)), n + F.when(c.isNotNull(), 1).otherwise(0)
    return F.try_divide(total, n.cast("double"))


def running_product(x: Column, w=None) -> Column:
    return F.product(x).over((w or series()).rowsBetween(Window.unboundedPreceding, 0))


def running_max(x: Column, w=None) -> Column:
    return F.max(x).over((w or series()).rowsBetween(Window.unboundedPreceding, 0))
