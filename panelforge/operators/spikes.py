"""Implausible readings of a series: an isolation forest per series, with explicit limits.

Readings are judged against their own series. The series itself, one reading a
day, is gathered per series (at most one row a calendar day bounds it); the rows
to be judged come beside it in shards of bounded size, so copies and revisions
of a hot series spread over tasks, each of which grows the same forest from the
same days and seed. Every row gets a score; rows of a high score are nominated,
and only these are held against the exact definition of a spike. Physical limits
and stuck runs are explicit rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

FIELDS = ("high", "low", "close", "quote_vol")
#: Fields whose values repeat only when a feed is stuck.
STUCK_FIELDS = ("close", "quote_vol")
TREES, SAMPLE, DEPTH, SEED = 64, 256, 8, 20_240_101
#: Rows judged in one task, and readings on either side that make the level.
SHARD_ROWS, SIDE = 150_000, 5
STUCK_RUN, SPIKE_DAYS, SPIKE_MADS = 5, 3, 20.0
#: The anomaly score (one half is ordinary) from which on a row is nominated as a spike. A series of fewer days than LEAST_DAYS is too
#: short to learn from: all its rows are nominated.
NOMINATED, LEAST_DAYS = 0.55, 32
#: Series beyond one shard are listed; up to so many are broadcast, more are joined by their keys.
MAX_BROADCAST = 100_000

_OUT = "bar_id bigint, exchange string, symbol string, day date, score double, candidate boolean, stuck boolean, spike boolean"


def impossible(high: Column, low: Column, close: Column, quote_vol: Column) -> Column:
    """The physical limits: prices above zero, volume not below it, low <= close <= high. Missing values decide nothing."""
    tests = [high <= 0, low <= 0, close <= 0, quote_vol < 0, low > high, close > high, close < low]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


# --- isolation forest -------------------------------------------------------


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    m = np.maximum(n - 1, 1).astype(float)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649015329) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """All trees as arrays in heap order, grown a level at a time for every tree at once."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator):
        n, k = x.shape
        size = min(SAMPLE, n)
        pick = np.argsort(rng.random((TREES, n)), axis=1)[:, :size] if n > size else np.tile(np.arange(n), (TREES, 1))
        data = x[pick]
        nodes = 2 ** (DEPTH + 1)
        self.feature = np.zeros((TREES, nodes), np.int64)
        self.cut = np.full((TREES, nodes), np.nan)
        self.path = np.zeros((TREES, nodes))
        self.expected = max(float(_average_path(np.array([size]))[0]), 1e-9)
        tree = np.repeat(np.arange(TREES), size)
        at = np.ones(TREES * size, np.int64)
        rows = data.reshape(-1, k)
        live = np.ones(len(at), bool)
        for level in range(DEPTH + 1):
            width = 2**level
            slot = tree * width + at - width
            count = np.bincount(slot[live], minlength=TREES * width)
            self.path[:, width : 2 * width] = (level + _average_path(count)).reshape(TREES, width)
            if level == DEPTH or not live.any():
                break
            f = rng.integers(0, k, (TREES, width))
            u = rng.random((TREES, width))
            self.feature[:, width : 2 * width] = f
            v = rows[np.arange(len(at)), f.reshape(-1)[slot]]
            lo, hi = np.full(TREES * width, np.inf), np.full(TREES * width, -np.inf)
            np.minimum.at(lo, slot[live], v[live])
            np.maximum.at(hi, slot[live], v[live])
            split = (hi > lo) & (count > 1)
            cut = np.where(split, lo + u.reshape(-1) * np.where(split, hi - lo, 0), np.nan)
            self.cut[:, width : 2 * width] = cut.reshape(TREES, width)
            live &= split[slot]
            at = np.where(live, 2 * at + (v >= cut[slot]), at)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1) of each row, one half being ordinary."""
        t = np.arange(TREES)[None, :]
        at = np.ones((len(x), TREES), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            cut = self.cut[t, at]
            go = ~np.isnan(cut)
            if not go.any():
                break
            at = np.where(go, 2 * at + (x[rows, self.feature[t, at]] >= cut), at)
        return 2.0 ** (-self.path[t, at].mean(axis=1) / self.expected)


# --- one field of one series ------------------------------------------------


class Field:
    """The recorded days of one field of a series (days without a value are not recorded), and their levels."""

    def __init__(self, day: np.ndarray, value: np.ndarray):
        have = ~np.isnan(value)
        self.day, self.value = day[have], value[have]
        self.positive = self.value > 0
        # levels and spikes are of logarithms: only positive values have one
        self.log_day, self.log = self.day[self.positive], np.log(self.value[self.positive])
        steps = np.abs(np.diff(self.log))
        self.mad = float(np.median(steps)) if len(steps) else np.nan
        # medians of up to SIDE readings: before[k] of those before reading k, after[k] of k and those after it
        n = len(self.log)
        pad = np.r_[np.full(SIDE, np.nan), self.log, np.full(SIDE, np.nan)]
        med = _nanmedian(np.lib.stride_tricks.sliding_window_view(pad, SIDE))
        self.before, self.after = med[: n + 1], med[SIDE : SIDE + n + 1]
        #: runs of equal values: first and last index of the run each recorded day lies in
        new = np.r_[True, self.value[1:] != self.value[:-1]] if len(self.value) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(self.value)] - 1 if len(first) else first
        self.first, self.last = (first[run], last[run]) if len(first) else (first, last)

    def run_length(self, day: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Of each row, how many consecutive recorded days hold its very value, its own day counted once."""
        out = np.zeros(len(day), np.int64)
        ok = ~np.isnan(value)
        i = np.searchsorted(self.day, day[ok])
        v, n = value[ok], len(self.value)
        left, right = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        j = i - 1
        m = (j >= 0) & (n > 0)
        m[m] = self.value[j[m]] == v[m]
        left[m] = j[m] - self.first[j[m]] + 1
        j = i + 1
        m = j < n
        m[m] = self.value[j[m]] == v[m]
        right[m] = self.last[j[m]] - j[m] + 1
        out[ok] = left + right + 1
        return out

    def spike(self, day: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Rows off the level both before and after, in one direction, within at most SPIKE_DAYS recorded days.

        The readings next to the run are back at the level, else it lasts longer.
        """
        out = np.zeros(len(day), bool)
        n = len(self.log)
        if n < 3 or not self.mad > 0:
            return out
        ok = value > 0
        i, j = (np.searchsorted(self.log_day, day[ok], side) for side in ("left", "right"))  # readings before the row's day, and up to it
        x, far = np.log(value[ok]), SPIKE_MADS * self.mad
        at = lambda k: np.where((k >= 0) & (k < n), self.log[np.clip(k, 0, n - 1)], np.nan)
        found = np.zeros(len(i), bool)
        for earlier in range(SPIKE_DAYS):  # days of the run before the row's, and after it
            for later in range(SPIKE_DAYS - earlier):
                a, b = i - earlier, j + later
                before, after = self.before[np.clip(a, 0, n)], self.after[np.clip(b, 0, n)]
                run = [x, *(at(i - k) for k in range(1, earlier + 1)), *(at(j + k) for k in range(later))]
                for sign in (1, -1):
                    off = (a > 0) & (b < n) & (sign * (at(a - 1) - before) <= far) & (sign * (at(b) - after) <= far)
                    for y in run:
                        off &= (sign * (y - before) > far) & (sign * (y - after) > far)
                    found |= off
        out[ok] = found
        return out

    def features(self, day: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
        """Level, difference and seasonal feature in units of the median daily change; zero where there is no value to tell.

        The level is that on the side that is nearer, and counts if both lie in
        one direction; the difference is the greatest to the readings of the
        SPIKE_DAYS days before or after, whichever side is smaller, so a lasting
        change stays small; the season is a week.
        """
        n = len(self.log)
        if n < 3 or not self.mad > 0:
            return [np.zeros(len(day))] * 3
        ok = value > 0
        x = np.where(ok, np.log(np.where(ok, value, 1.0)), 0.0)
        i, j = (np.searchsorted(self.log_day, day, side) for side in ("left", "right"))
        low, high = x - self.before[i], x - self.after[j]
        level = np.where(low * high < 0, 0.0, np.fmin(np.abs(low), np.abs(high)))
        apart = lambda k: np.where((k >= 0) & (k < n), np.abs(x - self.log[np.clip(k, 0, n - 1)]), 0.0)
        sides = [np.max([apart(k) for k in ks], axis=0) for ks in ([i - 1 - k for k in range(SPIKE_DAYS)], [j + k for k in range(SPIKE_DAYS)])]
        week = np.searchsorted(self.log_day, day - 7, "right") - 1
        seasonal = apart(np.where(week >= 0, week, np.searchsorted(self.log_day, day + 7)))
        return [np.where(ok, np.nan_to_num(f) / self.mad, 0.0) for f in (level, np.minimum(*sides), seasonal)]


def _nanmedian(sides: np.ndarray) -> np.ndarray:
    """Row medians without the missing ones; NaN where all are missing."""
    s = np.sort(sides, axis=1)
    n = np.sum(~np.isnan(s), axis=1)
    r = np.arange(len(s))
    lo, hi = np.maximum((n - 1) // 2, 0), n // 2
    return np.where(n > 0, (s[r, lo] + s[r, np.minimum(hi, s.shape[1] - 1)]) / 2, np.nan)


def judge(days: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score, candidate, stuck and spike of each of ``rows`` against the series ``days`` (sorted by day).

    The forest sees four features of a row: the greatest level, difference and
    seasonal feature of its fields and its longest run, as logarithms.
    """
    with np.errstate(all="ignore"):
        fields = {f: Field(days["day"], days[f]) for f in FIELDS}

        def features(t: dict[str, np.ndarray]) -> np.ndarray:
            own = [fields[f].features(t["day"], t[f]) for f in FIELDS]
            runs = [fields[f].run_length(t["day"], t[f]) for f in STUCK_FIELDS]
            return np.log1p(np.column_stack([*(np.max([x[k] for x in own], axis=0) for k in range(3)), np.max(runs, axis=0)]))

        forest = Forest(features(days), np.random.default_rng(SEED))
        score = forest.score(features(rows))
        candidate = (score >= NOMINATED) | (len(days["day"]) < LEAST_DAYS)
        # a run counts as the days' first or last revisions have it
        early = {f: Field(days["day"], days[f"first_{f}"]) for f in STUCK_FIELDS}
        stuck = np.any([x[f].run_length(rows["day"], rows[f]) >= STUCK_RUN for f in STUCK_FIELDS for x in (fields, early)], axis=0)
        spike = np.zeros(len(score), bool)
        at = np.flatnonzero(candidate)
        spike[at] = np.any([fields[f].spike(rows["day"][at], rows[f][at]) for f in FIELDS], axis=0)
    return score, candidate, stuck, spike


def _group(left: pa.Table, right: pa.Table) -> pa.Table:
    """``left`` the days of one series, ``right`` one shard of its rows."""
    names = ["bar_id", "exchange", "symbol", "day", "score", "candidate", "stuck", "spike"]
    arr = lambda t, c: t.column(c).to_numpy(zero_copy_only=False).astype(np.int64 if c == "x" else float)
    if not right.num_rows:
        none = [pa.int64(), pa.string(), pa.string(), pa.date32(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_()]
        return pa.table([pa.array([], k) for k in none], names=names)
    days = {c: arr(left, c) for c in ("x", *FIELDS, *(f"first_{f}" for f in STUCK_FIELDS))}
    order = np.argsort(days["x"], kind="stable")
    days = {"day" if c == "x" else c: v[order] for c, v in days.items()}
    rows = {"day" if c == "x" else c: arr(right, c) for c in ("x", *FIELDS)}
    score, candidate, stuck, spike = judge(days, rows)
    day = right.column("x").cast(pa.int32()).cast(pa.date32())
    return pa.table([right.column("bar_id"), right.column("exchange"), right.column("symbol"), day, *map(pa.array, (score, candidate, stuck, spike))], names=names)


def flag(bars: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Score and rules of every row: bar_id, exchange, symbol, day, score, candidate, stuck, spike, impossible.

    :param bars: (bar_id, load_id, exchange, symbol, day, high, low, close,
        quote_vol), doubles without NaN. Copies and revisions are rows of their
        own, judged by their own values; the series they are judged against
        holds, of each day and field, the value of the greatest load_id, then
        bar_id, that has one (for stuck runs also that of the least).

    Missing values decide nothing; rows without a day are no readings (the
    limits of ``flagged`` still hold for them); a series of one or two days has neither
    spikes nor stuck runs, one of fewer than LEAST_DAYS days nominates all its
    rows; ties in the order of revisions do not occur as
    bar_id is unique. An empty table gives no rows, null keys form series of
    their own, further columns are not carried.
    """
    rank = F.struct(F.coalesce("load_id", F.lit(-(2**31))), F.coalesce("bar_id", F.lit(-(2**63) + 1)))
    b = bars.filter(F.col("day").isNotNull()).withColumn("x", F.unix_date("day"))
    keys = ["exchange", "symbol"]
    have = lambda f: F.when(F.col(f).isNotNull(), rank)
    days = b.groupBy(*keys, "x").agg(*[F.max_by(f, have(f)).alias(f) for f in FIELDS], *[F.min_by(f, have(f)).alias(f"first_{f}") for f in STUCK_FIELDS])
    hot = b.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > shard_rows).select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("_n") / shard_rows).cast("int").alias("_shards"))
    hot = materialize(hot, "hot-series")  # read twice; rows / shard_rows of them at most
    hot = F.broadcast(hot) if hot.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else hot
    same = F.col("exchange").eqNullSafe(F.col("_exchange")) & F.col("symbol").eqNullSafe(F.col("_symbol"))
    shards = F.coalesce("_shards", F.lit(1))
    rows = b.join(hot, same, "left").withColumn("shard", F.pmod(F.xxhash64("bar_id"), shards).cast("int"))
    spread = days.join(hot, same, "left").withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    by = [*keys, "shard"]
    # fresh attributes on one side: both come from the same table
    rows = rows.select("bar_id", *[F.col(c).alias(c) for c in (*by, "x", *FIELDS)])
    return spread.select(*by, "x", *FIELDS, *[f"first_{f}" for f in STUCK_FIELDS]).groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(_group, _OUT)


def flagged(bars: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of ``bars`` that break a limit, lie in a stuck run or are a spike: bar_id, reasons."""
    hard = bars.filter(impossible(*map(F.col, FIELDS))).select("bar_id", F.lit("impossible").alias("reason"))
    soft = flag(bars, shard_rows).filter(F.col("stuck") | F.col("spike"))
    soft = soft.select("bar_id", F.explode(F.array_compact(F.array(F.when(F.col("stuck"), "stuck"), F.when(F.col("spike"), "spike")))).alias("reason"))
    return hard.unionByName(soft).groupBy("bar_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
