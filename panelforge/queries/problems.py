"""Queries p1_ to p5_: training-data operators over the market tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, profile, regrid, spikes, trailing
from ..schema import BAR_COLUMNS, OHLCV_1D
from ..sources.bars import clean, keyed, latest_per_day, table

TARGET_BYTES = 128 * 1024 * 1024
_DOUBLES = [f.name for f in OHLCV_1D if f.dataType.typeName() == "double"]


def _compacted(spark: SparkSession, d: str):
    bars = table(spark, d, "ohlcv_1d")
    done = compaction.compact(bars, BAR_COLUMNS, "bar_id", ["symbol"], ["symbol", "exchange", "ts_open", "bar_id"], target_bytes=TARGET_BYTES)
    schema = bars.select(*BAR_COLUMNS, "bar_id").schema
    return bars, spark.read.schema(schema).parquet(done.path)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the compaction folded into an equal one."""
    bars, compacted = _compacted(spark, d)
    return compaction.copies(bars, compacted, "bar_id")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """The compacted table itself, read back from its few files; NaN as null, and how many of a record's values are NaN."""
    records = _compacted(spark, d)[1]
    nans = sum((F.when(F.isnan(c), 1).otherwise(0) for c in _DOUBLES), F.lit(0))
    return records.withColumn("n_nan", nans).withColumns({c: clean(F.col(c)) for c in _DOUBLES})


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    """Files per exchange and symbol, and how many well-sized ones their bytes make."""
    return compaction.file_report(table(spark, d, "bar_files"), TARGET_BYTES)


_WATCHED = ("volume", "taker_buy_vol", "n_trades")


def _profiled(spark: SparkSession, d: str, watched: tuple[str, ...] = ()) -> DataFrame:
    bars = table(spark, d, "ohlcv_1d")
    patterns = {
        "taker_buy_vol": F.col("taker_buy_vol") <= clean(F.col("volume")),
        "symbol": F.col("symbol").rlike("^[A-Z0-9]+$"),
        "exchange": F.col("exchange").rlike("^[a-z0-9-]+$"),
    }
    return profile.profile(bars, "load_id", patterns=patterns, watched=watched)


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of every load and column of ohlcv_1d."""
    out = _profiled(spark, d)
    exact = {"n_rows", "n_missing", "n_distinct", "load_id", "column_name", "min_text", "max_text", "min_value", "max_value", "q25", "median", "q75"}
    return out.select(*[F.col(c) if c in exact else F.round(c, 9).alias(c) for c in out.columns])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Loads whose volume, taker_buy_vol or n_trades leaves what most loads show."""
    watched = _profiled(spark, d, _WATCHED).filter(F.col("column_name").isin(*_WATCHED))
    # whole numbers are a finding for the two volumes only
    watched = watched.withColumn("whole_share", F.when(F.col("column_name") != "n_trades", F.col("whole_share")))
    return profile.drifted(watched, "load_id").select("load_id", "column_name")


def _closes(spark: SparkSession, d: str) -> DataFrame:
    bars = table(spark, d, "ohlcv_1d")
    return latest_per_day(bars.filter(clean(F.col("close")).isNotNull()), "close")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    """The daily series of close: observed, filled or marked."""
    grid = regrid.regrid(_closes(spark, d), "close")
    return grid.select("exchange", "symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), F.when(F.col("status") == "filled", F.round("close", 9)).otherwise(F.col("close")).alias("close"), "status")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The days that were filled or marked: those of the grid whose value is interpolated, and those of a gap, which have none."""
    grid = regrid.regrid(_closes(spark, d), "close")
    filled = F.when(F.col("status") == "filled", F.col("close").isNotNull()).when(F.col("status") == "gap", F.col("close").isNull()).otherwise(False)
    return grid.filter(filled).select("exchange", "symbol", F.date_format("day", "yyyy-MM-dd").alias("day"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return keyed(table(spark, d, "ohlcv_1d"), "bar_id", "load_id", *spikes.FIELDS, undated=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Bars with an impossible, stuck or spiking value."""
    return spikes.flagged(_judged(spark, d)).select("bar_id")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score and rules of every bar."""
    return spikes.flag(_judged(spark, d)).withColumn("score", F.round("score", 6))


def _daily(spark: SparkSession, d: str, *values: str) -> DataFrame:
    daily = latest_per_day(table(spark, d, "ohlcv_1d"), *values)
    return daily.withColumn("n_trades", F.when(F.col("n_trades") >= 0, F.col("n_trades")))


def p5_trailing(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages of close, quote_vol and n_trades over 7 and 30 days, for every series and calendar day."""
    out = trailing.totals(_daily(spark, d, "close", "quote_vol", "n_trades"), ["close", "quote_vol", "n_trades"])
    for w in (7, 30):  # sums are exact to the stored digits; averages are of the sums shown
        out = out.withColumns({f"close_sum_{w}": F.round(f"close_sum_{w}", 6), f"quote_vol_sum_{w}": F.round(f"quote_vol_sum_{w}", 2)})
        out = out.withColumns({f"{a}_avg_{w}": F.try_divide(F.col(f"{a}_sum_{w}"), F.col(f"{a}_n_{w}").cast("double")) for a in ("close", "quote_vol")})
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Days from a series' 30th on whose trades of 7 days are at least half those of 30."""
    out = trailing.totals(_daily(spark, d, "n_trades"), ["n_trades"], from_day=30)
    week, month = F.col("n_trades_sum_7"), F.col("n_trades_sum_30")
    return out.filter((month > 0) & (2 * week >= month)).select("exchange", "symbol", F.date_format("day", "yyyy-MM-dd").alias("day"))


# --- the same in SQL --------------------------------------------------------

_US = "CASE WHEN abs(ts_open) < 100000000000 THEN ts_open * 1000000 WHEN abs(ts_open) < 100000000000000 THEN ts_open * 1000 ELSE ts_open END"
_DAY = f"(DATE '1970-01-01' + CAST(floor((({_US}) + 10000000) / 86400000000.0) AS INTEGER))"
_NN = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
#: Bars with a day, NaN as null.
BARS_CTE = f"""b AS (SELECT bar_id, load_id, exchange, upper(trim(symbol)) AS symbol, {_DAY} AS day, {", ".join(f"{_NN(c)} AS {c}" for c in ("open", "high", "low", "close", "volume", "quote_vol", "taker_buy_vol"))}, n_trades
  FROM ohlcv_1d WHERE ts_open IS NOT NULL)"""

_NEW = "row_number() OVER (PARTITION BY exchange, symbol, day ORDER BY load_id DESC NULLS LAST, bar_id DESC NULLS LAST)"


def _p2_sql() -> str:
    parts = []
    for c in _WATCHED:
        v = _NN(c) if c in _DOUBLES else c
        bad = "CASE WHEN taker_buy_vol > CASE WHEN isnan(volume) THEN NULL ELSE volume END THEN 1 ELSE 0 END" if c == "taker_buy_vol" else "0"
        parts.append(f"SELECT load_id, '{c}' AS column_name, CAST({v} AS DOUBLE) AS v, {bad} AS bad FROM ohlcv_1d")
    base = f"""WITH x AS ({" UNION ALL ".join(parts)}),
  t AS (SELECT load_id, column_name, max(n) AS top FROM (SELECT load_id, column_name, v, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
  s AS (SELECT x.load_id, x.column_name, count(*) AS n_rows, count(*) - count(v) AS n_missing, (count(*) - count(v)) / count(*)::DOUBLE AS missing_share,
    count(*) FILTER (v = 0) / nullif(count(v), 0)::DOUBLE AS zero_share, count(*) FILTER (v < 0) / nullif(count(v), 0)::DOUBLE AS negative_share,
    count(*) FILTER (v = floor(v)) / nullif(count(v), 0)::DOUBLE AS whole_share, sum(bad) FILTER (v IS NOT NULL) / nullif(count(v), 0)::DOUBLE AS bad_share,
    count(DISTINCT v) AS n_distinct, min(v) AS min_value, max(v) AS max_value,
    quantile_disc(v, 0.25) AS q25, quantile_disc(v, 0.5) AS median, quantile_disc(v, 0.75) AS q75
    FROM x GROUP BY 1, 2),
  p AS (SELECT s.*, t.top / nullif(n_rows - n_missing, 0)::DOUBLE AS top_share FROM s LEFT JOIN t ON s.load_id = t.load_id AND s.column_name = t.column_name)"""
    return (
        base
        + """, u AS (SELECT column_name, median(missing_share) AS m, median(zero_share) AS z, median(negative_share) AS g, median(whole_share) AS w, median(bad_share) AS b, median(top_share) AS t, median(median) AS d FROM p GROUP BY 1)
  SELECT p.load_id, p.column_name FROM p JOIN u USING (column_name) WHERE missing_share >= m + 0.1 OR zero_share >= z + 0.1 OR negative_share >= g + 0.1 OR bad_share >= b + 0.1 OR top_share >= t + 0.1
    OR (p.column_name <> 'n_trades' AND whole_share >= w + 0.5) OR CASE WHEN median / nullif(d, 0) > 0 THEN abs(ln(median / d)) > ln(5.0) ELSE false END"""
    )


def _p2_profile_sql() -> str:
    """Distances by a self-join of cumulative counts: every load at every value of the column."""
    doubles = [f.name for f in OHLCV_1D if f.dataType.typeName() == "double"]
    whole = ["ts_open", "ts_close", "n_trades", "bar_id", "file_id"]
    bad = {
        "taker_buy_vol": f"{_NN('taker_buy_vol')} > {_NN('volume')}", "symbol": "NOT regexp_full_match(symbol, '[A-Z0-9]+')", "exchange": "NOT regexp_full_match(exchange, '[a-z0-9-]+')",
    }
    cells = [f"SELECT load_id, '{c}' AS c, CAST({_NN(c)} AS DOUBLE) AS v, NULL AS s, true AS number, {bad.get(c, 'NULL')} AS bad FROM ohlcv_1d" for c in doubles]
    cells += [f"SELECT load_id, '{c}', CAST({c} AS DOUBLE), NULL, true, NULL FROM ohlcv_1d" for c in whole]
    cells += ["SELECT load_id, 'loaded_at', CAST(epoch_us(loaded_at) AS DOUBLE), NULL, false, NULL FROM ohlcv_1d"]
    cells += [f"SELECT load_id, '{c}', NULL, {c}, false, {bad[c]} FROM ohlcv_1d" for c in ("exchange", "symbol")]
    share = lambda test: f"CASE WHEN bool_or(number) THEN count(*) FILTER ({test}) / nullif(count(v), 0)::DOUBLE END"
    cum = lambda x: f"sum({x}) OVER (PARTITION BY c, load_id ORDER BY v)"
    far = lambda mine, own, every, total: f"abs({mine} / {own}::DOUBLE - ({every} - {mine}) / nullif({total} - {own}, 0)::DOUBLE)"
    return f"""WITH x AS ({" UNION ALL ".join(cells)}),
  a AS (SELECT load_id, c, count(*) AS n_rows, count(*) - count(coalesce(CAST(v AS VARCHAR), s)) AS n_missing, count(v) AS nv, {share("v = 0")} AS zero_share, {share("v < 0")} AS negative_share, {share("v = floor(v)")} AS whole_share,
    CASE WHEN c IN ('taker_buy_vol', 'symbol', 'exchange') THEN count(*) FILTER (bad) / nullif(count(coalesce(CAST(v AS VARCHAR), s)), 0)::DOUBLE END AS bad_share,
    count(DISTINCT coalesce(CAST(v AS VARCHAR), s)) AS n_distinct, min(v) AS min_value, quantile_disc(v, 0.25) AS q25, quantile_disc(v, 0.5) AS median, quantile_disc(v, 0.75) AS q75, max(v) AS max_value, min(s) AS min_text, max(s) AS max_text
    FROM x GROUP BY 1, 2),
  t AS (SELECT load_id, c, max(n) AS top FROM (SELECT load_id, c, v, s, count(*) AS n FROM x WHERE v IS NOT NULL OR s IS NOT NULL GROUP BY ALL) GROUP BY 1, 2),
  n AS (SELECT c, v, load_id, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY 1, 2, 3),
  l AS (SELECT load_id, c, nv, n_rows, lag(load_id) OVER (PARTITION BY c ORDER BY load_id) AS prior, sum(nv) OVER (PARTITION BY c) AS nall, (SELECT count(*) FROM ohlcv_1d) AS rall FROM a WHERE nv > 0),
  g AS (SELECT l.c, l.load_id, u.v, coalesce(n.n, 0) AS n, u.n AS every FROM (SELECT c, v, sum(n) AS n FROM n GROUP BY 1, 2) u JOIN l ON l.c = u.c LEFT JOIN n ON n.c = u.c AND n.v = u.v AND n.load_id = l.load_id),
  f AS (SELECT c, load_id, v, {cum("n")} AS f, {cum("every")} AS e FROM g),
  d AS (SELECT f.c, f.load_id, max({far("f.f", "nv", "f.e", "nall")}) AS ks_rest, max(abs(f.f / nv::DOUBLE - p.f / p.pn::DOUBLE)) AS ks_prev, max({far("f.f", "n_rows", "f.e", "rall")}) AS ks_all
    FROM f JOIN l ON l.c = f.c AND l.load_id = f.load_id LEFT JOIN (SELECT f.*, nv AS pn FROM f JOIN l USING (c, load_id)) p ON p.c = f.c AND p.v = f.v AND p.load_id = l.prior GROUP BY 1, 2)
  SELECT a.load_id, a.c AS column_name, n_rows, n_missing, round(n_missing / n_rows::DOUBLE, 9) AS missing_share, {", ".join(f"round({k}_share, 9) AS {k}_share" for k in ("zero", "negative", "whole", "bad"))},
    round(top / nullif(n_rows - n_missing, 0)::DOUBLE, 9) AS top_share, CASE WHEN n_rows > n_missing THEN n_distinct END AS n_distinct, min_value, q25, median, q75, max_value,
    round(ks_rest, 9) AS ks_rest, round(ks_prev, 9) AS ks_prev, round(ks_all, 9) AS ks_all, min_text, max_text
  FROM a LEFT JOIN t ON a.load_id = t.load_id AND a.c = t.c LEFT JOIN d ON a.load_id = d.load_id AND a.c = d.c"""


_P3_SQL = f"""WITH {BARS_CTE},
  r AS (SELECT exchange, symbol, day, close FROM (SELECT *, {_NEW} AS rn FROM b WHERE close IS NOT NULL) WHERE rn = 1),
  k AS (SELECT exchange, symbol, day, close AS y, lag(day) OVER w AS xp, lag(close) OVER w AS yp, lead(day) OVER w AS x1, lead(close) OVER w AS y1, lead(day, 2) OVER w AS x2, lead(close, 2) OVER w AS y2
    FROM r WINDOW w AS (PARTITION BY exchange, symbol ORDER BY day)),
  h AS (SELECT *, CASE WHEN day - xp <= 14 THEN (day - xp)::DOUBLE END AS hp, CASE WHEN x1 - day <= 14 THEN (x1 - day)::DOUBLE END AS h0, CASE WHEN x2 - x1 <= 14 THEN (x2 - x1)::DOUBLE END AS h1 FROM k),
  s AS (SELECT *, (y - yp) / hp AS sp, (y1 - y) / h0 AS s0, (y2 - y1) / h1 AS s1 FROM h),
  e AS (SELECT *, ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1) AS le, ((2 * h0 + hp) * s0 - h0 * sp) / (h0 + hp) AS re FROM s),
  g AS (SELECT *,
    CASE WHEN sp IS NULL THEN CASE WHEN s1 IS NULL THEN s0 WHEN sign(le) <> sign(s0) THEN 0 WHEN sign(s0) <> sign(s1) AND abs(le) > 3 * abs(s0) THEN 3 * s0 ELSE le END
      WHEN sign(sp) * sign(s0) <= 0 THEN 0 ELSE (3 * h0 + 3 * hp) / ((2 * h0 + hp) / nullif(sp, 0) + (h0 + 2 * hp) / nullif(s0, 0)) END AS dl,
    CASE WHEN s1 IS NULL THEN CASE WHEN sp IS NULL THEN s0 WHEN sign(re) <> sign(s0) THEN 0 WHEN sign(s0) <> sign(sp) AND abs(re) > 3 * abs(s0) THEN 3 * s0 ELSE re END
      WHEN sign(s0) * sign(s1) <= 0 THEN 0 ELSE (3 * h0 + 3 * h1) / ((2 * h1 + h0) / nullif(s0, 0) + (h1 + 2 * h0) / nullif(s1, 0)) END AS dr
    FROM e),
  d AS (SELECT *, unnest(generate_series(0, coalesce(x1 - day - 1, 0))) AS o FROM g),
  out AS (SELECT exchange, symbol, strftime(day + CAST(o AS INTEGER), '%Y-%m-%d') AS day,
    CASE WHEN o = 0 THEN y ELSE round(y * (1 + 2 * o / h0) * (1 - o / h0) * (1 - o / h0) + h0 * dl * (o / h0) * (1 - o / h0) * (1 - o / h0) + y1 * (o / h0) * (o / h0) * (3 - 2 * o / h0) - h0 * dr * (o / h0) * (o / h0) * (1 - o / h0), 9) END AS close,
    CASE WHEN o = 0 THEN 'observed' WHEN h0 IS NULL THEN 'gap' ELSE 'filled' END AS status FROM d)"""


def _p4_sql() -> str:
    """The definition itself, without a forest: a series as a sorted list a field, its levels as medians of slices."""
    key = "coalesce(exchange, chr(1)) || chr(2) || coalesce(symbol, chr(1)) AS s"
    fields, repeating = spikes.FIELDS, spikes.STUCK_FIELDS
    rank = "(coalesce(load_id, -2147483648), coalesce(bar_id, -9223372036854775807))"
    cases = []
    for e in range(spikes.SPIKE_DAYS):
        for later in range(spikes.SPIKE_DAYS - e):
            a, b = f"(i - {e})", f"(j + {later})"
            low = f"list_aggregate(l[greatest(1, {a} - {spikes.SIDE - 1}):{a}], 'median')"
            high = f"list_aggregate(l[{b} + 1:{b} + {spikes.SIDE}], 'median')"
            run = ["x", *(f"l[i - {k} + 1]" for k in range(1, e + 1)), *(f"l[j + {k} + 1]" for k in range(later))]
            for g in ("", "-"):
                off = [f"{g}(l[{a}] - {low}) <= far", f"{g}(l[{b} + 1] - {high}) <= far", *(f"{g}({y} - {z}) > far" for y in run for z in (low, high))]
                cases.append(f"CASE WHEN {a} > 0 AND {b} < n THEN {' AND '.join(off)} ELSE false END")
    wrong = "high <= 0 OR low <= 0 OR close <= 0 OR quote_vol < 0 OR low > high OR close > high OR close < low"
    return f"""WITH {BARS_CTE},
  v AS ({" UNION ALL ".join(f"SELECT bar_id, {key}, day, '{f}' AS f, {f} AS v, {rank} AS rank FROM b WHERE {f} IS NOT NULL" for f in fields)}),
  d AS (SELECT 'new' AS k, s, f, day, arg_max(v, rank) AS v FROM v GROUP BY s, f, day UNION ALL SELECT 'old', s, f, day, arg_min(v, rank) FROM v WHERE f IN {repeating} GROUP BY s, f, day),
  c AS (SELECT s, f, day, ln(v) AS x, abs(ln(v) - lag(ln(v)) OVER (PARTITION BY s, f ORDER BY day)) AS step FROM d WHERE k = 'new' AND v > 0),
  l AS (SELECT s, f, list(day ORDER BY day) AS ds, list(x ORDER BY day) AS l, count(*) AS n, {spikes.SPIKE_MADS} * median(step) AS far FROM c GROUP BY s, f HAVING count(*) >= 3 AND median(step) > 0),
  r AS (SELECT bar_id, ln(v) AS x, l, n, far, len(list_filter(ds, lambda q: q < day)) AS i, len(list_filter(ds, lambda q: q <= day)) AS j FROM v JOIN l ON v.s = l.s AND v.f = l.f WHERE v > 0),
  e AS (SELECT *, row_number() OVER w AS rn, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM d WHERE f IN {repeating} WINDOW w AS (PARTITION BY k, s, f ORDER BY day)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY k, s, f ORDER BY rn) AS run FROM e),
  h AS (SELECT *, rn - min(rn) OVER q + 1 AS done, max(rn) OVER q - rn + 1 AS left_over FROM g WINDOW q AS (PARTITION BY k, s, f, run)),
  y AS (SELECT *, lag(v) OVER w AS pv, lag(done) OVER w AS pn, lead(v) OVER w AS nv, lead(left_over) OVER w AS nn FROM h WINDOW w AS (PARTITION BY k, s, f ORDER BY rn)),
  o AS (SELECT {", ".join(["bar_id", *(f"{_NN(f)} AS {f}" for f in fields)])} FROM ohlcv_1d)
  SELECT bar_id FROM o WHERE {wrong}
  UNION SELECT bar_id FROM v JOIN y ON v.s = y.s AND v.f = y.f AND v.day = y.day WHERE 1 + CASE WHEN pv = v.v THEN pn ELSE 0 END + CASE WHEN nv = v.v THEN nn ELSE 0 END >= {spikes.STUCK_RUN}
  UNION SELECT bar_id FROM r WHERE {" OR ".join(cases)}"""


def _p5_sql(found: bool) -> str:
    cells = []
    for a in ("close", "quote_vol", "n_trades"):
        for n in (7, 30):
            s, c = f"sum({a}) OVER w{n}", f"count({a}) OVER w{n}"
            if a == "n_trades":
                cells.append(f"CAST(coalesce({s}, 0) AS BIGINT) AS {a}_sum_{n}, {c} AS {a}_n_{n}, CAST({s} AS DOUBLE) / nullif({c}, 0) AS {a}_avg_{n}")
            else:
                s = f"CAST(round(coalesce({s}, 0), {6 if a == 'close' else 2}) AS DOUBLE)"
                cells.append(f"{s} AS {a}_sum_{n}, {c} AS {a}_n_{n}, {s} / nullif({c}, 0) AS {a}_avg_{n}")
    base = f"""WITH {BARS_CTE},
  r AS (SELECT exchange, symbol, day, CAST(CAST(close AS VARCHAR) AS DECIMAL(38,20)) AS close, CAST(CAST(quote_vol AS VARCHAR) AS DECIMAL(38,20)) AS quote_vol, CASE WHEN n_trades >= 0 THEN n_trades END AS n_trades FROM (SELECT *, {_NEW} AS rn FROM b) WHERE rn = 1),
  s AS (SELECT exchange, symbol, min(day) AS lo, max(day) AS hi FROM r GROUP BY 1, 2),
  g AS (SELECT exchange, symbol, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM s),
  t AS (SELECT g.exchange, g.symbol, g.lo, g.day, {", ".join(cells)}
    FROM g LEFT JOIN r ON g.exchange IS NOT DISTINCT FROM r.exchange AND g.symbol IS NOT DISTINCT FROM r.symbol AND g.day = r.day
    WINDOW w7 AS (PARTITION BY g.exchange, g.symbol ORDER BY g.day ROWS 6 PRECEDING), w30 AS (PARTITION BY g.exchange, g.symbol ORDER BY g.day ROWS 29 PRECEDING))"""
    if found:
        return base + " SELECT exchange, symbol, strftime(day, '%Y-%m-%d') AS day FROM t WHERE day - lo >= 29 AND n_trades_sum_30 > 0 AND 2 * n_trades_sum_7 >= n_trades_sum_30"
    return base + " SELECT * EXCLUDE (lo) REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM t"


_TWELVE = ", ".join(f'"{c}"' for c in BAR_COLUMNS)

QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_files, p2_found, p2_profile, p3_found, p3_grid, p4_found, p4_scores, p5_found, p5_trailing)}

SQL = {
    "p1_found": f"SELECT bar_id FROM (SELECT bar_id, min(bar_id) OVER (PARTITION BY {_TWELVE}) AS kept FROM ohlcv_1d) WHERE bar_id > kept",
    "p1_records": f"""SELECT * REPLACE ({", ".join(f"{_NN(c)} AS {c}" for c in _DOUBLES)}), CAST({" + ".join(f"coalesce(CAST(isnan({c}) AS INTEGER), 0)" for c in _DOUBLES)} AS INTEGER) AS n_nan
  FROM (SELECT {_TWELVE}, min(bar_id) AS bar_id FROM ohlcv_1d GROUP BY {_TWELVE})""",
    "p1_files": f"""SELECT *, CAST(CASE WHEN n_files > 0 THEN greatest(1, ceil(n_bytes / {TARGET_BYTES}.0)) ELSE 0 END AS BIGINT) AS n_planned FROM (SELECT exchange, upper(trim(symbol)) AS symbol,
  count(*) FILTER (coalesce(committed, false)) AS n_files, count(*) FILTER (NOT coalesce(committed, false)) AS n_uncommitted,
  CAST(coalesce(sum(coalesce(n_bytes, 0)) FILTER (coalesce(committed, false)), 0) AS BIGINT) AS n_bytes,
  count(*) FILTER (coalesce(committed, false) AND coalesce(n_bytes, 0) < {TARGET_BYTES // 2}) AS n_small FROM bar_files GROUP BY 1, 2)""",
    "p2_found": _p2_sql(),
    "p2_profile": _p2_profile_sql(),
    "p3_found": _P3_SQL + " SELECT exchange, symbol, day FROM out WHERE status <> 'observed'",
    "p3_grid": _P3_SQL + " SELECT exchange, symbol, day, close, status FROM out",
    "p4_found": _p4_sql(),
    "p5_found": _p5_sql(True),
    "p5_trailing": _p5_sql(False),
}
