"""SQL of the research queries, written apart from the operators."""

from __future__ import annotations

from .problems import _DAY, _NN, _US, BARS_CTE
from ..functions.features import REGISTRY
from ..operators.qa import qa_warmup
from ..plans.pipeline import horizons_of
from .research import HORIZONS, STUDIED

_W = "PARTITION BY asset ORDER BY d"


def roll(x: str, n: int, agg: str, least: int | None = None, w: str = _W) -> str:
    frame = f"OVER ({w} ROWS {n - 1} PRECEDING)"
    return f"(CASE WHEN count({x}) {frame} >= {least or n} THEN {agg}({x}) {frame} END)"


def z(x: str, n: int) -> str:
    return f"(({x} - {roll(x, n, 'avg')}) / nullif({roll(x, n, 'stddev_samp')}, 0))"


_D = "strftime(d, '%Y-%m-%d') AS d"
P = f"""WITH {BARS_CTE},
  p AS (SELECT exchange || ':' || symbol AS asset, day AS d, open, high, low, close, volume, quote_vol, n_trades, taker_buy_vol
    FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol, day ORDER BY load_id DESC NULLS LAST, bar_id DESC NULLS LAST) AS rn FROM b) WHERE rn = 1)"""

_COMPOSITE = " + ".join(z("r1", w) for w in (15, 30, 60, 80, 100, 150, 200, 250, 300))
F = f"""{P},
  l AS (SELECT *, lag(close) OVER w AS c1, lag(close, 5) OVER w AS c5, lag(close, 20) OVER w AS c20 FROM p WINDOW w AS ({_W})),
  a AS (SELECT *, close / nullif(c1, 0) - 1 AS r1, CASE WHEN close / nullif(c1, 0) > 0 THEN ln(close / nullif(c1, 0)) END AS lr, close / nullif(c20, 0) - 1 AS pc20, close / nullif(c5, 0) - 1 AS pc5,
    2 * taker_buy_vol - volume AS sg, taker_buy_vol / nullif(volume, 0) AS tk, (high - low) / nullif(close, 0) AS hl, CAST(n_trades AS DOUBLE) AS nt FROM l),
  m AS (SELECT *, {roll("hl", 20, "avg")} AS hl20, volume / nullif({roll("volume", 20, "avg")}, 0) AS vr20, pc20 / nullif({roll("lr", 20, "stddev_samp")} * sqrt(252), 0) AS rk FROM a),
  f AS (SELECT asset, d, r1, lr AS ret_1d, {roll("lr", 20, "sum")} AS mom_20d, {roll("lr", 30, "stddev_samp")} * sqrt(365) AS rv_30d,
    {roll("sg", 20, "sum")} / nullif({roll("volume", 20, "avg")}, 0) AS cvd_20d, {z("pc20", 252)} AS rel_mom_20d, -pc5 AS reversal_5d, {z("tk", 20)} AS taker_ratio_20d,
    {z("rk", 252)} AS risk_adj_ret_20d, {z("hl20", 252)} AS hl_range_20d, close / nullif({roll("close", 20, "max")}, 0) - 1 AS dist_from_high_20d, {z("vr20", 252)} AS vol_ratio_20d,
    {z("nt", 20)} AS trades_zscore_20d, ({_COMPOSITE}) / 9 AS zscore_ret_composite FROM m)"""
PRICE = ["ret_1d", "mom_20d", "rv_30d", "cvd_20d", "rel_mom_20d", "reversal_5d", "taker_ratio_20d", "risk_adj_ret_20d", "hl_range_20d", "dist_from_high_20d", "vol_ratio_20d", "trades_zscore_20d", "zscore_ret_composite"]


def _long(names: list[str], where: str = "WHERE {0} IS NOT NULL", source: str = "f") -> str:
    return " UNION ALL ".join(f"SELECT asset, d, '{n}' AS feature_id, {n} AS value FROM {source} {where.format(n)}" for n in names)


_FW = f"""q AS (SELECT asset, d, ret_1d FROM f),
  fw AS ({" UNION ALL ".join(f"SELECT asset, d, {h} AS h, CASE WHEN lead(1, {h}) OVER (PARTITION BY asset ORDER BY d) = 1 THEN coalesce(sum(ret_1d) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING), 0) END AS fwd FROM q" for h in HORIZONS)}),
  fwv AS (SELECT * FROM fw WHERE fwd IS NOT NULL)"""
_HZ = ", ".join(f"('{f}', {h})" for f, hs in horizons_of(STUDIED).items() for h in hs)
_RANK = f"""hz AS (SELECT * FROM (VALUES {_HZ}) t(feature_id, h)),
  pr AS (SELECT s.feature_id, x.h, s.d, value, fwd FROM s JOIN hz ON s.feature_id = hz.feature_id JOIN fwv x ON s.asset = x.asset AND s.d = x.d AND x.h = hz.h),
  rk2 AS (SELECT feature_id, h, d, rank() OVER (PARTITION BY feature_id, h, d ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, h, d, value) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY feature_id, h, d ORDER BY fwd) + (count(*) OVER (PARTITION BY feature_id, h, d, fwd) - 1) / 2.0 AS rb FROM pr),
  ic0 AS (SELECT feature_id, h, d, CASE WHEN count(*) >= 3 THEN covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) END AS ic FROM rk2 GROUP BY 1, 2, 3),
  dt AS (SELECT DISTINCT feature_id, d FROM s),
  ic AS (SELECT dt.feature_id, hs.h, dt.d, ic0.ic FROM dt JOIN hz hs ON dt.feature_id = hs.feature_id LEFT JOIN ic0 ON ic0.feature_id = dt.feature_id AND ic0.h = hs.h AND ic0.d = dt.d)"""
IC = f"{F},\n  s AS ({_long(STUDIED)}),\n  {_FW},\n  {_RANK}"


def _ortho(y: str) -> str:
    controls = [c for c in ("mom_20d", "rv_30d") if c != y]
    a, b = controls[0], controls[1] if len(controls) > 1 else "0.0"
    full = f"{y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL"
    if len(controls) > 1:
        ok, sa, sb = "aa * bb - ab * ab > 1e-12 * aa * bb", "(ay * bb - yb * ab) / nullif(aa * bb - ab * ab, 0)", "(yb * aa - ay * ab) / nullif(aa * bb - ab * ab, 0)"
    else:
        ok, sa, sb = "aa > 0", "ay / nullif(aa, 0)", "0.0"
    return f"""SELECT f.asset, f.d, '{y}' AS feature_id, CASE WHEN n >= 30 AND {ok} THEN {y} - my - ({sa}) * ({a} - ma) - ({sb}) * ({b} - mb) ELSE {y} END AS value FROM f JOIN (SELECT asset,
    count(*) FILTER ({full}) AS n, avg({y}) FILTER ({full}) AS my, avg({a}) FILTER ({full}) AS ma, avg({b}) FILTER ({full}) AS mb, var_pop({a}) FILTER ({full}) AS aa, var_pop({b}) FILTER ({full}) AS bb,
    covar_pop({a}, {b}) FILTER ({full}) AS ab, covar_pop({a}, {y}) FILTER ({full}) AS ay, covar_pop({b}, {y}) FILTER ({full}) AS yb FROM f GROUP BY 1) k ON f.asset = k.asset"""


_ORTHO_IC = f"{F},\n  s AS (SELECT * FROM ({' UNION ALL '.join(_ortho(y) for y in STUDIED)}) WHERE value IS NOT NULL),\n  {_FW},\n  {_RANK}"
_SUMMARY = "SELECT feature_id, h, avg(ic) AS ic_mean, CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) END AS icir, count(ic) AS n, stddev_samp(ic) / nullif(sqrt(count(ic)), 0) AS stderr FROM ic GROUP BY 1, 2"


def _summary(digits: int) -> str:
    return f" SELECT feature_id, h, round(ic_mean, {digits}) AS ic_mean, round(icir, {digits}) AS icir, n, round(stderr, {digits}) AS stderr FROM ({_SUMMARY})"


_REGIME = f"""rv AS (SELECT d, rv_30d AS rv FROM f WHERE asset = (SELECT min(asset) FROM p)),
  rg AS (SELECT d, CASE WHEN rv >= (SELECT quantile_cont(rv, 0.5) FROM rv) THEN 'high_vol' WHEN rv IS NOT NULL THEN 'low_vol' END AS regime FROM rv)"""
_BYREG = f"""{_REGIME},
  br AS (SELECT feature_id, h, regime, avg(ic) AS m, stddev_samp(ic) AS sd, count(*) AS c FROM ic JOIN rg ON ic.d = rg.d WHERE ic IS NOT NULL AND regime IS NOT NULL GROUP BY 1, 2, 3),
  re0 AS (SELECT hz.feature_id, hz.h, x.regime, br.m, br.sd, coalesce(br.c, 0) AS c FROM hz CROSS JOIN (VALUES ('high_vol'), ('low_vol')) x(regime) LEFT JOIN br ON br.feature_id = hz.feature_id AND br.h = hz.h AND br.regime = x.regime WHERE hz.feature_id IN (SELECT feature_id FROM dt)),
  reg AS (SELECT feature_id, h, regime, CASE WHEN c >= 10 THEN round(m, 4) END AS mean_ic, CASE WHEN c >= 10 THEN round(sd, 4) END AS std_ic, CASE WHEN c >= 10 AND sd > 0 THEN round(m / sd, 3) END AS icir, CASE WHEN c >= 10 THEN c ELSE 0 END AS n FROM re0)"""
_CORR = """w2 AS (SELECT a.feature_id AS f1, b.feature_id AS f2, a.value AS x, b.value AS y FROM s a JOIN s b ON a.asset = b.asset AND a.d = b.d AND a.feature_id < b.feature_id),
  w3 AS (SELECT f1, f2, rank() OVER (PARTITION BY f1, f2 ORDER BY x) + (count(*) OVER (PARTITION BY f1, f2, x) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY f1, f2 ORDER BY y) + (count(*) OVER (PARTITION BY f1, f2, y) - 1) / 2.0 AS rb FROM w2),
  co AS (SELECT f1, f2, count(*) AS n, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS rho FROM w3 GROUP BY 1, 2)"""
_PAIRS = "cp AS (SELECT f1, f2, round(rho, 3) AS rho, abs(rho) >= 0.7 AS flagged FROM co WHERE n >= 30 AND rho IS NOT NULL)"
_S = f"{F},\n  s AS ({_long(STUDIED)})"
_SALL = f"{F},\n  s AS ({_long(STUDIED, '')})"
_WARM = ", ".join(f"('{f}', {qa_warmup(REGISTRY[f])})" for f in STUDIED)
_REF = f"{_SALL},\n  v AS (SELECT * FROM s WHERE asset = (SELECT min(asset) FROM p))"
_EXPL = f"""h0 AS (SELECT * FROM s WHERE value IS NOT NULL),
  h1 AS (SELECT feature_id, asset, d, {roll("value", 252, "stddev_samp", 126, "PARTITION BY feature_id, asset ORDER BY d")} AS sd FROM h0),
  ex AS (SELECT feature_id, asset, count(*) AS n, max_by(sd, d) FILTER (sd IS NOT NULL) / nullif(min_by(sd, d) FILTER (sd IS NOT NULL), 0) AS ratio FROM h1 GROUP BY 1, 2),
  exp AS (SELECT feature_id, asset, n, ratio, n < 504 OR coalesce(ratio < 5, false) AS passed FROM ex)"""
_T = f"""{F},
  t AS (SELECT asset, d, r1, lead(r1) OVER ({_W}) AS fwd, {z("r1", 30)} AS z FROM f),
  tr AS (SELECT asset, d, z, fwd, CASE WHEN z > 0 THEN 1 ELSE -1 END AS pos, (CASE WHEN z > 0 THEN 1 ELSE -1 END) * fwd AS strat FROM t)"""


def _book(centred: bool) -> str:
    s = "z - avg(z) OVER (PARTITION BY d)" if centred else "z"
    return f"""{_T},
  bk AS (SELECT d, fwd, {s} AS s FROM tr),
  bw AS (SELECT d, fwd, s / nullif(sum(abs(s)) OVER (PARTITION BY d), 0) AS w FROM bk),
  pf AS (SELECT d, coalesce(sum(w * fwd), 0) AS ret FROM bw GROUP BY 1),
  eq AS (SELECT d, ret, product(1 + ret) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS equity FROM pf),
  dd AS (SELECT d, ret, equity, equity / nullif(max(equity) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 0) - 1 AS drawdown FROM eq)"""


_SHARPE = "avg({0}) / nullif(stddev_samp({0}), 0) * sqrt({1})"
_SLASH = "coalesce(abs(icir), 0)"
_DAYS = "(SELECT DISTINCT asset FROM p) a CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(d) FROM p), (SELECT max(d) FROM p), INTERVAL 1 DAY)) AS DATE) AS day) g"
_SPOTS = """di AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM p)),
  sp AS (SELECT d FROM di WHERE n <= 10 OR floor((i * 10 + 5) / n) <> floor(((i - 1) * 10 + 5) / n) ORDER BY d LIMIT 10)"""

SQL: dict[str, str] = {
    "bars_daily": f"{P} SELECT * REPLACE (strftime(d, '%Y-%m-%d') AS d) FROM p",
    "bars_dedupe": f"""WITH x AS (SELECT exchange, upper(trim(symbol)) AS symbol, {_DAY} AS d, {_NN("close")} AS close, {_NN("volume")} AS volume, row_number() OVER (PARTITION BY exchange, upper(trim(symbol)), {_DAY} ORDER BY {_US}, bar_id) AS rn
  FROM ohlcv_1d WHERE ts_open IS NOT NULL) SELECT exchange, symbol, {_D}, close, volume FROM x WHERE rn = 1""",
    "bars_log_return": f"{F} SELECT asset, {_D}, round(ret_1d, 6) AS log_ret, round(r1, 6) AS ret FROM f",
    "bars_hourly_events": """SELECT event_type AS asset, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, round(sum(value), 4) AS volume, count(*) AS n_trades FROM events GROUP BY 1, 2""",
    "bars_klines": f"""SELECT exchange, upper(trim(symbol)) AS symbol, count(*) AS n, CAST(sum(n_trades) AS BIGINT) AS n_trades, min(CAST(floor(({_US}) / 1000.0) AS BIGINT) * 1000) AS ts_open, max({_NN("close")}) AS close
  FROM ohlcv_1d WHERE ts_open IS NOT NULL AND ts_close IS NOT NULL GROUP BY 1, 2""",
    **{f"feat_{n}": f"{F} SELECT asset, {_D}, round({n}, 6) AS value FROM f" for n in PRICE},
    "feat_funding_zscore_14d": f"""WITH t AS (SELECT exchange || ':' || upper(trim(symbol)) AS asset, {_DAY.replace("ts_open", "ts")} AS d, {_NN("funding_rate")} AS x, funding_rate AS raw, received_at, ts FROM derivative_ticker WHERE ts IS NOT NULL),
  g AS (SELECT asset, d, x FROM (SELECT *, row_number() OVER (PARTITION BY asset, d ORDER BY received_at DESC NULLS LAST, ts DESC, raw DESC NULLS LAST) AS rn FROM t) WHERE rn = 1)
  SELECT asset, {_D}, round({z("x", 14)}, 6) AS value FROM g""",
    "feat_obi_0_5pct": f"""WITH t AS (SELECT exchange || ':' || upper(trim(symbol)) AS asset, ts, {_NN("bid_price_0")} AS b, {_NN("ask_price_0")} AS a, {_NN("bid_size_0")} AS bs, {_NN("ask_size_0")} AS sz FROM book_snapshot_25),
  m AS (SELECT *, (b + a) / 2 AS mid FROM t), i AS (SELECT *, CASE WHEN mid IS NULL THEN NULL WHEN b >= mid * 0.995 THEN bs ELSE 0 END AS bi, CASE WHEN mid IS NULL THEN NULL WHEN a <= mid * 1.005 THEN sz ELSE 0 END AS ai FROM m)
  SELECT asset, ts, round((bi - ai) / nullif(bi + ai, 0), 6) AS value FROM i""",
    "feat_long_store": f"{F},\n  s AS ({_long(PRICE)}) SELECT feature_id, count(*) AS n, round(avg(value), 4) AS mean, count(DISTINCT asset) AS assets FROM s GROUP BY 1",
    "feat_range": f"{F},\n  s AS ({_long(['ret_1d', 'mom_20d', 'reversal_5d'])}) SELECT epoch_us(CAST(d AS TIMESTAMP)) AS ts, feature_id, 'v1' AS version, asset, round(value, 6) AS value FROM s WHERE d BETWEEN DATE '2024-04-01' AND DATE '2024-06-30'",
    "cs_zscore": f"{F} SELECT asset, {_D}, round((mom_20d - avg(mom_20d) OVER w) / nullif(stddev_samp(mom_20d) OVER w, 0), 6) AS z FROM f WHERE mom_20d IS NOT NULL WINDOW w AS (PARTITION BY f.d)",
    "cs_demean_weights": f"{F}, c AS (SELECT asset, d, mom_20d - avg(mom_20d) OVER (PARTITION BY d) AS m FROM f WHERE mom_20d IS NOT NULL) SELECT asset, {_D}, round(m, 6) AS m, round(m / nullif(sum(abs(m)) OVER (PARTITION BY c.d), 0), 6) AS w FROM c",
    "gross_weights": f"{F} SELECT asset, {_D}, round(mom_20d / nullif(sum(abs(mom_20d)) OVER (PARTITION BY f.d), 0), 6) AS w FROM f WHERE mom_20d IS NOT NULL",
    "fwd_ret": f"{F},\n  {_FW} SELECT asset, {_D}, h, round(fwd, 6) AS fwd FROM fwv",
    "dollar_neutral": f"""{F}, c AS (SELECT asset, d, mom_20d - avg(mom_20d) OVER (PARTITION BY d) AS m FROM f WHERE mom_20d IS NOT NULL), w AS (SELECT d, m / nullif(sum(abs(m)) OVER (PARTITION BY d), 0) AS w FROM c),
  n AS (SELECT d, sum(w) AS net, sum(abs(w)) AS gross FROM w GROUP BY 1) SELECT round(avg(net), 6) + 0.0 AS mean_net, round(avg(gross), 6) AS mean_gross FROM n""",
    "ic_daily": f"{IC} SELECT feature_id, h, {_D}, round(ic, 6) AS ic FROM ic",
    "ic_summary": IC + _summary(6),
    "ic_rolling63": f"""{IC}, hv AS (SELECT * FROM ic WHERE ic IS NOT NULL), ro AS (SELECT feature_id, h, d, {roll("ic", 63, "avg", 20, "PARTITION BY feature_id, h ORDER BY d")} AS m, {roll("ic", 63, "stddev_samp", 20, "PARTITION BY feature_id, h ORDER BY d")} AS sd FROM hv)
  SELECT feature_id, h, {_D}, round(m, 9) AS ic_roll, round(m / nullif(sd, 0), 9) AS icir_roll FROM ro""",
    "ic_monthly": f"""{IC}, mo AS (SELECT feature_id, h, date_trunc('month', d) AS month, avg(ic) AS ic FROM ic GROUP BY 1, 2, 3), sp AS (SELECT feature_id, h, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM mo GROUP BY 1, 2)
  SELECT sp.feature_id, sp.h, strftime(sp.month, '%Y-%m') AS month, round(mo.ic, 6) AS ic FROM sp LEFT JOIN mo ON sp.feature_id = mo.feature_id AND sp.h = mo.h AND sp.month = mo.month""",
    "ic_hist": f"""{IC}, hv AS (SELECT feature_id, h, round(ic, 9) AS ic FROM ic WHERE ic IS NOT NULL), lo AS (SELECT *, min(ic) OVER w AS a, max(ic) OVER w AS z FROM hv WINDOW w AS (PARTITION BY feature_id, h))
  SELECT feature_id, h, CAST(least(40, floor(coalesce((ic - a) / nullif(z - a, 0), 0) * 40) + 1) AS INTEGER) AS bin, count(*) AS n FROM lo GROUP BY 1, 2, 3""",
    "ic_ortho": _ORTHO_IC + _summary(4),
    "ic_raw_ortho": f"""SELECT feature_id, h, round(ic_mean, 4) AS ic_mean, round(icir, 4) AS icir, n, 'raw' AS kind FROM ({IC} {_SUMMARY}) UNION ALL SELECT feature_id, h, round(ic_mean, 4), round(icir, 4), n, 'ortho' FROM ({_ORTHO_IC} {_SUMMARY})""",
    "ic_regime_bars": f"{IC},\n  {_BYREG} SELECT feature_id, h, regime, round(m, 4) AS mean_ic, c AS n FROM re0",
    "ic_pooled": f"""{F},\n  {_FW}, x AS (SELECT w.h, f.mom_20d AS x, w.fwd AS y FROM f JOIN fwv w ON f.asset = w.asset AND f.d = w.d WHERE mom_20d IS NOT NULL),
  r AS (SELECT h, rank() OVER (PARTITION BY h ORDER BY x) + (count(*) OVER (PARTITION BY h, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY h ORDER BY y) + (count(*) OVER (PARTITION BY h, y) - 1) / 2.0 AS b FROM x)
  SELECT h, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(corr(a, b), 6) END AS ic FROM r GROUP BY 1""",
    "ortho_residuals": f"{F} SELECT asset, {_D}, round(value, 6) AS value FROM ({_ortho('reversal_5d')})",
    "regime_labels": f"{F},\n  {_REGIME} SELECT {_D}, regime FROM rg",
    "ic_by_regime": f"{IC},\n  {_BYREG} SELECT * FROM reg",
    "corr_matrix": f"{_S},\n  {_CORR} SELECT f1, f2, n, round(rho, 6) AS rho FROM co",
    "collinearity": f"{_S},\n  {_CORR},\n  {_PAIRS} SELECT * FROM cp",
    "rank_features": f"""{IC},\n  {_BYREG}, su AS ({_SUMMARY}), be AS (SELECT feature_id, regime FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY abs(mean_ic) DESC, regime DESC) AS rn FROM reg WHERE h = 1 AND mean_ic IS NOT NULL) WHERE rn = 1)
  SELECT su.feature_id, round(ic_mean, 4) AS ic_mean, round(icir, 3) AS icir, be.regime AS best_regime, coalesce(abs(icir) >= 0.1, false) AS exploitable, CAST(row_number() OVER (ORDER BY {_SLASH} DESC, su.feature_id) AS INTEGER) AS position FROM su LEFT JOIN be ON su.feature_id = be.feature_id WHERE h = 1""",
    "composite_weights": f"""{IC},\n  {_CORR},\n  {_PAIRS}, su AS (SELECT feature_id, {_SLASH} AS g FROM ({_SUMMARY}) WHERE h = 5),
  wk AS (SELECT DISTINCT CASE WHEN coalesce(a.g, 0) >= coalesce(b.g, 0) THEN f2 ELSE f1 END AS feature_id FROM cp LEFT JOIN su a ON a.feature_id = f1 LEFT JOIN su b ON b.feature_id = f2 WHERE flagged),
  lf AS (SELECT * FROM su WHERE g >= 0.05 AND feature_id NOT IN (SELECT feature_id FROM wk)) SELECT feature_id, round(1.0::DOUBLE / count(*) OVER (), 3) AS equal_weight, round(g / sum(g) OVER (), 3) AS icir_weight FROM lf QUALIFY count(*) OVER () >= 2""",
    "leaderboard": f"""{IC.replace("s AS (" + _long(STUDIED) + ")", "s0 AS (" + _long(STUDIED, "") + "), s AS (SELECT * FROM s0 WHERE value IS NOT NULL)")},
  {_EXPL.replace("FROM s WHERE", "FROM s0 WHERE")}, su AS ({_SUMMARY}), be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY abs(ic_mean) DESC, h) AS rn FROM su WHERE ic_mean IS NOT NULL) WHERE rn = 1), qa AS (SELECT feature_id, bool_and(passed) AS qa_passed FROM exp GROUP BY 1)
  SELECT be.feature_id, h AS best_h, round(ic_mean, 4) AS ic_mean, round(icir, 3) AS icir, qa_passed FROM be LEFT JOIN qa ON be.feature_id = qa.feature_id""",
    "qa_distribution": f"""{_REF}, hv AS (SELECT feature_id, d, value, lag(value) OVER (PARTITION BY feature_id, asset ORDER BY d) AS prev FROM v WHERE value IS NOT NULL),
  st AS (SELECT feature_id, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, covar_pop(value, prev) / nullif(stddev_pop(value) FILTER (prev IS NOT NULL) * stddev_pop(prev), 0) AS ac1 FROM hv GROUP BY 1),
  o AS (SELECT hv.feature_id, avg(CASE WHEN abs(value - mean) > 10 * std THEN 1.0::DOUBLE ELSE 0 END) AS outlier_share FROM hv JOIN st ON hv.feature_id = st.feature_id GROUP BY 1)
  SELECT st.feature_id, n, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(ac1, 6) AS ac1, round(outlier_share, 6) AS outlier_share, n >= 30 AND outlier_share < 0.01 AS passed FROM st JOIN o ON st.feature_id = o.feature_id""",
    "qa_coverage": f"""{_SALL}, wu AS (SELECT * FROM (VALUES {_WARM}) t(feature_id, k)),
  i AS (SELECT s.feature_id, asset, value, row_number() OVER (PARTITION BY s.feature_id, asset ORDER BY d) > k AS late FROM s JOIN wu ON s.feature_id = wu.feature_id),
  c AS (SELECT feature_id, asset, count(*) FILTER (late) AS n, count(*) FILTER (late AND value IS NULL) / nullif(count(*) FILTER (late), 0)::DOUBLE AS x FROM i GROUP BY 1, 2)
  SELECT feature_id, asset, n, round(x, 6) AS missing_share, coalesce(x <= 0.2, false) AS passed FROM c""",
    "qa_explosion": f"{_SALL},\n  {_EXPL} SELECT feature_id, asset, n, round(ratio, 4) AS ratio, passed FROM exp",
    "qa_lookahead": f"{_SALL}, {_SPOTS} SELECT feature_id, strftime(s.d, '%Y-%m-%d') AS spot, count(*) AS n, CAST(0 AS BIGINT) AS n_bad FROM s JOIN sp ON s.d = sp.d GROUP BY 1, 2",
    "qa_lookahead_planted": f"""{P}, {_SPOTS}, x AS (SELECT asset, d, lead(close) OVER ({_W}) AS v FROM p)
  SELECT 'peek' AS feature_id, strftime(x.d, '%Y-%m-%d') AS spot, count(*) AS n, count(v) AS n_bad FROM x JOIN sp ON x.d = sp.d GROUP BY 2 UNION ALL SELECT 'ret_1d', strftime(x.d, '%Y-%m-%d'), count(*), 0 FROM x JOIN sp ON x.d = sp.d GROUP BY 2""",
    "feat_composite_ewm": f"""{F}, o AS (SELECT asset, d, r1, row_number() OVER ({_W}) AS i FROM f),
  e AS (SELECT a.asset, a.d, w, any_value(a.r1) AS r, count(*) AS n, sum(pow(1 - 2.0 / (w + 1), a.i - b.i)) AS s1, sum(pow(1 - 2.0 / (w + 1), 2 * (a.i - b.i))) AS s2, sum(pow(1 - 2.0 / (w + 1), a.i - b.i) * b.r1) / sum(pow(1 - 2.0 / (w + 1), a.i - b.i)) AS m
    FROM o a JOIN o b ON a.asset = b.asset AND b.i <= a.i AND b.r1 IS NOT NULL CROSS JOIN (SELECT unnest([15, 30, 60, 80, 100]) AS w) GROUP BY 1, 2, 3),
  v AS (SELECT e.asset, e.d, e.w, any_value(r) AS r, any_value(n) AS n, any_value(m) AS m, sum(pow(1 - 2.0 / (e.w + 1), a.i - b.i) * (b.r1 - m) * (b.r1 - m)) / any_value(s1) * any_value(s1 * s1 / nullif(s1 * s1 - s2, 0)) AS var
    FROM e JOIN o a ON a.asset = e.asset AND a.d = e.d JOIN o b ON b.asset = a.asset AND b.i <= a.i AND b.r1 IS NOT NULL GROUP BY 1, 2, 3),
  z AS (SELECT asset, d, CASE WHEN count(CASE WHEN n >= w THEN (r - m) / nullif(sqrt(var), 0) END) = 5 THEN avg((r - m) / nullif(sqrt(var), 0)) END AS value FROM v GROUP BY 1, 2)
  SELECT o.asset, strftime(o.d, '%Y-%m-%d') AS d, round(z.value, 6) AS value FROM o LEFT JOIN z ON o.asset = z.asset AND o.d = z.d""",
    "ls_binary": f"{_T} SELECT asset, {_D}, pos, round(strat, 6) AS strat FROM tr",
    "ls_binary_inverted": f"{_T} SELECT asset, {_D}, -pos AS pos, round(-strat, 6) AS strat FROM tr",
    "portfolio_prop": f"{_book(False)} SELECT {_D}, round(ret, 6) AS ret FROM pf",
    "portfolio_demeaned": f"{_book(True)} SELECT {_D}, round(ret, 6) AS ret FROM pf",
    "portfolio_mean_binary": f"{_T} SELECT {_D}, round(avg(strat), 6) AS ret, round(avg(fwd), 6) AS hold FROM tr GROUP BY tr.d",
    "equity_curve": f"{_book(True)} SELECT {_D}, round(equity, 6) AS equity FROM dd",
    "drawdown": f"{_book(True)} SELECT {_D}, round(drawdown, 6) AS drawdown FROM dd",
    "portfolio_summary": f"{_book(True)} SELECT 'portfolio' AS asset, round({_SHARPE.format('ret', 252)}, 6) AS sharpe, round(min(drawdown), 6) AS max_drawdown, round(count(*) FILTER (ret > 0) / nullif(count(ret), 0)::DOUBLE, 6) AS win_rate, round(max_by(equity, d) - 1, 6) AS total_return, count(ret) AS n FROM dd",
    "sharpe_summary": f"{_T} SELECT asset, round({_SHARPE.format('strat', 252)}, 6) AS sharpe, round(count(*) FILTER (strat > 0) / nullif(count(strat), 0)::DOUBLE, 6) AS win_rate, count(strat) AS n FROM tr GROUP BY 1",
    "rolling_sharpe": f"{_T} SELECT asset, {_D}, round({roll('strat', 63, 'avg', 20)} / nullif({roll('strat', 63, 'stddev_samp', 20)}, 0) * sqrt(252), 5) AS sharpe FROM (SELECT * FROM tr)",
    "sharpe_by_window": f"{F}, t AS (SELECT asset, d, lead(r1) OVER ({_W}) AS fwd, {', '.join(f'{z("r1", w)} AS z{w}' for w in (15, 30, 60, 80, 100))} FROM f), g AS ({' UNION ALL '.join(f'SELECT asset, {w} AS w, CASE WHEN z{w} > 0 THEN fwd ELSE -fwd END AS strat FROM t' for w in (15, 30, 60, 80, 100))}) SELECT asset, w, round({_SHARPE.format('strat', 252)}, 6) AS sharpe FROM g GROUP BY 1, 2",
    "descriptives": f"""{F}, x AS (SELECT p.asset, p.d, close, volume, ret_1d AS lr, close / nullif(max(close) OVER (PARTITION BY p.asset ORDER BY p.d ROWS UNBOUNDED PRECEDING), 0) - 1 AS dd FROM p JOIN f ON p.asset = f.asset AND p.d = f.d)
  SELECT asset, round(avg(lr) * 365, 4) AS ann_return, round(stddev_samp(lr) * sqrt(365), 4) AS ann_vol, round({_SHARPE.format('lr', 365)}, 4) AS sharpe, round(min(dd), 4) AS max_drawdown,
  round(max_by(close, d) FILTER (close IS NOT NULL) / nullif(min_by(close, d) FILTER (close IS NOT NULL), 0) - 1, 4) AS total_return, round(avg(volume), 4) AS avg_volume FROM x GROUP BY 1""",
    "skew_kurt": f"{F} SELECT asset, round(skewness(ret_1d), 4) AS skew, round(kurtosis(ret_1d), 4) AS kurtosis FROM f GROUP BY 1",
    "store_load_slice": f"SELECT ts, {_NN('value')} AS value FROM features WHERE version = 'v1' AND (feature_id, asset) = (SELECT (feature_id, asset) FROM features WHERE version = 'v1' ORDER BY feature_id, asset LIMIT 1) AND ts >= epoch_us(TIMESTAMP '2024-01-01') AND ts < epoch_us(TIMESTAMP '2024-12-31')",
    "store_sql_agg": f"SELECT feature_id, asset, count(*) AS n, round(avg({_NN('value')}), 6) AS mean FROM features WHERE version = 'v1' GROUP BY 1, 2",
    "plan_missing": f"{P} SELECT a.asset, strftime(g.day, '%Y-%m-%d') AS day FROM {_DAYS} WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.asset = a.asset AND p.d = g.day)",
    "coverage_gate": f"{P}, c AS (SELECT a.asset, count(*) AS planned, count(*) FILTER (p.asset IS NULL) AS missing FROM {_DAYS} LEFT JOIN p ON p.asset = a.asset AND p.d = g.day GROUP BY 1) SELECT *, missing = 0 AS complete FROM c",
}
