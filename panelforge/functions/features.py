"""The feature registry: what each feature needs, and the expressions it is made of.

A feature is up to three layers of columns over one window spec, so all features
of a source are computed side by side after a single exchange and sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as k

Layer = Callable[[dict], dict[str, Column]]


@dataclass(frozen=True)
class FeatureSpec:
    id: str
    family: str
    requires: tuple[str, ...]
    value: Callable[[dict], Column]
    params: dict = field(default_factory=dict)
    first: Layer = lambda p: {}
    second: Layer = lambda p: {}
    #: Columns of these layers and the windows of their rolling scores.
    scores: Callable[[dict], dict[str, tuple[int, ...]]] = lambda p: {}
    #: Rows before a value can come, from the parameters.
    warmup: Callable[[dict], int] = lambda p: 0
    source: str = "ohlcv_1d"
    version: str = "v1"

    def with_params(self, **params) -> FeatureSpec:
        return replace(self, params=self.params | params)

    @property
    def warmup_rows(self) -> int:
        return self.warmup(self.params)


def _c(name: str) -> Column:
    return F.col(name)


def _lr(p: dict) -> dict[str, Column]:
    return {"_lr": k.log_change(F.col("close"))}


def _r1(p: dict) -> dict[str, Column]:
    return {"_r1": k.change(F.col("close"))}


def _obi(p: dict) -> Column:
    mid = (_c("bid_price_0") + _c("ask_price_0")) / 2
    reach = p["depth_pct"] / 100
    bid = F.when(_c("bid_price_0") >= mid * (1 - reach), _c("bid_size_0")).otherwise(F.when(_c("bid_price_0").isNull() | mid.isNull(), None).otherwise(0.0))
    ask = F.when(_c("ask_price_0") <= mid * (1 + reach), _c("ask_size_0")).otherwise(F.when(_c("ask_price_0").isNull() | mid.isNull(), None).otherwise(0.0))
    return k.div(bid - ask, F.nullif(bid + ask, F.lit(0.0)))


_SPECS = [
    FeatureSpec("ret_1d", "returns", ("close",), lambda p: _c("_lr"), first=_lr, warmup=lambda p: 1),
    FeatureSpec("mom_20d", "momentum", ("close",), lambda p: k.roll(_c("_lr"), p["window_d"], F.sum), {"window_d": 20}, _lr, warmup=lambda p: p["window_d"]),
    FeatureSpec("rv_30d", "volatility", ("close",), lambda p: k.roll(_c("_lr"), p["window_d"], F.stddev_samp) * math.sqrt(365), {"window_d": 30}, _lr, warmup=lambda p: p["window_d"]),
    FeatureSpec(
        "cvd_20d", "microstructure", ("volume", "taker_buy_vol"),
        lambda p: k.div(k.roll(_c("_signed"), p["window_d"], F.sum), F.nullif(k.roll(_c("volume"), p["window_d"], F.avg), F.lit(0.0))),
        {"window_d": 20}, lambda p: {"_signed": 2 * _c("taker_buy_vol") - _c("volume")}, warmup=lambda p: p["window_d"] - 1,
    ),
    FeatureSpec("funding_zscore_14d", "derivatives", ("funding_rate",), lambda p: k.zscore(_c("funding_rate"), p["lookback_d"]), {"lookback_d": 14}, warmup=lambda p: p["lookback_d"] - 1, source="derivative_ticker"),
    FeatureSpec(
        "rel_mom_20d", "momentum", ("close",), lambda p: k.ready_zscore(f"_pc_{p['window_mom']}", p["window_norm"]), {"window_mom": 20, "window_norm": 252},
        lambda p: {f"_pc_{p['window_mom']}": k.change(_c("close"), p["window_mom"])}, scores=lambda p: {f"_pc_{p['window_mom']}": (p["window_norm"],)}, warmup=lambda p: p["window_mom"] + p["window_norm"] - 1,
    ),
    FeatureSpec("reversal_5d", "momentum", ("close",), lambda p: -k.change(_c("close"), p["window_d"]), {"window_d": 5}, warmup=lambda p: p["window_d"]),
    FeatureSpec(
        "taker_ratio_20d", "microstructure", ("volume", "taker_buy_vol"), lambda p: k.zscore(_c("_taker"), p["window_d"]), {"window_d": 20},
        lambda p: {"_taker": k.div(_c("taker_buy_vol"), F.nullif(_c("volume"), F.lit(0.0)))}, warmup=lambda p: p["window_d"] - 1,
    ),
    FeatureSpec(
        "risk_adj_ret_20d", "momentum", ("close",), lambda p: k.ready_zscore(f"_risk_{p['window_ret']}", p["window_norm"]), {"window_ret": 20, "window_norm": 252},
        lambda p: _lr(p) | {f"_pc_{p['window_ret']}": k.change(_c("close"), p["window_ret"])},
        lambda p: {f"_risk_{p['window_ret']}": k.div(_c(f"_pc_{p['window_ret']}"), k.spread(k.roll(_c("_lr"), p["window_ret"], F.stddev_samp) * math.sqrt(252)))},
        scores=lambda p: {f"_risk_{p['window_ret']}": (p["window_norm"],)}, warmup=lambda p: p["window_ret"] + p["window_norm"] - 1,
    ),
    FeatureSpec(
        "hl_range_20d", "volatility", ("close", "high", "low"), lambda p: k.ready_zscore(f"_hl_{p['window_d']}", p["window_norm"]), {"window_d": 20, "window_norm": 252},
        lambda p: {"_hl": k.div(_c("high") - _c("low"), F.nullif(_c("close"), F.lit(0.0)))},
        lambda p: {f"_hl_{p['window_d']}": k.roll(_c("_hl"), p["window_d"], F.avg)}, scores=lambda p: {f"_hl_{p['window_d']}": (p["window_norm"],)}, warmup=lambda p: p["window_d"] + p["window_norm"] - 2,
    ),
    FeatureSpec("dist_from_high_20d", "momentum", ("close",), lambda p: k.div(_c("close"), k.roll(_c("close"), p["window_d"], F.max)) - 1, {"window_d": 20}, warmup=lambda p: p["window_d"] - 1),
    FeatureSpec(
        "vol_ratio_20d", "microstructure", ("volume",), lambda p: k.ready_zscore(f"_vr_{p['window_d']}", p["window_norm"]), {"window_d": 20, "window_norm": 252},
        second=lambda p: {f"_vr_{p['window_d']}": k.div(_c("volume"), F.nullif(k.roll(_c("volume"), p["window_d"], F.avg), F.lit(0.0)))}, scores=lambda p: {f"_vr_{p['window_d']}": (p["window_norm"],)}, warmup=lambda p: p["window_d"] + p["window_norm"] - 2,
    ),
    FeatureSpec("trades_zscore_20d", "microstructure", ("n_trades",), lambda p: k.zscore(_c("n_trades").cast("double"), p["window_d"]), {"window_d": 20}, warmup=lambda p: p["window_d"] - 1),
    FeatureSpec(
        "zscore_ret_composite", "returns", ("close",), lambda p: k.mean_of([k.ready_zscore("_r1", w) for w in p["windows"]]),
        {"windows": (15, 30, 60, 80, 100, 150, 200, 250, 300)}, _r1, scores=lambda p: {"_r1": tuple(p["windows"])}, warmup=lambda p: max(p["windows"]),
    ),
    FeatureSpec("obi_0_5pct", "microstructure", ("bid_price_0", "ask_price_0", "bid_size_0", "ask_size_0"), _obi, {"depth_pct": 0.5}, source="book_snapshot_25"),
]
#: Every feature by id, in registry order.
REGISTRY: dict[str, FeatureSpec] = {s.id: s for s in _SPECS}
#: Windows the composite takes where none are given (the registry gives nine).
DEFAULT_COMPOSITE_WINDOWS = (15, 30, 60, 80, 100)
#: Horizons in rows, by family.
HORIZONS = {"returns": (1, 3, 5, 7), "volatility": (1, 3, 5, 7), "momentum": (1, 3, 5, 7), "derivatives": (1, 3, 5), "microstructure": (1, 3)}
PRICE_FEATURES = [s.id for s in _SPECS if s.source == "ohlcv_1d"]


def specs(ids: list[str] | None = None) -> list[FeatureSpec]:
    return [REGISTRY[i] for i in (ids or PRICE_FEATURES)]


def compute(panel: DataFrame, wanted: list[FeatureSpec], keep: tuple[str, ...] = ()) -> DataFrame:
    """asset, d, ``keep`` and one column a feature. A feature whose columns the panel lacks is all null."""
    have = set(panel.columns)
    able = [s for s in wanted if set(s.requires) <= have]
    out = panel
    for layer in ("first", "second"):
        added = {}
        for s in able:
            added |= getattr(s, layer)(s.params)
        if added:
            out = out.withColumns(added)
    # what windows make comes first, while the rows still lie by asset; scores are put together from moments, row by row
    moments: dict[str, set[int]] = {}
    for s in able:
        for x, lengths in s.scores(s.params).items():
            moments.setdefault(x, set()).update(lengths)
    plain = {s.id: s.value(s.params) for s in able if not s.scores(s.params)}
    out = out.select(k.ASSET, k.TIME, *keep, *[c.alias(i) for i, c in plain.items()], *sorted(moments))
    out = k.with_moments(out, moments)
    values = [F.col(s.id) if s.id in plain else (s.value(s.params) if s in able else F.lit(None).cast("double")).alias(s.id) for s in wanted]
    return out.select(k.ASSET, k.TIME, *keep, *values)


def to_long(wide: DataFrame, ids: list[str], drop_null: bool = True) -> DataFrame:
    """(asset, d, feature_id, value), by default without the rows that have no value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("feature_id"), F.col(i).alias("value")) for i in ids]))
    long = wide.select(k.ASSET, k.TIME, pairs.alias("f")).select(k.ASSET, k.TIME, "f.feature_id", "f.value")
    return long.filter(F.col("value").isNotNull()) if drop_null else long


def ewm_composite(panel: DataFrame, windows: tuple[int, ...] = DEFAULT_COMPOSITE_WINDOWS) -> DataFrame:
    """(asset, d, value): the composite with exponentially weighted means and deviations.

    Weights run over the whole history, which no bounded frame expresses, so
    each asset is one grouped call; it has a row a calendar day at most.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d", kind="stable")
        close = pdf["close"].astype(float)
        r = close / close.shift(1).where(close.shift(1) != 0) - 1
        zs = []
        for w in windows:
            e = r.ewm(span=w, min_periods=w, adjust=True)
            sd = e.std()
            zs.append((r - e.mean()) / sd.where(sd != 0))
        total = sum(zs[1:], zs[0]) / len(zs)
        return pd.DataFrame({"asset": pdf["asset"], "d": pdf["d"], "value": total})

    return panel.select("asset", "d", "close").groupBy("asset").applyInPandas(one, "asset string, d date, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))
