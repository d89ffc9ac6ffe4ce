"""The chains of jobs as plain functions over one session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import HORIZONS, REGISTRY, FeatureSpec, compute, specs, to_long
from ..operators import ic, panel, qa, synthesis
from ..operators.pairs import placed
from ..session import materialize
from ..sources.store import FeatureStore, report_json
from .incremental import compute_range

CONTROLS = ("mom_20d", "rv_30d")


@dataclass(frozen=True)
class Research:
    daily: DataFrame
    summary: DataFrame
    ortho: DataFrame
    regimes: DataFrame
    pairs: DataFrame
    ranking: DataFrame
    weights: DataFrame


def construct(bars: DataFrame, store: FeatureStore, d0: str, d1: str, wanted: list[FeatureSpec] | None = None) -> None:
    """Features of the days d0 to d1 into the store, but for those that are there: one computation for all of them, one write a family.

    Only features of which a day of an asset is still missing are computed, and
    nothing at all where none is.
    """
    wanted = wanted or specs()
    cells = bars.select("asset", F.col("d").alias("day")).filter(F.col("day").between(F.lit(d0).cast("date"), F.lit(d1).cast("date"))).distinct()
    ids = F.explode(F.array(*[F.struct(F.lit(s.id).alias("feature_id"), F.lit(s.version).alias("version")) for s in wanted])).alias("f")
    open_ids = {r[0] for r in store.missing(cells.select("asset", "day", ids).select("f.feature_id", "f.version", "asset", "day")).select("feature_id").distinct().collect()}
    wanted = [s for s in wanted if s.id in open_ids]
    if not wanted:
        return
    rows = materialize(compute_range(bars, wanted, d0, d1), "features")
    by_family: dict[str, list[str]] = {}
    for s in wanted:
        by_family.setdefault(s.family, []).append(s.id)
    for family, members in by_family.items():
        store.write(rows.filter(F.col("feature_id").isin(members)), family)


def controls_for(feature: str) -> list[str]:
    return [c for c in CONTROLS if c != feature]


def signals_wide(bars: DataFrame, ids: list[str], kind: str = "raw", horizons: tuple[int, ...] = ()) -> DataFrame:
    """asset, d, a column a feature, and ``fwd_{h}``: features as they are, or with the controls taken out ("ortho"); all of one exchange by asset."""
    need = [*ids, *(c for c in CONTROLS if kind == "ortho" and c not in ids)]
    keep = [f"fwd_{h}" for h in horizons]
    wide = compute(panel.forward_columns(bars, horizons) if horizons else bars, specs(need), tuple(keep))
    if kind == "raw":
        return wide.select("asset", "d", *ids, *keep)
    return ic.residuals_wide(wide, {f: controls_for(f) for f in ids}, keep)


def signals(bars: DataFrame, ids: list[str], kind: str = "raw") -> DataFrame:
    """(asset, d, feature_id, value) of ``signals_wide``, without the rows that have no value."""
    return to_long(signals_wide(bars, ids, kind), ids)


def horizons_of(ids: list[str], horizons: tuple[int, ...] | None = None) -> dict[str, tuple[int, ...]]:
    """The horizons each feature is studied at: those of its family, unless given."""
    return {f: horizons or HORIZONS[REGISTRY[f].family] for f in ids}


def coefficients(bars: DataFrame, ids: list[str], kind: str = "raw", horizons: tuple[int, ...] | None = None) -> DataFrame:
    """Daily coefficients (feature_id, h, d, ic), written once: a row a feature, horizon and date, which several statistics are taken of."""
    of = horizons_of(ids, horizons)
    wide = signals_wide(bars, ids, kind, tuple(sorted({h for hs in of.values() for h in hs})))
    return materialize(ic.daily_wide(wide, of), f"ic-{kind}")


def studied(bars: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """The features and their forward returns, written once, and the daily coefficients of them."""
    of = horizons_of(ids)
    table = placed(signals_wide(bars, ids, "raw", tuple(sorted({h for hs in of.values() for h in hs}))))
    return table, materialize(ic.daily_wide(table, of), "ic-raw")


def research(bars: DataFrame, ids: list[str], horizons: tuple[int, ...] | None, reference: str, horizon: int = 1) -> Research:
    """Coefficients, raw and with the controls taken out, and what follows from the raw ones."""
    daily = coefficients(bars, ids, "raw", horizons)
    summary = ic.summary(daily)
    ortho = ic.summary(coefficients(bars, ids, "ortho", horizons))
    regimes = ic.by_regime(daily, ic.regimes(bars, reference))
    pairs = synthesis.collinear(synthesis.correlations_wide(signals_wide(bars, ids), ids))
    return Research(daily, summary, ortho, regimes, pairs, synthesis.rank_features(summary, regimes, horizon), synthesis.composites(summary, pairs, horizon))


def ic_report(r: Research, assets: list[str]) -> str:
    """The report of every feature as JSON; a row a feature and horizon is collected."""
    docs: dict[str, dict] = {}
    for x in r.summary.collect():
        d = docs.setdefault(x.feature_id, {"feature_id": x.feature_id, "assets": assets, "horizons": [], "ic_mean": {}, "icir": {}, "regime": {}})
        d["horizons"].append(x.h)
        d["ic_mean"][x.h], d["icir"][x.h] = x.ic_mean, x.icir
    for x in r.ortho.collect():
        d = docs[x.feature_id]
        d.setdefault("ic_mean_ortho", {})[x.h], d.setdefault("icir_ortho", {})[x.h] = x.ic_mean, x.icir
    for x in r.regimes.collect():
        d = docs[x.feature_id]["regime"].setdefault(x.h, {})
        d[x.regime] = {"mean_ic": x.mean_ic, "std_ic": x.std_ic, "icir": x.icir, "n": x.n}
    for d in docs.values():
        d["horizons"].sort()
    return report_json([docs[k] for k in sorted(docs)])


def quality_report(bars: DataFrame, feature: str, reference: str) -> str:
    """The four checks of one feature as markdown, with an overall mark."""
    spec = REGISTRY[feature]
    values = to_long(compute(bars, [spec]), [feature], drop_null=False)
    one = values.filter(F.col("asset") == reference)
    d = qa.distribution(one).first()
    c = qa.coverage(values, {feature: qa.qa_warmup(spec)}).agg(F.min("passed"), F.count("*")).first()
    e = qa.explosion(one).first()
    u = qa.stationarity(one).first()
    bad = qa.lookahead(bars, [spec], qa.spots(bars)).agg(F.sum("n_bad")).first()[0]
    rows = [
        ("distribution", bool(d and d.passed and u and u.stationary), f"n {d.n if d else 0}, unit root p {u.p if u else None}"), ("coverage", bool(c[0]), f"{c[1]} assets"),
        ("lookahead", not bad, f"{bad or 0} values differ"), ("explosion", bool(e is None or e.passed), f"ratio {e.ratio if e else None}"),
    ]
    overall = all(ok for _, ok, _ in rows)
    mark = lambda ok: "✅ PASS" if ok else "❌ FAIL"
    table = "\n".join(f"| {n} | {mark(ok)} | {m} |" for n, ok, m in rows)
    return f"# Quality of {feature}\n\nOverall: {mark(overall)}\n\n| check | result | detail |\n|---|---|---|\n{table}\n"


def research_note(r: Research, horizon: int = 1) -> str:
    """Ranking, collinear pairs, composites and conclusion as markdown; a row a feature is collected."""
    ranking = r.ranking.orderBy("position").collect()
    pairs = r.pairs.filter("flagged").orderBy("f1", "f2").collect()
    weights = r.weights.orderBy("feature_id").collect()
    lines = [f"# Research note, horizon {horizon}", "", "## Ranking", "", "| # | feature | IC | ICIR | best regime |", "|---|---|---|---|---|"]
    lines += [f"| {x.position} | {x.feature_id} | {x.ic_mean} | {x.icir} | {x.best_regime or '-'} |" for x in ranking]
    decay = {}
    for x in r.summary.orderBy("feature_id", "h").collect():
        decay.setdefault(x.feature_id, []).append(f"{x.h}: {x.ic_mean if x.ic_mean is None else round(x.ic_mean, 4)}")
    lines += ["", "## Decay", "", *[f"- {f}: {', '.join(v)}" for f, v in decay.items()]]
    lines += ["", "## Collinear pairs", "", *([f"- {x.f1}, {x.f2}: {x.rho}" for x in pairs] or ["- none"])]
    lines += ["", "## Composites", "", *([f"- {x.feature_id}: {x.icir_weight}" for x in weights] or ["- none"])]
    best = [x.feature_id for x in ranking if x.exploitable]
    lines += ["", "## Conclusions", "", f"- exploitable: {', '.join(best) or 'none'}", ""]
    return "\n".join(lines)


def yesterday() -> str:
    import datetime as dt

    return (dt.datetime.now(dt.timezone.utc).date() - dt.timedelta(days=1)).isoformat()


def daily_flow(bars: DataFrame, store: FeatureStore, raw_root: str, day: str | None = None, wanted: list[FeatureSpec] | None = None) -> None:
    """Ingestion and features of one day, yesterday by default: raw bars of the registered schema are stored, then the features of that day."""
    from ..sources.bars import asset_key, bar_day
    from ..sources.store import load_raw, write_raw

    day = day or yesterday()
    write_raw(bars, raw_root)
    panel_rows = load_raw(bars.sparkSession, raw_root)
    panel_rows = panel_rows.select(asset_key(F.col("exchange"), F.col("symbol")).alias("asset"), bar_day(F.col("ts_open")).alias("d"), "open", "high", "low", "close", "volume", "quote_vol", "n_trades", "taker_buy_vol")
    construct(panel_rows, store, day, day, wanted)


def full_flow(bars: DataFrame, store: FeatureStore, d0: str, d1: str, reference: str, wanted: list[FeatureSpec] | None = None, horizon: int = 1) -> dict[str, str]:
    """Features, quality, coefficients and synthesis of a panel (asset, d, ...): the reports by name."""
    wanted = wanted or specs()
    construct(bars, store, d0, d1, wanted)
    assets = sorted(r[0] for r in bars.select("asset").distinct().collect())
    found = research(bars, [s.id for s in wanted], None, reference, horizon)
    return {"ic.json": ic_report(found, assets), "note.md": research_note(found, horizon)} | {f"qa_{s.id}.md": quality_report(bars, s.id, reference) for s in wanted}
