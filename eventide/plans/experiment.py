"""One lazy plan per experiment: bars to verdict.

Only the small aggregates of the decision are collected. Features and trades
are written once to the shared folder, as much reads them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.features import add_features, add_positions, with_series
from eventide.operators import baselines, costs, decision, events, metrics, quality, regimes, robustness, splits, trades
from eventide.operators import fx as fx_ops
from eventide.sources.market import dedupe_first
from eventide.sources.tables import materialize

from .semantics import Semantics


@dataclass
class Experiment:
    """A declared event and what to measure after it."""

    event_id: str
    conditions: list
    cooldown_sessions: int = 10
    horizons: tuple[int, ...] = trades.HORIZONS
    primary_horizon: int | None = None
    shares: tuple[float, float, float] = (0.6, 0.2, 0.2)
    semantics: Semantics = field(default_factory=Semantics)

    @classmethod
    def from_yaml(cls, path: str) -> Experiment:
        import yaml

        with open(path) as f:
            return cls.from_config(yaml.safe_load(f) or {}, path)

    @classmethod
    def from_config(cls, c: dict, name: str = "unnamed") -> Experiment:
        """From the sections experiment, event, validation and research, or from the same keys at the top."""
        about, event = c.get("experiment") or c, c.get("event") or c
        shares, research = c.get("validation") or {}, c.get("research") or {}
        conditions = event.get("conditions")
        if not conditions:
            raise ValueError(f"{name}: no conditions")
        if errors := events.range_errors(conditions):
            raise ValueError("; ".join(errors))
        horizons = tuple(event.get("forward_horizons") or event.get("horizons") or ((5,) if "event" in c else trades.HORIZONS))
        sessions = event.get("cooldown_sessions", event.get("cooldown_days", 10))
        percent = (shares.get("discovery_pct", 60), shares.get("validation_pct", 20), shares.get("holdout_pct", 20))
        return cls(str(about.get("id", about.get("name", name))), conditions, sessions, horizons, research.get("primary_horizon", horizons[0]), tuple(x / 100 for x in percent))

    @property
    def exclusion(self) -> int:
        return self.cooldown_sessions if self.semantics.exclusion is None else self.semantics.exclusion


@dataclass
class Study:
    """The named tables of one experiment.

    ``canonical`` and ``enriched`` hold all trades; formal metrics are of those
    that cross no boundary. Parts of the leave-one-out tables are all of the data.
    """

    experiment: Experiment
    features: DataFrame
    events: DataFrame
    canonical: DataFrame
    bounds: DataFrame
    per_event: DataFrame
    enriched: DataFrame
    returns: DataFrame
    bench: DataFrame | None = None

    @property
    def formal(self) -> DataFrame:
        return splits.purged(self.enriched)

    def tables(self) -> dict[str, DataFrame]:
        h, e, t = self.experiment.horizons, self.experiment, self.formal
        every = baselines.all_baselines(self.events, self.returns, e.exclusion, self.bench, h, e.semantics.widen_exclusion)
        years = self.features.select(F.year("session").alias("year"))
        return {
            "canonical_trades": self.enriched, "metrics": metrics.by(t, "horizon"), "gross_metrics": metrics.by(t, "horizon", col="forward_return"), "split_metrics": metrics.split_metrics(t), "by_asset": metrics.by(t, "horizon", "ticker"),
            "coverage": baselines.coverage(self.per_event), "weighted_baseline": baselines.weighted_all(every),
            "loo_asset": robustness.leave_one_out(self.enriched, "ticker", parts=self.features, horizons=h), "loo_year": robustness.leave_one_out(self.enriched.withColumn("year", F.year("signal_date")), "year", parts=years, horizons=h),
            "concentration": robustness.concentration(self.enriched), "bootstrap": robustness.bootstrap(t, ["horizon"]), "gross_bootstrap": robustness.bootstrap(self.enriched, ["horizon"], "forward_return"),
        }


def prepare(bars: DataFrame, bench: DataFrame | None = None, price: str = "close", high: str = "high", low: str = "low", open_: str = "open") -> DataFrame:
    """Bars with positions, features and regimes."""
    return regimes.add_regimes(add_features(add_positions(bars), price, high, low, open_), bench, price)


def base_prices(bars: DataFrame, fx: DataFrame, local: Column, s: Semantics) -> DataFrame:
    """Bars whose prices are in the base currency; local rows without a rate go."""
    usd = fx_ops.in_base(bars, fx, local, s.adjust_all, s.fx_carry)
    keep = [c for c in ("ticker", "session", "volume") if c in usd.columns]
    return usd.select(*keep, *[F.col(f"{c}_usd").alias(c) for c in fx_ops.PRICES])


def run(
    spark: SparkSession, e: Experiment, bars: DataFrame, bench: DataFrame | None, market: Column, cost_table: DataFrame | None = None,
    fx: DataFrame | None = None, local: Column | None = None, bench_local: bool = False, targets: DataFrame | None = None, gate: tuple[str, str] | None = None,
    series: DataFrame | None = None, first_by: str | None = None,
) -> Study:
    """The study from bars to enriched trades.

    ``gate``: first and last day; raises on critical data issues of any ticker but
    indexes. ``fx``: rates (session, ccl) for ``local`` tickers and, with ``bench_local``,
    for the benchmark. ``targets``: a universe (ticker, role) whose targets events
    are searched in; other tickers have features only. ``series``: session and
    columns that are alike for all tickers (rates, spreads), which conditions may
    name; a session without a row has nulls. ``first_by``: of several bars for a
    session the first by this column stays; the gate still counts them all.
    Features are written once, as events, controls and trades read them.
    """
    s = e.semantics
    if gate:
        quality.require_clean(quality.quality_issues(bars.where(~F.col("ticker").startswith("^")), *gate))
    if first_by:
        bars = dedupe_first(bars, first_by).drop(first_by)
    if fx is not None:
        local = F.lit(True) if local is None else local
        bars = base_prices(bars, fx, local, s)
        if bench is not None and bench_local:
            bench = base_prices(bench, fx, F.lit(True), s)
    prepared = prepare(bars, bench)
    if series is not None:
        prepared = with_series(prepared, series, [c for c in series.columns if c != "session"])
    feats = materialize(trades.with_outcomes(prepared, e.horizons, entry_mode=s.entry_mode), "features")
    own = events.targets_only(feats, targets) if targets is not None else feats
    found = events.detect(own, e.conditions, e.cooldown_sessions)
    dates = bars.select("session") if bench is None else bars.select("session").unionByName(bench.select("session"))
    bounds = splits.boundaries(dates, *e.shares)
    canon = trades.canonical(trades.trades(found, ("trend_regime", "vol_regime")), bounds, cost_table if cost_table is not None else costs.cost_table(spark), market)
    if s.embargo_sessions:
        canon = splits.embargo(canon, feats.select("ticker", "session", "pos"), bounds, s.embargo_sessions)
    returns = control_rows(own, found, e.horizons)
    per_event = baselines.matched(found, baselines.pools(returns, e.exclusion, widen=s.widen_exclusion), e.horizons)
    enriched = materialize(baselines.enrich(canon, per_event, skip_insufficient=not s.edge_without_controls), "trades")
    return Study(e, own, found, canon, bounds, per_event, enriched, returns, bench)


def control_rows(feats: DataFrame, found: DataFrame, horizons: tuple[int, ...] = trades.HORIZONS) -> DataFrame:
    """Returns of every session and horizon, with the nearest events on both sides."""
    marks = found.select("ticker", "pos", F.lit(True).alias("__event"))
    return baselines.control_returns(baselines.mark_neighbours(feats.join(marks, ["ticker", "pos"], "left"), F.col("__event").isNotNull()), horizons)


def verdict(study: Study, e: Experiment, cost_pct: float) -> tuple[str, str]:
    """The decision at the primary horizon, from rows of a few aggregates."""
    h = e.primary_horizon or e.horizons[0]
    every = study.enriched.where(F.col("horizon") == h)
    t = splits.purged(every)
    m = metrics.by(t, "horizon").first()
    by_split = {r["temporal_split"]: r for r in metrics.by(t, "temporal_split").collect()}
    boot = robustness.bootstrap(t, ["horizon"]).first()
    conc = robustness.concentration(every).first()
    cov = study.per_event.where(F.col("horizon") == h).agg((100 * F.avg((F.col("status") != "INSUFFICIENT").cast("double"))).alias("c")).first()
    n = study.formal.count() if e.semantics.count_horizons_in_n else t.count()
    at = lambda s, c: by_split[s][c] if s in by_split else None
    return decision.decide(decision.Evidence(
        n, m and m["mean"], m and m["median"], at("validation", "median"), at("validation", "n_events"), at("holdout", "median"), at("holdout", "n_events"),
        cov["c"], boot and boot["ci_lower"], boot and boot["ci_upper"], conc["best_trade_pct"] if conc else 100.0, cost_pct,
    ), min_coverage=e.semantics.min_coverage_pct)
