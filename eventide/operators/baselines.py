"""Baselines: what the same instrument did in comparable conditions.

Controls of an event are the sessions of its ticker and regimes outside every
event's exclusion window, so the pool depends on (ticker, horizon, regimes)
only: it is aggregated once and joined to the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .trades import HORIZONS, forward_return

VALID, LOW = 20, 5


def control_returns(df: DataFrame, horizons=HORIZONS, price: str = "close") -> DataFrame:
    """(ticker, session, pos, regimes, event, horizon, ret) for every session, close to close."""
    out = df.withColumn("__r", F.array(*[F.struct(F.lit(h).alias("horizon"), forward_return(F.col(price), h).alias("ret")) for h in horizons]))
    keep = [c for c in ("trend_regime", "vol_regime", "__prev", "__next") if c in df.columns]
    return out.select("ticker", "session", "pos", *keep, F.explode("__r").alias("r")).select("ticker", "session", "pos", *keep, "r.horizon", "r.ret")


def mark_neighbours(df: DataFrame, is_event: Column) -> DataFrame:
    """Adds the positions of the nearest event at or before, and at or after, each session."""
    by = W.partitionBy("ticker").orderBy("pos")
    at = F.when(is_event, F.col("pos"))
    return df.withColumns({"__prev": F.last(at, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)), "__next": F.first(at, ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing))})


def excluded(exclusion: int, horizon: Column | None = None, widen: bool = False) -> Column:
    """Rows within [e - k, e + k + h) of an event e; ``widen`` moves the left edge by h too."""
    h = F.col("horizon") if horizon is None else horizon
    left = F.lit(exclusion) + h if widen else F.lit(exclusion)
    return F.coalesce(F.col("pos") - F.col("__prev") < F.lit(exclusion) + h, F.lit(False)) | F.coalesce(F.col("__next") - F.col("pos") <= left, F.lit(False))


def unconditional(returns: DataFrame) -> DataFrame:
    return returns.groupBy("ticker", "horizon").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("unconditional"))


def status(n: Column) -> Column:
    return F.when(n >= VALID, "VALID").when(n >= LOW, "LOW_CONFIDENCE").otherwise("INSUFFICIENT")


def pools(returns: DataFrame, exclusion: int, by_vol: bool = True, widen: bool = False) -> DataFrame:
    keys = ["ticker", "horizon", "trend_regime"] + ["vol_regime"] * by_vol
    free = returns.where(~excluded(exclusion, widen=widen) & F.col("ret").isNotNull())
    return free.groupBy(*keys).agg(F.avg("ret").alias("matched_return"), F.count("*").alias("n_controls"))


def matched(events: DataFrame, pool: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Per event and horizon: mean of its controls, their number and status."""
    e = events.select("ticker", F.col("session").alias("event_date"), "trend_regime", "vol_regime", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    keys = [c for c in ("ticker", "horizon", "trend_regime", "vol_regime") if c in pool.columns]
    n = F.coalesce("n_controls", F.lit(0))
    return e.join(pool, keys, "left").select("ticker", "horizon", "event_date", "trend_regime", "vol_regime", F.coalesce("matched_return", F.lit(0.0)).alias("matched_return"), n.alias("n_controls"), status(n).alias("status"))


def benchmark_returns(bench: DataFrame, dates: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Mean benchmark return at the dates that are sessions of the benchmark."""
    b = control_returns(bench.withColumn("pos", F.lit(0)), horizons).select("session", "horizon", "ret")
    return dates.select("session").join(b, "session").groupBy("horizon").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("benchmark"), F.count("ret").alias("n_dates"))


def benchmark_by_ticker(bench: DataFrame, found: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Mean benchmark return at each ticker's event dates."""
    b = control_returns(bench.withColumns({"pos": F.lit(0), "ticker": F.lit("^")}), horizons).select("session", "horizon", "ret")
    return found.select("ticker", "session").join(b, "session").groupBy("ticker", "horizon").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("benchmark"))


def all_baselines(found: DataFrame, returns: DataFrame, exclusion: int, bench: DataFrame | None = None, horizons=HORIZONS, widen: bool = False) -> DataFrame:
    """Per ticker with events, and horizon: the four baselines and their coverage.

    ``returns``: control returns of every session with its neighbours. Where
    nothing can be compared a baseline is 0.
    """
    exact = coverage(matched(found, pools(returns, exclusion, widen=widen), horizons))
    trend = coverage(matched(found, pools(returns, exclusion, by_vol=False, widen=widen), horizons)).select("ticker", "horizon", F.col("exact_matched_mean").alias("trend_only_mean"))
    out = exact.join(unconditional(returns), ["ticker", "horizon"], "left").join(trend, ["ticker", "horizon"])
    if bench is not None:
        out = out.join(benchmark_by_ticker(bench, found, horizons), ["ticker", "horizon"], "left")
    else:
        out = out.withColumn("benchmark", F.lit(0.0))
    return out.na.fill(0.0, ["unconditional", "benchmark"])


def weighted_all(summary: DataFrame) -> DataFrame:
    """The four baselines across tickers, weighted by all events of each, and the coverage."""
    n = F.nullif(F.sum("n_events"), F.lit(0))
    means = [(F.sum(F.col(c) * F.col("n_events")) / n).alias(c) for c in ("unconditional", "exact_matched_mean", "trend_only_mean", "benchmark")]
    counts = [F.sum(c).alias(c) for c in ("n_events", "n_valid", "n_low_confidence", "n_insufficient")]
    share = lambda c: F.round(100.0 * c / F.nullif("n_events", F.lit(0)), 1)
    out = summary.groupBy("horizon").agg(*means, *counts)
    return out.withColumns({"valid_pct": share(F.col("n_valid")), "valid_or_low_pct": share(F.col("n_valid") + F.col("n_low_confidence"))})


def coverage(per_event: DataFrame) -> DataFrame:
    used = F.col("status") != "INSUFFICIENT"
    n = F.count("*")
    return per_event.groupBy("ticker", "horizon").agg(
        n.alias("n_events"), F.count_if(F.col("status") == "VALID").alias("n_valid"), F.count_if(F.col("status") == "LOW_CONFIDENCE").alias("n_low_confidence"), F.count_if(~used).alias("n_insufficient"),
        F.coalesce(F.avg(F.when(used, F.col("matched_return"))), F.lit(0.0)).alias("exact_matched_mean"), F.coalesce(F.median(F.when(used, F.col("matched_return"))), F.lit(0.0)).alias("exact_matched_median"),
        F.round(100.0 * F.count_if(F.col("status") == "VALID") / n, 1).alias("valid_pct"), F.round(100.0 * F.count_if(used) / n, 1).alias("valid_or_low_pct"),
    )


def weighted(summary: DataFrame, value: str = "exact_matched_mean") -> DataFrame:
    """Across tickers, weighted by all events of each."""
    return summary.groupBy("horizon").agg((F.sum(F.col(value) * F.col("n_events")) / F.nullif(F.sum("n_events"), F.lit(0))).alias("weighted_baseline"), *[F.sum(c).alias(c) for c in ("n_events", "n_valid", "n_low_confidence", "n_insufficient")])


def histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("trend_regime", "vol_regime").agg(F.count("*").alias("n"))


def enrich(trades: DataFrame, per_event: DataFrame, skip_insufficient: bool = False) -> DataFrame:
    """Trades with their control mean, its size and status, and the edge over it."""
    b = per_event.select("ticker", "horizon", F.col("event_date").alias("signal_date"), F.col("matched_return").alias("matched_baseline_return"), F.col("n_controls").alias("matched_baseline_n"), F.col("status").alias("matched_baseline_status"))
    edge = F.col("net_return_pct") - F.col("matched_baseline_return")
    if skip_insufficient:
        edge = F.when(F.col("matched_baseline_status") != "INSUFFICIENT", edge)
    return trades.join(b, ["ticker", "horizon", "signal_date"], "left").withColumn("incremental_edge_net", edge)
