"""Queries over the test tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions import features as ft
from eventide.operators import baselines, costs, decision, events, fx, ledger, metrics, quality, regimes, robustness, splits, trades
from eventide.operators import ticks as tk
from eventide.sources import market as src
from eventide.sources.tables import materialize

from . import sqltext as s
from .experiment import Experiment, control_rows, prepare, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = [events.Rule("close_above_sma_200", "==", 1.0), events.Rule("return_60d", ">", 0.10), events.Rule("return_3d", "<", -0.03)]


def neat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines, which sum in different orders."""
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


#: Columns that are no doubles; a query's other columns are, and are rounded.
EXACT = (
    "best_asset cell check currency day discovery_end entry_date event_date event_id excluded exit_date holdout_end horizon mae_date market "
    "matched_baseline_n matched_baseline_status mfe_date n n_assets n_controls n_dates n_direct n_dropped n_events n_filled n_insufficient n_kept "
    "n_low_confidence n_parts n_raw n_signals n_ticks n_total n_trades n_valid name pos rank session severity signal_date status symbol temporal_split "
    "test_end test_start ticker train_end train_start trend_regime ts validation_end verdict vol_regime year signal_type quantity entry_ts exit_ts "
    "signal_ts filled want n_open n_closed n_wins "
).split()
#: Queries without a double.
WITHOUT = "instrument_resolution list_instruments period_counts list_contracts contract_resolution trend_regime vol_regime fx_gap_report rule_and rule_not_equal_null cooldown mfe_mae_dates split_time split_events boundary_purge walk_forward embargo regime_histogram quality_issues".split()


def rounded(name: str, sql: str, digits: int, exact: str = "") -> str:
    if name in WITHOUT:
        return sql
    names = ", ".join(f"'{c}'" for c in [*EXACT, *exact.split()])
    return f"SELECT COLUMNS(lambda c: c IN ({names})), round(COLUMNS(lambda c: c NOT IN ({names})), {digits}) FROM ({sql})"


def query(name: str, ctes: str | None = None, select: str | None = None, digits: int = 6, exact: str = ""):
    """Registers a query; the SQL rounds the same doubles. ``exact`` names further columns that are none."""

    def deco(f):
        QUERIES[name] = lambda spark, d: neat(f(spark, d), digits)
        if select:
            body = f"WITH RECURSIVE {ctes}{select}" if select.startswith(",") else f"WITH RECURSIVE {ctes}\n{select}"
            ORACLES[name] = rounded(name, body, digits, exact)
        return f

    return deco


# --- inputs shared by queries --------------------------------------------------


def base(spark: SparkSession, d: str) -> DataFrame:
    return prepare(src.bars(spark, d), src.benchmark(spark, d))


def plain(spark: SparkSession, d: str) -> DataFrame:
    return ft.add_features(ft.add_positions(src.bars(spark, d)))


def found(spark: SparkSession, d: str, mode: str = "next_open") -> DataFrame:
    return events.detect(trades.with_outcomes(base(spark, d), entry_mode=mode), RULES, 20)


def market():
    return F.when(F.col("ticker").startswith("1"), "argentina").otherwise("usa")


def features(spark: SparkSession, d: str) -> DataFrame:
    """Features with outcomes, written once for queries that read them in several places."""
    return materialize(trades.with_outcomes(base(spark, d)), "features")


def canon(spark: SparkSession, d: str, f: DataFrame | None = None) -> DataFrame:
    e = found(spark, d) if f is None else events.detect(f, RULES, 20)
    t = trades.trades(e, ("trend_regime", "vol_regime"))
    return trades.canonical(t, splits.boundaries(src.bars(spark, d)), costs.cost_table(spark), market())


def valid(spark: SparkSession, d: str, f: DataFrame | None = None) -> DataFrame:
    return splits.purged(canon(spark, d, f))


def near(spark: SparkSession, d: str, f: DataFrame | None = None) -> DataFrame:
    f = features(spark, d) if f is None else f
    return control_rows(f, events.detect(f, RULES, 20))


def per_event(spark: SparkSession, d: str, f: DataFrame | None = None) -> DataFrame:
    f = features(spark, d) if f is None else f
    return baselines.matched(events.detect(f, RULES, 20), baselines.pools(near(spark, d, f), 20))


PB = f"{s.BARS},\n{s.POS},\n{s.FEATURES}"

# --- sources ---------------------------------------------------------------------


@query("bars_daily", s.BARS, "SELECT * FROM bars")
def _(spark, d):
    return src.bars(spark, d)


@query("adjusted_ohlc", s.BARS, "SELECT ticker, session, close * (0.9::DOUBLE + pos % 10 / 100.0::DOUBLE) AS adj_close, open * f AS open_adj, high * f AS high_adj, low * f AS low_adj FROM (SELECT *, close * (0.9::DOUBLE + pos % 10 / 100.0::DOUBLE) / nullif(close, 0) AS f FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session) - 1 AS pos FROM bars))", 4)
def _(spark, d):
    b = ft.add_positions(src.bars(spark, d))
    b = b.withColumn("adj_close", F.col("close") * (F.lit(0.9) + F.col("pos") % 10 / F.lit(100.0)))
    return src.adjusted(b).select("ticker", "session", "adj_close", "open_adj", "high_adj", "low_adj")


@query("fx_synthetic", s.BARS, """, x AS (SELECT a.session, CASE WHEN a.close * 100 / b.close > 10 AND a.close * 100 / b.close < 5000 THEN a.close * 100 / b.close END AS r FROM bars a JOIN bars b USING (session) WHERE a.ticker = '1-URGENT' AND b.ticker = '2-HIGH')
SELECT session, ccl FROM (SELECT session, last_value(r IGNORE NULLS) OVER (ORDER BY session ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS ccl FROM x) WHERE ccl IS NOT NULL""")
def _(spark, d):
    b = src.bars(spark, d)
    return src.synthetic_rate(b.where("ticker = '1-URGENT'"), b.where("ticker = '2-HIGH'"), ratio=100.0)


@query("instrument_resolution", s.BARS, "SELECT DISTINCT ticker || CASE WHEN starts_with(ticker, '1') THEN '.BA' ELSE '' END AS ticker, CASE WHEN starts_with(ticker, '2') THEN 'europe' WHEN starts_with(ticker, '1') THEN 'argentina' ELSE 'usa' END AS market, CASE WHEN starts_with(ticker, '2') THEN 'EUR' WHEN starts_with(ticker, '1') THEN 'ARS' ELSE 'USD' END AS currency FROM bars")
def _(spark, d):
    t = src.bars(spark, d).select(F.concat("ticker", F.when(F.col("ticker").startswith("1"), ".BA").otherwise("")).alias("ticker")).distinct()
    return src.resolve_instruments(t, spark.createDataFrame([("2-HIGH", "europe", "EUR")], "ticker string, market string, currency string"))


@query("topk_latest_ticks", s.TICKS, "SELECT * FROM (SELECT symbol, ts, last, event_id, (row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC))::INTEGER AS rank FROM ticks) WHERE rank <= 100")
def _(spark, d):
    return src.latest(src.ticks(spark, d).select("symbol", "ts", "last", "event_id"), "symbol", "ts", 100, "event_id")


@query("tick_scan_nonnull", s.TICKS, "SELECT symbol, ts, bid, ask, last, event_id FROM ticks WHERE ts IS NOT NULL AND coalesce(bid, ask, last) IS NOT NULL")
def _(spark, d):
    return src.quoted(src.ticks(spark, d))


@query("list_contracts", "n AS (SELECT DISTINCT symbol FROM (SELECT event_type || '/' || strftime(ts, '%m%Y') AS symbol FROM events))", "SELECT symbol FROM n WHERE symbol LIKE 'click/%'")
def _(spark, d):
    t = src.ticks(spark, d).select(F.concat("symbol", F.lit("/"), F.date_format("ts", "MMyyyy")).alias("symbol"))
    return src.contracts(t, "click")


@query("contract_resolution", "n AS (SELECT event_type || '/' || strftime(ts, '%m%Y') AS symbol FROM events)", "SELECT max(symbol) AS symbol FROM n WHERE symbol LIKE 'click/%'")
def _(spark, d):
    t = src.ticks(spark, d).select(F.concat("symbol", F.lit("/"), F.date_format("ts", "MMyyyy")).alias("symbol"))
    return src.resolve_contract(t, "click")


@query("union_dedupe_keep_last", s.BARS, "SELECT ticker, session, CASE WHEN day(session) <= 10 THEN close * 2 ELSE close END AS close FROM bars")
def _(spark, d):
    b = src.bars(spark, d).select("ticker", "session", "close")
    return src.top_up(b, b.where(F.dayofmonth("session") <= 10).withColumn("close", F.col("close") * 2))


@query("daily_layout", s.BARS, "SELECT ticker, session, open, high, low, close, volume, close AS adj_close FROM bars")
def _(spark, d):
    b = src.bars(spark, d)
    raw = b.select(F.col("ticker").alias("Ticker"), F.col("session").alias("Date"), *[F.col(c).cast("string").alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume")])
    return src.normalise_daily(raw)


# --- features --------------------------------------------------------------------


def _feature(name: str, cols: list[str], digits: int = 6) -> None:
    @query(name, PB, f"SELECT ticker, session, {', '.join(cols)} FROM f3", digits)
    def _(spark, d):
        return plain(spark, d).select("ticker", "session", *cols)


_feature("sma", ["sma_20", "sma_60", "sma_200"], 5)
_feature("rsi", ["rsi_14"])
_feature("atr", ["atr_14"], 5)
_feature("rolling_returns", [f"return_{n}d" for n in (1, 3, 5, 10, 20, 60)])
_feature("zscore", ["return_3d_zscore"])
_feature("volume_ratio", ["volume_ratio_20d", "volume_ratio_50d"])
_feature("sma_slope", ["sma_200_slope"], 7)
_feature("dist_sma", ["dist_sma_20", "dist_sma_200", "close_above_sma_200"])
_feature("percentile_rank", ["atr_percentile_60d"])
_feature("bollinger_b", ["bb_pct_b"])
_feature("dist_to_high", ["distance_to_high_60d"])
_feature("gap_pct", ["gap_pct"])
_feature("consecutive_down", ["consecutive_down"])
_feature("breakout_20d", ["close_breaks_high_20d"])
_feature("all_features", ["sma_20", "sma_200", "return_1d", "return_60d", "rsi_14", "atr_percentile_60d", "volume_ratio_20d", "gap_pct", "consecutive_down", "dist_sma_200", "distance_to_high_60d", "return_3d_zscore", "bb_pct_b", "close_breaks_high_20d"], 5)


@query("ema", f"{s.BARS},\n{s.POS}", f"SELECT ticker, session, {s.ema('close', 9)} AS ema_9 FROM pb", 5)
def _(spark, d):
    return ft.add_ema(src.bars(spark, d), "close", 9, "ema_9").select("ticker", "session", "ema_9")


@query("macd", f"{s.BARS},\n{s.POS},\nm AS (SELECT *, {s.ema('close', 12)} - {s.ema('close', 26, 400)} AS macd FROM pb),\nm2 AS (SELECT *, {s.ema('macd', 9)} AS macd_signal FROM m)", "SELECT ticker, session, macd, macd_signal, macd - macd_signal AS macd_hist FROM m2", 4)
def _(spark, d):
    return ft.add_macd(src.bars(spark, d)).select("ticker", "session", "macd", "macd_signal", "macd_hist")


@query("fx_returns", s.FX, "SELECT session, ccl, ccl / lag(ccl) OVER (ORDER BY session) - 1 AS ccl_return_1d, ccl / lag(ccl, 5) OVER (ORDER BY session) - 1 AS ccl_return_5d FROM fx")
def _(spark, d):
    return ft.add_rate_returns(src.fx_rates(spark, d))


# --- regimes and currency ---------------------------------------------------------


@query("trend_regime", s.BASE, "SELECT ticker, session, trend_regime FROM feat")
def _(spark, d):
    return base(spark, d).select("ticker", "session", "trend_regime")


@query("vol_regime", s.BASE, "SELECT ticker, session, vol_regime FROM feat")
def _(spark, d):
    return base(spark, d).select("ticker", "session", "vol_regime")


@query("asof_benchmark", f"{s.BARS},\n{s.BENCH}", ", b AS (SELECT session, CASE WHEN day(session) % 5 <> 0 THEN close END AS close FROM bench WHERE day(session) % 3 <> 0)\nSELECT ticker, bars.session, b.close AS bench FROM bars ASOF LEFT JOIN b ON bars.session >= b.session")
def _(spark, d):
    b = src.benchmark(spark, d).where(F.dayofmonth("session") % 3 != 0).withColumn("close", F.when(F.dayofmonth("session") % 5 != 0, F.col("close")))
    return regimes.as_of(src.bars(spark, d), b).select("ticker", "session", "bench")


@query("dollarize_bounded_ffill", f"{s.BARS},\n{s.FX}", "SELECT ticker, session, rate AS ccl, open / rate AS open_usd, close / rate AS close_usd FROM (SELECT bars.*, last_value(ccl IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rate FROM bars LEFT JOIN fx USING (session)) WHERE rate IS NOT NULL")
def _(spark, d):
    out = fx.in_base(src.bars(spark, d), src.fx_rates(spark, d), local=F.lit(True))
    return out.select("ticker", "session", "ccl", "open_usd", "close_usd")


@query("fx_gap_report", f"{s.BARS},\n{s.FX}", "SELECT ticker, count(ccl)::BIGINT AS n_direct, count(*) FILTER (ccl IS NULL AND rate IS NOT NULL)::BIGINT AS n_filled, count(*) FILTER (rate IS NULL)::BIGINT AS n_dropped FROM (SELECT bars.*, ccl, last_value(ccl IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rate FROM bars LEFT JOIN fx USING (session)) GROUP BY ticker")
def _(spark, d):
    return fx.rate_gaps(src.bars(spark, d), src.fx_rates(spark, d))


# --- events -----------------------------------------------------------------------


@query("rule_and", s.BASE, f"SELECT ticker, session, pos FROM feat WHERE {s.RULE}")
def _(spark, d):
    f = base(spark, d)
    return f.where(events.event_mask(f, RULES)).select("ticker", "session", "pos")


@query("rule_not_equal_null", s.BASE, "SELECT ticker, session FROM feat WHERE rsi_14 IS DISTINCT FROM 50.0::DOUBLE AND trend_regime <> 'BEAR' AND coalesce(bb_pct_b <= 0.2, false)")
def _(spark, d):
    f = base(spark, d)
    rules = [events.Rule("rsi_14", "!=", 50.0), events.Rule("trend_regime", "!=", "BEAR"), events.Rule("bb_pct_b", "<=", 0.2)]
    return f.where(events.event_mask(f, rules)).select("ticker", "session")


@query("cooldown", f"{s.BASE},\n{s.kept(s.RULE, 20)}", "SELECT ticker, session, pos FROM feat JOIN kept USING (ticker, pos)")
def _(spark, d):
    return events.detect(base(spark, d), RULES, 20).select("ticker", "session", "pos")


@query("overlap_stats", f"{s.BASE},\n{s.kept(s.RULE, 20)}", "SELECT ticker, n_raw, coalesce(n_kept, 0)::BIGINT AS n_kept, 100.0::DOUBLE * (n_raw - coalesce(n_kept, 0)) / n_raw AS removed_pct FROM (SELECT ticker, count(*)::BIGINT AS n_raw FROM sig_kept GROUP BY ticker) LEFT JOIN (SELECT ticker, count(*) AS n_kept FROM kept GROUP BY ticker) USING (ticker)")
def _(spark, d):
    return events.overlap(base(spark, d), RULES, 20)


_GRID = [(f"ret60>{a} ret3<{b}", a, b) for a in (0.0, 0.1, 0.2) for b in (-0.05, -0.03, -0.01)]


@query("neighborhood_grid", ",\n".join([s.BASE] + [s.kept(f"return_60d > {a} AND return_3d < {b} AND close_above_sma_200 = 1", 20, f"k{i}") for i, (_, a, b) in enumerate(_GRID)] + [f"fr AS (SELECT ticker, pos, ({s.lead('close', 5)} / close - 1) * 100 AS ret FROM feat)"]), " UNION ALL ".join(f"SELECT '{n}' AS cell, (SELECT count(*) FROM sig_k{i})::BIGINT AS n_signals, (SELECT count(*) FROM k{i})::BIGINT AS n_events, (SELECT avg(ret) FROM k{i} JOIN fr USING (ticker, pos)) AS metric" for i, (n, _, _) in enumerate(_GRID)))
def _(spark, d):
    cells = [(n, [events.Rule("return_60d", ">", a), events.Rule("return_3d", "<", b), RULES[0]]) for n, a, b in _GRID]
    return events.grid(base(spark, d), cells, 20, "close")


# --- trades -------------------------------------------------------------------------


@query("forward_return_close", f"{s.BARS},\n{s.POS}", " UNION ALL ".join(f"SELECT ticker, session, {h} AS horizon, ({s.lead('close', h)} / close - 1) * 100 AS ret FROM pb" for h in s.HORIZONS))
def _(spark, d):
    return baselines.control_returns(ft.add_positions(src.bars(spark, d))).select("ticker", "session", "horizon", "ret")


_EV = f"{s.BASE},\n{s.kept(s.RULE, 20)}"


@query("trades_next_open", f"{_EV},\n{s.trades()}", "SELECT ticker, signal_date, horizon, entry_date, exit_date, signal_price, entry_price, exit_price, forward_return, mfe, mae FROM trades")
def _(spark, d):
    return trades.trades(found(spark, d)).drop("mfe_date", "mae_date")


@query("trades_signal_close", f"{_EV},\n{s.trades('signal_close')}", "SELECT ticker, signal_date, horizon, entry_date, exit_date, signal_price, entry_price, exit_price, forward_return, mfe, mae FROM trades")
def _(spark, d):
    return trades.trades(found(spark, d, "signal_close")).drop("mfe_date", "mae_date")


@query("mfe_mae_dates", f"{_EV},\n{s.trades()}", "SELECT ticker, signal_date, horizon, mfe_date, mae_date FROM trades")
def _(spark, d):
    return trades.trades(found(spark, d)).select("ticker", "signal_date", "horizon", "mfe_date", "mae_date")


@query("net_of_costs", s.STUDY, "SELECT ticker, signal_date, horizon, transaction_cost_pct, net_return_pct FROM canon")
def _(spark, d):
    return canon(spark, d).select("ticker", "signal_date", "horizon", "transaction_cost_pct", "net_return_pct")


@query("cost_model", f"""{s.BARS},
c(market, side) AS (VALUES ('argentina', 0.0098::DOUBLE), ('futures', 0.0023::DOUBLE), ('usa', 0.0021::DOUBLE)),
m AS (SELECT *, CASE WHEN starts_with(ticker, '1') THEN 'argentina' WHEN starts_with(ticker, '2') THEN 'futures' ELSE 'usa' END AS market FROM bars)""", "SELECT market, side AS per_side, 2 * side AS roundtrip, count(*)::BIGINT AS n, sum(close * volume) * 2 * side AS cost FROM m JOIN c USING (market) GROUP BY market, side", 3)
def _(spark, d):
    """What each market's bars would cost to turn over once."""
    own = F.when(F.col("ticker").startswith("1"), "argentina").when(F.col("ticker").startswith("2"), "futures").otherwise("usa")
    turned = src.bars(spark, d).groupBy(own.alias("market")).agg(F.count("*").alias("n"), F.sum(F.col("close") * F.col("volume")).alias("turned"))
    return turned.join(costs.cost_table(spark), "market").select("market", "per_side", "roundtrip", "n", (F.col("turned") * F.col("roundtrip")).alias("cost"))


@query("canonical_trades", f"{s.CONTROL}", """SELECT canon.ticker, market, signal_date, entry_date, exit_date, canon.horizon, signal_price, entry_price, exit_price, forward_return, transaction_cost_pct, net_return_pct, mfe, mae, canon.trend_regime, canon.vol_regime, temporal_split,
  matched_return AS matched_baseline_return, n_controls AS matched_baseline_n, status AS matched_baseline_status, net_return_pct - matched_return AS incremental_edge_net FROM canon LEFT JOIN matched ON canon.ticker = matched.ticker AND canon.horizon = matched.horizon AND signal_date = event_date""")
def _(spark, d):
    f = features(spark, d)
    return baselines.enrich(canon(spark, d, f), per_event(spark, d, f)).drop("mfe_date", "mae_date")


# --- splits ----------------------------------------------------------------------------


@query("split_time", f"{s.BARS},\n{s.BOUNDS}", "SELECT discovery_end, validation_end, holdout_end FROM bounds")
def _(spark, d):
    return splits.boundaries(src.bars(spark, d))


@query("split_events", f"{_EV},\ne AS (SELECT session AS d, row_number() OVER (ORDER BY session) AS rn, count(*) OVER () AS n FROM feat JOIN kept USING (ticker, pos))", "SELECT max(d) FILTER (rn = greatest(floor(n * 0.6::DOUBLE), 1)) AS discovery_end, max(d) FILTER (rn = greatest(floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE), 1)) AS validation_end, max(d) AS holdout_end FROM e")
def _(spark, d):
    return splits.boundaries(events.detect(base(spark, d), RULES, 20), distinct=False)


@query("boundary_purge", s.STUDY, "SELECT temporal_split, horizon, count(*)::BIGINT AS n FROM canon GROUP BY ALL")
def _(spark, d):
    return canon(spark, d).groupBy("temporal_split", "horizon").agg(F.count("*").alias("n"))


@query("walk_forward", f"{s.BARS},\nb AS (SELECT min(session) AS a, max(session) AS b, count(DISTINCT session) AS n FROM bars),\nw AS (SELECT a + (i * floor((b - a - 365) / 3.0::DOUBLE))::INTEGER AS s, b, i FROM b, range(3) t(i) WHERE n >= 504)", "SELECT 'window_' || (i + 1) AS name, s AS train_start, s + 365 AS train_end, s + 366 AS test_start, s + 548 AS test_end FROM w WHERE s + 548 <= b")
def _(spark, d):
    return splits.walk_forward_windows(src.bars(spark, d).select("session"), n=3, years=1.0)


@query("embargo", f"{s.STUDY},\nends AS (SELECT ticker, max(pos) FILTER (session <= discovery_end) AS dp, max(pos) FILTER (session <= validation_end) AS vp FROM feat, bounds GROUP BY ticker)", "SELECT canon.ticker, signal_date, horizon FROM canon JOIN feat ON feat.ticker = canon.ticker AND feat.session = signal_date JOIN ends ON ends.ticker = canon.ticker WHERE abs(pos - dp) > 21 AND abs(pos - vp) > 21")
def _(spark, d):
    at = ft.add_positions(src.bars(spark, d)).select("ticker", "session", "pos")
    return splits.embargo(canon(spark, d), at, splits.boundaries(src.bars(spark, d)), 21).select("ticker", "signal_date", "horizon")


# --- aggregates --------------------------------------------------------------------------


@query("horizon_metrics", s.STUDY, f"SELECT {s.metrics('horizon')} FROM valid GROUP BY horizon")
def _(spark, d):
    return metrics.by(valid(spark, d), "horizon")


@query("gross_metrics", s.STUDY, f"SELECT {s.metrics('horizon', 'forward_return')} FROM valid GROUP BY horizon")
def _(spark, d):
    return metrics.by(valid(spark, d), "horizon", col="forward_return")


@query("split_metrics_grouping_sets", s.STUDY, "SELECT CASE WHEN grouping(temporal_split) = 1 THEN 'all' ELSE temporal_split END AS temporal_split, horizon, count(*)::BIGINT AS n_events, avg(net_return_pct) AS mean, median(net_return_pct) AS median, avg((net_return_pct > 0)::INT::DOUBLE) AS win_rate FROM valid GROUP BY GROUPING SETS ((temporal_split, horizon), (horizon))")
def _(spark, d):
    return metrics.split_metrics(valid(spark, d))


@query("by_asset_metrics", s.STUDY, f"SELECT {s.metrics('horizon, ticker')} FROM valid GROUP BY ALL")
def _(spark, d):
    return metrics.by(valid(spark, d), "horizon", "ticker")


@query("by_regime_metrics", s.STUDY, f"SELECT {s.metrics('horizon, trend_regime, vol_regime')} FROM valid GROUP BY ALL")
def _(spark, d):
    return metrics.by(valid(spark, d), "horizon", "trend_regime", "vol_regime")


@query("by_year_metrics", s.STUDY, f"SELECT {s.metrics('horizon, year(signal_date)::INTEGER AS year')} FROM valid GROUP BY ALL")
def _(spark, d):
    return metrics.by(valid(spark, d).withColumn("year", F.year("signal_date")), "horizon", "year")


@query("positive_assets", s.STUDY, "SELECT horizon, count(*)::BIGINT AS n_parts, 100 * avg((m > 0)::INT::DOUBLE) AS positive_pct FROM (SELECT horizon, ticker, avg(net_return_pct) AS m FROM valid GROUP BY ALL) GROUP BY horizon")
def _(spark, d):
    return metrics.positive_share(valid(spark, d), "ticker")


@query("edge_weighting", s.CONTROL, "SELECT horizon, sum(s) / sum(n) AS event_weighted, avg(m) AS asset_weighted FROM (SELECT canon.horizon, canon.ticker, avg(net_return_pct - matched_return) AS m, sum(net_return_pct - matched_return) AS s, count(*) AS n FROM valid AS canon JOIN matched ON canon.ticker = matched.ticker AND canon.horizon = matched.horizon AND signal_date = event_date GROUP BY ALL) GROUP BY horizon")
def _(spark, d):
    f = features(spark, d)
    return metrics.edge_weights(baselines.enrich(valid(spark, d, f), per_event(spark, d, f)))


@query("unconditional", f"{s.BARS},\n{s.POS},\nu AS ({' UNION ALL '.join(f'SELECT ticker, {h} AS horizon, ({s.lead('close', h)} / close - 1) * 100 AS ret FROM pb' for h in s.HORIZONS)})", "SELECT ticker, horizon, coalesce(avg(ret), 0.0::DOUBLE) AS unconditional FROM u GROUP BY ALL")
def _(spark, d):
    return baselines.unconditional(baselines.control_returns(ft.add_positions(src.bars(spark, d))))


@query("exact_matched", s.CONTROL, "SELECT ticker, horizon, event_date, trend_regime, vol_regime, matched_return, n_controls, status FROM matched")
def _(spark, d):
    return per_event(spark, d)


@query("trend_only", f"{s.STUDY},\n{s.RETURNS}", "SELECT ticker, horizon, trend_regime, avg(ret) AS matched_return, count(*)::BIGINT AS n_controls FROM free GROUP BY ALL")
def _(spark, d):
    return baselines.pools(near(spark, d), 20, by_vol=False)


@query("benchmark_baseline", f"{_EV},\nb AS ({' UNION ALL '.join(f'SELECT session, {h} AS horizon, (lead(close, {h}) OVER (ORDER BY session) / close - 1) * 100 AS ret FROM bench' for h in s.HORIZONS)})", "SELECT horizon, coalesce(avg(ret), 0.0::DOUBLE) AS benchmark, count(ret)::BIGINT AS n_dates FROM (SELECT session FROM feat JOIN kept USING (ticker, pos)) JOIN b USING (session) GROUP BY horizon")
def _(spark, d):
    return baselines.benchmark_returns(src.benchmark(spark, d), events.detect(base(spark, d), RULES, 20))


@query("baseline_coverage", s.CONTROL, "SELECT * FROM cover")
def _(spark, d):
    return baselines.coverage(per_event(spark, d))


@query("regime_histogram", _EV, "SELECT trend_regime, vol_regime, count(*)::BIGINT AS n FROM feat JOIN kept USING (ticker, pos) GROUP BY ALL")
def _(spark, d):
    return baselines.histogram(events.detect(base(spark, d), RULES, 20))


@query("weighted_baseline", s.CONTROL, "SELECT horizon, sum(exact_matched_mean * n_events) / sum(n_events) AS weighted_baseline, sum(n_events)::BIGINT AS n_events, sum(n_valid)::BIGINT AS n_valid, sum(n_low_confidence)::BIGINT AS n_low_confidence, sum(n_insufficient)::BIGINT AS n_insufficient FROM cover GROUP BY horizon")
def _(spark, d):
    return baselines.weighted(baselines.coverage(per_event(spark, d)))


# --- quality, robustness, decision -----------------------------------------------------------

_DIRTY = """bad AS (SELECT ticker, session, CASE WHEN day(session) = 3 THEN NULL ELSE open END AS open, CASE WHEN day(session) = 5 THEN low - 1 ELSE high END AS high, low, CASE WHEN day(session) = 7 AND month(session) = 1 THEN -1.0::DOUBLE ELSE close END AS close, CASE WHEN day(session) = 9 THEN 0.0::DOUBLE ELSE volume END AS volume FROM bars),
twice AS (SELECT * FROM bad UNION ALL SELECT * FROM bad WHERE day(session) = 11),
q AS (SELECT *, abs(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY session), 0) - 1) * 100 AS jump FROM twice),
g AS (SELECT ticker, count(*) AS n, count(*) - count(DISTINCT session) AS dup, count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS bad, count(*) FILTER (high < low) AS flip, count(*) FILTER (close > high OR close < low) AS out_, count(*) FILTER (jump > 20) AS jump, count(*) FILTER (open IS NULL) AS mo, count(*) FILTER (volume = 0) AS still FROM q GROUP BY ticker)"""


@query("quality_issues", f"{s.BARS},\n{_DIRTY}", """SELECT ticker, unnest(i).severity AS severity, unnest(i).chk AS "check", unnest(i).n::BIGINT AS n FROM (SELECT ticker, list_filter([
  {'severity': 'WARNING', 'chk': 'DUPLICATE_DATES', 'n': dup}, {'severity': 'CRITICAL', 'chk': 'BAD_PRICES', 'n': bad}, {'severity': 'CRITICAL', 'chk': 'HIGH_BELOW_LOW', 'n': flip}, {'severity': 'WARNING', 'chk': 'CLOSE_OUTSIDE', 'n': out_}, {'severity': 'WARNING', 'chk': 'ABNORMAL_JUMP', 'n': jump},
  {'severity': CASE WHEN still > 0.1 * n THEN 'CRITICAL' ELSE 'WARNING' END, 'chk': 'ZERO_VOLUME', 'n': still}, {'severity': CASE WHEN mo > 0.1 * n THEN 'CRITICAL' ELSE 'WARNING' END, 'chk': 'MISSING_open', 'n': mo}, {'severity': 'CRITICAL', 'chk': 'LOW_COVERAGE', 'n': CASE WHEN n < 0.5 * 5000 THEN n ELSE 0 END}], lambda x: x.n > 0) AS i FROM g)""")
def _(spark, d):
    b, day = src.bars(spark, d), F.dayofmonth("session")
    b = b.withColumns({"open": F.when(day != 3, F.col("open")), "high": F.when(day == 5, F.col("low") - 1).otherwise(F.col("high")), "close": F.when((day == 7) & (F.month("session") == 1), -1.0).otherwise(F.col("close")), "volume": F.when(day == 9, 0.0).otherwise(F.col("volume"))})
    return quality.quality_issues(b.unionByName(b.where(F.dayofmonth("session") == 11)), "2000-01-01", "2019-10-25")


@query("loo_asset", s.STUDY, f"SELECT x.ticker AS excluded, h.horizon, count(canon.ticker) FILTER (canon.ticker <> x.ticker)::BIGINT AS n_events, coalesce(avg(forward_return) FILTER (canon.ticker <> x.ticker), 0.0::DOUBLE) AS mean_return FROM (SELECT DISTINCT ticker FROM bars) x CROSS JOIN (SELECT unnest({list(s.HORIZONS)}) AS horizon) h LEFT JOIN canon ON canon.horizon = h.horizon GROUP BY ALL")
def _(spark, d):
    return robustness.leave_one_out(canon(spark, d), "ticker", parts=src.bars(spark, d), horizons=trades.HORIZONS)


@query("loo_year", s.STUDY, f"SELECT x.y AS excluded, h.horizon, count(canon.ticker) FILTER (year(signal_date) <> x.y)::BIGINT AS n_events, coalesce(avg(forward_return) FILTER (year(signal_date) <> x.y), 0.0::DOUBLE) AS mean_return FROM (SELECT DISTINCT year(session)::INTEGER AS y FROM bars) x CROSS JOIN (SELECT unnest({list(s.HORIZONS)}) AS horizon) h LEFT JOIN canon ON canon.horizon = h.horizon GROUP BY ALL")
def _(spark, d):
    return robustness.leave_one_out(canon(spark, d).withColumn("year", F.year("signal_date")), "year", parts=src.bars(spark, d).select(F.year("session").alias("year")), horizons=trades.HORIZONS)


@query("profit_concentration", f"{s.STUDY},\np AS (SELECT horizon, ticker, sum(forward_return) AS s FROM canon GROUP BY ALL),\nb AS (SELECT horizon, sum(s) AS total, count(*)::BIGINT AS n_assets, max({{'s': s, 'p': ticker}}) AS top FROM p GROUP BY horizon),\nr AS (SELECT horizon, forward_return AS x, row_number() OVER (PARTITION BY horizon ORDER BY forward_return DESC, ticker, signal_date) AS r FROM canon)", "SELECT b.horizon, one / total * 100 AS best_trade_pct, three / total * 100 AS best_3_pct, top.p AS best_asset, top.s / total * 100 AS best_asset_pct, n_trades, n_assets, CASE WHEN total > 0 THEN 'OK' ELSE 'NOT_APPLICABLE' END AS status FROM b JOIN (SELECT horizon, max(x) AS one, sum(x) AS three FROM r WHERE r <= 3 GROUP BY horizon) USING (horizon) JOIN (SELECT horizon, count(*)::BIGINT AS n_trades FROM canon GROUP BY horizon) USING (horizon)")
def _(spark, d):
    return robustness.concentration(canon(spark, d))


#: Resampled means by hashed Poisson weights.
_MEANS = f"x AS (SELECT horizon, net_return_pct AS x, ('0x' || substr(md5(ticker || '|' || signal_date::VARCHAR), 1, 7))::BIGINT + 1 AS r FROM valid),\ndr AS (SELECT horizon, k, x, r * ((k * 48271 + 11) % {robustness.PRIME}) % {robustness.PRIME} / {robustness.PRIME}.0::DOUBLE AS u FROM x, range(1, 10001) t(k)),\nmeans AS (SELECT horizon, k, sum(w * x) / sum(w) AS mean FROM (SELECT horizon, k, x, {' + '.join(f'(u > {p!r}::DOUBLE)::INT' for p in robustness.POISSON)} AS w FROM dr) GROUP BY ALL HAVING sum(w) > 0)"
_INTERVAL = "SELECT horizon, quantile_cont(mean, 0.025::DOUBLE) AS ci_lower, quantile_cont(mean, 0.975::DOUBLE) AS ci_upper, stddev_samp(mean) AS std_error FROM means GROUP BY horizon"


@query("bootstrap_hash", f"{s.STUDY},\n{_MEANS}", _INTERVAL)
def _(spark, d):
    return robustness.bootstrap_hashed(valid(spark, d))


@query("bootstrap_numpy")
def _(spark, d):
    return robustness.bootstrap(valid(spark, d), ["horizon"])


_EVIDENCE = "gross AS (SELECT horizon, 100 * max(forward_return) / nullif(sum(forward_return), 0) AS best_trade_pct FROM canon GROUP BY horizon),\nev AS (SELECT horizon, count(*)::BIGINT AS n_total, avg(net_return_pct) AS mean, median(net_return_pct) AS median, median(net_return_pct) FILTER (temporal_split = 'validation') AS validation_median, count(*) FILTER (temporal_split = 'validation')::BIGINT AS validation_n, median(net_return_pct) FILTER (temporal_split = 'holdout') AS holdout_median, count(*) FILTER (temporal_split = 'holdout')::BIGINT AS holdout_n, any_value(gross.best_trade_pct) AS best_trade_pct, avg(transaction_cost_pct) AS cost_pct FROM valid JOIN gross USING (horizon) GROUP BY horizon)"


_GATES = f"{_EVIDENCE},\n{_MEANS},\nboot AS ({_INTERVAL}),\ncov AS (SELECT horizon, 100.0::DOUBLE * avg((status <> 'INSUFFICIENT')::INT::DOUBLE) AS coverage_pct FROM matched GROUP BY horizon)"


@query("decision_table", f"{s.CONTROL},\n{_GATES}", """SELECT horizon, n_total, mean, median, coverage_pct, ci_lower, ci_upper, CASE WHEN n_total < 40 OR mean <= 0 OR coalesce(validation_median <= 0, false) OR coalesce(validation_n < 10, false) OR coalesce(holdout_median <= 0, false) OR coalesce(holdout_n < 10, false) THEN 'REJECTED'
  WHEN coverage_pct < 50 THEN 'RESEARCH' WHEN n_total >= 60 AND median > 0 AND best_trade_pct <= 20 AND NOT (ci_lower < 0 AND ci_upper > 0) AND mean >= 1.5 * cost_pct THEN 'CANDIDATE' ELSE 'RESEARCH' END AS verdict FROM ev LEFT JOIN cov USING (horizon) LEFT JOIN boot USING (horizon)""")
def _(spark, d):
    f = features(spark, d)
    return decision.decide_all(evidence(materialize(canon(spark, d, f), "trades"), per_event(spark, d, f))).select("horizon", "n_total", "mean", "median", "coverage_pct", "ci_lower", "ci_upper", "verdict")


def evidence(t: DataFrame, controls: DataFrame) -> DataFrame:
    """What the gates ask for, per horizon: metrics of trades, the share of events with controls, the bootstrap interval."""
    x, part = F.col("net_return_pct"), F.col("temporal_split")
    own = splits.purged(t)
    aggs = [F.count("*").alias("n_total"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.avg("transaction_cost_pct").alias("cost_pct")]
    for p in ("validation", "holdout"):
        aggs += [F.median(F.when(part == p, x)).alias(f"{p}_median"), F.count_if(part == p).alias(f"{p}_n")]
    best = robustness.concentration(t).select("horizon", "best_trade_pct")
    cover = controls.groupBy("horizon").agg((100 * F.avg((F.col("status") != "INSUFFICIENT").cast("double"))).alias("coverage_pct"))
    boot = robustness.bootstrap_hashed(own).select("horizon", "ci_lower", "ci_upper")
    return own.groupBy("horizon").agg(*aggs).join(best, "horizon", "left").join(cover, "horizon", "left").join(boot, "horizon", "left")


# --- whole studies -----------------------------------------------------------------------------


@query("all_baselines", f"{s.CONTROL},\n{s.ALL_BASELINES}", "SELECT ticker, horizon, unconditional, exact_matched_mean, trend_only_mean, benchmark, n_events, n_valid FROM every")
def _(spark, d):
    f = features(spark, d)
    e = events.detect(f, RULES, 20)
    out = baselines.all_baselines(e, control_rows(f, e), 20, src.benchmark(spark, d))
    return out.select("ticker", "horizon", "unconditional", "exact_matched_mean", "trend_only_mean", "benchmark", "n_events", "n_valid")


_WEIGHTED = ", ".join(f"sum({c} * n_events) / sum(n_events) AS {c}" for c in ("unconditional", "exact_matched_mean", "trend_only_mean", "benchmark"))


@query("weighted_baselines", f"{s.CONTROL},\n{s.ALL_BASELINES}", f"SELECT horizon, {_WEIGHTED}, sum(n_events)::BIGINT AS n_events, sum(n_valid)::BIGINT AS n_valid, round(100.0::DOUBLE * sum(n_valid) / sum(n_events), 1) AS valid_pct FROM every GROUP BY horizon")
def _(spark, d):
    f = features(spark, d)
    e = events.detect(f, RULES, 20)
    return baselines.weighted_all(baselines.all_baselines(e, control_rows(f, e), 20, src.benchmark(spark, d))).select("horizon", "unconditional", "exact_matched_mean", "trend_only_mean", "benchmark", "n_events", "n_valid", "valid_pct")


#: Local tickers are those of the first priority, and the last one is a reference that no events are searched in.
_LOCAL = """raw AS (SELECT * FROM bars0 LEFT JOIN fx USING (session)),
rated AS (SELECT *, CASE WHEN starts_with(ticker, '1') THEN last_value(ccl IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) ELSE 1.0::DOUBLE END AS rate FROM raw),
bars AS (SELECT ticker, session, open / rate AS open, high / rate AS high, low / rate AS low, close / rate AS close, volume FROM rated WHERE rate IS NOT NULL)"""
_EQUITY = ",\n".join([s.BARS.replace("bars AS", "bars0 AS", 1), s.FX, _LOCAL, s.BENCH, s.POS, s.FEATURES, s.REGIMES, s.kept(f"{s.RULE} AND NOT starts_with(ticker, '5')", 20), s.trades(), s.BOUNDS.replace("FROM bars)", "FROM (SELECT session FROM bars UNION SELECT session FROM bench))"), s.CANON])
EQUITY = {
    "experiment": {"id": "equity", "family": "pullback"}, "event": {"conditions": [{"feature": r.feature, "operator": r.op, "value": r.value} for r in RULES], "cooldown_sessions": 20, "forward_horizons": list(s.HORIZONS)},
    "validation": {"discovery_pct": 60, "validation_pct": 20, "holdout_pct": 20}, "research": {"primary_horizon": 10},
}


def equity(spark: SparkSession, d: str):
    """The whole study: quality gate, base currency, features, events of targets, trades, controls, splits."""
    bars = src.bars(spark, d)
    universe = bars.select("ticker", F.when(F.col("ticker").startswith("5"), "reference").otherwise("target").alias("role")).distinct()
    first = F.col("ticker").startswith("1")
    return run(spark, Experiment.from_config(EQUITY), bars, src.benchmark(spark, d), market(), fx=src.fx_rates(spark, d), local=first, targets=universe)


@query("experiment_equity", _EQUITY, "SELECT horizon, CASE WHEN grouping(temporal_split) = 1 THEN 'all' ELSE temporal_split END AS temporal_split, count(*)::BIGINT AS n_events, avg(net_return_pct) AS mean, median(net_return_pct) AS median, avg((net_return_pct > 0)::INT::DOUBLE) AS win_rate FROM valid GROUP BY GROUPING SETS ((temporal_split, horizon), (horizon))", 5)
def _(spark, d):
    return metrics.split_metrics(equity(spark, d).formal)


# --- more sources ------------------------------------------------------------------------------

_VENDOR = ", ".join(f'{c}::VARCHAR AS "{c.title()}"' for c in ("open", "high", "low", "close", "volume"))


def _stock_prices(spark, d):
    """Bars as a daily database holds them: its own names, and numbers as text."""
    b = src.bars(spark, d)
    return b.select(F.col("ticker").alias("Ticker"), F.col("session").alias("Date"), *[F.col(c).cast("string").alias(c.title()) for c in ("open", "high", "low", "close", "volume")])


@query("database_bars", s.BARS, "SELECT ticker, session, open, high, low, close, volume, close AS adj_close FROM bars WHERE ticker IN ('1-URGENT', '3-MEDIUM') AND session BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'", 4)
def _(spark, d):
    return src.daily_bars(_stock_prices(spark, d), ["1-URGENT", "3-MEDIUM"], "1995-01-01", "1996-12-31")


@query("database_benchmark", s.BARS, "SELECT ticker, session, open, high, low, close, volume, close AS adj_close, open AS open_usd, high AS high_usd, low AS low_usd, close AS close_usd FROM (SELECT * FROM bars WHERE ticker = '2-HIGH' ORDER BY session DESC LIMIT 300)", 4)
def _(spark, d):
    return src.recent_benchmark(_stock_prices(spark, d), "2-HIGH", 300)


@query("database_rates", s.FX, "SELECT session, ccl FROM fx WHERE ccl > 0 AND session BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def _(spark, d):
    table = src.fx_rates(spark, d).select(F.col("session").cast("string").alias("date"), F.col("ccl").cast("string").alias("ccl"))
    return src.daily_rates(table, "1995-01-01", "1996-12-31")


def _two_listings(spark, d):
    b = src.bars(spark, d)
    return b.where("ticker = '1-URGENT'"), b.where("ticker = '2-HIGH'")


_IMPLIED = """x AS (SELECT a.session, CASE WHEN a.close * 100 / b.close > 10 AND a.close * 100 / b.close < 5000 THEN a.close * 100 / b.close END AS r FROM bars a JOIN bars b USING (session) WHERE a.ticker = '1-URGENT' AND b.ticker = '2-HIGH'),
implied AS (SELECT session, last_value(r IGNORE NULLS) OVER (ORDER BY session ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS ccl FROM x)"""


@query("rates_with_fallback", f"{s.BARS},\n{s.FX},\n{_IMPLIED}", "SELECT 'stored' AS name, session, ccl FROM fx WHERE ccl > 0 AND session BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' UNION ALL SELECT 'implied', session, ccl FROM implied WHERE ccl IS NOT NULL AND session BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def _(spark, d):
    local, foreign = _two_listings(spark, d)
    table = src.fx_rates(spark, d).withColumnRenamed("session", "date")
    out = [src.load_rates(t, local, foreign, "1995-01-01", "1995-12-31", 100.0).select(F.lit(n).alias("name"), "session", "ccl") for n, t in (("stored", table), ("implied", table.where("ccl < 0")))]
    return out[0].unionByName(out[1])


@query("list_instruments", "n AS (SELECT DISTINCT p_name, p_brand FROM part)", "SELECT p_name AS name, p_brand AS symbol FROM n")
def _(spark, d):
    return src.list_instruments(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name"), F.col("p_brand").alias("symbol")))


@query("tick_coercion", s.TICKS, "SELECT symbol, ts, bid, ask, last, event_id FROM (SELECT symbol, ts, CASE WHEN event_id % 11 <> 0 THEN bid END AS bid, ask, CASE WHEN event_id % 13 <> 0 THEN last END AS last, event_id FROM ticks) WHERE ts IS NOT NULL AND event_id % 17 <> 0 AND coalesce(bid, ask, last) IS NOT NULL")
def _(spark, d):
    """Ticks that arrive as text, with words in place of some numbers and times."""
    t, k = src.ticks(spark, d), F.col("event_id")
    text = t.select("symbol", F.when(k % 17 == 0, "soon").otherwise(F.col("ts").cast("string")).alias("ts"), F.when(k % 11 == 0, "n/a").otherwise(F.col("bid").cast("string")).alias("bid"), F.col("ask").cast("string").alias("ask"), F.when(k % 13 == 0, "nan").otherwise(F.col("last").cast("string")).alias("last"), "event_id")
    return src.coerced_ticks(text)


@query("latest_trades", s.TICKS, "SELECT symbol, ts, last AS price, event_id FROM ticks WHERE symbol = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(spark, d):
    t = src.ticks(spark, d).select("symbol", F.col("ts").alias("trade_date"), F.col("last").alias("price"), "event_id")
    return src.latest_trades(t, "click", 50).withColumnRenamed("trade_date", "ts")


_SPAN = "DATE '2024-01-05' AND DATE '2024-01-20'"


@query("symbol_ticks_to_daily", s.TICKS, f"SELECT symbol, ts::DATE AS day, arg_min(last, {{'t': ts, 'e': event_id}}) AS open, max(last) AS high, min(last) AS low, arg_max(last, {{'t': ts, 'e': event_id}}) AS close, avg(bid) AS vwap_bid, avg(ask) AS vwap_ask, count(*)::BIGINT AS n_ticks FROM ticks WHERE last IS NOT NULL AND symbol = 'click' AND ts::DATE BETWEEN {_SPAN} GROUP BY 1, 2")
def _(spark, d):
    return tk.ticks_to_daily(src.ticks(spark, d), "click", "2024-01-05", "2024-01-20")


@query("period_counts", f"{s.BARS},\n{s.BOUNDS}", f"SELECT ticker, {s.period('session')} AS name, count(*)::BIGINT AS n FROM bars, bounds WHERE session <= holdout_end GROUP BY ALL")
def _(spark, d):
    b = src.bars(spark, d)
    return splits.by_period(b, splits.boundaries(b)).groupBy("ticker", F.col("period").alias("name")).agg(F.count("*").alias("n"))


# --- ticks and ledger ------------------------------------------------------------------------


@query("ticks_to_daily", s.TICKS, "SELECT symbol, ts::DATE AS day, arg_min(last, {'t': ts, 'e': event_id}) AS open, max(last) AS high, min(last) AS low, arg_max(last, {'t': ts, 'e': event_id}) AS close, avg(bid) AS vwap_bid, avg(ask) AS vwap_ask, count(*)::BIGINT AS n_ticks FROM ticks WHERE last IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return tk.daily_bars(src.ticks(spark, d))


_ORDERS = f"{s.TICKS},\no AS (SELECT symbol, date_trunc('day', ts) + INTERVAL 12 HOUR AS want FROM ticks GROUP BY ALL)"


def _orders(spark, d):
    return src.ticks(spark, d).select("symbol", (F.date_trunc("day", "ts") + F.expr("INTERVAL 12 HOURS")).cast("timestamp_ntz").alias("want")).distinct()


def _fill(side: str) -> str:
    return f"SELECT o.symbol, o.want, arg_min({side}, {{'t': ts, 'e': event_id}}) AS price, min(ts) AS filled FROM o LEFT JOIN ticks t ON t.symbol = o.symbol AND t.{side} > 0 AND ts >= want AND ts <= want + INTERVAL 1 HOUR GROUP BY 1, 2"


@query("fill_ask", _ORDERS, _fill("ask"))
def _(spark, d):
    return tk.first_quote(_orders(spark, d), src.ticks(spark, d), "ask", "want", 3600, "price", "filled")


@query("fill_bid", _ORDERS, _fill("bid"))
def _(spark, d):
    return tk.first_quote(_orders(spark, d), src.ticks(spark, d), "bid", "want", 3600, "price", "filled")


_LONG = f"""{_ORDERS},
e AS (SELECT o.symbol, o.want AS signal_ts, arg_min(ask, {{'t': ts, 'e': event_id}}) AS entry_price, min(ts) AS entry_ts FROM o JOIN ticks t ON t.symbol = o.symbol AND ask > 0 AND ts >= want AND ts <= want + INTERVAL 48 HOUR GROUP BY 1, 2),
h AS (SELECT e.*, unnest([1, 3, 5]) AS horizon FROM e),
lt AS (SELECT h.symbol, signal_ts, horizon, entry_price, entry_ts, arg_min(bid, {{'t': ts, 'e': event_id}}) AS exit_price, min(ts) AS exit_ts FROM h JOIN ticks t ON t.symbol = h.symbol AND bid > 0 AND ts >= entry_ts + to_days(horizon) AND ts <= entry_ts + to_days(horizon) + INTERVAL 48 HOUR GROUP BY 1, 2, 3, 4, 5),
lr AS (SELECT *, (exit_price / entry_price - 1) * 100 AS gross_return_pct, abs(entry_price - exit_price) / entry_price * 100 AS spread_cost_pct, (exit_price / entry_price - 1) * 100 - 0.46::DOUBLE AS net_return_pct FROM lt)"""


def _long(spark, d):
    return tk.long_trades(_orders(spark, d).withColumnRenamed("want", "signal_ts"), src.ticks(spark, d), (1, 3, 5))


@query("long_trades", _LONG, "SELECT * FROM lr")
def _(spark, d):
    return _long(spark, d)


@query("futures_summary", _LONG, "SELECT horizon, count(*)::BIGINT AS n, avg(gross_return_pct) AS gross_mean, median(gross_return_pct) AS gross_median, avg(net_return_pct) AS net_mean, median(net_return_pct) AS net_median, avg((net_return_pct > 0)::INT::DOUBLE) AS win_rate, avg(spread_cost_pct) AS avg_spread FROM lr GROUP BY horizon", 5)
def _(spark, d):
    return tk.summarise(_long(spark, d))


_AS_OF = "last_day AS (SELECT max(session) AS a FROM bars)"
_PAPER = f"{s.BASE},\n{_AS_OF},\nopen_ AS (SELECT ticker, 'dip' AS signal_type, session AS signal_date, session AS entry_date, close AS entry_price, 7::BIGINT AS quantity, 1000.0::DOUBLE AS position_usd FROM feat, last_day WHERE starts_with(ticker, '5') AND session > a - 40 AND day(session) % 4 = 0),\nsg AS (SELECT ticker, session AS signal_date, 'volume' AS signal_type, close AS price FROM feat, last_day WHERE session > a - 40 AND volume_ratio_20d > 1.1)"
_NEW = "SELECT ticker, signal_type, signal_date, signal_date AS entry_date, price AS entry_price, CASE WHEN price > 0 THEN floor(1000000.0::DOUBLE / price) ELSE 1 END::BIGINT AS quantity, 1000000.0::DOUBLE AS position_usd, 'OPEN' AS status FROM (SELECT *, row_number() OVER (ORDER BY signal_date, ticker) AS slot FROM (SELECT * FROM sg WHERE ticker NOT IN (SELECT ticker FROM open_) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY signal_date, signal_type) = 1)) WHERE slot + (SELECT count(*) FROM open_) <= 12"
_OLD = "SELECT o.ticker, signal_type, signal_date, entry_date, a AS exit_date, entry_price, exit_price, quantity, position_usd, 'CLOSED' AS status, (exit_price / entry_price - 1) * 100 - 0.847::DOUBLE AS pnl_pct, round(position_usd * ((exit_price / entry_price - 1) * 100 - 0.847::DOUBLE) / 100, 2) AS pnl_usd FROM open_ o, last_day, (SELECT ticker, arg_max(close, session) AS exit_price FROM feat GROUP BY ticker) l WHERE l.ticker = o.ticker AND a - entry_date >= 10"


def _paper(spark, d):
    f = base(spark, d)
    last = F.broadcast(f.agg(F.max("session").alias("__a")))
    late = f.join(last).where(F.col("session") > F.date_sub("__a", 40))
    open_ = late.where(F.col("ticker").startswith("5") & (F.dayofmonth("session") % 4 == 0)).select("ticker", F.lit("dip").alias("signal_type"), F.col("session").alias("signal_date"), F.col("session").alias("entry_date"), F.col("close").alias("entry_price"), F.lit(7).cast("long").alias("quantity"), F.lit(1000.0).alias("position_usd"))
    signals = late.where("volume_ratio_20d > 1.1").select("ticker", F.col("session").alias("signal_date"), F.lit("volume").alias("signal_type"), F.col("close").alias("price"))
    return f, open_, signals


@query("paper_entries", _PAPER, _NEW)
def _(spark, d):
    _, open_, signals = _paper(spark, d)
    return ledger.entries(signals, open_, 12, 1_000_000.0)


def _closed(spark, d):
    f, open_, _ = _paper(spark, d)
    # The last day travels with the positions as a column.
    open_ = open_.join(F.broadcast(f.agg(F.max("session").alias("__as_of"))))
    return open_, ledger.exits(open_, f, F.col("__as_of"), 10, 0.00847)


@query("paper_exits", _PAPER, _OLD)
def _(spark, d):
    return _closed(spark, d)[1]


@query("paper_status", f"{_PAPER},\nold AS ({_OLD})", "SELECT (SELECT count(*) FROM open_)::BIGINT AS n_open, (SELECT sum(position_usd) FROM open_) AS exposure_usd, (SELECT count(*) FROM old)::BIGINT AS n_closed, (SELECT sum(pnl_usd) FROM old) AS pnl_usd, (SELECT count(*) FROM old WHERE pnl_usd > 0)::BIGINT AS n_wins")
def _(spark, d):
    return ledger.status(*_closed(spark, d))


@query("paper_last_closed", f"{_PAPER},\nold AS ({_OLD})", "SELECT ticker, entry_date, exit_date, pnl_pct, pnl_usd FROM old ORDER BY exit_date DESC, ticker, entry_date LIMIT 5")
def _(spark, d):
    return ledger.last_closed(_closed(spark, d)[1]).select("ticker", "entry_date", "exit_date", "pnl_pct", "pnl_usd")


# --- streaming --------------------------------------------------------------------------------


@query("stream_daily_bars")
def _(spark, d):
    from eventide.streaming.streams import replay_daily_bars

    return replay_daily_bars(spark, f"{d}/events.parquet")


@query("stream_long_trades", _LONG, "SELECT * FROM lr")
def _(spark, d):
    """The trades of ``long_trades``, with every fill found by a join of two streams."""
    from eventide.streaming.fills import replay_long_trades
    from eventide.streaming.streams import event_stream

    return replay_long_trades(_orders(spark, d).withColumnRenamed("want", "signal_ts"), src.as_ticks(event_stream(spark, f"{d}/events.parquet")), (1, 3, 5))
