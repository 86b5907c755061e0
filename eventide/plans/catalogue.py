"""Further queries over the test tables: stores, ranks, grids and scans."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.functions import features as ft
from eventide.functions import scans
from eventide.operators import baselines, events, metrics, ranks, robustness, rolls, routes
from eventide.sources import cache, intervals, landed
from eventide.sources import market as src
from eventide.sources.tables import shared_dir

from . import sqltext as s
from .experiment import Experiment, run
from .register import ORACLES, QUERIES, WITHOUT, base, features, market, per_event, query, valid

__all__ = ["ORACLES", "QUERIES"]

# --- the cache of ranges -----------------------------------------------------------

#: Stored: of every year, 180 days from its first session and 100 to 200 days after it. Wanted: two overlapping intervals a ticker.
_RANGES = f"""{s.BARS},
firsts AS (SELECT ticker, min(session) AS a FROM bars GROUP BY ticker, year(session)),
stored AS (SELECT ticker, a AS x, a + 180 AS y FROM firsts UNION ALL SELECT ticker, a + 100, a + 200 FROM firsts),
spans AS (SELECT ticker, min(session) AS a, max(session) AS b FROM bars GROUP BY ticker),
wanted AS (SELECT ticker, a AS x, a + 1500 AS y FROM spans UNION ALL SELECT ticker, a + 1000, b FROM spans),
missing AS (
  SELECT DISTINCT ticker, unnest(generate_series(x, y, INTERVAL 1 DAY))::DATE AS d FROM wanted
  EXCEPT SELECT ticker, unnest(generate_series(x, y, INTERVAL 1 DAY))::DATE FROM stored)"""


def _stored(bars):
    first = bars.groupBy("ticker", F.year("session").alias("y")).agg(F.min("session").alias("a"))
    one = first.select("ticker", F.col("a").alias("start"), F.date_add("a", 180).alias("end"))
    return one.unionByName(first.select("ticker", F.date_add("a", 100).alias("start"), F.date_add("a", 200).alias("end")))


def _wanted(bars):
    span = bars.groupBy("ticker").agg(F.min("session").alias("a"), F.max("session").alias("b"))
    one = span.select("ticker", F.col("a").alias("start"), F.date_add("a", 1500).alias("end"))
    return one.unionByName(span.select("ticker", F.date_add("a", 1000).alias("start"), F.col("b").alias("end")))


WITHOUT += ["cache_gaps", "cache_digests"]


@query("cache_gaps", _RANGES, "SELECT ticker, min(d) AS start, max(d) AS \"end\" FROM (SELECT ticker, d, d - (row_number() OVER (PARTITION BY ticker ORDER BY d))::INTEGER AS island FROM missing) GROUP BY ticker, island")
def _(spark, d):
    bars = src.bars(spark, d)
    return intervals.difference(_wanted(bars), _stored(bars), ["ticker"])


@query("cache_refresh", _RANGES, "SELECT bars.ticker, session, open, high, low, close, close + CASE WHEN missing.d IS NULL THEN 0 ELSE 1000 END AS adj_close, volume FROM bars LEFT JOIN missing ON missing.ticker = bars.ticker AND missing.d = session")
def _(spark, d):
    """A cache that has the stored days is asked for the wanted ones; what comes by the second fetch is marked in adj_close."""
    bars = src.bars(spark, d)
    own = cache.BarCache(spark, f"{shared_dir(spark).rstrip('/')}/eventide-{uuid.uuid4().hex}-cache", "orders", buckets=2)
    own.refresh(_stored(bars), cache.fetch_from(bars.withColumn("adj_close", F.col("close"))))
    return own.get(_wanted(bars), cache.fetch_from(bars.withColumn("adj_close", F.col("close") + 1000)))


_CENTS = [("close", "(close * 100)::BIGINT"), ("open", "(open * 100)::BIGINT"), ("session", "session"), ("ticker", "ticker"), ("volume", "volume::BIGINT")]
_CELLS = " || ".join(f"coalesce(length(({sql})::VARCHAR) || ':' || ({sql})::VARCHAR, '-')" for _, sql in _CENTS)


@query("cache_digests", f"""{s.BARS},
h AS (SELECT ticker, strftime(session, '%Y-%m') AS month, ('0x' || substr(sha256({_CELLS}), 1, 15))::BIGINT AS h FROM bars),
leaves AS (SELECT ticker, month, count(*)::BIGINT AS n_rows, sha256(count(*) || '|' || bit_xor(h) || '|' || sum(h::HUGEINT)) AS digest FROM h GROUP BY ALL)""",
"SELECT * FROM leaves UNION ALL SELECT ticker, NULL, sum(n_rows)::BIGINT, sha256(string_agg(month || '|' || digest, chr(10) ORDER BY month)) FROM leaves GROUP BY ticker")
def _(spark, d):
    """Leaves, and as rows without a month the roots, of whole numbers."""
    bars = src.bars(spark, d)
    cents = [(F.col(c) * 100).cast("decimal(20,0)").cast("long").alias(c) for c in ("open", "close")]
    leaves = cache.digests(bars.select("ticker", "session", *cents, F.col("volume").cast("long").alias("volume")))
    return leaves.unionByName(cache.roots(leaves).withColumn("month", F.lit(None).cast("string")))


# --- landed answers ----------------------------------------------------------------


@query("landed_quotes", s.BARS, "SELECT ticker, session, open, high, low, close, close AS adj_close, volume FROM bars WHERE ticker IN ('1-URGENT', '4-NOT SPECIFIED') AND session BETWEEN DATE '1994-06-01' AND DATE '1996-03-31'")
def _(spark, d):
    """Bars written as a fetcher lands them, a JSON answer a ticker and year in turn flat and nested, and read by the data source."""
    bars = src.bars(spark, d).withColumn("year", F.year("session"))
    rows = F.sort_array(F.collect_list(F.struct(F.unix_seconds(F.col("session").cast("timestamp")).alias("t"), "open", "high", "low", "close", "volume")))
    own = bars.groupBy("ticker", "year").agg(rows.alias("r"))
    arrays = [F.col(f"r.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")]
    flat = F.struct(F.col("r.t").alias("timestamp"), *arrays)
    nested = F.struct(F.struct(F.array(F.struct(F.col("r.t").alias("timestamp"), F.struct(F.array(F.struct(*arrays)).alias("quote")).alias("indicators"))).alias("result")).alias("chart"))
    path = f"{shared_dir(spark).rstrip('/')}/eventide-{uuid.uuid4().hex}-landed"
    own.select("ticker", "year", F.when(F.col("year") % 2 == 0, F.to_json(flat)).otherwise(F.to_json(nested)).alias("value")).write.partitionBy("ticker", "year").text(path)
    return src.between(landed.landed(spark, path).where(F.col("ticker").isin("1-URGENT", "4-NOT SPECIFIED")), "1994-06-01", "1996-03-31")


# --- ranks ---------------------------------------------------------------------------

_SHARES = {"p01": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}
_QUANTILES = ", ".join(f"quantile_cont(x, {q}::DOUBLE) AS {n}" for n, q in _SHARES.items())


@query("exact_quantiles", "v AS (SELECT l_returnflag AS flag, CASE WHEN l_linenumber <> 4 THEN l_linenumber::VARCHAR END AS line, CASE WHEN l_discount <> 0.05 THEN CASE WHEN l_linenumber = 2 THEN l_quantity ELSE l_extendedprice END END::DOUBLE AS x FROM lineitem)", f"SELECT flag, line, count(x)::BIGINT AS n, {_QUANTILES} FROM v WHERE x IS NOT NULL GROUP BY flag, line", exact="flag line")
def _(spark, d):
    """Prices, and for one line number quantities (50 values), with nulls and a null group."""
    line = F.col("l_linenumber").cast("string")
    x = F.when(F.col("l_discount") != 0.05, F.when(line == "2", F.col("l_quantity")).otherwise(F.col("l_extendedprice")))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("flag"), F.when(line != "4", line).alias("line"), x.alias("x"))
    return ranks.quantiles(rows, ["flag", "line"], "x", _SHARES)


@query("ranked_metrics", s.STUDY, f"SELECT {s.metrics('horizon')} FROM valid GROUP BY horizon")
def _(spark, d):
    return metrics.by_ranks(valid(spark, d, features(spark, d)), "horizon")


_EDGES = f"""{s.CONTROL},
edged AS (SELECT v.*, v.net_return_pct - matched_return AS incremental_edge_net FROM valid v LEFT JOIN matched m ON v.ticker = m.ticker AND v.horizon = m.horizon AND signal_date = event_date),
long AS (SELECT * REPLACE (horizon::INTEGER AS horizon), 'net_return_pct' AS measure, net_return_pct AS x FROM edged UNION ALL SELECT * REPLACE (horizon::INTEGER AS horizon), 'incremental_edge_net', incremental_edge_net FROM edged)"""


def _without(cells: str, out: str) -> str:
    """Everything computed again without each part."""
    return f"""SELECT c.p AS excluded, h.horizon, m.measure, count(x) FILTER (NOT {out})::BIGINT AS n_events, coalesce(avg(x) FILTER (NOT {out}), 0.0::DOUBLE) AS mean, coalesce(median(x) FILTER (NOT {out}), 0.0::DOUBLE) AS median
FROM ({cells}) c CROSS JOIN (SELECT unnest({list(s.HORIZONS)})::INTEGER AS horizon) h CROSS JOIN (SELECT unnest(['net_return_pct', 'incremental_edge_net']) AS measure) m
LEFT JOIN long ON long.horizon = h.horizon AND long.measure = m.measure GROUP BY ALL"""


def _edged(spark, d):
    f = features(spark, d)
    return baselines.enrich(valid(spark, d, f), per_event(spark, d, f))


@query("loo_asset_ranked", _EDGES, _without("SELECT DISTINCT ticker AS p FROM bars", "(ticker = c.p)"), exact="measure")
def _(spark, d):
    assets = src.bars(spark, d).select(F.col("ticker").alias("excluded"))
    return robustness.leave_one_out_ranked(_edged(spark, d), F.array("ticker"), assets)


@query("loo_year_ranked", _EDGES, _without("SELECT DISTINCT year(session)::INTEGER AS p FROM bars", "(c.p IN (year(signal_date), year(entry_date), year(exit_date)))"), exact="measure")
def _(spark, d):
    """A trade is left out with the years of its signal, its entry and its exit."""
    years = src.bars(spark, d).select(F.year("session").alias("excluded"))
    return robustness.leave_one_out_ranked(_edged(spark, d), robustness.trade_years(), years)


# --- running sums and scans ------------------------------------------------------------

_LENGTHS = (2, 5, 20, 60, 120, 200)


def _direct(n: int) -> str:
    mean, std = s.full("close", n, "avg"), s.full("close", n, "stddev_samp")
    return f"SELECT ticker, session, {n} AS length, {mean} AS mean, {std} AS std, (close - ({mean})) / nullif({std}, 0) AS zscore FROM pb"


@query("length_grid", f"{s.BARS},\n{s.POS}", " UNION ALL ".join(map(_direct, _LENGTHS)), 5, exact="length")
def _(spark, d):
    return scans.length_grid(src.bars(spark, d), "close", _LENGTHS)


_MEANS, _CHANGES, _DROPS = (60, 120, 200), (3, 10), (-0.05, -0.02)
_CELLS_OF = [(f"sma {m} change {c} < {x}", m, c, x) for m in _MEANS for c in _CHANGES for x in _DROPS]
_WINDOWS = f"{s.BARS},\n{s.POS},\nfeat AS (SELECT ticker, session, pos, close, {', '.join(f'{s.full("close", m, "avg")} AS sma_{m}' for m in _MEANS)}, {', '.join(f'close / {s.lag("close", c)} - 1 AS change_{c}' for c in _CHANGES)} FROM pb)"
_GRIDS = ",\n".join([_WINDOWS] + [s.kept(f"close > sma_{m} AND change_{c} < {x}", 15, f"k{i}") for i, (_, m, c, x) in enumerate(_CELLS_OF)] + [f"fr AS (SELECT ticker, pos, ({s.lead('close', 5)} / close - 1) * 100 AS ret FROM feat)"])


@query("window_length_grid", _GRIDS, " UNION ALL ".join(f"SELECT '{n}' AS cell, (SELECT count(*) FROM sig_k{i})::BIGINT AS n_signals, (SELECT count(*) FROM k{i})::BIGINT AS n_events, (SELECT avg(ret) FROM k{i} JOIN fr USING (ticker, pos)) AS metric" for i, (n, *_) in enumerate(_CELLS_OF)), exact="n_signals n_events")
def _(spark, d):
    """Rules over several lengths of means and changes, every length from the same running sums."""
    bars = scans.add_lengths(ft.add_positions(src.bars(spark, d)), "close", _MEANS, _CHANGES)
    cells = [(n, [events.Rule(f"above_sma_{m}", "==", 1.0), events.Rule(f"change_{c}", "<", x)]) for n, m, c, x in _CELLS_OF]
    return events.grid(bars, cells, 15, "close")


@query("ema_scan", f"{s.BARS},\n{s.POS}", f"SELECT ticker, session, {s.ema('close', 9)} AS ema_9, {s.ema('close', 26, 400)} AS ema_26 FROM pb", 3)
def _(spark, d):
    one = scans.add_ema_scan(src.bars(spark, d), "close", 9, "ema_9")
    return scans.add_ema_scan(one, "close", 26, "ema_26").select("ticker", "session", "ema_9", "ema_26")


@query("macd_scan", f"{s.BARS},\n{s.POS},\nm AS (SELECT *, {s.ema('close', 12)} - {s.ema('close', 26, 400)} AS macd FROM pb),\nm2 AS (SELECT *, {s.ema('macd', 9)} AS macd_signal FROM m)", "SELECT ticker, session, macd, macd_signal, macd - macd_signal AS macd_hist FROM m2", 3)
def _(spark, d):
    return scans.add_macd_scan(src.bars(spark, d)).select("ticker", "session", "macd", "macd_signal", "macd_hist")


_COOLDOWNS = (1, 5, 20, 60)
WITHOUT += ["cooldown_grid"]


@query("cooldown_grid", ",\n".join([s.BASE] + [s.kept("return_3d < -0.03", k, f"k{k}") for k in _COOLDOWNS]), " UNION ALL ".join(f"SELECT ticker, pos, {k} AS cooldown FROM k{k}" for k in _COOLDOWNS))
def _(spark, d):
    """The events of one rule under several cooldowns."""
    f = base(spark, d)
    return events.cooldowns(f.where(events.event_mask(f, [events.Rule("return_3d", "<", -0.03)])).select("ticker", "pos"), _COOLDOWNS)


# --- a study with a declared series -------------------------------------------------------

_RATED = """rated AS (SELECT *, CASE WHEN starts_with(ticker, '1') THEN last_value(ccl IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) ELSE 1.0::DOUBLE END AS rate FROM bars0 LEFT JOIN fx USING (session)),
bars AS (SELECT ticker, session, open / rate AS open, high / rate AS high, low / rate AS low, close / rate AS close, volume FROM rated WHERE rate IS NOT NULL),
bench AS (SELECT session, open / rate AS open, high / rate AS high, low / rate AS low, close / rate AS close, volume FROM (SELECT bench0.*, last_value(ccl IGNORE NULLS) OVER (ORDER BY session ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rate FROM bench0 LEFT JOIN fx USING (session)) WHERE rate IS NOT NULL),
tna AS (SELECT l_shipdate::DATE AS session, sum(round(l_discount * 100)::BIGINT) / count(*) AS caucion_tna FROM lineitem WHERE day(l_shipdate) % 5 <> 0 GROUP BY 1)"""
_CARRY = ",\n".join([s.BARS.replace("bars AS", "bars0 AS", 1), s.FX, s.BENCH.replace("bench AS", "bench0 AS", 1), _RATED, s.POS, s.FEATURES, s.REGIMES, s.kept("(SELECT caucion_tna FROM tna WHERE tna.session = feat.session) > 5.2 AND return_20d > 0 AND NOT starts_with(ticker, '5')", 10), s.trades(), s.BOUNDS.replace("FROM bars)", "FROM (SELECT session FROM bars UNION SELECT session FROM bench))"), s.CANON])
CARRY = {
    "experiment": {"id": "carry"}, "event": {"conditions": [{"feature": "caucion_tna", "operator": ">", "value": 5.2}, {"feature": "return_20d", "operator": ">", "value": 0.0}], "cooldown_sessions": 10, "forward_horizons": list(s.HORIZONS)},
    "validation": {"discovery_pct": 60, "validation_pct": 20, "holdout_pct": 20},
}


@query("experiment_carry", _CARRY, "SELECT ticker, signal_date, horizon, entry_date, exit_date, trend_regime, forward_return, net_return_pct, temporal_split FROM canon", 4)
def _(spark, d):
    """A condition on a rate that is no ticker's, with gaps; the benchmark in base currency as well; doubled bars at ingest."""
    bars = src.bars(spark, d).withColumn("seq", F.lit(1))
    late = bars.where(F.dayofmonth("session") % 3 == 0).withColumns({"close": F.col("close") * 3, "seq": F.lit(2)})
    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("session", F.to_date("l_shipdate"))
    tna = li.where(F.dayofmonth("session") % 5 != 0).groupBy("session").agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*")).alias("caucion_tna"))
    universe = bars.select("ticker", F.when(F.col("ticker").startswith("5"), "reference").otherwise("target").alias("role")).distinct()
    study = run(spark, Experiment.from_config(CARRY), late.unionByName(bars), src.benchmark(spark, d), market(), fx=src.fx_rates(spark, d), local=F.col("ticker").startswith("1"), bench_local=True, targets=universe, series=tna, first_by="seq")
    return study.canonical.select("ticker", "signal_date", "horizon", "entry_date", "exit_date", "trend_regime", "forward_return", "net_return_pct", "temporal_split")


# --- contracts ------------------------------------------------------------------------------

#: Every order is a trade of its root's contract of this month or one of the next two.
_CONTRACTS = f"""legs AS (SELECT *, (o_orderdate::DATE - (day(o_orderdate::DATE) - 1)::INTEGER) + to_months((o_orderkey % 3)::INTEGER) AS m FROM orders),
cbars AS (SELECT o_orderpriority AS root, o_orderpriority || '/' || {list(rolls.MONTHS)}[month(m)] || strftime(m, '%y') AS symbol, last_day(m)::DATE AS l, o_orderdate::DATE AS session, {s.OHLC} FROM legs WHERE m >= DATE '2000-01-01' GROUP BY ALL),
con AS (SELECT DISTINCT root, symbol, l - CASE dayofweek(l) WHEN 0 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS expiry, CASE WHEN starts_with(root, '1') THEN 100.0::DOUBLE ELSE 10.0::DOUBLE END AS multiplier FROM cbars),
cal AS (SELECT *, (expiry - 5)::DATE AS e, lead(symbol) OVER (PARTITION BY root ORDER BY expiry) AS nxt, lag((expiry - 5)::DATE) OVER (PARTITION BY root ORDER BY expiry) + 1 AS st FROM con),
rat AS (SELECT cal.symbol, arg_max(b.close / a.close, a.session) AS ratio FROM cal JOIN cbars a ON a.symbol = cal.symbol AND a.session BETWEEN e - 30 AND e JOIN cbars b ON b.symbol = nxt AND b.session = a.session GROUP BY 1),
fac AS (SELECT cal.*, product(coalesce(ratio, 1.0::DOUBLE)) OVER w AS factor, max((ratio IS NULL AND nxt IS NOT NULL)::INT) OVER w = 0 AS joined FROM cal LEFT JOIN rat USING (symbol) WINDOW w AS (PARTITION BY root ORDER BY expiry DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
st AS (SELECT cbars.root, session, cbars.symbol, open, high, low, close, volume, close * multiplier AS notional, ln(factor) AS log_factor, joined, close * factor AS c FROM cbars JOIN fac USING (symbol) WHERE (st IS NULL OR session >= st) AND session <= e)"""


@query("contract_roll", _CONTRACTS, "SELECT root, session, symbol, open, high, low, close, volume, notional, joined, log_factor, ln(c / lag(c) OVER (PARTITION BY root ORDER BY session)) AS log_return FROM st", exact="root joined")
def _(spark, d):
    """The stitched series of every root, with the logarithms of its factors and adjusted returns."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    m = F.add_months(F.trunc(F.to_date("o_orderdate"), "month"), (F.col("o_orderkey") % 3).cast("int"))
    code = F.element_at(F.array(*map(F.lit, rolls.MONTHS)), F.month(m))
    symbol = F.concat("o_orderpriority", F.lit("/"), code, F.date_format(m, "yy"))
    bars = src._ohlc(o.where(m >= F.lit("2000-01-01").cast("date")).groupBy(symbol.alias("symbol"), F.to_date("o_orderdate").alias("session")))
    contracts = bars.select("symbol", F.when(F.col("symbol").startswith("1"), 100.0).otherwise(10.0).alias("multiplier"))
    out = rolls.stitched(bars, rolls.roll_calendar(contracts))
    back = F.lag("close_adj").over(W.partitionBy("root").orderBy("session"))
    return out.select("root", "session", "symbol", "open", "high", "low", "close", "volume", "notional", "joined", F.log("factor").alias("log_factor"), F.log(F.col("close_adj") / back).alias("log_return"))


# --- currencies -----------------------------------------------------------------------------

#: Quoted: USD in ARS (with gaps), USD in EUR by two listings on some days, EUR in ARS on few; carried two sessions.
_ROUTES = f"""{s.BARS},
{s.FX},
sess AS (SELECT DISTINCT session FROM bars),
quotes AS (
  SELECT session, 'USD' AS base, 'ARS' AS quote, ccl AS rate FROM fx WHERE ccl > 0
  UNION ALL SELECT a.session, 'USD', 'EUR', b.close / (a.close * 4) FROM bars a JOIN bars b USING (session) WHERE a.ticker = '2-HIGH' AND b.ticker = '3-MEDIUM' AND day(session) % 6 = 0 AND b.close > 0 AND a.close > 0
  UNION ALL SELECT session, 'EUR', 'ARS', 2 * ccl FROM fx WHERE ccl > 0 AND day(session) % 10 = 1),
every AS (SELECT sess.session, base, quote, last_value(rate IGNORE NULLS) OVER (PARTITION BY base, quote ORDER BY sess.session ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rate
  FROM sess CROSS JOIN (SELECT DISTINCT base, quote FROM quotes) LEFT JOIN quotes USING (session, base, quote)),
edges AS (SELECT session, base AS a, quote AS b, rate FROM every WHERE rate IS NOT NULL UNION ALL SELECT session, quote, base, 1 / rate FROM every WHERE rate IS NOT NULL),
walk AS (
  SELECT session, o AS origin, o AS currency, 1.0::DOUBLE AS rate, 0 AS n_hops, o AS route FROM sess, (SELECT unnest(['ARS', 'EUR', 'USD']) AS o)
  UNION ALL SELECT walk.session, origin, b, walk.rate * edges.rate, n_hops + 1, route || '>' || b FROM walk JOIN edges ON edges.session = walk.session AND a = currency WHERE n_hops < 3 AND NOT contains(route, b))"""


@query("currency_routes", _ROUTES, "SELECT session, origin, currency, arg_min(rate, {'n': n_hops, 'r': route}) AS rate, min(n_hops)::INTEGER AS n_hops, arg_min(route, {'n': n_hops, 'r': route}) AS route FROM walk GROUP BY session, origin, currency", 8, exact="origin currency route n_hops")
def _(spark, d):
    bars, fx = src.bars(spark, d), src.fx_rates(spark, d).where("ccl > 0")
    pair = lambda df, a, b, x: df.select("session", F.lit(a).alias("base"), F.lit(b).alias("quote"), x.alias("rate"))
    adr = routes.listing_quotes(bars.where("ticker = '2-HIGH'"), bars.where("ticker = '3-MEDIUM'"), "USD", "EUR", 4.0)
    quotes = pair(fx, "USD", "ARS", F.col("ccl")).unionByName(adr.where(F.dayofmonth("session") % 6 == 0))
    quotes = quotes.unionByName(pair(fx.where(F.dayofmonth("session") % 10 == 1), "EUR", "ARS", 2 * F.col("ccl")))
    return routes.routes(quotes, bars, ["ARS", "EUR", "USD"], carry=2, hops=3)
