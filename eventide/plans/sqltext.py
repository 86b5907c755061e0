"""Common table expressions of the DuckDB oracles."""

from __future__ import annotations

HORIZONS = (1, 3, 5, 10, 20)
BY = "PARTITION BY ticker ORDER BY session"


def rows(n: int, last: int = 0) -> str:
    end = "CURRENT ROW" if last == 0 else f"{last} PRECEDING"
    return f"({BY} ROWS BETWEEN {n - 1 + last} PRECEDING AND {end})"


def full(x: str, n: int, agg: str, last: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n, last)} = {n} THEN {agg}({x}) OVER {rows(n, last)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({BY})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({BY})"


OHLC = "arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume"
BARS = f"bars AS (SELECT o_orderpriority AS ticker, o_orderdate::DATE AS session, {OHLC} FROM orders GROUP BY 1, 2)"
BENCH = f"bench AS (SELECT o_orderdate::DATE AS session, {OHLC} FROM orders GROUP BY 1)"
FX = "fx AS (SELECT l_shipdate::DATE AS session, sum((l_extendedprice * 100::DOUBLE)::BIGINT_CENTS) / sum(l_quantity::BIGINT) / 100 AS ccl FROM lineitem WHERE day(l_shipdate) % 7 <> 0 GROUP BY 1)".replace("(l_extendedprice * 100::DOUBLE)::BIGINT_CENTS", "trunc(l_extendedprice * 100::DOUBLE)::BIGINT::DOUBLE")
TICKS = "ticks AS (SELECT event_type AS symbol, ts, CASE WHEN event_id % 7 <> 5 THEN value * 0.999::DOUBLE END AS bid, CASE WHEN event_id % 7 <> 2 THEN value * 1.001::DOUBLE END AS ask, CASE WHEN event_id % 7 <> 3 THEN value END AS last, event_id FROM events)"
POS = f"pb AS (SELECT *, (row_number() OVER ({BY}) - 1)::INTEGER AS pos, (count(*) OVER (PARTITION BY ticker))::INTEGER AS n_sessions FROM bars)"


def ema(x: str, span: int, window: int = 250) -> str:
    a = 2.0 / (span + 1)
    return f"list_reduce(list({x}) OVER {rows(window)}, lambda y, v: y * (1 - {a!r}::DOUBLE) + v * {a!r}::DOUBLE)"


_RET = ", ".join(f"close / {lag('close', n)} - 1 AS return_{n}d" for n in (1, 3, 5, 10, 20, 60))
_SMA = ", ".join(f"{full('close', n, 'avg')} AS sma_{n}" for n in (20, 60, 200))
_BB = f"({full('close', 20, 'avg')})", f"({full('close', 20, 'stddev_samp')})"
_TOP = f"({full('high', 60, 'max')})"
_RSI = f"({full('greatest(d, 0.0) + d * 0', 14, 'avg')})", f"({full('greatest(-d, 0.0) + d * 0', 14, 'avg')})"
FEATURES = f"""f1 AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr, close - {lag('close')} AS d,
       CASE WHEN close < {lag('close')} THEN 1.0::DOUBLE ELSE 0.0 END AS down FROM pb),
f2 AS (SELECT *, {_SMA}, {_RET}, {full('tr', 14, 'avg')} AS atr_14, (close - {_TOP}) / nullif({_TOP}, 0) AS distance_to_high_60d,
       (close - ({_BB[0]} - 2 * {_BB[1]})) / nullif(4 * {_BB[1]}, 0) AS bb_pct_b,
       CASE WHEN close > ({full('high', 20, 'max', 1)}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS close_breaks_high_20d, (open / {lag('close')} - 1) * 100 AS gap_pct,
       volume / nullif({full('volume', 20, 'avg')}, 0) AS volume_ratio_20d, volume / nullif({full('volume', 50, 'avg')}, 0) AS volume_ratio_50d,
       100 - 100 / (1 + {_RSI[0]} / nullif({_RSI[1]}, 0)) AS rsi_14, sum(1 - down) OVER {rows(1000000)} AS run FROM f1),
f3 AS (SELECT *, CASE WHEN down = 1 THEN sum(down) OVER (PARTITION BY ticker, run ORDER BY session) ELSE 0.0 END AS consecutive_down,
       (close - sma_20) / sma_20 AS dist_sma_20, (close - sma_200) / sma_200 AS dist_sma_200, CASE WHEN close > sma_200 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS close_above_sma_200,
       (sma_200 - {lag('sma_200', 20)}) / 20 AS sma_200_slope, (return_3d - ({full('return_3d', 60, 'avg')})) / nullif({full('return_3d', 60, 'stddev_samp')}, 0) AS return_3d_zscore,
       CASE WHEN atr_14 IS NOT NULL AND count(atr_14) OVER {rows(60, 1)} = 60 THEN len(list_filter(list(atr_14) OVER {rows(60, 1)}, lambda b: b < atr_14)) / 60.0::DOUBLE END AS atr_percentile_60d FROM f2)"""
REGIMES = f"""r1 AS (SELECT f3.*, bench.close AS bp FROM f3 ASOF LEFT JOIN bench ON f3.session >= bench.session),
r2 AS (SELECT *, {full('bp', 200, 'avg')} AS bsma FROM r1),
r3 AS (SELECT *, (bsma - {lag('bsma', 20)}) / 20 AS bslope FROM r2),
feat AS (SELECT *, CASE WHEN bp > bsma AND bslope > 0 THEN 'BULL' WHEN bp < bsma AND bslope < 0 THEN 'BEAR' ELSE 'NEUTRAL' END AS trend_regime,
       CASE WHEN atr_percentile_60d < 0.25 THEN 'LOW_VOL' WHEN atr_percentile_60d > 0.75 THEN 'HIGH_VOL' ELSE 'NORMAL_VOL' END AS vol_regime FROM r3)"""
RULE = "close_above_sma_200 = 1 AND return_60d > 0.10 AND return_3d < -0.03"


def kept(mask: str, k: int, name: str = "kept") -> str:
    return f"""sig_{name} AS (SELECT ticker, pos FROM feat WHERE {mask}),
{name}(ticker, pos) AS (SELECT ticker, min(pos) FROM sig_{name} GROUP BY ticker
  UNION ALL SELECT s.ticker, min(s.pos) FROM {name} k JOIN sig_{name} s ON s.ticker = k.ticker AND s.pos - k.pos > {k} GROUP BY s.ticker, k.pos)"""


def outcome(h: int, mode: str = "next_open") -> str:
    after = f"({BY} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    entry, day = (lead("open"), lead("session")) if mode == "next_open" else ("close", "session")
    return f"""SELECT ticker, session, pos, n_sessions, trend_regime, vol_regime, {h} AS horizon, {day} AS entry_date, {lead('session', h)} AS exit_date, close AS signal_price, {entry} AS entry_price, {lead('close', h)} AS exit_price,
  max({{'x': high, 'k': -pos, 'd': session}}) OVER {after} AS top, min({{'x': low, 'k': pos, 'd': session}}) OVER {after} AS low_ FROM feat"""


def trades(mode: str = "next_open", horizons=HORIZONS) -> str:
    return f"""out AS ({' UNION ALL '.join(outcome(h, mode) for h in horizons)}),
trades AS (SELECT ticker, session AS signal_date, trend_regime, vol_regime, horizon, entry_date, exit_date, signal_price, entry_price, exit_price,
  (exit_price / entry_price - 1) * 100 AS forward_return, (top.x / entry_price - 1) * 100 AS mfe, (low_.x / entry_price - 1) * 100 AS mae, top.d AS mfe_date, low_.d AS mae_date
  FROM out JOIN kept USING (ticker, pos) WHERE pos + horizon < n_sessions AND entry_price <> 0)"""


BOUNDS = """days AS (SELECT d, row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT session AS d FROM bars)),
bounds AS (SELECT max(d) FILTER (rn = greatest(floor(n * 0.6::DOUBLE), 1)) AS discovery_end, max(d) FILTER (rn = greatest(floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE), 1)) AS validation_end, max(d) AS holdout_end FROM days)"""


def period(x: str) -> str:
    return f"CASE WHEN {x} <= discovery_end THEN 'discovery' WHEN {x} <= validation_end THEN 'validation' WHEN {x} <= holdout_end THEN 'holdout' END"


COST = "CASE WHEN starts_with(ticker, '1') THEN 2 * (0.0070::DOUBLE + 0.0008::DOUBLE + 0.0020::DOUBLE) ELSE 2 * (0.0010::DOUBLE + 0.0001::DOUBLE + 0.0010::DOUBLE) END"
CANON = f"""canon AS (SELECT trades.*, CASE WHEN starts_with(ticker, '1') THEN 'argentina' ELSE 'usa' END AS market, {COST} * 100 AS transaction_cost_pct, forward_return - {COST} * 100 AS net_return_pct,
  CASE WHEN {period('signal_date')} = {period('entry_date')} AND {period('entry_date')} = {period('exit_date')} THEN {period('signal_date')} ELSE 'boundary_crossing' END AS temporal_split FROM trades, bounds),
valid AS (SELECT * FROM canon WHERE temporal_split <> 'boundary_crossing')"""
_NEAR = f"near AS (SELECT feat.*, last_value(CASE WHEN k.pos IS NOT NULL THEN feat.pos END IGNORE NULLS) OVER (PARTITION BY feat.ticker ORDER BY feat.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev_, first_value(CASE WHEN k.pos IS NOT NULL THEN feat.pos END IGNORE NULLS) OVER (PARTITION BY feat.ticker ORDER BY feat.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_ FROM feat LEFT JOIN kept k USING (ticker, pos))"
RETURNS = _NEAR + ",\nret AS (" + " UNION ALL ".join(f"SELECT ticker, session, pos, trend_regime, vol_regime, prev_, next_, {h} AS horizon, ({lead('close', h)} / close - 1) * 100 AS ret FROM near" for h in HORIZONS) + "),\nfree AS (SELECT * FROM ret WHERE ret IS NOT NULL AND NOT (coalesce(pos - prev_ < 20 + horizon, false) OR coalesce(next_ - pos <= 20, false)))"
MATCHED = f"""pool AS (SELECT ticker, horizon, trend_regime, vol_regime, avg(ret) AS m, count(*) AS n FROM free GROUP BY ALL),
hz AS (SELECT unnest([{', '.join(map(str, HORIZONS))}]) AS horizon),
matched AS (SELECT e.ticker, hz.horizon, e.session AS event_date, e.trend_regime, e.vol_regime, coalesce(m, 0.0::DOUBLE) AS matched_return, coalesce(n, 0)::BIGINT AS n_controls,
  CASE WHEN coalesce(n, 0) >= 20 THEN 'VALID' WHEN coalesce(n, 0) >= 5 THEN 'LOW_CONFIDENCE' ELSE 'INSUFFICIENT' END AS status
  FROM feat e JOIN kept USING (ticker, pos) CROSS JOIN hz LEFT JOIN pool p ON p.ticker = e.ticker AND p.horizon = hz.horizon AND p.trend_regime = e.trend_regime AND p.vol_regime = e.vol_regime)"""
ALL_BASELINES = """un AS (SELECT ticker, horizon, coalesce(avg(ret), 0.0::DOUBLE) AS unconditional FROM ret GROUP BY ALL),
tpool AS (SELECT ticker, horizon, trend_regime, avg(ret) AS m, count(*) AS n FROM free GROUP BY ALL),
tr AS (SELECT e.ticker, e.horizon, coalesce(avg(m) FILTER (n >= 5), 0.0::DOUBLE) AS trend_only_mean FROM matched e LEFT JOIN tpool p USING (ticker, horizon, trend_regime) GROUP BY ALL),
bret AS (BENCH_RETURNS),
be AS (SELECT e.ticker, e.horizon, avg(b.ret) AS benchmark FROM matched e JOIN bret b ON b.session = e.event_date AND b.horizon = e.horizon GROUP BY ALL),
every AS (SELECT cover.*, coalesce(unconditional, 0.0::DOUBLE) AS unconditional, trend_only_mean, coalesce(benchmark, 0.0::DOUBLE) AS benchmark FROM cover LEFT JOIN un USING (ticker, horizon) JOIN tr USING (ticker, horizon) LEFT JOIN be USING (ticker, horizon))""".replace("BENCH_RETURNS", " UNION ALL ".join(f"SELECT session, {h} AS horizon, (lead(close, {h}) OVER (ORDER BY session) / close - 1) * 100 AS ret FROM bench" for h in HORIZONS))
COVER = """cover AS (SELECT ticker, horizon, count(*)::BIGINT AS n_events, count(*) FILTER (status = 'VALID')::BIGINT AS n_valid, count(*) FILTER (status = 'LOW_CONFIDENCE')::BIGINT AS n_low_confidence, count(*) FILTER (status = 'INSUFFICIENT')::BIGINT AS n_insufficient,
  coalesce(avg(matched_return) FILTER (status <> 'INSUFFICIENT'), 0.0::DOUBLE) AS exact_matched_mean, coalesce(median(matched_return) FILTER (status <> 'INSUFFICIENT'), 0.0::DOUBLE) AS exact_matched_median,
  round(100.0::DOUBLE * count(*) FILTER (status = 'VALID') / count(*), 1) AS valid_pct, round(100.0::DOUBLE * count(*) FILTER (status <> 'INSUFFICIENT') / count(*), 1) AS valid_or_low_pct FROM matched GROUP BY ALL)"""
BASE = ",\n".join([BARS, BENCH, POS, FEATURES, REGIMES])
STUDY = ",\n".join([BASE, kept(RULE, 20), trades(), BOUNDS, CANON])
CONTROL = ",\n".join([STUDY, RETURNS, MATCHED, COVER])


def metrics(keys: str, x: str = "net_return_pct") -> str:
    return f"""{keys}, count({x})::BIGINT AS n_events, avg({x}) AS mean, median({x}) AS median, stddev_samp({x}) AS std, quantile_cont({x}, 0.25::DOUBLE) AS p25, quantile_cont({x}, 0.75::DOUBLE) AS p75,
  avg(({x} > 0)::INT::DOUBLE) AS win_rate, coalesce(avg({x}) FILTER ({x} > 0), 0.0::DOUBLE) AS avg_gain, coalesce(avg({x}) FILTER ({x} <= 0), 0.0::DOUBLE) AS avg_loss, min({x}) AS worst, max({x}) AS best, sum({x}) AS total_return,
  coalesce(sum({x}) FILTER ({x} > 0), 0.0::DOUBLE) / coalesce(abs(sum({x}) FILTER ({x} < 0)), 1e-10::DOUBLE) AS profit_factor, avg(mfe) AS avg_mfe, avg(mae) AS avg_mae"""
