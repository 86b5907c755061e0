"""The event-study engine on hand-made rows; numbers are worked out by hand or by plain Python."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.functions import features as ft
from eventide.operators import baselines, costs, decision, events, fx, ledger, metrics, quality, regimes, robustness, splits, trades
from eventide.operators import ticks as tk
from eventide.plans.experiment import Experiment, run, verdict
from eventide.plans.semantics import Semantics
from eventide.sources import market

DAY = date(2020, 1, 1)


def bars(spark, closes, ticker="A", opens=None, highs=None, lows=None, volume=1.0):
    opens, highs, lows = opens or closes, highs or closes, lows or closes
    rows = [(ticker, DAY + timedelta(days=i), o, h, lo, c, volume) for i, (o, h, lo, c) in enumerate(zip(opens, highs, lows, closes))]
    return spark.createDataFrame(rows, "ticker string, session date, open double, high double, low double, close double, volume double")


def column(df, c, *order):
    return [r[c] for r in df.orderBy(*(order or ("ticker", "session"))).collect()]


def walk(n, seed=0):
    rng = np.random.default_rng(seed)
    return [float(x) for x in 100 * np.exp(np.cumsum(rng.normal(0.001, 0.02, n)))]


# --- features ----------------------------------------------------------------------


def test_warm_up_and_names(spark):
    f = ft.add_features(ft.add_positions(bars(spark, walk(260), highs=[x * 1.01 for x in walk(260)], lows=[x * 0.99 for x in walk(260)])))
    first = {c: next((i for i, x in enumerate(column(f, c)) if x is not None), None) for c in ("sma_200", "sma_200_slope", "rsi_14", "atr_14", "atr_percentile_60d", "return_3d_zscore", "return_60d")}
    assert first == {"sma_200": 199, "sma_200_slope": 219, "rsi_14": 14, "atr_14": 13, "atr_percentile_60d": 73, "return_3d_zscore": 62, "return_60d": 60}
    assert column(f, "close_breaks_high_20d")[:20] == [0.0] * 20 and set(column(f, "close_above_sma_200")[:199]) == {0.0}
    assert all(0 <= x <= 100 for x in column(f, "rsi_14") if x is not None) and all(x <= 0 for x in column(f, "distance_to_high_60d") if x is not None)


def test_prefix_invariance(spark):
    """A feature does not change when later rows are dropped."""
    x = walk(120, 3)
    whole, part = (ft.add_features(ft.add_positions(bars(spark, y))) for y in (x, x[:100]))
    for c in ("rsi_14", "sma_20", "bb_pct_b", "return_3d_zscore", "consecutive_down"):
        assert column(whole, c)[:100] == column(part, c)


def test_padded_returns_and_rsi_without_losses(spark):
    df = spark.createDataFrame([("A", DAY + timedelta(days=i), x) for i, x in enumerate([1.0, None, 3.0, 6.0])], "ticker string, session date, close double")
    assert column(ft.add_features(df, high="close", low="close"), "return_1d") == [None, 0.0, 2.0, 1.0]
    assert column(ft.add_rsi(bars(spark, [float(i) for i in range(1, 20)])), "rsi_14")[-1] is None


def test_runs_rank_and_ema(spark):
    x = [5.0, 4.0, 3.0, 4.0, 3.0, 3.0, 2.0]
    assert column(ft.add_down_runs(bars(spark, x)), "consecutive_down") == [0, 1, 2, 0, 1, 0, 1]
    b = bars(spark, [1.0, 2.0, 3.0, 2.5, 3.0]).withColumn("r", ft.percentile_rank(F.col("close"), 3))
    assert column(b, "r") == [None, None, None, 2 / 3, 2 / 3]
    y, want = walk(300), []
    for v in y:
        want.append(v if not want else want[-1] * 0.8 + v * 0.2)
    assert np.allclose(column(ft.add_ema(bars(spark, y), "close", 9, "e"), "e"), want, rtol=1e-12)


def test_macd(spark):
    f = ft.add_macd(bars(spark, walk(80)))
    assert all(abs(r["macd"] - r["macd_signal"] - r["macd_hist"]) < 1e-9 for r in f.collect())


# --- events --------------------------------------------------------------------------


@pytest.mark.parametrize(("op", "want"), [(">", [False, True, False]), ("<", [True, False, False]), (">=", [False, True, False]), ("<=", [True, False, False]), ("==", [False, False, False]), ("!=", [True, True, True])])
def test_operators_on_missing_values(spark, op, want):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, None)], "i int, x double")
    assert [r["m"] for r in df.withColumn("m", events.compile_rule(events.Rule("x", op, 2.0))).orderBy("i").collect()] == want


def test_rule_forms(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    n = lambda c: df.where(events.event_mask(df, c)).count()
    assert n([]) == 2 and n([{"feature": "x", "operator": ">", "value": 2}]) == 1 and n({"x": {"operator": ">", "value": 2}, "y": 3}) == 1
    assert n([{"feature": "nope", "operator": ">", "value": 2}]) == 0 and n([{"operator": ">"}]) == 0 and n("junk") == 0
    with pytest.raises(ValueError):
        events.compile_rule(events.Rule("x", "~", 1))
    assert events.range_errors([{"feature": "atr_percentile_60d", "operator": "<", "value": 1.3}]) and not events.range_errors([{"feature": "atr_percentile_60d", "operator": "<", "value": 0.3}, {"feature": "other", "operator": "<", "value": 1e9}])


def greedy(pos, k):
    out = []
    for p in sorted(pos):
        if not out or p - out[-1] > k:
            out.append(p)
    return out


def test_cooldown(spark):
    rnd = random.Random(1)
    cases = {"chain": [0, 10, 20, 30], "gap": [0, 20, 41], **{f"r{i}": rnd.sample(range(400), 60) for i in range(6)}}
    df = spark.createDataFrame([(t, p) for t, ps in cases.items() for p in ps], "ticker string, pos int")
    got = {}
    for r in events.cooldown(df, 20).collect():
        got.setdefault(r["ticker"], []).append(r["pos"])
    assert {t: sorted(p) for t, p in got.items()} == {t: greedy(p, 20) for t, p in cases.items()} and sorted(got["chain"]) == [0, 30]
    mask = [True, True, False, False, True, False, False, False, True, True]
    assert sorted(r["pos"] for r in events.cooldown(spark.createDataFrame([("A", i) for i, m in enumerate(mask) if m], "ticker string, pos int"), 3).collect()) == [0, 4, 8]


def test_detect_overlap_grid_recent(spark):
    df = ft.add_positions(bars(spark, [1.0, 5.0, 5.0, 1.0, 5.0]).unionByName(bars(spark, [5.0, 1.0], "B")))
    rule = [events.Rule("close", ">", 2.0)]
    assert sorted((r["ticker"], r["pos"]) for r in events.detect(df, rule, 1).collect()) == [("A", 1), ("A", 4), ("B", 0)]
    assert {r["ticker"] for r in events.detect(df, rule, 1, min_events=2).collect()} == {"A"}
    o = {r["ticker"]: (r["n_raw"], r["n_kept"]) for r in events.overlap(df, rule, 1).collect()}
    assert o == {"A": (3, 2), "B": (1, 1)}
    g = {r["cell"]: (r["n_signals"], r["n_events"]) for r in events.grid(df, [("a", rule), ("b", [events.Rule("close", ">", 0.0)])], 1).collect()}
    assert g == {"a": (4, 3), "b": (7, 4)}
    assert events.recent(df, F.lit(DAY + timedelta(days=10)), 7).count() == 2
    u = spark.createDataFrame([("A", "target"), ("B", "reference")], "ticker string, role string")
    assert {r["ticker"] for r in events.targets_only(df, u).collect()} == {"A"}


# --- currency, regimes -----------------------------------------------------------------


def test_bounded_carry(spark):
    b = bars(spark, [10.0] * 14)
    rates = spark.createDataFrame([(DAY + timedelta(days=i), 2.0) for i in (1, 2, 9)], "session date, ccl double")
    out = fx.with_rate(b, rates)
    assert column(out, "session", "session") == [DAY + timedelta(days=i) for i in (1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13)]
    gaps = fx.rate_gaps(b, rates).first()
    assert (gaps["n_direct"], gaps["n_filled"], gaps["n_dropped"]) == (3, 9, 2)
    usd = fx.in_base(b.withColumn("ticker", F.lit("X.BA")).unionByName(b), rates)
    assert {(r["ticker"], r["close_usd"]) for r in usd.collect()} == {("X.BA", 5.0), ("A", 10.0)} and usd.where("ticker = 'A'").count() == 14


def test_as_of_keeps_null_prices(spark):
    bench = spark.createDataFrame([(DAY + timedelta(days=1), 7.0), (DAY + timedelta(days=3), None)], "session date, close double")
    assert column(regimes.as_of(bars(spark, [1.0] * 5), bench), "bench") == [None, 7.0, 7.0, None, None]


def test_regimes(spark):
    df = spark.createDataFrame([(2.0, 1.0, 0.1, 0.1), (1.0, 2.0, -0.1, 0.9), (2.0, 1.0, -0.1, 0.5), (2.0, None, None, None)], "p double, s double, k double, v double")
    r = df.select(regimes.trend_regime(F.col("p"), F.col("s"), F.col("k")).alias("t"), regimes.vol_regime(F.col("v")).alias("v")).collect()
    assert [tuple(x) for x in r] == [("BULL", "LOW_VOL"), ("BEAR", "HIGH_VOL"), ("NEUTRAL", "NORMAL_VOL"), ("NEUTRAL", "NORMAL_VOL")]


# --- trades, costs, splits ---------------------------------------------------------------


def test_forward_returns(spark):
    b = bars(spark, [100.0, 110.0, 121.0, 133.1])
    for h, want in ((1, [10, 10, 10, None]), (2, [21, 21, None, None])):
        got = column(b.withColumn("r", trades.forward_return(F.col("close"), h)), "r")
        assert [x if x is None else round(x, 9) for x in got] == want


def test_trades_next_open(spark):
    b = ft.add_positions(bars(spark, [10.0, 12.0, 11.0, 13.0], opens=[1.0, 10.0, 0.0, 1.0], highs=[10.0, 15.0, 15.0, 13.0], lows=[10.0, 8.0, 9.0, 8.0]))
    t = {(r["signal_date"], r["horizon"]): r for r in trades.trades(trades.with_outcomes(b, (1, 3))).collect()}
    assert set(t) == {(DAY, 1), (DAY, 3), (DAY + timedelta(days=2), 1)}
    r = t[DAY, 3]
    assert r["entry_price"] == 10 and round(r["forward_return"], 9) == 30 and round(r["mfe"], 9) == 50 and round(r["mae"], 9) == -20
    assert r["mfe_date"] == DAY + timedelta(days=1) and r["mae_date"] == DAY + timedelta(days=1) and r["exit_date"] == DAY + timedelta(days=3)
    s = trades.trades(trades.with_outcomes(b, (1,), entry_mode="signal_close")).orderBy("signal_date").first()
    assert s["entry_price"] == 10.0 and round(s["forward_return"], 9) == 20


def test_costs(spark):
    one = {"argentina": (0.007, 0.0008, 0.002, 0.015)}
    assert abs(costs.roundtrip(one, "argentina") - 0.0196) < 1e-12 and costs.roundtrip(one, "moon") == costs.roundtrip(one, "argentina")
    assert costs.roundtrip({"argentina": (0.001, 0, 0, 0.015)}) == 0.015
    r = spark.createDataFrame([(5.0, 2.5)], "g double, b double").select(costs.net(F.col("g"), F.lit(0.0196)).alias("n"), costs.break_even(F.col("g"), F.col("b")).alias("e"), costs.break_even(F.col("b"), F.col("g")).alias("z")).first()
    assert round(r["n"], 9) == 3.04 and r["e"] == 2.5 and r["z"] == 0.0
    assert {x["market"]: round(x["roundtrip"], 6) for x in costs.cost_table(spark).collect()} == {"argentina": 0.0196, "futures": 0.0046, "usa": 0.0042}


def test_splits(spark):
    d = [DAY + timedelta(days=i) for i in range(10)]
    df = spark.createDataFrame([(x,) for x in d + d], "session date")
    b = splits.boundaries(df)
    assert tuple(b.first()) == (d[5], d[7], d[9])
    t = spark.createDataFrame([(d[0], d[1], d[5]), (d[4], d[5], d[6]), (d[6], d[7], d[7]), (d[8], d[8], d[9]), (d[8], None, d[9])], "signal_date date, entry_date date, exit_date date")
    assert [r["s"] for r in t.join(b).withColumn("s", splits.split_label()).orderBy("signal_date", F.col("entry_date").desc()).collect()] == ["discovery", "boundary_crossing", "validation", "holdout", "boundary_crossing"]
    with pytest.raises(ValueError):
        splits.boundaries(df, 0.5, 0.2, 0.2)


def test_walk_forward(spark):
    d = [DAY + timedelta(days=i) for i in range(800)]
    want = splits.walk_forward(d[0], d[-1], len(d), 2, 1.0)
    got = splits.walk_forward_windows(spark.createDataFrame([(x,) for x in d], "session date"), 2, 1.0).orderBy("name").collect()
    assert want and [r.asDict() for r in got] == want and splits.walk_forward(d[0], d[9], 10) == []
    assert splits.holdout_intact([]) and not splits.holdout_intact([{"event": "holdout_opened", "at": "1"}, {"event": "parameters_changed", "at": "2"}])


# --- baselines, metrics, robustness --------------------------------------------------------


def test_exclusion_window(spark):
    n, k, h, hits = 60, 5, 3, [0, 20, 24, 58]
    b = ft.add_positions(bars(spark, [1.0] * n))
    m = baselines.mark_neighbours(b, F.col("pos").isin(hits)).withColumn("x", baselines.excluded(k, F.lit(h)))
    assert column(m, "x") == [any(e - k <= p < e + k + h for e in hits) for p in range(n)]


@pytest.mark.parametrize(("n", "want"), [(0, "INSUFFICIENT"), (4, "INSUFFICIENT"), (5, "LOW_CONFIDENCE"), (19, "LOW_CONFIDENCE"), (20, "VALID")])
def test_pool_status(spark, n, want):
    assert spark.range(1).select(baselines.status(F.lit(n))).first()[0] == want


def trade_rows(spark, rows):
    return spark.createDataFrame([(t, d, 5, float(x), float(x), 1.0, -1.0) for t, d, x in rows], "ticker string, signal_date date, horizon int, forward_return double, net_return_pct double, mfe double, mae double")


def test_metrics(spark):
    d = [DAY + timedelta(days=400 * i) for i in range(4)]
    t = trade_rows(spark, [("A", d[0], 10), ("A", d[1], -5), ("B", d[2], 0), ("B", d[3], 5)])
    m = metrics.by(t, "horizon").first()
    x = np.array([10, -5, 0, 5.0])
    assert (m["n_events"], m["mean"], m["median"], m["win_rate"], m["profit_factor"], m["avg_loss"]) == (4, 2.5, 2.5, 0.5, 3.0, -2.5)
    assert abs(m["std"] - x.std(ddof=1)) < 1e-12 and abs(m["p25"] - np.percentile(x, 25)) < 1e-12
    gains = metrics.by(trade_rows(spark, [("A", d[0], 1)]), "horizon").first()
    assert gains["profit_factor"] == 1e10 and gains["std"] is None
    loo = {(r["excluded"], r["n_events"]): r["mean_return"] for r in robustness.leave_one_out(t, "ticker").collect()}
    assert loo == {("A", 2): 2.5, ("B", 2): 2.5}
    c = robustness.concentration(t).first()
    assert (c["best_trade_pct"], c["best_3_pct"], c["best_asset"], c["status"]) == (100.0, 150.0, "B", "OK")
    assert robustness.concentration(trade_rows(spark, [("A", d[0], -3)])).first()["status"] == "NOT_APPLICABLE"
    zero = robustness.concentration(trade_rows(spark, [("A", d[0], 3), ("B", d[0], -3)])).first()
    assert zero["best_asset"] == "—" and zero["best_trade_pct"] == 0.0


def test_bootstrap(spark):
    t = trade_rows(spark, [("A", DAY + timedelta(days=i), x) for i, x in enumerate(np.random.default_rng(1).normal(1, 2, 50))])
    b = robustness.bootstrap(t, ["horizon"], n=300).first()
    x = [r["net_return_pct"] for r in t.orderBy("ticker", "signal_date").collect()]
    want = robustness.bootstrap_ci(x, 300)
    assert b["ci_lower"] == want["ci_lower"] < b["mean"] < b["ci_upper"] == want["ci_upper"]
    assert robustness.bootstrap_ci([])["mean"] == 0.0


# --- decision ---------------------------------------------------------------------------------


E = decision.Evidence


@pytest.mark.parametrize(
    ("e", "want"),
    [
        (E(10, 1.0, 1.0), "REJECTED"), (E(50, None, None), "REJECTED"), (E(50, -1.0, 1.0), "REJECTED"), (E(100, 3.0, 1.0, validation_median=-1.0), "REJECTED"), (E(100, 3.0, 1.0, holdout_n=9), "REJECTED"),
        (E(100, 3.0, 1.0, coverage_pct=40.0), "RESEARCH"), (E(50, 3.0, 1.0, best_trade_pct=30.0), "RESEARCH"), (E(100, 3.0, 1.0, ci_lower=-1.0, ci_upper=1.0, best_trade_pct=5.0), "RESEARCH"), (E(100, 1.0, 1.0, best_trade_pct=5.0, cost_pct=1.0), "RESEARCH"),
        (E(100, 3.0, 1.0, 1.0, 20, 1.0, 20, 90.0, 0.5, 4.0, 5.0, 0.42), "CANDIDATE"),
    ],
)
def test_decision(spark, e, want):
    assert decision.decide(e)[0] == want
    row = spark.createDataFrame([tuple(vars(e).values())], "n_total int, mean double, median double, validation_median double, validation_n int, holdout_median double, holdout_n int, coverage_pct double, ci_lower double, ci_upper double, best_trade_pct double, cost_pct double")
    assert decision.decide_all(row).first()["verdict"] == want


# --- quality, ticks, ledger, sources --------------------------------------------------------------


def test_quality(spark):
    good = bars(spark, walk(200))
    assert quality.quality_issues(good, "2020-01-01", "2020-07-01").where("severity = 'CRITICAL'").count() == 0
    bad = bars(spark, [10.0, -1.0, 10.0]).unionByName(bars(spark, [10.0]))
    got = {r["check"]: r["severity"] for r in quality.quality_issues(bad, "2020-01-01", "2020-12-31").collect()}
    assert got["BAD_PRICES"] == "CRITICAL" and got["DUPLICATE_DATES"] == "WARNING" and got["LOW_COVERAGE"] == "CRITICAL" and "ABNORMAL_JUMP" in got
    expected = spark.createDataFrame([("A",), ("Z",)], "ticker string")
    issues = quality.quality_issues(good, "2020-01-01", "2020-07-01", expected)
    assert [(r["ticker"], r["check"]) for r in issues.where("severity = 'CRITICAL'").collect()] == [("Z", "EMPTY")]
    with pytest.raises(ValueError, match="Z"):
        quality.require_clean(issues)


def test_fills_and_trades(spark):
    t = lambda s: f"2024-01-0{1 + s // 86400} {s % 86400 // 3600:02d}:{s % 3600 // 60:02d}:00"
    rows = [("S", t(0), None, 0.0, None, 1), ("S", t(1800), 9.0, 10.0, 10.0, 2), ("S", t(3600), 9.5, 11.0, 11.0, 3), ("S", t(86400 + 1800), 12.0, 13.0, 12.5, 4), ("S", t(86400 + 7200), 12.0, None, None, 5)]
    ticks = spark.createDataFrame(rows, "symbol string, ts string, bid double, ask double, last double, event_id long").withColumn("ts", F.to_timestamp_ntz("ts"))
    orders = spark.createDataFrame([("S", t(0)), ("S", t(7200)), ("S", t(1800 - 60))], "symbol string, signal_ts string").withColumn("signal_ts", F.to_timestamp_ntz("signal_ts"))
    got = [r["p"] for r in tk.first_quote(orders, ticks, "ask", "signal_ts", 3600, "p", "w").orderBy("signal_ts").collect()]
    assert got == [10.0, 10.0, None]
    edge = spark.createDataFrame([("S", t(0))], "symbol string, signal_ts string").withColumn("signal_ts", F.to_timestamp_ntz("signal_ts"))
    assert tk.first_quote(edge, ticks, "ask", "signal_ts", 1800, "p", "w").first()["p"] == 10.0 and tk.first_quote(edge, ticks, "ask", "signal_ts", 1799, "p", "w").first()["p"] is None
    lt = tk.long_trades(edge, ticks, (1,), 3600).first()
    assert lt["entry_price"] == 10.0 and lt["exit_price"] == 12.0 and round(lt["net_return_pct"], 6) == round(20 - 0.46, 6)
    d = {r["day"].day: r for r in tk.daily_bars(ticks).collect()}
    assert d[1]["open"] == 10.0 and d[1]["close"] == 11.0 and d[1]["n_ticks"] == 2


def test_ledger(spark):
    s = spark.createDataFrame([("A", DAY, "x", 30.0), ("A", DAY, "y", 30.0), ("B", DAY, "x", 0.0), ("C", DAY, "x", 9.0)], "ticker string, signal_date date, signal_type string, price double")
    open_ = spark.createDataFrame([("C", "x", DAY, DAY, 10.0, 5, 100.0)], "ticker string, signal_type string, signal_date date, entry_date date, entry_price double, quantity long, position_usd double")
    new = ledger.entries(s, open_, 3, 100.0).orderBy("ticker").collect()
    assert [(r["ticker"], r["quantity"]) for r in new] == [("A", 3), ("B", 1)] and ledger.entries(s, open_, 2, 100.0).count() == 1
    out = ledger.exits(open_, bars(spark, [10.0, 11.0], "C"), F.lit(DAY + timedelta(days=10)), 10, 0.01).first()
    assert round(out["pnl_pct"], 9) == 9.0 and out["pnl_usd"] == 9.0
    assert ledger.exits(open_, bars(spark, [10.0], "C"), F.lit(DAY + timedelta(days=9)), 10, 0.01).count() == 0


def test_sources(spark, tmp_path):
    b = bars(spark, [1.0, 2.0])
    assert column(market.top_up(b, b.limit(1).withColumn("close", F.lit(9.0))), "close") == [9.0, 2.0]
    raw = spark.createDataFrame([("A", "2020-01-01", "1.5", "x", "NaN", "2", "3")], "Ticker string, Date string, Open string, High string, Low string, Close string, Volume string")
    r = market.normalise_daily(raw).first()
    assert (r["open"], r["high"], r["low"], r["adj_close"]) == (1.5, None, None, 2.0)
    m = market.cache_manifest(b, "test", DAY, DAY)
    assert market.cache_valid(m, b, "test", DAY, DAY) == (True, "") and market.cache_valid(m, b.limit(1), "test", DAY, DAY)[1] == "content" and market.cache_valid(m, b, "other", DAY, DAY)[1] == "source" and market.cache_valid(None, b, "test", DAY, DAY)[0] is False
    line = spark.createDataFrame([('{"symbol":"S/1","trades":[{"datetime":"2024-01-01 10:00:00","price":1.5,"size":2,"side":"B"},{"datetime":"junk","price":1,"size":1,"side":"S"}]}',)], "value string")
    t = market.landed_trades(line).orderBy("buy_or_sell").collect()
    assert t[0]["price"] == 1.5 and t[1]["trade_date"] is None
    for fmt in ("csv", "parquet", "orc", "json"):
        p = str(tmp_path / fmt)
        df = market.adjusted(b).select("ticker", "session", "open", "high", "low", "close", "adj_close", "volume")
        df.write.option("header", True).format(fmt).save(p)
        assert sorted(map(tuple, market.read_bars(spark, p, fmt).collect())) == sorted(map(tuple, df.collect()))
    assert market.adjusted(b).where("open_adj = open").count() == 2


# --- whole experiments and streams ------------------------------------------------------------------


def test_experiment(spark, sf, tmp_path):
    p = tmp_path / "e.yaml"
    p.write_text("id: demo\nconditions:\n  - {feature: return_60d, operator: '>', value: 0.1}\n  - {feature: return_3d, operator: '<', value: -0.03}\ncooldown_sessions: 20\nhorizons: [1, 5]\nresearch: {primary_horizon: 5}\n")
    e = Experiment.from_yaml(str(p))
    study = run(spark, e, market.bars(spark, sf), market.benchmark(spark, sf), F.lit("usa"))
    tables = study.tables()
    assert study.enriched.count() == study.canonical.count() > 0 and tables["metrics"].count() == 2 and tables["loo_asset"].count() > 0
    assert verdict(study, e, 0.42)[0] in ("REJECTED", "RESEARCH", "CANDIDATE")
    less = run(spark, Experiment("x", e.conditions, 20, (1,), semantics=Semantics(embargo_sessions=10, edge_without_controls=False)), market.bars(spark, sf), None, F.lit("usa"))
    assert less.enriched.where("matched_baseline_status = 'INSUFFICIENT' and incremental_edge_net is not null").count() == 0


def test_report_files(spark, sf, tmp_path):
    from eventide.plans import report

    e = Experiment("demo", [events.Rule("return_60d", ">", 0.1)], 20, (5,), 5)
    study = run(spark, e, market.bars(spark, sf), market.benchmark(spark, sf), F.lit("usa"))
    report.write(e, study, ("RESEARCH", "because"), str(tmp_path / "out"), {"event": "x"})
    text = (tmp_path / "out" / "summary.md").read_text()
    assert text.startswith("# demo") and "| 5 | " in text and (tmp_path / "out" / "metadata.json").exists()
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "canonical_trades")).count() == study.enriched.count()
    (tmp_path / "a.yaml").write_text("id: a\nconditions: []\n")
    assert [c["id"] for c in report.catalogue(str(tmp_path))] == ["a"] and report.number(None) == "—"


def test_futures_and_paper_runs(spark, sf):
    from eventide.plans import futures, paper

    ticks = market.ticks(spark, sf)
    days = [r[0] for r in ticks.select(F.to_date("ts")).distinct().orderBy(F.to_date("ts")).limit(3).collect()]
    signals = spark.createDataFrame([("A", d) for d in days] + [("A", date(1999, 1, 1))], "ticker string, session date")
    t, s = futures.run(signals, ticks, "click", (1, 3))
    assert 0 < t.count() <= 6 and s.where("n > 0").count() == s.count() > 0
    f = ft.add_positions(bars(spark, [1.0, 2.0, 3.0])).withColumn("x", F.col("close"))
    none = spark.createDataFrame([], "ticker string, signal_type string, signal_date date, entry_date date, entry_price double, quantity long, position_usd double")
    new, old = paper.day(none, f, {"up": [events.Rule("x", ">", 1.5)], "no": [events.Rule("nope", ">", 1.5)]}, F.lit(DAY + timedelta(days=3)), 5, 100.0, 10, 0.01)
    assert [(r["ticker"], r["signal_type"], r["quantity"]) for r in new.collect()] == [("A", "up", 50)] and old.count() == 0
    assert costs.summarise()["roundtrip_pct"] == 1.96
    rates = spark.createDataFrame([(DAY, 1.0), (DAY + timedelta(days=1), 1.1)], "session date, ccl double")
    assert [x if x is None else round(x, 9) for x in column(ft.with_series(f, ft.add_rate_returns(rates), ["ccl_return_1d"]), "ccl_return_1d")] == [None, 0.1, None]


def test_stream_matches_batch(spark, sf):
    from eventide.streaming.streams import replay_daily_bars

    cols = ["symbol", "day", "open", "high", "low", "close", "n_ticks"]
    events_ = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("last"), "event_id", F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask"))
    batch = {tuple(r) for r in tk.daily_bars(events_).select(*cols).collect()}
    stream = {tuple(r) for r in replay_daily_bars(spark, f"{sf}/events.parquet").select(*cols).collect()}
    assert stream <= batch and len(stream) > 0.8 * len(batch)


def test_stream_cooldown(spark, tmp_path):
    from eventide.streaming import streams

    rnd = random.Random(3)
    pos = sorted(rnd.sample(range(300), 80))
    for i, part in enumerate((pos[:30], pos[30:60], pos[60:])):
        spark.createDataFrame([("A", p) for p in part], "ticker string, pos long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ticker string, pos long").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    out = streams.drain(streams.cooldown(s, 15), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["pos"] for r in out.collect()) == greedy(pos, 15)


def test_entry_registers_everything():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70 and {"horizon_metrics", "cooldown", "bootstrap_hash"} <= set(o)
