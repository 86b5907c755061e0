"""Whole studies: event files in sections, purged trades, all parts, currency, caches and sources."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventide.operators import events, fx, ledger, robustness, splits
from eventide.plans import report
from eventide.plans.experiment import Experiment, run, verdict
from eventide.plans.semantics import Semantics
from eventide.sources import market

SECTIONS = """
experiment: {id: own_01, family: pullback, description: a test}
event:
  conditions:
    - {feature: return_60d, operator: ">", value: 0.1}
    - {feature: return_3d, operator: "<", value: -0.03}
  cooldown_sessions: 15
  forward_horizons: [1, 5]
validation: {discovery_pct: 50, validation_pct: 30, holdout_pct: 20}
research: {primary_horizon: 5}
"""


@pytest.fixture(scope="module")
def study(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("events")
    (at / "own.yaml").write_text(SECTIONS)
    e = Experiment.from_yaml(str(at / "own.yaml"))
    return e, run(spark, e, market.bars(spark, sf), market.benchmark(spark, sf), F.lit("usa")), at


def test_sections_are_read(study, tmp_path):
    e, s, at = study
    assert (e.event_id, e.cooldown_sessions, e.horizons, e.primary_horizon, e.shares, e.exclusion) == ("own_01", 15, (1, 5), 5, (0.5, 0.3, 0.2), 15)
    assert s.events.count() > 0 and report.catalogue(str(at))[0]["conditions"] == e.conditions
    assert Experiment.from_config({"event": {"conditions": e.conditions}}).horizons == (5,)
    for text in ("experiment: {id: x}\n", "event: {conditions: []}\n"):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ValueError, match="no conditions"):
            Experiment.from_yaml(str(tmp_path / "bad.yaml"))


def test_formal_metrics_leave_crossing_trades_out(study):
    e, s, _ = study
    crossing = s.enriched.where("temporal_split = 'boundary_crossing'").count()
    n = {r["horizon"]: r["n_events"] for r in s.tables()["metrics"].collect()}
    assert sum(n.values()) == s.enriched.count() - crossing == s.formal.count()
    assert verdict(s, e, 0.42)[0] in ("REJECTED", "RESEARCH", "CANDIDATE")


def test_report_has_all_parts(study, tmp_path):
    e, s, _ = study
    tables = report.write(e, s, ("RESEARCH", "because"), str(tmp_path))
    text = (tmp_path / "summary.md").read_text()
    assert all(f"## {x}" in text for x in ("Net metrics", "Gross metrics", "By split", "Baselines", "Bootstrap", "Costs", "Concentration", "Without one asset", "Without one year"))
    found = json.loads((tmp_path / "metrics.json").read_text())
    assert set(found) == {"horizon_1d", "horizon_5d"} and {"metrics", "gross_metrics", "weighted_baseline", "bootstrap", "splits"} <= set(found["horizon_5d"])
    assert {r["test"] for r in tables["robustness"].select("test").distinct().collect()} == {"bootstrap", "gross_bootstrap", "loo_asset", "loo_year", "concentration"}


def test_parts_without_trades_have_rows(spark):
    t = spark.createDataFrame([("A", 1, 2.0), ("A", 1, 4.0), ("B", 1, 6.0)], "ticker string, horizon int, forward_return double")
    parts = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    got = {(r["excluded"], r["horizon"]): (r["n_events"], r["mean_return"]) for r in robustness.leave_one_out(t, "ticker", parts=parts, horizons=(1, 3)).collect()}
    assert got == {("A", 1): (1, 6.0), ("B", 1): (2, 3.0), ("C", 1): (3, 4.0), ("A", 3): (0, 0.0), ("B", 3): (0, 0.0), ("C", 3): (0, 0.0)}


def test_grid_keeps_empty_cells(spark):
    df = spark.createDataFrame([("A", i, dt.date(2024, 1, 1) + dt.timedelta(i), 10.0 + i) for i in range(12)], "ticker string, pos int, session date, close double")
    got = {r["cell"]: r for r in events.grid(df, [("none", [events.Rule("close", ">", 99.0)]), ("some", [events.Rule("close", ">", 12.5)])], 2, "close").collect()}
    assert (got["none"]["n_signals"], got["none"]["n_events"], got["none"]["metric"]) == (0, 0, None)
    want = [((10 + p + 5) / (10 + p) - 1) * 100 for p in (3, 6)]
    assert got["some"]["n_events"] == 3 and abs(got["some"]["metric"] - sum(want) / 2) < 1e-9


def test_test_windows_begin_the_day_after():
    w = splits.walk_forward(dt.date(2010, 1, 1), dt.date(2024, 1, 1), 3000)
    assert w and all(x["test_start"] == x["train_end"] + dt.timedelta(1) and x["test_end"] == x["test_start"] + dt.timedelta(365) for x in w)


def test_poisson_resampling_agrees_with_the_exact_one(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(1.0, 4.0, 400)
    rows = [(1, f"T{i % 7}", dt.date(2020, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(x)]
    got = robustness.bootstrap_hashed(spark.createDataFrame(rows, "horizon int, ticker string, signal_date date, net_return_pct double"), n=2000).first()
    want = robustness.bootstrap_ci(x, 2000)
    assert abs(got["std_error"] - want["std_error"]) < 0.1 * want["std_error"]
    assert abs(got["ci_lower"] - want["ci_lower"]) < 0.1 and abs(got["ci_upper"] - want["ci_upper"]) < 0.1


def test_currency_and_targets(spark, sf):
    bars, rates = market.bars(spark, sf), market.fx_rates(spark, sf)
    e = Experiment("x", [events.Rule("return_3d", "<", -0.01)], 10, (1,))
    universe = bars.select("ticker", F.when(F.col("ticker") < "3", "target").otherwise("reference").alias("role")).distinct()
    s = run(spark, e, bars, None, F.lit("usa"), fx=rates, local=F.col("ticker").startswith("1"), targets=universe)
    assert {r["ticker"] for r in s.events.select("ticker").distinct().collect()} == {"1-URGENT", "2-HIGH"}
    with pytest.raises(ValueError, match="no valid exchange rate"):
        fx.in_base(bars, rates.where("ccl < 0"))
    with pytest.raises(ValueError, match="critical data issues"):
        run(spark, e, bars.withColumn("close", F.lit(-1.0)), None, F.lit("usa"), gate=("1992-01-01", "1998-08-02"))
    wide = run(spark, Experiment("x", e.conditions, 10, (1,), semantics=Semantics(widen_exclusion=True, exclusion=5)), bars, None, F.lit("usa"))
    assert wide.per_event.count() == wide.events.count()


def test_cache_is_used_until_it_no_longer_answers(spark, tmp_path):
    day, calls = dt.date(2024, 1, 1), []
    rows = spark.createDataFrame([("A", day + dt.timedelta(i), 1.0 + i, 1.0) for i in range(5)], "ticker string, session date, close double, volume double")

    def fetch():
        calls.append(1)
        return rows

    ask = lambda end, **k: market.cached(spark, str(tmp_path / "A"), "vendor", day, end, fetch, "A", **k)
    assert ask(day + dt.timedelta(4)).count() == 5 and ask(day + dt.timedelta(3)).count() == 5 and len(calls) == 1
    assert ask(day + dt.timedelta(9)).count() == 5 and len(calls) == 2
    assert ask(day + dt.timedelta(9), refresh=True).count() == 5 and len(calls) == 3
    manifest = json.loads(spark.read.text(str(tmp_path / "A" / "manifest")).first()[0])
    assert tuple(manifest) == market.MANIFEST_KEYS and manifest["ticker"] == manifest["yf_ticker"] == "A"


def test_landed_quotes_and_state(spark, tmp_path):
    line = '{"symbol":"S","timestamp":[1704067200,1704153600],"open":[1,2],"high":[2,3],"low":[0.5,1],"close":[1.5,null],"adjclose":[1.4,null],"volume":[10,20]}'
    got = market.landed_quotes(spark.createDataFrame([(line,)], "value string")).collect()
    assert [(r["ticker"], r["session"], r["adj_close"]) for r in got] == [("S", dt.date(2024, 1, 1), 1.4)]
    path = str(tmp_path / "state.json")
    assert market.load_json(path)["positions"] == []
    market.save_json(path, {"positions": [{"ticker": "S"}]})
    assert market.load_json(path)["positions"] == [{"ticker": "S"}]
    closed = spark.createDataFrame([(f"T{i}", dt.date(2024, 1, i), dt.date(2024, 2, i)) for i in range(1, 9)], "ticker string, entry_date date, exit_date date")
    assert [r["ticker"] for r in ledger.last_closed(closed).collect()] == ["T8", "T7", "T6", "T5", "T4"]


def test_tables_are_swept(spark):
    import os

    from eventide.sources.tables import made, materialize, sweep

    since = made()
    a, b = materialize(spark.range(3), "a"), materialize(spark.range(4), "b")
    sweep(spark, since, (b,))
    there = [os.path.isdir(x._eventide_path.removeprefix("file://")) for x in (a, b)]
    assert there == [False, True] and b.count() == 4
    sweep(spark, since)
    assert made() == since
