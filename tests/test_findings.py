"""Registered queries do the whole of what their operators do."""

import datetime as dt

from pyspark.sql import functions as F

from eventide.operators import decision
from eventide.plans import register


def test_decision_table_has_the_evidence_of_all_gates(spark):
    """Three horizons alike but for their controls and spread: only the last passes all gates."""
    day = dt.date(2020, 1, 1)
    rows, controls = [], []
    for horizon, wide, status in ((1, False, "INSUFFICIENT"), (3, True, "VALID"), (5, False, "VALID")):
        for i in range(90):
            # Many small gains; in the wide case rare large losses, so that the mean's interval holds zero.
            x = 4.0 + i % 3
            if wide and i % 30 == 29:
                x = -110.0
            rows.append(("A", day + dt.timedelta(i), horizon, x, ("discovery", "validation", "holdout")[i % 3], 0.4))
            controls.append(("A", horizon, status))
    t = spark.createDataFrame(rows, "ticker string, signal_date date, horizon int, net_return_pct double, temporal_split string, transaction_cost_pct double")
    e = register.evidence(t, spark.createDataFrame(controls, "ticker string, horizon int, status string"))
    got = {r["horizon"]: r for r in decision.decide_all(e).collect()}
    assert [got[h]["coverage_pct"] for h in (1, 3, 5)] == [0.0, 100.0, 100.0] and got[3]["mean"] > 0.6 and got[3]["ci_lower"] < 0 < got[3]["ci_upper"] and got[5]["ci_lower"] > 0
    assert {h: r["verdict"] for h, r in got.items()} == {1: "RESEARCH", 3: "RESEARCH", 5: "CANDIDATE"}
    as_before = e.withColumns({"coverage_pct": F.lit(100.0), "ci_lower": F.lit(1.0), "ci_upper": F.lit(2.0)})
    assert {r["verdict"] for r in decision.decide_all(as_before).collect()} == {"CANDIDATE"}


def test_bootstrap_numpy_takes_the_default_resamples(spark, sf):
    rows = register.QUERIES["bootstrap_numpy"](spark, sf).collect()
    assert rows and {r["n_iterations"] for r in rows} == {10_000}


def test_stream_daily_bars_has_every_day(spark, sf):
    days = lambda name: {(r["symbol"], r["day"]): r["n_ticks"] for r in register.QUERIES[name](spark, sf).collect()}
    stream, batch = days("stream_daily_bars"), days("ticks_to_daily")
    print("bars", len(stream), len(batch))
    assert stream.keys() == {*batch}
