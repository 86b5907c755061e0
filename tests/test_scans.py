"""Running sums and scans against direct windows and full recursion."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.functions import scans
from eventide.operators import events


def series_of(seed, n, nulls=0.0):
    rnd = random.Random(seed)
    x, out = 100.0, []
    for _ in range(n):
        x *= math.exp(rnd.gauss(0, 0.02))
        out.append(None if rnd.random() < nulls else round(x, 6))
    return out


@pytest.fixture(scope="module")
def data():
    return {"LONG": series_of(1, 1300), "GAPS": series_of(2, 600, 0.2), "SHORT": series_of(3, 4), "ONE": [5.0], "NONE": [None, None], "BIG": [1e9 + v for v in series_of(4, 400)]}


@pytest.fixture(scope="module")
def bars(spark, data):
    return spark.createDataFrame([(t, date(2000, 1, 1) + timedelta(i), v) for t, xs in data.items() for i, v in enumerate(xs)], "ticker string, session date, close double")


def column(df, name):
    out = {}
    for r in df.orderBy("ticker", "session").collect():
        out.setdefault(r["ticker"], []).append(r[name])
    return out


@pytest.mark.parametrize("span", [1, 2, 9, 26, 200])
def test_ema_is_the_recursion(bars, data, span):
    got = column(scans.add_ema_scan(bars, "close", span, "e"), "e")
    a = 2 / (span + 1)
    for t, xs in data.items():
        y = None
        for x, g in zip(xs, got[t], strict=True):
            if x is None:
                assert g is None
                continue
            y = x if y is None else y * (1 - a) + x * a
            assert g == pytest.approx(y, rel=1e-12)


def test_macd(bars, data):
    rows = scans.add_macd_scan(bars).where("ticker = 'LONG'").orderBy("session").toPandas()
    x = pd.Series(data["LONG"])
    macd = x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()
    signal = macd.ewm(span=9, adjust=False).mean()
    for name, want in (("macd", macd), ("macd_signal", signal), ("macd_hist", macd - signal)):
        assert np.allclose(rows[name], want, rtol=0, atol=1e-10)


def test_no_fold_and_no_frame_of_the_length(bars):
    for df in (scans.add_ema_scan(bars, "close", 26, "e"), scans.length_grid(bars, "close", (20, 200))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "aggregate(" not in plan and "(RowFrame, -199" not in plan
    plan = scans.length_grid(bars, "close", (5, 20, 60, 200))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") <= 1


def test_lengths(bars, data):
    lengths = (1, 2, 5, 60, 500)
    rows = scans.length_grid(bars, "close", lengths).toPandas()
    for t, xs in data.items():
        for n in lengths:
            own = rows[(rows.ticker == t) & (rows.length == n)].sort_values("session")
            x = pd.Series(xs, dtype=float)
            mean, std = x.rolling(n, min_periods=n).mean(), x.rolling(n, min_periods=n).apply(lambda v: np.std(v, ddof=1) if len(v) > 1 else np.nan, raw=True)
            assert np.allclose(own["mean"].to_numpy(float), mean, rtol=1e-10, equal_nan=True)
            if n > 1:
                assert np.allclose(own["std"].to_numpy(float), std, rtol=1e-5, atol=1e-7, equal_nan=True)


def test_grid_of_lengths(spark, bars):
    """Events of every cell equal those of a study with that length alone."""
    means, returns = (5, 50), (3, 10)
    df = scans.add_lengths(bars.withColumn("pos", F.row_number().over(scans.series()) - 1), "close", means, returns)
    cells = [(f"{m} {r}", [events.Rule(f"above_sma_{m}", "==", 1.0), events.Rule(f"change_{r}", "<", -0.01)]) for m in means for r in returns]
    got = {r["cell"]: (r["n_signals"], r["n_events"]) for r in events.grid(df, cells, 10).collect()}
    for m in means:
        for r in returns:
            x = bars.withColumn("pos", F.row_number().over(scans.series()) - 1)
            sma = F.when(F.count("close").over(scans.frame(-m + 1, 0)) == m, F.avg("close").over(scans.frame(-m + 1, 0)))
            x = x.withColumns({"a": (F.col("close") > sma).cast("double"), "c": F.col("close") / F.lag("close", r).over(scans.series()) - 1}).where("a = 1 and c < -0.01")
            assert got[f"{m} {r}"] == (x.count(), events.cooldown(x.select("ticker", "pos"), 10).count())


def folded(pos, k):
    out = []
    for p in sorted(set(pos)):
        if not out or p - out[-1] > k:
            out.append(p)
    return out


def test_cooldowns_equal_the_fold(spark):
    rnd = random.Random(8)
    own = {"DENSE": range(300), "SOME": [i for i in range(900) if rnd.random() < 0.3], "FEW": [0, 21, 22, 60], "ONE": [7], "TWICE": [3, 3, 4]}
    df = spark.createDataFrame([(t, p) for t, x in own.items() for p in x], "ticker string, pos int")
    lengths = (0, 1, 5, 20, 1000)
    out = events.cooldowns(df, lengths)
    got = sorted((r["ticker"], r["cooldown"], r["pos"]) for r in out.collect())
    assert got == sorted((t, k, p) for t, x in own.items() for k in lengths for p in folded(x, k))
    one = sorted((r["ticker"], r["pos"]) for r in events.cooldown(df.distinct(), 5).collect())
    assert one == sorted((t, p) for t, k, p in got if k == 5)
    assert events.cooldowns(df.limit(0), lengths).count() == 0


def test_cooldowns_hold_no_chain(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(events, "materialize", lambda df, name, was=events.materialize: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), was(df, name))[1])
    df = spark.createDataFrame([("A", i) for i in range(64)], "ticker string, pos int")
    assert events.cooldowns(df, (1,)).count() == 32
    # 32 kept signals after one head: five rounds of doubling, and one to see that they are all.
    assert len(plans) <= 2 + 2 * 7 and not any("collect_list" in p or "aggregate(" in p for p in plans)
