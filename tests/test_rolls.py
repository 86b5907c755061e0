"""Contracts: expiry, calendar, stitched series."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from eventide.operators import rolls

#: Spring to autumn of 2026, out of the order of their names.
SYMBOLS = ["GG/AGO26", "GG/JUN26", "GG/OCT26", "YP/JUN26"]


def test_expiry(spark):
    cases = {"GG/AGO26": date(2026, 8, 31), "GG/may26": date(2026, 5, 29), "A/B/FEB28": date(2028, 2, 29), "GG/OCT27": date(2027, 10, 29), "GG/XXX26": None, "GG": None, "GG/AGO2026": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "symbol string")
    assert {r["symbol"]: r["e"] for r in df.withColumn("e", rolls.expiry(F.col("symbol"))).collect()} == cases


@pytest.fixture(scope="module")
def calendar(spark):
    return rolls.roll_calendar(spark.createDataFrame([(x, 100.0 if x.startswith("G") else None) for x in SYMBOLS + SYMBOLS[:1] + ["bad"]], "symbol string, multiplier double"), 3)


def test_calendar(calendar):
    got = {r["symbol"]: (r["start"], r["end"], r["next"], r["multiplier"]) for r in calendar.collect()}
    assert got["GG/JUN26"] == (None, date(2026, 6, 27), "GG/AGO26", 100.0)
    assert got["GG/AGO26"] == (date(2026, 6, 28), date(2026, 8, 28), "GG/OCT26", 100.0)
    assert got["GG/OCT26"] == (date(2026, 8, 29), date(2026, 10, 27), None, 100.0)
    assert got["YP/JUN26"][1:] == (date(2026, 6, 27), None, 1.0) and len(got) == 4
    on = lambda d: {r["symbol"] for r in rolls.active_contract(calendar, F.lit(d)).collect()}
    assert on(date(2026, 6, 27)) == {"GG/JUN26", "YP/JUN26"} and on(date(2026, 6, 28)) == {"GG/AGO26"} and on(date(2027, 1, 1)) == set()


def test_stitched(spark, calendar):
    """Each contract costs a tenth more than the one before: adjusted, the series is smooth."""
    rows, first = [], date(2026, 6, 1)
    for k, x in enumerate(("GG/JUN26", "GG/AGO26", "GG/OCT26")):
        for i in range(150):
            p = 100 * 1.1**k * 1.001**i
            # The second contract is not quoted in the week before the first roll.
            if not (k == 1 and 20 <= i <= 26):
                rows.append((x, first + timedelta(i), p, p + 1, p - 1, p, 10.0))
    rows.append(("YP/JUN26", first, 5.0, 5.0, 5.0, 5.0, 1.0))
    bars = spark.createDataFrame(rows, "symbol string, session date, open double, high double, low double, close double, volume double")
    got = rolls.stitched(bars, calendar).orderBy("root", "session").collect()
    own = [r for r in got if r["root"] == "GG"]
    assert [r["symbol"] for r in own] == ["GG/JUN26"] * 27 + ["GG/AGO26"] * 62 + ["GG/OCT26"] * 60 and all(r["joined"] for r in got)
    assert {r["symbol"]: round(r["factor"], 9) for r in own} == {"GG/JUN26": 1.21, "GG/AGO26": 1.1, "GG/OCT26": 1.0}
    steps = [math.log(b["close_adj"] / a["close_adj"]) for a, b in zip(own, own[1:])]
    assert max(steps) - min(steps) < 1e-9 and own[0]["notional"] == 10000.0
    assert own[0]["high_adj"] == pytest.approx((100 + 1) * 1.21)
    # Quotes that end long before the roll are no bridge.
    apart = rolls.stitched(bars.where("symbol <> 'GG/AGO26' or session > '2026-06-27'"), calendar).where("root = 'GG'").select("symbol", "joined", F.round("factor", 6).alias("f")).distinct()
    assert {tuple(r) for r in apart.collect()} == {("GG/JUN26", False, 1.1), ("GG/AGO26", True, 1.1), ("GG/OCT26", True, 1.0)}
