"""Order statistics by rank against numpy."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import metrics, robustness
from eventide.operators.ranks import Ranks, quantiles

SHARES = {"low": 0.0, "p25": 0.25, "half": 0.5, "p90": 0.9, "top": 1.0}


@pytest.fixture
def spread(spark):
    """Partitions stay apart, however small."""
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def values(rnd, n=900):
    """A hot group, a hot value in it, groups of one row, nulls, a null group."""
    rows = [("hot", rnd.choice([7.0, 7.0, rnd.gauss(0, 5)])) for _ in range(n)]
    rows += [("small", float(x)) for x in (3, 1, 2, 2)] + [("one", -0.5), ("none", None), (None, 4.0), (None, 6.0), ("hot", None)]
    return rows


def test_quantiles(spark, spread):
    rows = values(random.Random(1))
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r for r in quantiles(df, ["k"], "x", SHARES).collect()}
    groups = {k for k, x in rows if x is not None}
    assert set(got) == groups
    for k in groups:
        own = [x for g, x in rows if g == k and x is not None]
        assert got[k]["n"] == len(own)
        assert [got[k][n] for n in SHARES] == pytest.approx([np.percentile(own, 100 * q) for q in SHARES.values()], abs=1e-12)
    want = {r["k"]: r for r in df.groupBy("k").agg(*[F.percentile("x", q).alias(n) for n, q in SHARES.items()]).collect()}
    assert all(got[k][n] == want[k][n] for k in groups for n in SHARES)


def test_no_partition_holds_the_hot_group(spark, spread):
    rnd = random.Random(2)
    df = spark.createDataFrame([("hot", rnd.random()) for _ in range(4000)], "k string, x double")
    ranks = Ranks(df, ["k"], "x")
    held = [r["n"] for r in ranks._placed.groupBy("__at").agg(F.count("*").alias("n")).collect()]
    assert len(held) >= 4 and max(held) < 2000
    plan = ranks.quantiles(SHARES)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower() and "collect_list" not in plan.lower()


def test_at_rank(spark, spread):
    df = spark.createDataFrame([(1, x) for x in (5.0, 3.0, 3.0, 9.0)], "k int, x double")
    wanted = spark.createDataFrame([(1, r) for r in range(-1, 5)] + [(2, 0)], "k int, r long")
    got = {(r["k"], r["r"]): r["v"] for r in Ranks(df, ["k"], "x").at(wanted, "r", "v").collect()}
    assert got == {(1, -1): None, (1, 0): 3.0, (1, 1): 3.0, (1, 2): 5.0, (1, 3): 9.0, (1, 4): None, (2, 0): None}


def test_medians_without_each_part(spark, spread):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2]), rnd.choice([0.5, rnd.gauss(0, 1), float(rnd.randint(-2, 2))]), rnd.choice([["a"], ["b"], ["a", "b", "a"], ["c", None], [], ["d"]])) for _ in range(400)]
    rows += [(3, 1.0, ["a"]), (3, None, ["b"])]
    df = spark.createDataFrame(rows, "h int, x double, p array<string>")
    cells = spark.createDataFrame([(h, p) for h in (1, 2, 3, 4) for p in "abcdz"], "h int, p string")
    got = {(r["h"], r["p"]): (r["n"], r["median"]) for r in Ranks(df, ["h"], "x", "p").without_parts(cells, "p").collect()}
    assert len(got) == 20
    for h, p in got:
        rest = [x for g, x, q in rows if g == h and x is not None and p not in q]
        assert got[h, p][0] == len(rest) and (got[h, p][1] == pytest.approx(np.median(rest)) if rest else got[h, p][1] is None)


def trades(spark, n=300):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        y = 2000 + rnd.randrange(5)
        rows.append((rnd.choice([1, 5]), rnd.choice("ABC"), date(y, 12, 20), date(y + (i % 7 == 0), 1 if i % 7 == 0 else 12, 25), date(y + (i % 3 == 0), 1 if i % 3 == 0 else 12, 28), rnd.gauss(0, 3), rnd.choice([None, rnd.gauss(0, 3)]), 1.0, -1.0))
    return rows, spark.createDataFrame(rows, "horizon int, ticker string, signal_date date, entry_date date, exit_date date, net_return_pct double, incremental_edge_net double, mfe double, mae double")


def test_leave_one_out(spark):
    rows, df = trades(spark)
    years = spark.createDataFrame([(y,) for y in range(1999, 2007)], "excluded int")
    assets = spark.createDataFrame([(t,) for t in "ABCX"], "excluded string")
    for parts, cells, own in ((robustness.trade_years(), years, lambda r: {d.year for d in r[2:5]}), (F.array("ticker"), assets, lambda r: {r[1]})):
        got = robustness.leave_one_out_ranked(df, parts, cells, horizons=(1, 5, 9)).collect()
        assert len(got) == cells.count() * 6
        for r in got:
            at = 5 if r["measure"] == "net_return_pct" else 6
            rest = [x[at] for x in rows if x[0] == r["horizon"] and x[at] is not None and r["excluded"] not in own(x)]
            assert r["n_events"] == len(rest) and (r["mean"], r["median"]) == pytest.approx((np.mean(rest), np.median(rest)) if rest else (0, 0))


def test_metrics_agree(spark):
    _, df = trades(spark)
    df = df.withColumn("horizon", F.when(F.col("horizon") == 1, 1))
    key = lambda r: str(r["horizon"])
    a, b = (sorted(f(df, "horizon", col="incremental_edge_net").collect(), key=key) for f in (metrics.by, metrics.by_ranks))
    assert [r.asDict().keys() for r in a] == [r.asDict().keys() for r in b]
    assert len(a) == 2 and all(tuple(x)[1:] == pytest.approx(tuple(y)[1:]) for x, y in zip(a, b))
