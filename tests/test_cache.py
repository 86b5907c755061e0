"""The cache of ranges: intervals against sets of days, gaps fetched only, partitions left alone."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from eventide.sources import cache, intervals
from eventide.sources.market import BARS_SCHEMA

DAY = dt.timedelta(days=1)
FIRST = dt.date(2020, 1, 1)


def ranges(spark, rows):
    return spark.createDataFrame([(k, FIRST + a * DAY, FIRST + z * DAY) for k, a, z in rows], cache.RANGES)


def days(df):
    return {(r["ticker"], (r["start"] - FIRST).days, (r["end"] - FIRST).days) for r in df.collect()}


def blocks(held):
    """Maximal runs of a set of (key, day)."""
    out = set()
    for k, d in held:
        if (k, d - 1) not in held:
            end = d
            while (k, end + 1) in held:
                end += 1
            out.add((k, d, end))
    return out


def each(rows):
    return {(k, d) for k, a, z in rows for d in range(a, z + 1)}


def test_intervals(spark):
    rnd = random.Random(1)
    for _ in range(4):
        a, b = ([(rnd.choice("xyz"), s, s + rnd.randint(-2, 9)) for s in (rnd.randint(0, 60) for _ in range(n))] for n in (30, 20))
        assert days(intervals.union(ranges(spark, a), ["ticker"])) == blocks(each(a))
        assert days(intervals.difference(ranges(spark, a), ranges(spark, b), ["ticker"])) == blocks(each(a) - each(b))
    none = ranges(spark, [])
    assert days(intervals.union(none, ["ticker"])) == set()
    assert days(intervals.difference(ranges(spark, [("x", 3, 3)]), none, ["ticker"])) == {("x", 3, 3)}
    open_ = spark.createDataFrame([("x", None, FIRST), ("x", FIRST, None)], cache.RANGES)
    assert days(intervals.union(open_, ["ticker"])) == set()


def table(spark, tickers=("GG", "^AB C", "Z.BA"), n=500, bump=0.0):
    """Bars of every day but each tenth."""
    rows = [(t, FIRST + i * DAY, *([10.0 + i + bump] * 5), 100.0) for t in tickers for i in range(n) if i % 10]
    return spark.createDataFrame(rows, BARS_SCHEMA)


class Source:
    """A fetch that keeps what it was asked for."""

    def __init__(self, bars):
        self.bars, self.asked = bars, []

    def __call__(self, gaps):
        self.asked.append(days(gaps))
        return cache.fetch_from(self.bars)(gaps)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in (path / "bars").rglob("*.parquet")}


def rows_of(df):
    return sorted(tuple(r) for r in df.select("ticker", "session", "close").collect())


def test_only_gaps_are_fetched(spark, tmp_path):
    bars = table(spark)
    source, own = Source(bars), cache.BarCache(spark, str(tmp_path), "test", buckets=2)
    want = ranges(spark, [("GG", 100, 200), ("Z.BA", 0, 50)])
    assert rows_of(own.get(want, source)) == rows_of(intervals.within(bars, want, ["ticker"]))
    assert source.asked == [{("GG", 100, 200), ("Z.BA", 0, 50)}]
    before = files(tmp_path)
    # The same again, and parts of it: nothing is fetched or written.
    own.get(want, source)
    inner = ranges(spark, [("GG", 110, 120)])
    assert rows_of(own.get(inner, source)) == rows_of(intervals.within(bars, inner, ["ticker"]))
    assert len(source.asked) == 1 and files(tmp_path) == before
    # Both ends and a new ticker: three gaps.
    wide = ranges(spark, [("GG", 90, 380), ("^AB C", 5, 5)])
    assert rows_of(own.get(wide, source)) == rows_of(intervals.within(bars, wide, ["ticker"]))
    assert source.asked[1] == {("GG", 90, 99), ("GG", 201, 380), ("^AB C", 5, 5)}
    assert days(own.coverage()) == {("GG", 90, 380), ("Z.BA", 0, 50), ("^AB C", 5, 5)}
    # Days without bars are covered: day 200 and 380 are holidays.
    own.get(ranges(spark, [("GG", 380, 380)]), source)
    assert len(source.asked) == 2


def test_untouched_partitions_stay(spark, tmp_path):
    source, own = Source(table(spark, n=800)), cache.BarCache(spark, str(tmp_path), "test", buckets=1)
    own.get(ranges(spark, [("GG", 0, 300), ("Z.BA", 0, 700)]), source)
    before = files(tmp_path)
    own.get(ranges(spark, [("GG", 0, 500)]), source)
    after = files(tmp_path)
    years = {y: {k: v for k, v in before.items() if f"year={y}" in k} for y in (2020, 2021)}
    # Days 301 to 500 end 2020 and begin 2021.
    own.get(ranges(spark, [("GG", 400, 600)]), source)
    last = files(tmp_path)
    assert all(last[k] == v for k, v in after.items() if "year=2020" in k) and years[2021].items() - last.items()
    assert rows_of(own.read(ranges(spark, [("Z.BA", 0, 700)]))) == rows_of(source.bars.where("ticker = 'Z.BA'").where(F.col("session") <= FIRST + 700 * DAY))


def test_damage_is_found_and_mended(spark, tmp_path):
    bars = table(spark)
    source, own = Source(bars), cache.BarCache(spark, str(tmp_path), "test", buckets=1)
    want = ranges(spark, [("GG", 0, 120), ("Z.BA", 0, 120)])
    own.get(want, source)
    # One cell of February changes, one row of March goes.
    stored = spark.createDataFrame(spark.read.parquet(f"{tmp_path}/bars").toPandas())
    spoilt = stored.withColumn("close", F.when((F.col("ticker") == "GG") & (F.col("session") == "2020-02-03"), -1.0).otherwise(F.col("close"))).where("not (ticker = 'Z.BA' and session = '2020-03-03')")
    spoilt.write.mode("overwrite").partitionBy("bucket", "year").parquet(f"{tmp_path}/bars")
    assert {tuple(r) for r in own.damaged(want.select("ticker").distinct()).collect()} == {("GG", "2020-02"), ("Z.BA", "2020-03")}
    assert days(own.missing(want)) == {("GG", 31, 59), ("Z.BA", 60, 90)}
    # Half of a damaged month is asked for: the other half is no longer covered.
    own.get(ranges(spark, [("GG", 40, 45)]), source)
    assert source.asked[-1] == {("GG", 40, 45)} and days(own.missing(want)) == {("GG", 31, 39), ("GG", 46, 59), ("Z.BA", 60, 90)}
    assert rows_of(own.get(want, source)) == rows_of(intervals.within(bars, want, ["ticker"]))
    assert own.damaged(want.select("ticker").distinct()).isEmpty()


def test_other_source_and_lost_records(spark, tmp_path):
    want = ranges(spark, [("GG", 0, 60)])
    cache.BarCache(spark, str(tmp_path), "one", buckets=3).get(want, Source(table(spark)))
    other = Source(table(spark, bump=5.0))
    assert rows_of(cache.BarCache(spark, str(tmp_path), "two").get(want, other)) == rows_of(intervals.within(other.bars, want, ["ticker"]))
    # A run that dies before its records are written leaves bars that count as missing.
    assert cache.BarCache(spark, str(tmp_path), "two")._state()["buckets"] == 3
    import shutil

    shutil.rmtree(tmp_path / "state")
    again = Source(table(spark))
    own = cache.BarCache(spark, str(tmp_path), "two", buckets=3)
    assert rows_of(own.get(want, again)) == rows_of(intervals.within(again.bars, want, ["ticker"])) and again.asked == [{("GG", 0, 60)}]


def test_months_that_are_gone(spark, tmp_path):
    """A damaged year that the source has no rows for leaves the store."""
    own = cache.BarCache(spark, str(tmp_path), "test", buckets=1)
    want = ranges(spark, [("GG", 0, 20)])
    own.get(want, Source(table(spark)))
    spark.read.parquet(f"{tmp_path}/bars").limit(3).write.mode("append").partitionBy("bucket", "year").parquet(f"{tmp_path}/bars")
    assert own.get(want, Source(table(spark).limit(0))).isEmpty()
    assert own.missing(want).isEmpty()


@pytest.mark.parametrize("cells", [(("a\x1f", "b"), ("a", "\x1fb")), (("a", None), ("a", "-")), (("1:", "a"), ("1", ":a"))])
def test_row_hashes_differ(spark, cells):
    df = spark.createDataFrame(cells, "x string, y string")
    assert len({r[0] for r in df.select(cache.row_hash(["x", "y"])).collect()}) == 2
