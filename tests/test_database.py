"""Daily tables of a database, read by JDBC from an embedded one."""

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from eventide.sources import market

DAY = dt.date(2024, 1, 1)
ROWS = [(t, DAY + dt.timedelta(i), str(10.0 + i), 12.0 + i, 9.0 + i, 11.0 + i, 100 + i) for t in ("A", "B", "C") for i in range(40)] + [("A", None, "1", 1.0, 1.0, 1.0, 1), (None, DAY, "x", 1.0, 1.0, None, None), ("D", dt.date(2030, 1, 1), "5", 5.0, 5.0, 5.0, 5)]
URL = "jdbc:derby:memory:daily;create=true"


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    jvm = spark._jvm
    jvm.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("derby") / "derby.log"))
    con = jvm.java.sql.DriverManager.getConnection(URL)
    for name, rows in (("stock_prices", ROWS), ("no_prices", [])):
        con.createStatement().execute(f'CREATE TABLE {name} ("Ticker" VARCHAR(20), "Date" DATE, "Open" VARCHAR(20), "High" DOUBLE, "Low" DOUBLE, "Close" DOUBLE, "Volume" BIGINT)')
        for row in rows:
            cells = ("NULL" if x is None else repr(str(x)) if isinstance(x, (str, dt.date)) else str(x) for x in row)
            con.createStatement().execute(f"INSERT INTO {name} VALUES ({', '.join(cells)})")
    con.close()
    return URL


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_rows_and_ranges_of_days(spark, url):
    whole = market.read_table(spark, url, "stock_prices")
    parts = market.read_table(spark, url, "stock_prices", day="Date", start="2024-01-01", end="2024-02-10", parts=4)
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() == 4
    # Rows before, behind and without a day are in the ranges at the ends.
    assert key(parts) == key(whole) == sorted(map(str, ROWS))
    sizes = [r[0] for r in parts.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 4 and max(sizes) < len(ROWS) / 2


def test_daily_bars_ask_the_database_for_their_rows_only(spark, url):
    table = market.read_table(spark, url, "stock_prices", day="Date", start="2024-01-01", end="2024-02-10", parts=4)
    bars = market.daily_bars(table, ["A", "C"], "2024-01-05", "2024-01-09")
    got = sorted((r["ticker"], r["session"], r["open"], r["adj_close"]) for r in bars.collect())
    assert got == [(t, DAY + dt.timedelta(i), 10.0 + i, 11.0 + i) for t in ("A", "C") for i in range(4, 9)]
    pushed = next(line for line in plan(bars).splitlines() if "PushedFilters" in line)
    assert "Ticker" in pushed and "Date" in pushed and "2024-01-05" in pushed
    narrow = plan(bars.select("ticker", "close"))
    assert "Volume" not in next(line for line in narrow.splitlines() if "ReadSchema" in line)


def test_tables_without_rows_and_unknown_tickers(spark, url):
    table = market.read_table(spark, url, "stock_prices")
    assert market.daily_bars(table, ["Z"], "2024-01-01", "2024-12-31").count() == 0
    empty = market.read_table(spark, url, "no_prices", day="Date", start="2024-01-01", end="2024-02-10", parts=4)
    assert market.daily_bars(empty, ["A"], "2024-01-01", "2024-12-31").count() == 0
