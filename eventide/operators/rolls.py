"""Futures contracts as one series: expiry from the symbol, a roll calendar, back-adjustment.

A symbol is ``ROOT/MMMYY``. Contracts follow each other by expiry, not by name.
The calendar gives each contract the days on which it is the one to trade, as
an interval; the stitched series is a join of bars with it by symbol, so bars
are read once and only the calendar, a row a contract, is ordered by root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The months' codes in contract symbols.
MONTHS = ("ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC")
PRICES = ("open", "high", "low", "close")


def root(symbol: Column) -> Column:
    return F.regexp_extract(symbol, "^(.*)/[^/]*$", 1)


def expiry(symbol: Column) -> Column:
    """The last weekday of the contract's month; null for a symbol without one."""
    code, digits = (F.regexp_extract(symbol, "/([A-Za-z]{3})([0-9]{2})$", k) for k in (1, 2))
    code, year = F.upper(code), F.nullif(digits, F.lit("")).cast("int")
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), code), F.lit(0).cast("long")).cast("int")
    last = F.last_day(F.make_date(2000 + year, month, F.lit(1)))
    back = F.when(F.dayofweek(last) == 1, 2).when(F.dayofweek(last) == 7, 1).otherwise(0)
    return F.date_sub(last, back)


def roll_calendar(contracts: DataFrame, days: int = 5) -> DataFrame:
    """(root, symbol, expiry, multiplier, start, end, next): each contract is traded until ``days`` before it expires.

    The first contract of a root has no start. ``contracts`` has symbol and
    perhaps multiplier (1 without); symbols without an expiry are left out.
    """
    own = F.col("multiplier") if "multiplier" in contracts.columns else F.lit(1.0)
    rows = contracts.select("symbol", own.cast("double").alias("multiplier")).dropDuplicates(["symbol"])
    rows = rows.select(root(F.col("symbol")).alias("root"), "symbol", expiry(F.col("symbol")).alias("expiry"), F.coalesce("multiplier", F.lit(1.0)).alias("multiplier")).where("expiry is not null and root <> ''")
    by = W.partitionBy("root").orderBy("expiry", "symbol")
    rows = rows.withColumn("end", F.date_sub("expiry", days))
    return rows.select("root", "symbol", "expiry", "multiplier", F.date_add(F.lag("end").over(by), 1).alias("start"), "end", F.lead("symbol").over(by).alias("next"))


def active_contract(calendar: DataFrame, day: Column) -> DataFrame:
    """The contract of each root that is traded on a day."""
    return calendar.where((F.coalesce(F.col("start") <= day, F.lit(True))) & (day <= F.col("end")))


def roll_ratios(bars: DataFrame, calendar: DataFrame, within: int = 30) -> DataFrame:
    """(root, symbol, expiry, ratio): the next contract's close over this one's, on the last day up to the roll that has both.

    Days more than ``within`` before the roll do not count. A roll without such
    a day, and the last contract, have ratio null.
    """
    closes = bars.select("symbol", "session", "close").where("close > 0")
    old = calendar.where("next is not null").select("symbol", "next", "end").join(closes, "symbol").where(F.col("session").between(F.date_sub("end", within), F.col("end")))
    new = closes.select(F.col("symbol").alias("next"), "session", F.col("close").alias("__new"))
    both = old.join(new, ["next", "session"]).groupBy("symbol").agg(F.max_by(F.col("__new") / F.col("close"), "session").alias("ratio"))
    return calendar.select("root", "symbol", "expiry").join(both, "symbol", "left")


def stitched(bars: DataFrame, calendar: DataFrame, within: int = 30) -> DataFrame:
    """One series a root: (root, session, symbol, prices, volume, factor, adjusted prices, notional, joined).

    A contract's factor is the product of the ratios of its roll and all later
    ones, so the last contract keeps its prices and returns have no jump at a
    roll. ``joined`` is false where some later roll had no common day; its
    ratio counts as 1.
    """
    later = W.partitionBy("root").orderBy(F.desc("expiry"), F.desc("symbol")).rowsBetween(W.unboundedPreceding, 0)
    known = roll_ratios(bars, calendar, within).join(calendar.select("symbol", "next"), "symbol")
    log = F.sum(F.log(F.coalesce("ratio", F.lit(1.0)))).over(later)
    broken = F.max((F.col("ratio").isNull() & F.col("next").isNotNull()).cast("int")).over(later)
    factors = known.select("symbol", F.exp(log).alias("factor"), (broken == 0).alias("joined"))
    plan = calendar.select("symbol", "root", "multiplier", "start", "end").join(factors, "symbol")
    rows = bars.join(plan, "symbol").where((F.col("start").isNull() | (F.col("session") >= F.col("start"))) & (F.col("session") <= F.col("end")))
    adjusted = [(F.col(c) * F.col("factor")).alias(f"{c}_adj") for c in PRICES]
    return rows.select("root", "session", "symbol", *PRICES, "volume", "factor", *adjusted, (F.col("close") * F.col("multiplier")).alias("notional"), "joined")
