"""Currency: rates joined with a bounded carry, and prices in the base currency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def with_rate(bars: DataFrame, fx: DataFrame, carry: int = 5) -> DataFrame:
    """Bars with the rate of their session, or of at most ``carry`` sessions of the asset before; others go."""
    rows = W.partitionBy("ticker").orderBy("session").rowsBetween(-carry, 0)
    joined = bars.join(fx.select("session", F.col("ccl").alias("__rate")), "session", "left")
    return joined.withColumn("ccl", F.last("__rate", ignorenulls=True).over(rows)).drop("__rate").where("ccl is not null")


def rate_gaps(bars: DataFrame, fx: DataFrame, carry: int = 5) -> DataFrame:
    """Per ticker: sessions with a rate, filled ones, and those that go."""
    rows = W.partitionBy("ticker").orderBy("session").rowsBetween(-carry, 0)
    j = bars.join(fx, "session", "left").withColumn("__f", F.last("ccl", ignorenulls=True).over(rows))
    return j.groupBy("ticker").agg(F.count("ccl").alias("n_direct"), F.count_if(F.col("ccl").isNull() & F.col("__f").isNotNull()).alias("n_filled"), F.count_if(F.col("__f").isNull()).alias("n_dropped"))


def in_base(bars: DataFrame, fx: DataFrame, local=None, adjust_all: bool = False, carry: int = 5) -> DataFrame:
    """Adds ``*_usd``: local tickers at adjusted price over rate, others at their own price.

    Raises if there are local rows and no valid rate at all: they would all go.
    """
    if fx.where(F.col("ccl") > 0).isEmpty():
        raise ValueError("no valid exchange rate")
    local = F.col("ticker").endswith(".BA") | (F.col("ticker") == "^MERV") if local is None else local
    source = {c: F.col(f"{c}_adj") if f"{c}_adj" in bars.columns else F.col("adj_close") if c == "close" and "adj_close" in bars.columns else F.col(c) for c in PRICES}
    rows = W.partitionBy("ticker").orderBy("session").rowsBetween(-carry, 0)
    j = bars.join(fx.select("session", F.col("ccl").alias("__rate")), "session", "left").withColumn("ccl", F.when(local, F.last("__rate", ignorenulls=True).over(rows)))
    j = j.where(~local | F.col("ccl").isNotNull())
    plain = source if adjust_all else {c: F.col(c) for c in PRICES}
    return j.drop("__rate").withColumns({f"{c}_usd": F.when(local, source[c] / F.nullif("ccl", F.lit(0.0))).otherwise(plain[c]) for c in PRICES})
