"""Market regimes: trend by a benchmark, volatility by the range's percentile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.functions.windows import back, full


def as_of(bars: DataFrame, bench: DataFrame, price: str = "close", name: str = "bench") -> DataFrame:
    """The benchmark's price of its last session not after each session, NULL prices included.

    The benchmark is carried over the distinct sessions once, whatever the
    number of tickers, and joined by session. The last non-null struct is
    carried, so a NULL inside it is kept; the one window holds days, not bars.
    """
    days = bars.select("session").where("session is not null").distinct()
    quotes = bench.select("session", F.struct(F.col(price).alias("p")).alias("__q"), F.lit(0).alias("__own"))
    both = quotes.unionByName(days.select("session", F.lit(None).cast(quotes.schema["__q"].dataType).alias("__q"), F.lit(1).alias("__own")))
    rows = W.partitionBy(F.lit(0)).orderBy("session", "__own").rowsBetween(W.unboundedPreceding, 0)
    aligned = both.withColumn(name, F.last("__q", ignorenulls=True).over(rows)["p"]).where("__own = 1").select(F.col("session").alias("__day"), name)
    return bars.join(aligned, F.col("session") == F.col("__day"), "left").drop("__day")


def trend_regime(price: Column, sma: Column, slope: Column) -> Column:
    return F.when((price > sma) & (slope > 0), "BULL").when((price < sma) & (slope < 0), "BEAR").otherwise("NEUTRAL")


def vol_regime(percentile: Column) -> Column:
    return F.when(percentile < 0.25, "LOW_VOL").when(percentile > 0.75, "HIGH_VOL").otherwise("NORMAL_VOL")


def add_regimes(features: DataFrame, bench: DataFrame | None = None, price: str = "close") -> DataFrame:
    """Adds both labels; the benchmark is first aligned to the asset's sessions."""
    df = as_of(features, bench) if bench is not None else features.withColumn("bench", F.col(price))
    df = df.withColumn("__sma", full(F.col("bench"), 200, F.avg))
    df = df.withColumn("__slope", (F.col("__sma") - back(F.col("__sma"), 20)) / 20)
    vol = vol_regime(F.col("atr_percentile_60d")) if "atr_percentile_60d" in df.columns else F.lit("NORMAL_VOL")
    return df.withColumns({"trend_regime": trend_regime(F.col("bench"), F.col("__sma"), F.col("__slope")), "vol_regime": vol}).drop("__sma", "__slope", "bench")
