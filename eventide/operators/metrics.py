"""Metrics of a set of trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles


def profit_factor(x: Column) -> Column:
    gains, losses = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.abs(F.sum(F.when(x < 0, x)))
    return gains / F.coalesce(losses, F.lit(1e-10))


#: The names of ``summary``.
SUMMARY = ("n_events", "mean", "median", "std", "p25", "p75", "win_rate", "avg_gain", "avg_loss", "worst", "best", "total_return", "profit_factor", "avg_mfe", "avg_mae")


def summary(col: str = "net_return_pct") -> list[Column]:
    """The aggregates of one return column, with its trades' excursions."""
    x = F.col(col)
    return [
        F.count(x).alias("n_events"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"), F.percentile(x, 0.25).alias("p25"), F.percentile(x, 0.75).alias("p75"),
        F.avg((x > 0).cast("double")).alias("win_rate"), F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("avg_gain"), F.coalesce(F.avg(F.when(x <= 0, x)), F.lit(0.0)).alias("avg_loss"),
        F.min(x).alias("worst"), F.max(x).alias("best"), F.sum(x).alias("total_return"), profit_factor(x).alias("profit_factor"), F.avg("mfe").alias("avg_mfe"), F.avg("mae").alias("avg_mae"),
    ]


def by(trades: DataFrame, *keys: str, col: str = "net_return_pct") -> DataFrame:
    return trades.groupBy(*keys).agg(*summary(col))


def by_ranks(trades: DataFrame, *keys: str, col: str = "net_return_pct") -> DataFrame:
    """``by`` for groups of any size: the median and the quartiles come from ranks, and no buffer holds a group's values."""
    shares = {"median": 0.5, "p25": 0.25, "p75": 0.75}
    sums = trades.groupBy(*keys).agg(*[c for c, n in zip(summary(col), SUMMARY) if n not in shares])
    own = quantiles(trades, keys, col, shares).drop("n").withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return sums.join(own, same, "left").select(*keys, *SUMMARY)


def split_metrics(trades: DataFrame, col: str = "net_return_pct") -> DataFrame:
    """Every split and the full sample, per horizon, in one pass; the full sample is split ``all``."""
    x = F.col(col)
    aggs = [F.count(x).alias("n_events"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.avg((x > 0).cast("double")).alias("win_rate")]
    out = trades.groupingSets([[F.col("temporal_split"), F.col("horizon")], [F.col("horizon")]], "temporal_split", "horizon").agg(F.grouping("temporal_split").alias("g"), *aggs)
    return out.withColumn("temporal_split", F.when(F.col("g") == 1, "all").otherwise(F.col("temporal_split"))).drop("g")


def positive_share(trades: DataFrame, part: str, col: str = "net_return_pct") -> DataFrame:
    """Percent of the parts (assets, years) whose mean is above zero, per horizon."""
    means = trades.groupBy("horizon", part).agg(F.avg(col).alias("m"))
    return means.groupBy("horizon").agg(F.count("*").alias("n_parts"), (100 * F.avg((F.col("m") > 0).cast("double"))).alias("positive_pct"))


def edge_weights(trades: DataFrame) -> DataFrame:
    """The edge weighted by events, and by assets."""
    per = trades.groupBy("horizon", "ticker").agg(F.avg("incremental_edge_net").alias("m"), F.sum("incremental_edge_net").alias("s"), F.count("incremental_edge_net").alias("n"))
    return per.groupBy("horizon").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("event_weighted"), F.avg("m").alias("asset_weighted"))
