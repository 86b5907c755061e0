"""Robustness: bootstrap, leave-one-out, concentration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import Ranks
from .trades import HORIZONS


def bootstrap_ci(returns: np.ndarray, n: int = 10_000, ci: float = 0.95, seed: int = 42) -> dict:
    """Percentile interval of the mean by resampling; no returns give zeros."""
    x = np.asarray(returns, dtype=float)
    if not len(x):
        return {"mean": 0.0, "median": 0.0, "ci_lower": 0.0, "ci_upper": 0.0, "std_error": 0.0, "ci": ci, "n_iterations": n}
    rng = np.random.default_rng(seed)
    means = np.array([rng.choice(x, size=len(x), replace=True).mean() for _ in range(n)])
    low, high = np.percentile(means, [100 * (1 - ci) / 2, 100 * (1 + ci) / 2])
    return {"mean": float(x.mean()), "median": float(np.median(x)), "ci_lower": float(low), "ci_upper": float(high), "std_error": float(means.std(ddof=1)) if n > 1 else 0.0, "ci": ci, "n_iterations": n}


def bootstrap(trades: DataFrame, keys: list[str], col: str = "net_return_pct", n: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Per group, with returns in the order of (ticker, date).

    A resample needs its group's returns together: a group holds the trades of
    one horizon, some thousands of rows.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trades.select(*keys).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["ticker", "signal_date"])["x"].dropna().to_numpy()
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | bootstrap_ci(x, n, ci, seed)])

    rows = trades.select(*keys, "ticker", "signal_date", F.col(col).alias("x"))
    return rows.groupBy(*keys).applyInPandas(run, f"{fields}, mean double, median double, ci_lower double, ci_upper double, std_error double, ci double, n_iterations int")


#: The distribution function of Poisson(1) at 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
PRIME = 2147483647


def bootstrap_hashed(trades: DataFrame, key: str = "horizon", col: str = "net_return_pct", n: int = 10_000, ci: float = 0.95) -> DataFrame:
    """Resampling by Poisson weights, which any SQL engine repeats; other draws than ``bootstrap``.

    Resample k weighs a row by a number that follows from the row's hash and k
    alone, so a resample is two sums: partial sums are made where the rows are,
    and no group has to be together.
    """
    own = F.conv(F.substring(F.md5(F.concat_ws("|", "ticker", F.col("signal_date").cast("string"))), 1, 7), 16, 10).cast("long") + 1
    rows = trades.where(F.col(col).isNotNull()).select(key, F.col(col).alias("x"), own.alias("r"))
    draws = rows.select(key, "x", "r", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("k"))
    u = F.col("r") * ((F.col("k") * 48271 + 11) % PRIME) % PRIME / F.lit(float(PRIME))
    weight = sum(((u > p).cast("int") for p in POISSON), F.lit(0))
    sums = draws.withColumn("w", weight).groupBy(key, "k").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum("w").alias("m"))
    means = sums.where("m > 0").withColumn("mean", F.col("s") / F.col("m"))
    return means.groupBy(key).agg(F.percentile("mean", (1 - ci) / 2).alias("ci_lower"), F.percentile("mean", (1 + ci) / 2).alias("ci_upper"), F.stddev_samp("mean").alias("std_error"))


def leave_one_out(trades: DataFrame, part: str, col: str = "forward_return", parts: DataFrame | None = None, horizons: tuple[int, ...] | None = None) -> DataFrame:
    """Mean without each part, from the parts' sums: nothing is computed again.

    ``parts`` holds all parts of the data, with or without trades, and ``horizons``
    all horizons; by default those that trades have.
    """
    x = trades.select("horizon", part, F.col(col).cast("double").alias("x"))
    parts = x.select(part) if parts is None else parts.select(part)
    every = x.select("horizon") if horizons is None else None
    cells = parts.distinct().select(part, F.explode(F.array(*map(F.lit, horizons))).alias("horizon")) if every is None else parts.distinct().join(every.distinct())
    per = x.unionByName(cells.select("horizon", part, F.lit(None).cast("double").alias("x"))).groupBy("horizon", part).agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    whole = W.partitionBy("horizon")
    left = F.sum("n").over(whole) - F.col("n")
    rest = F.sum("s").over(whole) - F.coalesce("s", F.lit(0.0))
    return per.select(F.col(part).alias("excluded"), "horizon", left.alias("n_events"), F.coalesce(rest / F.nullif(left, F.lit(0)), F.lit(0.0)).alias("mean_return"))


def leave_one_out_ranked(trades: DataFrame, parts: Column, cells: DataFrame, measures: tuple[str, ...] = ("net_return_pct", "incremental_edge_net"), horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """n, mean and median of every measure without each part: sums for the mean, ranks for the median, nothing computed again.

    ``parts`` is an array: a trade that belongs to several parts (the years of
    its signal, entry and exit) is left out with each of them. ``cells`` has the
    parts as ``excluded``, with or without trades. Nothing left gives zeros.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])).alias("v")
    long = trades.select("horizon", parts.alias("parts"), values).select("horizon", "parts", "v.measure", "v.x").where("x is not null")
    keys = ["horizon", "measure"]
    every = cells.select("excluded").distinct().withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("measure", F.explode(F.array(*map(F.lit, measures))))
    medians = Ranks(long, keys, "x", "parts").without_parts(every, "excluded")
    own = long.select(*keys, "x", F.explode(F.array_distinct("parts")).alias("excluded")).groupBy(*keys, "excluded").agg(F.sum("x").alias("own"))
    total = long.groupBy(*keys).agg(F.sum("x").alias("total"))
    out = medians.join(total, keys, "left").join(own, [*keys, "excluded"], "left")
    rest = F.col("total") - F.coalesce("own", F.lit(0.0))
    zero = F.lit(0.0)
    return out.select("excluded", "horizon", "measure", F.col("n").alias("n_events"), F.when(F.col("n") > 0, rest / F.col("n")).otherwise(zero).alias("mean"), F.coalesce("median", zero).alias("median"))


def trade_years() -> Column:
    """The years that a trade touches: of its signal, its entry and its exit."""
    return F.array(*[F.year(c) for c in ("signal_date", "entry_date", "exit_date")])


def concentration(trades: DataFrame, col: str | None = None, part: str = "ticker") -> DataFrame:
    """Shares of the best trade, three trades and part in the total, with a status for totals of 0 or less.

    Gross returns by default. Trades are ranked within their part, and only the
    three best of each part go on, so no horizon's trades are ranked together.
    """
    col = col or ("forward_return" if "forward_return" in trades.columns else "net_return_pct")
    rank = F.row_number().over(W.partitionBy("horizon", part).orderBy(F.desc("x"), "signal_date"))
    ranked = trades.select("horizon", part, F.col(col).cast("double").alias("x"), "signal_date").withColumn("r", rank)
    per = ranked.groupBy("horizon", part).agg(F.sum("x").alias("s"), F.count("x").alias("n"), F.collect_list(F.when(F.col("r") <= 3, F.col("x"))).alias("best"))
    best = per.groupBy("horizon").agg(F.sum("s").alias("total"), F.sum("n").alias("n_trades"), F.count("*").alias("n_assets"), F.max(F.struct("s", F.col(part).alias("p"))).alias("top"), F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, 3).alias("three"))
    t = F.nullif("total", F.lit(0.0))
    share = lambda c: F.coalesce(c / t * 100, F.lit(0.0))
    three = F.aggregate("three", F.lit(0.0), lambda a, v: a + v)
    return best.select("horizon", share(F.get("three", F.lit(0))).alias("best_trade_pct"), share(three).alias("best_3_pct"), F.when(F.col("total") == 0, "—").otherwise(F.col("top.p").cast("string")).alias("best_asset"), share(F.col("top.s")).alias("best_asset_pct"), "n_trades", "n_assets", F.when(F.col("total") > 0, "OK").otherwise("NOT_APPLICABLE").alias("status"))


def crosses_zero(low: Column, high: Column) -> Column:
    return (low < 0) & (high > 0)
