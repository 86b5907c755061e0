"""Technical features as Columns over (ticker, session) rows.

``add_features`` adds them in stages, as some are windows over others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import back, flag, frame, full, ratio, series

def sma(x: Column, n: int) -> Column:
    return full(x, n, F.avg)


def padded(x: Column) -> Column:
    """The last value known, as percentage changes carry missing prices forward."""
    return F.last(x, ignorenulls=True).over(frame(W.unboundedPreceding, 0))


def true_range(high: Column, low: Column, close: Column) -> Column:
    before = back(close)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def zscore(x: Column, n: int) -> Column:
    return ratio(x - full(x, n, F.avg), full(x, n, F.stddev_samp))


def volume_ratio(v: Column, n: int) -> Column:
    return ratio(v, full(v, n, F.avg))


def percentile_rank(x: Column, n: int) -> Column:
    """Share of the ``n`` values before that are smaller; needs all of them."""
    before = F.collect_list(x).over(frame(-n, -1))
    return F.when(x.isNotNull() & (F.size(before) == n), F.size(F.filter(before, lambda b: b < x)) / F.lit(float(n)))


def bollinger_b(x: Column, n: int = 20, k: float = 2.0) -> Column:
    mean, sd = full(x, n, F.avg), full(x, n, F.stddev_samp)
    return ratio(x - (mean - sd * k), sd * (2 * k))


def high_distance(close: Column, high: Column, n: int) -> Column:
    top = full(high, n, F.max)
    return ratio(close - top, top)


def breakout(close: Column, high: Column, n: int = 20) -> Column:
    return flag(close > full(high, n, F.max, last=-1))


def add_positions(bars: DataFrame) -> DataFrame:
    """Adds ``pos``, the session's number from 0, and ``n_sessions`` of the ticker."""
    return bars.withColumns({"pos": F.row_number().over(series()) - 1, "n_sessions": F.count("*").over(W.partitionBy("ticker")).cast("int")})


def add_rsi(df: DataFrame, price: str = "close", n: int = 14, name: str = "rsi_14") -> DataFrame:
    """Relative strength with plain rolling means of gains and losses; no losses give NULL."""
    df = df.withColumn("__d", F.col(price) - back(F.col(price)))
    gain = full(F.greatest(F.col("__d"), F.lit(0.0)) + F.col("__d") * 0, n, F.avg)
    loss = full(F.greatest(-F.col("__d"), F.lit(0.0)) + F.col("__d") * 0, n, F.avg)
    return df.withColumn(name, 100 - 100 / (1 + ratio(gain, loss))).drop("__d")


def add_down_runs(df: DataFrame, price: str = "close", name: str = "consecutive_down") -> DataFrame:
    """Length of the run of declines that ends here, by numbering the runs."""
    down = flag(F.col(price) < back(F.col(price)))
    df = df.withColumn("__down", down).withColumn("__run", F.sum(1 - F.col("__down")).over(frame(W.unboundedPreceding, 0)))
    rows = F.sum("__down").over(W.partitionBy("ticker", "__run").orderBy("session").rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(name, F.when(F.col("__down") == 1, rows).otherwise(0.0)).drop("__down", "__run")


def add_ema(df: DataFrame, x: str, span: int, name: str, window: int = 250) -> DataFrame:
    """Exponential mean with weight 2 / (span + 1), started at the first value.

    The sum of past weights is folded over the ``window`` last rows, which is
    exact to double precision once (1 - weight) ** window is below its step.
    """
    a = 2.0 / (span + 1)
    rows = F.collect_list(F.col(x)).over(frame(-window + 1, 0))
    fold = F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), F.get(rows, F.lit(0)), lambda y, v: y * (1 - a) + v * a)
    return df.withColumn(name, F.when(F.col(x).isNotNull(), fold))


def add_macd(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = add_ema(add_ema(df, x, fast, "__fast"), x, slow, "__slow", window=400)
    df = df.withColumn("macd", F.col("__fast") - F.col("__slow"))
    return add_ema(df, "macd", signal, "macd_signal").withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__fast", "__slow")


def add_features(bars: DataFrame, price: str = "close", high: str = "high", low: str = "low", open_: str = "open", only: set[str] | None = None) -> DataFrame:
    """Bars with every feature (or those in ``only``), by three stages of windows."""
    cols = set(bars.columns)
    p = F.col(price)
    h, lo = (F.col(c) if c in cols else p for c in (high, low))
    df = bars.withColumns({"__pad": padded(p), "__tr": true_range(h, lo, p)})
    pad = F.col("__pad")
    out = {f"sma_{n}": sma(p, n) for n in (20, 60, 200)}
    out |= {f"return_{n}d": ratio(pad, back(pad, n)) - 1 for n in (1, 3, 5, 10, 20, 60)}
    out |= {"atr_14": full(F.col("__tr"), 14, F.avg), "distance_to_high_60d": high_distance(p, h, 60), "bb_pct_b": bollinger_b(p), "close_breaks_high_20d": breakout(p, h)}
    if open_ in cols:
        out["gap_pct"] = (ratio(F.col(open_), back(p)) - 1) * 100
    if "volume" in cols:
        out |= {f"volume_ratio_{n}d": volume_ratio(F.col("volume"), n) for n in (20, 50)}
    df = add_down_runs(add_rsi(df.withColumns(out), price), price)
    df = df.withColumns({
        "dist_sma_20": ratio(p - F.col("sma_20"), F.col("sma_20")), "dist_sma_200": ratio(p - F.col("sma_200"), F.col("sma_200")),
        "close_above_sma_200": flag(p > F.col("sma_200")), "sma_200_slope": (F.col("sma_200") - back(F.col("sma_200"), 20)) / 20,
        "atr_percentile_60d": percentile_rank(F.col("atr_14"), 60), "return_3d_zscore": zscore(F.col("return_3d"), 60),
    }).drop("__pad", "__tr")
    made = [c for c in df.columns if c not in cols]
    return df if only is None else df.drop(*[c for c in made if c not in only])


def add_rate_returns(fx: DataFrame, rate: str = "ccl") -> DataFrame:
    """``ccl_return_1d`` and ``ccl_return_5d`` of an exchange-rate series."""
    w = W.partitionBy(F.lit(0)).orderBy("session")
    return fx.withColumns({f"ccl_return_{n}d": ratio(F.col(rate), F.lag(rate, n).over(w)) - 1 for n in (1, 5)})


def with_series(df: DataFrame, series: DataFrame, columns: list[str]) -> DataFrame:
    """Features that are the same for all instruments of a session, such as rates."""
    return df.join(series.select("session", *columns), "session", "left")
