"""The futures runner: equity signals filled at a contract's quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import ticks as tk


def run(events: DataFrame, ticks: DataFrame, symbol: str, horizons: tuple[int, ...], tolerance_s: int = 172_800, cost_pct: float = 0.46) -> tuple[DataFrame, DataFrame]:
    """(trades, summary by horizon); entries are aimed at the day after the signal.

    Signals outside the days that the ticks cover are left out.
    """
    quotes = ticks.where(F.col("symbol") == symbol)
    inside = tk.within_range(events, quotes, F.col("session"))
    signals = inside.select(F.lit(symbol).alias("symbol"), F.col("session").alias("signal_date"), F.date_add("session", 1).cast("timestamp_ntz").alias("signal_ts")).distinct()
    trades = tk.long_trades(signals.select("symbol", "signal_ts"), quotes, horizons, tolerance_s, cost_pct)
    return trades, tk.summarise(trades)
