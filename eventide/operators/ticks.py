"""Ticks: daily bars, fills at quotes, and long trades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_bars(ticks: DataFrame) -> DataFrame:
    """Bars of the traded price per symbol and day, with mean quotes; ties by event id."""
    t = ticks.where("last is not null").withColumn("__o", F.struct("ts", "event_id"))
    return t.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min_by("last", "__o").alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", "__o").alias("close"), F.avg("bid").alias("vwap_bid"), F.avg("ask").alias("vwap_ask"), F.count("*").alias("n_ticks"))


def ticks_to_daily(ticks: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    """Daily bars of one symbol's ticks of the days from ``start`` to ``end``."""
    day = F.to_date("ts")
    return daily_bars(ticks.where((F.col("symbol") == symbol) & day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))))


def first_quote(orders: DataFrame, ticks: DataFrame, side: str, at: str, tolerance_s: int, price: str, when: str) -> DataFrame:
    """Adds the first positive quote of ``side`` within the tolerance of ``at``, both ends included.

    A band join in time buckets of the tolerance: an order meets its own and
    the next bucket of its symbol only, so the join is an equi-join.
    """
    sec = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    # A fill depends on the symbol and the time alone, so these are the key, and equal orders share it.
    wanted = orders.select("symbol", F.col(at).alias("__at")).distinct()
    quotes = ticks.where(F.col(side) > 0).select("symbol", F.col("ts").alias("__ts"), F.col(side).alias("__q"), "event_id", F.floor(sec("ts") / tolerance_s).alias("__b"))
    want = wanted.select("symbol", "__at", F.explode(F.array(F.floor(sec("__at") / tolerance_s), F.floor(sec("__at") / tolerance_s) + 1)).alias("__b"))
    end = F.col("__at") + F.make_dt_interval(secs=F.lit(float(tolerance_s)))
    hit = want.join(quotes, ["symbol", "__b"]).where((F.col("__ts") >= F.col("__at")) & (F.col("__ts") <= end))
    fill = hit.groupBy("symbol", "__at").agg(F.min(F.struct("__ts", "event_id", "__q")).alias("f")).select(F.col("symbol").alias("__s"), "__at", F.col("f.__q").alias(price), F.col("f.__ts").alias(when))
    return orders.join(fill, (F.col("symbol") == F.col("__s")) & (F.col(at) == F.col("__at")), "left").drop("__s", "__at")


def long_trades(signals: DataFrame, ticks: DataFrame, horizons: tuple[int, ...], tolerance_s: int = 172_800, cost_pct: float = 0.46, short: bool = False, fill: Callable[..., DataFrame] = first_quote) -> DataFrame:
    """Entry at the ask, exit at the bid ``h`` calendar days after the entry (mirrored if short); ``fill`` finds the quotes."""
    a, b = ("bid", "ask") if short else ("ask", "bid")
    s = signals.select("symbol", "signal_ts", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    e = fill(s, ticks, a, "signal_ts", tolerance_s, "entry_price", "entry_ts").where("entry_price is not null")
    e = e.withColumn("__exit", F.col("entry_ts") + F.make_dt_interval(days=F.col("horizon")))
    x = fill(e, ticks, b, "__exit", tolerance_s, "exit_price", "exit_ts").where("exit_price is not null").drop("__exit")
    gross = (F.col("exit_price") / F.col("entry_price") - 1) * 100 * (-1 if short else 1)
    return x.withColumns({"gross_return_pct": gross, "spread_cost_pct": F.abs(F.col("entry_price") - F.col("exit_price")) / F.col("entry_price") * 100, "net_return_pct": gross - cost_pct})


def summarise(trades: DataFrame) -> DataFrame:
    g, n = "gross_return_pct", "net_return_pct"
    return trades.groupBy("horizon").agg(F.count("*").alias("n"), F.avg(g).alias("gross_mean"), F.median(g).alias("gross_median"), F.avg(n).alias("net_mean"), F.median(n).alias("net_median"), F.avg((F.col(n) > 0).cast("double")).alias("win_rate"), F.avg("spread_cost_pct").alias("avg_spread"))


def within_range(events: DataFrame, ticks: DataFrame, day: Column) -> DataFrame:
    """Events on a day between the first and last tick."""
    r = ticks.agg(F.to_date(F.min("ts")).alias("__a"), F.to_date(F.max("ts")).alias("__b"))
    return events.join(F.broadcast(r)).where((day >= F.col("__a")) & (day <= F.col("__b"))).drop("__a", "__b")
