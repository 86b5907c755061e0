"""A paper ledger as a function: positions and bars give the next positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entries(signals: DataFrame, open_: DataFrame, max_concurrent: int, size_usd: float) -> DataFrame:
    """New positions: the first signal of a ticker that is not open, while slots are free.

    ``signals``: (ticker, signal_date, signal_type, price), taken in the order
    of (signal_date, ticker, signal_type). The slot number ranks one row a ticker.
    """
    first = W.partitionBy("ticker").orderBy("signal_date", "signal_type")
    new = signals.join(open_.select("ticker").distinct(), "ticker", "left_anti").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    used = open_.agg(F.count("*").alias("__used"))
    # At most ``max_concurrent`` rows are ever taken: a top-k, and only those are numbered.
    slots = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("signal_date", "ticker"))
    taken = new.orderBy("signal_date", "ticker").limit(max_concurrent).withColumn("__slot", slots).join(F.broadcast(used)).where(F.col("__slot") + F.col("__used") <= max_concurrent)
    quantity = F.when(F.col("price") > 0, F.floor(F.lit(float(size_usd)) / F.nullif("price", F.lit(0.0)))).otherwise(1).cast("long")
    return taken.select("ticker", "signal_type", "signal_date", F.col("signal_date").alias("entry_date"), F.col("price").alias("entry_price"), quantity.alias("quantity"), F.lit(float(size_usd)).alias("position_usd"), F.lit("OPEN").alias("status"))


def exits(open_: DataFrame, bars: DataFrame, as_of, holding: int, roundtrip: float) -> DataFrame:
    """Positions closed at ``as_of``: held for ``holding`` calendar days, at the latest close."""
    due = open_.withColumn("__due", as_of).where(F.datediff("__due", "entry_date") >= holding)
    upto = due.select("ticker", F.col("__due").alias("__upto")).distinct()
    last = bars.join(upto, "ticker").where(F.col("session") <= F.col("__upto")).groupBy("ticker", "__upto").agg(F.max_by("close", "session").alias("exit_price"))
    old = due.join(last.withColumnsRenamed({"ticker": "__t", "__upto": "__u"}), (F.col("ticker") == F.col("__t")) & (F.col("__due") == F.col("__u")))
    pct = (F.col("exit_price") / F.nullif("entry_price", F.lit(0.0)) - 1) * 100 - roundtrip * 100
    return old.select("ticker", "signal_type", "signal_date", "entry_date", F.col("__due").alias("exit_date"), "entry_price", "exit_price", "quantity", "position_usd", F.lit("CLOSED").alias("status"), pct.alias("pnl_pct"), F.round(F.col("position_usd") * pct / 100, 2).alias("pnl_usd"))


def status(open_: DataFrame, closed: DataFrame) -> DataFrame:
    a = open_.agg(F.count("*").alias("n_open"), F.coalesce(F.sum("position_usd"), F.lit(0.0)).alias("exposure_usd"))
    b = closed.agg(F.count("*").alias("n_closed"), F.coalesce(F.sum("pnl_usd"), F.lit(0.0)).alias("pnl_usd"), F.count_if(F.col("pnl_usd") > 0).alias("n_wins"))
    return a.join(F.broadcast(b))


def last_closed(closed: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` positions that closed last."""
    return closed.orderBy(F.desc("exit_date"), "ticker", "entry_date").limit(n)
