"""Chronological splits, boundary purge, embargo and walk-forward windows."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def boundaries(dates: DataFrame, discovery: float = 0.6, validation: float = 0.2, holdout: float = 0.2, distinct: bool = True, col: str = "session") -> DataFrame:
    """One row: the last date of each period, by shares of the dates in order.

    Dates are counted per day and days are ranked by a running sum, so the row
    number's single partition holds days and never the table.
    """
    if abs(discovery + validation + holdout - 1) > 0.001:
        raise ValueError("the shares must sum to 1")
    days = dates.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("d")).agg(F.count("*").alias("n"))
    days = days.withColumn("n", F.lit(1)) if distinct else days
    every = W.partitionBy(F.lit(0)).orderBy("d")
    days = days.withColumns({"upto": F.sum("n").over(every.rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("n").over(W.partitionBy(F.lit(0)))})
    d_end = F.floor(F.col("total") * discovery)
    v_end = d_end + F.floor(F.col("total") * validation)
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("d")))
    return days.agg(at(d_end).alias("discovery_end"), F.coalesce(F.when(F.max(v_end) == 0, F.max("d")), at(v_end)).alias("validation_end"), F.max("d").alias("holdout_end"))


def period(day: Column) -> Column:
    return F.when(day <= F.col("discovery_end"), "discovery").when(day <= F.col("validation_end"), "validation").when(day <= F.col("holdout_end"), "holdout")


def split_label(signal: str = "signal_date", entry: str = "entry_date", exit_: str = "exit_date") -> Column:
    """The period that all three dates lie in, or ``boundary_crossing``."""
    a, b, c = (period(F.col(x)) for x in (signal, entry, exit_))
    return F.when((a == b) & (b == c), a).otherwise("boundary_crossing")


def purged(trades: DataFrame) -> DataFrame:
    """Trades that lie in one period: what metrics, bootstrap and counts are of."""
    return trades.where("temporal_split <> 'boundary_crossing'")


def by_period(rows: DataFrame, bounds: DataFrame, col: str = "session") -> DataFrame:
    """Rows with the period of their date; those after the last period go."""
    return rows.join(F.broadcast(bounds)).withColumn("period", period(F.col(col))).drop(*bounds.columns).where("period is not null")


def embargo(trades: DataFrame, positions: DataFrame, bounds: DataFrame, sessions: int) -> DataFrame:
    """Trades whose signal is more than ``sessions`` sessions from both inner boundaries."""
    ends = positions.join(F.broadcast(bounds)).groupBy("ticker").agg(F.max(F.when(F.col("session") <= F.col("discovery_end"), F.col("pos"))).alias("__d"), F.max(F.when(F.col("session") <= F.col("validation_end"), F.col("pos"))).alias("__v"))
    at = positions.select("ticker", F.col("session").alias("signal_date"), F.col("pos").alias("__p"))
    far = lambda c: F.coalesce(F.abs(F.col("__p") - F.col(c)) > sessions, F.lit(True))
    return trades.join(at, ["ticker", "signal_date"]).join(ends, "ticker").where(far("__d") & far("__v")).drop("__p", "__d", "__v")


def walk_forward(first: date, last: date, n_dates: int, n: int = 4, years: float = 2.0) -> list[dict]:
    """Training windows, and test windows from the day after; none if there are too few dates."""
    if n_dates < int(252 * (years + 1)):
        return []
    size = int(years * 365)
    step = ((last - first).days - size) // n
    out = []
    for i in range(n):
        start = first + timedelta(days=i * step)
        end = start + timedelta(days=size)
        test_start = end + timedelta(days=1)
        test_end = test_start + timedelta(days=size // 2)
        if test_end > last:
            break
        out.append({"name": f"window_{i + 1}", "train_start": start, "train_end": end, "test_start": test_start, "test_end": test_end})
    return out


def walk_forward_windows(dates: DataFrame, n: int = 4, years: float = 2.0) -> DataFrame:
    """The same as a table, from the dates' bounds alone."""
    size = int(years * 365)
    b = dates.agg(F.min("session").alias("a"), F.max("session").alias("b"), F.count_distinct("session").alias("n"))
    b = b.where(F.col("n") >= int(252 * (years + 1))).withColumn("step", F.floor((F.datediff("b", "a") - size) / n).cast("int"))
    b = b.select("b", "a", "step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("s", F.date_add("a", F.col("i") * F.col("step")))
    out = b.select(F.concat(F.lit("window_"), (F.col("i") + 1).cast("string")).alias("name"), F.col("s").alias("train_start"), F.date_add("s", size).alias("train_end"), F.date_add("s", size + 1).alias("test_start"), F.date_add("s", size + 1 + size // 2).alias("test_end"), "b")
    return out.where("test_end <= b").drop("b")


def holdout_intact(log: list[dict]) -> bool:
    """False if parameters changed after the holdout was opened."""
    opened = [e["at"] for e in log if e.get("event") == "holdout_opened"]
    return not opened or not any(e.get("event") == "parameters_changed" and e["at"] > min(opened) for e in log)


#: The keys of an experiment's log.
OPENED, CREATED, CHANGES, LAST_CHANGE = "holdout_opened_at", "hypothesis_created_at", "parameter_changes", "last_param_change"


def logs_intact(logs: DataFrame) -> DataFrame:
    """Adds ``intact`` to experiments' logs: false where parameters changed after the holdout was opened.

    Times are compared as text, as they are written. A log without an opening
    or without the hypothesis's date cannot be broken; columns may be missing.
    """
    have = set(logs.columns)
    opened, created, changes, last = (F.col(c) if c in have else F.lit(None) for c in (OPENED, CREATED, CHANGES, LAST_CHANGE))
    broken = opened.isNotNull() & created.isNotNull() & (changes.cast("long") > 0) & (F.coalesce(last.cast("string"), F.lit("")) > opened.cast("string"))
    return logs.withColumn("intact", ~F.coalesce(broken, F.lit(False)))
