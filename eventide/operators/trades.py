"""Trades after events: entry, exit, return and excursions for every horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.windows import ahead, frame, ratio

HORIZONS = (1, 3, 5, 10, 20)


def forward_return(price: Column, h: int) -> Column:
    """Close to close, in percent."""
    return (ratio(ahead(price, h), price) - 1) * 100


def event_return(entry: Column, exit_: Column) -> Column:
    return F.when(entry == 0, 0.0).otherwise((ratio(exit_, entry) - 1) * 100)


def with_outcomes(df: DataFrame, horizons=HORIZONS, price: str = "close", high: str = "high", low: str = "low", open_: str = "open", entry_mode: str = "next_open") -> DataFrame:
    """Adds ``__t``, an array with each horizon's outcome, to every session.

    ``next_open`` enters at the next open and ``signal_close`` at the close;
    both leave at the close ``h`` sessions later. All are offsets of one window,
    so nothing is joined and events are filtered afterwards.
    """
    p, h, lo = F.col(price), F.col(high), F.col(low)
    entry = (ahead(F.col(open_)) if open_ in df.columns else ahead(p)) if entry_mode == "next_open" else p
    day = ahead(F.col("session")) if entry_mode == "next_open" else F.col("session")
    top, floor = F.struct(h.alias("x"), (-F.col("pos")).alias("k"), F.col("session").alias("d")), F.struct(lo.alias("x"), F.col("pos").alias("k"), F.col("session").alias("d"))
    out = {}
    for n in horizons:
        rows = frame(1, n)
        out[f"__{n}"] = F.when(
            F.col("pos") + n < F.col("n_sessions"),
            F.struct(F.lit(n).alias("horizon"), day.alias("entry_date"), ahead(F.col("session"), n).alias("exit_date"), p.alias("signal_price"), entry.alias("entry_price"), ahead(p, n).alias("exit_price"), F.max(top).over(rows).alias("top"), F.min(floor).over(rows).alias("floor")),
        )
    names = list(out)
    return df.withColumns(out).withColumn("__t", F.array_compact(F.array(*names))).drop(*names)


def trades(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per event and horizon; those without a full horizon or with entry 0 go."""
    rows = events.select("ticker", F.col("session").alias("signal_date"), *keep, F.explode("__t").alias("t")).where("t.entry_price <> 0")
    entry = F.col("t.entry_price")
    return rows.select(
        "ticker", "signal_date", *keep, "t.horizon", "t.entry_date", "t.exit_date", "t.signal_price", "t.entry_price", "t.exit_price",
        event_return(entry, F.col("t.exit_price")).alias("forward_return"), event_return(entry, F.col("t.top.x")).alias("mfe"), event_return(entry, F.col("t.floor.x")).alias("mae"),
        F.col("t.top.d").alias("mfe_date"), F.col("t.floor.d").alias("mae_date"),
    )


def canonical(trades_: DataFrame, bounds: DataFrame, costs: DataFrame, market: Column) -> DataFrame:
    """The fact table: trades with market, costs, net return, regimes and split."""
    from .splits import split_label

    t = trades_.withColumn("market", market).join(costs.select("market", F.col("roundtrip").alias("__rt")), "market", "left")
    t = t.withColumns({"transaction_cost_pct": F.col("__rt") * 100, "net_return_pct": F.col("forward_return") - F.col("__rt") * 100, "trend_regime": F.coalesce("trend_regime", F.lit("NEUTRAL")), "vol_regime": F.coalesce("vol_regime", F.lit("NORMAL_VOL"))})
    return t.join(F.broadcast(bounds)).withColumn("temporal_split", split_label()).drop("__rt", "discovery_end", "validation_end", "holdout_end")


