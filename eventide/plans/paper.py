"""The daily paper scan: signals of every configuration, then entries and exits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators import events, ledger


def signals(features: DataFrame, configs: dict[str, list], as_of: Column, sessions: int = 20, days: int = 7) -> DataFrame:
    """Recent events of each named configuration: a branch each over the same features, which are read once a branch."""
    found = [events.recent(events.detect(features.select("ticker", "session", "pos", "close", *_used(features, c)), c, sessions), as_of, days).select("ticker", F.col("session").alias("signal_date"), F.lit(name).alias("signal_type"), F.col("close").alias("price")) for name, c in configs.items()]
    return reduce(DataFrame.unionByName, found)


def _used(features: DataFrame, conditions) -> list[str]:
    own = {r.feature for r in events.parse_rules(conditions) or []}
    return sorted((own & set(features.columns)) - {"ticker", "session", "pos", "close"})


def day(open_: DataFrame, features: DataFrame, configs: dict[str, list], as_of: Column, max_concurrent: int, size_usd: float, holding: int, roundtrip: float) -> tuple[DataFrame, DataFrame]:
    """(positions opened, positions closed) of one day, from the positions before it."""
    return ledger.entries(signals(features, configs, as_of), open_, max_concurrent, size_usd), ledger.exits(open_, features, as_of, holding, roundtrip)
