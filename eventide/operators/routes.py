"""Exchange rates between any two currencies, over a graph of quoted pairs.

Every session has its own graph: an edge is a pair with a quote no older than
``carry`` sessions, and may be walked both ways. A rate is the product along the
shortest route of that session (of routes as short, the one whose currencies
come first by name). Routes grow level by level, one join a level, for all
sessions and all wanted currencies at once; a level keeps one route for each
(session, from, currency), so the tables grow with sessions and currencies and
not with the number of routes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.sources.tables import materialize

QUOTES = "session date, base string, quote string, rate double"


def listing_quotes(local: DataFrame, foreign: DataFrame, base: str, quote: str, ratio: float = 1.0) -> DataFrame:
    """Quotes implied by two listings of one share: ``ratio`` local shares make one foreign (an ADR)."""
    a, b = local.select("session", F.col("close").alias("__a")), foreign.select("session", F.col("close").alias("__b"))
    rate = F.col("__b") / F.nullif(F.col("__a") * ratio, F.lit(0.0))
    return a.join(b, "session").select("session", F.lit(base).alias("base"), F.lit(quote).alias("quote"), rate.alias("rate")).where("rate > 0")


def fresh_quotes(quotes: DataFrame, sessions: DataFrame, carry: int) -> DataFrame:
    """Quotes of every session, each pair's last one at most ``carry`` sessions old; of several for a session the mean."""
    q = quotes.where((F.col("rate") > 0) & F.col("base").isNotNull() & F.col("quote").isNotNull() & (F.col("base") != F.col("quote")))
    q = q.groupBy("session", "base", "quote").agg(F.avg("rate").alias("rate"))
    # All pairs in one row: a pair is two names of currencies, of which there are few hundred.
    pairs = q.agg(F.collect_set(F.struct("base", "quote")).alias("__pairs"))
    every = sessions.select("session").distinct().join(F.broadcast(pairs)).select("session", F.explode("__pairs").alias("p")).select("session", "p.*")
    last = F.last("rate", ignorenulls=True).over(W.partitionBy("base", "quote").orderBy("session").rowsBetween(-carry, 0))
    return every.join(q, ["session", "base", "quote"], "left").withColumn("rate", last).where("rate is not null")


def routes(quotes: DataFrame, sessions: DataFrame, origins: list[str], carry: int = 5, hops: int = 4) -> DataFrame:
    """(session, origin, currency, rate, n_hops, route): what one unit of each origin is in every currency within ``hops`` quotes."""
    q = fresh_quotes(quotes, sessions, carry)
    both = q.select("session", "base", "quote", "rate").unionByName(q.select("session", F.col("quote").alias("base"), F.col("base").alias("quote"), (1 / F.col("rate")).alias("rate")))
    # A pair that is quoted both ways has one edge, the mean of what the two say.
    edges = materialize(both.groupBy("session", F.col("base").alias("currency"), F.col("quote").alias("__to")).agg(F.avg("rate").alias("__rate")), "edges")
    start = sessions.select("session").distinct().select("session", F.explode(F.array(*map(F.lit, sorted(set(origins))))).alias("origin"))
    level = start.select("session", "origin", F.col("origin").alias("currency"), F.lit(1.0).alias("rate"), F.lit(0).alias("n_hops"), F.col("origin").alias("route"))
    known = level
    for _ in range(hops):
        steps = level.join(edges, ["session", "currency"]).select("session", "origin", F.col("__to").alias("currency"), (F.col("rate") * F.col("__rate")).alias("rate"), (F.col("n_hops") + 1).alias("n_hops"), F.concat("route", F.lit(">"), "__to").alias("route"))
        steps = steps.join(known.select("session", "origin", "currency"), ["session", "origin", "currency"], "left_anti")
        best = F.min_by(F.struct("rate", "n_hops", "route"), "route").alias("b")
        level = materialize(steps.groupBy("session", "origin", "currency").agg(best).select("session", "origin", "currency", "b.*"), "level")
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def converted(rows: DataFrame, rates: DataFrame, currency: Column, to: str, prices: tuple[str, ...]) -> DataFrame:
    """``rows`` with prices in ``to`` and the columns rate and route; sessions without a route have nulls."""
    own = rates.where(F.col("currency") == to).select(F.col("session").alias("__s"), F.col("origin").alias("__o"), "rate", "route")
    out = rows.withColumn("__c", currency).join(own, (F.col("session") == F.col("__s")) & (F.col("__c") == F.col("__o")), "left")
    return out.withColumns({c: F.col(c) * F.col("rate") for c in prices}).drop("__s", "__o", "__c")


def require_routes(rates: DataFrame, origins: list[str], to: str) -> None:
    """An error that names the currencies that have no route to ``to`` in any session."""
    have = {r[0] for r in rates.where(F.col("currency") == to).select("origin").distinct().collect()}
    if missing := sorted(set(origins) - have):
        raise ValueError(f"no quoted route to {to} from {', '.join(missing)}")
