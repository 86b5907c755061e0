"""Exact order statistics by rank, of groups of any size.

Values are counted first, so equal ones are one row however many there are.
The distinct values are range-partitioned by group and value; counts within a
partition, and the partitions' totals in order, give every value its rank in
its group. A statistic is then a lookup of one or two ranks. No task and no
buffer holds a whole group: a group of a third of all rows spreads over as
many partitions as its distinct values fill.

With parts (the asset or the years of a trade, several if need be) the k-th
value without a part needs no second look at the rest: it is the value of rank
k + m, where m of the part's values stand before it, and those are the ones
with at most k values of other parts before them.

Groups may be null, and are one group then. Null values are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.sources.tables import materialize


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Join on keys that may be null; the keys come from ``a``."""
    b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True) if extra is None else extra
    for k in keys:
        on &= a[k].eqNullSafe(b[f"__{k}"])
    return a.join(b, on, how).drop(*[f"__{k}" for k in keys])


class Ranks:
    """Ranks of ``col`` within groups of ``keys``; optionally also within the parts of ``parts``, an array column."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], col: str, parts: str | None = None) -> None:
        self.keys = list(keys)
        rows = rows.where(F.col(col).isNotNull()).withColumn("__x", F.col(col).cast("double"))
        counts = rows.groupBy(*self.keys, "__x").agg(F.count("*").alias("__c")).withColumn("__part", F.lit(None).cast("string"))
        if parts is not None:
            own = rows.select(*self.keys, "__x", F.explode(F.array_distinct(F.array_compact(F.col(parts).cast("array<string>")))).alias("__part"))
            counts = counts.unionByName(own.groupBy(*self.keys, "__x", "__part").agg(F.count("*").alias("__c")))
        # Values of a part come before the value itself: what a row finds before it are the smaller values only.
        order = [*[F.col(k) for k in self.keys], F.col("__x"), F.asc_nulls_last("__part")]
        placed = materialize(counts.repartitionByRange(*order).withColumn("__at", F.spark_partition_id()), "ranged")
        whole, at = F.col("__part").isNull(), W.partitionBy("__at", *self.keys)
        sums = F.coalesce(F.sum(F.when(whole, F.col("__c"))).over(at.orderBy("__x", F.asc_nulls_last("__part")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        placed = placed.withColumn("__before", sums)
        if parts is not None:
            mine = W.partitionBy("__at", *self.keys, "__part").orderBy("__x").rowsBetween(W.unboundedPreceding, -1)
            placed = placed.withColumn("__own", F.coalesce(F.sum("__c").over(mine), F.lit(0)))
        self._placed = materialize(placed, "placed")
        self._spans = self._offsets(self._placed, F.when(whole, F.col("__c")).otherwise(0), [])
        self._parts = self._offsets(self._placed.where(~whole), F.col("__c"), ["__part"]) if parts is not None else None

    def _offsets(self, placed: DataFrame, count: Column, also: list[str]) -> DataFrame:
        """(keys, also, partition, first rank, number) of what a partition holds: a row for each, and no values."""
        sums = placed.groupBy(*self.keys, *also, "__at").agg(F.sum(count).alias("__n"))
        earlier = W.partitionBy(*self.keys, *also).orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
        return materialize(sums.withColumn("__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0))), "offsets")

    def sizes(self, name: str = "n") -> DataFrame:
        """(keys, n): values of each group."""
        return self._spans.groupBy(*self.keys).agg(F.sum("__n").alias(name))

    def at(self, wanted: DataFrame, rank: str, name: str) -> DataFrame:
        """``wanted`` with the value of its rank, from 0; null where the group has no such rank."""
        spans = self._spans.select(*self.keys, F.col("__at").alias("__to"), F.col("__first").alias("__f"), F.col("__n").alias("__m"))
        asked = wanted.select(*self.keys, F.col(rank).cast("long").alias("__rank")).distinct()
        found = _joined(asked, spans, self.keys, extra=(F.col("__rank") >= F.col("__f")) & (F.col("__rank") < F.col("__f") + F.col("__m")))
        values = self._placed.where("__part is null").select(*self.keys, "__at", "__x", "__before", "__c")
        local = F.col("__rank") - F.col("__f")
        hit = _joined(found, values, self.keys, extra=(F.col("__to") == F.col("__at")) & (local >= F.col("__before")) & (local < F.col("__before") + F.col("__c")))
        hit = hit.select(*self.keys, F.col("__rank").alias("__hit"), F.col("__x").alias(name))
        return _joined(wanted, hit, self.keys, "left", extra=F.col(rank) == F.col("__hit")).drop("__hit")

    def quantiles(self, shares: dict[str, float]) -> DataFrame:
        """(keys, n, one column a share), interpolated between ranks as ``percentile`` does."""
        asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("q")) for n, q in shares.items()])).alias("a")
        wanted = self.sizes("__size").select(*self.keys, "__size", asked).select(*self.keys, "__size", "a.name", ((F.col("__size") - 1) * F.col("a.q")).alias("__pos"))
        wanted = wanted.withColumns({"__low": F.floor("__pos"), "__high": F.ceil("__pos")})
        both = self.at(self.at(wanted, "__low", "__a"), "__high", "__b")
        step = F.col("__pos") - F.col("__low")
        value = F.when(F.col("__low") == F.col("__high"), F.col("__a")).otherwise((1 - step) * F.col("__a") + step * F.col("__b"))
        one = [F.max(F.when(F.col("name") == n, value)).alias(n) for n in shares]
        return both.groupBy(*self.keys).agg(F.max("__size").alias("n"), *one)

    def without_parts(self, cells: DataFrame, part: str) -> DataFrame:
        """``cells`` (keys, part) with n and median of the group's values that do not belong to the part.

        A part without values leaves its group whole; a group without values, or
        a part that holds all of them, has n 0 and a null median.
        """
        keys = [*self.keys, "__part"]
        cells = cells.withColumn("__part", F.col(part).cast("string"))
        own = self._parts.groupBy(*keys).agg(F.sum("__n").alias("__mine"))
        sized = _joined(_joined(cells, self.sizes("__size"), self.keys, "left"), own, keys, "left")
        sized = sized.withColumn("n", F.coalesce("__size", F.lit(0)) - F.coalesce("__mine", F.lit(0)))
        low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
        sized = sized.withColumns({"__low": low, "__high": high}).drop("__size", "__mine")
        members = self._placed.where("__part is not null").select(*keys, "__at", "__c", "__before", "__own")
        spans = self._spans.select(*self.keys, F.col("__at").alias("__in"), F.col("__first").alias("__f"))
        runs = self._parts.select(*keys, F.col("__at").alias("__in"), F.col("__first").alias("__g"))
        members = _joined(members, spans, self.keys, extra=F.col("__at") == F.col("__in")).drop("__in")
        members = _joined(members, runs, keys, extra=F.col("__at") == F.col("__in")).drop("__in")
        others = F.col("__before") + F.col("__f") - F.col("__own") - F.col("__g")
        ranks = _joined(members.withColumn("__others", others), sized.select(*keys, "__low", "__high").distinct(), keys)
        ranks = ranks.groupBy(*keys).agg(*[F.sum(F.when(F.col("__others") <= F.col(k), F.col("__c")).otherwise(0)).alias(f"__m{k}") for k in ("__low", "__high")])
        moved = _joined(sized, ranks, keys, "left")
        moved = moved.withColumns({k: F.when(F.col("n") > 0, F.col(k) + F.coalesce(f"__m{k}", F.lit(0))) for k in ("__low", "__high")})
        both = self.at(self.at(moved, "__low", "__a"), "__high", "__b")
        return both.withColumn("median", (F.col("__a") + F.col("__b")) / 2).drop("__a", "__b", "__low", "__high", "__m__low", "__m__high", "__part")


def quantiles(rows: DataFrame, keys: Sequence[str], col: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of ``col`` in each group of ``keys``."""
    return Ranks(rows, keys, col).quantiles(shares)
