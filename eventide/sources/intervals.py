"""Sets of days as closed intervals (start, end) of each key.

Both operations sweep a key's interval ends in order: a window over the ends,
never a join of intervals with intervals and never a row a day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ends(ranges: DataFrame, keys: list[str], weight: str, weights: list[str]) -> DataFrame:
    """One row an end: +1 where an interval begins, -1 on the day after it ends. Empty and open intervals are none."""
    ends = F.explode(F.array(F.struct(F.col("start").alias("day"), F.lit(1).alias("w")), F.struct(F.date_add("end", 1).alias("day"), F.lit(-1).alias("w"))))
    rows = ranges.where("start <= end").select(*keys, ends.alias("e"))
    return rows.select(*keys, "e.day", *[(F.col("e.w") if w == weight else F.lit(0)).alias(w) for w in weights])


def _swept(ends: DataFrame, keys: list[str], weights: list[str], inside: Column) -> DataFrame:
    """The maximal intervals where ``inside`` holds for the numbers of open intervals of each kind."""
    by = W.partitionBy(*keys).orderBy("day")
    steps = ends.groupBy(*keys, "day").agg(*[F.sum(w).alias(w) for w in weights])
    steps = steps.withColumns({w: F.sum(w).over(by) for w in weights}).withColumn("__in", inside)
    # Neighbouring steps on the same side of the condition belong to one interval.
    steps = steps.withColumn("__was", F.coalesce(F.lag("__in").over(by), F.lit(False)))
    turns = steps.where(F.col("__in") != F.col("__was"))
    out = turns.withColumn("__next", F.lead("day").over(by)).where("__in")
    return out.select(*keys, F.col("day").alias("start"), F.date_sub("__next", 1).alias("end"))


def union(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and adjoining intervals of each key as one."""
    return _swept(_ends(ranges, keys, "a", ["a"]), keys, ["a"], F.col("a") > 0)


def difference(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The days of ``wanted`` that no interval of ``stored`` holds."""
    weights = ["a", "b"]
    ends = reduce(DataFrame.unionByName, (_ends(r, keys, w, weights) for r, w in ((wanted, "a"), (stored, "b"))))
    return _swept(ends, keys, weights, (F.col("a") > 0) & (F.col("b") == 0))


def within(rows: DataFrame, ranges: DataFrame, keys: list[str], day: str = "session") -> DataFrame:
    """Rows whose day some interval of their key holds, each once."""
    whole = union(ranges, keys).withColumnsRenamed({"start": "__start", "end": "__end"})
    return rows.join(whole, keys).where(F.col(day).between(F.col("__start"), F.col("__end"))).select(*rows.columns)
