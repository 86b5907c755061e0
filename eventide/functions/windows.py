"""Window expressions over one instrument's sessions.

Every expression is a Column over one window specification, so Spark plans one
Exchange and one Sort for a whole set of features and prunes what no rule
names. Missing values are NULL, divisions by zero give NULL, and a trailing
frame gives a value only when it holds as many values as it is long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def series():
    """One instrument's sessions in order."""
    return W.partitionBy("ticker").orderBy("session")


def frame(first: int, last: int):
    return series().rowsBetween(first, last)


def full(x: Column, k: int, agg: Callable[[Column], Column], last: int = 0) -> Column:
    """``agg`` over the ``k`` rows that end ``-last`` rows back, if all hold a value."""
    rows = frame(last - k + 1, last)
    return F.when(F.count(x).over(rows) == k, agg(x).over(rows))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def back(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(series())


def ahead(x: Column, n: int = 1) -> Column:
    return F.lead(x, n).over(series())


def flag(cond: Column) -> Column:
    """A condition as 1.0 or 0.0; unknown counts as 0.0."""
    return F.coalesce(cond, F.lit(False)).cast("double")
