"""Windows of any length and recursions, from running sums.

A sliding frame is summed again for every row, so its cost grows with its
length, and with every length of a grid. Here an instrument's running sums are
made once and every length is a difference of two of them. An exponential mean
is a chain of affine maps: maps compose within blocks of rows by running sums
of scaled values, and a block takes over what the blocks before it end in. Both
cost the same for a row whatever the length or span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import back, frame, ratio, series


def add_running(df: DataFrame, x: str, name: str = "__run", digits: int = 6) -> DataFrame:
    """Adds the running number, sum and sum of squares of ``x``, less the instrument's first value.

    Values are taken to ``digits`` decimals (and to 10 ** 12 in size), and their
    sums are decimal: exact, so a difference of two of them has no drift however
    long the series is. Null values count as none.
    """
    rows = frame(W.unboundedPreceding, 0)
    own = (F.col(x) - F.col(f"{name}_0")).cast(f"decimal({12 + digits},{digits})")
    df = df.withColumn(f"{name}_0", F.first(x, ignorenulls=True).over(rows)).withColumn(f"{name}_d", own)
    d = F.col(f"{name}_d")
    return df.withColumns({f"{name}_n": F.count(d).over(rows), f"{name}_s": F.sum(d).over(rows), f"{name}_q": F.sum(d * d).over(rows)}).drop(f"{name}_d")


def _since(c: str, n: int) -> Column:
    """The running sum less that of ``n`` rows ago; null where nothing has been summed."""
    return (F.col(c) - F.coalesce(F.lag(c, n).over(series()), F.lit(0))).cast("double")


def run_mean(n: int, name: str = "__run") -> Column:
    """The mean of the last ``n`` rows, if all hold a value."""
    return F.when(_since(f"{name}_n", n) == n, F.col(f"{name}_0") + _since(f"{name}_s", n) / n)


def run_std(n: int, name: str = "__run") -> Column:
    """Their sample standard deviation."""
    s, q = _since(f"{name}_s", n), _since(f"{name}_q", n)
    return F.when(_since(f"{name}_n", n) == n, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / max(n - 1, 1)))


def length_grid(df: DataFrame, x: str, lengths: tuple[int, ...]) -> DataFrame:
    """(ticker, session, length, mean, std, zscore) for every length, from one pass over the bars."""
    cells = F.array(*[F.struct(F.lit(n).alias("length"), run_mean(n).alias("mean"), run_std(n).alias("std")) for n in lengths])
    # All lengths are columns of one window before they become rows.
    wide = add_running(df.select("ticker", "session", x), x).withColumn("__cells", cells)
    long = wide.select("ticker", "session", x, F.explode("__cells").alias("c")).select("ticker", "session", x, "c.*")
    return long.select("ticker", "session", "length", "mean", "std", ratio(F.col(x) - F.col("mean"), F.col("std")).alias("zscore"))


def add_lengths(df: DataFrame, price: str = "close", means: tuple[int, ...] = (), returns: tuple[int, ...] = ()) -> DataFrame:
    """Adds ``above_sma_n`` (1.0 or 0.0, null without a full window) and ``change_n`` for every length, from one pass."""
    p = F.col(price)
    wide = add_running(df, price)
    out = {f"above_sma_{n}": (p > run_mean(n)).cast("double") for n in means}
    out |= {f"change_{n}": ratio(p, back(p, n)) - 1 for n in returns}
    return wide.withColumns(out).drop(*[f"__run_{c}" for c in "0nsq"])


#: A block's values are scaled by this factor at most, and the rest of a block that so many blocks lie behind is nothing.
_SCALE, _BLOCKS = 16.0, 16


def add_ema_scan(df: DataFrame, x: str, span: int, name: str) -> DataFrame:
    """Exponential mean with weight 2 / (span + 1), started at the first value: ``add_ema`` without its fold.

    Null values are skipped and have no mean. Weights of a block fall by a
    factor of 16 at most, so sums of values over their weights lose few digits;
    sixteen blocks back a value's weight is under 1e-19.
    """
    a = 2.0 / (span + 1)
    if a >= 1:
        return df.withColumn(name, F.col(x).cast("double"))
    size = max(1, int(math.log(_SCALE) / -math.log1p(-a)))
    keep = df.columns
    at = F.count(x).over(frame(W.unboundedPreceding, 0)) - 1
    rows = df.withColumn("__i", F.when(F.col(x).isNotNull(), at)).withColumns({"__b": F.floor(F.col("__i") / size), "__j": F.col("__i") % size})
    scaled = F.col(x) * F.when(F.col("__i") == 0, 1.0).otherwise(a) * F.pow(F.lit(1 - a), -F.col("__j"))
    block = W.partitionBy("ticker", "__b").orderBy("session").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.sum(scaled).over(block) * F.pow(F.lit(1 - a), F.col("__j")))
    ends = rows.where(F.col("__j") == size - 1).select("ticker", F.col("__b").alias("__e"), F.col("__own").alias("__end"))
    by = W.partitionBy("ticker").orderBy("__e")
    carry = sum((F.coalesce(F.lag("__end", m).over(by) if m else F.col("__end"), F.lit(0.0)) * (1 - a) ** (size * m) for m in range(_BLOCKS)), F.lit(0.0))
    carried = ends.select(F.col("ticker").alias("__t"), (F.col("__e") + 1).alias("__e"), carry.alias("__carry"))
    both = rows.join(carried, F.col("ticker").eqNullSafe(F.col("__t")) & (F.col("__b") == F.col("__e")), "left")
    mean = F.col("__own") + F.coalesce("__carry", F.lit(0.0)) * F.pow(F.lit(1 - a), F.col("__j") + 1)
    return both.select(*[c for c in keep if c != name], mean.alias(name))


def add_macd_scan(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """``add_macd`` by scans."""
    df = add_ema_scan(add_ema_scan(df, x, fast, "__fast"), x, slow, "__slow")
    df = add_ema_scan(df.withColumn("macd", F.col("__fast") - F.col("__slow")), "macd", signal, "macd_signal")
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__fast", "__slow")
