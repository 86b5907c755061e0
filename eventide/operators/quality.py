"""Data-quality checks on bars: one aggregate per ticker, then a row per issue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.windows import back


def expected_days(start: str, end: str) -> int:
    from datetime import date

    return max(int((date.fromisoformat(end) - date.fromisoformat(start)).days * 252 / 365), 1)


def quality_issues(bars: DataFrame, start: str, end: str, expected: DataFrame | None = None, jump_pct: float = 20.0) -> DataFrame:
    """(ticker, severity, check, n) of every check that found something."""
    cols = [c for c in ("open", "high", "low", "close", "adj_close", "volume") if c in bars.columns]
    prices = [c for c in cols if c != "volume"]
    df = bars.withColumn("__jump", F.abs(F.col("close") / F.nullif(back(F.col("close")), F.lit(0.0)) - 1) * 100)
    n = F.count("*")
    bad = F.lit(False)
    for c in prices:
        bad |= F.coalesce(F.col(c) <= 0, F.lit(False))
    aggs = [n.alias("n"), (n - F.count_distinct("session")).alias("dup"), F.count_if(bad).alias("bad"), F.count_if(F.col("high") < F.col("low")).alias("flip"), F.count_if((F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))).alias("out"), F.count_if(F.col("__jump") > jump_pct).alias("jump")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"miss_{c}") for c in cols]
    aggs += [F.count_if(F.col("volume") == 0).alias("still")] if "volume" in cols else [F.lit(0).cast("long").alias("still")]
    g = df.groupBy("ticker").agg(*aggs)
    if expected is not None:
        g = expected.select("ticker").distinct().join(g, "ticker", "left").na.fill(0)
    many = lambda c: F.when(F.col(c) > 0.1 * F.col("n"), "CRITICAL").otherwise("WARNING")
    full = F.col("n") > 0
    issue = lambda check, severity, count, hit: F.when(hit, F.struct((F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(check).alias("check"), count.cast("long").alias("n")))
    rows = [issue("EMPTY", "CRITICAL", F.col("n"), ~full)]
    for c, check, severity in (("dup", "DUPLICATE_DATES", "WARNING"), ("bad", "BAD_PRICES", "CRITICAL"), ("flip", "HIGH_BELOW_LOW", "CRITICAL"), ("out", "CLOSE_OUTSIDE", "WARNING"), ("jump", "ABNORMAL_JUMP", "WARNING"), ("still", "ZERO_VOLUME", many("still"))):
        rows.append(issue(check, severity, F.col(c), full & (F.col(c) > 0)))
    rows += [issue(f"MISSING_{c}", many(f"miss_{c}"), F.col(f"miss_{c}"), full & (F.col(f"miss_{c}") > 0)) for c in cols]
    rows.append(issue("LOW_COVERAGE", "CRITICAL", F.col("n"), full & (F.col("n") < 0.5 * expected_days(start, end))))
    return g.select("ticker", F.explode(F.array_compact(F.array(*rows))).alias("i")).select("ticker", "i.severity", "i.check", "i.n")


def require_clean(issues: DataFrame) -> None:
    """Raises if any ticker has a critical issue."""
    found = issues.where("severity = 'CRITICAL'").select("ticker").distinct().orderBy("ticker").limit(20).collect()
    if found:
        raise ValueError("critical data issues: " + ", ".join(r["ticker"] for r in found))
