"""The verdict on an experiment: ordered gates over small aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Evidence:
    n_total: int
    mean: float | None
    median: float | None
    validation_median: float | None = None
    validation_n: int | None = None
    holdout_median: float | None = None
    holdout_n: int | None = None
    coverage_pct: float | None = None
    ci_lower: float | None = None
    ci_upper: float | None = None
    best_trade_pct: float = 100.0
    cost_pct: float = 0.0


def decide(e: Evidence, min_events: int = 40, firm_events: int = 60, min_coverage: float = 50.0) -> tuple[str, str]:
    """(REJECTED, RESEARCH or CANDIDATE, the reasons)."""
    mean = -999.0 if e.mean is None else e.mean
    if e.n_total < min_events:
        return "REJECTED", f"{e.n_total} events, fewer than {min_events}"
    if mean <= 0:
        return "REJECTED", "net mean not above zero"
    for name, median, n in (("validation", e.validation_median, e.validation_n), ("holdout", e.holdout_median, e.holdout_n)):
        if median is not None and median <= 0:
            return "REJECTED", f"{name} net median not above zero"
        if n is not None and n < 10:
            return "REJECTED", f"{name} has fewer than 10 events"
    if e.coverage_pct is not None and e.coverage_pct < min_coverage:
        return "RESEARCH", "too few events with controls"
    reasons = []
    crosses = e.ci_lower is not None and e.ci_upper is not None and e.ci_lower < 0 < e.ci_upper
    if crosses:
        reasons.append("interval holds zero")
    if e.best_trade_pct > 20:
        reasons.append("one trade is over a fifth of the total")
        if e.n_total < firm_events:
            return "RESEARCH", "; ".join(reasons)
    if mean < 1.5 * e.cost_pct:
        reasons.append("mean under 1.5 times the cost")
    if e.n_total >= firm_events and (e.median or 0) > 0 and not reasons:
        return "CANDIDATE", "all gates passed"
    return "RESEARCH", "; ".join(reasons) or "not enough evidence"


def decide_all(evidence: DataFrame) -> DataFrame:
    """The same gates as one CASE over a table with a row per experiment or horizon."""
    bad = F.lit(False)
    for s in ("validation", "holdout"):
        bad |= F.coalesce(F.col(f"{s}_median") <= 0, F.lit(False)) | F.coalesce(F.col(f"{s}_n") < 10, F.lit(False))
    crosses = F.coalesce((F.col("ci_lower") < 0) & (F.col("ci_upper") > 0), F.lit(False))
    best = F.coalesce("best_trade_pct", F.lit(100.0))
    verdict = (
        F.when(F.col("n_total") < 40, "REJECTED").when(F.coalesce("mean", F.lit(-999.0)) <= 0, "REJECTED").when(bad, "REJECTED").when(F.coalesce(F.col("coverage_pct") < 50, F.lit(False)), "RESEARCH")
        .when((F.col("n_total") >= 60) & (F.coalesce("median", F.lit(0.0)) > 0) & (best <= 20) & ~crosses & (F.col("mean") >= 1.5 * F.col("cost_pct")), "CANDIDATE").otherwise("RESEARCH")
    )
    return evidence.withColumn("verdict", verdict)
