"""Events: rules, their conjunction, cooldown and overlap."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.sources.tables import discard, materialize

OPERATORS = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "==": operator.eq, "!=": operator.ne}

#: The range that each feature's threshold may lie in.
FEATURE_RANGES = {
    "atr_percentile_60d": (0.0, 1.0),
    "distance_to_high_60d": (-1.0, 0.0),
    "return_3d": (-1.0, 10.0),
    "return_60d": (-1.0, 10.0),
    "return_3d_zscore": (-10.0, 10.0),
    "volume_ratio_20d": (0.0, 100.0),
    "close_above_sma_200": (0.0, 1.0),
    "close_breaks_high_20d": (0.0, 1.0),
}


@dataclass(frozen=True)
class Rule:
    feature: str
    op: str
    value: float | str


def parse_rules(conditions) -> list[Rule] | None:
    """Rules of a list of mappings, or of a mapping by feature (bad entries are skipped).

    A list entry without feature or operator gives None: no event can match.
    """
    if isinstance(conditions, dict):
        return [Rule(f, c["operator"], c["value"]) for f, c in conditions.items() if isinstance(c, dict) and {"operator", "value"} <= set(c)]
    if not isinstance(conditions, (list, tuple)):
        return None
    if any(isinstance(c, dict) and not {"feature", "operator"} <= set(c) for c in conditions):
        return None
    return [c if isinstance(c, Rule) else Rule(c["feature"], c["operator"], c.get("value")) for c in conditions]


def range_errors(conditions) -> list[str]:
    """What a configuration's thresholds violate; unknown features and texts pass."""
    out = []
    for r in parse_rules(conditions) or []:
        if r.feature in FEATURE_RANGES and isinstance(r.value, (int, float)):
            low, high = FEATURE_RANGES[r.feature]
            if not low <= r.value <= high:
                out.append(f"{r.feature} {r.op} {r.value}: outside [{low}, {high}]")
    return out


def compile_rule(r: Rule) -> Column:
    """A missing feature satisfies ``!=`` and no other operator."""
    if r.op not in OPERATORS:
        raise ValueError(f"unknown operator {r.op!r}")
    if r.op == "!=":
        return ~F.col(r.feature).eqNullSafe(F.lit(r.value))
    return F.coalesce(OPERATORS[r.op](F.col(r.feature), F.lit(r.value)), F.lit(False))


def event_mask(df: DataFrame, conditions) -> Column:
    """The conjunction of all rules; no rules match all, an unknown column none."""
    rules = parse_rules(conditions)
    if rules is None or any(r.feature not in df.columns for r in rules):
        return F.lit(False)
    return reduce(operator.and_, map(compile_rule, rules), F.lit(True))


def cooldown(signals: DataFrame, sessions: int) -> DataFrame:
    """The first signal of a ticker, and each one more than ``sessions`` after the last kept.

    Keeping depends on what was kept before, so the sorted signals of a ticker
    are folded. Signals more than ``sessions`` after the one before them are
    always kept whatever came before: they cut a ticker into chains that fold
    apart, so no task holds more than a chain. Rows travel whole, and nothing
    is joined back. Needs (ticker, pos), and keeps all columns.
    """
    by = W.partitionBy("ticker").orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(by)
    chained = signals.withColumn("__new", F.coalesce(gap > sessions, F.lit(True)).cast("int"))
    chained = chained.withColumn("__chain", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    rest = [c for c in signals.columns if c not in ("ticker", "pos")]
    folded = chained.groupBy("ticker", "__chain").agg(F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("p"))
    keep = F.aggregate("p", F.slice("p", 1, 0), lambda kept, x: F.when((F.size(kept) == 0) | (x["pos"] - F.try_element_at(kept, F.lit(-1))["pos"] > sessions), F.concat(kept, F.array(x))).otherwise(kept))
    return folded.select("ticker", F.explode(keep).alias("k")).select("ticker", "k.*").select(*signals.columns)


def cooldowns(signals: DataFrame, sessions: tuple[int, ...]) -> DataFrame:
    """``cooldown`` for several lengths at once, as (ticker, pos, cooldown), without a fold.

    Each signal points to the first one more than the cooldown after it. A
    signal so far from the one before it is kept whatever came before, and what
    is kept after it is what its pointers reach: rounds of doubling, in which
    the pointers of a round lead twice as far as those of the round before. So
    a chain of n signals takes log2(n) joins, and no task holds one.
    """
    own = signals.select("ticker", "pos").distinct()
    lengths = own.withColumn("cooldown", F.explode(F.array(*map(F.lit, sorted(set(sessions))))))
    keys = ["ticker", "cooldown"]
    by = W.partitionBy(*keys).orderBy("pos")
    # Heads: more than the cooldown after the signal before.
    lengths = lengths.withColumn("head", F.coalesce(F.col("pos") - F.lag("pos").over(by) > F.col("cooldown"), F.lit(True)))
    # Every signal asks for the first signal at pos + cooldown + 1 or later: read backwards, the last one seen.
    asks = lengths.select(*keys, (F.col("pos") + F.col("cooldown") + 1).alias("at"), F.lit(0).alias("kind"), F.col("pos").alias("own"), F.lit(None).cast("boolean").alias("head"))
    seen = lengths.select(*keys, F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("own"), "head")
    backwards = W.partitionBy(*keys).orderBy(F.desc("at"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    found = F.last(F.when(F.col("kind") == 1, F.struct("at", "head")), ignorenulls=True).over(backwards)
    steps = asks.unionByName(seen).withColumn("to", found).where("kind = 0").select(*keys, F.col("own").alias("pos"), F.when(~F.col("to.head"), F.col("to.at")).alias("next"))
    # A pointer to a head leads to what is kept anyway.
    steps = materialize(steps.where("next is not null"), "steps")
    kept = materialize(lengths.where("head").select(*keys, "pos"), "kept")
    while not steps.isEmpty():
        reached = kept.join(steps, [*keys, "pos"]).select(*keys, F.col("next").alias("pos"))
        more = materialize(kept.unionByName(reached), "kept")
        second = steps.select(*keys, F.col("pos").alias("next"), F.col("next").alias("then"))
        twice = materialize(steps.join(second, [*keys, "next"]).select(*keys, "pos", F.col("then").alias("next")), "steps")
        discard(kept)
        discard(steps)
        kept, steps = more, twice
    return kept.select("ticker", "pos", "cooldown")


def detect(df: DataFrame, conditions, sessions: int = 10, min_events: int = 1) -> DataFrame:
    """Rows of ``df`` that are events; tickers with fewer than ``min_events`` have none."""
    kept = cooldown(df.where(event_mask(df, conditions)), sessions)
    if min_events > 1:
        kept = kept.withColumn("__n", F.count("*").over(W.partitionBy("ticker"))).where(F.col("__n") >= min_events).drop("__n")
    return kept


def overlap(df: DataFrame, conditions, sessions: int = 10) -> DataFrame:
    """Per ticker: signals, events kept after cooldown, and the share removed in percent."""
    signals = df.where(event_mask(df, conditions)).select("ticker", "pos")
    kept = cooldown(signals, sessions).groupBy("ticker").agg(F.count("*").alias("n_kept"))
    raw = signals.groupBy("ticker").agg(F.count("*").alias("n_raw"))
    return raw.join(kept, "ticker", "left").select("ticker", "n_raw", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), (100.0 * (F.col("n_raw") - F.coalesce("n_kept", F.lit(0))) / F.col("n_raw")).alias("removed_pct"))


def recent(events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return events.where(F.col("session") >= F.date_sub(as_of, days))


def targets_only(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows of the universe's targets; indexes (``^``) are never targets."""
    return df.where(~F.col("ticker").startswith("^")).join(universe.where("role = 'target'").select("ticker"), "ticker", "left_semi")


def grid(df: DataFrame, cells: list[tuple[str, list[Rule]]], sessions: int, price: str | None = None, horizon: int = 5) -> DataFrame:
    """Signals and events of every cell of a parameter grid, in one pass over the features.

    Cells without signals have zeros. With ``price`` also the metric of each
    cell: the mean return, close to close, ``horizon`` sessions after its events.
    """
    from .trades import forward_return

    ret = forward_return(F.col(price), horizon) if price else F.lit(None).cast("double")
    tagged = df.withColumn("__ret", ret).select("ticker", "pos", "__ret", F.explode(F.array_compact(F.array(*[F.when(event_mask(df, rules), F.lit(name)) for name, rules in cells]))).alias("cell"))
    one = tagged.select(F.concat_ws("\x1f", "cell", "ticker").alias("ticker"), "pos", "__ret")
    kept = cooldown(one, sessions).groupBy(F.substring_index("ticker", "\x1f", 1).alias("cell")).agg(F.count("*").alias("n_events"), F.avg("__ret").alias("metric"))
    raw = tagged.groupBy("cell").agg(F.count("*").alias("n_signals"))
    names = df.sparkSession.createDataFrame([(name,) for name, _ in cells], "cell string")
    out = names.join(raw, "cell", "left").join(kept, "cell", "left").na.fill(0, ["n_signals", "n_events"])
    return out if price else out.drop("metric")
