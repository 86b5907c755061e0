"""Files of a finished experiment: tables, a summary and the run's metadata."""

from __future__ import annotations

import hashlib
import json
import math
import os
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators import costs

from .experiment import Experiment, Study

#: Tables with a row per trade are written by Spark; the others are small and written as one CSV.
LARGE = ("canonical_trades",)


def number(x: float | None, digits: int = 2) -> str:
    return "—" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.{digits}f}"


def markdown(df: DataFrame, columns: list[str]) -> str:
    """A small table as Markdown, in the order of its columns."""
    rows = df.select(*columns).orderBy(*columns).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(number(v) if isinstance(v, float) or v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines)


def metadata(e: Experiment, study: Study, decision: tuple[str, str], configs: dict[str, str]) -> dict:
    """What it takes to repeat the run; ``configs``: name to text."""
    b = study.bounds.first().asDict()
    n = study.enriched.groupBy("temporal_split").count().collect()
    return {
        "event": e.event_id, "decision": decision[0], "reason": decision[1], "horizons": list(e.horizons), "cooldown_sessions": e.cooldown_sessions, "seed": 42,
        "bounds": {k: str(v) for k, v in b.items()}, "trades_by_split": {r["temporal_split"]: r["count"] for r in n}, "n_events": study.events.count(),
        "configs": {k: hashlib.sha256(v.encode()).hexdigest() for k, v in configs.items()}, "written_at": datetime.now(timezone.utc).isoformat(), "semantics": vars(e.semantics),
    }


def write(e: Experiment, study: Study, decision: tuple[str, str], folder: str, configs: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Writes everything under ``folder`` and returns the tables."""
    os.makedirs(folder, exist_ok=True)
    tables = study.tables() | {"events": study.events.select("ticker", "session", "pos")}
    tables["robustness"] = robustness_rows(tables)
    for name, df in tables.items():
        (df if name in LARGE else df.coalesce(1)).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    for name, what in (("metadata", metadata(e, study, decision, configs or {})), ("metrics", metrics_json(tables))):
        with open(f"{folder}/{name}.json", "w") as f:
            json.dump(what, f, indent=2, default=str)
    with open(f"{folder}/summary.md", "w") as f:
        f.write(summary(e, tables, decision, costs.cost_table(study.enriched.sparkSession)))
    return tables


def robustness_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(test, horizon, part, measure, value): all robustness tests in one long table."""

    def long(name: str, df: DataFrame, part: Column, measures: list[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        return df.select(F.lit(name).alias("test"), "horizon", part.cast("string").alias("part"), F.explode(pairs).alias("m")).select("test", "horizon", "part", "m.measure", "m.value")

    none = F.lit(None)
    out = long("bootstrap", tables["bootstrap"], none, ["mean", "ci_lower", "ci_upper", "std_error"])
    out = out.unionByName(long("gross_bootstrap", tables["gross_bootstrap"], none, ["mean", "ci_lower", "ci_upper", "std_error"]))
    for name in ("loo_asset", "loo_year"):
        out = out.unionByName(long(name, tables[name], F.col("excluded"), ["n_events", "mean_return"]))
    return out.unionByName(long("concentration", tables["concentration"], F.col("best_asset"), ["best_trade_pct", "best_3_pct", "best_asset_pct", "n_trades", "n_assets"]))


def metrics_json(tables: dict[str, DataFrame]) -> dict:
    """Net, gross and split metrics and the baselines by horizon: tables of a few rows."""
    out: dict[str, dict] = {}
    for name in ("metrics", "gross_metrics", "weighted_baseline", "bootstrap"):
        for r in tables[name].collect():
            out.setdefault(f"horizon_{r['horizon']}d", {})[name] = {k: v for k, v in r.asDict().items() if k != "horizon"}
    for r in tables["split_metrics"].collect():
        out[f"horizon_{r['horizon']}d"].setdefault("splits", {})[r["temporal_split"]] = {k: v for k, v in r.asDict().items() if k not in ("horizon", "temporal_split")}
    return out


def summary(e: Experiment, tables: dict[str, DataFrame], decision: tuple[str, str], cost_table: DataFrame | None = None) -> str:
    parts = [f"# {e.event_id}", f"**{decision[0]}**: {decision[1]}", f"Primary horizon: {e.primary_horizon or e.horizons[0]} sessions"]
    parts += ["## Net metrics", markdown(tables["metrics"], ["horizon", "n_events", "mean", "median", "win_rate", "profit_factor"]), "## Gross metrics", markdown(tables["gross_metrics"], ["horizon", "n_events", "mean", "median", "win_rate"])]
    parts += ["## By split", markdown(tables["split_metrics"], ["horizon", "temporal_split", "n_events", "mean", "median"])]
    parts += ["## Baselines", markdown(tables["weighted_baseline"], ["horizon", "unconditional", "exact_matched_mean", "trend_only_mean", "benchmark", "n_events", "n_valid", "n_low_confidence", "n_insufficient", "valid_pct"])]
    parts += ["## Bootstrap", markdown(tables["bootstrap"], ["horizon", "mean", "ci_lower", "ci_upper", "std_error"])]
    if cost_table is not None:
        parts += ["## Costs", markdown(cost_table.select("market", (F.col("per_side") * 100).alias("per_side_pct"), (F.col("roundtrip") * 100).alias("roundtrip_pct")), ["market", "per_side_pct", "roundtrip_pct"])]
    parts += ["## Concentration", markdown(tables["concentration"], ["horizon", "best_trade_pct", "best_3_pct", "best_asset", "best_asset_pct", "status"])]
    for name, title in (("loo_asset", "Without one asset"), ("loo_year", "Without one year")):
        parts += [f"## {title}", markdown(tables[name], ["horizon", "excluded", "n_events", "mean_return"])]
    return "\n\n".join(parts) + "\n"


def catalogue(folder: str) -> list[dict]:
    """Experiments declared under a folder: id, family, description, path and conditions."""
    import yaml

    out = []
    for at, _, names in sorted(os.walk(folder)):
        for name in sorted(n for n in names if n.endswith((".yaml", ".yml"))):
            with open(f"{at}/{name}") as f:
                c = yaml.safe_load(f) or {}
            about, event = c.get("experiment") or c, c.get("event") or c
            out.append({"id": about.get("id", name), "family": about.get("family"), "description": about.get("description"), "path": f"{at}/{name}", "conditions": event.get("conditions")})
    return out
