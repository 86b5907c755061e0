"""Transaction costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Commission, fees, slippage per side, least round trip; by market.
COSTS = {"argentina": (0.0070, 0.0008, 0.0020, 0.015), "futures": (0.0015, 0.0003, 0.0005, 0.003), "usa": (0.0010, 0.0001, 0.0010, 0.0)}


def per_side(costs: dict = COSTS, market: str = "argentina") -> float:
    """An unknown market costs what the first one does."""
    a, b, c, _ = costs.get(market, costs["argentina"])
    return a + b + c


def roundtrip(costs: dict = COSTS, market: str = "argentina") -> float:
    return max(2 * per_side(costs, market), costs.get(market, costs["argentina"])[3] or 0.0)


def cost_table(spark: SparkSession, costs: dict = COSTS) -> DataFrame:
    rows = [(m, *map(float, c)) for m, c in costs.items()]
    df = spark.createDataFrame(rows, "market string, commission double, fees double, slippage double, least double")
    side = F.col("commission") + F.col("fees") + F.col("slippage")
    return df.withColumns({"per_side": side, "roundtrip": F.greatest(side * 2, F.coalesce("least", F.lit(0.0)))})


def net(gross: Column, roundtrip_: Column) -> Column:
    """Percent net of a round trip given as a fraction."""
    return gross - roundtrip_ * 100


def break_even(gross: Column, baseline: Column) -> Column:
    return F.greatest(F.lit(0.0), gross - baseline)


def summarise(costs: dict = COSTS, market: str = "argentina") -> dict[str, float]:
    """A market's costs in percent, rounded for reports."""
    c = costs.get(market, costs["argentina"])
    return {"commission_pct": round(c[0] * 100, 4), "fees_pct": round(c[1] * 100, 4), "slippage_pct": round(c[2] * 100, 4), "per_side_pct": round(per_side(costs, market) * 100, 2), "roundtrip_pct": round(roundtrip(costs, market) * 100, 2)}
