"""Fills on streams: orders meet the quotes that follow them while both arrive.

Orders and quotes are joined as two streams by symbol and time bucket, with an
interval condition on their times. Both sides have a watermark, so an order is
forgotten once no quote of its interval can still come, and a quote once no
order can ask for it: the state holds some intervals and not the history. The
bucket in the key spreads a busy symbol over tasks.

A micro-batch keeps one quote an order, the first it has seen, in a partition
of its own that a repeated batch overwrites. The least of these is the fill,
since the first of firsts is the first of all. It may still move to an earlier
quote that comes late, until the watermark has passed its interval.

Orders without a quote have null fills, as in the batch form. Rows whose
symbol or time is null meet nothing. Rows later than the watermark are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.ticks import long_trades
from eventide.sources.tables import materialize, shared_dir

from .streams import each_batch

def candidates(orders: DataFrame, quotes: DataFrame, side: str, tolerance_s: int, late: str = "1 day") -> DataFrame:
    """(symbol, at, quote) for every positive quote of ``side`` within the tolerance of a streamed order (symbol, at)."""
    bucket = lambda c: F.floor(F.unix_timestamp(c) / tolerance_s)
    o = orders.select("symbol", "at", F.col("at").cast("timestamp").alias("__o")).withWatermark("__o", late)
    o = o.withColumn("__b", F.explode(F.array(bucket(F.col("__o")), bucket(F.col("__o")) + 1)))
    q = quotes.where(F.col(side) > 0).select(F.col("symbol").alias("__s"), F.col("ts").cast("timestamp").alias("__q"), F.struct("ts", "event_id", F.col(side).alias("price")).alias("quote")).withWatermark("__q", late)
    q = q.withColumn("__c", bucket(F.col("__q")))
    span = F.make_dt_interval(secs=F.lit(float(tolerance_s)))
    exact = (F.col("quote.ts") >= F.col("at")) & (F.col("quote.ts") <= F.col("at") + span)
    # Event times follow the session's zone, so the state's bounds leave room for a shifted clock.
    shift = F.expr("INTERVAL 2 HOURS")
    bounds = (F.col("__q") >= F.col("__o") - shift) & (F.col("__q") <= F.col("__o") + span + shift)
    return o.join(q, (F.col("symbol") == F.col("__s")) & (F.col("__b") == F.col("__c")) & exact & bounds).select("symbol", "at", "quote")


def first_quote(orders: DataFrame, quotes: DataFrame, side: str, at: str, tolerance_s: int, price: str, when: str, late: str = "1 day", progress: list | None = None) -> DataFrame:
    """``operators.ticks.first_quote`` with ``quotes`` as a stream: runs over what is there and adds the fills.

    ``progress`` takes the reports of the micro-batches.
    """
    spark = orders.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fills-{uuid.uuid4().hex}"
    wanted = materialize(orders.select("symbol", F.col(at).alias("at")).distinct(), "orders")
    hits = candidates(spark.readStream.schema(wanted.schema).parquet(wanted._eventide_path), quotes, side, tolerance_s, late)
    least = lambda df: df.groupBy("symbol", "at").agg(F.min("quote").alias("quote"))
    done = []

    def fold(df: DataFrame, batch: int) -> None:
        least(df).write.mode("overwrite").parquet(f"{path}/found/batch={batch}")
        done.append(batch)

    query = each_batch(hits, fold, f"{path}/checkpoint")
    if progress is not None:
        progress.extend(query.recentProgress)
    found = spark.read.schema(hits.schema).parquet(f"{path}/found") if done else spark.createDataFrame([], hits.schema)
    fill = least(found).select(F.col("symbol").alias("__s"), F.col("at").alias("__at"), F.col("quote.price").alias(price), F.col("quote.ts").alias(when))
    return orders.join(fill, (F.col("symbol") == F.col("__s")) & (F.col(at) == F.col("__at")), "left").drop("__s", "__at")


def replay_long_trades(signals: DataFrame, quotes: DataFrame, horizons: tuple[int, ...], **options) -> DataFrame:
    """``operators.ticks.long_trades`` over a stream of quotes: entries are filled first, and their exits are the next orders."""
    return long_trades(signals, quotes, horizons, fill=first_quote, **options)
