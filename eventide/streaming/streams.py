"""Streaming forms: daily bars behind a watermark, cooldown with state, a ledger by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventide.sources.tables import shared_dir


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet file, or the files of a folder in their order of time, as a stream."""
    schema = spark.read.parquet(path).schema
    read = spark.readStream.schema(schema)
    if files_per_batch:
        read = read.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    return read.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else read.parquet(path)


def tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """The recorded ticks as a stream; watermarks need a timestamp with a zone."""
    e = event_stream(spark, path)
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("last"), "event_id")


def daily_bars(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """Bars per day; a day is emitted when the watermark has passed it."""
    o = F.struct("ts", "event_id")
    w = ticks.where("last is not null").withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "symbol")
    bars = w.agg(F.min_by("last", o).alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", o).alias("close"), F.count("*").alias("n_ticks"))
    return bars.select("symbol", F.to_date(F.col("window.start")).alias("day"), "open", "high", "low", "close", "n_ticks")


def cooldown(signals: DataFrame, sessions: int) -> DataFrame:
    """The greedy cooldown over (ticker, pos) rows; the state is the last position kept."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for p in sorted(x for pdf in batches for x in pdf["pos"].tolist()):
            if last is None or p - last > sessions:
                out.append(p)
                last = p
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"ticker": [key[0]] * len(out), "pos": out})

    return signals.groupBy("ticker").applyInPandasWithState(keep, "ticker string, pos long", "last long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into Parquet, and reads the result."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def each_batch(stream: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hands every micro-batch to ``fold``, such as a ledger's merge of positions; returns the ended query."""
    q = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def replay_daily_bars(spark: SparkSession, path: str) -> DataFrame:
    """The recorded ticks replayed as a stream; each batch writes all bars so far, so the last one has every day."""
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    bars, done = daily_bars(tick_stream(spark, path)), []

    def fold(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/bars/{batch}")
        done.append(batch)

    each_batch(bars, fold, f"{at}/checkpoint", "complete")
    return spark.read.schema(bars.schema).parquet(f"{at}/bars/{max(done)}") if done else spark.createDataFrame([], bars.schema)
