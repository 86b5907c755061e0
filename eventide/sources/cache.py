"""A cache of daily bars that fetches and rewrites no more than what is missing.

Under one path of a shared store lie

* ``bars``: Parquet, partitioned by year and by a bucket of tickers (a hash),
  so files stay large however many tickers there are,
* ``coverage``: the days of each ticker that have been asked for, as intervals
  (a day without a bar, such as a holiday, is covered as well),
* ``digests``: rows and digest of each (ticker, month): the leaves of a hash
  tree whose root is one digest a ticker.

A request is compared with the coverage by interval difference. Only the gaps
are fetched, only the partitions that they touch are written again (by dynamic
partition overwrite), and a stored month whose digest is not the recorded one
counts as missing. Coverage and digests are written after the bars, under a
new name each time, and a pointer names the current ones: a run that dies
leaves the earlier state, and what it wrote in between is found by its digest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import intervals
from .market import BARS_SCHEMA, row_hash
from .tables import delete, discard, materialize

VERSION = 3
RANGES = "ticker string, start date, end date"
DIGESTS = "ticker string, month string, n_rows long, digest string"
_STATE = "version int, source string, buckets int, coverage string, digests string"
_FIELDS = [f.split() for f in BARS_SCHEMA.split(", ")]
_LAYOUT = ["bucket", "year"]


def month() -> Column:
    return F.date_format("session", "yyyy-MM")


def digests(bars: DataFrame) -> DataFrame:
    """(ticker, month, n_rows, digest): independent of the order of rows, and partial sums are made where the rows are."""
    rows = bars.select("ticker", month().alias("month"), row_hash(bars.columns).alias("h"))
    sums = rows.groupBy("ticker", "month").agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    return sums.select("ticker", "month", "n_rows", F.sha2(F.concat_ws("|", "n_rows", "x", F.col("s").cast("string")), 256).alias("digest"))


def roots(leaves: DataFrame) -> DataFrame:
    """(ticker, n_rows, digest): the upper level of the tree, over a ticker's months in order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("month", "digest"))), lambda m: F.concat_ws("|", m["month"], m["digest"]))
    return leaves.groupBy("ticker").agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(listed, "\n"), 256).alias("digest"))


def changed(leaves: DataFrame, recorded: DataFrame) -> DataFrame:
    """(ticker, month) of the months that differ, or that only one side has.

    Roots are compared first, so tickers without a change are not looked into.
    """
    differ = roots(leaves).alias("a").join(roots(recorded).alias("b"), "ticker", "full").where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select("ticker")
    a, b = (t.join(differ, "ticker", "left_semi") for t in (leaves, recorded))
    return a.alias("a").join(b.alias("b"), ["ticker", "month"], "full").where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select("ticker", "month")


def _days(months: DataFrame) -> DataFrame:
    first = F.to_date(F.concat("month", F.lit("-01")))
    return months.select("ticker", first.alias("start"), F.last_day(first).alias("end"))


class BarCache:
    """Bars of one source under ``path``; ``buckets`` holds for a new cache, an old one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, source: str, buckets: int = 16) -> None:
        self.spark, self.path, self.source, self._buckets = spark, path.rstrip("/"), source, buckets

    def _state(self) -> dict:
        try:
            at = self.spark.read.schema(_STATE).json(f"{self.path}/state").first()
        except AnalysisException:
            at = None
        state = at.asDict() if at is not None and at["version"] == VERSION else {"buckets": self._buckets}
        # Bars of another source are in the way of no one: without records all their months count as missing.
        return state if state.get("source") == self.source else {"buckets": state["buckets"]}

    def _table(self, name: str | None, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], schema)

    def _bars(self) -> DataFrame:
        schema = f"{BARS_SCHEMA}, bucket int, year int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/bars")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _placed(self, rows: DataFrame, day: str, buckets: int) -> DataFrame:
        return rows.withColumns({"bucket": F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int"), "year": F.year(day)})

    def coverage(self) -> DataFrame:
        """(ticker, start, end) that have been asked for."""
        return self._table(self._state().get("coverage"), RANGES)

    def _covered(self, tickers: DataFrame) -> DataFrame:
        return self.coverage().join(tickers, "ticker", "left_semi").select("ticker", "start", "end")

    def recorded(self) -> DataFrame:
        """(ticker, month, n_rows, digest) as written."""
        return self._table(self._state().get("digests"), DIGESTS)

    def _stored(self, tickers: DataFrame) -> DataFrame:
        own = tickers.withColumn("bucket", F.pmod(F.xxhash64("ticker"), F.lit(self._state()["buckets"])).cast("int"))
        return self._bars().join(own, ["bucket", "ticker"], "left_semi").select(*[n for n, _ in _FIELDS])

    def damaged(self, tickers: DataFrame) -> DataFrame:
        """(ticker, month) of stored months of some tickers that are not as recorded."""
        return changed(digests(self._stored(tickers)), self.recorded().join(tickers, "ticker", "left_semi"))

    def missing(self, wanted: DataFrame) -> DataFrame:
        """(ticker, start, end) that must be fetched for ``wanted``."""
        tickers = wanted.select("ticker").distinct()
        sound = intervals.difference(self._covered(tickers), _days(self.damaged(tickers)), ["ticker"])
        return intervals.difference(wanted, sound, ["ticker"])

    def refresh(self, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The gaps (ticker, start, end) that had to be fetched; the cache then covers ``wanted``.

        ``fetch`` gets the gaps and returns bars; rows outside them are ignored,
        and of several rows for a session one stays.
        """
        tickers = wanted.select("ticker").distinct()
        state = self._state()
        broken = materialize(self.damaged(tickers), "damaged")
        sound = materialize(intervals.difference(self._covered(tickers), _days(broken), ["ticker"]), "sound")
        gaps = materialize(intervals.difference(wanted, sound, ["ticker"]), "gaps")
        if gaps.isEmpty():
            return gaps
        got = fetch(gaps)
        fresh = intervals.within(got, gaps, ["ticker"]).select(*[(F.col(n) if n in got.columns else F.lit(None)).cast(t).alias(n) for n, t in _FIELDS])
        months = F.explode(F.sequence(F.trunc("start", "month"), F.col("end"), F.expr("INTERVAL 1 MONTH"))).alias("m")
        touched = materialize(self._placed(gaps.select("ticker", months), "m", state["buckets"]).withColumn("month", F.date_format("m", "yyyy-MM")).drop("m").distinct(), "touched")
        # What a touched partition holds of other tickers stays; of the wanted ones stays what is sound.
        old = self._bars().join(touched.select(*_LAYOUT).distinct(), _LAYOUT, "left_semi")
        kept = old.join(tickers, "ticker", "left_anti").unionByName(intervals.within(old, sound, ["ticker"]))
        rows = materialize(kept.unionByName(self._placed(fresh.dropDuplicates(["ticker", "session"]), "session", state["buckets"])), "rows")
        rows.repartition(*_LAYOUT).sortWithinPartitions(*_LAYOUT, "ticker", "session").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_LAYOUT).parquet(f"{self.path}/bars")
        for bucket, year in touched.select(*_LAYOUT).distinct().exceptAll(rows.select(*_LAYOUT).distinct()).toLocalIterator():
            delete(self.spark, f"{self.path}/bars/bucket={bucket}/year={year}")
        covered = intervals.union(sound.unionByName(wanted.select(*sound.columns)), ["ticker"])
        others = self.coverage().join(tickers, "ticker", "left_anti")
        leaves = digests(rows.select(*[n for n, _ in _FIELDS])).join(touched.select("ticker", "month"), ["ticker", "month"], "left_semi")
        self._record(state["buckets"], covered.unionByName(others), self.recorded().join(touched, ["ticker", "month"], "left_anti").unionByName(leaves.select("ticker", "month", "n_rows", "digest")))
        for t in (broken, sound, touched, rows):
            discard(t)
        return gaps

    def _record(self, buckets: int, covered: DataFrame, leaves: DataFrame) -> None:
        """Write coverage and digests beside the current ones, then point to them.

        Months that were not touched keep their record, damaged or not.
        """
        names = tuple(f"{kind}-{uuid.uuid4().hex}" for kind in ("coverage", "digests"))
        covered.write.parquet(f"{self.path}/{names[0]}")
        leaves.write.parquet(f"{self.path}/{names[1]}")
        self.spark.createDataFrame([(VERSION, self.source, buckets, *names)], _STATE).coalesce(1).write.mode("overwrite").json(f"{self.path}/state")

    def read(self, wanted: DataFrame) -> DataFrame:
        """Stored bars of the wanted days, and no others."""
        return intervals.within(self._stored(wanted.select("ticker").distinct()), wanted, ["ticker"])

    def get(self, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Bars of the wanted days; what the cache does not have is fetched first."""
        self.refresh(wanted, fetch)
        return self.read(wanted)


def fetch_from(bars: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetch that reads the gaps from a table of bars."""
    return lambda gaps: intervals.within(bars, gaps, ["ticker"])
