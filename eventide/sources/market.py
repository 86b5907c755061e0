"""Market tables: readers, and the stand-ins that the test tables give."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BARS_SCHEMA = "ticker string, session date, open double, high double, low double, close double, adj_close double, volume double"
CACHE_VERSION = 2


def number(c: str) -> Column:
    """A price that may arrive as text; what is no number, and NaN, is NULL."""
    x = F.expr(f"try_cast(`{c}` as double)")
    return F.when(~F.isnan(x), x)


# --- stand-ins ---------------------------------------------------------------


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per order priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _ohlc(o.groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("session")))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _ohlc(o.groupBy(F.to_date("o_orderdate").alias("session"))).withColumn("ticker", F.lit("^BENCH"))


def _ohlc(groups) -> DataFrame:
    p = "o_totalprice"
    return groups.agg(F.min_by(p, "o_orderkey").alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"))


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rate a session; sessions on every seventh day of a month are missing."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("session", F.to_date("l_shipdate"))
    cents = F.sum((F.col("l_extendedprice") * 100).cast("long"))
    return li.where(F.dayofmonth("session") % 7 != 0).groupBy("session").agg((cents / F.sum(F.col("l_quantity").cast("long")) / 100).alias("ccl"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_ticks(e: DataFrame) -> DataFrame:
    """Events, read or streamed, as ticks with quotes around their value."""
    k = F.col("event_id") % 7
    last = F.when(k != 3, F.col("value"))
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.when(k != 5, F.col("value") * 0.999).alias("bid"), F.when(k != 2, F.col("value") * 1.001).alias("ask"), last.alias("last"), F.col("event_id"))


# --- readers -----------------------------------------------------------------


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars from Parquet, ORC, JSON or CSV; a CSV needs a header."""
    reader = spark.read.schema(BARS_SCHEMA)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def adjusted(df: DataFrame) -> DataFrame:
    """Adds adjusted open, high and low by the factor adj_close / close."""
    df = df.withColumn("adj_close", F.coalesce("adj_close", "close") if "adj_close" in df.columns else F.col("close"))
    factor = F.col("adj_close") / F.nullif("close", F.lit(0.0))
    return df.withColumns({f"{c}_adj": F.col(c) * factor for c in ("open", "high", "low")})


def normalise_daily(df: DataFrame, layout: str = "stock_prices") -> DataFrame:
    """Two table layouts of a daily database to bars with numeric columns."""
    names = {"stock_prices": {"Ticker": "ticker", "Date": "session", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}, "prices": {"symbol": "ticker", "date": "session", "open": "open", "high": "high", "low": "low", "close": "close", "adj_close": "adj_close", "volume": "volume"}}[layout]
    own = {c.lower(): c for c in df.columns}
    found = {n: own[c.lower()] for c, n in names.items() if c.lower() in own}
    # A database's VARCHAR is a string already, and a cast of it would keep conditions from the scan.
    ticker = F.col(found["ticker"])
    ticker = ticker if isinstance(df.schema[found["ticker"]].dataType, StringType) else ticker.cast("string")
    out = [ticker.alias("ticker"), F.to_date(F.col(found["session"])).alias("session")]
    out += [number(found[n]).alias(n) for n in ("open", "high", "low", "close", "volume") if n in found]
    out.append(number(found.get("adj_close", found["close"])).alias("adj_close"))
    return df.select(*out)


def top_up(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored and fresh bars; of two for a session the fresh one stays."""
    both = stored.withColumn("__from", F.lit(0)).unionByName(fresh.withColumn("__from", F.lit(1)), allowMissingColumns=True)
    last = W.partitionBy("ticker", "session").orderBy(F.desc("__from"))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__from")


def dedupe_first(df: DataFrame, order: str) -> DataFrame:
    """The first row by ``order`` of each (ticker, session)."""
    first = W.partitionBy("ticker", "session").orderBy(order)
    return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def instrument_market(ticker: Column, registry: DataFrame | None = None) -> tuple[Column, Column]:
    """(market, currency) of a ticker that no registry holds."""
    local = ticker.endswith(".BA")
    return F.when(local, "argentina").otherwise("usa"), F.when(local, "ARS").otherwise("USD")


def resolve_instruments(df: DataFrame, registry: DataFrame) -> DataFrame:
    market, currency = instrument_market(F.col("ticker"))
    return df.join(registry, "ticker", "left").withColumns({"market": F.coalesce("market", market), "currency": F.coalesce("currency", currency)})


def synthetic_rate(local: DataFrame, foreign: DataFrame, ratio: float = 1.0, low: float = 10.0, high: float = 5000.0, carry: int = 5) -> DataFrame:
    """Rate implied by two listings of one share: plausible values, carried at most ``carry`` sessions."""
    a = local.select("session", F.col("close").alias("__a"))
    b = foreign.select("session", F.col("close").alias("__b"))
    rate = F.col("__a") * ratio / F.nullif("__b", F.lit(0.0))
    out = a.join(b, "session").select("session", F.when((rate > low) & (rate < high), rate).alias("ccl"))
    rows = W.partitionBy(F.lit(0)).orderBy("session").rowsBetween(-carry, 0)
    return out.withColumn("ccl", F.last("ccl", ignorenulls=True).over(rows)).where("ccl is not null")


def latest(df: DataFrame, key: str, order: str, n: int, tie: str) -> DataFrame:
    """The last ``n`` rows of each key."""
    rows = W.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("rank", F.row_number().over(rows)).where(F.col("rank") <= n)


def quoted(ticks_: DataFrame) -> DataFrame:
    """Ticks with a time and at least one of bid, ask and last."""
    return ticks_.where(F.coalesce("bid", "ask", "last").isNotNull() & F.col("ts").isNotNull())


def contracts(symbols: DataFrame, root: str) -> DataFrame:
    return symbols.where(F.col("symbol").startswith(f"{root}/")).select("symbol").distinct()


def resolve_contract(symbols: DataFrame, root: str) -> DataFrame:
    """The contract of ``root`` whose name sorts last."""
    return contracts(symbols, root).agg(F.max("symbol").alias("symbol"))


def landed_trades(lines: DataFrame, col: str = "value") -> DataFrame:
    """Trades from landed JSON answers of a trade-history service."""
    kind = "struct<symbol:string,trades:array<struct<datetime:string,price:double,size:double,side:string>>>"
    rows = lines.select(F.from_json(col, kind).alias("r")).select("r.symbol", F.explode("r.trades").alias("t"))
    return rows.select("symbol", F.try_to_timestamp(F.col("t.datetime")).alias("trade_date"), F.col("t.price").alias("price"), F.col("t.size").alias("volume"), F.col("t.side").alias("buy_or_sell"))


def between(df: DataFrame, start: str, end: str, col: str = "session") -> DataFrame:
    """Rows of the days from ``start`` to ``end``; the bounds reach the scan."""
    return df.where(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_table(spark: SparkSession, url: str, table: str, day: str | None = None, start: str | None = None, end: str | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A database table by JDBC; filters and columns of what follows are pushed down to it.

    With a date column ``day``, the table is read in ``parts`` ranges of days over
    ``start`` to ``end``, each by its own connection; rows outside the two (and
    without a day) are in the ranges at the ends, so none is lost.
    """
    read = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if day is not None and parts > 1:
        read = read.options(partitionColumn=day, lowerBound=start, upperBound=end, numPartitions=str(parts))
    return read.load()


def daily_bars(table: DataFrame, tickers: list[str], start: str, end: str, layout: str = "stock_prices") -> DataFrame:
    """Bars of some tickers and days of a daily database's table."""
    bars_ = normalise_daily(table, layout)
    return between(bars_.where(F.col("ticker").isin(tickers)), start, end)


def daily_rates(table: DataFrame, start: str, end: str) -> DataFrame:
    """Rates (session, ccl) of a table (date, ccl): numbers above zero."""
    return between(table.select(F.to_date("date").alias("session"), number("ccl").alias("ccl")), start, end).where("ccl > 0")


def load_rates(stored: DataFrame | None, local: DataFrame, foreign: DataFrame, start: str, end: str, ratio: float = 10.0) -> DataFrame:
    """Stored rates of the days, or where there are none the rates that two listings imply.

    Both are one plan: implied rates count only if no stored day is in range.
    """
    implied = between(synthetic_rate(local, foreign, ratio), start, end)
    if stored is None:
        return implied
    own = daily_rates(stored, start, end)
    none = own.agg(F.count("*").alias("__n")).where("__n = 0")
    return own.unionByName(implied.join(F.broadcast(none)).drop("__n"))


def list_instruments(table: DataFrame) -> DataFrame:
    """Every instrument of a futures database once."""
    return table.distinct()


def coerced_ticks(raw: DataFrame) -> DataFrame:
    """Ticks whose columns may be text: what is no number or no time is NULL; rows without time or quote go."""
    typed = raw.select("symbol", F.try_to_timestamp(F.col("ts").cast("string")).cast("timestamp_ntz").alias("ts"), *[number(c).alias(c) for c in ("bid", "ask", "last")], "event_id")
    return quoted(typed)


def latest_trades(trades: DataFrame, symbol: str, n: int = 100) -> DataFrame:
    """The last ``n`` trades of a symbol, newest first: a top-k."""
    return trades.where(F.col("symbol") == symbol).orderBy(F.desc("trade_date"), F.desc("event_id")).limit(n)


def recent_benchmark(table: DataFrame, ticker: str = "SPY", days: int = 300, layout: str = "stock_prices") -> DataFrame:
    """The last ``days`` sessions of the benchmark; its close is its adjusted close and its own base currency."""
    own = normalise_daily(table, layout).where(F.col("ticker") == ticker).orderBy(F.desc("session")).limit(days)
    prices = ("open", "high", "low", "close")
    return own.withColumns({"adj_close": F.col("close")} | {f"{c}_usd": F.col(c) for c in prices})


def landed_quotes(lines: DataFrame, col: str = "value") -> DataFrame:
    """Bars from landed JSON answers of a daily-quote service: a symbol and parallel arrays by time."""
    x = "array<double>"
    kind = f"struct<symbol:string,timestamp:array<bigint>,open:{x},high:{x},low:{x},close:{x},adjclose:{x},volume:{x}>"
    r = lines.select(F.from_json(col, kind).alias("r"))
    rows = r.select("r.symbol", F.explode(F.arrays_zip("r.timestamp", "r.open", "r.high", "r.low", "r.close", "r.adjclose", "r.volume")).alias("q"))
    day = F.to_date(F.timestamp_seconds("q.timestamp"))
    return rows.select(F.col("symbol").alias("ticker"), day.alias("session"), "q.open", "q.high", "q.low", "q.close", F.coalesce("q.adjclose", "q.close").alias("adj_close"), "q.volume").where("close is not null")


# --- cache -------------------------------------------------------------------


def row_hash(columns: list[str]) -> Column:
    """60 bits of a row's SHA-256. Cells go in with their lengths, so no two rows read alike."""
    cells = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (F.col(c).cast("string") for c in sorted(columns))]
    return F.conv(F.substring(F.sha2(F.concat(*cells), 256), 1, 15), 16, 10).cast("long")


def content_hash(df: DataFrame) -> str:
    """Order-independent digest of all rows: row hashes are summed and xor-ed."""
    half = row_hash(df.columns)
    r = df.agg(F.count("*").alias("n"), F.bit_xor(half).alias("x"), F.sum(half.cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{r['n']}|{r['x']}|{r['s']}".encode()).hexdigest()


#: The keys of a cache entry's description, which other readers expect.
MANIFEST_KEYS = ("ticker", "yf_ticker", "source", "requested_start", "requested_end", "downloaded_at", "first_available_date", "last_available_date", "n_rows", "auto_adjust", "schema_version", "content_sha256")


def cache_manifest(df: DataFrame, source: str, start: date, end: date, ticker: str | None = None, vendor_ticker: str | None = None) -> dict:
    r = df.agg(F.min("session").alias("a"), F.max("session").alias("b"), F.count("*").alias("n")).first()
    values = (ticker, vendor_ticker or ticker, source, str(start), str(end), datetime.now(timezone.utc).isoformat(), str(r["a"]), str(r["b"]), r["n"], False, CACHE_VERSION, content_hash(df))
    return dict(zip(MANIFEST_KEYS, values))


def cached(spark: SparkSession, path: str, source: str, start: date, end: date, fetch: Callable[[], DataFrame], ticker: str | None = None, refresh: bool = False) -> DataFrame:
    """Bars of a cache entry if it still answers the request, else fetched, written and described anew.

    Table and description lie under ``path`` in any store that Spark reads.
    """
    from pyspark.errors import AnalysisException

    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
        stored = spark.read.schema(BARS_SCHEMA).parquet(f"{path}/bars")
        if not refresh and cache_valid(manifest, stored, source, start, end)[0]:
            return stored
    except AnalysisException:
        pass
    fresh = fetch()
    have = set(fresh.columns)
    fields = [f.split() for f in BARS_SCHEMA.split(", ")]
    fresh.select(*[F.col(n).cast(t) if n in have else F.lit(ticker if n == "ticker" else None).cast(t).alias(n) for n, t in fields]).write.mode("overwrite").parquet(f"{path}/bars")
    stored = spark.read.schema(BARS_SCHEMA).parquet(f"{path}/bars")
    text = json.dumps(cache_manifest(stored, source, start, end, ticker))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return stored


def cache_valid(manifest: dict | None, df: DataFrame, source: str, start: date, end: date) -> tuple[bool, str]:
    """Whether a cached table still answers a request, and why not."""
    if not manifest:
        return False, "no manifest"
    if manifest.get("schema_version") != CACHE_VERSION:
        return False, "schema version"
    if manifest.get("source") != source:
        return False, "source"
    if str(start) < manifest["requested_start"] or str(end) > manifest["requested_end"]:
        return False, "coverage"
    return (True, "") if manifest.get("content_sha256") == content_hash(df) else (False, "content")


def save_json(path: str, what: dict) -> None:
    with open(path, "w") as f:
        json.dump(what, f, indent=2, default=str)


def load_json(path: str, default: dict | None = None) -> dict:
    """A saved state, or ``default`` where there is none."""
    import os

    if not os.path.exists(path):
        return dict(default or {"positions": [], "history": [], "last_scan": None})
    with open(path) as f:
        return json.load(f)
