"""Landed answers of market services as a data source: quotes and trades.

A fetcher drops a service's JSON answers, one a line, under folders
``ticker=GGAL.BA/year=2024/…`` (trades: ``symbol=…/year=…``); the year level may
be left out. ``spark.read.format("landed_quotes").load(path)`` reads them with
filters pushed down: a condition on the symbol lists and opens that symbol's
folders only, and conditions on the day leave out the years beyond them. Files
are bundled into partitions by size, so neither a great many small answers nor
one large symbol makes an odd task; a partition is read file by file.

Answers may be flat (parallel arrays by time), as charting services nest them
(``chart.result[].indicators``), or lists of records. The symbol is the
folder's. Days are UTC days, as time stamps are seconds or text with an offset.
What is no answer gives no rows, or an error with option ``mode`` FAILFAST.

Files are opened by Arrow's file systems (local, HDFS, S3, GCS) on executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of the files that one partition reads.
BUNDLE_BYTES = 32 << 20
PRICES = ("open", "high", "low", "close", "adj_close", "volume")
QUOTES = "ticker string, session date, " + ", ".join(f"{c} double" for c in PRICES)
TRADES = "symbol string, trade_date timestamp, price double, volume double, buy_or_sell string"
#: Other names that services have for a column.
NAMES = {"adj_close": ("adj_close", "adjclose", "adjClose"), "volume": ("volume", "size"), "buy_or_sell": ("buy_or_sell", "side", "buyOrSell"), "time": ("timestamp", "datetime", "date", "session")}


def _pick(record: dict, name: str):
    return next((record[n] for n in NAMES.get(name, (name,)) if record.get(n) is not None), None)


def _number(x) -> float | None:
    try:
        y = float(x)
    except (TypeError, ValueError):
        return None
    return y if y == y else None


def _time(x) -> datetime | None:
    """Seconds since 1970, or text with or without an offset (then UTC)."""
    try:
        if isinstance(x, (int, float)):
            return datetime.fromtimestamp(x, timezone.utc)
        t = datetime.fromisoformat(str(x).strip().replace("Z", "+00:00"))
        return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)
    except (TypeError, ValueError, OverflowError, OSError):
        return None


def _columns(answer: dict) -> list[dict]:
    """Parallel arrays as records."""
    times = _pick(answer, "time") or []
    arrays = {c: _pick(answer, c) or [] for c in PRICES}
    return [{"timestamp": t} | {c: v[i] for c, v in arrays.items() if i < len(v)} for i, t in enumerate(times)]


def quote_records(answer) -> list[dict]:
    """The records of an answer of any known shape."""
    if isinstance(answer, list):
        return [r for r in answer if isinstance(r, dict)]
    if isinstance(answer.get("chart"), dict):
        out = []
        for r in answer["chart"].get("result") or []:
            parts = r.get("indicators") or {}
            flat = {"timestamp": r.get("timestamp")}
            for kind in ("quote", "adjclose"):
                flat |= ((parts.get(kind) or [None])[0]) or {}
            out += _columns(flat)
        return out
    listed = next((answer[k] for k in ("quotes", "prices") if isinstance(answer.get(k), list)), None)
    return quote_records(listed) if listed is not None else _columns(answer)


def _quotes(symbol: str, answer) -> Iterator[tuple]:
    for r in quote_records(answer):
        t = _time(_pick(r, "time"))
        values = {c: _number(_pick(r, c)) for c in PRICES}
        if t is not None and values["close"] is not None:
            values["adj_close"] = values["close"] if values["adj_close"] is None else values["adj_close"]
            yield symbol, t.date(), *values.values()


def _trades(symbol: str, answer) -> Iterator[tuple]:
    for r in answer.get("trades") or [] if isinstance(answer, dict) else answer:
        yield symbol, _time(_pick(r, "time")), _number(_pick(r, "price")), _number(_pick(r, "volume")), _pick(r, "buy_or_sell")


@dataclass
class Files(InputPartition):
    """(path, symbol) of the files of one partition."""

    files: tuple[tuple[str, str], ...]


class LandedReader(DataSourceReader):
    #: By source: the column of the symbol, that of the day, and how an answer is read.
    KINDS = {"landed_quotes": ("ticker", "session", _quotes), "landed_trades": ("symbol", "trade_date", _trades)}

    def __init__(self, kind: str, schema: pa.Schema, options: dict) -> None:
        self.key, self.day, self.parse = self.KINDS[kind]
        self.path, self.strict, self.arrow = options["path"], options.get("mode", "").upper() == "FAILFAST", schema
        self.symbols: set[str] | None = None
        self.years = (date.min.year, date.max.year)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the symbol are kept here; those on the day bound the years and are checked again by Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == (self.key,) and isinstance(f, (EqualTo, EqualNullSafe, In)):
                own = set(f.value) if isinstance(f, In) else {f.value}
                self.symbols = own if self.symbols is None else self.symbols & own
                continue
            if column == (self.day,) and isinstance(getattr(f, "value", None), date):
                first, last = self.years
                if isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual)):
                    first = max(first, f.value.year)
                if isinstance(f, (EqualTo, EqualNullSafe, LessThan, LessThanOrEqual)):
                    last = min(last, f.value.year)
                self.years = (first, last)
            yield f

    def _folders(self, store: fs.FileSystem, root: str) -> Iterator[tuple[str, str]]:
        """(folder, symbol) of the symbols asked for; of all, if none are named."""
        if self.symbols is None:
            for x in store.get_file_info(fs.FileSelector(root)):
                if x.type == fs.FileType.Directory and x.base_name.startswith(f"{self.key}="):
                    yield x.path, unquote(x.base_name.split("=", 1)[1])
            return
        for symbol in sorted(s for s in self.symbols if s is not None):
            # Writers escape different characters of a folder's name.
            for name in dict.fromkeys((symbol, quote(symbol, safe=" .-_^+,()@$&;~!"), quote(symbol, safe=""))):
                if "/" not in name and store.get_file_info(f"{root}/{self.key}={name}").type == fs.FileType.Directory:
                    yield f"{root}/{self.key}={name}", symbol
                    break

    def partitions(self) -> list[InputPartition]:
        store, root = _store(self.path)
        found = []
        for folder, symbol in self._folders(store, root):
            for x in store.get_file_info(fs.FileSelector(folder, recursive=True)):
                levels = x.path[len(folder) :].strip("/").split("/")
                hidden = any(part.startswith(("_", ".")) for part in levels)
                years = [int(part[5:]) for part in levels if part.startswith("year=") and part[5:].isdigit()]
                if x.type == fs.FileType.File and not hidden and all(self.years[0] <= y <= self.years[1] for y in years):
                    found.append((x.path, symbol, x.size or 0))
        bundles: list[list[tuple[str, str]]] = []
        total = BUNDLE_BYTES
        for path, symbol, size in sorted(found):
            if total + size > BUNDLE_BYTES:
                bundles.append([])
                total = 0
            bundles[-1].append((path, symbol))
            total += size
        return [Files(tuple(b)) for b in bundles] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for path, symbol in partition.files:
            with store.open_input_stream(path) as stream:
                for line in stream.read().split(b"\n"):
                    rows = list(self._rows(symbol, line, path)) if line.strip() else []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.arrow)], schema=self.arrow)

    def _rows(self, symbol: str, line: bytes, path: str) -> list[tuple]:
        try:
            return list(self.parse(symbol, json.loads(line)))
        except (ValueError, AttributeError, TypeError, KeyError) as e:
            if self.strict:
                raise ValueError(f"no answer of a market service in {path}") from e
            return []


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store, root.rstrip("/")


class LandedQuotes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_quotes"

    def schema(self) -> str:
        return QUOTES

    def reader(self, schema) -> LandedReader:
        kinds = [pa.string(), pa.date32(), *[pa.float64()] * len(PRICES)]
        return LandedReader(self.name(), pa.schema(list(zip(schema.fieldNames(), kinds))), dict(self.options))


class LandedTrades(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_trades"

    def schema(self) -> str:
        return TRADES

    def reader(self, schema) -> LandedReader:
        kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.float64(), pa.float64(), pa.string()]
        return LandedReader(self.name(), pa.schema(list(zip(schema.fieldNames(), kinds))), dict(self.options))


def landed(spark: SparkSession, path: str, kind: str = "quotes", **options: str) -> DataFrame:
    """Landed ``quotes`` or ``trades`` under a path; filters on what is returned reach the files.

    Spark keeps what a filter on a Python source has pushed, and gives it to a
    later query on the same frame that has no filter of its own. The condition
    added here is always pushed, so every query starts from all files.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (LandedQuotes, LandedTrades):
        spark.dataSource.register(source)
    return spark.read.format(f"landed_{kind}").options(**options).load(path).where(F.col(LandedReader.KINDS[f"landed_{kind}"][0]).isNotNull())
