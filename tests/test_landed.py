"""Landed answers as a data source: shapes, pushed filters, odd files."""

import gzip
import json
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from eventide.sources import landed as src


def at(y, m, d, h=14):
    return int(datetime(y, m, d, h, tzinfo=timezone.utc).timestamp())


FLAT = {"symbol": "other", "timestamp": [at(2023, 3, 1), at(2023, 3, 2), at(2023, 3, 3)], "open": [1, 2, 3], "high": [2, 3, 4], "low": [0.5, 1, 2], "close": [1.5, None, 3.5], "volume": [10, 20]}
CHART = {"chart": {"error": None, "result": [{"meta": {}, "timestamp": [at(2024, 1, 2), at(2024, 1, 3, 23)], "indicators": {"quote": [{"open": [5, 6], "high": [7, 7], "low": [4, 5], "close": [6, 6.5], "volume": [1, 2]}], "adjclose": [{"adjclose": [3, None]}]}}]}}
LISTED = {"quotes": [{"date": "2024-02-01", "open": "1", "close": "2"}, {"date": "soon", "close": 3}, {"date": "2024-02-02T01:00:00+03:00", "close": "nan"}, {"date": "2024-02-03T01:00:00+03:00", "close": 4}]}


def put(path, name, *answers, zipped=False):
    f = path / name
    f.parent.mkdir(parents=True, exist_ok=True)
    data = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in answers).encode()
    f.write_bytes(gzip.compress(data) if zipped else data)


@pytest.fixture
def store(tmp_path):
    put(tmp_path, "ticker=GG.BA/year=2023/a.json", FLAT)
    put(tmp_path, "ticker=GG.BA/year=2024/a.json", CHART, "", LISTED)
    put(tmp_path, "ticker=A%2FB/b.json.gz", CHART, zipped=True)
    put(tmp_path, "ticker=^X/_SUCCESS", "no answer")
    put(tmp_path, "ticker=^X/year=2023/.hidden.json", FLAT)
    put(tmp_path, "notes/c.json", FLAT)
    return tmp_path


def rows(df):
    return sorted((r["ticker"], r["session"], r["open"], r["close"], r["adj_close"], r["volume"]) for r in df.collect())


G23 = [("GG.BA", date(2023, 3, 1), 1.0, 1.5, 1.5, 10.0), ("GG.BA", date(2023, 3, 3), 3.0, 3.5, 3.5, None)]
G24 = [("GG.BA", date(2024, 1, 2), 5.0, 6.0, 3.0, 1.0), ("GG.BA", date(2024, 1, 3), 6.0, 6.5, 6.5, 2.0), ("GG.BA", date(2024, 2, 1), 1.0, 2.0, 2.0, None), ("GG.BA", date(2024, 2, 2), None, 4.0, 4.0, None)]


def test_shapes(spark, store):
    df = src.landed(spark, str(store))
    assert [r[1:] for r in rows(df) if r[0] == "A/B"] == [r[1:] for r in G24[:2]]
    assert [r for r in rows(df) if r[0] == "GG.BA"] == sorted(G23 + G24, key=lambda r: r[1])
    assert df.select("ticker").distinct().count() == 2
    assert rows(src.landed(spark, f"file://{store}")) == rows(df)


def test_other_symbols_are_not_opened(spark, store):
    """Files that cannot be read lie in every folder that the filter leaves out."""
    for name in ("ticker=Q/a.json.gz", "ticker=GG.BA/year=2022/a.json.gz"):
        put(store, name, "not zipped")
    df = src.landed(spark, str(store))
    own = F.col("ticker") == "GG.BA"
    days = F.col("session").between(F.lit("2023-03-02").cast("date"), F.lit("2024-01-02").cast("date"))
    assert rows(df.where(own & days)) == sorted([G23[1], G24[0]], key=lambda r: r[1])
    assert rows(df.where(F.col("ticker").isin("GG.BA", "A/B", "none")).where(F.col("session") > F.lit("2024-01-31").cast("date"))) == G24[2:]
    assert df.where((F.col("ticker") == "A/B") & (F.col("ticker") == "GG.BA")).count() == 0
    with pytest.raises(Exception, match="(?i)gzip|zlib|header|decompress"):
        df.collect()


def test_partitions_follow_size(spark, store, monkeypatch):
    put(store, "ticker=Z/a.json", *[FLAT] * 40)
    reader = src.LandedQuotes({"path": str(store)})
    monkeypatch.setattr(src, "BUNDLE_BYTES", 3000)
    parts = reader.reader(src_schema(spark)).partitions()
    assert len(parts) == 2 and [s for _, s in parts[-1].files] == ["Z"]
    assert sum(len(p.files) for p in parts) == 4


def src_schema(spark):
    return spark.createDataFrame([], src.QUOTES).schema


def test_no_answers(spark, tmp_path):
    put(tmp_path, "ticker=A/a.json", "{", "null", "17", {"chart": {"result": None}}, {"quotes": []}, {})
    assert src.landed(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no answer of a market service"):
        src.landed(spark, str(tmp_path), mode="FAILFAST").collect()


def test_trades(spark, tmp_path):
    put(tmp_path, "symbol=GG%2FAGO26/t.json", {"status": "OK", "trades": [{"datetime": "2026-07-01 10:00:00", "price": 5, "size": 2, "buyOrSell": "BUY"}, {"datetime": None, "price": "x", "side": "S"}]})
    got = [tuple(r) for r in src.landed(spark, str(tmp_path), "trades").where("symbol = 'GG/AGO26'").orderBy("price").selectExpr("symbol", "cast(trade_date as string)", "price", "volume", "buy_or_sell").collect()]
    assert got == [("GG/AGO26", None, None, None, "S"), ("GG/AGO26", "2026-07-01 10:00:00", 5.0, 2.0, "BUY")]
