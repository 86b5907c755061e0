"""Fills by a join of two streams equal the batch form."""

import datetime as dt

from pyspark.sql import functions as F

from eventide.operators import ticks as tk
from eventide.plans import register
from eventide.streaming import fills
from eventide.streaming.streams import event_stream

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp_ntz, bid double, ask double, event_id long"


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def test_stream_long_trades_equals_long_trades(spark, sf):
    stream, batch = (register.QUERIES[n](spark, sf) for n in ("stream_long_trades", "long_trades"))
    assert stream.columns == batch.columns
    got = rows(stream)
    assert got == rows(batch) and got


def written(spark, path, parts):
    """A folder of files, one a part, that the stream reads in this order."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    return spark.read.parquet(str(path)), event_stream(spark, str(path), 1)


def test_state_is_bounded_over_many_batches(spark, tmp_path):
    """Forty days of quotes, a file a day: the answers are the batch form's, and old quotes leave the state."""
    parts = [[("A" if i % 3 else "B", DAY + dt.timedelta(days=d, minutes=37 * i), 1.0 + i, 2.0 + i if i % 4 else None, d * 100 + i) for i in range(30)] for d in range(40)]
    batch, stream = written(spark, tmp_path / "ticks", parts)
    orders = spark.createDataFrame([(s, DAY + dt.timedelta(days=d, hours=h)) for s in "AB" for d in range(40) for h in (1, 9)], "symbol string, want timestamp_ntz")
    progress = []
    got = fills.first_quote(orders, stream, "ask", "want", 3600, "price", "filled", late="1 hour", progress=progress)
    assert rows(got) == rows(tk.first_quote(orders, batch, "ask", "want", 3600, "price", "filled"))
    kept = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]
    assert len(kept) >= 40
    # All orders come in the first file, two rows each; they and the quotes leave as the days pass.
    assert kept[-1] < 40 and max(kept[20:]) < max(kept[:5])


def test_odd_rows_and_no_rows(spark, tmp_path):
    """Ties go to the smaller id, repeated rows keep their number, nulls and empty tables give null fills; both ends count."""
    at = DAY + dt.timedelta(hours=1)
    part = [("A", at, 1.0, 5.0, 9), ("A", at, 1.0, 4.0, 3), ("A", at, 1.0, 4.0, 3), (None, at, 1.0, 1.0, 1), ("A", None, 1.0, 1.0, 1), ("B", at + dt.timedelta(seconds=60), 1.0, 7.0, 5), ("C", at, 1.0, -1.0, 5), ("C", at, 1.0, None, 6)]
    orders = spark.createDataFrame([("A", at, 1), ("A", at, 1), ("B", at, 2), ("C", at, 3), (None, at, 4), ("A", None, 5)], "symbol string, want timestamp_ntz, batch int")
    batch, stream = written(spark, tmp_path / "ticks", [part])
    got = fills.first_quote(orders, stream, "ask", "want", 60, "price", "filled")
    assert rows(got) == rows(tk.first_quote(orders, batch, "ask", "want", 60, "price", "filled"))
    assert sorted((r["batch"], r["price"]) for r in got.where("price is not null").collect()) == [(1, 4.0), (1, 4.0), (2, 7.0)]
    assert got.where("price is null").count() == 3
    none, nothing = written(spark, tmp_path / "none", [[]])
    assert fills.first_quote(orders, nothing, "ask", "want", 60, "price", "filled").where("price is null").count() == 6
    assert fills.first_quote(orders.where(F.lit(False)), event_stream(spark, str(tmp_path / "ticks"), 1), "ask", "want", 60, "price", "filled").count() == 0
