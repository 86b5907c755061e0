"""Shared tables and plans."""

import os

from pyspark.sql import functions as F

from eventide.llm import op2_shards, op3_chat, op5_urls, work


def test_tables_come_and_go(spark):
    df = spark.range(10).select("id", F.lit(None).cast("string").alias("s"))
    a, b = work.materialize(df, "a"), work.materialize(df.limit(0), "b")
    assert a.count() == 10 and b.count() == 0 and a.schema.simpleString() == df.schema.simpleString()
    path = a._eventide_path.removeprefix("file://")
    assert path.startswith(work.shared_dir(spark).removeprefix("file://")) and os.path.isdir(path)
    work.discard(a)
    assert not os.path.isdir(path) and b.count() == 0
    work.discard(b)


def test_shared_dir_is_read_from_the_session(spark, monkeypatch):
    conf = type(spark.sparkContext.getConf())
    monkeypatch.setattr(conf, "get", lambda self, key, default=None: "/shared" if key == "spark.checkpoint.dir" else default)
    assert work.shared_dir(spark) == "/shared"
    monkeypatch.setattr(conf, "get", lambda self, key, default=None: default)
    made = work.shared_dir(spark)
    assert os.path.isdir(made) and work.shared_dir(spark) == made


def plan(df):
    return df._jdf.queryExecution().toString()


def test_native_operators_have_no_python(spark, sf):
    for df in (op3_chat.op3_chat_format(spark, sf), op5_urls.op5_url_filter(spark, sf), op2_shards.op2_sharding(spark, sf)):
        assert not any(x in plan(df) for x in ("Arrow", "Python", "Pandas", "Cartesian", "NestedLoop"))
