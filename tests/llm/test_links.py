"""Aliases of URLs, in Spark and in SQL, and turns that separators could confuse."""

import duckdb

from eventide.llm import op3_chat, op5_urls

CANONICAL = '<link rel="canonical" href="{}">'
REFRESH = '<meta http-equiv="refresh" content="0;url={}">'
LONG = "http://long.org/" + "x" * 100_000
PAGES = [
    (1, "http://shop.org/item?id=1", None), (2, "http://shop.org/item?id=2", CANONICAL.format("http://bad.com/en/2")), (3, "http://bad.com/en/2", None),
    (4, "http://shop.org/item?id=2#reviews", None), (5, "HTTP://SHOP.org/item?id=2", None), (6, "https://shop.org/item?id=2", None), (7, "http://shop.org/item?id=2&x", None),
    (8, "http://a.org/1", REFRESH.format("http://b.org/2")), (9, "http://b.org/2", REFRESH.format("/3")), (10, "http://b.org/3", CANONICAL.format("http://bad.com/en/9")), (11, "http://a.org", CANONICAL.format("http://a.org/")),
    (12, "http://ok.org/1", CANONICAL.format("http://bad.com/en/5")), (13, "http://www.example.com/en/77", CANONICAL.format("http://ok.org/1")), (14, LONG, CANONICAL.format("http://bad.com/en/long")), (15, LONG + "y", None), (16, None, CANONICAL.format("http://bad.com/en/5")), (17, "none", None), (17, "none", None),
]


def test_only_links_make_aliases(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in op5_urls.judge_urls(df).collect()}
    assert {i for i, v in got.items() if v == "block"} == {2, 3, 4, 5, 8, 9, 10, 14}


def test_sql_agrees_on_links(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({op5_urls.oracle()})").fetchall()
    got = [tuple(r) for r in op5_urls.judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_turns_are_told_apart(spark):
    rows = [(1, 0, "u\x1fx", "y"), (2, 0, "u", "x\x1fy"), (3, 0, "u:1", "y"), (4, 0, "u", "1:y"), (5, 0, "long", "word " * 200_000)]
    got = op3_chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["conv_id"] for r in got} == {1, 2, 3, 4, 5} and max(len(r["rendered"]) for r in got) > 1_000_000
