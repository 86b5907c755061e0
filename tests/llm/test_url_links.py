"""Every form of link to a blocked page makes an alias of it, in Spark and in SQL; what is no link does not."""

import duckdb
import pandas as pd
import pytest

from eventide.llm import op5_urls

CANONICAL = '<head><link rel="canonical" href="{}"></head>'
#: The page's URL, its HTML, and whether it is blocked. ``http://a.com/en/x?s=2`` and all of ``/en/`` there are blocked by rule.
ALIASES = [
    ("http://a.com/fr/x", CANONICAL.format("/en/x"), True),
    ("http://a.com/fr/x/1", CANONICAL.format("../../en/x"), True),
    ("http://a.com/fr/x/2", CANONICAL.format("../.././en/./x/.."), True),
    ("http://a.com/fr/3", CANONICAL.format("http://a.com/fr/../en/x"), True),
    ("http://a.com/fr/4", CANONICAL.format("../../../../en/x"), True),
    ("http://a.com/de/../en/x#top", None, True),
    ("http://a.com/fr/5", CANONICAL.format("HTTP://A.COM/en/x?a=1#part"), True),
    ("http://b.info/q", CANONICAL.format("//a.com/en/x"), True),
    ("https://g.info/1", CANONICAL.format("https://s.info/secure"), True),
    ("https://s.info/secure", CANONICAL.format("http://a.com/en/x"), True),
    ("https://g.info/2", CANONICAL.format("//s.info/secure"), True),
    ("http://g.info/3", CANONICAL.format("//s.info/secure"), False),
    ("http://q.info/p", None, False),
    ("http://q.info/p?s=2", CANONICAL.format("http://a.com/en/x"), True),
    ("http://q.info/p?s=3&t=4", CANONICAL.format("?s=2"), True),
    ("http://q.info/p?s=5", CANONICAL.format("?s=9"), False),
    ("http://r.info?x", CANONICAL.format("http://a.com/en/x"), True),
    ("http://r.info/other", CANONICAL.format("/?x"), True),
    ("http://m.info/1", '<link href="http://a.com/en/x" rel="alternate canonical">', True),
    ("http://m.info/2", "<LINK REL='Canonical  nofollow' HREF='http://a.com/en/x'>", True),
    ("http://m.info/3", "<link rel=canonical href=http://a.com/en/x>", True),
    ("http://m.info/4", '<link rel="canonical-ish" href="http://a.com/en/x"><link rel="x" title="canonical" href="http://a.com/en/x">', False),
    ("http://m.info/5", '<link data-rel="canonical" rel="next" href="http://a.com/en/x">', False),
    ("http://n.info/1", CANONICAL.format("http://q.info/p?s=3&amp;t=4"), True),
    ("http://n.info/2", CANONICAL.format("http://q.info/p?s=3&#38;t=4"), True),
    ("http://n.info/3", CANONICAL.format("http:&#x2F;&#47;a.com/en/x"), True),
    ("http://c.info/1", "<!-- " + CANONICAL.format("http://a.com/en/x") + "\n-->", False),
    ("http://c.info/2", "<!-- a --><!-- b -->" + CANONICAL.format("http://a.com/en/x"), True),
    ("http://c.info/3", "<!-- never closed " + CANONICAL.format("http://a.com/en/x"), False),
    ("http://f.info/1", '<META HTTP-EQUIV="Refresh" CONTENT="0; URL=http://a.com/en/x">', True),
    ("http://f.info/2", "<meta content='5;url=\"http://a.com/en/x\"' http-equiv=refresh>", True),
    ("http://f.info/3", '<meta http-equiv="refresh" content="5">', False),
    ("http://f.info/4", '<meta name="refresh" content="0; url=http://a.com/en/x">', False),
    ("http://f.info/5", '<meta http-equiv="refresh" content="0, http://a.com/en/x">', True),
    ("http://o.info/1", CANONICAL.format("mailto:x@a.com"), False),
    ("http://o.info/2", CANONICAL.format("#http://a.com/en/x"), False),
    ("http://o.info/3", CANONICAL.format(" \n "), False),
    ("http://o.info/4", CANONICAL.format("/go?to=http://a.com/en/x"), False),
    ("http://o.info/5", CANONICAL.format("\n http://a.com/en/x\t"), True),
    ("http://long.info/" + "y" * 200_000, CANONICAL.format("http://a.com/en/x") + "z" * 2_000_000, True),
    ("http://long.info/2", CANONICAL.format("http://long.info/" + "y" * 200_000), True),
    ("no scheme", CANONICAL.format("http://a.com/en/x"), False),
    ("http://a.com/en/x", None, True),
]


@pytest.fixture(scope="module")
def rows():
    return [(i, url, html) for i, (url, html, _) in enumerate(ALIASES)]


def test_links_in_spark(spark, rows):
    got = {r["page_id"]: r["verdict"] for r in op5_urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [(url[:60], got[i] == "block") for i, (url, _, _) in enumerate(ALIASES)] == [(url[:60], blocked) for url, _, blocked in ALIASES]


def test_links_in_sql(spark, rows, tmp_path):
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    want = {r[0]: tuple(r) for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({op5_urls.oracle()})").fetchall()}
    got = {r["page_id"]: tuple(r) for r in op5_urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_dot_segments(spark):
    cases = {"/a/b/../c": "/a/c", "/a/./b": "/a/b", "/a/..": "/", "/../../a": "/a", "/a/b/.": "/a/b/", "/a//../b": "/a/b", "/.a/..b/c.": "/.a/..b/c.", "": "", "/": "/"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "path string, want string")
    from pyspark.sql import functions as F

    assert df.where(~op5_urls._undotted(F.col("path")).eqNullSafe(F.col("want"))).count() == 0
