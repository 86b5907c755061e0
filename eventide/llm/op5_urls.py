"""URL filters: block decisions reach the aliases of a URL.

Rules on (host, path) decide a URL by the longest rule that fits; of rules as
long, allow wins. Pages that redirect (``http-equiv=refresh``) or name a
canonical link are aliases of the target. Links are read as browsers do: not in
comments, ``rel`` among several values, character references decoded, relative
to the page (``//host``, ``/path``, ``?query``, ``../path``). A URL is a node by its
whole normal form: scheme and host in lower case, no dot segments, ``/`` for an
empty path, the query, but no fragment, as that is not sent. Connected components over those edges, and no
others, hold equivalent URLs. A URL without a rule is blocked if its component
holds a blocked URL and no explicitly allowed one; otherwise it is allowed.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule
and are allowed; null HTML has no links. Very long URLs and pages are read
whole. Repeated rows each give a row; other columns are ignored; no rows give
none. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .texts import UPPER, lower_ascii
from .work import materialize

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def _decide(host: Column, path: Column, rules: tuple) -> Column:
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        what = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, what) if out is None else out.when(fits, what)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _undotted(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    # A path that ends in a dot segment names a folder.
    parts = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    up = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda kept, x: F.when(x == "..", up(kept)).when(x == ".", kept).otherwise(F.concat(kept, F.array(x))))
    return F.when(path.contains("/."), F.array_join(walked, "/")).otherwise(path)


def _key(url: Column, host: Column, path: Column) -> Column:
    """The whole URL in normal form; null without a host."""
    scheme = lower_ascii(F.substring(url, F.lit(1), F.instr(url, "://") - 1))
    query = F.regexp_extract(F.regexp_replace(url, "(?s)#.*$", ""), r"(?s)\?.*$", 0)
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(_undotted(path)), query))


def _parts(df: DataFrame, url: str, rules: tuple) -> DataFrame:
    host, path = split_url(F.col(url))
    df = df.withColumns({"host": host, "path": path})
    return df.withColumns({"key": _key(F.col(url), F.col("host"), F.col("path")), "said": _decide(F.col("host"), F.col("path"), rules)})


def _keys(df: DataFrame, url: str, name: str) -> DataFrame:
    """Adds the normal form of a URL column."""
    host, path = split_url(F.col(url))
    return df.withColumns({"__host": host, "__path": path}).withColumn(name, _key(F.col(url), F.col("__host"), F.col("__path"))).drop("__host", "__path")


#: What character references in a link stand for, the ampersand last.
REFERENCES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#47;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
TAG = r"(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>"
REFRESH = r"(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"']*)"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def _attribute_pattern(name: str) -> str:
    return rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def _attribute(name: str) -> Column:
    """An attribute's value, quoted or not; empty where there is none."""
    return F.concat(*[F.regexp_extract("tag", _attribute_pattern(name), k) for k in (1, 2, 3)])


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target) for every canonical link and refresh target in the HTML."""
    tags = F.regexp_extract_all(F.regexp_replace(F.col(html_col), COMMENT, " "), F.lit(TAG), F.lit(0))
    tag = pages.where(F.col(html_col).rlike("(?i)canonical|http-equiv")).select(F.col(url_col).alias("url"), F.explode(tags).alias("tag"))
    rel = F.array_contains(F.split(lower_ascii(_attribute("rel")), r"\s+"), "canonical")
    refresh = F.trim(lower_ascii(_attribute("http-equiv"))) == "refresh"
    named = F.when(F.col("tag").rlike(r"(?i)^<link\b") & rel, _attribute("href")).when(F.col("tag").rlike(r"(?i)^<meta\b") & refresh, F.regexp_extract(_attribute("content"), REFRESH, 1))
    for code, what in REFERENCES:
        named = F.replace(named, F.lit(code), F.lit(what))
    links = tag.select("url", F.regexp_replace(named, r"^\s+|\s+$", "").alias("link"))
    link, url = F.col("link"), F.col("url")
    base = F.regexp_extract(url, "^.*?://[^/?#]*", 0)
    plain = F.regexp_extract(url, "^.*?://[^?#]*", 0)
    folder = F.regexp_extract(url, "^.*?://[^/?#]*(?:/(?:[^?#]*/)?)?", 0)
    target = (
        F.when(link.rlike(SCHEME + "//"), link)
        .when(link.rlike(SCHEME), None)
        .when(link.startswith("//"), F.concat(F.regexp_extract(url, "^[^:]*:", 0), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("?"), F.concat(plain, link))
        .when(~link.startswith("#"), F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )
    return links.where("link <> ''").select("url", target.alias("target")).where("target is not null")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """Host, path, rule and verdict of each row; ``redirects`` may add (url, target) rows."""
    spark = pages.sparkSession
    # Written once: it is read three times, and its expressions stay apart from those that follow.
    page = materialize(_parts(pages.select(F.col(id_col), F.col(url_col).alias("url")), "url", rules).drop("url"), "pages")
    links = alias_links(pages, url_col, html_col) if html_col else spark.createDataFrame([], "url string, target string")
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    ends = _keys(_keys(links, "url", "from"), "target", "to").where("from is not null and to is not null").select("from", "to").distinct()
    # Rules look at a target's normal form.
    links = materialize(_parts(ends, "to", rules).select("from", "to", F.col("said.verdict").alias("verdict")), "links")
    edges = links.where("from <> to").select("from", "to")
    seeds = page.select("key", F.col("said.verdict").alias("verdict")).unionByName(links.select(F.col("to").alias("key"), "verdict"))
    seeds = seeds.where("key is not null and verdict is not null").groupBy("key").agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    open_ = page.where("said is null and key is not null")
    if edges.isEmpty():
        flags = seeds
    else:
        labels = materialize(connected_components(edges, "from", "to"), "labels").withColumnRenamed("node", "key")
        seeds = seeds.join(labels, "key", "left").groupBy(F.coalesce("component", "key").alias("component")).agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
        flags = seeds
        open_ = open_.join(labels, "key", "left").withColumn("key", F.coalesce("component", "key"))
    flags = materialize(flags.where("blocked and not allowed").toDF("key", "allowed", "blocked").select("key", "blocked"), "blocked")
    open_ = open_.join(flags, "key", "left")
    inherited = F.when(F.col("blocked"), "block").otherwise("allow")
    out = [id_col, "host", "path"]
    decided = page.where("said is not null or key is null").select(*out, "said.rule", F.coalesce("said.verdict", F.lit("allow")).alias("verdict"))
    return decided.unionByName(open_.select(*out, F.lit(None).cast("string").alias("rule"), inherited.alias("verdict")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[2]))

    def case(value: int) -> str:
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[value]}'" for h, p, v in ordered) + " END"

    def parts(url: str) -> str:
        scheme = f"translate(substr({url}, 1, instr({url}, '://') - 1), '{UPPER}', '{UPPER.lower()}')"
        query = f"regexp_extract(regexp_replace({url}, '#.*$', '', 's'), '\\?.*$', 0, 's')"
        segments = "CASE WHEN split_part(path, '/', -1) IN ('.', '..') THEN list_append(string_split(path, '/'), '') ELSE string_split(path, '/') END"
        walked = f"list_reduce(list_transform({segments}, lambda x: [x]), lambda a, b: CASE WHEN b[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] WHEN b[1] = '.' THEN a ELSE list_concat(a, b) END)"
        undotted = f"CASE WHEN contains(path, '/.') THEN array_to_string({walked}, '/') ELSE path END"
        return f"""SELECT *, {case(0)} AS rule, {case(1)} AS said, CASE WHEN host <> '' THEN {scheme} || '://' || host || CASE WHEN path = '' THEN '/' ELSE {undotted} END || {query} END AS key
  FROM (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
               regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
        FROM (SELECT *, CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END AS rest FROM {{}}))"""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def attribute(name: str) -> str:
        pattern = text(_attribute_pattern(name).replace('\\"', '"'))
        return "(" + " || ".join(f"regexp_extract(tag, {pattern}, {k})" for k in (1, 2, 3)) + ")"

    low = lambda x: f"translate({x}, '{UPPER}', '{UPPER.lower()}')"
    named = f"""CASE WHEN regexp_matches(tag, '(?i)^<link\\b') AND list_contains(regexp_split_to_array({low(attribute('rel'))}, '\\s+'), 'canonical') THEN {attribute('href')}
    WHEN regexp_matches(tag, '(?i)^<meta\\b') AND trim({low(attribute('http-equiv'))}) = 'refresh' THEN regexp_extract({attribute('content')}, {text(REFRESH.replace(chr(92) + '"', '"'))}, 1) END"""
    for code, what in REFERENCES:
        named = f"replace({named}, {text(code)}, {text(what)})"
    return f"""
WITH RECURSIVE p AS ({parts('url').format('(SELECT page_id, url FROM pages)')}),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '{COMMENT}', ' ', 'g'), '{TAG}')) AS tag FROM pages),
links AS (SELECT url, regexp_replace({named}, '^\\s+|\\s+$', '', 'g') AS link FROM tags),
targets AS (
  SELECT url, CASE WHEN regexp_matches(link, '{SCHEME}//') THEN link WHEN regexp_matches(link, '{SCHEME}') THEN NULL
                   WHEN starts_with(link, '//') THEN regexp_extract(url, '^[^:]*:') || link
                   WHEN starts_with(link, '/') THEN regexp_extract(url, '^.*?://[^/?#]*') || link
                   WHEN starts_with(link, '?') THEN regexp_extract(url, '^.*?://[^?#]*') || link
                   WHEN NOT starts_with(link, '#') THEN rtrim(regexp_extract(url, '^.*?://[^/?#]*(?:/(?:[^?#]*/)?)?'), '/') || '/' || link END AS target
  FROM links WHERE link <> ''),
n AS (SELECT url, key AS target FROM ({parts('target').format("(SELECT * FROM targets WHERE target IS NOT NULL)")}) WHERE key IS NOT NULL),
t AS ({parts('target').format("n")}),
e AS (SELECT DISTINCT p.key AS a, t.key AS b FROM t JOIN p USING (url) WHERE p.key IS NOT NULL AND t.key IS NOT NULL AND p.key <> t.key),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT DISTINCT a, a FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
label AS (SELECT a AS key, min(b) AS comp FROM reach GROUP BY a),
seed AS (SELECT key, said FROM p WHERE key IS NOT NULL AND said IS NOT NULL UNION ALL SELECT key, said FROM t WHERE key IS NOT NULL AND said IS NOT NULL),
flag AS (SELECT coalesce(comp, key) AS comp, bool_or(said = 'allow') AS allowed, bool_or(said = 'block') AS blocked FROM seed LEFT JOIN label USING (key) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN label USING (key) LEFT JOIN flag ON flag.comp = coalesce(label.comp, p.key)"""
