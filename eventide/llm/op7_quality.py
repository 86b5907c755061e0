"""Quality rules: thresholds that adapt to each language and source.

Each text gives four integer ratios. A mergeable quantile sketch per (language,
source, ratio) holds counts in log-linear bins: bins are exact below 1024 and
1/512 wide above, so two sketches merge by adding counts, in any order and
partitioning, with the same result. What a group usually has reaches from its
lower to its upper quartile, and beyond by ``spread`` times their distance from
the median; so junk moves it only from a quarter of the group on. That is the
fence of a ratio without bound. A share of characters, lines or words ends at
all of them: its fence lies a part of the way from the usual values to that
end, and below it in every group. The fences are joined to the rows. ``RESOLUTION``
only keeps a group whose quartile is its median from rejecting the next value.

Every quantile of a group is a mean of its own and of its language's, weighted
with the group's rows and ``SHRINK``; a language's leans on all texts' likewise. So
small groups are judged nearly as their language is, large ones by themselves,
and nothing changes by a step.

Null texts are empty. A null language or source is a group like any other.
Texts are counted whole, however long. Repeated rows count each time and each
give a row; other columns are ignored or, in the filter, kept under any names.
Without rows there are no fences and no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .texts import map_texts
from .work import materialize

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Ratio: (expression, sides that are fenced, spread, most it can be, part of the way to that).
RATIOS = {
    "word_length": ("word_chars * 1000 div greatest(n_words, 1)", "both", 11, None, None),
    "symbols": ("n_symbols * 10000 div greatest(word_chars, 1)", "high", 3, 10000, 16),
    "dup_lines": ("n_dup_lines * 10000 div greatest(n_lines, 1)", "high", 1, 10000, 4),
    "repeats": ("n_repeat_words * 10000 div greatest(n_words, 1)", "high", 1, 10000, 4),
}
#: Quantile levels of the sketches. Junk of under a quarter of a group does not reach the upper one.
LEVELS = (25, 50, 75)
#: A group's usual values of a ratio with a most are so many tenths of it at most.
USUAL = 9
RESOLUTION, SHRINK = 100, 100
#: Bins of the sketches an octave.
FINE = 512


def text_counts(texts: list[bytes]) -> dict[str, pa.Array]:
    out: dict[str, list[int]] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    for text in texts:
        words = text.split()
        n = len(words)
        letters = b"".join(words)
        out["n_words"].append(n)
        out["word_chars"].append(len(letters.decode("utf-8", "replace")))
        out["n_symbols"].append(len(text) - len(text.translate(None, SYMBOLS)))
        lines = [x for x in text.split(b"\n") if x.strip()]
        out["n_lines"].append(len(lines))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(_repeated(words))
    return {k: pa.array(v, pa.int64()) for k, v in out.items()}


def _repeated(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice: set = set()
    for x in windows:
        (twice if x in seen else seen).add(x)
    total = until = 0
    for i, x in enumerate(windows):
        if x in twice:
            total += i + 3 - max(i, until)
            until = i + 3
    return total


def _bin(x: Column) -> Column:
    """The smallest value of the sketch bin that holds ``x``."""
    out = x
    for k in range(1, 42):
        step = F.lit(1 << k)
        out = F.when(x >= F.lit(FINE << k), (x - x % step).cast("long")).otherwise(out)
    return out


def sketch(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., ratio, bin, n): the mergeable sketch of each group."""
    pairs = F.array(*[F.struct(F.lit(k).alias("ratio"), F.col(f"__{k}").alias("x")) for k in RATIOS])
    return rows.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.ratio", _bin(F.col("p.x")).alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], levels: tuple[int, ...] = (25, 50, 75)) -> DataFrame:
    """Size and quantiles q1, q2, ... at ``levels`` in a hundred per group and ratio, from bin counts."""
    keys = [*by, "ratio"]
    bins = sketches.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    upto = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(W.partitionBy(*keys))})
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * x, F.col("bin"))).alias(f"q{k}") for k, x in enumerate(levels, 1)]
    return bins.groupBy(*keys).agg(F.max("total").alias("total"), *at)


def _shrunk(own: str, towards: str) -> Column:
    """The quantiles ``own``, drawn ``towards`` those of a wider group."""
    n = F.col(f"{own}.total")
    q = [F.expr(f"({own}.total * {own}.q{k} + {SHRINK} * {towards}.q{k}) div ({own}.total + {SHRINK})").alias(f"q{k}") for k in range(1, len(LEVELS) + 1)]
    return F.struct(n.alias("total"), *q)


def fences(rows: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """One row per (language, source): low and high bound of every ratio."""
    fine = materialize(sketch(rows, [lang_col, source_col]), "sketch")
    q = F.struct("total", *[f"q{k}" for k in range(1, len(LEVELS) + 1)])
    every = quantiles(fine, [], LEVELS).select(F.col("ratio").alias("__ra"), q.alias("__all"))
    lang = quantiles(fine, [lang_col], LEVELS).select(F.col(lang_col).alias("__l"), F.col("ratio").alias("__rl"), q.alias("__own"))
    lang = lang.join(every, F.col("__rl") == F.col("__ra")).select("__l", "__rl", _shrunk("__own", "__all").alias("__wide"))
    own = quantiles(fine, [lang_col, source_col], LEVELS).select(lang_col, source_col, "ratio", q.alias("__own"))
    own = own.join(lang, own[lang_col].eqNullSafe(lang["__l"]) & (F.col("ratio") == F.col("__rl"))).select(lang_col, source_col, "ratio", _shrunk("__own", "__wide").alias("q"))
    aggs = []
    low, middle, high = (F.col(f"q.q{k}") for k in range(1, len(LEVELS) + 1))
    for k, (_, sides, spread, most, way) in RATIOS.items():
        up = high + F.greatest((high - middle) * spread, F.lit(RESOLUTION))
        if most:
            up = F.least(up, F.lit(most * USUAL // 10))
            up = up + F.floor((F.lit(most) - up) / way)
        aggs.append(F.max(F.when(F.col("ratio") == k, up)).alias(f"{k}_high"))
        if sides == "both":
            aggs.append(F.max(F.when(F.col("ratio") == k, low - F.greatest((middle - low) * spread, F.lit(RESOLUTION)))).alias(f"{k}_low"))
    return own.groupBy(lang_col, source_col).agg(*aggs)


def _counted(docs: DataFrame, keep: dict[str, Column], text_col: str) -> DataFrame:
    rows = map_texts(docs, keep, text_col, "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long", text_counts)
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    return rows.withColumns({f"__{k}": F.expr(e) for k, (e, *_) in RATIOS.items()})


def _judged(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows with ``kept``; the bounds are a table with a row per language and source."""
    bounds = bounds.withColumnsRenamed({"__lang": "__l", "__source": "__s"})
    rows = rows.join(bounds, rows["__lang"].eqNullSafe(bounds["__l"]) & rows["__source"].eqNullSafe(bounds["__s"]), "left")
    ok = ~F.col("base_failed")
    for k, (_, sides, *_) in RATIOS.items():
        ok &= F.col(f"__{k}") <= F.col(f"{k}_high")
        if sides == "both":
            ok &= F.col(f"__{k}") >= F.col(f"{k}_low")
    return rows.withColumn("kept", F.coalesce(ok, F.lit(False)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, base verdict and verdict of each row."""
    keep = {id_col: F.col(id_col), "__lang": F.col(lang_col), "__source": F.col(source_col)}
    rows = materialize(_counted(docs, keep, text_col), "counts")
    bounds = materialize(fences(rows, "__lang", "__source"), "fences")
    return _judged(rows, bounds).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    Texts are counted twice, once for the thresholds and once on the way to the
    filter, so that they are never shuffled.
    """
    group = {"__lang": F.col(lang_col), "__source": F.col(source_col)}
    bounds = materialize(fences(_counted(docs, group, text_col), "__lang", "__source"), "fences")
    names = {f"__c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    kept = _judged(_counted(docs, names | group, text_col), bounds).where("kept")
    return kept.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    bins = "CASE " + " ".join(f"WHEN x >= {FINE << k} THEN x - x % {1 << k}" for k in range(41, 0, -1)) + " ELSE x END"
    ratios = " UNION ALL ".join(f"SELECT rid, lang, source, '{k}' AS ratio, ({e.replace('div', '//')})::BIGINT AS x FROM c" for k, (e, *_) in RATIOS.items())

    def quant(by: str) -> str:
        on = f"{by}, ratio" if by else "ratio"
        at = ", ".join(f"min(bin) FILTER (upto * 100 >= total * {x})" for x in LEVELS)
        return f"""SELECT {on}, max(total) AS total, [{at}] AS q
  FROM (SELECT *, sum(n) OVER (PARTITION BY {on} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {on}) AS total
        FROM (SELECT {on}, bin, sum(n) AS n FROM sk GROUP BY {on}, bin)) GROUP BY {on}"""

    def drawn(own: str, wide: str) -> str:
        return f"list_transform(range(1, {len(LEVELS) + 1}), lambda i: ({own}.total * {own}.q[i] + {SHRINK} * {wide}.q[i]) // ({own}.total + {SHRINK}))"

    def high(spread: int, most: int | None, way: int | None) -> str:
        up = f"(q[3] + greatest((q[3] - q[2]) * {spread}, {RESOLUTION}))"
        return f"(least({up}, {most * USUAL // 10}) + ({most} - least({up}, {most * USUAL // 10})) // {way})" if most else up

    bad = " OR ".join(
        f"ratio = '{k}' AND (x > {high(spread, most, way)}" + (f" OR x < q[1] - greatest((q[2] - q[1]) * {spread}, {RESOLUTION})" if sides == "both" else "") + ")"
        for k, (_, sides, spread, most, way) in RATIOS.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, w[i + 1:i + 3] AS g FROM (SELECT rid, w, unnest(range(0, len(w)::BIGINT - 2)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
c AS (
  SELECT w.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM c),
r AS ({ratios}),
sk AS (SELECT lang, source, ratio, {bins} AS bin, count(*) AS n FROM r GROUP BY ALL),
ba AS ({quant('')}),
bl AS (SELECT l.lang, ratio, {drawn('l', 'ba')} AS q FROM ({quant('lang')}) l JOIN ba USING (ratio)),
own AS (SELECT o.lang, o.source, o.ratio, {drawn('o', 'bl')} AS q FROM ({quant('lang, source')}) o JOIN bl ON o.lang IS NOT DISTINCT FROM bl.lang AND o.ratio = bl.ratio),
bad AS (
  SELECT DISTINCT rid
  FROM (SELECT rid, r.ratio, x, q FROM r JOIN own ON r.lang IS NOT DISTINCT FROM own.lang AND r.source IS NOT DISTINCT FROM own.source AND r.ratio = own.ratio)
  WHERE {bad})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND bad.rid IS NULL) AS kept
FROM f LEFT JOIN bad USING (rid)"""
