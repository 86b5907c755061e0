"""Periodic runs of words, by Kolpakov and Kucherov's algorithm.

A run is a stretch of consecutive words with smallest period q that holds
``repeats`` periods at least, ``min_words`` words at least, and that neither
neighbour extends. A text's words are cut into Lempel-Ziv factors by a suffix
automaton: a factor is the longest prefix of the rest that also begins
earlier. A run that touches the border before a factor and ends inside it is
found by Main's extension functions around that border. Every other run lies
strictly inside a factor, which occurs earlier, and is copied from the run of
that occurrence. All of it is linear in the words.

The work is narrowed first, without losing a run: in a run every stretch of
``min_words // repeats`` words comes again one period before or after it. So
only stretches whose grams of that many words repeat inside their text reach
the automaton, and a run never leaves such a stretch.

Words are runs of anything but space and U+0009 to U+000D; texts are whole. A
null or empty text has no words, no runs and an empty collapsed text. Null ids
are kept; repeated rows each give a row; other columns are ignored, whatever
their names. An empty table gives no rows. A task holds one chunk of texts and
the automaton of one stretch; a very long text comes alone and is held whole.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import map_texts

SPACES = r"[\x20\x09-\x0D]+"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lz_factors(s: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, end, source) of each factor; source is an earlier start of the same words, or -1 for a new word."""
    edges: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] != length[p] + 1:
                twin = len(edges)
                edges.append(edges[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = twin
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                q = twin
            link[new] = q
        last = new
    at, n = 0, len(s)
    while at < n:
        state, end = 0, at
        while end < n and first[after := edges[state][s[end]]] < end:
            state, end = after, end + 1
        yield (at, end, first[state] - (end - at) + 1) if end > at else (at, at + 1, -1)
        at = max(end, at + 1)


def _prefixes(s: list, upto: int) -> list[int]:
    """How far ``s`` agrees with itself from each place below ``upto`` on."""
    n = len(s)
    z = [0] * upto
    left = right = 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _at_border(s: list[int], b: int, e: int, window: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repeats that touch the border before ``b``, inside ``window`` words before it and up to ``e``."""
    u, t = s[b:e], s[b - window : b]
    right, left = min(longest, e - b), min(longest, window)
    back = t[::-1]
    # Backward agreement with the words before the border, from each word on either side of it; then forward agreement with the words after it.
    before = _prefixes(back + [None] + u[:right][::-1] + back, window + 1 + right)
    after = _prefixes(u + [None] + t[window - left :] + u, e - b + 1 + left)
    for p in range(1, right + 1):
        yield b - before[window + 1 + right - p], b + p + (after[p] if p < e - b else 0), p
    for p in range(1, left + 1):
        yield b - p - (before[p] if p < window else 0), b + after[e - b + 1 + left - p], p


def runs_of(words: list[int], min_words: int = 24, repeats: int = 3) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of a list of word numbers (none of them negative), by start and period."""
    s = [*words, -1]
    found: dict[tuple[int, int], int] = {}
    starts: list[tuple[int, int]] = []

    def add(start: int, end: int, period: int) -> None:
        if (start, end) not in found:
            insort(starts, (start, end))
        found[start, end] = min(period, found.get((start, end), period))

    size = 0
    for b, e, source in lz_factors(s):
        # A run of so many periods that touches the border reaches back by less than a period beyond the factor before it.
        longest = (size + e - b) // (repeats - 1)
        window = min(b, size + longest)
        if window + e - b >= min_words:
            for start, end, p in _at_border(s, b, e, window, longest):
                if end - start >= max(min_words, repeats * p) and not (start and s[start - 1] == s[start - 1 + p]) and not (end < len(s) and s[end] == s[end - p]):
                    add(start, end, p)
        if source >= 0 and e - b > min_words:
            k, until = bisect_left(starts, (source + 1, 0)), source + e - b
            while k < len(starts) and starts[k][0] < until:
                start, end = starts[k]
                if end < until:
                    add(start + b - source, end + b - source, found[start, end])
                k += 1
        size = e - b
    return sorted(((a, z, p) for (a, z), p in found.items()), key=lambda r: (r[0], r[2]))


def _stretches(codes: np.ndarray, sizes: np.ndarray, min_words: int, gram: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of a chunk's words whose every gram repeats in its text."""
    n = len(codes)
    if n < min_words:
        return
    text = np.repeat(np.arange(len(sizes)), sizes)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    keys = np.zeros(n - gram + 1, dtype=np.uint64)
    for k in range(gram):
        keys = keys * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + len(keys)]
    inside = np.flatnonzero(text[: len(keys)] == text[gram - 1 :])
    keys = keys[inside] ^ (text[inside].astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(n + 1, dtype=bool)
    again[inside[order[1:][same]]] = True
    again[inside[order[:-1][same]]] = True
    # Grams of two texts are never neighbours: the last words of a text begin none.
    edges = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0))
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if z - a + gram - 1 >= min_words:
            yield a, z + gram - 1


class _Codes(dict):
    def __missing__(self, key) -> int:
        self[key] = code = len(self)
        return code


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 24, repeats: int = 3, narrow: bool = True, keep: dict[str, Column] | None = None) -> DataFrame:
    """n_words, runs (start, length, period: word numbers, by start and period) and collapsed text of each row.

    The collapsed text has the words joined by one space, without those that
    some run holds after its first period. ``narrow`` off gives whole texts to
    the automaton.
    """
    if repeats < 3 or min_words < repeats:
        raise ValueError("runs need three repeats and a word for each of them")

    def run(texts: list[bytes]) -> dict:
        codes = _Codes()
        split = [t.split() for t in texts]
        sizes = np.array([len(x) for x in split], dtype=np.int64)
        flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sizes.sum())
        ends = np.cumsum(sizes)
        if narrow:
            stretches = _stretches(flat, sizes, min_words, min_words // repeats)
        else:
            stretches = zip((ends - sizes).tolist(), ends.tolist())
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for a, z in stretches:
            text = int(np.searchsorted(ends, a, side="right")) if z > a else 0
            off = a - int(ends[text] - sizes[text])
            runs[text] += [(x + off, y + off, p) for x, y, p in runs_of(flat[a:z].tolist(), min_words, repeats)]
        collapsed = []
        for words, own in zip(split, runs):
            if own:
                kept = bytearray(b"\1") * len(words)
                for x, y, p in own:
                    kept[x + p : y] = bytes(y - x - p)
                words = [w for w, k in zip(words, kept) if k]
            collapsed.append(b" ".join(words))
        rows = [[{"start": x, "length": y - x, "period": p} for x, y, p in own] for own in runs]
        return {"n_words": pa.array(sizes), "runs": pa.array(rows, RUNS), "collapsed": pa.array(collapsed, pa.binary())}

    out = map_texts(docs, keep or {id_col: F.col(id_col)}, text_col, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary", run, chunk_bytes=4 << 20)
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: str) -> Column:
    """The run of greatest length / period, compared exactly; smallest start, then period on ties; null without runs."""

    def order(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(x != y, F.when(x > y, -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    return F.get(F.array_sort(F.col(runs), order), 0)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the words of every tenth document (by crc32 of its id) made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), SPACES), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g")).withColumn("words", F.when(F.col("g").isNotNull(), words))
    rows = rows.withColumn("n", F.when(F.size("words") > 0, F.size("words"))).withColumn("a", F.col("g") % F.col("n"))
    rows = rows.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    head, part = F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice("words", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    periodic = F.array_join(F.slice(F.concat(head, F.flatten(F.array_repeat(part, times))), F.lit(1), F.col("n")), " ")
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.withColumn("top", strongest("runs"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words",
    )
