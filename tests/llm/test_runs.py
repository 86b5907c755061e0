"""Periodic runs against a look at every period."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventide.llm import op12_runs as op

from .test_operators import docs, odd, words_of


def every_run(s, least=24, repeats=3):
    out = {}
    for p in range(1, len(s) // repeats + 1):
        i = 0
        while i + p < len(s):
            if s[i] != s[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j + p - i >= max(least, repeats * p):
                out.setdefault((i, j + p), p)
            i = j
    return sorted(((a, z, p) for (a, z), p in out.items()), key=lambda r: (r[0], r[2]))


def test_factors_are_longest():
    rnd = random.Random(2)
    for _ in range(300):
        s = rnd.choices(range(rnd.randint(1, 4)), k=rnd.randint(0, 40))
        at = 0
        for b, e, source in op.lz_factors(s):
            assert b == at
            longest = max((k for a in range(b) for k in range(1, len(s) - b + 1) if s[a : a + k] == s[b : b + k]), default=0)
            assert e - b == max(1, longest) and (source < 0) == (longest == 0)
            assert source < 0 or source < b and s[source : source + e - b] == s[b:e]
            at = e
        assert at == len(s)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 6)), max_size=12), st.sampled_from([(3, 3), (6, 3), (8, 4)]))
def test_runs(parts, limits):
    s = [x for words, n in parts for x in words * n]
    assert op.runs_of(s, *limits) == every_run(s, *limits)


def test_copied_runs():
    """Runs inside a passage that comes again, alone and inside a run."""
    rnd = random.Random(3)
    passage = [*range(100, 130), *[1, 2, 3] * 9, *range(200, 230), *[5] * 30, 7]
    s = [*passage, *range(300, 340), *passage, *rnd.choices(range(9), k=50), *passage * 4]
    assert op.runs_of(s) == every_run(s) and len(op.runs_of(s)) > 8


def brute(i, text):
    w = words_of(text)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    runs = every_run(w)
    top = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    gone = {k for a, z, p in runs for k in range(a + p, z)}
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{z - a},{p}\n" for a, z, p in runs), " ".join(x for k, x in enumerate(w) if k not in gone))]
    return (i, len(runs), *((top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4), *digest, len(w))


def written(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return Counter(tuple(r) for r in op.op12_periodic_runs(spark, str(tmp_path)).collect())


def test_query(spark, sf):
    want = Counter(brute(r["doc_id"], r["text"]) for r in docs(spark, sf).collect())
    assert Counter(tuple(r) for r in op.op12_periodic_runs(spark, sf).collect()) == want
    assert sum(n for row, n in want.items() if row[1]) > 10


def test_odd_rows(spark, tmp_path):
    df = odd(spark)
    assert written(spark, df, tmp_path) == Counter(brute(r["doc_id"], r["text"]) for r in df.collect())


def test_no_rows(spark, tmp_path):
    assert not written(spark, odd(spark).limit(0), tmp_path)


def test_narrowing_loses_nothing(spark, sf):
    df = docs(spark, sf).limit(60)
    for least, repeats in ((24, 3), (9, 3), (12, 4)):
        a, b = (Counter((r["doc_id"], str(r["runs"]), r["collapsed"]) for r in op.periodic_runs(df, min_words=least, repeats=repeats, narrow=x).collect()) for x in (True, False))
        assert a == b
    with pytest.raises(ValueError):
        op.periodic_runs(df, repeats=2)
