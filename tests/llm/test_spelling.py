"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from eventide.llm import op11_spelling as op

from .test_operators import docs, low, odd


def counted(rows, least=6, damage=None):
    out = Counter()
    for i, text in rows:
        for run, n in Counter(re.findall("[a-zÀ-ÿ]+", low(text))).items():
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += n
    return {w: n for w, n in out.items() if len(w) >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words, ratio=5):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def test_counts(spark, sf, monkeypatch):
    for df in (docs(spark, sf), odd(spark)):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        for damage in (None, 7):
            want = counted(rows, damage=damage)
            assert {r["word"]: r["n"] for r in op.word_counts(df, damage=damage).collect()} == want
    assert op.word_counts(odd(spark).limit(0), damage=7).count() == 0


def test_split_words():
    text = "Ünïcode ÀÿZ×÷ a1b_c 漢字kanji ﬁx don't\x00end"
    assert [w.decode() for w in op.split_words(text.encode())] == re.findall("[a-zÀ-ÿ]+", low(text))


@pytest.mark.parametrize("crowd", [1, 3, 32])
def test_near_words_of_crowded_halves(spark, crowd):
    """Words that share nearly all halves, in one shard and in many; chains of forms; ties."""
    rnd = random.Random(crowd)
    words = {}
    while len(words) < 500:
        w = "".join(rnd.choices("ab", k=rnd.randint(6, 9))) if rnd.random() < 0.6 else "prefix" + "".join(rnd.choices("abcé", k=rnd.randint(1, 4)))
        words[w] = rnd.choice([5, 5, 30, 160, 900])
    words |= {"longer" * 40: 5, "longer" * 40 + "s": 50, "longer" * 40 + "es": 5000}
    for size in (1 << 20, 1500):
        got = {tuple(r) for r in op.spelling_groups(table(spark, words), shard_bytes=size, crowd=crowd).collect()}
        assert got == grouped(words)


def test_long_chains(spark):
    words = {"abcdef" + "x" * i: 2**i for i in range(40)}
    got = {tuple(r) for r in op.spelling_groups(table(spark, words), ratio=2).collect()}
    assert got == grouped(words, 2)
    assert op.spelling_groups(table(spark, words).limit(0)).count() == 0


def test_query(spark, sf):
    words = {w: n for w, n in counted([(r["doc_id"], r["text"]) for r in docs(spark, sf).collect()], damage=199).items() if n >= 5}
    assert {tuple(r) for r in op.op11_spelling_variants(spark, sf).collect()} == grouped(words)
