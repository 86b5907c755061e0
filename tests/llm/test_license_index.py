"""The rare-word index with full notices, against a search of every place."""

import random
import re

import pytest
from pyspark.sql import functions as F

from eventide.llm import op1_license as op
from eventide.llm.license_texts import NOTICES

FILLER = "the of and software license permission copy use under notice any to is in this with or by terms public source".split()


def planted(seed=5, n=300):
    """Texts of frequent words with whole, cut, edited and doubled notices in them."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        body = rnd.choices(FILLER, k=rnd.randrange(0, 200))
        for _ in range(rnd.randrange(0, 3)):
            own = rnd.choice(NOTICES)[1].split()
            kind = rnd.randrange(5)
            if kind == 1:
                own = own[rnd.randrange(0, 6) :]
            elif kind == 2:
                own[rnd.randrange(len(own))] = "OTHER"
            elif kind == 3:
                del own[rnd.randrange(len(own))]
            elif kind == 4:
                own = own[: rnd.randrange(1, len(own))]
            at = rnd.randrange(len(body) + 1)
            body[at:at] = own
        rows.append((i, " ".join(body)))
    return rows


def places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    out = set()
    for t in op.TEMPLATES:
        tw = t.words
        for s in range(-len(tw), len(w)):
            if all(s + a >= 0 and w[s + a : s + a + n] == tw[a : a + n] for a, n in t.keys):
                out.add((t.label, s, sum(0 <= s + k < len(w) and w[s + k] == x for k, x in enumerate(tw)) / len(tw)))
    return out


def test_every_notice_is_found_whole(spark):
    rows = [(i, f"some words before\n{text}\nand after") for i, (_, text, _) in enumerate(NOTICES)]
    got = {r["doc_id"]: r for r in op.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(NOTICES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
    # Two clauses that share their first words keep apart.
    assert got[5]["labels"] == "bsl-1.0"


def test_planted_notices_equal_a_search_of_every_place(spark):
    rows = planted()
    got = {r["doc_id"]: {(m["label"], m["start"], m["share"]) for m in r["matches"]} for r in op.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: places(t) for i, t in rows}
    assert got == want and sum(map(len, want.values())) > 100


@pytest.mark.parametrize("seed", range(3))
def test_frequencies_never_change_the_result(seed):
    rnd, plain = random.Random(seed), op.RareWordIndex(op.TEMPLATES)
    other = op.RareWordIndex(op.TEMPLATES, 1000, {w: rnd.randrange(1000) for w in op.vocabulary(op.TEMPLATES)}, probes=1 + seed)
    for _, t in planted(seed, 100):
        w = op.words_of(t.encode())
        assert sorted(plain.find(w)) == sorted(other.find(w))


def test_frequencies_are_of_all_texts_and_prune(spark):
    rows = [(i, "permission is hereby granted by " + ("cc by" if i % 10 == 0 else "under the license")) for i in range(500)] + [(None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    n, f = op.word_frequencies(df, "text", op.vocabulary(op.TEMPLATES))
    assert n == 502 and f[b"permission"] == f[b"granted"] == 500 and f[b"cc"] == 50 and b"mozilla" not in f
    assert op.word_frequencies(df.where(F.lit(False)), "text", [b"cc"]) == (0, {})
    index = op.RareWordIndex(op.TEMPLATES, n, f)
    # The common words of a notice alone lead to no template; its rarest does.
    assert b"permission" not in index.postings and b"cc" in index.postings
    assert index.alive(set(op.words_of(b"permission is hereby granted free of charge"))) == []
    assert [op.TEMPLATES[i].label for i, _ in index.alive({b"cc", b"by", b"permission"})] == ["cc-by"]
