import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import op9_lm

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the mat is on the log", "the cat sat"] * 12


def quantised(c):
    return float(op9_lm._MIDDLE[op9_lm._levels(np.array([c]))[0]]) if c else 0.0


def brute(rows):
    """log10 probability of texts of known words, by dictionaries of quantised counts."""
    grams, starts, tokens = Counter(), 0, 0
    for i, text in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            w = ["<s>", "<s>", *text.lower().split(), "</s>"]
            starts, tokens = starts + 1, tokens + len(w) - 2
            grams.update(tuple(w[k - n + 1 : k + 1]) for k in range(2, len(w)) for n in (1, 2, 3))
    ones = {g[0]: c for g, c in grams.items() if len(g) == 1}
    unseen = min(0.5, max(sum(c == 1 for c in ones.values()), 1) / tokens)
    mass = sum(map(quantised, ones.values()))
    grams[("<s>",)] = grams[("<s>", "<s>")] = starts

    def p(w, before):
        out, upper = (1 - unseen) * quantised(ones[w]) / mass, quantised(ones[w])
        for n, k in zip((2, 3), op9_lm.WORD_K):
            context = tuple(before[-(n - 1) :])
            own, upper_context = quantised(grams[(*context, w)]), quantised(grams[context])
            upper = min(own, upper, upper_context)
            out = (upper + k * out) / (upper_context + k)
        return out

    def score(text):
        w = ["<s>", "<s>", *text.lower().split(), "</s>"]
        return sum(np.log10(p(w[k], w[:k])) for k in range(2, len(w)))

    return score, p, list(ones)


def test_score_is_the_smoothed_ngram_model(spark):
    rows = list(enumerate(TEXTS))
    score, p, words = brute(rows)
    got = op9_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # False hits of the filter are rare: nearly every text has the very score.
    close = [abs(r["score"] - score(TEXTS[r["doc_id"]])) < 1e-6 for r in got]
    assert len(got) == len(rows) and np.mean(close) > 0.9
    # Added up over the known words it stays near one: a count is read at most a factor of the square root of BASE, and
    # rounding to whole counts, off, above and below the line alike.
    for before in (["<s>", "<s>"], ["the", "cat"], ["on", "the"], ["cat", "sat"]):
        assert 1 / op9_lm.BASE < sum(p(w, before) for w in words) < op9_lm.BASE


def test_word_order_counts(spark):
    good, mixed, new = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = [*enumerate(TEXTS), (good, "the cat sat on the mat"), (mixed, "mat the on sat cat the"), (new, "xq zzv qqk")]
    r = {x["doc_id"]: x for x in op9_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert r[good]["score"] > r[mixed]["score"] + 0.1 and abs(r[good]["base_score"] - r[mixed]["base_score"]) < 1e-9
    assert r[new]["score"] < r[good]["score"] - 3


def test_partitions_and_segments_do_not_move_scores(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one = {r["doc_id"]: r for r in op9_lm.score_texts(df.coalesce(1)).collect()}
    monkeypatch.setattr(op9_lm, "BLOCK_BYTES", 1 << 15)
    many = {r["doc_id"]: r for r in op9_lm.score_texts(df.repartition(7)).collect()}
    assert one.keys() == many.keys()
    for k, a in one.items():
        assert a["n_known"] == many[k]["n_known"] and np.isclose(a["base_score"], many[k]["base_score"], rtol=1e-12) and np.isclose(a["score"], many[k]["score"], rtol=1e-9)


def test_text_ids_keep_their_letters(spark):
    df = spark.createDataFrame([("007", "a b"), ("x\ny", "a b"), (None, "a b"), ("7", "a b")], "doc_id string, text string")
    got = {r["doc_id"]: r["held_out"] for r in op9_lm.score_texts(df).collect()}
    assert got == {i: zlib.crc32((i or "").encode()) % 10 == 0 for i in ("007", "x\ny", None, "7")}


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_model_leads_base_on_held_out(spark, table):
    r = op9_lm.score_texts(spark.read.parquet(f"/root/testdata/{table}/documents.parquet")).where("held_out").agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert r["m"] > r["b"]


def test_long_new_words_cost_by_length(spark):
    """A new word of any length is spelled to its end: no floor, and about the same for each letter."""
    import random

    rnd = random.Random(6)
    held = [i for i in range(1000, 4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    sizes = [50, 100, 200, 400, 1000, 10_000, 100_000]
    long = {i: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)) for i, n in zip(held, sizes)}
    rows = [*enumerate(TEXTS), *long.items()]
    got = {r["doc_id"]: r["score"] for r in op9_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    each = [got[i] / n for i, n in zip(held, sizes)]
    assert all(np.isfinite(each)) and max(each) < min(each) * 0.9 < 0
    # The score is the letters' and the end's: a word twice in a text costs twice.
    twice = op9_lm.score_texts(spark.createDataFrame([*enumerate(TEXTS), (held[0], long[held[3]]), (held[1], f"{long[held[3]]} {long[held[3]]}")], "doc_id long, text string")).collect()
    one, two = (next(r["score"] for r in twice if r["doc_id"] == i) for i in held[:2])
    assert abs(two - 2 * one) < 12
