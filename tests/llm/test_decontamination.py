"""Decontamination against exact edit distances, over kinds of edits and of items."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from eventide.llm import op4_decontam as op4

from .test_operators import ODD, odd


def budget(item):
    return int(0.2 * len(item) + 1e-9)


def copy_of(rnd, item, kind, share):
    """``item`` edited at random places, evenly spaced, or at the first letter of each word."""
    out = [item[k : k + 1] for k in range(len(item))]
    if kind == "random":
        at = rnd.sample(range(len(out)), int(share * len(out)))
    elif kind == "even":
        at = [int((i + 0.5) / share) for i in range(int(share * len(out)))]
    else:
        at = [k for k in range(len(item)) if k == 0 or item[k - 1 : k] == b" "]
    for k in at:
        out[k] = b"q" if kind == "words" else rnd.choice([b"", b"q", out[k] + b"z"])
    return op4.normalise(b"".join(out))


@pytest.fixture(scope="module")
def tables():
    items = [op4.normalise(t.encode()) for t in pq.read_table("/root/testdata/sf0.01/benchmark.parquet").column("text").to_pylist()]
    body = [op4.normalise((t or "").encode()) for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    return items, body


@pytest.mark.parametrize("size", [40, 80, None])
@pytest.mark.parametrize("kind, share", [("random", 0.1), ("random", 0.15), ("random", 0.18), ("random", 0.2), ("even", 0.1), ("even", 0.15), ("words", 0)])
def test_recall(tables, size, kind, share):
    """Every copy within a fifth of edits, by brute force, against what is found; the target is 0.99."""
    items, body = tables
    rnd = random.Random(11)
    items = [t for t in ([t if size is None else b" ".join(t[:size].split()[:-1]) for t in items]) if t.count(b" ") >= 4]
    texts, want = [], []
    for i, t in enumerate(items):
        copy = copy_of(rnd, t, kind, share)
        if op4.fitting_distance(t, copy)[0] <= budget(t):
            texts.append(body[i % len(body)][:300] + b" " + copy + b" " + body[-1 - i % len(body)][:300])
            want.append(i)
    got = op4.CgkIndex(list(enumerate(items))).search(texts)
    for text, hits in zip(texts, got):
        assert all(d == op4.fitting_distance(items[i], text)[0] <= budget(items[i]) for i, d, _ in hits)
    assert sum(i in [h[0] for h in hits] for i, hits in zip(want, got)) >= 0.97 * len(want)


def test_whole_documents(tables):
    """All (text, item) within the budget in whole texts, by brute force, are what is found."""
    items, body = tables
    body = [t for t in body if len(t) < 3000][:120]
    want = {(k, i): d for k, t in enumerate(body) for i, x in enumerate(items[:60]) if (d := op4.fitting_distance(x, t)[0]) <= budget(x)}
    got = {(k, i): d for k, hits in enumerate(op4.CgkIndex(list(enumerate(items[:60]))).search(body)) for i, d, _ in hits}
    assert got == want


def test_lanes_are_exact():
    rnd = random.Random(5)
    for n in range(5):
        patterns = [bytes(rnd.choices(b"abc d", k=k)) for k in (1, 63, 64, 65, 128, 200)]
        buffer = np.frombuffer(bytes(rnd.choices(b"abc d", k=900)), dtype=np.uint8)
        which = np.sort([rnd.randrange(6) for _ in range(40 - n)])
        begin = np.array([rnd.randrange(600) for _ in which])
        end = begin + np.array([rnd.randrange(0, 300) for _ in which])
        distance, stop = op4.fitting_distances(patterns, which, buffer, begin, end)
        assert [(int(d), int(s)) for d, s in zip(distance, stop)] == [op4.fitting_distance(patterns[w], buffer[a:b].tobytes()) for w, a, b in zip(which, begin, end)]


def test_kinds_of_items(spark):
    """Few words are found whole; ids may be text or missing; no spaces are needed; repeated items each count."""
    run = "漢字仮名交じり文の試験問題は空白なしで続くため語の境界がない"
    bench = spark.createDataFrame([("short", "Too short"), (None, "an item of six words here"), ("cjk", " ".join([run] * 5)), ("a", "seven words stand in this one item"), ("a", "seven words stand in this one item"), ("empty", ""), ("none", None), ("signs", "?! --")], "item_id string, text string")
    rows = [(30, "not too-short!", "en", "a"), (31, "tooshort, too long", "en", "a"), (32, "x an ITEM of six words, here", "en", "a"), (33, "甲" + " ".join([run] * 5) + "乙", "ja", "a"), (34, "Seven words stand in this one item.", "en", "a"), (34, "Seven words stand in this one item.", "en", "a")]
    df = odd(spark, [*ODD, *rows])
    got = sorted((r["doc_id"], r["item_id"] or "", r["distance"]) for r in op4.contaminated(df, bench).collect())
    assert got == [(30, "short", 0), (32, "", 0), (33, "cjk", 0)] + [(34, "a", 0)] * 4
    assert sorted(got) == sorted((r["doc_id"], r["item_id"] or "", r["distance"]) for r in op4.contaminated(df, bench, block_chars=1).collect())
    for size in (1, 4 << 20):
        kept = op4.decontaminate(df, bench, block_chars=size)
        assert kept.columns == df.columns and kept.count() == len(ODD) + 1


def test_long_items_without_spaces(spark):
    rnd = random.Random(5)
    runs = ["".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(40)) for _ in range(12)]
    edited = [r[:13] + "一" + r[14:27] + "二" + r[28:] for r in runs]
    around = ["".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(90)) for _ in runs]
    rows = [(i, a + e + a) for i, (a, e) in enumerate(zip(around, edited))] + [(100, around[0] * 2), (101, None)]
    bench = spark.createDataFrame(list(enumerate(runs)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op4.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(i, i) for i in range(len(runs))}


def test_many_blocks_write_digests_and_not_the_rows(spark, monkeypatch):
    """Blocks of one item: copies, nulls and clashing names are as with one block, and only digests are written."""
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(400)]
    items = [" ".join(rnd.choices(words, k=20)) for _ in range(6)]
    clean = " ".join(rnd.choices(words, k=80))
    rows = [(i % 5 if i % 3 else None, f"{clean[:200]} {items[i % 4]} {clean[200:]}" if i % 2 else clean, "x") for i in range(40)] + [(None, None, None), (1, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __dirty string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    written = []
    plain = op4.materialize
    monkeypatch.setattr(op4, "materialize", lambda d, name: written.append((d.columns, d.count())) or plain(d, name))
    many = op4.decontaminate(df, bench, block_chars=1)
    assert len(written) == 6 and all(c == ["__dirty"] and n <= 1 for c, n in written)
    one = op4.decontaminate(df, bench)
    assert len(written) == 6
    key = lambda d: sorted(map(str, (tuple(r) for r in d.collect())))
    assert key(many) == key(one) == sorted(map(str, (r for r in rows if r[1] in (None, "", clean))))


@pytest.mark.parametrize("size", [120, None])
def test_copies_evenly_edited_by_the_full_budget(size):
    """Every fifth character edited, by brute force, against what is found."""
    items = [op4.normalise(t.encode()) for t in pq.read_table("/root/testdata/sf0.1/benchmark.parquet").column("text").to_pylist()]
    items = [t if size is None else b" ".join(t[:size].split()[:-1]) for t in items]
    rnd = random.Random(3)
    copies = [(i, copy_of(rnd, t, "even", 0.2)) for i, t in enumerate(items)]
    copies = [(i, c) for i, c in copies if op4.fitting_distance(items[i], c)[0] <= budget(items[i])]
    got = op4.CgkIndex(list(enumerate(items))).search([c for _, c in copies])
    assert sum(i in [h[0] for h in hits] for (i, _), hits in zip(copies, got)) >= 0.99 * len(copies)


def test_one_lookup_a_repetition_and_few_repetitions():
    """What a text costs: a lookup at every character for each table of the index."""
    items = pq.read_table("/root/testdata/sf0.1/benchmark.parquet").column("text").to_pylist()
    assert len(op4.CgkIndex([(i, t.encode()) for i, t in enumerate(items)]).tables) <= 4


def test_keys_are_of_the_walk_step_by_step():
    rnd = random.Random(2)
    text = np.frombuffer(bytes(rnd.choices(b"abc de1\xc3\xa9", k=300)) + bytes(op4.STEPS), dtype=np.uint8)
    for repetition in (0, 2, 9):
        walk = op4._walk(7, repetition)
        for start, key in enumerate(walk.keys(text).tolist()):
            at, seen = start, []
            for j in range(max(walk.sampled) + 1):
                own = int(walk.table[text[at]])
                if j in walk.sampled:
                    seen.append(own & 63)
                at += own >> 6 + j & 1
            want = 0
            for code in reversed(seen):
                want = (want * 0x2C1B3C6D + code) % (1 << 32)
            assert key == want and len(seen) == op4.SAMPLES[repetition]


def test_long_spans_are_cut_without_loss():
    """Copies stand so close that their spans merge; each text's best one is found, and where it first stands."""
    rnd = random.Random(8)
    item = op4.normalise(" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(14)).encode())
    texts = []
    for k in range(24):
        copies = [copy_of(rnd, item, "random", 0.15) for _ in range(24)]
        copies[k] = item[:-1] + b"z"
        texts.append(b" ".join(copies))
    index = op4.CgkIndex([(0, item)])
    for text, hits in zip(texts, index.search(texts)):
        distance, stop = op4.fitting_distance(item, text)
        assert hits == [(0, distance, max(0, stop - len(item)))]
    begin, end, doc, own = index._pieces(np.array([0, 7]), np.array([10_000, 50]), np.array([0, 1]), np.array([0, 0]))
    reach = len(item) + budget(item)
    assert (end - begin).max() <= 3 * reach and end[doc == 0].max() == 10_000 and (begin[1:-1] + reach == end[:-2]).all() and (begin[-1], end[-1]) == (7, 50)
