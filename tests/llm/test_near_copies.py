"""The near-copy stage against all pairs of shingle sets."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from eventide.llm import op8_simhash

from .test_operators import ODD, docs, low, odd, words_of


def shingles(text):
    w = words_of(low(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def survivors(rows):
    """The smallest id of each component at Jaccard similarity 0.8; equal sets first."""
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append(i)
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in combinations(sets, 2):
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) and find(a) is not find(b):
            root[find(a)] = find(b)
    least = {}
    for s, ids in sets.items():
        least.setdefault(find(s), []).extend(ids)
    return sorted(min((i is None, i or 0) for i in ids) for ids in least.values())


def kept(df, spark):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.near_copies(spark, df, "").collect())


def edited(rnd, words, n):
    out = list(words)
    for p in rnd.sample(range(len(out)), n):
        out[p] = f"e{rnd.randrange(1000)}"
    return " ".join(out)


def test_near_copies(spark, sf):
    rnd = random.Random(3)
    long = [t.split()[:200] for t in (r["text"] for r in docs(spark, sf).collect()) if len(set(t.split())) > 120]
    rows = [(5000 + i, edited(rnd, long[i % 12], i % 7)) for i in range(80)]
    df = docs(spark, sf).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = survivors([(r["doc_id"], r["text"]) for r in df.collect()])
    assert kept(df, spark) == want and len(want) < df.count() - 40
    assert kept(odd(spark), spark) == survivors([(r[0], r[1]) for r in ODD])


@pytest.mark.parametrize("crowd", [2, 64])
def test_crowded_keys(spark, monkeypatch, crowd):
    """One large group, where keys over the crowd need no more than two draws."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rnd, words, rnd.randint(0, 2))) for i in range(300)] + [(1000 + i, edited(rnd, words[::-1], rnd.randint(0, 2))) for i in range(20)]
    monkeypatch.setattr(op8_simhash.jaccard_links, "__defaults__", (crowd,))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(df, spark) == survivors(rows) == [(False, 0), (False, 1000)]


def of_template(rnd, clusters, per, words=120):
    """Rows of one text in clusters: a word of the cluster's and one of the row's are changed."""
    rows = []
    for c in range(clusters):
        own = [f"w{i}" for i in range(words)]
        own[rnd.randrange(words)] = f"c{c}"
        for k in range(per):
            row = list(own)
            row[rnd.randrange(words)] = f"r{c}_{k}"
            rows.append((len(rows), " ".join(row)))
    return rows


@pytest.mark.parametrize("crowd, block", [(64, 256), (1, 16)])
def test_every_key_crowded(spark, monkeypatch, crowd, block):
    """Hundreds of sets share every key, most pairs are just below the similarity, and chains of links hold them together."""
    monkeypatch.setattr(op8_simhash.jaccard_links, "__defaults__", (crowd,))
    monkeypatch.setattr(op8_simhash, "BLOCK_SETS", block)
    for clusters, per, seed in ((200, 2, 2),) if crowd > 1 else ((60, 2, 3),):
        rows = of_template(random.Random(seed), clusters, per)
        # Shorter rows of the same text: neighbouring classes of size.
        rows += [(5000 + i, " ".join(t.split()[: 119 - i])) for i, (_, t) in enumerate(rows[:40])]
        assert kept(spark.createDataFrame(rows, "doc_id long, text string"), spark) == survivors(rows)


def test_shared_elements():
    import numpy as np

    rnd = np.random.default_rng(1)
    one, two = ([np.unique(rnd.integers(0, 300, rnd.integers(0, 200))).astype(np.uint64) for _ in range(n)] for n in (9, 7))
    monkey = op8_simhash._shared(one, two)
    assert (monkey == [[len(np.intersect1d(a, b)) for b in two] for a in one]).all()
    assert op8_simhash._shared([], two).shape == (0, 7) and op8_simhash._shared(one, [np.empty(0, np.uint64)]).sum() == 0
    a, b = np.array([1, 2, 1, 3, 4]), np.array([2, 3, 3, 1, 5])
    assert op8_simhash._pick_links(a, b) == [0, 1, 4]


def test_copies_at_the_full_edit_budget(sf):
    """Items with a fifth of their characters edited, in the midst of other text."""
    import pyarrow.parquet as pq

    from eventide.llm import op4_decontam

    rnd = random.Random(9)
    items = [(r["item_id"], op4_decontam.normalise(r["text"].encode())) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    body = [op4_decontam.normalise((r["text"] or "").encode())[:500] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    texts, want = [], []
    for j, (i, t) in enumerate(items * 2):
        out = [t[k : k + 1] for k in range(len(t))]
        for k in rnd.sample(range(len(out)), len(out) // 5):
            out[k] = rnd.choice([b"", b"q", out[k] + b"z"])
        copy = op4_decontam.normalise(b"".join(out))
        if op4_decontam.fitting_distance(t, copy)[0] <= int(0.2 * len(t) + 1e-9):
            texts.append(body[j % len(body)] + b" " + copy + b" " + body[-1 - j % len(body)])
            want.append((i, t))
    got = op4_decontam.CgkIndex(items).search(texts)
    for (i, t), text, hits in zip(want, texts, got):
        near = {h[0]: h[1] for h in hits}
        assert i not in near or near[i] == op4_decontam.fitting_distance(t, text)[0]
    assert len(want) > len(items) and sum(i in [h[0] for h in hits] for (i, _), hits in zip(want, got)) >= 0.99 * len(want)
