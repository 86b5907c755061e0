"""Exact top-k against sorting every score."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventide.llm import op13_topk as op


def best(rows, k, every=20):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for at, (q, a) in enumerate(whole):
        if q % every == 0:
            scores = sorted((-max(-(2**61), min(2**61, sum(x * y for x, y in zip(a, b)))), i) for n, (i, b) in enumerate(whole) if n != at)
            out.update((q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1))
    return out


def found(spark, rows, k, kind="float", parts=3):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(parts).withColumns({c: F.lit("clash") for c in ("id", "score", "rank", "block", "row", "part")})
    return Counter(tuple(r) for r in op.top_k(df, k, F.col("vec_id") % 20 == 0).collect())


def vectors(rnd, n, width=8):
    return [(i, [rnd.uniform(-2, 2) for _ in range(width)]) for i in range(n)]


def test_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in op.op13_exact_topk(spark, sf).collect()) == best(rows, 20)


def test_steps_of_every_size(spark, monkeypatch):
    """Blocks, groups and passes much smaller than the table."""
    monkeypatch.setattr(op, "BITS", 5)
    monkeypatch.setattr(op, "QUERIES", 8)
    monkeypatch.setattr(op, "GROUP_BYTES", 5000)
    rows = vectors(random.Random(1), 300)
    assert found(spark, rows, 7, "double") == best(rows, 7)


def test_ties_and_repeated_rows(spark):
    """One vector holds a third of all rows; queries are among them; rows repeat."""
    rows = vectors(random.Random(2), 200) + [(i, [1.0] * 8) for i in range(1000, 1150)] + [(40, [0.5] * 8)] * 3
    assert found(spark, rows, 20, "double") == best(rows, 20)


def test_odd_vectors(spark):
    rows = vectors(random.Random(3), 60) + [(None, [1.0] * 8), (80, None), (100, [1.0, None]), (120, [float("nan")] * 8), (140, [float("inf")] * 8), (160, []), (180, [1.5]), (200, [0.25] * 20), (-20, [-0.01] * 8)]
    assert found(spark, rows, 5, "double") == best(rows, 5)


def test_few_rows(spark):
    rows = vectors(random.Random(4), 10)
    assert found(spark, rows, 20) and found(spark, rows, 20, "double") == best(rows, 20)
    assert not found(spark, rows[:1], 20)
    assert not found(spark, rows[1:], 20)
    assert op.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), 20, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("size", [1e6, 1e8, 1e300])
def test_scores_beyond_floats(spark, size):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) * size for _ in range(3)]) for i in range(45)]
    assert found(spark, rows, 6, "double") == best(rows, 6)
