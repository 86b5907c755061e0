"""The pipeline against its stages done one row at a time."""

from collections import Counter

import corpus_pipeline
from eventide.llm import op4_decontam, op7_quality

from .test_near_copies import survivors
from .test_operators import ODD, brute_quality, odd, words_of


def sketch_bin(x):
    for k in range(41, 0, -1):
        if x >= op7_quality.FINE << k:
            return x - x % (1 << k)
    return x


def quantiles(values):
    own = sorted(map(sketch_bin, values))
    return [next(v for i, v in enumerate(own, 1) if i * 100 >= len(own) * level) for level in op7_quality.LEVELS]


def brute_kept(rows):
    """Ids that the rules keep, of (id, text, lang, source): every quantile from sorted values."""
    ratios = []
    for i, text, lang, source in rows:
        n, chars, symbols, dup, repeats = brute_quality(text)
        lines = len([x for x in (text or "").split("\n") if words_of(x)])
        base = n < 50 or 100 * repeats > 50 * n
        ratios.append((i, lang, source, base, {"word_length": chars * 1000 // max(n, 1), "symbols": symbols * 10000 // max(n, 1), "dup_lines": dup * 10000 // max(lines, 1), "repeats": repeats * 10000 // max(n, 1)}))
    k = op7_quality.SHRINK

    def drawn(values, wide):
        return [(len(values) * q + k * w) // (len(values) + k) for q, w in zip(quantiles(values), wide)]

    kept = []
    for i, lang, source, base, own in ratios:
        ok = not base
        for name, (_, sides, spread, most, way) in op7_quality.RATIOS.items():
            wide = drawn([r[4][name] for r in ratios if r[1] == lang], quantiles([r[4][name] for r in ratios]))
            lower, middle, upper = drawn([r[4][name] for r in ratios if r[1:3] == (lang, source)], wide)
            fence = upper + max((upper - middle) * spread, op7_quality.RESOLUTION)
            if most:
                fence = min(fence, most * op7_quality.USUAL // 10)
                fence += (most - fence) // way
            least = lower - max((middle - lower) * spread, op7_quality.RESOLUTION) if sides == "both" else own[name]
            ok &= least <= own[name] <= fence
        if ok:
            kept.append(i)
    return kept


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    text = {r[0]: r[1] for r in rows}
    kept = brute_kept(rows)
    assert sorted(kept) == sorted(r["doc_id"] for r in op7_quality.quality_rules(docs).where("kept").collect())
    heads = [i for _, i in survivors([(i, text[i]) for i in kept])]
    items = [op4_decontam.normalise(r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [i for i in heads if not any(op4_decontam.fitting_distance(x, op4_decontam.normalise(text[i].encode()))[0] <= int(0.2 * len(x) + 1e-9) for x in items)]
    got = corpus_pipeline.run(spark, sf)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(clean)
    assert set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0


def test_stages_on_odd_rows(spark, sf):
    """Nulls, empty and long texts, repeated rows and clashing names pass all stages in sequence."""
    docs, n = odd(spark), len(ODD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd(spark).columns and docs.count() <= n
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, sf).count() == n and last(spark, odd(spark), sf).count() == len(ODD) and last(spark, docs.limit(0), sf).count() == 0
