"""The fences follow each group's own distribution."""

import random

import pytest
from pyspark.sql import functions as F

from eventide.llm import op7_quality as op7


def bounds(spark, groups):
    """Fences of rows (lang, source, value of every ratio)."""
    rows = spark.createDataFrame([(lang, source, int(v)) for lang, source, values in groups for v in values], "lang string, source string, v long")
    rows = rows.select("lang", "source", *[F.col("v").alias(f"__{k}") for k in op7.RATIOS])
    return {(r["lang"], r["source"]): r for r in op7.fences(rows, "lang", "source").collect()}


def test_unlike_groups_get_unlike_fences(spark):
    code, prose = [i % 900 for i in range(3000)], [i % 90 for i in range(3000)]
    got = bounds(spark, [("en", "code", code), ("en", "prose", prose)])
    for k, (_, _, spread, most, way) in op7.RATIOS.items():
        a, b = got["en", "code"][f"{k}_high"], got["en", "prose"][f"{k}_high"]
        # Within a bin and the pull of the language: the quartile and its distance from the median, and for shares a part of the rest.
        want = 675 + spread * 225
        want += (most - want) / way if most else 0
        assert a > b and abs(a - want) < 0.15 * want


def text_of(rnd, kind):
    """Sixty words in ten lines, with one kind of junk."""
    word = lambda n=0: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n or rnd.randint(3, 7)))
    words = [word(24) if kind == "word_length" and rnd.random() < 0.6 else word() for _ in range(70)]
    if kind == "symbols":
        words = [w + rnd.choice(["##", "$$", "|"]) for w in words]
    if kind == "repeats":
        words = [*words[:46], *words[:12], *words[46:]]
    lines = [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
    if kind == "dup_lines":
        lines += ["ok"] * len(lines)
        rnd.shuffle(lines)
    return "\n".join(lines)


@pytest.mark.parametrize("kind", list(op7.RATIOS))
@pytest.mark.parametrize("background", [0, 60])
def test_each_ratio_alone_rejects_its_junk(spark, kind, background):
    """With a fifth of the group as junk of that kind, or with a single row of it."""
    rnd = random.Random(7)
    rows = [(i, text_of(rnd, None), "en", "web") for i in range(240)] + [(1000 + i, text_of(rnd, kind), "en", "web") for i in range(background + 1)]
    out = op7.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in out)
    assert {r["doc_id"] for r in out if not r["kept"]} == {1000 + i for i in range(background + 1)}


def test_every_fence_of_a_share_can_be_passed(spark):
    got = bounds(spark, [("en", "all", [10000] * 500), ("de", "most", [9000] * 300 + [9900] * 200), ("fr", "none", [0] * 500)])
    for r in got.values():
        assert all(2500 <= r[f"{k}_high"] < 10000 for k in ("dup_lines", "repeats")) and r["symbols_high"] < 10000


def test_small_groups_lean_on_their_language(spark):
    many = [i % 100 for i in range(20000)]
    got = bounds(spark, [("en", "large", many), ("en", "one", [5000]), ("en", "some", [5000] * 100), (None, None, [7])])
    high = {s: r["repeats_high"] for (_, s), r in got.items()}
    assert high["large"] < high["one"] < high["some"] < 2 * 5000 and high["one"] < high["large"] + 300


def test_no_step_at_any_size(spark):
    """A group's fence moves a little with each row, as rows are added that differ from the language."""
    many = [i % 100 for i in range(40000)]
    sizes = range(60, 141, 40)
    got = bounds(spark, [("en", "large", many)] + [("en", f"n{n}", [1000] * n) for n in sizes])
    at = [got["en", f"n{n}"]["symbols_high"] for n in sizes]
    assert all(0 < b - a < 300 for a, b in zip(at, at[1:]))


def test_fences_decide_and_not_the_resolution(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")

    def kept():
        return {r["doc_id"] for r in op7.quality_rules(docs).where("kept").collect()}

    own = kept()
    monkeypatch.setattr(op7, "RESOLUTION", 0)
    without = kept()
    assert len(own ^ without) < 0.001 * docs.count()
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    passed = {r["doc_id"] for r in op7.quality_rules(docs).where("not base_failed").collect()}
    assert len(own & clean) > 0.99 * len(passed & clean)
    # Without any fence 291 rows of the labelled junk would stay.
    junk = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(own & junk) < 0.2 * len(passed & junk)
