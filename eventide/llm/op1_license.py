"""License scans: a positional index of rare licence words.

Every template is a run of words with mandatory key phrases at fixed places;
templates are one-line notices and the full notices of ``license_texts``. A
first pass counts in how many texts each licence word stands, over all texts
(partial counts a task, so only the licence words are gathered), which gives
their inverse document frequency. The index knows each template by its rarest
mandatory word and keeps the places of all mandatory words.

A text's licence words are looked up from the rarest on. A template whose
rarest word is not in the text is never met, and one that lacks another
mandatory word is dropped before any place is looked at. The places of a
template's rarest words, minus their places in the template, are possible
starts; these are intersected, and what is left is verified against the key
phrases. Key phrases are mandatory, so no frequency can lose a place: it
decides the cost and never the result.

Null texts are empty and give zero counts, empty labels and null places; an
empty table gives no rows. Texts of any length are searched whole; a chunk holds
one of them at least. Repeated rows each give a row; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import NOTICES
from .texts import UPPER, as_bytes, map_texts

#: A-Z to lower case, every other ASCII character but digits and a-z to space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Template:
    """A licence notice; ``keys`` are (first word, words) of its mandatory phrases."""

    label: str
    text: str
    keys: tuple[tuple[int, int], ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return [w.decode() for w in words_of(self.text.encode())]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def notice(label: str, text: str, phrases: tuple[str, ...]) -> Template:
    """A template whose keys are phrases of its text, each at its first place."""
    words = Template(label, text, ()).words
    keys = []
    for phrase in phrases:
        own = phrase.split()
        at = next((i for i in range(len(words)) if words[i : i + len(own)] == own), None)
        if at is None:
            raise ValueError(f"{label}: {phrase!r} is not in the text")
        keys.append((at, len(own)))
    return Template(label, text, tuple(keys))


#: The three base phrases and common licence notices.
TEMPLATES = (
    Template("cc-by", "cc by", ((0, 2),), True),
    Template("gpl", "general public license", ((0, 3),), True),
    Template("reserved", "all rights reserved", ((0, 3),), True),
    Template("apache-2.0", "licensed under the apache license version 2 0", ((3, 2), (5, 3))),
    Template("mit", "released under the mit license", ((3, 2),)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", ((0, 4), (7, 6))),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ((3, 4), (7, 2))),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ((3, 4), (7, 2))),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ((2, 3), (5, 2))),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ((2, 3), (5, 2))),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ((0, 3), (8, 4))),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ((6, 3), (9, 3))),
    *(notice(*n) for n in NOTICES),
)


def vocabulary(templates: tuple[Template, ...]) -> list[bytes]:
    """The words of the templates' key phrases."""
    return sorted({w.encode() for t in templates for a, n in t.keys for w in t.words[a : a + n]})


def word_frequencies(docs: DataFrame, text_col: str, words: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of texts, and for each of ``words`` the number of texts that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total, found = set(words), 0, Counter()
        for batch in batches:
            # One text at a time is unpacked.
            for text in batch.column(0):
                found.update(wanted.intersection(words_of(text.as_py())))
            total += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([None, *found], pa.binary()), pa.array([total, *found.values()], pa.int64())], names=["word", "n"])

    parts = docs.select(as_bytes(text_col).alias("text")).mapInArrow(count, "word binary, n long")
    # At most one row a licence word comes back.
    sums = {r["word"] and bytes(r["word"]): r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return sums.pop(None, 0), sums


class RareWordIndex:
    """Templates by their rarest mandatory word, with the places of all mandatory words."""

    def __init__(self, templates: tuple[Template, ...], texts: int = 0, frequencies: dict[bytes, int] | None = None, probes: int = 2) -> None:
        known = frequencies or {}
        self.idf = {w: math.log((1 + texts) / (1 + known.get(w, 0))) for w in vocabulary(templates)}
        self.templates = templates
        self.words = [[w.encode() for w in t.words] for t in templates]
        #: By rarest word: (template, its mandatory words, (word, place) of its rarest ones).
        self.postings: dict[bytes, list[tuple[int, frozenset[bytes], list[tuple[bytes, int]]]]] = {}
        for i, t in enumerate(templates):
            place: dict[bytes, int] = {}
            for a, n in t.keys:
                for k in range(a, a + n):
                    place.setdefault(self.words[i][k], k)
            rarest = sorted(place, key=lambda w: (-self.idf[w], w))
            self.postings.setdefault(rarest[0], []).append((i, frozenset(place), [(w, place[w]) for w in rarest[:probes]]))

    def alive(self, seen: set[bytes]) -> list[tuple[int, list[tuple[bytes, int]]]]:
        """Templates whose mandatory words are all in ``seen``, with their probes, from the rarest word of the text on."""
        heads = sorted(self.postings.keys() & seen, key=lambda w: (-self.idf[w], w))
        return [(i, probes) for w in heads for i, must, probes in self.postings[w] if must <= seen]

    def find(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of its words in place) of each verified place."""
        alive = self.alive(set(words))
        if not alive:
            return []
        places: dict[bytes, list[int]] = {w: [] for _, probes in alive for w, _ in probes}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        out = []
        for template, probes in alive:
            starts: set[int] | None = None
            for w, offset in probes:
                own = {p - offset for p in places[w]}
                starts = own if starts is None else starts & own
                if not starts:
                    break
            own = self.words[template]
            for s in starts or ():
                if all(s + a >= 0 and words[s + a : s + a + n] == own[a : a + n] for a, n in self.templates[template].keys):
                    same = sum(0 <= s + k < len(words) and words[s + k] == w for k, w in enumerate(own))
                    out.append((template, s, same / len(own)))
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document: word count, base places, labels, matches and score. Counts the licence words of ``docs`` first."""
    index = RareWordIndex(templates, *word_frequencies(docs, text_col, vocabulary(templates)))

    def scan(texts: list[bytes]) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")}
        for text in texts:
            words = words_of(text)
            found = index.find(words)
            base = [(s, templates[t].label) for t, s, _ in found if templates[t].base]
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            out["first_word"].append(min((s for s, _ in base), default=None))
            out["last_word"].append(max((s for s, _ in base), default=None))
            out["base_labels"].append(",".join(sorted({x for _, x in base})))
            out["labels"].append(",".join(sorted({templates[t].label for t, _, _ in found})))
            out["score"].append(max((x for _, _, x in found), default=0.0))
            out["matches"].append([{"label": templates[t].label, "start": s, "share": x} for t, s, x in sorted(found)])
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "matches": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())]))}
        return {k: pa.array(v, kinds[k]) for k, v in out.items()}

    return map_texts(docs, {id_col: F.col(id_col)}, text_col, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,share:double>>", scan)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")


def oracle() -> str:
    rows = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, {t.words!r}, {[list(k) for k in t.keys]!r})" for i, t in enumerate(TEMPLATES))
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
tpl(tid, label, base, tw, keys) AS (VALUES {rows}),
pos AS (SELECT rid, w, unnest(w) AS x, unnest(range(0, len(w)::BIGINT)) AS i FROM docs),
hit AS (
  SELECT rid, label, base, s,
         len(list_filter(range(1, len(tw) + 1), lambda k: s + k >= 1 AND s + k <= len(w) AND w[greatest(s + k, 1)] = tw[k]))::DOUBLE / len(tw) AS share
  FROM (SELECT *, i - keys[1][1] AS s FROM pos JOIN tpl ON x = tw[keys[1][1] + 1])
  WHERE len(list_filter(keys, lambda k: s + k[1] < 0 OR s + k[1] + k[2] > len(w)
        OR w[greatest(s + k[1] + 1, 1):s + k[1] + k[2]] <> tw[k[1] + 1:k[1] + k[2]])) = 0),
agg AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN agg USING (rid)"""
