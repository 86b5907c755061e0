"""Spelling variants at one edit, by Aho-Corasick automata over halves of words.

Of two words that differ by one inserted, deleted or replaced character, one
half of the first stands unchanged in the second, at its beginning or at its
end. The words are cut into shards of one length. A shard's automaton holds
both halves of all its words; every block of words of that length, or of one
more or less, is scanned by it as one text, with line ends as marks, so a
first half is found only where a word begins and a second half only where one
ends. Words that share the half are then held against each other exactly.

A half that more than ``CROWD`` words of the shard own is split again instead:
the edit lies in the rest of the word, so one half of the rest is unchanged as
well, and so on down to a rest of one character. Owners that remain differ in
that character only, so there are never more than there are characters.

Words are counted over all rows first: each task adds up what it has read and
sends its sums; the sums by word are partial aggregates. A shard and a block
meet in one task, and each word gets the number of its near words in the shard
and the most frequent of them, so no list of pairs is kept.

Null and empty texts have no words. A null id is an empty string in the
checksum. Repeated rows each count; other columns are ignored, whatever their
names. Texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import UPPER
from .work import discard, materialize

#: Words of a half beyond which the rest of the word is split as well.
CROWD = 32
#: Bytes of the words of a shard, distinct words that a task adds up before it sends them, and bytes of words compared at once.
SHARD_BYTES, HELD, STEP_BYTES = 2 << 20, 400_000, 8 << 20

_LETTERS = bytes(range(97, 123)) + bytes(range(0xC0, 0x100))
#: Latin-1: A-Z to a-z, letters as they are, and a space for everything else.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTERS else 32 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    """The text's runs of letters, A-Z lower-cased, as UTF-8."""
    flat = text.decode("utf-8", "replace").encode("latin-1", "replace").translate(_TABLE)
    return (flat if flat.isascii() else flat.decode("latin-1").encode()).split()


def _damaged(words: set[bytes], start: int, every: int) -> Iterator[tuple[bytes, bytes]]:
    """(word, word without one character) of the words whose checksum ``every`` divides; ``start`` is that of the id and colon."""
    crc = zlib.crc32
    for w in [w for w in words if crc(w, start) % every == 0]:
        t = w.decode()
        k = crc(w, start) % len(t)
        yield w, (t[:k] + t[k + 1 :]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, damage: int | None = None) -> DataFrame:
    """(word, n) of the words of ``least`` characters at least.

    With ``damage``, words lose one character in the documents where the
    checksum of the document's id and the word is a multiple of it.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")

    def sent(held: Counter) -> pa.RecordBatch:
        # A character takes one byte or two, so shorter words cannot be long enough.
        words = [w for w in held if len(w) >= least and (w.isascii() or len(w.decode()) >= least)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split_words(text.as_py())
                held.update(words)
                if damage:
                    found = list(_damaged(set(words), zlib.crc32(f"{own}:".encode()), damage))
                    times = Counter(words) if found else {}
                    for whole, rest in found:
                        held[whole] -= times[whole]
                        held[rest] += times[whole]
                if len(held) > HELD:
                    yield sent(held)
                    held = Counter()
        yield sent(held)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


# --- near words ---------------------------------------------------------------


class _Words:
    """Words of one length, in code-point order: characters, counts, and hashes of every beginning and end."""

    def __init__(self, length: int, words: bytes, counts: bytes) -> None:
        self.length = length
        self.chars = np.frombuffer(words, dtype=np.uint8).reshape(-1, length)
        self.counts = np.frombuffer(counts, dtype=np.int64)
        self._ends = [self._hashed(self.chars, 0x9E3779B97F4A7C15), self._hashed(self.chars[:, ::-1], 0xBF58476D1CE4E5B9)]

    @staticmethod
    def _hashed(chars: np.ndarray, factor: int) -> np.ndarray:
        out = np.zeros((chars.shape[1] + 1, len(chars)), dtype=np.uint64)
        for i in range(chars.shape[1]):
            mixed = out[i] * np.uint64(factor) + chars[:, i] + np.uint64(1)
            out[i + 1] = mixed ^ (mixed >> np.uint64(29))
        return out

    def keys(self, at: np.ndarray, first: int, last: int) -> np.ndarray:
        """One number for the first and last so many characters of the words ``at``."""
        return self._ends[0][first][at] * np.uint64(0x94D049BB133111EB) + self._ends[1][last][at]

    def text(self, at: np.ndarray) -> list[str]:
        flat = self.chars[at].tobytes().decode("latin-1")
        return [flat[i : i + self.length] for i in range(0, len(flat), self.length)]


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two character tables differ by exactly one edit; their widths differ by one at most."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    m = a.shape[1]
    same = np.ones((len(a), m + 1), dtype=bool)
    same[:, :m] = a != b[:, :m]
    begin = same.argmax(axis=1)
    same[:, :m] = (a != b[:, 1:])[:, ::-1]
    return begin + same.argmax(axis=1) >= m


def _matched(owners: np.ndarray, owner_keys: np.ndarray, seekers: np.ndarray, seeker_keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owners in key order, and for every seeker the first of its key's owners and their number."""
    order = np.argsort(owner_keys, kind="stable")
    ordered = owner_keys[order]
    first = np.searchsorted(ordered, seeker_keys)
    return owners[order], first, np.searchsorted(ordered, seeker_keys, side="right") - first


class _Shard:
    """Near words between a shard and blocks of words, by the automaton of the shard's halves."""

    def __init__(self, words: _Words, crowd: int = CROWD) -> None:
        import ahocorasick

        self.words, self.crowd = words, crowd
        self.cut = cut = words.length // 2
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        for kind, (a, z) in enumerate(((0, cut), (cut, words.length))):
            part = np.ascontiguousarray(words.chars[:, a:z])
            halves, group = np.unique(part.view(f"V{z - a}").ravel(), return_inverse=True)
            self.groups.append((np.argsort(group, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(halves)))])))
            for i, half in enumerate(halves.tolist()):
                t = bytes(half).decode("latin-1")
                self.automaton.add_word("\n" + t if kind == 0 else t + "\n", 2 * i + kind)
        self.automaton.make_automaton()

    def near(self, block: _Words) -> tuple[np.ndarray, np.ndarray]:
        """(word of the block, word of the shard) of every two that differ by one edit, each once."""
        text = np.full((len(block.chars), block.length + 1), 10, dtype=np.uint8)
        text[:, :-1] = block.chars
        hits = np.fromiter(chain.from_iterable(self.automaton.iter("\n" + text.tobytes().decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
        found = [np.empty(0, dtype=np.int64)]
        for kind, (order, starts) in enumerate(self.groups):
            own = hits[hits[:, 1] & 1 == kind]
            group, seekers = own[:, 1] >> 1, own[:, 0] // (block.length + 1) - kind
            rest = (self.cut, self.words.length) if kind == 0 else (0, self.cut)
            self._meet(block, *rest, order, seekers, starts[group], starts[group + 1] - starts[group], found)
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.words.chars), pairs % len(self.words.chars)

    def _meet(self, block: _Words, a: int, z: int, owners: np.ndarray, seekers: np.ndarray, first: np.ndarray, n: np.ndarray, found: list[np.ndarray]) -> None:
        """Hold seekers against their owners, which agree but for the characters from ``a`` to ``z`` of an owner."""
        few = (n <= self.crowd) if z - a > 1 else np.ones(len(n), dtype=bool)
        self._compare(block, owners, seekers[few & (n > 0)], first[few & (n > 0)], n[few & (n > 0)], found)
        many = ~few
        if not many.any():
            return
        marked = np.zeros(len(owners) + 1, dtype=np.int64)
        np.add.at(marked, first[many], 1)
        np.add.at(marked, first[many] + n[many], -1)
        owners, seekers = owners[np.cumsum(marked[:-1]) > 0], seekers[many]
        middle = (a + z) // 2
        for x, y in ((middle, z), (a, middle)):
            keys = (w.keys(at, x, self.words.length - y) for w, at in ((self.words, owners), (block, seekers)))
            self._meet(block, x, y, *_reordered(_matched(owners, next(keys), seekers, next(keys)), seekers), found)

    def _compare(self, block: _Words, owners: np.ndarray, seekers: np.ndarray, first: np.ndarray, n: np.ndarray, found: list[np.ndarray]) -> None:
        upto = np.cumsum(n)
        step = max(1, STEP_BYTES // self.words.length)
        at = 0
        while at < len(n):
            until = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, side="right")))
            k = n[at:until]
            mine = np.repeat(seekers[at:until], k)
            place = np.arange(len(mine)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[at:until], k)
            theirs = owners[place]
            near = _near(block.chars[mine], self.words.chars[theirs])
            found.append(mine[near] * len(self.words.chars) + theirs[near])
            at = until


def _reordered(matched: tuple[np.ndarray, ...], seekers: np.ndarray) -> tuple[np.ndarray, ...]:
    owners, first, n = matched
    return owners, seekers, first, n


_FOUND = "word string, n_near long, best_n long, best string"


def _met(crowd: int):
    def run(table: pa.Table) -> pa.Table:
        roles = table.column("role").to_pylist()
        empty = {"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())}
        if sorted(roles) != [0, 1]:
            return pa.table(empty)
        shard, block = (_Words(*(table.column(c)[roles.index(k)].as_py() for c in ("length", "words", "counts"))) for k in (0, 1))
        mine, theirs = _Shard(shard, crowd).near(block)
        if not len(mine):
            return pa.table(empty)
        order = np.lexsort((theirs, -shard.counts[theirs], mine))
        mine, theirs = mine[order], theirs[order]
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        return pa.table({"word": block.text(mine[first]), "n_near": np.diff(first, append=len(mine)), "best_n": shard.counts[theirs[first]], "best": shard.text(theirs[first])})

    return run


def _packed(table: pa.Table) -> pa.Table:
    words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    order = sorted(range(len(words)), key=words.__getitem__)
    return pa.table({
        "length": table.column("length")[:1], "shard": table.column("shard")[:1], "words": pa.array(["".join([words[i] for i in order]).encode("latin-1")], pa.binary()), "counts": pa.array([counts[order].tobytes()], pa.binary()),
    })


def near_words(words: DataFrame, shard_bytes: int = SHARD_BYTES, crowd: int = CROWD) -> DataFrame:
    """(word, n_near, best_n, best) of the words with a near word; ``words`` has distinct words of U+0000 to U+00FF and their n."""
    sized = words.select("word", "n", F.length("word").alias("length"))
    shards = materialize(sized.groupBy("length").agg(F.ceil(F.count("*") * F.greatest(F.col("length"), F.lit(8)) / shard_bytes).cast("int").alias("shards")), "shards")
    placed = sized.join(shards, "length").withColumn("shard", F.pmod(F.xxhash64("word"), F.col("shards")).cast("int"))
    blocks = materialize(placed.select("word", "n", "length", "shard").groupBy("length", "shard").applyInArrow(_packed, "length int, shard int, words binary, counts binary"), "blocks")

    # A shard meets the blocks of its length and of one more or less, each in a task of its own.
    other = shards.select(F.col("length").alias("l"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s"))
    reach = F.explode(F.array(*[F.col("length") + d for d in (-1, 0, 1)])).alias("l")
    meets = blocks.select("*", reach).join(other, "l")
    here, there = F.struct("length", "shard"), F.struct(F.col("l").alias("length"), F.col("s").alias("shard"))
    both = [meets.select(F.lit(role).alias("role"), "length", "words", "counts", a.alias("a"), b.alias("b")) for role, a, b in ((0, here, there), (1, there, here))]
    n = blocks.select("length", reach).join(other, "l").count()
    found = both[0].unionByName(both[1]).repartition(max(1, min(4 * n, 10_000)), "a", "b").groupBy("a", "b").applyInArrow(_met(crowd), _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best"))


def spelling_groups(words: DataFrame, ratio: int = 5, **options) -> DataFrame:
    """word, form, root, n, n_near and form_n of distinct words with counts ``n``.

    A word's form is its most frequent near word, if that is ``ratio`` times as
    frequent. Each step multiplies the count, so chains of forms have few links
    and their ends are found by doubling: as many joins as the chain's length
    has bits.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent as its word")
    near = near_words(words, **options)
    rows = words.join(near, "word", "left")
    formed = F.col("best_n") >= ratio * F.col("n")
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    links = materialize(rows.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(links.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        discard(links)
        links = after
        if after.where("moved").isEmpty():
            break
    return rows.join(links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), damage=199)
    return spelling_groups(materialize(words.where("n >= 5"), "words"))


def oracle() -> str:
    return f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  GROUP BY ALL),
crc AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x, length(run) AS len,
         xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
             lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS h
  FROM runs, tab),
v AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % len)::BIGINT) || substr(run, (h % len)::BIGINT + 2) ELSE run END AS word, n FROM crc)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
-- Two words are near if one is the other without a character, or both are alike without the same character.
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN v b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, max(n) AS best_n, min(struct_pack(k := -n, w := other)).w AS best FROM pairs GROUP BY word),
formed AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN near USING (word)),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON chain.root = formed.word WHERE formed.form IS NOT NULL)
SELECT formed.word, formed.form, chain.root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN chain USING (word) JOIN formed f ON f.word = chain.root WHERE f.form IS NULL"""
