"""LM scoring: a log-frequency Bloom filter of quantised word n-gram counts.

Base: add-0.1 unigram probabilities of tokens, with exact counts. Model: word
1- to 3-grams, each order backing off to the one below by
``p_n = (c(n-gram) + K_n * p_{n-1}) / (c(context) + K_n)``. Known words start
from ``(1 - u) * c(w) / Z``; the mass ``u`` (the share of tokens seen once) goes to
new words, which a model of letter 1- to 4-grams, built alike over the training
tokens, spells. All counts of the model, words' and letters', come from the
filter: quantised to powers of ``BASE``, an n-gram of level q is present as
(n-gram, 1) to (n-gram, q), and a count is read by probing level after level
until one is missing. An n-gram counts no more often than its parts, which
takes off most false hits.

The filter grows with the corpus, so it is no broadcast: it is cut by the
n-grams' hash into segments of about ``SEGMENT_ENTRIES`` entries, as many as
the counted tokens ask for. A block of texts sends its distinct n-grams once to
the segments, which add them up, fill their filters, probe them and send levels
back; a filter lives in its segment's task and is not written. Orders are the
same at every size. A frequent n-gram is one entry a block in its segment, not
one an occurrence.

``score`` sums to one over the next token up to quantisation (a context's level
against those of its followers) and false hits. Tokens are told apart by
XXH64, n-grams by the segment and 32 more bits.

Training rows: crc32 of the id as text, modulo 10, is not 0 (a null id is the
empty text, which is held out). Null texts are empty: one end token. Repeated
rows count each time and each give a row. An empty table gives none. Other
columns are not read, so their names cannot clash. Texts of any length are
scored whole; a block holds at least one. Without training rows N and V are 0:
the base gives each token probability 1, and the model spells every word with
equal bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import as_bytes
from .work import materialize

ALPHA, BASE = 0.1, 2.0**0.5
#: What a context's shorter form weighs, in occurrences: word 2- and 3-grams, letter 1- to 4-grams.
WORD_K, LETTER_K = (1000.0, 10.0), (2.0, 2.0, 2.0, 2.0)
HASHES, BITS_PER_ENTRY = 4, 10
BLOCK_BYTES, SEGMENT_ENTRIES, LEAST_SEGMENT_BITS = 8 << 20, 1 << 21, 3
#: Entries a token can make: two word n-grams, and the letters' share.
ENTRIES_PER_TOKEN = 2
_START, _END = np.uint64(0x5D1E7A11C0FFEE01), np.uint64(0x0DDBA11D00D5EA57)
_MIDDLE = np.concatenate([[0.0], (BASE ** np.arange(127) + np.maximum(np.ceil(BASE ** np.arange(1, 128)) - 1, 1)) / 2])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), a.nbytes) + p for a, p in zip(arrays, planes)), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        size = int(kind[1:])
        planes = np.frombuffer(raw, dtype=np.uint8, count=n, offset=at + 10).reshape(size, n // size)
        out.append(np.ascontiguousarray(planes.T).view(kind.decode()).reshape(-1))
        at += 10 + n
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Codes(dict):
    def __missing__(self, key) -> int:
        self[key] = code = len(self)
        return code


# --- blocks of texts --------------------------------------------------------


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, tokens, ends, letters, payload): texts as numbers of the block's distinct words, in the order of their hashes.

    ``tokens`` counts all, ``ends`` the training texts, ``letters`` the bytes and ends of training words.
    """

    def emit(block: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        codes = _Codes()
        split = [t.lower().split() for t in texts]
        n = np.array([len(x) for x in split], dtype=np.uint32)
        flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(n.sum()))
        del split
        words = list(codes)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        order = np.argsort(hashes)
        place = np.empty(len(words), dtype=np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        train = np.array([i is not None and zlib.crc32(i.encode()) % 10 != 0 for i in ids])
        counts = np.bincount(place[flat[np.repeat(train, n)]], minlength=len(words)).astype(np.uint32)
        words = [words[i] for i in order.tolist()]
        names = [b"" if i is None else i.encode() for i in ids]
        sizes = np.array([-1 if i is None else len(x) for i, x in zip(ids, names)], dtype=np.int32)
        letters = int((counts * np.array([len(w) + 1 for w in words], dtype=np.int64)).sum()) if words else 0
        payload = _pack(np.frombuffer(b"".join(names), np.uint8), sizes, train.astype(np.uint8), n, place[flat], np.frombuffer(b"\n".join(words), np.uint8), counts)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((block, pa.int64()), (len(flat) + len(ids), pa.int64()), (int(train.sum()), pa.int64()), (letters, pa.int64()), (payload, pa.binary()))], names=["block", "tokens", "ends", "letters", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 24, 0
        ids: list = []
        texts: list[bytes] = []
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and size + len(t) > BLOCK_BYTES:
                    yield emit(block, ids, texts)
                    ids, texts, size, block = [], [], 0, block + 1
                ids.append(i)
                texts.append(t)
                size += len(t) + 64
        if texts:
            yield emit(block, ids, texts)

    return docs.select(F.col(id_col).cast("string").alias("id"), as_bytes(text_col).alias("text")).mapInArrow(run, "block long, tokens long, ends long, letters long, payload binary")


class _Block:
    """A block's texts, and the n-grams of its words in texts and of the letters in its distinct words."""

    def __init__(self, payload: bytes) -> None:
        names, sizes, train, n, self.codes, raw, self.counts = _unpack(payload)
        self.names, self.sizes, self.train, self.n = names.tobytes(), sizes, train.astype(bool), n.astype(np.int64)
        self.words = raw.tobytes().split(b"\n") if len(self.counts) else []
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), dtype=np.uint64, count=len(self.words))
        self.length = np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words))
        self.at, self.inside = _places(self.n)
        self.letter_at, self.letter_inside = _places(self.length)

    def ngrams(self, bits: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Distinct keys (segment bits and 32 more), their training counts, and for every order of words, then letters, the place of each n-gram among the keys."""
        parts = [*self._of_words(bits), *self._of_letters(bits)]
        # Sorted runs merge faster than np.unique hashes.
        keys = np.sort(np.concatenate([k for k, _, _ in parts]), kind="stable")
        keys = keys[np.diff(keys, prepend=~keys[:1]) != 0]
        counts = np.zeros(len(keys), dtype=np.uint32)
        places = []
        for own, inverse, n in parts:
            at = np.searchsorted(keys, own)
            counts[at] += n.astype(np.uint32)
            places.append((at, inverse))
        return keys, counts, places

    def _of_words(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        tokens = np.full(len(self.at), _END)
        tokens[self.inside] = self.hashes[self.codes]
        train = np.repeat(self.train, self.n + 1)
        for order in range(2, len(WORD_K) + 2):
            gram = np.full(len(tokens), order, dtype=np.uint64)
            for back in range(order - 1, -1, -1):
                gram = _hash(gram * np.uint64(31) + _before(tokens, self.at, back, _START))
            keys, inverse = np.unique(gram >> np.uint64(32 - bits), return_inverse=True)
            yield keys, inverse.astype(np.int32), np.bincount(inverse[train], minlength=len(keys))

    def _of_letters(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """An order's distinct n-grams are numbered by (number of the context, letter), so nothing is sorted by position."""
        letters = np.full(len(self.letter_at), 256)
        letters[self.letter_inside] = np.frombuffer(b"".join(self.words), dtype=np.uint8)
        weight = np.repeat(self.counts.astype(np.float64), self.length + 1)
        context, hashes = np.zeros(len(letters), dtype=np.int64), np.array([_START])
        for order in range(1, len(LETTER_K) + 1):
            code = context * 257 + letters
            found = np.flatnonzero(np.bincount(code))
            number = np.zeros(int(found.max(initial=0)) + 1, dtype=np.int32)
            number[found] = np.arange(len(found))
            inverse = number[code]
            hashes = _hash(hashes[found // 257] * np.uint64(31) + (found % 257).astype(np.uint64) + np.uint64(1024 * order))
            keys, same = np.unique(hashes >> np.uint64(32 - bits), return_inverse=True)
            yield keys, same[inverse].astype(np.int32), np.bincount(same[inverse], weights=weight, minlength=len(keys))
            # The next letter's context is this n-gram, or the start with number len(found).
            context, hashes = _before(inverse, self.letter_at, 1, len(found)), np.append(hashes, _hash(_START + np.array([order], dtype=np.uint64)))


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sequences that each take an end, and which are not that end."""
    m = n + 1
    ends = np.cumsum(m)
    total = int(ends[-1]) if len(m) else 0
    own = np.ones(total, dtype=bool)
    own[ends - 1] = False
    return np.arange(total) - np.repeat(ends - m, m), own


def _before(values: np.ndarray, at: np.ndarray, back: int, start) -> np.ndarray:
    return np.where(at >= back, np.roll(values, back), start)


# --- the filter ---------------------------------------------------------------


def _levels(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9)).astype(np.int64)


def _probes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    x = _hash(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return x >> np.uint64(32), x & np.uint64(0xFFFFFFFF) | np.uint64(1)


def _spot(a: np.ndarray, b: np.ndarray, i: int, bits: int) -> np.ndarray:
    return ((((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)


class LogFrequencyBloom:
    """One segment: a Bloom filter of (key, level)."""

    def __init__(self, bits: int, data: bytes) -> None:
        self.bits, self.data = bits, np.frombuffer(data, dtype=np.uint8)

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> LogFrequencyBloom:
        """The filter of distinct keys with counts of at least one."""
        level = _levels(counts)
        bits = max(64, -(-int(level.sum()) * BITS_PER_ENTRY // 64) * 64)
        own = np.zeros(bits, dtype=bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            a, b = _probes(keys[level >= q], q)
            for i in range(HASHES):
                own[_spot(a, b, i, bits)] = True
        return cls(bits, np.packbits(own, bitorder="little").tobytes())

    def levels(self, keys: np.ndarray) -> np.ndarray:
        level = np.zeros(len(keys), dtype=np.uint8)
        still, q = np.arange(len(keys)), 1
        while len(still):
            a, b = _probes(keys[still], q)
            for i in range(HASHES):
                at = _spot(a, b, i, self.bits)
                hit = (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                still, a, b = still[hit], a[hit], b[hit]
            level[still] = q
            q += 1
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count that each key's levels stand for; 0 where there is none."""
        return _MIDDLE[self.levels(keys)]


def _cut(payload: bytes, bits: int) -> Iterator[tuple[int, bytes]]:
    """A block's distinct words and n-grams with their training counts, by segment."""
    block = _Block(payload)
    keys, counts, _ = block.ngrams(bits)
    edges = np.arange((1 << bits) + 1, dtype=np.uint64)
    grams = np.searchsorted(keys, edges << np.uint64(32))
    words = np.searchsorted(block.hashes >> np.uint64(64 - bits), edges)
    low = keys.astype(np.uint32)
    for s in range(1 << bits):
        w, g = slice(words[s], words[s + 1]), slice(grams[s], grams[s + 1])
        if w.start < w.stop or g.start < g.stop:
            yield s, _pack(_steps(block.hashes[w]), block.counts[w], _steps(low[g]), counts[g])


def _asked(blocks: DataFrame, bits: int) -> DataFrame:
    """(block, segment, payload) of ``_cut``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                segments, data = zip(*_cut(payload, bits))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(data), pa.int64()), pa.array(segments, pa.int32()), pa.array(data, pa.binary())], names=["block", "segment", "payload"])

    return blocks.select("block", "payload").mapInArrow(run, "block long, segment int, payload binary")


def _read(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, n, grams, counts = _unpack(payload)
    return np.cumsum(words, dtype=np.uint64), n, np.cumsum(grams, dtype=np.uint32).astype(np.uint64), counts


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of sorted lists, the sums of their counts, and the place of each listed key among them."""
    listed = np.concatenate(keys)
    order = np.argsort(listed, kind="stable")
    ordered = listed[order]
    new = np.diff(ordered, prepend=~ordered[:1]) != 0
    place = np.empty(len(listed), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    distinct = ordered[new]
    return distinct, np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64), place


def _answers(asked: DataFrame) -> DataFrame:
    """(block, segment, tokens, kinds, once, mass, payload): every segment's filter, and what it says to each block.

    The filter's row has block -1 and the sums of its words; a block's row has exact counts and levels of its words and levels of
    its n-grams. Both come from one gathering of the blocks' n-grams.
    """

    def answer(table: pa.Table) -> pa.Table:
        parts = [_read(x) for x in table.column("payload").to_pylist()]
        words, n, word = _sum([p[0] for p in parts], [p[1] for p in parts])
        grams, counts, gram = _sum([p[2] for p in parts], [p[3] for p in parts])
        cuts = [np.cumsum([len(p[k]) for p in parts])[:-1] for k in (0, 2)]
        rest = [0] * len(parts)
        del parts
        bloom = LogFrequencyBloom.of(np.concatenate([words[n > 0], grams[counts > 0]]), np.concatenate([n[n > 0], counts[counts > 0]]))
        # Every distinct key is probed once, however many blocks ask for it.
        told = zip(np.split(n[word], cuts[0]), np.split(bloom.levels(words)[word], cuts[0]), np.split(bloom.levels(grams)[gram], cuts[1]))
        data = [b"", *[_pack(*x) for x in told]]
        return pa.table({
            "block": pa.array([-1, *table.column("block").to_pylist()], pa.int64()), "segment": pa.array(table.column("segment")[:1].to_pylist() * len(data), pa.int32()),
            "tokens": [int(n.sum()), *rest], "kinds": [int((n > 0).sum()), *rest], "once": [int((n == 1).sum()), *rest], "mass": pa.array([_MIDDLE[_levels(n[n > 0])].sum(), *rest], pa.float64()),
            "payload": pa.array(data, pa.binary()),
        })

    return asked.groupBy("segment").applyInArrow(answer, "block long, segment int, tokens long, kinds long, once long, mass double, payload binary")


# --- scoring ----------------------------------------------------------------


def _back_off(p: np.ndarray, counts: list[np.ndarray], at: np.ndarray, first: np.ndarray | float, starts: float, weights: tuple[float, ...]) -> np.ndarray:
    """``p`` smoothed by one higher order after another; ``first`` counts the contexts of the first of ``counts``."""
    context = first
    for c, k in zip(counts, weights):
        c = np.minimum(c, context)
        p = (c + k * p) / (context + k)
        context = _before(c, at, 1, starts)
    return p


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """held_out, token numbers, base and model log10 probability of each row."""
    blocks = materialize(_blocks(docs, id_col, text_col), "blocks")
    size, ends, letters = (int(x or 0) for x in blocks.agg(F.sum("tokens"), F.sum("ends"), F.sum("letters")).first())
    bits = max(LEAST_SEGMENT_BITS, (ENTRIES_PER_TOKEN * size // SEGMENT_ENTRIES).bit_length())
    answers = materialize(_answers(_asked(blocks, bits)), "filter")
    tokens, kinds, once, mass = (x or 0 for x in answers.where("block < 0").agg(F.sum("tokens"), F.sum("kinds"), F.sum("once"), F.sum("mass")).first())
    tokens, kinds, once = tokens + ends, kinds + (ends > 0), once + (ends == 1)
    starts = float(_MIDDLE[_levels(np.array([ends]))[0]]) if ends else 0.0
    mass += starts
    unseen = min(0.5, max(once, 1) / tokens) if tokens else 1.0

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(texts.column("payload")[0].as_py())
        n, at = block.n, block.at
        order = np.argsort(answers.column("segment").to_numpy())
        parts = [_unpack(answers.column("payload")[int(i)].as_py()) for i in order]
        exact = np.concatenate([p[0] for p in parts] or [np.empty(0)]).astype(np.float64)
        words = _MIDDLE[np.concatenate([p[1] for p in parts] or [np.empty(0, np.uint8)])]
        levels = np.concatenate([p[2] for p in parts] or [np.empty(0, np.uint8)])
        counts = [_MIDDLE[levels[place]][inverse] for place, inverse in block.ngrams(bits)[2]]
        own, spelt = counts[: len(WORD_K)], counts[len(WORD_K) :]

        # New words, by their letters.
        p = _back_off(np.full(len(block.letter_at), 1 / 257), spelt, block.letter_at, float(letters), float(tokens - ends), LETTER_K)
        spell = _sums(np.log10(p), block.length + 1)
        # A new word's counts are zero in every order, so its spelling is a factor of its probability and joins as a logarithm, however long the word.
        start = np.where(words > 0, (1 - unseen) * words / max(mass, 1.0), unseen)
        spelt_log = np.append(np.where(words > 0, 0.0, spell), 0.0)

        # All places: words and ends.
        end = max((1 - unseen) * starts / max(mass, 1.0), unseen * 1e-9)
        here = np.full(len(at), len(words))
        here[block.inside] = block.codes
        first = np.append(start, end)[here]
        unigrams = np.append(words, starts)[here]
        own[0] = np.minimum(own[0], unigrams)
        own[1] = np.minimum(own[1], own[0])
        p = _back_off(first, own, at, _before(unigrams, at, 1, starts), starts, WORD_K)
        floor = ALPHA * (kinds + 1) + tokens
        seen = np.append(exact, ends)[here]
        ids, sizes = [], block.sizes.tolist()
        upto = 0
        for x in sizes:
            ids.append(None if x < 0 else block.names[upto : upto + x].decode())
            upto += max(x, 0)
        return pa.table({
            "id": pa.array(ids, pa.string()), "held_out": pa.array(~block.train), "n_tokens": pa.array(n + 1), "n_known": pa.array(_sums((seen > 0).astype(np.float64), n + 1).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(n), tokens, dtype=np.int64)), "base_score": pa.array(_sums(np.log10((seen + ALPHA) / floor), n + 1)), "score": pa.array(_sums(np.log10(p) + spelt_log[here], n + 1)),
        })

    told = answers.where("block >= 0").select("block", "segment", "payload")
    scored = blocks.select("block", "payload").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *[c for c in scored.columns if c != "id"])


def _sums(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Sums of runs of at least one value."""
    return np.add.reduceat(values, np.cumsum(runs) - runs) if len(runs) else np.zeros(0)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
