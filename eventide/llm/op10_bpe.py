"""Byte-level BPE: encoding by ranked merges of distinct words, and decoding.

A text is cut by the public pattern into words; each distinct word of a chunk
of texts is merged once, and ids are gathered back by word number. Two folds
give the same ids:

* ``fold="arrays"`` (the query): all distinct words of a chunk at once, as a
  matrix of token ids. Each step looks up the rank of every adjacent pair that
  changed, finds each word's lowest rank (leftmost on ties) and merges there.
* ``fold="hof"``: Spark higher-order functions over the byte array of each
  distinct word, with the rank map as a literal. It takes about 0.3 ms a word,
  which the README puts against the limits.

Decoding concatenates the byte pieces of the ids. Null texts are empty: no
ids, and the hashes of no bytes. Any string has an encoding, as all 256 bytes
are tokens. Repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import map_texts

_NONE = np.int32(2**31 - 1)
#: Words of more bytes than this are merged one by one.
_WIDE = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a tiktoken file. Its size is fixed: a vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _members(escape: str) -> str:
    """The characters of a class such as ``\\p{L}`` as ranges for ``re``, asked of the library whose ids count: Python's own tables are older."""
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    one_by_one = tiktoken.Encoding("class", pat_str=escape, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    found = np.frombuffer(bytes(one_by_one.encode_ordinary(every)).decode().encode("utf-32-le"), dtype="<u4").astype(np.int64)
    ends = np.flatnonzero(np.diff(found) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(found[np.concatenate([[0], ends + 1])].tolist(), found[np.concatenate([ends, [-1]])].tolist()))


@lru_cache(maxsize=4)
def word_pattern(pattern: str | None = None) -> str:
    """``pattern`` (the public one) for ``re``, which is faster and has no classes by category: they are spelt out."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    classes = {x: _members(x) for x in (r"\p{L}", r"\p{N}", r"\s")}

    def spelt(match: re.Match) -> str:
        text = match.group()
        if text == r"\S":
            return f"[^{classes[chr(92) + 's']}]"
        inner = text[1:-1] if text[0] == "[" else text
        for escape, members in classes.items():
            inner = inner.replace(escape, members)
        return f"[{inner}]"

    return re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", spelt, pattern)


class PairRanks:
    """(left id, right id) to the rank of their bytes together, as an open hash table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("every byte must be a token")
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.found = np.full(1 << bits, _NONE, dtype=np.int32)
        for key, rank in pairs.items():
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.found[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        out = np.full(len(keys), _NONE, dtype=np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            here = self.keys[at[open_]]
            same = here == keys[open_]
            out[open_[same]] = self.found[at[open_[same]]]
            open_ = open_[~same & (here != -1)]
            at[open_] = (at[open_] + 1) & self.mask
        return out


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` (of ``sizes``) that ``codes`` name, end to end, and their sizes."""
    n = sizes[codes]
    starts = (np.cumsum(sizes) - sizes)[codes]
    return flat[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def merge_words(words: list[bytes], table: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the words, end to end, and how many each has."""
    sizes = np.zeros(len(words), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    by_size: dict[int, list[int]] = {}
    whole, rank = [], []
    for i, r in enumerate(map(table.ranks.get, words)):
        if r is not None:
            whole.append(i)
            rank.append(r)
        else:
            by_size.setdefault(len(words[i]), []).append(i)
    sizes[whole] = 1
    parts.append((np.array(whole, dtype=np.int64), np.array(rank, dtype=np.int32)))
    for n, at in by_size.items():
        if n > _WIDE:
            done = [_merge_long(words[i], table) for i in at]
            sizes[at] = [len(x) for x in done]
            parts.append((np.array(at), np.concatenate(done)))
        elif n:
            raw = np.frombuffer(b"".join([words[i] for i in at]), dtype=np.uint8).reshape(-1, n)
            ids, own = _merge_matrix(table.bytes[raw], table)
            sizes[at] = own
            parts.append((np.array(at), ids[np.arange(n)[None, :] < own[:, None]]))
    flat = np.empty(sizes.sum(), dtype=np.int32)
    starts = np.cumsum(sizes) - sizes
    for at, ids in parts:
        n = sizes[at]
        flat[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
    return flat, sizes


def _merge_matrix(ids: np.ndarray, table: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    count, n = ids.shape
    ids = ids.copy()
    sizes = np.full(count, n)
    ranks = np.full((count, n), _NONE, dtype=np.int32)
    ranks[:, : n - 1] = table.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, n - 1)
    live = np.arange(count)
    places = np.arange(n)
    while len(live):
        r = ranks[live]
        at = r.argmin(axis=1)
        low = r[np.arange(len(live)), at]
        going = low != _NONE
        live, at, low = live[going], at[going], low[going]
        if not len(live):
            break
        # Close the gap after the merge: what stands right of it moves left by one.
        source = np.minimum(places[None, :] + (places[None, :] > at[:, None]), n - 1)
        own = np.take_along_axis(ids[live], source, axis=1)
        own[np.arange(len(live)), at] = low
        r = np.take_along_axis(ranks[live], source, axis=1)
        r[:, n - 1] = _NONE
        sizes[live] -= 1
        for shift in (0, -1):
            left = at + shift
            ok = (left >= 0) & (left + 1 < sizes[live])
            rows, left = np.flatnonzero(ok), left[ok]
            r[rows, left] = table.look_up(own[rows, left], own[rows, left + 1])
        last = at == sizes[live] - 1
        r[np.flatnonzero(last), at[last]] = _NONE
        ids[live], ranks[live] = own, r
    return ids, sizes


def _merge_long(word: bytes, table: PairRanks) -> np.ndarray:
    """One word by a heap of (rank, place) over a linked list: n log n for n bytes."""
    import heapq

    ids = table.bytes[np.frombuffer(word, dtype=np.uint8)].tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = table.pairs.get
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b or ids[i] < 0:
            continue
        ids[i], ids[j] = r, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (x := get(ids[k] << 32 | ids[after[k]])) is not None:
                heapq.heappush(heap, (x, k, ids[k], ids[after[k]]))
    return np.array([x for x in ids if x >= 0], dtype=np.int32)


class _Codes(dict):
    """Numbers its keys in the order in which they are first looked up."""

    def __missing__(self, key) -> int:
        self[key] = code = len(self)
        return code


class Encoder:
    """Encodes chunks of texts; what it keeps between chunks is the vocabulary only."""

    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None) -> None:
        self.table = PairRanks(ranks)
        pieces = dict(zip(ranks.values(), ranks))
        ordered = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.piece_bytes = np.frombuffer(b"".join(ordered), dtype=np.uint8)
        self.piece_sizes = np.array([len(x) for x in ordered], dtype=np.int64)
        self.find = re.compile(pattern or word_pattern()).findall

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has."""
        units, words = _Codes(), _Codes()
        code = units.__getitem__
        codes, n_units = [], []
        for data in texts:
            own = _units(data)
            n_units.append(len(own))
            codes.append(np.fromiter(map(code, own), dtype=np.int64, count=len(own)))
        found = [self.find(u[0] if type(u) is tuple else " " + u) for u in units]
        unit_words = np.fromiter(map(words.__getitem__, chain.from_iterable(found)), dtype=np.int64)
        ids, sizes = merge_words([w.encode() for w in words], self.table)
        ids, n = gather(ids, sizes, unit_words)
        n_words = np.array([len(x) for x in found], dtype=np.int64)
        sizes = _run_sums(n, n_words)
        ids, n = gather(ids, sizes, np.concatenate(codes) if codes else np.empty(0, dtype=np.int64))
        return ids, _run_sums(n, np.array(n_units, dtype=np.int64))

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' byte pieces, concatenated."""
        return gather(self.piece_bytes, self.piece_sizes, ids)[0].tobytes()


def _run_sums(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(runs)
    return upto[ends] - upto[ends - runs]


#: Where a single space stands between two characters that are no white space, a text can be cut before it.
_CUT = re.compile(r"(?<![\s\x85\xa0]) (?![\s\x85\xa0])")
#: UTF-8 of white space other than the space and the line feed, or the first bytes of some.
_OTHER_SPACE = [bytes([c]) for c in (9, 11, 12, 13, 28, 29, 30, 31)] + [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80"]


def _units(data: bytes) -> list:
    """Runs that the pattern treats alone: (run,), or a string that a space comes before."""
    text = data.decode("utf-8", "replace")
    if b"  " in data or b" \n" in data or b"\n " in data or any(x in data for x in _OTHER_SPACE):
        first, *rest = _CUT.split(text)
    else:
        first, *rest = text.split(" ")
    return [(first,), *rest]


def bpe_encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: dict[str, Column] | None = None) -> DataFrame:
    """n_tokens and the hashes of ids and decoded bytes (and the ids, if asked for)."""
    holder: list[Encoder] = []
    pattern = word_pattern()

    def run(texts: list[bytes]) -> dict:
        if not holder:
            holder.append(Encoder(ranks, pattern))
        encoder = holder[0]
        flat, sizes = encoder.encode(texts)
        ends = np.cumsum(sizes).tolist()
        ids = [flat[a:b] for a, b in zip([0, *ends], ends)]
        out = {
            "n_tokens": pa.array(sizes, pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string()),
        }
        return out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {})

    return map_texts(docs, keep or {id_col: F.col(id_col)}, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, run, chunk_bytes=12 << 20)


def merge_words_hof(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word") -> DataFrame:
    """(word, ids) of distinct words (binary), folded by Spark's higher-order functions.

    The literal rank map is an array of buckets of (pair, rank), as a lookup in
    one map literal of this size would scan it.
    """
    table = PairRanks(ranks)
    buckets = 131071
    keys: list[list[int]] = [[] for _ in range(buckets)]
    found: list[list[int]] = [[] for _ in range(buckets)]
    for key, rank in table.pairs.items():
        own = (key >> 32) * 65536 + (key & 0xFFFFFFFF)
        keys[own % buckets].append(own)
        found[own % buckets].append(rank)
    literal = F.from_json(F.lit(json.dumps({"k": keys, "r": found}, separators=(",", ":"))), "struct<k:array<array<bigint>>,r:array<array<int>>>")
    first = F.from_json(F.lit(json.dumps(table.bytes.tolist())), "array<int>")
    none = F.lit(int(_NONE))

    def rank(a: Column, b: Column) -> Column:
        key = a.cast("bigint") * 65536 + b
        bucket = (key % buckets).cast("int")
        at = F.array_position(literal["k"][bucket], key).cast("int")
        return F.when(at > 0, F.get(literal["r"][bucket], at - 1)).otherwise(none)

    def step(p: Column, _: Column) -> Column:
        near = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: rank(F.get(p, i), F.get(p, i + 1)))
        low = F.transform(F.array(near), lambda r: F.struct(F.array_min(r).alias("rank"), F.array_position(r, F.array_min(r)).cast("int").alias("at")))
        merged = F.transform(low, lambda z: F.when(z["rank"] == none, p).otherwise(F.concat(F.slice(p, F.lit(1), z["at"] - 1), F.array(z["rank"]), F.slice(p, z["at"] + 2, F.size(p)))))
        return F.when(F.size(p) < 2, p).otherwise(F.get(merged, F.lit(0)))

    n = F.length(word_col)
    start = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(first, F.conv(F.hex(F.substring(F.col(word_col), i, F.lit(1))), 16, 10).cast("int")))
    ids = F.when(n == 0, F.array().cast("array<int>")).when(n == 1, start).otherwise(F.aggregate(F.sequence(F.lit(2), n), start, step))
    return words.select(word_col, ids.alias("ids"))


def default_ranks() -> dict[bytes, int]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_ranks())
