"""Benchmark decontamination: CGK embedding and bit-sampling LSH.

Texts and items are normalised to lower-case words of letters and digits with
single spaces. The CGK random walk copies a string, and repeats each character
or not by a random bit of (step, character), so strings at a small edit
distance get embeddings at a small Hamming distance: after an edit two walks
fall into step again. Of a character's bits for two steps in a row one is set,
so that no walk stands still for long: such keys sample few characters, and
texts of one language share them. A repetition samples positions of the walk
and hashes them to a key.

Windows of at most ``STEPS`` steps begin at every character of the texts and of the
items, so no word or gram has to be whole, and scripts without spaces are
searched like others. An item-sized stretch of a text is a candidate if enough
of its windows have the key of an item's window on neighbouring diagonals.
How many is measured: ``survival`` edits strings of an item's length by the full
budget at random places, by three quarters of it and by all of it evenly spaced,
and at word starts, and counts the cells of the string in which keys are left.
An item takes part in the first repetitions, whose keys have fewer and fewer
samples, until the share ``recall`` of such copies keeps ``LEAST`` cells; so many
as that share keeps must be found. A repetition is one walk over the text and
one lookup for all items that take part.

Verification is exact: the smallest edit distance of the item to any part of
the text around the candidate, by a bit-parallel dynamic programme, must be at
most ``1 - similarity`` of the item's length.

Items of fewer than ``MIN_WORDS`` words and ``LONG`` bytes are found where exactly
their words stand, so a long item of a script without spaces is searched like
others; items without words are in no text. Items may be repeated; each gives its rows.
An item without an id gives rows with a null id; null texts are empty, an empty
or null item text is in no text. Repeated rows each give a row, other columns
are ignored; without items or texts there are no rows. Ids of texts may have any type, ids of
items any that text can hold (numbers, strings, dates). Items are searched in
blocks of ``block_chars`` characters, and a block's hits or digests are written
before the next is read, so that driver and tasks hold one block at a time
however large the benchmark is.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import as_bytes, map_texts
from .work import materialize

_TABLE = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)
SIMILARITY, TARGET_RECALL, MIN_WORDS, LONG = 0.8, 0.99, 5, 40
#: Most steps of a window's walk, steps for each position that a key samples, characters of a cell, and the least cells that a copy must keep.
STEPS, STRIDE, CELL, LEAST = 20, 2.8, 4, 4
#: Samples of each repetition's keys. An item takes part in the first ones, so long items meet selective keys only.
SAMPLES = (7, 6, 5, 5, 5, 5, 5, 5) + 24 * (4,)
#: Kinds of edits that a copy must survive.
KINDS = ("random", "even", "full", "words")
_PAD = 1 << 12
_SLICE, _BLOCK = 1 << 15, 1 << 17


def normalise(text: bytes) -> bytes:
    return b" ".join(_TABLE[np.frombuffer(text, dtype=np.uint8)].tobytes().split()) if text else b""


def _flatten(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised texts in one buffer, each behind a zero, and where each begins."""
    raw = bytearray(b"\0" + b"\0".join(texts) + b"\0")
    cuts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    clean = np.frombuffer(raw.translate(_TABLE.tobytes()), dtype=np.uint8)
    clean[cuts] = 0
    gap = clean <= 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[cuts] = True
    kept = np.add.reduceat(keep, cuts, dtype=np.int64)
    return np.concatenate([clean[keep], np.zeros(_PAD, dtype=np.uint8)]), np.cumsum(kept) - kept


class CgkWalk:
    """One repetition: a random walk and the positions that its keys sample."""

    def __init__(self, seed: int, samples: int) -> None:
        rng = np.random.default_rng(seed)
        symbols = np.arange(256)
        # Six bits tell symbols apart (letters, digits and the space for certain); bit 6 + j of a symbol says whether its walk goes on at step j.
        code = np.where(symbols >= 128, 37 + symbols % 26, np.where(symbols >= 97, symbols - 97, np.where(symbols >= 48, symbols - 48 + 26, np.where(symbols == 32, 36, 63)))) & 63
        # Of each two steps a symbol goes on in one, so no walk stands still for long and keys sample different characters.
        turns = rng.integers(0, 2, (256, STEPS // 2))
        bits = np.stack([turns, 1 - turns], axis=2).reshape(256, -1)
        self.table = (code | (bits << np.arange(6, 6 + STEPS)).sum(axis=1)).astype(np.uint32)
        # One sample in each of so many equal parts of the walk.
        edges = np.linspace(0, min(STEPS, round(STRIDE * samples)), samples + 1).astype(int)
        self.sampled = {int(rng.integers(a, b)) for a, b in zip(edges, edges[1:])}

    def keys(self, buffer: np.ndarray) -> np.ndarray:
        """Key of the window from every character but the last ``STEPS``: a hash of its samples.

        From the last step back: the key of the rest of the walk is known at every
        place, so a step takes it from its own place or from the next one.
        """
        n, last = max(0, len(buffer) - STEPS), max(self.sampled)
        own = self.table.take(buffer[: n + last])
        code, steps = own & np.uint32(63), own.view(np.int32)
        key, moved, going = np.zeros(n + last, dtype=np.uint32), np.empty(n + last, dtype=np.uint32), np.empty(n + last, dtype=np.int32)
        for j in range(last, -1, -1):
            m = n + j
            here, move, go = key[:m], moved[:m], going[:m]
            if j < last:
                # All bits set where the walk goes on.
                np.left_shift(steps[:m], 25 - j, out=go)
                np.right_shift(go, 31, out=go)
                np.bitwise_xor(here, key[1 : m + 1], out=move)
                np.bitwise_and(move, go.view(np.uint32), out=move)
                np.bitwise_xor(here, move, out=here)
            if j in self.sampled:
                np.multiply(here, np.uint32(0x2C1B3C6D), out=here)
                np.add(here, code[:m], out=here)
        return key[:n]


@lru_cache(maxsize=64)
def _walk(seed: int, repetition: int) -> CgkWalk:
    return CgkWalk(seed + repetition, SAMPLES[repetition])


def _edited(texts: np.ndarray, edits: int, how: str, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Copies of the rows, edited within ``edits`` edits each, end to end behind zeros, and each symbol's place in ``texts``.

    ``random``: all edits at random places; ``even``: three quarters of them, evenly
    spaced; ``full``: all of them, evenly spaced; ``words``: another symbol at each word's start, for words of 1 to 7 symbols.
    """
    trials, size = texts.shape
    if how == "random":
        at = np.argsort(rng.random((trials, size)), axis=1)[:, :edits]
    elif how in ("even", "full"):
        few = edits if how == "full" else 3 * edits // 4
        at = np.broadcast_to(((np.arange(few) + 0.5) * size / max(few, 1)).astype(int), (trials, few))
    else:
        at = np.cumsum(rng.integers(2, 9, (trials, edits)), axis=1) % size
    kind = np.zeros((trials, size), dtype=np.int64)
    rows = np.arange(trials)[:, None]
    kind[rows, at] = rng.integers(1, 4, at.shape) if how != "words" else 1
    # Kinds: 0 stays, 1 another symbol, 2 dropped, 3 another symbol behind it; column 0 is the zero before each copy.
    kind = np.concatenate([np.zeros((trials, 1), dtype=np.int64), kind], axis=1)
    source = np.concatenate([np.zeros((trials, 1), dtype=np.uint8), texts], axis=1).ravel()
    n = np.array([1, 1, 0, 2])[kind.ravel()]
    place = np.repeat(np.arange(len(source)), n)
    second = np.zeros(len(place), dtype=bool)
    second[1:] = place[1:] == place[:-1]
    out = source[place]
    new = second | (kind.ravel()[place] == 1)
    out[new] = rng.integers(97, 123, new.sum())
    return out, place


@lru_cache(maxsize=4096)
def survival(size: int, edits: int, recall: float, seed: int, repetitions: int, trials: int = 200) -> list[int]:
    """Cells that the share ``recall`` of copies of ``size`` characters keeps at least, after 1, 2, up to ``repetitions`` repetitions.

    The least of ``KINDS`` counts. A cell is ``CELL`` characters of the
    item; it is kept if a window that begins in it has its key in the copy, within
    two neighbouring strips of diagonals.
    """
    rng = np.random.default_rng(size)
    texts = rng.integers(97, 123, (trials, size), dtype=np.uint8)
    pad = np.zeros(STEPS, dtype=np.uint8)
    flat = np.concatenate([np.concatenate([np.zeros((trials, 1), dtype=np.uint8), texts], axis=1).ravel(), pad])
    made, width, phase = [], strip_width(edits), rng.random(trials)
    for how in KINDS:
        copy, place = _edited(texts, edits, how, rng)
        trial, offset = np.divmod(place, size + 1)
        strip = (np.arange(len(copy)) - np.flatnonzero(copy == 0)[trial] - offset + edits) / width + phase[trial]
        made.append((np.concatenate([copy, pad]), place, trial, strip.astype(np.int64), np.maximum(0, offset - 1) // CELL))
    strips = 2 + int(2 * edits / width + 1)
    kept = np.zeros((len(made), trials, strips, (size - 1) // CELL + 1), dtype=bool)
    out = []
    for r in range(repetitions):
        walk = _walk(seed, r)
        own = walk.keys(flat)
        for known, (copy, place, trial, strip, cell) in zip(kept, made):
            # Of each window of a copy, the same window of its source: on the diagonal of its first symbol.
            hit = (copy[: len(place)] > 0) & (walk.keys(copy) == own[place])
            known[trial[hit], strip[hit], cell[hit]] = True
        pairs = (kept[:, :, :-1] | kept[:, :, 1:]).sum(axis=3).max(axis=2)
        out.append(int(min(np.quantile(x, 1 - recall, method="lower") for x in pairs)))
    return out


def strip_width(edits: int) -> float:
    """Diagonals of a strip: half of the edits, as insertions and deletions seldom all pull one way."""
    return max(4.0, edits / 2)


def plan_for(size: int, edits: int, recall: float, seed: int) -> tuple[int, int]:
    """(repetitions, cells): the fewest that promise ``LEAST`` cells, and how many they promise."""
    for most in (4, len(SAMPLES)):
        cells = survival(size, edits, recall, seed, most)
        for n, found in enumerate(cells, 1):
            if found >= LEAST:
                return n, found
    return most, max(1, cells[-1])


class CgkIndex:
    """Keys of the items' windows by repetition, and what it takes to look texts up."""

    def __init__(self, items: list[tuple], recall: float = TARGET_RECALL, similarity: float = SIMILARITY, seed: int = 7) -> None:
        self.similarity, self.seed = similarity, seed
        clean = [(i, normalise(t)) for i, t in items]
        self.items = [(i, t) for i, t in clean if t.count(b" ") >= MIN_WORDS - 1 or len(t) >= LONG]
        self.short: dict[int, dict[tuple, list]] = {}
        for i, t in clean:
            words = tuple(t.split())
            if 0 < len(words) < MIN_WORDS and len(t) < LONG:
                self.short.setdefault(len(words), {}).setdefault(words, []).append(i)
        self.tables: list[tuple] = []
        if not self.items:
            return
        self.size = size = np.array([len(t) for _, t in self.items])
        self.most = ((1 - similarity) * size + 1e-9).astype(np.int64)
        # Rules are for lengths in small steps down; half of what may be lost is lost here.
        grid = [max(4, math.floor(1.1 ** math.floor(math.log(n) / math.log(1.1) + 1e-9))) for n in size.tolist()]
        plans = [plan_for(n, math.ceil((1 - similarity) * n - 1e-9), 1 - (1 - recall) / 2, seed) for n in grid]
        self.needed = np.array([cells for _, cells in plans])
        self.width = np.array([strip_width(k) for k in self.most.tolist()])
        self.scale = 1 / self.width
        self.shift = np.int32(size.max())
        self.salt = (np.arange(len(size)) * 0x9E3779B1 & 0x3FFFFFFF).astype(np.int32)
        for r in range(max(n for n, _ in plans)):
            self.tables.append(self._table(np.array([i for i, (n, _) in enumerate(plans) if n > r]), r))

    def _table(self, own: np.ndarray, r: int) -> tuple:
        """Keys of the windows of the items ``own`` by hash, the windows' items and places, where each hash's run begins, and a filter of longer hashes."""
        buffer = np.frombuffer(b"\0".join(self.items[i][1] for i in own) + bytes(STEPS + 1), dtype=np.uint8)
        n = self.size[own] + 1
        item, offset = np.repeat(own, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        inside = offset < self.size[item]
        keys, item, offset = _walk(self.seed, r).keys(buffer)[inside], item[inside], offset[inside]
        bits = min(30, max(16, (8 * len(keys)).bit_length()))
        slot = self._slot(keys, bits)
        order = np.argsort(slot, kind="stable")
        known = np.zeros(1 << bits, dtype=bool)
        known[slot] = True
        first = np.searchsorted(slot[order] >> 3, np.arange((1 << bits - 3) + 1)).astype(np.int32)
        return keys[order], item[order].astype(np.int32), offset[order].astype(np.int32), first, bits, known

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)).astype(np.int64)

    def _candidates(self, buffer: np.ndarray) -> np.ndarray:
        """(item's place, a place in the text, item) of candidates, as columns.

        A copy's keys are looked for in each strip of diagonals and its neighbour.
        """
        found = [np.empty((3, 0), dtype=np.int32)]
        # Slice by slice, so that what is walked and looked up stays in the processor's cache.
        for a in range(0, len(buffer) - STEPS, _SLICE):
            own = buffer[a : a + _SLICE + STEPS]
            for r, (keys, items, offsets, first, bits, known) in enumerate(self.tables):
                mine = _walk(self.seed, r).keys(own)
                slot = self._slot(mine, bits)
                hit = np.flatnonzero(known.take(slot))
                hit = hit[own[hit] > 0]
                slot = slot[hit] >> 3
                low = first.take(slot)
                n = first.take(slot + 1) - low
                entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at = np.repeat(hit, n)
                same = np.flatnonzero(keys.take(entry) == mine.take(at))
                entry = entry[same]
                found.append(np.stack([(at[same] + a).astype(np.int32), offsets.take(entry), items.take(entry)]))
        at, offset, item = np.concatenate(found, axis=1)
        strip = ((at - offset + self.shift) * self.scale.take(item)).astype(np.int32)
        # Strips are counted in bins first, neighbours in neighbouring bins: strips that share a bin only add to a count.
        bins = 1 << max(10, (len(at) * 4).bit_length())
        slot = strip + self.salt.take(item) & bins - 1
        counts = np.bincount(slot, minlength=bins + 1)
        near = counts.take(slot) + np.maximum(counts.take(slot + 1), counts.take(slot - 1, mode="wrap"))
        # The first and the last bin are neighbours as well.
        enough = (near >= self.needed.take(item)) | (slot == 0) | (slot == bins - 1)
        at, offset, item, strip = (x[enough].astype(np.int64) for x in (at, offset, item, strip))
        key, cell = item << 32 | strip, offset // CELL
        order = np.lexsort((cell, key))
        key, cell, at = key[order], cell[order], at[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
        key, at = key[new], at[new]
        enough = self._crowded(key)
        key, at = key[enough], at[enough]
        item = key >> 32
        begin = ((key & 0xFFFFFFFF) * self.width[item]).astype(np.int64) - 1 - self.shift
        return np.stack([begin, at, item])

    def _crowded(self, key: np.ndarray) -> np.ndarray:
        """Whether each key's strip and a neighbour hold as many hits as the item needs."""
        strips, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        after = np.flatnonzero(np.diff(strips) == 1)
        most = n.copy()
        both = n[after] + n[after + 1]
        most[after] = both
        most[after + 1] = np.maximum(most[after + 1], both)
        return (most >= self.needed[strips >> 32])[inverse]

    def _whole(self, text: bytes) -> list[tuple]:
        """Items of few words, where exactly their words stand first."""
        words, out = text.split(), []
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]) if words else []
        for n, known in self.short.items():
            seen: set = set()
            for k, run in enumerate(zip(*[words[j:] for j in range(n)])):
                if run in known and run not in seen:
                    seen.add(run)
                    out += [(i, 0, int(starts[k])) for i in known[run]]
        return out

    def search(self, texts: list[bytes]) -> list[list[tuple]]:
        """(item id, edit distance, first character in the normalised text) per text, by item."""
        found: list[list[tuple]] = [[] for _ in texts]
        buffer, cuts = _flatten(texts)
        if self.short:
            for d in range(len(texts)):
                found[d] += self._whole(buffer[cuts[d] + 1 : cuts[d + 1]].tobytes())
        if not self.items:
            return found
        parts, a = [], 0
        # Some texts at a time, so that what is counted stays in the processor's cache as well.
        while a < len(texts):
            b = min(len(texts), max(a + 1, int(np.searchsorted(cuts, cuts[a] + _BLOCK))))
            at, own, item = self._candidates(buffer[cuts[a] : cuts[b] + 1 + STEPS])
            parts.append(np.stack([at + cuts[a], own + cuts[a], item]))
            a = b
        at, own, item = np.concatenate(parts, axis=1) if parts else np.empty((3, 0), dtype=np.int64)
        if not len(at):
            return [_ordered(x) for x in found]
        doc = np.searchsorted(cuts, own, side="right") - 1
        most = self.most[item]
        begin = np.maximum(cuts[doc] + 1, at - most)
        end = np.minimum(cuts[doc + 1], at + self.size[item] + 2 * most + np.ceil(self.width[item]).astype(np.int64) + 2)
        begin, end, doc, item = self._pieces(*_merged(begin, end, doc, item))
        distance, stop = self._distances(buffer, begin, end, item)
        first: dict[tuple[int, int], tuple[int, int]] = {}
        for k in np.flatnonzero(distance <= self.most[item]).tolist():
            d, i = int(doc[k]), int(item[k])
            start = max(0, int(begin[k] + stop[k] - self.size[i] - cuts[d] - 1))
            first[d, i] = min(first.get((d, i), (1 << 60, 0)), (int(distance[k]), start))
        for (d, i), best in first.items():
            found[d].append((self.items[i][0], *best))
        return [_ordered(x) for x in found]

    def _pieces(self, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, item: np.ndarray) -> tuple:
        """Long spans as pieces that overlap by the longest part of a text that an item can be near, so each such part is whole in one."""
        reach = self.size[item] + self.most[item]
        n = np.maximum(1, -((reach - end + begin) // (2 * reach)))
        span = np.repeat(np.arange(len(n)), n)
        begin = begin[span] + 2 * reach[span] * (np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n))
        return begin, np.minimum(end[span], begin + 3 * reach[span]), doc[span], item[span]

    def _distances(self, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``fitting_distance`` of each span's item; up to ``LANES`` spans at once, but one by one for very long items."""
        distance, stop = np.zeros(len(item), dtype=np.int64), np.zeros(len(item), dtype=np.int64)
        long = self.size[item] > MOST_WORDS * 64
        for k in np.flatnonzero(long).tolist():
            distance[k], stop[k] = fitting_distance(self.items[item[k]][1], buffer[begin[k] : end[k]].tobytes(), int(self.most[item[k]]))
        own = np.flatnonzero(~long)
        own = own[np.lexsort((end[own] - begin[own], (self.size[item[own]] - 1) // 64))]
        for a in range(0, len(own), LANES):
            lanes = own[a : a + LANES]
            distance[lanes], stop[lanes] = fitting_distances([t for _, t in self.items], item[lanes], buffer, begin[lanes], end[lanes])
        return distance, stop


def _ordered(hits: list[tuple]) -> list[tuple]:
    return sorted(hits, key=lambda h: (str(h[0]), h[1:]))


def _merged(begin: np.ndarray, end: np.ndarray, doc: np.ndarray, item: np.ndarray) -> tuple:
    """Spans of the same text and item that overlap, as one."""
    order = np.lexsort((begin, item, doc))
    begin, end, doc, item = begin[order], end[order], doc[order], item[order]
    fresh = np.ones(len(begin), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    # Ends so far within a text and item: spans of one item have nearly one length, so ends rise with begins.
    reach = np.maximum.accumulate(np.cumsum(fresh) * (1 << 40) + end) & ((1 << 40) - 1)
    fresh[1:] |= begin[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return begin[at], np.maximum.reduceat(end, at), doc[at], item[at]


#: Spans that are checked at once, and the most words of 64 characters of an item that is checked so.
LANES, MOST_WORDS = 2048, 16


def fitting_distances(patterns: list[bytes], which: np.ndarray, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``fitting_distance`` of ``patterns[which]`` to the spans of ``buffer``, for patterns in order of their words of 64 bits."""
    used, lane = np.unique(which, return_inverse=True)
    size = np.array([len(patterns[i]) for i in used.tolist()], dtype=np.int64)[lane]
    last = (size - 1) // 64
    words = int(last.max()) + 1
    # A pattern's rows: where each of its symbols stands, after a row for all others.
    row_of = np.zeros((len(used), 256), dtype=np.int64)
    masks, rows_so_far = [], 0
    for k, i in enumerate(used.tolist()):
        x = np.frombuffer(patterns[i], dtype=np.uint8)
        symbols = np.unique(x)
        own = np.zeros((len(symbols) + 1, words * 64), dtype=np.uint8)
        own[1:, : len(x)] = symbols[:, None] == x[None, :]
        masks.append(np.packbits(own, axis=1, bitorder="little").view(np.uint64))
        row_of[k] = rows_so_far
        row_of[k, symbols] = rows_so_far + 1 + np.arange(len(symbols))
        rows_so_far += len(symbols) + 1
    mask = np.ascontiguousarray(np.concatenate(masks).T)
    n, columns = len(which), int((end - begin).max())
    one = np.uint64(1)
    top = ((size - 1) % 64).astype(np.uint64)
    scratch = [np.zeros(n, dtype=np.uint64) for _ in range(7)]
    up, down = np.full((words, n), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros((words, n), dtype=np.uint64)
    # Lanes that have word w begin at first[w]; those that end there are before first[w + 1].
    first = np.searchsorted(last, np.arange(words + 1)).tolist()
    base, flat, length = lane * 256, row_of.ravel(), end - begin
    score, best, stop = size.copy(), size.copy(), np.zeros(n, dtype=np.int64)
    for j in range(columns):
        if j % 32 == 0:
            # The lanes before the first one that goes on are done.
            a = int(np.argmax(length > j))
            at = [max(f, a) for f in first]
            views = [tuple(x[at[w] :] for x in (up[w], down[w], *scratch)) for w in range(words)]
            begins, ends, bases = begin[a:], end[a:], base[a:]
        place = begins + j
        # Behind its span a lane reads a symbol of no pattern, which never lowers its score.
        symbol = buffer.take(place, mode="clip").astype(np.int64)
        symbol *= place < ends
        rows = flat.take(symbol + bases)
        for w, (pv, mv, p, m, eq, xv, xh, ph, t) in enumerate(views):
            mask[w].take(rows[at[w] - a :], out=eq, mode="clip")
            np.bitwise_or(eq, mv, out=xv)
            if w:
                np.bitwise_or(eq, m, out=eq)
            np.bitwise_and(eq, pv, out=xh)
            np.add(xh, pv, out=xh)
            np.bitwise_xor(xh, pv, out=xh)
            np.bitwise_or(xh, eq, out=xh)
            np.bitwise_or(xh, pv, out=ph)
            np.invert(ph, out=ph)
            np.bitwise_or(ph, mv, out=ph)
            np.bitwise_and(pv, xh, out=xh)
            done = at[w + 1] - at[w]
            if done:
                own = slice(at[w], at[w + 1])
                score[own] += ((ph[:done] >> top[own]) & one).view(np.int64)
                score[own] -= ((xh[:done] >> top[own]) & one).view(np.int64)
            np.left_shift(ph, one, out=t)
            if w:
                np.bitwise_or(t, p, out=t)
            # What leaves this word's last row enters the next word.
            np.right_shift(ph, 63, out=p)
            np.left_shift(xh, one, out=ph)
            if w:
                np.bitwise_or(ph, m, out=ph)
            np.right_shift(xh, 63, out=m)
            np.bitwise_and(t, xv, out=mv)
            np.bitwise_or(xv, t, out=xv)
            np.invert(xv, out=xv)
            np.bitwise_or(ph, xv, out=pv)
        better = np.flatnonzero(score[a:] < best[a:]) + a
        best[better] = score[better]
        stop[better] = j + 1
    return best, stop


def fitting_distance(pattern: bytes, text: bytes, most: int | None = None) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a substring of ``text``, and the first end of one.

    Myers' bit-parallel dynamic programme, exact for any lengths. A distance
    over ``most`` may come out larger: it ends once the rest cannot reach ``most``.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    ones, high = (1 << m) - 1, 1 << (m - 1)
    equal: dict[int, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    up, down, score = ones, 0, m
    best, stop, last = m, 0, len(text) + (m if most is None else most)
    for j, c in enumerate(text, 1):
        eq = equal.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & ones
        mh = up & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & ones, mh << 1 & ones
        up = mh | ~(xv | ph) & ones
        down = ph & xv
        if score < best:
            best, stop = score, j
        elif score + j > last and best > last - len(text):
            break
    return best, stop


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, recall: float = TARGET_RECALL, block_chars: int = 4 << 20) -> DataFrame:
    """(id, item_id, distance, start) for each benchmark item that a row's text holds."""
    out = None
    kind = benchmark.schema[item_id].dataType
    for items, last in _blocks(benchmark, item_id, item_text, block_chars):
        hits = _hits(docs, {id_col: F.col(id_col)}, text_col, items, similarity, recall)
        rows = hits.where(F.size("hits") > 0).select(id_col, F.explode("hits").alias("hit"))
        rows = rows.select(id_col, F.col("hit.item_id").cast(kind).alias(item_id), "hit.distance", "hit.start")
        rows = rows if last and out is None else materialize(rows, "hits")
        out = rows if out is None else out.unionByName(rows)
    return out


def _hits(docs: DataFrame, keep: dict, text_col: str, items: list, similarity: float, recall: float) -> DataFrame:
    holder: list[CgkIndex] = []
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("distance", pa.int64()), ("start", pa.int64())]))

    def run(texts: list[bytes]) -> dict:
        if not holder:
            holder.append(CgkIndex(items, recall=recall, similarity=similarity))
        return {"hits": pa.array([[{"item_id": i, "distance": d, "start": s} for i, d, s in x] for x in holder[0].search(texts)], kind)}

    return map_texts(docs, keep, text_col, "hits array<struct<item_id:string,distance:long,start:long>>", run, chunk_bytes=4 << 20)


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_chars: int):
    """(list of (id as text, text) of at most about ``block_chars`` characters, whether it is the last); one empty list for no items."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string"), F.col(item_text).cast("binary"))
    block, size = [], 0
    for i, text in items.toLocalIterator():
        if size >= block_chars:
            yield block, False
            block, size = [], 0
        block.append((i, bytes(text)))
        size += len(text)
    yield block, True


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, recall: float = TARGET_RECALL, block_chars: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns.

    A benchmark of one block is a filter. Of a larger one, every block writes
    the digests of the texts that it hits, and ``docs`` meets all of them once;
    the rows themselves are never written. Equal texts have equal verdicts, so
    a digest stands for its copies, and rows need no id.
    """
    digest = F.sha2(as_bytes(text_col), 256)
    dirty = None
    for items, last in _blocks(benchmark, item_id, item_text, block_chars):
        if last and dirty is None:
            names = [f"__c{i}" for i in range(len(docs.columns))]
            keep = {n: F.col(f"`{c}`") for n, c in zip(names, docs.columns)}
            clean = _hits(docs, keep, text_col, items, similarity, recall).where(F.size("hits") == 0)
            return clean.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
        hits = _hits(docs, {"__dirty": digest}, text_col, items, similarity, recall)
        found = materialize(hits.where(F.size("hits") > 0).select("__dirty").distinct(), "dirty")
        dirty = found if dirty is None else dirty.unionByName(found)
    dirty = dirty.distinct()
    return docs.join(dirty, digest == dirty["__dirty"], "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
