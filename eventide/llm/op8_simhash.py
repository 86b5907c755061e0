"""SimHash near-duplicates by deletion variants of segments.

Fingerprints link at two or fewer differing bits. A fingerprint is cut into two
32-bit segments, so of two linked ones a segment differs in one bit at most.
Each segment is indexed under its 32 one-wildcard variants (segment, place of
the wildcard, other 31 bits); linked fingerprints share a variant. An equality
join on the variants and a bit count give the links. Only distinct
fingerprints are indexed, so exact copies make no pairs.

A variant that more than ``crowd`` fingerprints share is not paired. Its
members get a wildcard in the other segment as well (or two, where the first
segment is equal); fingerprints that share such a key differ in two bits at
most, so each links to the smallest of its key. That is exact, and grows with
the members and not with their pairs.

Words of a null text are none: fingerprint zero, linked like any other. A text
of one or two words is one shingle. Repeated rows each give a row.
``component_id`` is the smallest id reachable; null ids count as no id, and a
component of null ids only has a null id.

``simhash_filter`` can ask for a Jaccard similarity of word shingles instead.
At 0.8 fingerprints differ in about 10 bits, which no selective variant
reaches, so candidates share a min-wise band or a component of fingerprints,
and each link is verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .texts import map_texts
from .work import discard, materialize

#: A variant shared by more distinct fingerprints than this takes the second wildcard.
CROWD = 64
#: Shared variants are broadcast up to this many rows of 16 bytes, and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Distinct fingerprints that one task expands.
TASK_ROWS = 50_000
#: Sets and bytes of a block of a crowded key, and elements that two blocks are compared by at once.
BLOCK_SETS, BLOCK_BYTES, COLUMNS = 256, 4 << 20, 2048
#: Min-wise keys: texts at Jaccard similarity 0.8 share one of the bands with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.999997.
BANDS, ROWS = 24, 4
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of the word shingles of all texts, and how many each text has."""
    hashes: list[int] = []
    sizes = []
    xx = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()
        n = len(words)
        if n <= width:
            if n:
                hashes.append(xx(b" ".join(words), 42))
            sizes.append(1 if n else 0)
            continue
        joined = b" ".join(words)
        starts = [0, *accumulate([len(w) + 1 for w in words])]
        hashes += [xx(joined[a : b - 1], 42) for a, b in zip(starts, starts[width:])]
        sizes.append(n - width + 1)
    return np.array(hashes, dtype=np.uint64), np.array(sizes, dtype=np.int64)


def fingerprints(texts: list[bytes], width: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text."""
    return _majority(*_shingles(texts, width))


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits set in over half of each run of hashes: byte lanes are summed in runs of 255 at most."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    ends = np.cumsum(n)
    blocks = (n + 254) // 255
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    within = np.arange(blocks.sum()) - np.repeat(first, blocks)
    starts = np.repeat(ends - n, blocks) + within * 255
    lanes = np.uint64(0x0101010101010101)
    result = np.zeros(len(full), dtype=np.uint64)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, starts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        ones = 2 * counts > n[:, None]
        for byte in range(8):
            result |= ones[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    out[full] = result
    return out


def _fingerprinted(docs: DataFrame, keep: dict[str, Column], text_col: str, width: int = 3) -> DataFrame:
    return map_texts(docs, keep, text_col, "fp long", lambda texts: {"fp": pa.array(fingerprints(texts, width).view(np.int64))})


def _segments() -> Column:
    return F.array(*[F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).alias("own"), F.shiftrightunsigned("fp", 32 - 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).alias("other")) for s in (0, 1)])


def _variants(fps: DataFrame) -> DataFrame:
    """(fp, own, other, key): 32 one-wildcard variants of both segments.

    ``key`` holds the segment, the wildcard's place and the other 31 bits.
    """
    segs = fps.select("fp", F.explode(_segments()).alias("s")).select("fp", "s.*")
    masked = F.array(*[F.col("own").bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))).bitwiseOR(F.lit(i << 32)) for i in range(32)])
    return segs.select("fp", "own", "other", "seg", F.explode(masked).alias("key")).withColumn("key", F.col("key").bitwiseOR(F.shiftleft(F.col("seg").cast("long"), 40)))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) rows that hold every component of fingerprints at two bits or fewer."""
    keyed = _variants(fps)
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    small = sizes.count() <= BROADCAST_ROWS
    shared = materialize(keyed.join(F.broadcast(sizes) if small else sizes, "key"), "shared")
    few = shared.where(F.col("n") <= crowd).select("key", "fp")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select(F.col("key").alias("k"), F.col("fp").alias("b")), (F.col("key") == F.col("k")) & (F.col("a") < F.col("b")) & (_distance("a", "b") <= 2)).select("a", "b").distinct()
    many = shared.where(F.col("n") > crowd)
    one = F.array(*[F.struct(F.lit(i).alias("i"), F.col("other").bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))).alias("rest")) for i in range(32)])
    both = many.select("fp", "key", F.explode(one).alias("w")).select("fp", F.concat_ws(":", F.col("key"), "w.i", "w.rest").alias("k"))
    two = F.array(*[F.lit(0xFFFFFFFF ^ (1 << i) ^ (1 << j)) for i in range(32) for j in range(i)])
    equal = many.select("fp", "seg", "own", "other").distinct().select("fp", "seg", "own", "other", F.explode(two).alias("mask"))
    equal = equal.select("fp", F.concat_ws(":", F.lit("="), "seg", "own", "mask", F.col("other").bitwiseAND(F.col("mask"))).alias("k"))
    wide = both.unionByName(equal)
    least = wide.groupBy("k").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("k", "a")
    stars = wide.join(least, "k").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def classes(rows: DataFrame) -> DataFrame:
    """(fp, root) for each distinct fingerprint; equal roots are one component."""
    fps = materialize(rows.select("fp").distinct(), "distinct")
    # A small table of 64 variants a row: dealt out by rows, as its bytes would make few tasks.
    fps = fps.repartition(1 + fps.count() // TASK_ROWS, "fp")
    labels = materialize(connected_components(links(fps), "a", "b"), "labels")
    return fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of each row."""
    rows = materialize(_fingerprinted(docs, {"id": F.col(id_col)}, text_col), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("id").alias("id"))
    roots = materialize(classes(rows), "roots")
    heads = least.join(roots, "fp").groupBy("root").agg(F.min("id").alias("component_id"))
    table = materialize(roots.join(heads, "root").select("fp", "component_id"), "components")
    return rows.join(table, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _distinct(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[e - n : e]) for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist())]


def _sketches(texts: list[bytes], width: int) -> dict[str, pa.Array]:
    """Each text's fingerprint, hash and number of its distinct shingles, and the min-wise keys of its bands."""
    hashes, sizes = _shingles(texts, width)
    ends = np.cumsum(sizes)
    grams = _distinct(hashes, sizes)
    full = np.flatnonzero(sizes)
    keys = np.zeros((len(full), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k, factor in enumerate(_FACTORS if len(full) else []):
        mixed = (keys[:, k // ROWS] ^ np.minimum.reduceat(hashes * factor, (ends - sizes)[full])) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, k // ROWS] = mixed ^ (mixed >> np.uint64(29))
    bands: list[np.ndarray] = [keys[:0].reshape(-1).view(np.int64)] * len(texts)
    for i, row in zip(full.tolist(), keys.view(np.int64)):
        bands[i] = row
    return {
        "fp": pa.array(_majority(hashes, sizes).view(np.int64)), "whole": pa.array(np.array([xxhash.xxh64_intdigest(g.tobytes(), 42) for g in grams], dtype=np.uint64).view(np.int64)),
        "size": pa.array(np.array([len(g) for g in grams], dtype=np.int64)), "bands": pa.array(bands, pa.list_(pa.int64())),
    }


def _grams(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(whole, grams): the distinct shingles of the sets that ``pairs`` names, from the text of one row each."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("whole")).distinct()
    heads = materialize(sets.join(named, "whole", "left_semi").select("whole", "best.id", "best.mark"), "heads")
    small = heads.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(heads) if small else heads, docs["__id"].eqNullSafe(heads["id"]) & (docs["__mark"] == heads["mark"]))
    grams = map_texts(texts, {"whole": F.col("whole")}, text_col, "grams binary", lambda own: {"grams": pa.array([g.tobytes() for g in _distinct(*_shingles(own, width))], pa.binary())})
    return materialize(grams.dropDuplicates(["whole"]), "grams")


def _verified(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingles' Jaccard similarity is ``similarity`` at least."""
    first, second = (grams.select(F.col("whole").alias(x), F.col("grams").alias(f"{x}_grams")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_grams"), batch.column("b_grams")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = materialize(pairs.join(second, "b").join(first, "a").select("a", "b", "a_grams", "b_grams").mapInArrow(run, "a long, b long"), "found")
    discard(grams)
    return found


def _pick_links(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of the links (a, b) between roots that hold all of their components together: no two roots are joined twice."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            parent[x] = y
            kept.append(k)
    return kept


def _shared(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """How many elements every set of ``first`` shares with every one of ``second``."""
    owners = [np.repeat(np.arange(len(x)), [len(g) for g in x]) for x in (first, second)]
    grams = [np.concatenate([*x, np.empty(0, np.uint64)]) for x in (first, second)]
    common = np.intersect1d(*grams)
    out = np.zeros((len(first), len(second)), dtype=np.float32)
    placed = []
    for own, g in zip(owners, grams):
        at = np.searchsorted(common, g)
        hit = at < len(common)
        hit[hit] = common[at[hit]] == g[hit]
        at, own = at[hit], own[hit]
        order = np.argsort(at, kind="stable")
        placed.append((at[order], own[order]))
    for start in range(0, len(common), COLUMNS):
        parts = []
        for (at, own), n in zip(placed, out.shape):
            x, y = np.searchsorted(at, [start, start + COLUMNS])
            m = np.zeros((n, COLUMNS), dtype=np.float32)
            m[own[x:y], at[x:y] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _block_links(rows: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """(a, b) between sets of different roots that share a key, by blocks: links that hold all of them together.

    ``rows`` has key, whole, size and root. A key's sets are put in order of
    size into classes whose sizes differ by the similarity at most; a class is
    cut into blocks, and every two blocks of a class or of neighbouring ones
    meet in a task, which counts shared elements by a product of two tables
    and sends links between roots only. No pair is left out and none is a row.
    """
    base = -np.log(similarity) * (1 + 1e-9)
    rows = rows.withColumn("class", F.floor(F.log("size") / F.lit(float(base))).cast("int"))
    sizes = rows.groupBy("key", "class").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("size") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    sizes = materialize(sizes, "classes")
    after = sizes.select("key", (F.col("class") - 1).alias("class"), F.col("blocks").alias("after"))
    before = sizes.select("key", (F.col("class") + 1).alias("class"), F.col("blocks").alias("before"))
    placed = rows.join(sizes.join(after, ["key", "class"], "left").join(before, ["key", "class"], "left"), ["key", "class"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("whole"), F.col("blocks")).cast("int")).join(grams, "whole")

    def units(offset: int, n: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct((F.col("class") + offset).alias("class"), x.cast("int").alias("block")))
        return F.when(n > 0, found).otherwise(F.array().cast("array<struct<class:int,block:int>>"))

    own = F.struct("class", "block")
    same = units(0, F.col("blocks"))
    first = placed.withColumn("other", F.explode(F.concat(F.filter(same, lambda u: u["block"] >= F.col("block")), units(1, F.coalesce("after", F.lit(0))))))
    second = placed.withColumn("other", F.explode(F.concat(F.filter(same, lambda u: u["block"] <= F.col("block")), units(-1, F.coalesce("before", F.lit(0))))))
    sides = [(0, first, own, F.col("other")), (1, second, F.col("other"), own)]
    both = [df.select(F.lit(side).alias("side"), "key", x.alias("x"), y.alias("y"), "whole", "root", "grams") for side, df, x, y in sides]

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        whole, root = (table.column(c).to_numpy() for c in ("whole", "root"))
        data = [np.frombuffer(g, dtype=np.uint64) for g in table.column("grams").to_pylist()]
        at = [np.flatnonzero(side == k) for k in (0, 1)]
        one, two = ([data[i] for i in x.tolist()] for x in at)
        n, m = (np.array([len(g) for g in x], dtype=np.float64) for x in (one, two))
        both = _shared(one, two).astype(np.float64)
        near = both >= similarity * (n[:, None] + m[None, :] - both) - 1e-9
        near &= root[at[0]][:, None] != root[at[1]][None, :]
        i, j = np.nonzero(near)
        a, b = at[0][i], at[1][j]
        kept = _pick_links(root[a], root[b])
        a, b = whole[a[kept]], whole[b[kept]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return materialize(both[0].unionByName(both[1]).groupBy("key", "x", "y").applyInArrow(run, "a long, b long").distinct(), "block_links")


def jaccard_links(sets: DataFrame, grams: Callable[[DataFrame], DataFrame], similarity: float, crowd: int = CROWD) -> DataFrame:
    """(a, b) rows that hold the components of distinct sets (whole, size, keys) at ``similarity``.

    Sets that share a key are candidates, and every link is verified. First
    each set is held against one of each of its keys, drawn by hash. Then, for
    keys whose sets are not yet in one component, every pair that is still
    apart: as pairs where a key has few sets, and in blocks (``_block_links``)
    where it has more than ``crowd``, after another draw that only spares work.
    """
    keyed = sets.select("whole", "size", F.explode("keys").alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    small = sizes.count() <= BROADCAST_ROWS
    shared = materialize(keyed.join(F.broadcast(sizes) if small else sizes, "key"), "shared")

    def stars(rows: DataFrame, salt: int, *also: str) -> DataFrame:
        centre = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "whole", F.lit(salt)).alias("h"), "whole", "size", *also)).alias("c"))
        apart = F.col("whole") != F.col("c.whole")
        for x in also:
            apart &= F.col(x) != F.col(f"c.{x}")
        return pairs(rows.join(centre, "key").where(apart), F.col("whole"), F.col("size"), F.col("c.whole"), F.col("c.size"))

    def pairs(rows: DataFrame, a: Column, m: Column, b: Column, n: Column) -> DataFrame:
        return rows.where(F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    def apart(rows: DataFrame, labels: DataFrame, old: Column) -> DataFrame:
        """``rows`` of the keys whose sets are in several components; ``old`` is their component so far, ``labels`` what became of it."""
        named = rows.withColumn("node", old).join(labels, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component", "node")
        named = materialize(named, "named")
        split = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
        return materialize(named.join(split, "key"), "left")

    tried = materialize(stars(shared, 0), "tried")
    found = _verified(tried, grams(tried), similarity)
    left = apart(shared, materialize(connected_components(found, "a", "b"), "labels"), F.col("whole"))
    few, many = left.where(F.col("n") <= crowd), left.where(F.col("n") > crowd)
    other = few.select("key", F.col("whole").alias("w"), F.col("size").alias("s"), F.col("root").alias("r"))
    rest = pairs(few.join(other, "key").where("whole < w and root <> r"), F.col("whole"), F.col("size"), F.col("w"), F.col("s"))
    rest = rest.unionByName(stars(many, 1, "root")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = materialize(rest, "rest")
    more = _verified(rest, grams(rest), similarity)
    found = found.unionByName(more)
    if many.isEmpty():
        return found
    # What the new links join are components, of which there are fewer than sets.
    roots = materialize(left.select("whole", "root").distinct(), "roots")
    first, second = (roots.select(F.col("whole").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
    joined = more.join(first, "a").join(second, "b").where("a_root <> b_root").select("a_root", "b_root")
    still = apart(many, materialize(connected_components(joined, "a_root", "b_root"), "labels"), F.col("root"))
    if still.isEmpty():
        return found
    named = grams(still.select(F.col("whole").alias("a"), F.col("whole").alias("b")).distinct())
    return found.unionByName(_block_links(still.select("key", "whole", "size", "root"), named, similarity))


def _alike(rows: DataFrame, docs: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """(root, best) for each component of the rows' sets of shingles."""
    sets = rows.groupBy("whole").agg(F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min(_order()).alias("best")).join(classes(rows), "fp")
    sets = materialize(sets.select("whole", "size", "best", F.concat("bands", F.array(F.xxhash64(F.lit("fp"), "root"))).alias("keys")), "sets")
    links = jaccard_links(sets, lambda pairs: _grams(pairs, sets, docs, text_col, width), similarity)
    labels = materialize(connected_components(links, "a", "b"), "labels")
    return sets.select("whole", "best").join(labels.withColumnRenamed("node", "whole"), "whole", "left").select(F.coalesce("component", "whole").alias("root"), "best")


def _order() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "mark")


def simhash_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each group: the smallest id, then the smallest text hash.

    Groups are op8's components, or with ``similarity`` the components of texts
    whose shingles of ``width`` words have that Jaccard similarity at least.
    """
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    head = {"id": F.col(id_col), "mark": mark}
    if similarity is None:
        rows = materialize(_fingerprinted(docs, head, text_col, width), "fingerprints")
        best = rows.groupBy("fp").agg(F.min(_order()).alias("best")).join(classes(rows), "fp")
    else:
        rows = materialize(map_texts(docs, head, text_col, "fp long, whole long, size long, bands array<long>", lambda texts: _sketches(texts, width), chunk_bytes=2 << 20), "fingerprints")
        best = _alike(rows, docs.select(F.col(id_col).alias("__id"), mark.alias("__mark"), text_col), text_col, width, similarity)
    best = best.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.id").alias("__id"), F.col("best.mark").alias("__mark"))
    many = rows.groupBy(F.col("id").alias("__i"), F.col("mark").alias("__m")).agg(F.count("*").alias("__n")).where("__n > 1")
    best = best.join(many, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__mark") == F.col("__m")), "left")
    best = materialize(best.select("__id", "__mark", F.coalesce("__n", F.lit(1)).alias("__n")), "kept")
    marked = docs.withColumn("__own", mark)
    kept = marked.join(best, marked[id_col].eqNullSafe(best["__id"]) & (F.col("__own") == F.col("__mark")))
    once = kept.where("__n = 1").select(*[marked[c] for c in docs.columns])
    again = kept.where("__n > 1").dropDuplicates(["__id", "__mark"]).select(*docs.columns)
    return once.unionByName(again)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
