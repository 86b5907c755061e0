"""Exact top-k search by refining global histograms of scores.

Vectors are packed into blocks of rows and queries into blocks of vectors; a
task scores one block of queries against a group of blocks. A pass counts, for
every query, the scores that fall into each bin of the interval that is known
to hold its kth value; the counts of all groups are summed, and the bin that
holds the kth value is the next pass's interval. A bin is one value after the
last pass. Then every score above it is taken, and of the scores equal to it
as many of the smallest ids as are still open. A group sends the bins from its
highest score down to the one where it has counted enough by itself: the kth
value of all rows is never below that, so no bin that matters is left out and
no group sends more than k of them for a query.

Scores are recomputed in every pass and never stored. They are exact: floats
hold them where the vectors' norms prove it, whole numbers of any size
otherwise; a score beyond 61 bits is held at 2 ** 61. Vectors that are null or
hold null or (scaled) non-finite components take no part, nor do rows without an id.
A vector that is shorter than another counts as if zeros followed. Repeated
rows each take part: a query leaves out its own row only. Ties go to the
smaller id. A table without queries gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import discard, materialize

#: Bytes of the vectors of a block, and of the blocks that one task holds beside its queries.
BLOCK_BYTES, GROUP_BYTES = 4 << 20, 32 << 20
#: Queries of a block, rows that are scored at once, and bits of a pass.
QUERIES, ROWS, BITS = 2048, 1024, 10
_MOST = 1 << 61


def _padded(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of a matrix from lists of any size, with zeros behind the shorter ones."""
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _packed(rows: DataFrame, scale: int) -> DataFrame:
    """Blocks (kind 0) of id, query flag and vector, and beside each the vectors (kind 1) of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ends = np.cumsum(sizes)
            ids, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            step = max(1, BLOCK_BYTES // (8 * max(1, int(sizes.max(initial=0)))))
            for a in range(0, len(ids), step):
                z = min(a + step, len(ids))
                vectors = _padded(flat[ends[a] - sizes[a] : ends[z - 1]], sizes[a:z])
                at = np.flatnonzero(asks[a:z])
                for kind, own, own_ids, norms in ((0, vectors, ids[a:z], vectors), (1, vectors[at], np.concatenate([at, ids[a:z][at]]), vectors[at])):
                    if len(own):
                        small = own.astype(np.float32)
                        data = small if np.array_equal(small, own) else own
                        norm = float(np.sqrt((norms * norms).sum(axis=1)).max())
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((kind, pa.int32()), (block, pa.int64()), (len(own), pa.int64()), (own.shape[1], pa.int32()), (norm, pa.float64()), (own_ids.astype(np.int64).tobytes(), pa.binary()), (data.tobytes(), pa.binary()))], names=["kind", "block", "n", "width", "norm", "ids", "data"])
                block += 1

    return rows.mapInArrow(run, "kind int, block long, n long, width int, norm double, ids binary, data binary")


def _matrix(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float32 if len(data) == 4 * n * width else np.float64).reshape(n, width)


def _scores(queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    width = min(queries.shape[1], rows.shape[1])
    a, b = queries[:, :width].astype(np.float64), rows[:, :width].astype(np.float64)
    if exact:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    if not width:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    return np.clip(whole(a).dot(whole(b).T), -_MOST, _MOST).astype(np.int64)


class _Asked:
    """The queries of a block: own (block, row), id, the lower end of the interval that holds the kth value, and how many are still open."""

    def __init__(self, ids: bytes, data: bytes, n: int, width: int) -> None:
        self.block, self.row, self.id, self.low, self.open = np.frombuffer(ids, dtype=np.int64).reshape(5, n)
        self.vectors = _matrix(data, n, width)

    def against(self, table: pa.Table, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of rows in steps; a query's own row gets the lowest number."""
        for block, n, width, ids, data in zip(*(table.column(c).to_pylist() for c in ("block", "n", "width", "ids", "data"))):
            ids, rows = np.frombuffer(ids, dtype=np.int64), _matrix(data, n, width)
            mine = np.flatnonzero(self.block == block)
            for a in range(0, n, ROWS):
                s = _scores(self.vectors, rows[a : a + ROWS], exact)
                own = mine[(self.row[mine] >= a) & (self.row[mine] < a + ROWS)]
                s[own, self.row[own] - a] = np.iinfo(np.int64).min
                yield ids[a : a + ROWS], s


def _asked(table: pa.Table) -> tuple[_Asked | None, pa.Table]:
    kinds = table.column("kind").to_numpy()
    at = np.flatnonzero(kinds == 1)
    if not len(at) or len(at) == len(kinds):
        return None, table.slice(0, 0)
    q = {c: table.column(c)[int(at[0])].as_py() for c in ("ids", "data", "n", "width")}
    return _Asked(**q), table.take(pa.array(np.flatnonzero(kinds == 0)))


_COUNTED = "block long, row long, bin int, n long"


def _count(shift: int, bits: int, exact: bool):
    """Counts of a group's scores by bin of each query's interval, from the highest bin down to where enough are counted."""

    def run(table: pa.Table) -> pa.Table:
        q, rows = _asked(table)
        if q is None:
            return pa.table({"block": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "bin": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        bins = 1 << bits
        counts = np.zeros(len(q.id) * bins, dtype=np.int64)
        first = (np.arange(len(q.id)) * bins)[:, None]
        for _, s in q.against(rows, exact):
            inside = s >= q.low[:, None]
            s = (s - q.low[:, None]) >> shift
            inside &= s < bins
            counts += np.bincount((s + first)[inside], minlength=len(counts))
        counts = counts.reshape(-1, bins)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        i, b = np.nonzero((counts > 0) & (above < q.open[:, None]))
        return pa.table({"block": q.block[i], "row": q.row[i], "bin": b.astype(np.int32), "n": counts[i, b]})

    return run


def _take(exact: bool):
    """Scores above each query's kth value, and of those equal to it the smallest ids of the group."""

    def run(table: pa.Table) -> pa.Table:
        q, rows = _asked(table)
        above: list[tuple[np.ndarray, ...]] = []
        ties = np.empty((2, 0), dtype=np.int64)
        if q is not None:
            for ids, s in q.against(rows, exact):
                i, j = np.nonzero((s > q.low[:, None]) & (s > np.iinfo(np.int64).min))
                above.append((i, ids[j], s[i, j]))
                i, j = np.nonzero((s == q.low[:, None]) & (q.open > 0)[:, None])
                ties = np.concatenate([ties, np.stack([i, ids[j]])], axis=1)
                ties = ties[:, np.lexsort((ties[1], ties[0]))]
                place = np.arange(ties.shape[1]) - np.searchsorted(ties[0], ties[0])
                ties = ties[:, place < q.open[ties[0]]]
            above.append((ties[0], ties[1], q.low[ties[0]]))
        i, ids, s = (np.concatenate([x[k] for x in above] or [np.empty(0, np.int64)]).astype(np.int64) for k in range(3))
        own = q if q is not None else _Asked(b"", b"", 0, 0)
        return pa.table({"block": own.block[i], "row": own.row[i], "query_id": own.id[i], "vec_id": ids, "score": s})

    return run


def _asking(table: pa.Table) -> pa.Table:
    """One block of queries from its rows."""
    sizes = table.column("width").to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(table.column("data").to_pylist()), dtype=np.float64)
    head = np.stack([table.column(c).to_numpy() for c in ("block", "row", "id", "low", "open")])
    return pa.table({
        "part": table.column("part")[:1], "kind": pa.array([1], pa.int32()), "block": pa.array([0], pa.int64()), "n": pa.array([len(sizes)], pa.int64()),
        "width": pa.array([int(sizes.max())], pa.int32()), "ids": pa.array([head.tobytes()], pa.binary()), "data": pa.array([_padded(data, sizes).tobytes()], pa.binary()),
    })


def _single(blocks: DataFrame, parts: int) -> DataFrame:
    """A row for each query: part, block, row, id, width, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, width, ids, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                row, own = np.frombuffer(ids, dtype=np.int64).reshape(2, n)
                vectors = _matrix(data, n, width).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(row), pa.array(own), pa.array(np.full(n, width, dtype=np.int32)), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["block", "row", "id", "width", "data"])

    rows = blocks.select("block", "n", "width", "ids", "data").mapInArrow(run, "block long, row long, id long, width int, data binary")
    return rows.withColumn("part", F.pmod(F.xxhash64("block", "row"), F.lit(parts)).cast("int"))


def top_k(rows: DataFrame, k: int, is_query: Column, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` rows of highest score for each query.

    Components are ``floor(scale * x)`` and the score is their inner product.
    """
    spark = rows.sparkSession
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scale * x.cast("double")) < float("inf")))
    valid = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    valid = valid.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("ask"), F.col(vec_col).cast("array<double>").alias("vec"))
    packed = materialize(_packed(valid, scale), "packed")
    stats = {r["kind"]: r for r in packed.groupBy("kind").agg(F.sum("n").alias("n"), F.max("norm").alias("norm"), F.count("*").alias("blocks"), F.sum(F.octet_length("data")).alias("bytes")).collect()}
    if 1 not in stats:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = stats[0]["norm"] * stats[1]["norm"] * (1 + 1e-9) + 1
    exact = bound < 2**53
    width = int(bound if bound < _MOST else _MOST).bit_length() + 1
    parts = -(-int(stats[1]["n"]) // QUERIES)
    # As many groups as their bytes ask for, and no fewer than keep the cores busy.
    groups = max(-(-int(stats[0]["bytes"]) // GROUP_BYTES), min(int(stats[0]["blocks"]), -(-2 * spark.sparkContext.defaultParallelism // parts)))
    vectors = packed.where("kind = 0").select("kind", "block", "n", "width", "ids", "data").withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    vectors = vectors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = materialize(_single(packed.where("kind = 1"), parts), "queries")
    state = queries.withColumns({"low": F.lit(-(1 << (width - 1))).cast("long"), "open": F.lit(k).cast("long")})

    def grouped(state: DataFrame) -> DataFrame:
        asking = state.groupBy("part").applyInArrow(_asking, "part int, kind int, block long, n long, width int, ids binary, data binary")
        asking = asking.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return vectors.unionByName(asking).repartition(max(1, min(4 * parts * groups, 10_000)), "part", "group").groupBy("part", "group")

    shift, before = width, None
    while shift:
        bits = -(-shift // -(-shift // BITS))
        shift -= bits
        counted = grouped(state).applyInArrow(_count(shift, bits, exact), _COUNTED).groupBy("block", "row", "bin").agg(F.sum("n").alias("n"))
        over = W.partitionBy("block", "row").orderBy(F.desc("bin"))
        counted = counted.withColumn("upto", F.sum("n").over(over)).join(state.select("block", "row", "low", "open"), ["block", "row"])
        at = counted.where("upto >= open and upto - n < open").select("block", "row", (F.col("low") + F.shiftleft(F.col("bin").cast("long"), shift)).alias("low"), (F.col("open") - F.col("upto") + F.col("n")).alias("open"))
        # A query with fewer rows than it asks for takes them all: its interval begins below every score and nothing is open.
        after = queries.join(at, ["block", "row"], "left").withColumns({"low": F.coalesce("low", F.lit(-(1 << 62)).cast("long")), "open": F.coalesce("open", F.lit(0).cast("long"))})
        state = materialize(after, "state")
        if before is not None:
            discard(before)
        before = state
    found = grouped(state).applyInArrow(_take(exact), "block long, row long, query_id long, vec_id long, score long")
    order = W.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20, F.col("vec_id") % 20 == 0)


def oracle() -> str:
    return """
WITH e AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""
