"""Byte-level text helpers that the Arrow operators share.

Texts travel to Python as binary, so nothing is decoded that need not be.
``bytes.lower`` and ``bytes.split`` touch ASCII only: lower-casing is A-Z, and
words are runs of anything but space and U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def as_bytes(col: str) -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def map_texts(docs: DataFrame, keep: dict[str, Column], text_col: str, schema: str, fn: Callable[[list[bytes]], dict], chunk_bytes: int = 8 << 20) -> DataFrame:
    """Rows of ``keep`` with the columns that ``fn`` computes from the texts.

    ``fn`` gets the texts of at most about ``chunk_bytes`` bytes (one longer
    text comes alone) and returns one list or array per new column, so a
    task's memory is bounded by its chunk and not by its partition.
    """
    kept = docs.select(*[c.alias(n) for n, c in keep.items()], as_bytes(text_col).alias("__text"))
    head = kept.drop("__text").schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head)
    full = f"{fields}, {schema}" if fields else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at, n in _chunks(texts, chunk_bytes):
                own = fn(texts.slice(at, n).to_pylist())
                arrays = [batch.column(i).slice(at, n) for i in range(batch.num_columns - 1)]
                names = batch.schema.names[:-1]
                arrays += [v if isinstance(v, pa.Array) else pa.array(v) for v in own.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *own])

    return kept.mapInArrow(run, full)


def _chunks(texts: pa.Array, chunk_bytes: int) -> Iterator[tuple[int, int]]:
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > chunk_bytes:
            yield start, i - start
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes) - start
