"""Sharding: weighted rendezvous hashing of record keys.

Each (key, shard) pair hashes to u in (0, 1); a record goes to the shard with
the smallest -ln(u) / weight. A new shard can only win records, so growing by
one moves just what lands in it. Law: ``key``; the key and the number of
shards decide, whatever else the row holds.

Slots number the rows of a shard without gaps: rows are range-partitioned by
(shard, key, size, checksum), counted per partition, and offset by the counts
before them. No task sees more than a range of rows, and equal keys are split
by a row number, so a key with a third of all rows does no harm.

A null key hashes as the empty text. A null text has no bytes: size 1,
checksum 0. Repeated rows get slots of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import materialize


def _draw(key: Column, shard: int, weight: float) -> Column:
    """(-ln(u) / weight, shard): the smallest over all shards wins."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return F.struct((-F.ln((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of ``key`` among ``len(weights)`` shards."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    draws = [_draw(text, i, w) for i, w in enumerate(weights) if w > 0]
    if not draws:
        raise ValueError("some shard needs a positive weight")
    return (F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0])["shard"]


def shard_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Shard, slot and the shard with one more shard of ``grown_weight``."""
    weights = weights or [1.0] * 16
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col), (F.octet_length(data) + F.lit(1)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.withColumns({"shard": rendezvous(F.col(id_col), weights), "grown_shard": rendezvous(F.col(id_col), [*weights, grown_weight]), "__row": F.monotonically_increasing_id()})
    order = ["shard", id_col, "size", "text_crc32", "__row"]
    ranged = materialize(rows, "rows").repartitionByRange(*order).sortWithinPartitions(*order).drop("__row")
    ranged = materialize(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranged")
    before = W.partitionBy("shard").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy("shard", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__from"))
    counts = materialize(counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), "offsets")
    return ranged.join(counts, ["shard", "__part"]).select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__before") + F.col("__at") - F.col("__from")).cast("long").alias("slot"), "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    def least(n: int) -> str:
        draws = ", ".join(f"{{'draw': -ln((('0x' || substr(md5(k || ':{i}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE), 'shard': {i}}}" for i in range(n))
        return f"list_sort([{draws}])[1].shard::INTEGER"

    return f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (
  SELECT doc_id, (length(x) // 2 + 1)::BIGINT AS size,
         xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
             lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32,
         {least(16)} AS shard, {least(17)} AS grown_shard
  FROM d, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM s"""
