"""Chat formatting: cumulative snapshots collapse to maximal conversations.

A chat service that logs the whole conversation after every turn leaves many
prefixes of one conversation. Each turn gets a rolling hash of the turns up to
it (two 60-bit xors of hashes that hold the turn's place, role and text). A
conversation whose last hash is some longer conversation's inner hash is a
prefix of it and goes in an anti-join; of equal conversations the smallest id
stays. Common first turns and much-copied conversations collapse in partial
aggregates before any join.

Turns are ordered by (turn, role, text); exact repeats of a row count once.
Null roles and texts are empty. Rows with a null conversation id belong to no
conversation and give no row. Markers inside a text are broken up by a space.
The result has a row per kept conversation, whose text is the sum of its turns,
however long. Other columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import materialize

#: The turn markers of the output format.
START, END = "<|im_start|>", "<|im_end|>"


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Adds ``at`` (1, 2, ...), ``h1``, ``h2`` (hash of the turns up to here) and ``n``."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = turns.withColumn("at", F.row_number().over(order))
    # The lengths keep (role, text) apart whatever characters they hold.
    digest = F.md5(F.concat_ws(":", F.col("at").cast("string"), F.octet_length("role").cast("string"), F.octet_length("text").cast("string"), "role", "text"))
    out = out.withColumns({"__a": _half(digest, 1), "__b": _half(digest, 17)})
    out = out.withColumns({"h1": F.bit_xor("__a").over(so_far), "h2": F.bit_xor("__b").over(so_far), "n": F.count("*").over(W.partitionBy("conv_id"))})
    return out.drop("__a", "__b")


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, n_copies, rendered."""
    turns = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    # One shuffle of the texts serves the distinct and the windows.
    turns = turns.repartition("conv_id").distinct()
    hashed = materialize(prefix_hashes(turns), "turns")
    inner = hashed.where("at < n").select("h1", "h2").distinct()
    whole = hashed.where("at = n").groupBy("h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    kept = materialize(whole.join(inner, ["h1", "h2"], "left_anti").select("conv_id", "n_copies"), "kept")
    body = F.concat(F.lit(START), "role", F.lit("\n"), F.replace("text", F.lit("<|"), F.lit("< |")), F.lit(END + "\n"))
    shown = hashed.join(kept, "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", body.alias("body")))).alias("turns"))
    return shown.join(kept, "conv_id").select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.transform("turns", lambda t: t["body"]), "").alias("rendered"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def oracle() -> str:
    return f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
w AS (SELECT turns, min(conv_id) AS conv_id, count(*)::BIGINT AS n_copies FROM c GROUP BY turns),
inner_ AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM w))
SELECT conv_id, len(turns)::BIGINT AS n_turns, n_copies,
       array_to_string(list_transform(turns, lambda x: '{START}' || x.role || chr(10) || replace(x.text, '<|', '< |') || '{END}' || chr(10)), '') AS rendered
FROM w WHERE turns NOT IN (SELECT turns FROM inner_)"""
