"""Chat formatting with collapse of cumulative snapshots, with DataFrame functions only.

Logs often hold a conversation again and again, each time with the turns so far. Every prefix of a conversation gets
a rolling hash: each turn's digest covers its position, role and text, and the digests of the turns so far are summed
up in two independent 60-bit lanes. A conversation whose last hash is the hash of a shorter prefix of another one is a
snapshot; an anti-join drops it. Equal conversations keep the smallest id. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.llm.shared import written

START, END = "<|im_start|>", "<|im_end|>"


def _lane(digest: Column, at: int) -> Column:
    """15 hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END), F.lit("\n"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, n_turns, n_copies, chat): one row for each conversation that is no proper prefix of another.

    Turns are ordered by number, then role and text, so ties have one order; repeated turns stay. A null role is
    'unknown', a null text is empty; rows with a null conversation id belong to none and are left out; a null turn
    number comes first. `n_copies` counts the equal conversations that the row stands for. No rows give no rows.
    The turns of one conversation meet in one sorted stream; copies are merged before the anti-join, so a
    conversation that many logs hold doesn't gather in one task."""
    order = ["turn", "role", "text"]
    base = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    by = W.partitionBy("conv").orderBy(*order)
    digest = F.sha2(F.concat_ws("\x00", F.col("k").cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    so_far = by.rowsBetween(W.unboundedPreceding, 0)
    prefixes = written(
        base.withColumn("k", F.row_number().over(by))
        .withColumn("digest", digest)
        .select("conv", "k", F.sum(_lane(F.col("digest"), 1)).over(so_far).alias("h1"), F.sum(_lane(F.col("digest"), 17)).over(so_far).alias("h2"), F.count(F.lit(1)).over(W.partitionBy("conv")).alias("n")),
        "prefixes",
    )
    whole = prefixes.where("k = n").groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    longer = prefixes.where("k < n").select(F.col("k").alias("n"), "h1", "h2").distinct()
    kept = written(whole.join(longer.hint("merge"), ["n", "h1", "h2"], "left_anti").select("conv", "n", "n_copies"), "kept")
    lines = F.array_sort(F.collect_list(F.struct(*order)))
    return (
        base.join(kept.hint("merge"), "conv")
        .groupBy("conv", "n", "n_copies")
        .agg(F.array_join(F.transform(lines, lambda t: rendered(t["role"], t["text"])), "").alias("chat"))
        .select(F.col("conv").alias(conv_col), F.col("n").cast("long").alias("n_turns"), "n_copies", "chat")
    )
