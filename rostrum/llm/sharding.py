"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and a new shard only takes rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.llm.shared import partitions, written

#: The published multiplier of the generator's step.
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key among `shards`; all keys jump together until each has passed the last shard."""
    state, at, ahead = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    active = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(active):
            at[active] = ahead[active]
            state[active] = state[active] * _STEP + np.uint64(1)
            ahead[active] = ((at[active] + 1) * (float(1 << 31) / ((state[active] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
            active = active[ahead[active] < shards]
    return at.astype(np.int32)


def shard_of(key, shards: int):
    """Column: the shard of `key` among `shards`, by its xxhash64 (a null key has a shard of its own choice)."""

    @F.pandas_udf("int")
    def jumped(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(np.int64).view(np.uint64), shards))

    return jumped(F.xxhash64(key))


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: (id_col, size, text_crc32, law 'key', shard, slot, grown_shard).

    The id and the shard count alone decide the shard; `grown_shard` is the one among shards + 1. `slot` numbers a
    shard's rows from 0 without gaps: rows are numbered inside small hash buckets of a shard and shifted by the counts
    of the buckets before, so no task sees a whole shard. Ids that repeat share a shard and take one slot each. A null
    text has size 1 and the checksum of the empty text; a null id is a key like any other; no rows give no rows."""
    buckets = partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = written(
        keyed.withColumns({
            "shard": shard_of(F.col("id"), shards),
            "grown_shard": shard_of(F.col("id"), shards + 1),
            "bucket": F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(buckets)),
        }),
        "placed",
    )
    # at most shards x buckets rows, whatever the input: a bound for the broadcast
    before = F.sum("rows").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows")).select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("id", "text_crc32")) - 1
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(counts), ["shard", "bucket"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("within")).cast("long").alias("slot"), "grown_shard")
    )
