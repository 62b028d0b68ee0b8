"""Merges of user state: last-write-wins logs, texts, and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("add", "del")


def last_write(log: DataFrame, keys: Sequence[str], op: str = "op", ts: str = "ts", incoming: str = "incoming", seq: str = "seq") -> DataFrame:
    """(keys, op, ts): the winning entry of each id: the latest, on a tie the incoming one, then the later `seq`.
    Malformed operations are dropped. The merge is an aggregate, so the same code runs on batches and streams."""
    fine = log.where(F.col(op).isin(*OPS) & F.col(ts).isNotNull())
    best = F.max(F.struct(ts, incoming, seq, op)).alias("best")
    return fine.groupBy(*keys).agg(best).select(*keys, F.col(f"best.{op}").alias(op), F.col(f"best.{ts}").alias(ts))


def current(log: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """Ids whose winning entry is `add`."""
    return last_write(log, keys, **columns).where("op = 'add'").select(*keys)


def with_legacy(log: DataFrame, legacy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, op, ts): adds from sources without a log beat every entry; their merged timestamp is 0."""
    old = legacy.select(*keys).distinct().select(*keys, F.lit("add").alias("op"), F.lit(0).cast("long").alias("ts"))
    return last_write(log, keys).join(old, [*keys], "left_anti").unionByName(old)


def merge_texts(local: DataFrame, incoming: DataFrame, key: str, text: str, not_items: DataFrame | None = None) -> DataFrame:
    """The longer text of each key wins, the local one on a tie; blank texts never win; keys of the wrong kind go."""
    both = local.select(key, text, F.lit(1).alias("is_local")).unionByName(incoming.select(key, text, F.lit(0).alias("is_local")))
    both = both.where(F.length(F.trim(text)) > 0)
    if not_items is not None:
        both = both.join(not_items.select(key), key, "left_anti")
    return both.groupBy(key).agg(F.max_by(text, F.struct(F.length(text), "is_local", F.col(text))).alias(text))


def migrated(old: DataFrame, keys: Sequence[str], synced_at: Column) -> DataFrame:
    """Baseline adds at the time of the last sync for state that has no log."""
    return old.select(*keys).distinct().select(*keys, F.lit("add").alias("op"), synced_at.alias("ts"))


def days_of_range(ranges: DataFrame, first: str, last: str, known: DataFrame, day: str) -> DataFrame:
    """Ranges of days as the days that are known."""
    each = ranges.select("*", F.explode(F.sequence(F.col(first), F.col(last))).alias(day))
    return each.join(known.select(day).distinct().hint("merge"), day, "left_semi").drop(first, last)


def change_counts(before: DataFrame, after: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """(group, added, removed): ids that a merge added or removed."""
    a, b = before.select(*keys).distinct().withColumn("_a", F.lit(1)), after.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, [*keys], "full_outer")
    return both.groupBy(group).agg(F.count(F.when(F.col("_a").isNull(), 1)).alias("added"), F.count(F.when(F.col("_b").isNull(), 1)).alias("removed"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed keys; unchanged ones are left out."""
    a, b = old.select(key, F.col(value).alias("old"), F.lit(1).alias("_a")), new.select(key, F.col(value).alias("new"), F.lit(1).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def replaced_everywhere(uses: DataFrame, corrections: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(uses with old values replaced, old values that nothing uses any more)."""
    fixed = uses.join(corrections.select(F.col("old").alias(value), "new"), value, "left").withColumn(value, F.coalesce("new", value)).drop("new")
    gone = corrections.select(F.col("old").alias(value)).join(fixed.select(value), value, "left_anti").distinct()
    return fixed, gone
