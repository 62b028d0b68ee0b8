"""Operators over ordered rows: numbering, runs, gaps, overlaps, slots and missing ends. Every window has a partition
key, so no task sees a whole table."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.operators.ranks import numbered

from rostrum.operators import sweeps


def number_repeats(df: DataFrame, keys: Sequence[str], title: str, order: Sequence[str]) -> DataFrame:
    """Titles that repeat within their key get ` 1`, ` 2` … in order; unique ones stay."""
    by = W.partitionBy(*keys, title)
    n, k = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy(*order))
    return df.withColumn(title, F.when(n > 1, F.concat_ws(" ", F.col(title), k.cast("string"))).otherwise(F.col(title)))


def running_flag(flag: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """How many rows up to this one have the flag."""
    return F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def day_rollover(df: DataFrame, keys: Sequence[str], order: Sequence[str], minute: str, last_day: int, slack: int = 1) -> DataFrame:
    """`day` of each row: a clock that goes back by more than `slack` minutes begins the next day, up to last_day."""
    before = F.lag(minute).over(W.partitionBy(*keys).orderBy(*order))
    stepped = df.withColumn("_back", F.col(minute) < before - slack)
    return stepped.withColumn("day", F.least(running_flag(F.col("_back"), keys, order), F.lit(last_day))).drop("_back")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], divider: Column, phase: Column) -> DataFrame:
    """`run` numbers contiguous rows: a divider is a run of its own, and a change of phase begins a new one."""
    by = W.partitionBy(*keys).orderBy(*order)
    marked = df.withColumns({"_divider": F.coalesce(divider, F.lit(False)), "_phase": phase})
    first = F.lag("_divider").over(by).isNull()
    breaks = first | F.col("_divider") | F.lag("_divider").over(by) | ~F.col("_phase").eqNullSafe(F.lag("_phase").over(by))
    stepped = marked.withColumn("_break", breaks)
    return stepped.withColumn("run", running_flag(F.col("_break"), keys, order)).withColumnRenamed("_divider", "is_divider").drop("_phase", "_break")


def gap_clusters(df: DataFrame, keys: Sequence[str], value: str, tolerance: float, order: Sequence[str] = ()) -> DataFrame:
    """`cluster` numbers chains whose neighbours are at most `tolerance` apart."""
    by = W.partitionBy(*keys).orderBy(value, *order)
    stepped = df.withColumn("_gap", F.col(value) - F.lag(value).over(by) > tolerance)
    return stepped.withColumn("cluster", running_flag(F.col("_gap"), keys, [value, *order])).drop("_gap")


def anchored_clusters(df: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """(keys, value, cluster): a value belongs to a cluster while it is within `tolerance` of the cluster's smallest.
    Distinct values only are swept, so a key is as long as it has values."""
    distinct = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()

    def sweep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(value)
        cluster, anchor, out = -1, None, []
        for v in rows[value]:
            if anchor is None or v - anchor > tolerance:
                cluster, anchor = cluster + 1, v
            out.append(cluster)
        return rows.assign(cluster=out)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    return distinct.groupBy(*keys).applyInPandas(sweep, f"{kinds}, cluster int")


def overlaps(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str]) -> DataFrame:
    """`overlaps`: the half-open interval begins before an earlier one of its key has ended, or starts together with
    another."""
    by = W.partitionBy(*keys).orderBy(start, *order)
    ends = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    same = F.count(F.lit(1)).over(W.partitionBy(*keys, start)) > 1
    return df.withColumn("overlaps", F.coalesce(F.col(start) < ends, F.lit(False)) | same)


def renumber(children: DataFrame, parent: str, number: str, pos: Sequence[str]) -> DataFrame:
    """(parent, number, new_number): numbers of each parent from 1 in order of first appearance."""
    first = children.groupBy(parent, number).agg(F.min(F.struct(*pos)).alias("at"))
    return first.select(parent, number, F.row_number().over(W.partitionBy(parent).orderBy("at", number)).alias("new_number"))


def slots(df: DataFrame, keys: Sequence[str], order: Sequence[str], begin: Column, close: Column, minutes: int) -> DataFrame:
    """`slot_start` and `slot_end` (in minutes): one after the other, clipped at the close; full ones are left out."""
    k = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    timed = df.withColumn("slot_start", begin + k * minutes).withColumn("slot_end", F.least(F.col("slot_start") + minutes, close))
    return timed.where(F.col("slot_start") < close)


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """`chunk`: each key's rows in order, in up to n chunks of equal size (the last one shorter). Rows are numbered by ranges, so a key
    with most rows isn't one task."""
    size = F.ceil(F.col("_total") / n)
    return numbered(df, keys, order, "_rank", "_total").withColumn("chunk", F.floor((F.col("_rank") - 1) / size).cast("int")).drop("_rank", "_total")


def unique_codes(df: DataFrame, slug: Column, order: Sequence[str]) -> DataFrame:
    """`code`: the slug, then slug2, slug3 … for repeats in order."""
    named = df.withColumn("_slug", slug)
    k = F.row_number().over(W.partitionBy("_slug").orderBy(*order))
    return named.withColumn("code", F.when(k == 1, F.col("_slug")).otherwise(F.concat("_slug", k.cast("string")))).drop("_slug")


def stitched(lines: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """(key, record, text): lines join the open record until it ends with a period or a blank line comes."""
    by = W.partitionBy(key).orderBy(pos)
    before = F.lag(line).over(by)
    begins = lines.withColumn("_new", before.isNull() | (F.trim(before) == "") | before.rlike(r"\.\s*$"))
    numbered = begins.withColumn("record", running_flag(F.col("_new"), [key], [pos])).where(F.trim(line) != "")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos), F.trim(line).alias("t"))))
    return numbered.groupBy(key, "record").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("text"))


def next_boundary(df: DataFrame, columns: Sequence[str], now: Column) -> DataFrame:
    """(boundary): the smallest instant of the columns after `now`; null if there is none."""
    each = df.select(F.explode(F.array(*columns)).alias("boundary"))
    return each.where(F.col("boundary") > now).agg(F.min("boundary").alias("boundary"))


def inferred_end(df: DataFrame, parent: Sequence[str], start: str, end: str, seconds: str, closing: Column, extra: Column, starts: DataFrame | None = None, day: Sequence[str] = ()) -> DataFrame:
    """A missing end becomes the next strictly later start of the parent, else its closing time, else the next of
    `starts` (day, start) on the same day, where given, else start + extra. `seconds` is the start as whole seconds, for the
    range frame."""
    later = F.min(start).over(W.partitionBy(*parent).orderBy(seconds).rangeBetween(1, W.unboundedFollowing))
    out = df.withColumn("_later", later)
    out = sweeps.next_after(out, starts, day, start) if starts is not None else out.withColumn("next_at", F.lit(None).cast(df.schema[start].dataType))
    return out.withColumn(end, F.coalesce(F.col(end), "_later", closing, "next_at", F.col(start) + extra)).drop("_later", "next_at")


def parent_span(parents: DataFrame, children: DataFrame, key: str, start: str, end: str, closing: str, extra: Column, day: Sequence[Column] = ()) -> DataFrame:
    """Start: the earliest child, else the parent's own. End: the closing time, else the latest child's end, else, by
    `day` (the program and the day of span_start, where given), the next start of a parent that day, else start + extra."""
    spans = children.groupBy(key).agg(F.min(start).alias("_first"), F.max(end).alias("_last"))
    own = F.col("span_start") if "span_start" in parents.columns else F.lit(None)
    out = parents.join(spans.hint("merge"), key, "left").withColumn("span_start", F.coalesce("_first", own)).drop("_first")
    if day:
        names = [f"_day{i}" for i in range(len(day))]
        out = out.withColumns(dict(zip(names, day)))
        out = sweeps.next_after(out, out.select(*names, "span_start").distinct(), names, "span_start").drop(*names)
    else:
        out = out.withColumn("next_at", F.lit(None).cast(out.schema["span_start"].dataType))
    return out.withColumn("span_end", F.coalesce(F.col(closing), "_last", "next_at", F.col("span_start") + extra)).drop("_last", "next_at")


def renumber_all(items: DataFrame, references: DataFrame, parent: str, number: str, pos: Sequence[str], item_pos: str) -> DataFrame:
    """(parent, number, new_number) of all `items` (parent, number, item_pos): from 1 by the first reference (parent, number, pos),
    then the items nobody refers to in their own order. References to no item count for nothing."""
    first = references.groupBy(parent, number).agg(F.min(F.struct(*pos)).alias("_at"))
    both = items.select(parent, number, F.col(item_pos).alias("_pos")).join(first.hint("merge"), [parent, number], "left")
    order = W.partitionBy(parent).orderBy(F.col("_at").asc_nulls_last(), "_pos", number)
    return both.select(parent, number, F.row_number().over(order).alias("new_number"))
