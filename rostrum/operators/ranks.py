"""Row numbers inside keys without one task a key: rows are dealt by ranges of (key, order), so a key with most of the rows is
spread over all tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.operators.shared import hinted, written


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank", total: str | None = None) -> DataFrame:
    """`df` with `name`: the row's number from 1 inside its key by `order` (ascending, nulls first), and with `total` the number of the
    key's rows.

    Null keys are a key; without keys the whole table is numbered. `order` should end in a unique column: rows of equal order get
    any of their numbers. The ranges are written once, so a task that runs again sees the same ones; what a range must know of the
    others is one count. A column of `df` called `name` or `total` is replaced."""
    given = [c for c in df.columns if c not in (name, total)]
    sorts = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))]
    placed = df.withColumns({f"_o{i}": o if isinstance(o, Column) else F.col(o) for i, o in enumerate(order)})
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys], *sorts).withColumn("_part", F.spark_partition_id())
    ranged = written(dealt, "ranges")
    by = W.partitionBy(*(keys or [F.lit(0)]))
    rows = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(by.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = written(rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), before.alias("_before"), F.sum("_rows").over(by).alias("_n")), "offsets")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    inside = ranged.withColumn("_place", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*sorts)))
    out = inside.join(hinted(offsets), same).withColumn("_number", F.col("_before") + F.col("_place"))
    return out.select(*given, F.col("_number").alias(name), *([F.col("_n").alias(total)] if total else []))
