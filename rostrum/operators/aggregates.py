"""Aggregations: pools, casing, consolidation, facets, merges, reports and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators.shared import hinted


def pool(df: DataFrame, *columns: str, separator: str = ";") -> DataFrame:
    """(value): distinct trimmed non-blank values of the columns, lists split at the separator."""
    each = F.explode(F.flatten(F.array(*[F.split(F.coalesce(F.col(c), F.lit("")), separator) for c in columns])))
    return df.select(each.alias("value")).select(F.trim("value").alias("value")).where("value != ''").distinct()


def learn_casing(tokens: DataFrame, token: str) -> DataFrame:
    """(upper, form): the most frequent form of each upper-cased token (ties: the smallest form), where that form has
    two capitals or more. Two aggregations with partial results; no token's rows meet in one task."""
    counts = tokens.groupBy(F.upper(token).alias("upper"), F.col(token).alias("form")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("upper").agg(F.max(F.struct("n", F.lit(0).alias("z"))).alias("m")).select("upper", F.col("m.n").alias("n"))
    first = counts.join(best.hint("merge"), ["upper", "n"]).groupBy("upper").agg(F.min("form").alias("form"))
    return first.where(F.length(F.regexp_replace("form", "[^A-Z]", "")) >= 2)


def consolidate(labels: DataFrame, label: str, curated: Column) -> DataFrame:
    """(label, winner): labels that are equal without diacritics (case kept) share a winner: curated first, then the
    larger count, a form with diacritics, the longer, the greater text."""
    plain = T.unmarked_cased(F.col(label))
    counts = labels.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.max(curated.cast("int")).alias("curated"))
    keyed = counts.withColumn("key", plain)
    order = F.struct("curated", "n", (F.col(label) != F.col("key")).cast("int"), F.length(label), F.col(label))
    winners = keyed.groupBy("key").agg(F.max_by(label, order).alias("winner"))
    return keyed.join(winners.hint("merge"), "key").select(label, "winner")


def facets(df: DataFrame, token: str, registry: DataFrame, default: str = "neutral") -> DataFrame:
    """(id, label, n) for the registered types that occur, in the registry's order (`ord`)."""
    counts = df.groupBy(F.coalesce(token, F.lit(default)).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(registry), "id").select("id", "label", "ord", "n")


def merge_groups(parents: DataFrame, children: DataFrame, signature: Sequence[str], key: str, pos: str, number: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) where parents with equal signatures are one, the first by `pos`; children point to it and
    those with a repeated number are kept once (the first by their parent's place)."""
    first = parents.groupBy(*signature).agg(F.min_by(key, pos).alias("survivor"))
    same = [parents[c].eqNullSafe(first[c]) for c in signature]
    moved = parents.join(first, same).select(parents[key], parents[pos], "survivor")
    kept = parents.join(moved.where(F.col(key) == F.col("survivor")).select(key), key, "left_semi")
    others = [c for c in children.columns if c not in (key, number)]
    once = children.join(moved, key).groupBy(F.col("survivor").alias(key), number).agg(F.min_by(F.struct(*others), pos).alias("row"))
    return kept, once.select(key, number, "row.*")


def merge_tags(rows: DataFrame, signature: Sequence[str], tags: str, pos: str) -> DataFrame:
    """(signature, key, value): values of each key of groups with equal signatures, distinct, in order of appearance,
    joined by ` / `."""
    each = rows.select(*signature, pos, F.posexplode(tags).alias("at", "tag")).select(*signature, pos, "at", "tag.key", "tag.value")
    seen = each.groupBy(*signature, "key", "value").agg(F.min(F.struct(pos, "at")).alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "value")))
    return seen.groupBy(*signature, "key").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), " / ").alias("value"))


def integer_median(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Median of integers per key, floored; counts per value first, so a key is as many rows as it has values."""
    counts = df.groupBy(*keys, value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.floor(F.expr("percentile(v, 0.5D, n)")).alias("median"))


def quality_report(df: DataFrame, key: str, checks: dict[str, Column], samples: int = 3) -> DataFrame:
    """(category, n, samples): rows that fail each check, with the `samples` smallest keys as examples. One scan counts, one
    ranks; a task passes on no more than its own first keys of a category, so nothing unbounded is collected."""
    flags = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    rows = df.select(key, F.explode(flags).alias("category"))
    totals = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.where(F.col(key).isNotNull()).withColumn("place", F.dense_rank().over(W.partitionBy("category").orderBy(key))).where(F.col("place") <= samples)
    shown = ranked.groupBy("category").agg(F.array_sort(F.collect_set(F.struct("place", F.col(key).cast("string").alias("k")))).alias("first"))
    named = F.array_join(F.transform(F.coalesce("first", F.array().cast("array<struct<place:int,k:string>>")), lambda x: x["k"]), ",")
    return totals.join(shown.hint("merge"), "category", "left").select("category", "n", named.alias("samples"))


def dangling(children: DataFrame, parents: DataFrame, key: str, number: str) -> DataFrame:
    """(key, duplicate_number, dangling): parents' children whose numbers repeat or whose parent isn't there."""
    repeated = children.groupBy(key, number).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg((F.max("n") > 1).alias("duplicate_number"))
    known = parents.select(key).distinct().withColumn("there", F.lit(True))
    return repeated.join(known, key, "left").select(key, "duplicate_number", F.col("there").isNull().alias("dangling"))


def union_facets(tables: Sequence[tuple[DataFrame, str, DataFrame]], default: str = "neutral") -> DataFrame:
    """(id, label, ord, n) over several tables, each as (rows, token, registry of id, label, ord): the counts of a token in all of
    them together, by the first registry that has it.

    `ord` counts from 1: the first registry's types in its order, then those only later ones have. Null tokens count as `default`, types in no
    registry or without rows are left out. Registries are small tables of types, one row a type."""
    counts = reduce(DataFrame.unionByName, [df.groupBy(F.coalesce(token, F.lit(default)).alias("id")).agg(F.count(F.lit(1)).alias("n")) for df, token, _ in tables])
    types = reduce(DataFrame.unionByName, [r.select("id", F.struct(F.lit(i).alias("i"), "ord", "label").alias("t")) for i, (_, _, r) in enumerate(tables)])
    first = types.groupBy("id").agg(F.min("t").alias("t"))
    order = F.array_position(F.array_sort(F.collect_list("at").over(W.partitionBy(F.lit(1)))), F.col("at")).cast("int")
    placed = first.withColumn("at", F.struct("t.i", "t.ord", "id")).select("id", F.col("t.label").alias("label"), order.alias("ord"))
    return counts.groupBy("id").agg(F.sum("n").alias("n")).join(hinted(placed), "id").select("id", "label", "ord", "n")


def counters(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """One row: `n`, and for each flag how many rows it holds for (null is no), in one aggregate."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(flag).alias(name) for name, flag in flags.items()])
