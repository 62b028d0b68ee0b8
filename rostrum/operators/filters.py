"""Predicates and projections over items with a start, an end, a type and a place. `now` is always a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_past(end: Column, now: Column) -> Column:
    """Ended before `now`; without an end never."""
    return F.coalesce(end < now, F.lit(False))


def in_progress(start: Column, end: Column, now: Column) -> Column:
    """start <= now < end; false where either is missing."""
    return F.coalesce((start <= now) & (now < end), F.lit(False))


def not_concluded(end: Column, withdrawn: Column, now: Column, show_all: bool = False) -> Column:
    return F.lit(True) if show_all else ~(is_past(end, now) | F.coalesce(withdrawn, F.lit(False)))


def type_shown(token: Column, hidden: Sequence[str], default: str = "neutral") -> Column:
    return ~F.coalesce(token, F.lit(default)).isin(*hidden) if hidden else F.lit(True)


def on_days(start: Column, days: Sequence[str]) -> Column:
    """Starts on one of the days; no days means all, and undated rows always pass."""
    return start.isNull() | F.to_date(start).isin(*[F.to_date(F.lit(d)) for d in days]) if days else F.lit(True)


def display_title(title: Column, withdrawn: Column) -> Column:
    return F.when(withdrawn & ~title.rlike("(?i)withdrawn"), F.concat(F.lit("(WITHDRAWN) "), title)).otherwise(title)


def inherited(own: Column, parent: Column) -> Column:
    """The own value, also where it is explicitly blank; the parent's where it is missing."""
    return F.coalesce(own, parent)


def compact_place(own_short: Column, own: Column, parent_short: Column, parent: Column) -> Column:
    """For tight places: the own short form if it isn't blank, else the own place where there is one (an explicit blank too), else the
    parent's short form or place, the first that isn't blank; an empty text where there is none."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(own_short), own, filled(parent_short), filled(parent), F.lit(""))


def usable_affiliation(c: Column) -> Column:
    return F.exists(F.split(c, ";"), lambda p: F.length(F.regexp_replace(p, "[^A-Za-z]", "")) >= 2)


def meaningful_source(c: Column, countries: Sequence[str]) -> Column:
    """More than a country and a legal form."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(c), r"\b(?:inc|ltd|llc|gmbh|corp|co)\b\.?", ""), "|".join(countries), "")
    return F.length(F.regexp_replace(rest, "[^a-z]", "")) >= 2


def time_range(start: Column, end: Column) -> Column:
    return F.concat_ws(" – ", F.date_format(start, "HH:mm"), F.date_format(end, "HH:mm"))


def tags(kind: Column, topic: Column) -> Column:
    """Ordered (key, value) tags: the type, then the topic unless it repeats the type; a topic `k: v` has its own key."""
    own = topic.rlike("^[^:]+: .+$")
    topical = F.when(own, F.struct(F.regexp_extract(topic, "^([^:]+): ", 1).alias("key"), F.regexp_extract(topic, "^[^:]+: (.+)$", 1).alias("value"))).otherwise(F.struct(F.lit("topic").alias("key"), topic.alias("value")))
    typed = F.when(kind.isNotNull() & (kind != ""), F.struct(F.lit("type").alias("key"), kind.alias("value")))
    return F.array_compact(F.array(typed, F.when(topic.isNotNull() & (topic != "") & ~topic.eqNullSafe(kind), topical)))


def flattened(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """One header row for each parent, then its children with the parent's columns repeated; `row_type` tells them
    apart."""
    child = children.join(parents, key).withColumn("row_type", F.lit("child"))
    return parents.withColumn("row_type", F.lit("header")).unionByName(child, allowMissingColumns=True)


def last_per_key(rows: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """One row for each key: the last by `pos`. Aggregated, so a key with many rows is merged before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(pos)).alias("last")).select(*keys, "last.*")


def drop_empty_parents(df: DataFrame, n_children: Column, start: Column, kind: Column) -> DataFrame:
    return df.where((n_children > 0) | start.isNotNull() | F.coalesce(kind == "Event", F.lit(False)))
