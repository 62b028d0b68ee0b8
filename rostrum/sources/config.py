"""Settings of single programs as tables: venues and their abbreviations, type registries, days, and pattern files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.operators.needles import first_hits
from rostrum.operators.shared import hinted

#: Patterns that a runtime file may have: they are read once, like other configuration.
MOST_PATTERNS = 100_000


@dataclass(frozen=True)
class Settings:
    """Tables keyed by `program`: venues (ord, needle, short), types (id, label), days (day). A program without rows in one
    of them has none of that kind."""

    venues: DataFrame
    types: DataFrame
    days: DataFrame


def with_settings(items: DataFrame, settings: Settings, program: str, location: str = "location", kind: str = "type", start: str = "start") -> DataFrame:
    """`items` with place, label and day by their own program's settings.

    place: the abbreviation of the program's first venue (by ord) whose needle is part of the location, case aside, and the room
    number; the location where none is. label: of the registered type, else null. day: the number of the start's
    day among the program's days, from 1, else null. A program's few rows are gathered per program and
    joined once, so items are neither multiplied nor ranked."""
    venues = settings.venues.groupBy("program").agg(F.array_sort(F.collect_list(F.struct("ord", F.lower("needle").alias("needle"), "short"))).alias("_venues"))
    types = settings.types.groupBy("program", F.col("id").alias(kind)).agg(F.min("label").alias("label"))
    days = settings.days.select("program", "day").distinct().withColumn("_n", F.row_number().over(W.partitionBy("program").orderBy("day")))
    days = days.select("program", F.col("day").alias("_date"), F.col("_n").alias("day"))
    out = items.withColumn("_date", F.to_date(start)).withColumnRenamed(program, "program")
    out = out.join(hinted(venues, 4096), "program", "left").join(hinted(types), ["program", kind], "left").join(hinted(days), ["program", "_date"], "left")
    hit = F.try_element_at(F.filter("_venues", lambda v: F.contains(F.lower(location), v["needle"])), F.lit(1))["short"]
    room = F.nullif(F.regexp_extract(location, r"(?i)(?:room|level|#)\s*([0-9]+[A-Za-z]?)", 1), F.lit(""))
    place = F.when(hit.isNull(), F.col(location)).otherwise(F.concat_ws(" ", hit, room))
    return out.withColumn("place", place).drop("_date", "_venues").withColumnRenamed("program", program)


def first_pattern(rows: DataFrame, patterns: DataFrame, text: str) -> DataFrame:
    """The rows in whose text one of `patterns` (pattern; a Java pattern) is found, with the first of them in order of
    their own text."""
    listed = sorted(r.pattern for r in patterns.select("pattern").limit(MOST_PATTERNS + 1).collect())
    if len(listed) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    plain = all(not set(p) & set("\\^$.|?*+()[]{}") for p in listed)
    hits = first_hits(rows.select(text).distinct(), text, [(p, not plain) for p in listed])
    names = rows.sparkSession.createDataFrame(list(enumerate(listed)), "rank int, pattern string")
    return rows.join(hits.where("rank is not null").join(F.broadcast(names), "rank").select(text, "pattern").hint("merge"), text)
