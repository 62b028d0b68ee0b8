"""Classification by ordered keyword rules, durations and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_keywords(fields: Sequence[Column], rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first rule (pattern, label) that any field matches; a field is tried with all rules before the
    next field."""
    out = F.lit(default)
    for field in reversed([*fields]):
        for pattern, label in reversed([*rules]):
            out = F.when(F.coalesce(F.lower(field).rlike(pattern), F.lit(False)), label).otherwise(out)
    return out


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes of the clock from start to end (minutes of the day), across midnight."""
    return F.pmod(end - start, F.lit(1440))


def by_duration(minutes: Column, phase: Column, long: int = 30) -> Column:
    """Long talks are invited; others go by their phase."""
    return F.when(minutes >= long, "invited").when(phase == "poster", "poster").otherwise("oral")


def phase_of(at: Column, cut: Column) -> Column:
    return F.when(at < cut, "first").otherwise("second")


def half_of_day(at: Column) -> Column:
    return F.when(F.hour(at) < 12, "AM").otherwise("PM")


def format_of(banner: Column, n_children: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """By the banner's beginning; without children an event, else oral."""
    found = F.lit(None).cast("string")
    for prefix, label in reversed([*rules]):
        found = F.when(F.startswith(F.lower(banner), F.lit(prefix)), label).otherwise(found)
    return F.coalesce(found, F.when(n_children == 0, "event").otherwise("oral"))
