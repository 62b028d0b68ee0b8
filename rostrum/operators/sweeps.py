"""Sweeps along an axis inside keys (as-of, nearest, bands, slots, event times) and spans inside spans, also where one key
has most of the rows.

A sweep stacks both sides and deals the rows by ranges of (key, place), so a task gets a stretch of a key, whatever the key's
size. What a stretch must know of the others is one row: the last hit before it and the first behind it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.operators.shared import hinted, ranges_of, written


def swept(rows: DataFrame, keys: Sequence[str], at: str, hits: Sequence[str], side: str = "side") -> DataFrame:
    """`rows` with, for each column h of `hits`, h_low: the last hit of the key up to and with the row, and h_high: the
    first hit behind it. A hit is a struct that begins with the row's `at`, or null. Rows go by `at` (nulls first), then `side`;
    of hits at one place, h_low is the largest and h_high the smallest. Null keys are a key."""
    order = [F.col(at).asc_nulls_first(), F.col(side), F.col("_salt")]
    # a number fixed by the write splits even rows of one place over the ranges
    salted = written(rows.withColumn("_salt", F.monotonically_increasing_id()), "stacked")
    n = ranges_of(salted)
    ranged = written(salted.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys], *order).withColumn("_part", F.spark_partition_id()), "stretches")
    ends = ranged.groupBy(*keys, "_part").agg(*[f(h).alias(f"{n}_{h}") for h in hits for n, f in (("_max", F.max), ("_min", F.min))])
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy(*keys).orderBy(F.col("_part").desc()).rowsBetween(W.unboundedPreceding, -1)
    carry = written(ends.select(*keys, "_part", *[c for h in hits for c in (F.max(f"_max_{h}").over(before).alias(f"_before_{h}"), F.min(f"_min_{h}").over(behind).alias(f"_behind_{h}"))]), "carry")
    # the stretches are dealt by number and key over n tasks, which adaptive execution would put together to fewer
    dealt = ranged.repartition(n, *keys, "_part")
    up = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys, "_part").orderBy(F.col(at).desc_nulls_last(), F.col(side).desc(), F.col("_salt").desc()).rowsBetween(W.unboundedPreceding, -1)
    inside = dealt.withColumns({f"_up_{h}": F.max(h).over(up) for h in hits}).withColumns({f"_down_{h}": F.min(h).over(down) for h in hits})
    named = carry.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}).withColumnRenamed("_part", "_p")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    both = inside.join(hinted(named), same, "left")
    return both.withColumns({f"{h}_low": F.coalesce(f"_up_{h}", f"_before_{h}") for h in hits} | {f"{h}_high": F.coalesce(f"_down_{h}", f"_behind_{h}") for h in hits}).select(*rows.columns, *[f"{h}_{x}" for h in hits for x in ("low", "high")])


def _stacked(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, hits: dict[str, Column]) -> DataFrame:
    """Both sides, right ones first at equal places, with the hits of the right side."""
    typed = right.select(*[c.alias(h) for h, c in hits.items()]).schema
    own = left.withColumns({h: F.lit(None).cast(typed[h].dataType) for h in hits} | {"side": F.lit(1)})
    return own.unionByName(right.select(*keys, at, *[c.alias(h) for h, c in hits.items()], F.lit(0).alias("side")), allowMissingColumns=True)


def _left(df: DataFrame, left: DataFrame, *more: str) -> DataFrame:
    return df.where("side = 1").select(*left.columns, *more)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, tolerance: Column | None = None) -> DataFrame:
    """For each left row, `value` and time (`matched_at`) of the last right row of its key at or before `at`, within the
    tolerance (in the unit of `at`); of right rows at one time, the largest value."""
    place = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    found = _left(swept(_stacked(left, right.where(F.col(at).isNotNull()), keys, at, {"_hit": place}), keys, at, ["_hit"]), left, "_hit_low")
    near = F.lit(True) if tolerance is None else F.col(at) - F.col("_hit_low.at") <= tolerance
    return found.withColumns({"matched_at": F.when(near, F.col("_hit_low.at")), "matched": F.when(near, F.col("_hit_low.value"))}).drop("_hit_low")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """For each left row the right row of its key that is nearest in `at` (`matched`, `matched_at`), ties to the earlier
    one."""
    place = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    found = _left(swept(_stacked(left, right.where(F.col(at).isNotNull()), keys, at, {"_hit": place}), keys, at, ["_hit"]), left, "_hit_low", "_hit_high")
    best = _nearer(F.col(at), F.col("_hit_low"), F.col("_hit_high"))
    return found.withColumns({"matched": best["value"], "matched_at": best["at"]}).drop("_hit_low", "_hit_high")


def _nearer(at: Column, low: Column, high: Column) -> Column:
    """Of two hits around `at`, either of which may be null, the nearer one; ties to the lower."""
    return F.when(low.isNotNull() & (high.isNull() | (F.abs(at - low["at"]) <= F.abs(at - high["at"]))), low).otherwise(high)


def band_of(rows: DataFrame, headers: DataFrame, keys: Sequence[str], pos: str, header: str) -> DataFrame:
    """The header whose band [its position, the next header's) holds each row; rows before the first are dropped."""
    return as_of(rows, headers, keys, pos, header).where("matched is not null").withColumnRenamed("matched", header).drop("matched_at")


def next_after(rows: DataFrame, points: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """`rows` with `next_at`: the first of the points (keys, at) of its key strictly after `at`; null where `at` is."""
    place = F.struct(F.col(at).alias("at"))
    found = _left(swept(_stacked(rows, points.where(F.col(at).isNotNull()), keys, at, {"_hit": place}), keys, at, ["_hit"]), rows, "_hit_high")
    return found.withColumn("next_at", F.when(F.col(at).isNotNull(), F.col("_hit_high.at"))).drop("_hit_high")


def _with_neighbours(slots: DataFrame, keys: Sequence[str], at: str, fields: Sequence[str]) -> DataFrame:
    """Slots, one row a place, with `prev` and `next`: structs (at, fields) of the slots before and behind."""
    place = F.struct(F.col(at).alias("at"), *fields)
    kind = slots.select(place.alias("x")).schema["x"].dataType
    rows = slots.withColumns({"_own": place, "side": F.lit(0)})
    # the slot before: the last one up to the slot, seen by a row that stands just in front of it
    ahead = slots.withColumns({"_own": F.lit(None).cast(kind), "side": F.lit(-1)})
    out = swept(rows.unionByName(ahead), keys, at, ["_own"])
    prev = out.where("side = -1").select(*keys, at, F.col("_own_low").alias("prev"))
    nxt = out.where("side = 0").select(*slots.columns, F.col("_own_high").alias("next"))
    p = prev.withColumnsRenamed({k: f"_q{i}" for i, k in enumerate([*keys, at])}).hint("merge")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_q{i}")) for i, k in enumerate([*keys, at])])
    return nxt.join(p, same).select(*slots.columns, "prev", "next")


def slot_windows(rows: DataFrame, slots: DataFrame, keys: Sequence[str], at: str, start: str, end: str, invited: str, level: float = 1.0, even: float = 2.0, apart: float = 3.0) -> DataFrame:
    """`rows` with slot_start and slot_end: the times of the nearest slot of the key (ties to the earlier), over two slots where a
    row takes two. slots: (keys, at, start, end), one row a place.

    An invited row takes the next slot too if there is one and the row isn't above its slot by more than `level`, else the slot
    before if there is one. Another row takes a neighbour (the earlier first) from which it is as far as from its slot, to less than `even`,
    if it is more than `apart` from its slot. Keys without slots give nulls."""
    place = F.struct(F.col(at).alias("at"), F.col(start).alias("s"), F.col(end).alias("e"), "prev", "next")
    around = _with_neighbours(slots.withColumns({"s": F.col(start), "e": F.col(end)}), keys, at, ["s", "e"])
    found = _left(swept(_stacked(rows, around, keys, at, {"_hit": place}), keys, at, ["_hit"]), rows, "_hit_low", "_hit_high")
    out = found.withColumn("_slot", _nearer(F.col(at), F.col("_hit_low"), F.col("_hit_high")))
    slot, y = F.col("_slot"), F.col(at)
    distance = F.abs(y - slot["at"])
    has, midway = lambda n: slot[n].isNotNull(), lambda n: slot[n].isNotNull() & (F.abs(distance - F.abs(y - slot[n]["at"])) < even) & (distance > apart)
    special = F.coalesce(F.col(invited), F.lit(False))
    forward = F.when(special, has("next") & (y >= slot["at"] - level)).otherwise(~midway("prev") & midway("next"))
    back = F.when(special, ~(has("next") & (y >= slot["at"] - level)) & has("prev")).otherwise(midway("prev"))
    return out.withColumns({"slot_start": F.when(back, slot["prev"]["s"]).otherwise(slot["s"]), "slot_end": F.when(forward, slot["next"]["e"]).otherwise(slot["e"])}).drop("_hit_low", "_hit_high", "_slot")


def event_times(rows: DataFrame, points: DataFrame, keys: Sequence[str], at: str, time: str, dash: str, above: float = 45.0, below: float = 8.0, reach: float = 45.0) -> DataFrame:
    """`rows` with start_time and end_time from the points (keys, at, time, dash) of its key, one a place; points without
    a time don't count.

    The start is the nearest dashed point within [at - above, at + below], else the nearest point there, else the nearest of all
    (ties to the earlier). A dashed start ends at the first point behind it, if that is within `reach`."""
    timed = points.where(F.col(time).isNotNull()).select(*keys, at, F.col(time).alias("t"), F.coalesce(F.col(dash), F.lit(False)).alias("d"))
    nexts = _with_neighbours(timed, keys, at, ["t", "d"]).drop("prev")
    place = F.struct(F.col(at).alias("at"), "t", "d", F.col("next.at").alias("next_at"), F.col("next.t").alias("next_t"))
    found = _left(swept(_stacked(rows, nexts, keys, at, {"_any": place, "_dash": F.when(F.col("d"), place)}), keys, at, ["_any", "_dash"]), rows, "_any_low", "_any_high", "_dash_low", "_dash_high")
    y = F.col(at)
    inside = lambda h: F.when((F.col(h)["at"] >= y - above) & (F.col(h)["at"] <= y + below), F.col(h))
    pick = lambda n, f: _nearer(y, f(f"{n}_low"), f(f"{n}_high"))
    out = found.withColumn("_start", F.coalesce(pick("_dash", inside), pick("_any", inside), pick("_any", F.col)))
    ends = F.when(F.col("_start.d") & (F.col("_start.next_at") <= F.col("_start.at") + reach), F.col("_start.next_t"))
    return out.withColumns({"start_time": F.col("_start.t"), "end_time": ends}).drop("_any_low", "_any_high", "_dash_low", "_dash_high", "_start")


def contained_in(parts: DataFrame, hosts: DataFrame, keys: Sequence[str], part_id: str, host_id: str) -> DataFrame:
    """Each part's smallest enclosing host of the same key: part [lo, hi] inside host [lo, hi], ties to the smaller id.

    A host of length n stands in the one or two buckets of 2^l >= n that it touches; a part looks up its `lo` in one bucket of
    each level that the key's hosts have, so only hosts that lie near it are compared, not all of its key."""
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0)))).cast("int"))
    bucket = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level")))
    h = hosts.where("lo <= hi").withColumn("_level", level).withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket("lo"), bucket("hi")))))
    h = h.select(*keys, "_level", "_bucket", host_id, F.col("lo").alias("h_lo"), F.col("hi").alias("h_hi"))
    levels = h.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    p = parts.join(hinted(levels), [*keys]).select(*keys, part_id, "lo", "hi", F.explode("_levels").alias("_level")).withColumn("_bucket", bucket("lo"))
    inside = (F.col("lo") >= F.col("h_lo")) & (F.col("hi") <= F.col("h_hi"))
    best = F.min_by(host_id, F.struct(F.col("h_hi") - F.col("h_lo"), F.col(host_id)))
    return p.join(h.hint("merge"), [*keys, "_level", "_bucket"]).where(inside).groupBy(part_id).agg(best.alias(host_id))


def line_hosts(rows: DataFrame, keys: Sequence[str], row_id: str, top: str, left: str, right: str, words: str, near: float = 2.0, far: float = 9.0, slack: float = 1.0) -> DataFrame:
    """(row_id, host_id): rows that are a part of another row of their page: more than `near` and less than `far` from it in
    `top`, inside its span from left to right (to `slack`), with fewer words. The nearest host, ties to the smaller id.

    Rows meet in strips of `far`: a row looks for hosts in its own strip and the two beside it."""
    strip = F.floor(F.col(top) / far)
    fields = {"id": row_id, "top": top, "left": left, "right": right, "words": words}
    host = rows.select(*keys, strip.alias("_strip"), F.struct(*[F.col(c).alias(n) for n, c in fields.items()]).alias("h"))
    part = rows.select(*keys, F.explode(F.array(strip - 1, strip, strip + 1)).alias("_strip"), F.struct(*[F.col(c).alias(n) for n, c in fields.items()]).alias("p"))
    away = F.abs(F.col("p.top") - F.col("h.top"))
    fits = (away > near) & (away < far) & (F.col("p.left") >= F.col("h.left") - slack) & (F.col("p.right") <= F.col("h.right") + slack) & (F.col("h.words") > F.col("p.words")) & (F.col("h.id") != F.col("p.id"))
    found = part.join(host.hint("merge"), [*keys, "_strip"]).where(fits)
    return found.groupBy(F.col("p.id").alias(row_id)).agg(F.min(F.struct(away.alias("away"), F.col("h.id").alias("id")))["id"].alias("host_id"))
