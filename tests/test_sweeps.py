"""Sweeps against loops, also with one key for all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rostrum.operators import sweeps


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("keys", [1, 5])
def test_sweeps_equal_loops(spark, keys):
    draw = random.Random(keys)
    key = lambda: draw.choice([None, *range(keys)]) if keys > 1 else 7
    left = [(i, key(), draw.choice([None, *range(60)])) for i in range(300)]
    right = sorted({(key(), draw.randint(0, 60)) for _ in range(60)}, key=repr)
    points = [(k, at, at * 3 if at % 7 else None, at % 3 == 0) for k, at in right]
    rows, marks = _frame(spark, left, "id int, k int, at int"), _frame(spark, [(k, at, at + 1000) for k, at in right], "k int, at int, v int")
    of = {k: sorted(at for q, at in right if q == k) for k in {q for q, _ in right}}
    before = {i: max((x for x in of.get(k, []) if at is not None and x <= at), default=None) for i, k, at in left}
    assert {r.id: r.matched_at for r in sweeps.as_of(rows, marks, ["k"], "at", "v").collect()} == before
    assert {r.id: r.matched for r in sweeps.as_of(rows, marks, ["k"], "at", "v", F.lit(2)).collect()} == {i: x + 1000 if x is not None and at - x <= 2 else None for (i, _, at), x in zip(left, before.values())}
    near = {i: min((x for x in of.get(k, [])), key=lambda x: (abs(x - at), x), default=None) for i, k, at in left if at is not None}
    assert {r.id: r.matched_at for r in sweeps.nearest(rows.where("at is not null"), marks, ["k"], "at", "v").collect()} == near
    after = {i: min((x for x in of.get(k, []) if at is not None and x > at), default=None) for i, k, at in left}
    assert {r.id: r.next_at for r in sweeps.next_after(rows, marks, ["k"], "at").collect()} == after

    def times(k, y):
        timed = [(at, t, dash) for q, at, t, dash in points if q == k and t is not None]
        if not timed:
            return None, None
        window = [p for p in timed if y - 9 <= p[0] <= y + 4]
        start = min([p for p in window if p[2]] or window or timed, key=lambda p: (abs(p[0] - y), p[0]))
        later = sorted(p for p in timed if start[0] < p[0] <= start[0] + 5)
        nxt = sorted(p for p in timed if p[0] > start[0])[:1]
        return start[1], (nxt[0][1] if start[2] and later else None)

    got = sweeps.event_times(rows.where("at is not null"), _frame(spark, points, "k int, at int, t int, dash boolean"), ["k"], "at", "t", "dash", 9, 4, 5)
    assert {r.id: (r.start_time, r.end_time) for r in got.collect()} == {i: times(k, at) for i, k, at in left if at is not None}


def test_one_key_is_shared_out(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.lit(1).alias("side"), F.when(F.col("id") % 1000 == 0, F.struct(F.col("id").alias("at"))).alias("h"))
    out = sweeps.swept(rows.unionByName(rows.withColumn("at", F.lit(5).cast("long")).withColumn("h", F.lit(None).cast("struct<at:bigint>"))), ["k"], "at", ["h"])
    assert out.where("at > 0 AND h_low.at != at - at % 1000").count() == 0 and out.count() == 80_000
    files = spark.conf.get("spark.checkpoint.dir")
    latest = max((p for p in __import__("pathlib").Path(files.removeprefix("file://")).glob("stretches-*")), key=lambda p: p.stat().st_mtime)
    sizes = [r.n for r in spark.read.parquet(str(latest)).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 80_000 / 4


def test_slots_by_hand(spark):
    slots = _frame(spark, [("p", 10, "a", "b"), ("p", 20, "c", "d"), ("p", 31, "e", "f")], "k string, at int, s string, e string")
    rows = _frame(spark, [(1, "p", 11, False), (2, "p", 15, False), (3, "p", 10, True), (4, "p", 31, True), (5, "p", 18, True), (6, "p", 25, None), (7, "q", 3, False), (8, "p", 99, False)], "id int, k string, at int, inv boolean")
    got = {r.id: (r.slot_start, r.slot_end) for r in sweeps.slot_windows(rows, slots, ["k"], "at", "s", "e", "inv").collect()}
    assert got == {1: ("a", "b"), 2: ("a", "d"), 3: ("a", "d"), 4: ("c", "f"), 5: ("a", "d"), 6: ("c", "f"), 7: (None, None), 8: ("e", "f")}


@pytest.mark.parametrize("seed", [1, 2])
def test_hosts_equal_loops(spark, seed):
    draw = random.Random(seed)
    span = lambda n: (lo := draw.randint(-50, 300), lo + draw.choice([0, 1, 3, 7, 8, 9, 40, 200, n]))
    parts, hosts = [(i, draw.randint(0, 1), *span(2)) for i in range(150)], [(i, draw.randint(0, 1), *span(500)) for i in range(150)]
    want = {}
    for i, k, lo, hi in parts:
        found = [(h - g, j) for j, q, g, h in hosts if q == k and g <= lo and hi <= h]
        if found:
            want[i] = min(found)[1]
    frame = lambda rows, n: _frame(spark, rows, f"{n} int, k int, lo int, hi int")
    assert {r.p: r.h for r in sweeps.contained_in(frame(parts, "p"), frame(hosts, "h"), ["k"], "p", "h").collect()} == want
    plan = sweeps.contained_in(frame(parts, "p"), frame(hosts, "h"), ["k"], "p", "h")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_ranges_grow_in_number_with_the_table(spark, monkeypatch):
    from rostrum.operators import shared

    monkeypatch.setattr(shared, "RANGE_ROWS", 10)
    assert shared.ranges_of(spark.range(200)) == 20
    assert shared.ranges_of(spark.range(5)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
