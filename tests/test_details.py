"""Whole forms by hand: nulls, empty texts, ties and repeated rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import aggregates as A
from rostrum.operators import filters as P
from rostrum.operators import people
from rostrum.operators import windows as N
from rostrum.session import shared_folder
from rostrum.sources import program


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] and tuple(r[0]) for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_numbered_body(spark):
    got = one(spark, T.numbered_body, "12. A body. 3. x", " 1.\tB", "1.5 volts", "9999999999. far", "no", "", None, "3. ")
    assert got == [(12, "A body. 3. x"), (1, "B"), (None, "1.5 volts"), (None, "9999999999. far"), (None, "no"), (None, ""), (None, None), (None, "3.")]


def test_agenda_cell(spark):
    got = one(spark, T.agenda_cell, "AB1.2 • Talk,, Hall B ,", "Coffee Break ,Foyers", "Lunch, TBA", "Plain", "AB1 •", "", None, "A•B, c, d")
    assert got == [("AB1.2", "Talk", "Hall B"), (None, "Coffee Break", "Foyers"), (None, "Lunch", None), (None, "Plain", None), (None, "AB1 •", None), (None, "", None), (None, None, None), ("A", "B", "c, d")]


def test_venue_and_prose(spark):
    got = one(
        spark,
        T.venue_and_prose,
        "Dinner is at the  St. Ann Jr. Ballroom, from 18:00 - 21:00. Bring a friend! All welcome.",
        "Meet in the hall at noon.\n\nLunch 12:30.\n\nThen  rest?\nSleep.",
        "12:00 in the Lobby",
        "We sat at the Big Hallway.",
        "",
        None,
    )
    assert got == [("St. Ann Jr. Ballroom", "Dinner is at the St. Ann Jr. Bring a friend! All welcome."), (None, "Meet in the hall at noon.\n\nThen rest? Sleep."), ("Lobby", ""), (None, "We sat at the Big Hallway."), (None, ""), (None, None)]


def test_chosen_speaker(spark):
    rows = [("José Wu", None, "J. Wu", ["Ann", "JOSE  WU"]), ("J.", "x", "Jon", ["jon"]), (" ", "Bo Lee; y", None, ["Al", "Bo Lee", "bo lee"]), (None, "", "Al", None), (None, None, "", ["Al", None]), (None, None, None, []), (None, "; y", None, [None])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, u string, p string, a array<string>")
    got = [tuple(r[0]) for r in df.orderBy("i").select(people.chosen_speaker(*map(F.col, "supa"))).collect()]
    assert got == [("José Wu", "fuller", 1), ("J.", "scraped", -1), ("Bo Lee", "underlined", 1), ("Al", "presenter", -1), ("Al", "first", 0), (None, None, -1), (None, None, -1)]
    counted = A.counters(df, {"scraped": F.col("s") != " ", "none": F.lit(None).cast("boolean")}).collect()
    assert [tuple(r) for r in counted] == [(7, 2, 0)]
    assert [tuple(r) for r in A.counters(df.where("false"), {"x": F.col("s") == ""}).collect()] == [(0, 0)]


def test_overrides(spark):
    path = f"{shared_folder(spark)}/o-{uuid.uuid4().hex}"
    lines = ["# surname\tinitial\taff", "", "Lee\ta\tX ", " Lee\tB\tY", "Lee\tB\tZ", "Wu\t\tnone", "Wu\tC", "O'Neil\tj\t\"Q\" lab"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    overrides = people.read_overrides(spark, path)
    assert sorted(map(tuple, overrides.collect())) == [("Lee", "A", "X"), ("Lee", "B", "Y"), ("O'Neil", "J", '"Q" lab')]
    rows = [("Ann Lee", "a"), ("Lee, Bob", "b"), ("Cy Wu", "c"), ("j. K. O'Neil", None), (None, "n"), ("", "e"), ("Lee", "own")]
    df = spark.createDataFrame([(i, n, v, "s") for i, (n, v) in enumerate(rows)], "i int, n string, aff string, surname string")
    out = people.overridden(df, "n", "aff", overrides)
    assert out.columns == df.columns
    assert [r["aff"] for r in out.orderBy("i").collect()] == ["X", "Y", "c", '"Q" lab', "n", "e", "own"]


def test_union_facets(spark):
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "c string")
    kinds = lambda *xs: spark.createDataFrame(xs, "id string, label string, ord int")
    first, second = kinds(("b", "B", 5), ("neutral", "N", 7), ("u", "U", 9)), kinds(("x", "X", 2), ("a", "A", 2), ("b", "other", 1))
    got = A.union_facets([(rows("b", None, "b", "lost"), "c", first), (rows("b", "a", None, "x"), "c", second)]).collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == [("b", "B", 1, 3), ("neutral", "N", 2, 2), ("a", "A", 4, 1), ("x", "X", 5, 1)]
    assert A.union_facets([(rows("b").where("false"), "c", first)]).count() == 0


def test_renumber_all(spark):
    items = spark.createDataFrame([(1, 10, 0), (1, 20, 1), (1, 30, 2), (1, 40, 3), (2, 5, 0), (None, 5, 0)], "p int, n int, at int")
    refs = spark.createDataFrame([(1, 30, 0, 0), (1, 10, 0, 1), (1, 30, 1, 0), (1, 99, 2, 0), (3, 1, 0, 0), (None, 5, 0, 0)], "p int, n int, a int, b int")
    got = {(r["p"], r["n"]): r["new_number"] for r in N.renumber_all(items, refs, "p", "n", ["a", "b"], "at").collect()}
    assert got == {(1, 30): 1, (1, 10): 2, (1, 20): 3, (1, 40): 4, (2, 5): 1, (None, 5): 1}
    assert N.renumber_all(items, refs.where("false"), "p", "n", ["a", "b"], "at").where("p = 1").orderBy("new_number").select("n").collect()[0][0] == 10


def test_compact_place(spark):
    rows = [("s", "o", "ps", "p"), ("", "", "ps", "p"), (None, None, "", "p"), (None, None, None, None), (None, "o", "ps", "p"), ("", None, "ps", "p")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string, d string")
    assert [r[0] for r in df.orderBy("i").select(P.compact_place(*map(F.col, "abcd"))).collect()] == ["s", "", "p", "", "o", "ps"]


def test_speaker_affiliation(spark):
    a, b = [("Ann", [1, 2]), ("Bo", [2])], [("Ann", []), ("Bo", [3, 2])]
    rows = [("ANN ", a), ("Bo", a), ("ann", b), ("Nobody", b), ("bo", [("Ann", [2]), ("Bo", [])]), ("x", [("Ann", None), ("Bo", None)]), (None, None), ("Ann", [("Ann", [9]), (None, [2])]), ("Ann", [])]
    df = spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(rows)], "i int, s string, a array<struct<name:string,insts:array<int>>>")
    places = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("short")) for n, s in ((5, "Main"), (1, "One"), (2, "Two"))])
    assert [r[0] for r in df.orderBy("i").select(people.speaker_affiliation(F.col("s"), F.col("a"), places)).collect()] == ["Two", "Two", "Two", "Two", "Main", "Main", "Main", "Two", "Main"]
    none = F.lit(None).cast("array<struct<n:int,short:string>>")
    assert {r[0] for r in df.select(people.speaker_affiliation(F.col("s"), F.col("a"), none)).collect()} == {None}


def test_full_notes_report(spark):
    items = spark.createDataFrame([(1, "t1", 5, "Title", [" Ann  Wu ", "", None, "Bo"], "ann wu"), (1, "t2", 3, None, None, None), (1, "t3", None, "Late", [], ""), (2, "t1", 1, "x", ["A"], None), (3, "t9", 1, "x", ["A"], None)], "o int, id string, at int, title string, authors array<string>, s string")
    notes = spark.createDataFrame([(1, "t1", " a\nb \n"), (1, "t2", "c"), (1, "t3", "d"), (1, None, "g1"), (1, "zz", "lost"), (2, "t1", " \n"), (2, "t1", None), (4, None, "only")], "o int, id string, n string")
    got = {r["o"]: r["report"] for r in program.full_notes_report(items, notes, "o", "id", "at", "title", "authors", "s", "n").collect()}
    assert got[1] == "General notes\n  g1\n\nt2, (untitled)\n  c\n\nt1, Title, Ann  Wu*; Bo\n  a\n  b\n\nt3, Late\n  d\n"
    assert got[2] == got[3] == "(No notes yet.)" and got[4] == "General notes\n  only\n" and len(got) == 4
