"""Nested affiliations, person suggestions and name repair by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import people, search

TALK = "id int, authors array<struct<name:string,insts:array<int>>>, institutions array<struct<n:int,name:string,alt_names:array<string>>>, inst_shorts array<string>, speaker string, speaker_aff string"


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_backfilled_affiliations_are_mirrored(spark):
    home = [(3, "Home Lab", None), (7, "Away", [])]
    rows = [
        (1, [("Ann Lee", [3])], home, ["Home", "Away"], "Ann Lee", "Home"),
        (2, [("A. Lee", []), ("Bo", [7])], home, [" Home ", "Away"], "Ann Lee", ""),  # the talk has it: its number is used again
        (3, [("Bo", [7]), ("Ann Lee", None)], [(7, "Away", None)], ["Away"], "Ann Lee", None),  # a new number, 8
        (4, [("Ann Lee", [7])], home, ["Home", "Away"], "Ann Lee", " "),  # has one of its own: only the affiliation
        (5, None, None, None, "Ann Lee", ""),  # no author, nothing there
        (6, [("Cy", [])], [], [], "Cy", ""),  # no vote
        (7, [("Ann Lee", [3])], home, ["Home", "Away"], None, ""),
        (8, [("Ann Lee", [3, 99])], home, ["Home", "Away"], "", "kept"),
    ]
    got = {r.id: r for r in people.backfill_speakers(spark.createDataFrame(rows, TALK)).collect()}
    assert {i: r.speaker_aff for i, r in got.items()} == {1: "Home", 2: "Home", 3: "Home", 4: "Home", 5: "Home", 6: "", 7: "", 8: "kept"}
    assert got[2].authors[0].insts == [3] and len(got[2].institutions) == 2
    assert got[3].authors[1].insts == [8] and tuple(got[3].institutions[1]) == (8, "Home", []) and got[3].inst_shorts == ["Away", "Home"]
    assert got[4].authors[0].insts == [7] and len(got[4].institutions) == 2
    assert [i.n for i in got[5].institutions] == [1] and got[5].authors == [] and got[6].institutions == []
    assert people.backfill_speakers(spark.createDataFrame([], TALK)).count() == 0


def test_a_tied_vote_fills_nothing(spark):
    two = [(1, "X", None), (2, "Y", None)]
    rows = [(1, [("Ann Lee", [1, 2])], two, ["X", "Y"], None, None), (2, [("Ann Lee", [])], [], [], "Ann Lee", "")]
    assert {r.id: r.speaker_aff for r in people.backfill_speakers(spark.createDataFrame(rows, TALK)).collect()} == {1: None, 2: ""}


def test_institutions_are_renumbered(spark):
    rows = [(1, [("A", [9, 4, 77]), ("B", [5, 6]), ("C", None)], [(4, "X", None), (9, "X again", None), (5, "", None), (6, "none", None)], ["X", "X ", "", None], None, None)]
    df = spark.createDataFrame(rows, TALK)
    got = people.renumber_institutions(df.withColumn("may", F.lit(True)), "may").first()
    assert [tuple(a) for a in got.authors] == [("A", [1]), ("B", [2, 3]), ("C", None)] and [(i.n, i.name) for i in got.institutions] == [(1, "X"), (2, ""), (3, "none")]
    same = people.renumber_institutions(df.withColumn("may", F.lit(None).cast("boolean")), "may").first()
    assert [i.n for i in same.institutions] == [4, 9, 5, 6]


def test_people_are_suggested(spark):
    names = ["Stina A. A. Dillmark", "Wen Ho", "Wila Ho", "Hoang Li", "Doris Burgmann", "Fedora Capanna", "Ilona-Kristin Bente-Chalmer", "Sumak", "Ho", " ", None]
    wanted = {
        "Stina Dillmark": {("Stina A. A. Dillmark", 1)},
        "W. Ho": {("Wen Ho", 1), ("Wila Ho", 1), ("Ho", 1)},
        "Wen Ho": {("Wen Ho", 1), ("Ho", 1)},
        "Ho": {("Wen Ho", 1), ("Wila Ho", 1), ("Ho", 1)},
        "Capan": {("Fedora Capanna", 1)},
        "Doris B": {("Doris Burgmann", 2)},
        "BAO S": set(),
        "fed": {("Fedora Capanna", 3)},
        "kristin": {("Ilona-Kristin Bente-Chalmer", 3)},
        "kristin-": set(),
        "bente-ch": {("Ilona-Kristin Bente-Chalmer", 1)},
        "hoa": {("Hoang Li", 3)},
        "xy": set(),
    }
    queries = spark.createDataFrame([(q,) for q in [*wanted, "", None]], "q string")
    found = search.suggest_people(queries, spark.createDataFrame([(n,) for n in names], "name string"), "q", "name").collect()
    got = {q: {(r.name, r["pass"]) for r in found if r.q == q} for q in wanted}
    assert got == wanted


@pytest.mark.parametrize(
    ("given", "want"),
    [("Doe, Jane", "Jane Doe"), ("Smith, Jr.", "Smith, Jr."), ("Smith, Ph.D.", "Smith, Ph.D."), ("Doe, Universität", "Doe, Universität"), ("A, B, C", "A, B, C"), ("Lee Wei, Wesley", "Lee Wei, Wesley"), ("O’Neil, Anaïs", "Anaïs O’Neil"), (None, None)],
)
def test_surname_first_is_turned_only_where_it_is_clear(spark, given, want):
    assert one(spark, T.given_first, given) == [want]


def test_shouted_names_of_any_alphabet(spark):
    names = ["JOSÉ GARCÍA", "SHAUN O’NEIL", "ŁUKASZ WRZESIŃSKI", "J.-P. ÉMILE", "ANNA DE LA CRUZ", "Van MIT", "R2 UNIT", "ABC", "J.K. ROE"]
    assert one(spark, T.repaired_name, *names) == ["José García", "Shaun O’Neil", "Łukasz Wrzesiński", "J.-P. Émile", "Anna de la Cruz", "Van Mit", "R2 UNIT", "Abc", "J.K. Roe"]


def _one_by_one(name):
    """The rule of `repaired_name` by a loop, for letters A-Z and a-z."""
    pieces = " ".join(name.split()).split(" ")
    if len(pieces) > 6 or any(x.isdigit() for x in name):
        return name

    def piece(i, p):
        if 0 < i < len(pieces) - 1 and p.lower() in T.PARTICLES:
            return p.lower()
        return p.capitalize() if len(p) > 2 and p.isupper() and p.isalpha() and set(p) & set("AEIOUY") else p

    return " ".join(piece(i, p) for i, p in enumerate(pieces))


def test_names_are_split_once_and_plain_ones_need_no_pattern_for_a_piece(spark):
    words = ["VAN", "DE", "ANN", "BCD", "YVY", "AB", "Z", "Lee", "van", "BERG", "DEL", "R2D"]
    names = [" ".join(words[(k * j + k // 7) % len(words)] for j in range(1, k % 9)) for k in range(400)]
    names += ["ANN  BERG", " ANN BERG", "ANN BERG ", "ANN\n", "ANN\nDE BERG", "DE", "DE LA", "ANN DE", " ", "A" * 3000]
    assert one(spark, T.repaired_name, *names) == [_one_by_one(x) for x in names]
    assert one(spark, T.repaired_name, None) == [None]
    plan = spark.createDataFrame([("x",)], "v string").select(T.repaired_name(F.col("v")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(v#") == 1


def test_people_of_frequent_names_in_parts(spark):
    rows = lambda n, forms, i: spark.createDataFrame([(k, forms[k % len(forms)]) for k in range(n)], f"{i} int, name string")
    left, right = rows(60, ["Ada Lee", "A. Lee", "Bo Lee", "Lee", "Bo Ray", None, " "], "i"), rows(45, ["Lee, Ada", "B. Lee", "Lee, Ada Bea", "Ray", ""], "j")
    person = lambda df: df.select("*", T.person(F.col("name")).alias("p")).where("p.surname != ''")
    a, b = person(left).alias("a"), person(right).alias("b")
    both = a.join(b, F.col("a.p.surname") == F.col("b.p.surname")).where(T.consistent_given(F.col("a.p.given"), F.col("b.p.given")))
    want = sorted(map(tuple, both.select("i", "j").collect()))
    for most in (3, 40, people.PART_PAIRS):
        assert sorted(map(tuple, people.match_people(left, right, "i", "j", "name", most).collect())) == want


def test_talks_of_one_speaker_stay_spread_over_tasks(spark):
    schema = "k int, authors array<struct<name:string,insts:array<int>>>, institutions array<struct<n:int,name:string,alt_names:array<string>>>, inst_shorts array<string>, speaker string, speaker_aff string"
    rows = [(k, [("Ada Lov", [1] if k % 2 else [])], [(1, "Place", [])], ["P"], "A. Lov" if k % 3 else None, "") for k in range(200)]
    out = people.backfill_speakers(spark.createDataFrame(rows, schema).repartition(4, "k"))
    got = out.select("*", F.spark_partition_id().alias("part")).collect()
    assert {r.k: r.speaker_aff for r in got} == {k: "P" if k % 3 else "" for k in range(200)}
    assert len({r.part for r in got if r.speaker}) > 1 and len({r.part for r in got if not r.speaker}) > 1
