"""Title matches against loops."""

from __future__ import annotations

import difflib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rostrum.operators import matching, titles
from rostrum.plans import title_queries


def _greedy(pairs):
    out, i, j = {}, set(), set()
    for score, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if a not in i and b not in j:
            out[a] = (b, score)
            i.add(a)
            j.add(b)
    return out


def _plain_assign(left, right, least=0.5):
    """left, right: {id: form} of one block."""
    got = _greedy([(r, a, b) for a, x in left.items() for b, y in right.items() if (r := difflib.SequenceMatcher(None, x, y).ratio()) >= least])
    rest = [sorted(set(left) - set(got)), sorted(set(right) - {b for b, _ in got.values()})]
    return got | ({a: (b, None) for a, b in zip(*rest)} if len(rest[0]) == len(rest[1]) else {})


def _blocks(rows, key):
    out = defaultdict(dict)
    for r in rows:
        out[r[0]][r[1]] = r[2]
    return out


def test_title_blocks_equal_a_loop(spark, folder):
    talks, entries = title_queries._sides(spark, folder)
    form = titles.title_form(F.coalesce("title", F.lit("")))
    left, right = _blocks(talks.select("session", "talk", form).collect(), 0), _blocks(entries.select("session", "entry", form).collect(), 0)
    want = {(s, a, b, None if r is None else round(r, 6)) for s in left for a, (b, r) in _plain_assign(left[s], right.get(s, {})).items()}
    assert {tuple(r) for r in title_queries.j10(spark, folder).collect()} == want
    assert any(r[3] is None for r in want) and len({r[3] for r in want}) > 20


def test_titles_awkward(spark):
    left = spark.createDataFrame([("s", 1, "Long Title of a Talk"), ("s", 2, None), ("s", 3, "zzz"), (None, 4, "Long Title"), ("t", 5, "only here")], "b string, i int, title string")
    right = spark.createDataFrame([("s", 7, "A talk: long title"), ("s", 8, ""), ("s", 9, "qqq"), (None, 6, "Long Title"), ("u", 5, "only there")], "b string, j int, title string")
    got = {(r.b, r.i): (r.j, r.score) for r in titles.assign_titles(left, right, "b", "i", "j", "title").collect()}
    assert set(got) == {("s", 1), ("s", 2), ("s", 3)} and got["s", 2] == (8, 1.0) and got["s", 3] == (9, None) and got["s", 1][0] == 7
    assert titles.assign_titles(left.where("1 = 0"), right, "b", "i", "j", "title").count() == 0


def test_claims_equal_a_loop(spark, folder):
    talks, _ = title_queries._sides(spark, folder)
    start = {(r.session, r.talk): r.start for r in talks.collect()}
    scores = defaultdict(list)
    for r in title_queries.j11_scores(spark, folder).collect():
        scores[r.session, r.talk].append((-r.score, r.entry))
    used, want = set(), set()
    for (session, talk), found in sorted(scores.items(), key=lambda x: (x[0][0], start[x[0]], x[0][1])):
        free = sorted(f for f in found if (session, f[1]) not in used)
        if free:
            used.add((session, free[0][1]))
            want.add((session, talk, free[0][1], -free[0][0]))
    assert {tuple(r) for r in title_queries.j11_claims(spark, folder).collect()} == want and want


def test_presenter_scores_by_hand(spark):
    talks = [("s", 1, "Deep Risk Models", "Ann Lee"), ("s", 2, "Deep risk-models!", None), ("s", 3, "a b c d e f g h", ""), ("s", 4, "a b c d", None), ("s", 5, " ", "Ann Lee"), ("z", 6, "Deep Risk Models", None)]
    entries = [("s", 1, "Deep Risk Models", ["X"]), ("s", 2, "Other", ["Prof. Ann Lee", None]), ("s", 3, "a b c d e f g", None), ("s", 4, "a b c x", ["Q"]), ("s", 5, "", ["Ann Lee"])]
    left, right = spark.createDataFrame(talks, "b string, i int, title string, speaker string"), spark.createDataFrame(entries, "b string, j int, title string, speakers array<string>")
    got = {(r.i, r.j): round(r.score, 4) for r in titles.presenter_scores(left, right, "b", "i", "j").collect()}
    assert got == {(1, 1): 1.0, (2, 1): 1.0, (1, 2): 0.72, (3, 3): 1.0}


@pytest.mark.parametrize("seed", [1, 2])
def test_word_sets_equal_a_loop(spark, seed):
    draw = random.Random(seed)
    make = lambda n: [(i, draw.sample("abcdefghij", draw.randint(0, 5))) for i in range(n)]
    left, right = make(120), make(80)
    want = {}
    for i, w in left:
        found = [(set(w) == set(v), len(set(w) & set(v)), -j) for j, v in right if w and v and (set(w) == set(v) or ((set(w) <= set(v) or set(v) <= set(w)) and min(len(w), len(v)) >= 2))]
        if found:
            equal, shared, j = max(found)
            want[i] = (-j, shared, equal)
    frame = lambda rows, i: spark.createDataFrame(rows, f"{i} int, words array<string>")
    got = titles.word_set_matches(frame(left, "i"), frame(right, "j"), "i", "j", "words").collect()
    assert {r.i: (r.j, r.shared, r.equal) for r in got} == want and len(got) == len(want)


def test_word_sets_go_by_number_where_words_are_exploded(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"])], "i int, words array<string>")
    out = titles.word_set_matches(rows, rows.withColumnRenamed("i", "j"), "i", "j", "words")
    assert sorted(map(tuple, out.collect())) == [(1, 1, 3, True), (2, 2, 2, True)]
    exploded = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode(" in x]
    assert exploded and all(re.search(r"explode\(\w+#\d+\), \[\d+\]", x) for x in exploded)  # the array is dropped there


def test_lines_of_one_key_count_by_their_smallest_forms(spark, tmp_path):
    import duckdb

    part = [(p, f"hot bolt {p}", "BIG", "Brand#1") for p in range(12)]
    twice = [(o, p, s, 1, 9.0, None) for o in range(40) for p in (5, 4) for s in ((3 + o, 5) if o % 2 else (5, 3 + o))]
    con = duckdb.connect()
    for name, rows, schema in (("part", part, "p_partkey long, p_name string, p_type string, p_brand string"), ("lineitem", twice, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as from '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in title_queries.j11_scores(spark, str(tmp_path)).select("session", "talk", "entry", "score").collect())
    want = sorted(con.execute(title_queries._SCORES).fetchall())
    assert got == want and want


def test_titles_are_measured_only_while_both_rows_are_free(monkeypatch):
    draw, count = random.Random(3), [0]

    class Counted(difflib.SequenceMatcher):
        def ratio(self):
            count[0] += 1
            return super().ratio()

    every = 0
    for _ in range(300):
        a, b = ([" ".join(draw.choices(["hot", "bolt", "ring", "", "blue", "hot bolt"], k=draw.randint(0, 5))) for _ in range(draw.randint(1, 6))] for _ in "ab")
        want = {(i, j, r) for i, (j, r) in _plain_assign(dict(enumerate(a)), dict(enumerate(b))).items()}
        with monkeypatch.context() as m:
            m.setattr(titles.difflib, "SequenceMatcher", Counted)
            assert set(titles._assigned(a, b, 0.5)) == want
        every += len(a) * len(b)
    assert count[0] < every / 2


def test_large_blocks_equal_small_ones(spark, folder, monkeypatch):
    names = ("j10", "j11_scores", "j11_claims")
    want = [sorted(map(tuple, getattr(title_queries, n)(spark, folder).collect()), key=repr) for n in names]
    monkeypatch.setattr(matching, "GROUP_PAIRS", 20)
    assert [sorted(map(tuple, getattr(title_queries, n)(spark, folder).collect()), key=repr) for n in names] == want


def test_significant_words(spark):
    row = spark.createDataFrame([("The 3rd SESSION: a b2, on monday 7 x Würz",), (None,)], "t string").select(titles.significant_words(F.col("t")).alias("w")).collect()
    assert [r.w for r in row] == [["3rd", "b2", "7", "rz"], []]


@pytest.mark.parametrize(("n", "block", "most"), [(1000, None, 4000), (1000, "b", 4000), (6, None, 3), (6, "b", 3)])
def test_a_chain_of_falling_scores(spark, monkeypatch, n, block, most):
    monkeypatch.setattr(matching, "GROUP_PAIRS", most)
    pairs = [(None if i % 7 else 1, i, j, 1.0 - (2 * i + (j - i)) / 10_000) for i in range(n) for j in (i, i + 1) if j < n]
    got = matching.assign_once(spark.createDataFrame(pairs, "b int, i int, j int, score double"), block, "i", "j", "score").collect()
    if block is None:
        assert {(r.i, r.j) for r in got} == {(i, i) for i in range(n)}
    else:  # blocks with a null are one like any other
        left = {b: _greedy([(p[3], p[1], p[2]) for p in pairs if p[0] == b]) for b in (None, 1)}
        assert {(r.b, r.i, r.j) for r in got} == {(b, i, j) for b, found in left.items() for i, (j, _) in found.items()}
