"""Operators on small tables: documented examples, edge cases, properties and plans."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import aggregates, matching, people, search, state, windows
from rostrum.sources import program
from rostrum.streaming import state as streaming


def one(spark, column, *values):
    """The column function over single values."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_fold(spark):
    assert one(spark, T.fold, "Łódź Straße", "ÆØŒ þing", None, "") == ["lodz strasse", "aeooe thing", None, ""]


@pytest.mark.parametrize("f", [T.fold, T.squeezed, T.clean_title, T.tidy_location, T.repaired_name])
def test_idempotent(spark, f):
    values = ("  Dr. JOHN  van DER Berg ", "A ((B)) )", "Ünï  x.", "9 um laser", "", "&amp;lt;")
    once = one(spark, f, *values)
    skip = {"&amp;lt;"} if f is T.clean_title else set()  # an entity of an entity decodes once a pass
    assert [a for v, a in zip(values, one(spark, f, *once)) if v not in skip] == [a for v, a in zip(values, once) if v not in skip]


def test_titles(spark):
    assert one(spark, T.clean_title, "A &lt;b&gt; title.", "Wait...", "at 9 um​ (") == ["A <b> title", "Wait...", "at 9μm"]
    assert one(spark, T.is_shouting, "ALL CAPS", "No caps", "A", None) == [True, False, False, False]


def test_names(spark):
    assert one(spark, T.repaired_name, "MARIA DE LA CRUZ", "J. SMITH", "JEAN-LUC PICARD") == ["Maria de la Cruz", "J. Smith", "Jean-Luc Picard"]
    assert one(spark, T.given_first, "Berg, Ann", "van den Berg, Ann", "Ann Berg") == ["Ann Berg", "van den Berg, Ann", "Ann Berg"]
    assert one(spark, T.surname_initial, "Müller, Ann", "Ann Müller") == ["muller|a"] * 2
    assert one(spark, T.abbreviated, "Ann Bea van Berg", "Ann") == ["A. B. van Berg", "Ann"]


def test_split_outside(spark):
    assert one(spark, T.split_outside, "a (b; c); d", "x") == [["a (b; c)", "d"], ["x"]]


def test_clock(spark):
    assert one(spark, T.clock_minutes, "12:05 AM", "12:05 PM", "9:30 PM", "soon") == [5, 725, 1290, None]


def test_edit_distance_join_equals_brute_force(spark):
    words = ["", "a", "ab", "abc", "abcd", "bcd", "acbd", "xabcdefgh", "abcdefghx", "abcdefgh", "abXdefgh", "hgfedcba", "kitten", "sitting", "mitten"]
    left = spark.createDataFrame([(w,) for w in words + [None]], "a string")
    right = spark.createDataFrame([(w,) for w in words], "b string")
    for k in (1, 2, 3):
        got = {(r.a, r.b) for r in matching.edit_distance_join(left, right, "a", "b", k).collect()}
        want = {(r.a, r.b) for r in left.crossJoin(right).where(F.levenshtein("a", "b") <= k).collect()}
        assert got == want


def test_rules_first_wins_and_tiers(spark):
    rules = spark.createDataFrame([(2, "uni", False, "late"), (1, "^univ", True, "early")], "rule_id int, needle string, is_regex boolean, short string")
    texts = spark.createDataFrame([("university",), ("a unit",), ("none",), (None,), ("none",)], "t string")
    got = {r.t: (r.short, r.tier) for r in matching.resolve_labels(texts, [rules], "t", F.col("t")).collect()}
    assert got == {"university": ("early", 0), "a unit": ("late", 0), "none": ("none", None)}


def test_as_of_and_nearest(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 0, 2), ("z", 5, 3)], "k string, at int, id int")
    right = spark.createDataFrame([("k", 3, "c"), ("k", 7, "g"), ("k", 5, "e")], "k string, at int, v string")
    assert {r.id: r.matched for r in matching.as_of(left, right, ["k"], "at", "v").collect()} == {1: "e", 2: None, 3: None}
    assert {r.id: r.matched for r in matching.nearest(left.withColumn("at", F.col("at") + 1), right, ["k"], "at", "v").collect()} == {1: "e", 2: "c", 3: None}


def test_mode_unless_tied(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", None)], "k string, v string")
    assert {r.k: r.v for r in people.mode_unless_tied(rows, ["k"], "v").collect()} == {"a": "x", "b": None}


def test_consolidation_keeps_case_apart(spark):
    labels = spark.createDataFrame([("Zürich",), ("Zurich",), ("Zurich",), ("ZURICH",)], "label string")
    got = {r.label: r.winner for r in aggregates.consolidate(labels, "label", F.lit(False)).collect()}
    assert got == {"Zürich": "Zurich", "Zurich": "Zurich", "ZURICH": "ZURICH"}


def test_merge_commutes_away_from_ties(spark):
    a = [("x", "add", 1), ("x", "del", 3), ("y", "add", 2)]
    b = [("x", "add", 2), ("y", "del", 1), ("z", "bad", 9)]
    rows = lambda own, other: spark.createDataFrame([(*r, 0, i) for i, r in enumerate(own)] + [(*r, 1, i) for i, r in enumerate(other)], "id string, op string, ts long, incoming int, seq long")
    merged = [sorted(map(tuple, state.last_write(rows(*p), ["id"]).collect())) for p in ((a, b), (b, a), (a + b, b))]
    assert merged[0] == merged[1] == merged[2] == [("x", "del", 3), ("y", "add", 2)]


def test_text_merge(spark):
    rows = lambda *r: spark.createDataFrame(r, "id int, t string")
    got = state.merge_texts(rows((1, "long"), (2, "same"), (3, "kept")), rows((1, "longer"), (2, "tied"), (3, "  ")), "id", "t")
    assert {r.id: r.t for r in got.collect()} == {1: "longer", 2: "same", 3: "kept"}


def test_anchored_differs_from_chained(spark):
    rows = spark.createDataFrame([("k", float(v)) for v in (0, 1, 2, 3)], "k string, v double")
    chained = windows.gap_clusters(rows, ["k"], "v", 1.0).select("cluster").distinct().count()
    assert (chained, windows.anchored_clusters(rows, ["k"], "v", 1.0).select("cluster").distinct().count()) == (1, 2)


def test_program_round_trip(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"conference_name": "c", "sessions": [{"id": "s1", "title": "t", "location": "", "talk_ids": ["x"]}, {"id": "s2"}], "talks": [{"id": "x", "authors": [{"name": "A", "insts": [1]}]}], "affiliation_sources": ["u"]}')
    parts = program.read_program(spark, str(tmp_path / "p.json"))
    assert [(r.id, r.location) for r in parts["sessions"].orderBy("pos").collect()] == [("s1", ""), ("s2", None)]
    assert parts["talks"].first().authors[0].insts == [1]
    program.write_program(parts["talks"], str(tmp_path / "out"), unused=["abstract"])
    again = spark.read.json(str(tmp_path / "out"))
    assert again.first().id == "x" and "abstract" not in again.columns and "status" not in again.columns


def test_csv_and_rules_and_map(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Id,Name\n1," Ann\nLee "\n')
    assert program.read_csv(spark, str(tmp_path / "a.csv")).first().asDict() == {"Id": "1", "Name": "Ann\nLee"}
    (tmp_path / "r.txt").write_text("# all\nabc # x\n\n d \n")
    assert [r.pattern for r in program.read_rules(spark, str(tmp_path / "r.txt")).collect()] == ["abc", "d"]
    program.write_map_tsv(spark.createDataFrame([("b\tx", "s"), ("a", "t")], "raw string, short string"), str(tmp_path / "m"))
    lines = [x for f in sorted(os.listdir(tmp_path / "m")) if f.startswith("part") for x in (tmp_path / "m" / f).read_text().splitlines()]
    assert lines == ["a\tt", "b x\ts"]


def test_inputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "talks_1.csv").write_text("x")
    found = program.files(spark, str(tmp_path / "in"))
    manifest = spark.createDataFrame([("talks_*.csv", True), ("rooms?.csv", True), ("extra.csv", False)], "pattern string, required boolean")
    assert [r.pattern for r in program.missing_inputs(manifest, found).collect()] == ["rooms?.csv"]
    before = program.fingerprint(found).first().digest
    (tmp_path / "in" / "talks_1.csv").write_text("y")
    assert before != program.fingerprint(program.files(spark, str(tmp_path / "in"))).first().digest


def test_stream_restarts(spark, tmp_path):
    schema = "id string, op string, ts long, incoming int, seq long"
    state_of = {}

    def keep(rows, batch):
        state_of.update({r.id: (r.op, r.ts) for r in rows.collect()})

    for part in ([("a", "add", 1, 0, 1), ("b", "add", 1, 0, 2)], [("a", "del", 2, 0, 3), ("b", "del", 0, 0, 4)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streaming.merge_stream(log, ["id"], str(tmp_path / "log"), keep).awaitTermination()
    assert state_of == {"a": ("del", 2), "b": ("add", 1)}


def test_native_plans_have_no_python_and_no_cartesian(spark, folder):
    from rostrum.plans import join_queries, registry, state_queries, table_queries, text_queries  # noqa: F401

    for name in ("f1_search_fold", "j9_edit_distance", "j17_as_of", "w3_run_segmentation", "a7_consolidate", "t1_last_write_wins"):
        plan = registry.queries()[name](spark, folder)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name


def greedy(rows):
    """The rows kept by one loop over (block, left, right, score) in the given order."""
    used, kept = set(), []
    for block, a, b, score in rows:
        if not {(block, "a", a), (block, "b", b)} & used:
            used |= {(block, "a", a), (block, "b", b)}
            kept.append((block, a, b, score))
    return sorted(kept, key=repr)


def test_one_to_one_matching_equals_a_greedy_loop(spark):
    import random

    draw = random.Random(5)
    pairs = sorted({(draw.choice(["x", "y", None]), draw.randrange(25), draw.randrange(12)): draw.randrange(6) / 4 for _ in range(300)}.items(), key=repr)
    rows = [(*p, s) for p, s in pairs]
    df = spark.createDataFrame([*rows, *rows[:5]], "block string, a int, b int, score double")
    plain = lambda got: sorted(map(tuple, got.collect()), key=repr)
    once = matching.assign_once(df, "block", "a", "b", "score")
    assert plain(once) == greedy(sorted(rows, key=lambda r: (-r[3], r[1], r[2]))) and once.columns == df.columns
    assert plain(matching.claim_in_order(df, "block", ["a"], "a", "b", "score")) == greedy(sorted(rows, key=lambda r: (r[1], -r[3], r[2])))
    assert matching.assign_once(df.where("1 = 0"), "block", "a", "b", "score").count() == 0
    assert "Python" not in once._jdf.queryExecution().toString() and "Pandas" not in once._jdf.queryExecution().toString()


def test_claims_take_one_item_for_each_document(spark, folder):
    from rostrum.plans import join_queries

    rows = [(None, r.documents_id, r.benchmark_id, r.score) for r in join_queries.j11(spark, folder).where("score >= 0.05").collect()]
    got = [(None, r.documents_id, r.benchmark_id, r.score) for r in join_queries.j11_claims(spark, folder).collect()]
    assert sorted(got, key=repr) == greedy(sorted(rows, key=lambda r: (r[1], -r[3], r[2])))
    assert len({r[1] for r in got}) == len(got)


def test_suggestion_pool_of_all_languages(spark, tmp_path):
    from rostrum.plans import registry, state_queries  # noqa: F401

    docs = [(1, "Straße Æther", "de", "Web"), (2, "strasse noch", "en", None), (3, "Niemand NOCH", None, "noch"), (4, None, "de", "web"), (5, "  ", "fr", "Press"), (6, "aether", "en", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.fold: r.display for r in registry.queries()["q5_suggestion_pools_all"](spark, str(tmp_path)).collect()}
    assert got == {"strasse": "Straße", "aether": "Æther", "noch": "noch", "niemand": "Niemand", "web": "Web", "press": "Press"}


def test_suggestion_pool_equals_a_loop_over_all_documents(spark, folder):
    from rostrum.plans import registry, state_queries  # noqa: F401

    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.explode(F.split("text", r"\s+")).alias("token")).where("token != ''").distinct()
    want = {}
    for r in sorted(rows.withColumn("fold", T.squeezed(T.fold(F.col("token")))).collect(), key=lambda r: (r.doc_id, r.token.encode())):
        if r.fold:
            want.setdefault(r.fold, r.token)
    for r in spark.read.parquet(f"{folder}/documents.parquet").where("source is not null").orderBy("doc_id").collect():
        want.setdefault(r.source.lower(), r.source)
    assert {r.fold: r.display for r in registry.queries()["q5_suggestion_pools_all"](spark, folder).collect()} == want


def test_every_shouted_line_is_recased(spark, tmp_path):
    from rostrum.plans import table_queries

    text = "a quiet line\nGREAT HALLS OF LIGHT\nquiet again\nSMALL ROOMS"
    spark.createDataFrame([(1, text, "en", "s", 60), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.line): r.title.lower() for r in table_queries.f5(spark, str(tmp_path)).collect()}
    assert got == {(1, 1): "great halls of light", (1, 3): "small rooms"}


def test_numbers_of_any_length_sort_by_value(spark):
    names = ["a12345678902", "a12345678901", "a1234567890", "a007", "a8", "b", "a10c2", "a10c10"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "s string").orderBy(search.natural_key(F.col("s"))).collect()]
    assert got == ["a007", "a8", "a10c2", "a10c10", "a1234567890", "a12345678901", "a12345678902", "b"]


def test_long_words_stay_whole(spark):
    word = "B" + "A" * 1499
    row = spark.createDataFrame([(word,)], "s string").select(T.repaired_name(F.col("s")).alias("n"), T.recased(F.col("s"), F.lit(None)).alias("t")).first()
    assert row.n == row.t == "B" + "a" * 1499


def test_batch_search_finds_what_contains_finds(spark):
    items = {1: "xab cdx and more", 2: "nothing", 3: "Ab  Cd", 4: "cab", 5: "one two three four", 6: "", 7: "a", 8: None, 9: "stone two threes"}
    asked = {1: "ab cd", 2: "ab", 3: "a", 4: "one two three", 5: "b", 6: "", 7: None, 8: "tone", 9: "two thre", 10: "one two three four"}
    frame = lambda rows, i: spark.createDataFrame(list(rows.items()), f"{i} long, text string")
    got = {tuple(r) for r in search.batch_search(frame(asked, "q"), frame(items, "i"), "q", "i", "text").collect()}
    plain = lambda t: " ".join((t or "").lower().split())
    assert got == {(q, i) for q, a in asked.items() for i, t in items.items() if plain(a) and plain(a) in plain(t)}


def test_rules_in_parts(spark, monkeypatch):
    rules = spark.createDataFrame([(i, f"w{i}", False, f"s{i}") for i in range(40)] + [(40, "w[0-9]", True, "any")], "rule_id long, needle string, is_regex boolean, short string")
    texts = spark.createDataFrame([("has w7 and w30",), ("w39 alone",), ("w99",), ("none",)], "t string")
    whole = {tuple(r) for r in matching.first_rule(texts, rules, "t").collect()}
    monkeypatch.setattr(matching, "MOST_RULES", 6)
    assert {tuple(r) for r in matching.first_rule(texts, rules, "t").collect()} == whole == {("has w7 and w30", 3, "s3"), ("w39 alone", 3, "s3"), ("w99", 9, "s9")}


def test_author_institutions_are_not_shuffled_by_region(spark, folder):
    from rostrum.plans import join_queries, registry  # noqa: F401

    plan = registry.queries()["j5_author_institutions"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_pools_take_null_positions_first_and_fold_each_value_once(spark):
    rows = [("Ab", 3), ("AB", 2), ("ab", None), ("Cd", 5), ("cD", 4), ("Cd", 6), (" ", 1), (None, 1)]
    found = search.pools(spark.createDataFrame(rows, "v string, p int"), "v", "p")
    assert {r.fold: r.display for r in found.collect()} == {"ab": "ab", "cd": "cD"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_small_side_of_word_overlap_and_few_queries_are_broadcast(spark):
    docs = spark.createDataFrame([(k, ["alpha", "beta", f"w{k}"]) for k in range(50)], "a int, words array<string>")
    items = spark.createDataFrame([(1, ["alpha", "beta", "x"])], "b int, words array<string>")
    for found in (matching.word_overlap(docs, items, "a", "b", "words"), matching.word_overlap(items, docs, "b", "a", "words", small="left")):
        assert {(r.a, r.b, r.shared) for r in found.collect()} == {(k, 1, 2) for k in range(50)}
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    names = spark.createDataFrame([("Ada Lovelace",), ("Bo Loren",)], "name string")
    asked = search.suggest_people(spark.createDataFrame([("a love",)], "q string"), names, "q", "name")
    assert [tuple(r) for r in asked.collect()] == [("a love", "Ada Lovelace", 1)]
    assert "SortMergeJoin" not in asked._jdf.queryExecution().executedPlan().toString()
