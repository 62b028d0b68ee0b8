"""Label rules, the fallback and the whole resolution against plain loops; needles against brute force."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import labels, matching, needles

NAMES = ["Meridia", "Ålborg Optics", "St. Ives", "Kö-Lab", "Saint-Élan"]
SHAPES = [
    "Department of Physics, {n} University, Rome, Italy",
    "{n}",
    "{n} (France)",
    "{n} – Germany",
    "Foundation for {n} Research (FNRX)",
    "{n} Photonics Co., Ltd.",
    "{n} GmbH & Co. KG",
    "Univ. of {n}",
    "Université de {n}",
    "Technische Universität {n}",
    "{n} State University, Fresno, CA, USA",
    "University of {n}, {n} at Troy, 12345, USA",
    "University College {n}",
    "Physics, School of Optics, {n} Institute of Technology, Troy",
    "The {n} (x (y)) Univ",
    "Universitätsklinikum {n}",
    "{n} Universitätsmedizin Berlin",
    "Università degli Studi di {n}",
    "U {n}, Natl. Lab",
    "Institute: {n} Center, Inc.",
    "A.C.",
    "({n})",
    "",
    " , ,",
    "Italy",
    "Key Laboratory of {n}, Beijing {n} University",
    "Foundation (USA)",
    "{n} - {n} (ABC)",
]


def _plain_rewrite(text, rules):
    """The rules one by one in Python, a round at a time."""
    text = text.strip(" ")
    for r in rules:
        if r.unless and re.search(r.unless, text):
            continue
        for _ in range(text.count(r.rounds) if r.rounds else 1):
            text = re.sub(r.pattern, lambda m: re.sub(r"\$(\d)", lambda d: m.group(int(d[1])) or "", r.replacement), text, flags=re.ASCII)
    return text.strip(" ")


def _plain_fallback(text):
    words = labels.Words()
    rules = {s: [r for r in labels.REWRITES if r.step == s] for s in range(1, 7)}
    m = re.match(r"^\s*([^,()]+?)\s*\(\s*([A-Z][A-Za-z0-9]*[A-Z](?:-[A-Z0-9]+)?)\s*\)\.?\s*$", text)
    if m and sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in m[2]) >= 3 and len(m[2]) < len(m[1]) and m[2].upper() not in {c.upper() for c in words.countries} and not re.search(r"\s[-–—]\s", m[1]):
        return m[2]
    every = [p.strip(" ") for p in _plain_rewrite(text, rules[1] + rules[5]).split(",")]
    parts = [p for p in every if p]
    while parts and (parts[-1] in words.tails or re.fullmatch("[0-9]{4,6}", parts[-1])):
        parts.pop()
    if len(parts) >= 2 and not re.search(words.institutions.replace("|(?i)", "|"), parts[-1]):
        parts.pop()
    while len(parts) > 1 and (re.search(words.units, parts[0]) or re.sub(r"\.+$", "", parts[0].lower()) in words.fields):
        parts.pop(0)
    part = _plain_rewrite(parts[0] if parts else every[0], rules[5] + rules[3] + rules[6])
    return part or _plain_rewrite(text, rules[1] + rules[6]) or text.strip(" ")


def _plain_polish(text):
    return _plain_rewrite(text, labels.REWRITES) or _plain_rewrite(text, [r for r in labels.REWRITES if r.step in (1, 6)]) or text.strip(" ")


@pytest.fixture(scope="module")
def fixture(spark):
    texts = sorted({s.format(n=n) for s in SHAPES for n in NAMES})
    return texts, spark.createDataFrame([(t,) for t in texts], "raw string").repartition(3)


def test_rules_equal_a_plain_loop(fixture):
    texts, df = fixture
    got = {r.raw: (r.polished, r.fallback) for r in df.select("raw", labels.polished_label(F.col("raw")).alias("polished"), labels.fallback_label(F.col("raw")).alias("fallback")).collect()}
    assert got == {t: (_plain_polish(t), _plain_fallback(t)) for t in texts}


def test_shapes_by_hand(spark):
    want = {
        "Department of Physics, Meridia University, Rome, Italy": "Meridia",
        "Foundation for Meridia Research (FNRX)": "FNRX",
        "Meridia Photonics Co., Ltd.": "Meridia Photonics",
        "Meridia GmbH & Co. KG": "Meridia",
        "Smith & Sons": "Smith & Sons",
        "Univ. of Meridia": "Meridia",
        "Technische Universität Meridia": "TU Meridia",
        "Université de Meridia": "Meridia",
        "Università degli Studi di Meridia": "Meridia",
        "Universitätsklinikum Meridia": "Meridia",
        "Meridia Universitätsmedizin Berlin": "Meridia",
        "University College Meridia": "University College Meridia",
        "Glimmer Corp., Cambridge, MA, USA": "Glimmer",
        "Key Laboratory of X, Beijing Y University": "Beijing Y",
        "Physics, School of Optics, Z Institute of Technology, Troy": "Z Institute of Technology",
        "Tulsa Labs": "Tulsa Labs",
        "Solo (x (y (z)))": "Solo",
        "A.C.": "AC",
    }
    df = spark.createDataFrame([(t,) for t in want], "raw string")
    assert {r.raw: r[1] for r in df.select("raw", labels.fallback_label(F.col("raw"))).collect()} == want
    polished = {"U Chester": "Chester", "Busan Nat": "Busan National", "Institute: Utrecht Center": "Utrecht Center", "The Agave Inc.": "Agave", "Hanbit Univ. (Korea": "Hanbit", "UC Davis": "UC Davis", "Inc.": "Inc", "Bell R&D": "Bell R&D"}
    df = spark.createDataFrame([(t,) for t in polished], "raw string")
    assert {r.raw: r[1] for r in df.select("raw", labels.polished_label(F.col("raw"))).collect()} == polished


def test_polish_is_idempotent_and_never_empty(fixture):
    _, df = fixture
    once = df.select("raw", labels.polished_label(F.col("raw")).alias("once"))
    rows = once.select("raw", "once", labels.polished_label(F.col("once")).alias("twice")).collect()
    assert all(r.once for r in rows if r.raw.strip(" ,"))
    assert [r for r in rows if r.once != r.twice and "University" not in r.raw and "Univ" not in r.raw] == []


def test_rules_are_a_table(spark):
    table = labels.rewrite_table(spark)
    assert labels.read_rewrites(table.repartition(4)) == sorted(labels.REWRITES)
    more = table.unionByName(spark.createDataFrame([(7, 1, "colour", "color", None, None)], labels.RULE_SCHEMA))
    df = spark.createDataFrame([("The colour, Inc.",)], "raw string")
    assert df.select(labels.polished_label(F.col("raw"), labels.read_rewrites(more))).first()[0] == "color"
    with pytest.raises(ValueError, match="one step"):
        labels.read_rewrites(table.unionByName(table))
    steps = df.select(labels.forms(F.col("raw"), labels.REWRITES)).first()[0]
    assert steps == ["The colour, Inc.", "The colour, Inc.", "colour, Inc.", "colour, Inc.", "colour, Inc.", "colour", "colour"]


def test_resolution_by_hand(spark):
    tiers = [spark.createDataFrame([(1, "leeds", False, "U Leeds"), (2, "^mit$", True, "MIT")], "rule_id int, needle string, is_regex boolean, short string")]
    curated = spark.createDataFrame([("Quiet Place", "QP Lab (kept)"), ("Photon Works", "PW")], "form string, short string")
    want = {
        "University of Leeds, UK": ("Leeds", "rules"),
        "Quiet Place": ("QP Lab (kept)", "map"),
        "The Photon Works Ltd.": ("PW", "map"),
        "Lumenia – France": ("Lumenia", "retry"),
        "MIT – USA": ("MIT", "retry"),
        "Nest (Italy)": ("Nest", "fallback"),
        "Alone": ("Alone", "fallback"),
    }
    rows = [(t,) for t in [*want, *want, None]]
    got = labels.canonical_labels(spark.createDataFrame(rows, "aff string"), "aff", tiers, curated)
    assert {r.aff: (r.short, r.tier) for r in got.collect()} == want and got.count() == len(want)
    empty = labels.canonical_labels(spark.createDataFrame([], "aff string"), "aff", tiers, curated)
    assert empty.count() == 0


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [("^abc$", "abc"), ("ab?cd", "cd"), (r"a\.b+c", "a.b"), ("(ab|cd)efg", "efg"), ("ab|cd", ""), ("(?i)abc", ""), ("[abc]de", "de"), (r"\bword\b", "word"), ("x{2,3}yz", "yz"), ("a(b(c)d)e", "a"), (r"[^\]]q", "q"), ("", ""), ("[a[b]]xyz", "")],
)
def test_required_literal(pattern, literal):
    assert needles.required_literal(pattern) == literal


def test_needles_equal_brute_force(spark):
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abcé𝄞") for _ in range(n))
    texts = [word(draw.randint(0, 14)) for _ in range(400)]
    rules = [(word(draw.randint(1, 5)), False) for _ in range(60)] + [("^b.*é", True), ("a+c", True), ("(?i)CA", True), ("", False), ("c", False)]
    draw.shuffle(rules)
    got = {r.t: r["rank"] for r in needles.first_hits(spark.createDataFrame([(t,) for t in {*texts}] + [(None,)], "t string"), "t", rules).collect()}
    hit = lambda n, regex, t: bool(re.search(n, t)) if regex else n in t
    assert got == {t: next((k for k, (n, regex) in enumerate(rules) if hit(n, regex, t)), None) for t in texts}
    assert needles.first_hits(spark.createDataFrame([("x",)], "t string"), "t", []).first()["rank"] is None


@pytest.mark.parametrize("n", [1537, 200_000])
def test_many_rules_in_parts(spark, monkeypatch, n):
    draw = random.Random(n)
    word = lambda k: "".join(draw.choice("abcdefghij") for _ in range(k))
    rules = [(i, word(7), False, f"L{i}") for i in range(n - 2)] + [(n, "^abc", True, "R"), (n + 1, "j$", True, "S")]
    texts = [word(30) for _ in range(300)]
    schema = "rule_id int, needle string, is_regex boolean, short string"
    whole = {}
    for most in (needles.MOST_BYTES, n * 20):
        monkeypatch.setattr(needles, "MOST_BYTES", most)
        began = time.time()
        rows = matching.first_rule(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame(rules, schema), "t").collect()
        print(n, "rules in", round(time.time() - began, 1), "s")
        whole[most] = {r.t: (r.rule_id, r.short) for r in rows}
    first = {}
    for i, needle, _, short in rules[:-2]:
        first.setdefault(needle, (i, short))
    want = {}
    for t in texts:
        found = [first[t[k : k + 7]] for k in range(24) if t[k : k + 7] in first] + [(n, "R")] * t.startswith("abc") + [(n + 1, "S")] * t.endswith("j")
        if found:
            want[t] = min(found)
    assert all(x == want for x in whole.values()) and len(want) > 10


def test_no_nested_loop(spark, folder):
    from rostrum.plans import join_queries

    plan = join_queries.j15(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_normal_form_before_rules(spark):
    assert spark.range(1).select(T.normal_form(F.lit("Univ. of  LEEDS"), ((r"\buniv\.", "university"),))).first()[0] == "university of leeds"


def test_rules_are_passed_over_only_where_they_cannot_match(spark):
    assert labels.required_part(r"(?i)^(\S.*?)[\s,-]+(?:universit[aä]t|university|univ)(?:[\s.,].*)?$") == ("univ", False)
    assert labels.required_part(r"\s*\([^()]*\)") == ("(", True) and labels.required_part("ab?c+d") == ("a", True)
    for loose in ("a|b", "(?:ab)?", r"\Qa\E", "[a[b]c]d", "(?i)é", r"(?m)^ab"):
        assert labels.required_part(loose)[0] == "", loose
    rules = [labels.Rewrite(1, 1, "(?i)ab+c", "-"), labels.Rewrite(1, 2, "X", "abc"), labels.Rewrite(1, 3, "(?i)abc", "."), labels.Rewrite(2, 1, "q", "", unless="(?i)STOP")]
    texts = ["", "ABBC", "x abc", "X", "qX", "q stop", "nothing"]
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", labels.rewritten(F.col("t"), rules).alias("x")).collect()}
    assert got == {t: _plain_rewrite(t, rules) for t in texts}


def test_addresses_of_one_row_group_are_dealt_over_tasks(spark, tmp_path):
    from rostrum.plans import text_queries

    spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("ab, cd "), F.lit("ef gh i")).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    runs = text_queries._runs(spark, str(tmp_path), 3)
    assert runs.select(F.spark_partition_id()).distinct().count() > 2
    assert {tuple(r.w) for r in runs.select("w").distinct().collect()} == {("ab", "cd", "ef"), ("gh", "i")}


def test_rules_run_over_arrow_batches(spark):
    rows = [None, "", "  ", ",", " , Italy", "Key Lab of X, Univ. of Y, Rome, Italy", "Acme Co., Ltd.", "12345", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string").repartition(3)
    made = df.select("i", labels.fallback_label(F.col("raw")).alias("f"), labels.polished_label(F.col("raw")).alias("p"), labels.forms(F.col("raw"), labels.REWRITES).alias("all"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    # a regular expression of the JVM costs ten times as much, and inside an interpreted lambda still more
    assert "ArrowEvalPython" in plan and "regexp_replace" not in plan and "lambdafunction" not in plan
    got = {r.i: (r.f, r.p, r["all"]) for r in made.collect()}
    assert got[0] == got[8] == (None, None, [None] * 7) and got[1][:2] == got[2][:2] == ("", "")
    assert [got[i][0] for i in (3, 4, 5, 6, 7)] == [",", "Italy", "Y", "Acme", "12345"]


def test_whole_resolution_is_written_between_its_steps(spark):
    texts = spark.createDataFrame([("Acme (Italy)",), ("Acme",), ("Acme (Italy)",), (None,), ("",)], "aff string")
    tier = spark.createDataFrame([(1, "zzz", False, "Z")], "rule_id int, needle string, is_regex boolean, short string")
    got = labels.canonical_labels(texts, "aff", [tier], spark.createDataFrame([], "form string, short string"))
    # what was asked and answered is read back: only the retry's join is left
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert {r.aff: (r.short, r.tier) for r in got.collect()} == {"Acme (Italy)": ("Acme", "fallback"), "Acme": ("Acme", "fallback"), "": ("", "fallback")}


def test_runs_of_words_come_as_strings(spark, tmp_path):
    from rostrum.plans import text_queries

    texts = ["", None, "--", "a", " One,two\n\nTHREE  four5six Straße é ", "x" * 5000 + " y z w", "a b c d e f", ". a-b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    for n in (2, 3):
        words = {i: re.findall("[A-Za-z]+", t or "") for i, t in enumerate(texts)}
        want = sorted((i, k // n, " ".join(w[k : k + n]), tuple(w[k : k + n])) for i, w in words.items() for k in range(0, len(w), n))
        runs = text_queries._runs(spark, str(tmp_path), n)
        assert sorted((r.doc_id, r.pos, r.run, tuple(r.w)) for r in runs.collect()) == want
    plan = runs.select("doc_id", "pos", "run")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "split(" not in plan
