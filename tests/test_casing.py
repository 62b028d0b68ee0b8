"""Recased titles, compatibility forms and the four-pass match, by hand and against loops."""

from __future__ import annotations

import random
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from rostrum.functions import compat
from rostrum.operators import casing as C
from rostrum.operators import people


def one(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_nfkc_of_all_assigned_signs(spark):
    signs = [chr(k) for k in range(1, sys.maxunicode + 1) if unicodedata.category(chr(k)) not in ("Cn", "Cs", "Co")]
    texts = ["".join(signs[i : i + 40]) for i in range(0, len(signs), 40)]
    rng = random.Random(1)
    texts += ["".join(rng.choices(signs[:20000] + ["́", "̈", "̣", "a", "e"] * 2000, k=12)) for _ in range(500)]
    assert one(spark, compat.nfkc, texts) == [unicodedata.normalize("NFKC", t) for t in texts]
    lone = [s for s in signs if len(unicodedata.normalize("NFKC", s)) > 1][::7]
    assert one(spark, compat.nfkc, lone) == [unicodedata.normalize("NFKC", s) for s in lone]


def test_matching_form(spark):
    texts = ["ﬁne ① ²", "Ｕｎｉｖ． of Ｘ", "München—Süd", "O’Neil`s ʼt", "Univeristy of Reasearch", "Universität Universitaet", "universityof y", "IIT, Delhi", "Paranivesity niversitya", "a  b c\n", "", None, "plain"]
    want = ["fine 1 2", "university of x", "munchen-sud", "o'neil's 't", "university of research", "universitat universitat", "university of y", "iit delhi", "paranivesity niversitya", "a b c", "", None, "plain"]
    assert one(spark, compat.matching_form, texts) == want
    assert one(spark, lambda c: compat.matching_form(c, [("a", "b")]), ["A a"]) == ["b b"]


def _words(spark, rows, forms):
    table = spark.createDataFrame([*forms.items()], "upper string, form string")
    titles = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "i int, title string, upper string")
    out = C.recase_titles(titles, ["i"], "title", table)
    assert out.columns == ["i", "title", "upper"]
    return [r["title"] for r in out.orderBy("i").collect()]


def _loop(title, forms):
    """The same in plain Python, one word after the other."""
    letters = [x for x in title if x.isascii() and x.isalpha()]
    if len(letters) < 3 or sum(x.isupper() for x in letters) < 0.8 * len(letters):
        return title
    roman = re.compile(r"M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})")
    known = lambda w: forms.get(w.upper()) or (forms[w.upper()[:-1]] + "s" if w.upper().endswith("S") and w.upper()[:-1] in forms else None)
    words, out = title.split(), []
    for i, w in enumerate(words):
        only = "".join(x for x in w if x.isascii() and x.isalpha())
        if known(w):
            new = known(w)
        elif 0 < i < len(words) - 1 and only.lower() in C.MINOR_WORDS:
            new = w.lower()
        elif len(only) > 1 and roman.fullmatch(only.upper()):
            new = w.upper()
        else:
            new, seen = "", False
            for part in re.findall(r"[A-Za-z]+|[^A-Za-z]+", w):
                if part[0].isascii() and part[0].isalpha():
                    new += known(part) or (part.lower() if seen and part.lower() in C.MINOR_WORDS else part[0].upper() + part[1:].lower())
                    seen = True
                else:
                    new += part
            new = re.sub(r"'S\b", "'s", new)
        if i == 0 or words[i - 1].endswith(":"):
            at = next((k for k, x in enumerate(new) if x.isalpha()), None)
            new = new if at is None else new[:at] + new[at].upper() + new[at + 1 :]
        out.append(new)
    return " ".join(out)


FORMS = {"XYZ": "xyZ", "QED": "QeD", "MRNA": "mRNA", "3D": "3D"}


def test_recased_by_hand(spark):
    rows = ["THE PARTS OF XYZS: A NEW QED", "XYZ-ON-QED AND THE MIX-IN", "PART XVIII OF CIVIL MILL'S", "MRNA: THE 3D'S VIA", "Already fine", "", None, "(XYZ) ÉTUDE DE: mRNA", "WITH", "AB"]
    want = ["The Parts of xyZs: A New QeD", "XyZ-on-QeD and the Mix-in", "Part XVIII of Civil Mill's", "MRNA: The 3D's Via", "Already fine", "", None, "(XyZ) Étude De: MRNA", "With", "AB"]
    got = _words(spark, rows, FORMS)
    assert got[:3] == want[:3] and got[4:7] == want[4:7] and got[8:] == want[8:]
    assert got == [r and _loop(r, FORMS) for r in rows]


def test_recased_equals_a_loop(spark):
    rng = random.Random(2)
    pieces = ["THE", "OF", "XYZ", "XYZS", "QED'S", "MRNA", "XIV", "MIX", "IV:", "CIVIL", "ON-XYZ-IN", "A/B-OF-C", "(QED)", "12", "É", "É-THE", "VIA:", "ÉTAT", "S", "'S", "WORD'S,", ":", "3D", "3DS", "lower"]
    rows = [rng.choice([" ", "  "]).join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(300)]
    assert _words(spark, rows, FORMS) == [_loop(r, FORMS) for r in rows]


def test_runs_beside_letters_that_become_two(spark):
    forms = {"SS": "sS", "QED": "QeD", "SSSS": "wrong"}
    assert _words(spark, ["GO SSß. ON", "GO ßQED ßQEDS GO"], forms) == ["Go sSß. On", "Go ßQeD ßQeDs Go"]


def test_learned_forms(spark):
    texts = ["We use AbX, abx and AbX; an eV.", "aBX aBX iPod (iPod)", "The ABX IS LOUD AND TEACHES NOTHING", "Word word WHO who", None, "", "mRNA mrna mrna and Gpu"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["upper"]: r["form"] for r in C.learned_forms(rows, "t", {"gpu": "GPU"}).collect()}
    assert got == {"ABX": "AbX", "EV": "eV", "IPOD": "iPod", "WHO": "WHO", "GPU": "GPU"}
    assert C.learned_forms(rows.where("false"), "t", {}).count() == 0


def test_layered_match(spark):
    known = spark.createDataFrame([(1, "Ann Lee", "On Things", "X"), (2, "Ann Lee", "Other", "Y"), (3, "Zoëlle Marchetti", "Late", "Z"), (4, "Bo Nowhere", "Lost", None), (5, "", "Free-standing", "W"), (6, "Anna Lea", "On Things", "V")], "p int, n string, t string, aff string")
    asked = spark.createDataFrame([(1, "ANN  LEE", "Late"), (2, "Ann Leex", None), (3, "Z. Marchetti", "x"), (4, "Somebody Else", "on things!"), (5, None, "free standing"), (6, "", ""), (7, "Bo Nowhere", "Lost"), (8, None, None), (9, "Anne Lea", None)], "i int, speaker string, talk string").withColumn("n", F.lit("kept"))
    out = people.layered_match(asked, known, ("speaker", "talk"), ("n", "t"), "aff", "p")
    assert set(out.columns) == {"i", "speaker", "talk", "n", "pass", "aff"}
    got = {r["i"]: (r["pass"], r["aff"]) for r in out.collect()}
    assert got == {1: (1, "X"), 2: (2, "X"), 3: (3, "Z"), 4: (4, "X"), 5: (4, "W"), 6: (None, None), 7: (None, None), 8: (None, None), 9: (2, "X")}
    assert people.layered_match(asked, known.where("false"), ("speaker", "talk"), ("n", "t"), "aff", "p").where("pass is not null").count() == 0
