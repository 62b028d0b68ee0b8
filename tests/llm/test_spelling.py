"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rostrum.llm import queries, spelling


def _one_edit(a, b):
    cuts = lambda w: {(i, w[:i] + w[i + 1 :]) for i in range(len(w))}
    if len(a) == len(b):
        return a != b and bool(cuts(a) & cuts(b))
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and short in {x for _, x in cuts(long)}


def _plain_variants(counts, factor=2):
    near = {w: [x for x in counts if _one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def last(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], last(w), n, len(near[w]), form[w] and counts[form[w]]) for w, n in counts.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_all_pairs(spark, seed):
    draw = random.Random(seed)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(2, 6))) for _ in range(400)}
    counts = {w: draw.choice([3, 3, 4, 8, 16, 40, 100]) for w in words}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == _plain_variants(counts)


def test_each_pair_once(spark):
    words = [(w,) for w in ("abcde", "abcdx", "abcdee", "abccde", "xbcde", "abde", "bacde", "abcd")]
    pairs = [tuple(r) for r in spelling.near_pairs(spark.createDataFrame(words, "word string")).collect()]
    want = {(a, b) for (a,) in words for (b,) in words if (len(a), a) < (len(b), b) and _one_edit(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_long_chain_of_forms(spark):
    chain = ["q" * 5 + "r" * k for k in range(30)]
    rows = spelling.variants(spark.createDataFrame([(w, 1 << (40 - k)) for k, w in enumerate(chain)], "word string, n long")).collect()
    assert {r.root for r in rows} == {"qqqqq"} and {r.word: r.form for r in rows}["qqqqqrr"] == "qqqqqr"


def test_slips_and_counts(spark, awkward, empty):
    docs = awkward.select("doc_id", "text").collect()
    want = Counter()
    for r in docs:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")):
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 5 == 0 else run] += 1
    runs = spelling.with_slips(spelling.word_runs(awkward), every=5)
    assert {r.word: r.n for r in runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect() if r.word} == {w: n for w, n in want.items() if w}
    for table in (awkward, empty):
        rows = spelling.variants(spelling.counted(spelling.with_slips(spelling.word_runs(table, least=5), every=97), times=1)).collect()
        assert bool(rows) == (table is awkward)


def test_no_python_and_no_cross_join(spark, folder):
    plan = queries.op12_spelling(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
