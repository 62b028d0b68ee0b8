"""Pairs of many small blocks at once, against loops."""

from __future__ import annotations

import difflib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rostrum.operators import blocks, shared, titles
from rostrum.plans import title_queries


def _texts(draw, n, most):
    pieces = ["hot", "bolt", "ring", "", "blue", "hot bolt", "a", "ab", "brand 7", "x" * 9]
    return [" ".join(draw.choices(pieces, k=draw.randint(0, most)))[: blocks.LONGEST] for _ in range(n)]


@pytest.mark.parametrize("most", [4, 60])
def test_ratio_and_bound(most):
    draw = random.Random(most)
    a, b = _texts(draw, 40, most), _texts(draw, 40, most)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40), indexing="ij"))
    x, y = (blocks.texts_of(pa.array(t, pa.string())) for t in (a, b))
    ratio, common = blocks.block_ratio(x, y, i, j), blocks.common_signs(x, y, i, j)
    assert ratio.tolist() == [difflib.SequenceMatcher(None, a[p], b[q]).ratio() for p, q in zip(i, j)]

    def plain(s, t):
        row = [0] * (len(t) + 1)
        for c in s:
            last = 0
            for k, d in enumerate(t, 1):
                last, row[k] = row[k], last + 1 if c == d else max(row[k], row[k - 1])
        return row[-1]

    some = draw.sample(range(len(i)), 300)
    assert [common[k] for k in some] == [plain(a[i[k]], b[j[k]]) for k in some]


def test_blocks_at_once_equal_one_by_one():
    draw = random.Random(5)
    sides, want = ([], []), set()
    for block in range(200):
        own = [_texts(draw, draw.randint(0, 6), 5) for _ in "ab"]
        if block % 50 == 7:
            own[0].append("very long title " * 20)
        first = [len(s) for s in sides]
        if own[0] and own[1]:
            want |= {(first[0] + i, first[1] + j, r) for i, j, r in titles._assigned(*own, 0.5)}
        for side, new in zip(sides, own):
            side += [(block, t) for t in new]
    tables = [pa.table({"_t": [t for _, t in s]}) for s in sides]
    i, j, score = titles._assign_small(*tables, *[np.array([n for n, _ in s]) for s in sides], 200, 0.5)
    assert set(zip(i.tolist(), j.tolist(), score.to_pylist())) == want and len(i) == len(want)


def test_a_pass_uses_each_row_once():
    draw = random.Random(6)
    for _ in range(50):
        pairs = [(draw.randint(0, 8), draw.randint(0, 8)) for _ in range(draw.randint(0, 40))]
        left, right, want = set(), set(), []
        for k, (i, j) in enumerate(pairs):
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                want.append(k)
        both = np.array(pairs, np.int64).reshape(-1, 2)
        assert sorted(blocks.one_pass(both[:, 0], both[:, 1]).tolist()) == want


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_chunks_never_split_a_block(monkeypatch, rows):
    monkeypatch.setattr(blocks, "CHUNK_ROWS", rows)
    keys = [k for k in range(20) for _ in range(k % 4 + 1)]
    batches = [pa.RecordBatch.from_pydict({"b": keys[s : s + 3], "row": list(range(s, min(s + 3, len(keys))))}) for s in range(0, len(keys), 3)]
    got = [(t["b"].to_pylist(), t["row"].to_pylist(), number.tolist()) for t, number in blocks.chunks(iter(batches), "b")]
    assert [r for _, rows_, _ in got for r in rows_] == list(range(len(keys)))
    seen = [set(b) for b, _, _ in got]
    assert sum(map(len, seen)) == len(set().union(*seen))
    for b, _, number in got:
        assert [x - number[0] for x in number] == [sorted(set(b)).index(x) for x in b]


def test_lines_travel_without_titles(spark, folder):
    plan = title_queries._rows(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RepartitionByExpression") :]
    assert "_title" not in moved.split("Join", 1)[0] and plan.count("RepartitionByExpression") == 1


@pytest.mark.parametrize("name", ["j11_scores", "j11_claims", "j10"])
def test_no_side_is_written(spark, folder, name, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda _: f"file://{tmp_path}")
    assert getattr(title_queries, name)(spark, folder).count() > 0
    assert {x.split("-")[0] for x in os.listdir(tmp_path)} <= {"title", "large"}


def test_texts_that_fit_no_broadcast(spark, folder, monkeypatch):
    want = sorted(map(tuple, title_queries.j11_scores(spark, folder).collect()))
    monkeypatch.setattr(title_queries, "BROADCAST_BYTES", 1)
    assert sorted(map(tuple, title_queries.j11_scores(spark, folder).collect())) == want and want


def test_awkward_names(spark):
    left = spark.createDataFrame([("s", 1, "x", "Ann"), ("s", 2, "y", None), ("s", 3, "", "Ann")], "b string, i int, title string, speaker string")
    right = spark.createDataFrame([("s", "p", "q", [""]), ("s", "q", "z", None), ("s", "r", "w", [None, "Bo", "ann lee"])], "b string, j string, title string, speakers array<string>")
    got = {(r.i, r.j): r.score for r in titles.presenter_scores(left, right, "b", "i", "j").collect()}
    assert got == {(1, "p"): 0.72, (1, "r"): 0.72}
    assert [tuple(r) for r in titles.claim_abstracts(left.withColumn("at", F.lit(1)), right, "b", "at", "i", "j").collect()] == [("s", 1, "p", 0.72)]


def test_times_travel_only_where_they_are_asked_for(spark, folder):
    plan = lambda df: "".join(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" not in x)
    assert "l_shipdate" not in plan(title_queries.j11_scores(spark, folder)) and "l_shipdate" in plan(title_queries.j11_claims(spark, folder))
