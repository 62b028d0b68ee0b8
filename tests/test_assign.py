"""One-to-one assignment by all words, against loops."""

from __future__ import annotations

import random

import pytest

from rostrum.operators import matching
from rostrum.plans import join_queries


@pytest.mark.parametrize("way", ["index", "join", "small steps"])
def test_assigned_by_all_words(spark, monkeypatch, way):
    if way == "join":
        monkeypatch.setattr(matching, "INDEX_ROWS", 0)
    if way == "small steps":
        monkeypatch.setattr(matching, "_CELLS", 8)
    draw = random.Random(4)
    some = lambda: draw.choices("a be sea d1 éa zz long-word I".split(), k=draw.randint(0, 6))
    left = [(i, draw.choice(["x", "y", None]), some()) for i in range(60)] + [(90, "x", None)]
    right = [(j, some()) for j in range(9)] + [(10, None)]
    want = set()
    for block in ("x", "y", None):
        pairs = []
        for i, b, w in left:
            for j, v in right:
                if b == block and w and v and set(w) & set(v):
                    pairs.append((-len(set(w) & set(v)) / len(set(w) | set(v)), i, j))
        used = (set(), set())
        for score, i, j in sorted(pairs):
            if -score >= 0.3 and i not in used[0] and j not in used[1]:
                used[0].add(i)
                used[1].add(j)
                want.add((block, i, j, -score))
    got = matching.assign_similar(spark.createDataFrame(left, "i int, b string, w array<string>").repartition(5), spark.createDataFrame(right, "j long, w array<string>"), "b", "i", "j", "w", 0.3)
    assert got.columns == ["b", "i", "j", "score"] and {tuple(r) for r in got.collect()} == want and len(want) > 15


def test_assign_once_reads_short_words(spark, tmp_path):
    spark.createDataFrame([(1, "The cat sat.", "en"), (2, "Ça va, été 7", "fr"), (3, "nothing alike", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "A cat sat, the cat"), (6, "été 7 va")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = join_queries.j10(spark, str(tmp_path)).collect()
    assert {(r.lang, r.documents_id, r.benchmark_id, r.score) for r in got} == {("en", 1, 5, 0.75), ("fr", 2, 6, 0.75)}
