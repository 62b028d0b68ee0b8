"""Removal of repeated passages against a plain table of all strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from rostrum.llm import queries, suffix_dedup
from rostrum.llm.suffix_dedup import blind_trie, deep_shallow, repeated_bytes, words_of


def _plain(docs, least):
    """docs: (id, bytes); per row its removed runs."""
    first = {}
    order = lambda i: float("inf") if i is None else i
    for i, t in docs:
        for s in range(len(t) - least + 1):
            w = t[s : s + least]
            first[w] = min(first.get(w, float("inf")), order(i))
    out = []
    for i, t in docs:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - least + 1):
            if first[t[s : s + least]] < order(i):
                gone[s : s + least] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone])).tolist()
        out.append((i, list(zip(edge[::2], edge[1::2]))))
    return out


def _spans(df):
    return sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("chunk", "piece", "least"), [(1 << 22, 1 << 18, 50), (3000, 700, 50), (0, 64, 24), (5000, 1 << 18, 77)])
def test_spans_equal_a_table_of_all_strings(spark, monkeypatch, chunk, piece, least):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    draw = random.Random(chunk + least)
    word = lambda: "".join(draw.choice("abé") for _ in range(draw.randint(1, 5)))
    shared = [" ".join(word() for _ in range(n)) for n in (9, 15, 30, 200)] + ["x" * 300, "ab" * 90]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(draw.randint(0, 40))) for _ in range(3)]
        rows.append((draw.choice([i, i, i // 2, None]), draw.choice(shared).join(parts) if i % 3 else draw.choice(shared)[draw.randint(0, 9) :]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = _spans(repeated_bytes(docs, least=least, outputs=("spans",)))
    assert got == sorted(_plain([(i, t.encode()) for i, t in rows], least), key=repr)
    assert any(s for _, s in got)


def test_query_equals_a_table_of_all_strings(spark, folder, texts):
    want = {}
    for i, spans in _plain([(i, (t or "").encode()) for i, t in texts.items()], 50):
        body = (texts[i] or "").encode()
        kept = b"".join(body[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(body)]))
        want[i] = (i, len(body), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: tuple(r) for r in queries.op13_suffix_dedup(spark, folder).collect()} == want


@pytest.mark.parametrize("letters", [b"a", b"ab", bytes(range(256))])
def test_sorting_equals_python(letters):
    draw = random.Random(len(letters))
    raw = bytes(draw.choice(letters) for _ in range(400)) + b"q" * 120 + bytes(draw.choice(letters) for _ in range(200))
    raw += raw[100:500] + raw[90:300]
    at = np.array(draw.sample(range(len(raw) - 50), 900))
    order, first = deep_shallow(raw, words_of(np.frombuffer(raw, np.uint8)), at, 50)
    cut = [raw[p : p + 50] for p in at[order].tolist()]
    assert cut == sorted(raw[p : p + 50] for p in at.tolist())
    assert first.tolist() == [k == 0 or cut[k] != cut[k - 1] for k in range(len(cut))]


def test_blind_trie_orders_and_groups():
    draw = random.Random(5)
    texts = [bytes(draw.choice(b"ab\xff\x00") for _ in range(7)) for _ in range(3000)]
    leaves = blind_trie(texts)
    assert [texts[x[0]] for x in leaves] == sorted(set(texts)) and sorted(i for x in leaves for i in x) == list(range(3000))
    assert all(len({texts[i] for i in x}) == 1 for x in leaves)


def test_awkward(spark, awkward, empty):
    got = {(r.doc_id, r.n_bytes): r for r in repeated_bytes(awkward, outputs=("kept", "spans")).collect()}
    assert got[3, 0].kept == b"" and got[4, 0].n_spans == 0
    assert got[6, 300_003].n_removed == 0  # a text that repeats itself keeps all
    assert got[None, len("a text without an id")].n_removed == 0
    twin = [("a passage that stands in a document with an id and in two without one", i) for i in (None, 5, None, 5)]
    rows = repeated_bytes(spark.createDataFrame(twin, "text string, doc_id long")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 69), (0, 69), (5, 0), (5, 0)]
    assert repeated_bytes(empty).count() == 0
