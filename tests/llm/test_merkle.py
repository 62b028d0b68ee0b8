"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rostrum.llm import merkle, queries


def _plain_tree(leaves, fanout):
    """Root of a list of digests, and the siblings of each leaf run by run upwards."""
    at, nodes, paths = list(range(len(leaves))), list(leaves), [[] for _ in leaves]
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a // fanout * fanout
            paths[i].append((nodes[run:a], nodes[a + 1 : run + fanout]))
        nodes = [_sha("".join(nodes[a : a + fanout])) for a in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], paths


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("fanout", "sizes"), [(2, [1, 2, 33, 0, 300]), (3, [40, 1, 9]), (5, [1]), (17, [18, 5])])
def test_manifest_equals_a_plain_tree(spark, fanout, sizes):
    names = [None, "", "a", "é", "z"]
    rows = [(names[g], i, _sha(f"{g} {i}")) for g, n in enumerate(sizes) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, "g string, i long, leaf string").repartition(3), "g", ["i"], fanout=fanout).collect()
    assert len(got) == len(rows)
    groups = [[r for r in rows if r[0] == names[g]] for g, n in enumerate(sizes) if n]
    trees = [_plain_tree([r[2] for r in group], fanout) for group in groups]
    root, upper = _plain_tree([t[0] for t in trees], fanout)
    want = {(r[0], r[1]): (tree[0], [("".join(a), "".join(b)) for a, b in path + up]) for group, tree, up in zip(groups, trees, upper) for r, path in zip(group, tree[1])}
    assert {(r.g, r.i): (r.subroot, [tuple(s) for s in r.path]) for r in got} == want
    assert {r.root for r in got} == {root}


def test_manifest_awkward(awkward, empty):
    leaves = awkward.withColumns({"leaf": merkle.leaf_digest(F.col("doc_id"), F.col("text")), "path": F.lit(1), "grp": F.lit(2), "at": F.lit(3), "item": F.lit(4), "levels": F.lit(5)})
    got = merkle.manifest(leaves, "lang", ["doc_id"]).withColumn("again", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(got) == 10 and all(r.again == r.root for r in got) and {r.item for r in got} == {4}
    assert {r.doc_id: r.leaf for r in got}[3] == _sha("1:3-")
    twins = [r for r in got if r.doc_id == 2]  # equal rows have a place each
    assert len(twins) == 2 and twins[0].path != twins[1].path
    assert merkle.manifest(empty.withColumn("leaf", F.lit("x")), "lang", ["doc_id"]).count() == 0


def test_merkle_tampering_is_seen(spark, folder):
    rows = queries.op11_merkle(spark, folder).collect()
    struck = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
    assert {r.doc_id for r in rows if not r.verified} == struck and len({r.root for r in rows}) == 1
