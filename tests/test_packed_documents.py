"""Program documents lie compressed, and are read as they are or compressed."""

from __future__ import annotations

import gzip
import json
import os

from rostrum.plans import source_queries
from rostrum.sources import processors


def test_documents_are_written_compressed(spark, folder, tmp_path):
    made = processors.process(spark, "orders", folder=folder, dealt=True)
    out = f"{tmp_path}/out"
    processors.write_documents(made, f"file://{out}", packed=True)
    files = os.listdir(out)
    plain = sum(len(r.document.encode()) + 1 for r in processors.documents(made).collect())
    assert files and all(f.endswith(".jsonl.zst") for f in files) and sum(os.path.getsize(f"{out}/{f}") for f in files) < plain / 4
    for relation in ("sessions", "talks"):
        keys = ("conference_name", "id")
        back = processors.read_documents(spark, f"file://{out}", relation)
        assert sorted(map(tuple, back.select(*keys).collect())) == sorted(map(tuple, made[relation].select(*keys).collect()))
    processors.write_documents({r: df.limit(1) for r, df in made.items()}, f"file://{out}")
    assert not set(files) & set(os.listdir(out))  # what lay there goes


def test_plain_and_gzip_documents(spark, tmp_path):
    line = json.dumps({"conference_name": "A", "talks": [{"id": "1"}]}).encode() + b"\n"
    (tmp_path / "a.jsonl").write_bytes(line)
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(line + line))
    assert processors.read_documents(spark, f"file://{tmp_path}", "talks").count() == 3


def test_documents_travel_narrow(spark, folder):
    plan = processors.documents(processors.process(spark, "orders", folder=folder, dealt=True))._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning(conference_name" in x]
    assert len(moved) == 2 and all("REPARTITION_BY_COL" in x for x in moved)  # no JSON text meets by program
    assert source_queries.x2(spark, folder).count() > 0
