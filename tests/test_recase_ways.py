"""Titles are recased the same by forms in the tasks and by joins."""

from __future__ import annotations

import random

from rostrum.operators import casing as C

FORMS = {"XYZ": "xyZ", "QED": "QeD", "MRNA": "mRNA", "SS": "sS", "GO.": "gO.", "BIGS": "bIGS"}


def test_tasks_equal_joins(spark, monkeypatch):
    rng = random.Random(8)
    pieces = ["THE", "OF:", "XYZ", "XYZS", "QEDS,", "MRNA", "XIV", "MIX.", "CIVIL", "CIVILX", "GO.", "GO", "BIG", "BIGS", "SSß", "É'S", "A'S²", "A'SÉ", "A'S_", "A'Ŝ", "ΣΑΣ", "İI", "ŉA", "A/B", "WORD?!", "(VIA)", "VIA,", "12", ":", "TO", "T", "\x0bTAB", " NB"]
    rows = [(i if i % 17 else None, rng.choice([" ", "  ", "\t"]).join(rng.choices(pieces, k=rng.randint(1, 9))), i) for i in range(400)] + [(900, None, 1), (901, "", 1), (902, "fine as is", 1)]
    titles = spark.createDataFrame(rows, "i int, title string, n long").repartition(3)
    forms = spark.createDataFrame([*FORMS.items()], "upper string, form string")
    both = []
    for limit in (C.BROADCAST_BYTES, 0):
        monkeypatch.setattr(C, "BROADCAST_BYTES", limit)
        both.append(C.recase_titles(titles, ["i"], "title", forms))
    assert "MapInArrow" in both[0]._jdf.queryExecution().analyzed().toString() and "MapInArrow" not in both[1]._jdf.queryExecution().analyzed().toString()
    one, other = (sorted(map(tuple, b.collect()), key=repr) for b in both)
    assert one == other and len(one) == len(rows)
