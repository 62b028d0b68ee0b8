"""Processors, the program data source, settings and pattern files on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rostrum.sources import config, processors, program


def _write(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines), encoding="utf-8")


@pytest.fixture
def messy(tmp_path):
    one = {
        "conference_name": "Élan",
        "sessions": [
            {"id": "s1", "title": "A", "start_ts": "2026-05-01T09:00:00", "end_ts": "2026-05-01T08:00:00", "location": "", "talk_ids": ["t1", "gone"], "tags": [{"key": "k", "value": "v"}, {"key": "k", "value": "w"}]},
            {"id": "s1", "title": "B", "start_ts": "soon", "color": "odd"},
            {"title": "no id"},
        ],
        "talks": [
            {"id": "t1", "session_id": "s1", "authors": [{"name": "Ann", "insts": [1, 9]}, {"name": "Bo"}], "institutions": [{"n": 1, "name": "X"}, {"n": 1, "name": "Y", "alt_names": ["Z"]}], "withdrawn": True},
            {"id": "t2", "session_id": "nowhere", "speaker_pos": "three", "title": 7, "start_ts": " "},
        ],
        "session_types": [{"id": "plain", "label": "Plain"}],
    }
    _write(tmp_path / "in", "a.jsonl", one, "", {"conference_name": None, "talks": [{"id": "u1"}, None]}, "{broken", "[]")
    _write(tmp_path / "in", "b.jsonl", {"conference_name": "Late", "sessions": [{"id": "s9"}]})
    _write(tmp_path / "in", "c.txt", "not a document file")
    return str(tmp_path / "in")


def test_read_relations(spark, messy):
    talks = {(r.conference_name, r.pos): r for r in processors.read_documents(spark, messy, "talks").collect()}
    assert set(talks) == {("Élan", 0), ("Élan", 1), (None, 0), (None, 1)}
    assert talks["Élan", 0].authors[0].insts == [1, 9] and talks["Élan", 0].institutions[1].alt_names == ["Z"] and talks["Élan", 0].withdrawn is True
    assert talks["Élan", 1].speaker_pos is None and talks["Élan", 1].title == "7" and talks[None, 1].id is None
    sessions = {(r.conference_name, r.pos): r for r in processors.read_documents(spark, messy, "sessions").collect()}
    assert sessions["Élan", 0].location == "" and sessions["Élan", 1].location is None and [t.value for t in sessions["Élan", 0].tags] == ["v", "w"]
    broken = processors.read_documents(spark, messy, "broken").collect()
    assert sorted(r.line for r in broken) == ["[]", "{broken"] and {r.file for r in broken} == {"a.jsonl"}
    with pytest.raises(Exception, match="no relation"):
        processors.read_documents(spark, messy, "rooms").collect()


def test_files_are_shared_out(spark, messy):
    reader = processors._Reader(messy, "talks", processors.RELATIONS["talks"], 1)
    assert [len(p.files) for p in reader.partitions()] == [1, 1]
    assert [len(p.files) for p in processors._Reader(messy, "talks", processors.RELATIONS["talks"], 1 << 20).partitions()] == [2]


def test_round_trip_and_overwrite(spark, messy, tmp_path):
    made = {r: processors.read_documents(spark, messy, r).where("conference_name is not null") for r in ("sessions", "talks", "session_types")}
    out = str(tmp_path / "out")
    for _ in range(2):  # the second write takes the place of the first
        processors.write_documents(made, out)
    for relation, df in made.items():
        back = processors.read_documents(spark, out, relation)
        key = lambda r: (r.conference_name, r.pos)
        assert sorted(back.collect(), key=key) == sorted(df.collect(), key=key)
    lines = [json.loads(x) for f in (tmp_path / "out").iterdir() for x in f.read_text().splitlines()]
    assert sorted(d["conference_name"] for d in lines) == ["Late", "Élan"] and "location" not in lines[0]["sessions"][-1]
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.endswith(".draft")]


def test_problems(spark, messy):
    made = {r: processors.read_documents(spark, messy, r) for r in ("sessions", "talks", "session_types")}
    found = {tuple(r)[1:] for r in processors.problems(made).where("conference_name = 'Élan'").collect()}
    assert found == {
        ("sessions", "s1", "ends before it starts"), ("sessions", "s1", "start is no time"), ("sessions", None, "no id"), ("sessions", "s1", "id twice"), ("sessions", "s1", "listed talk isn't there"),
        ("sessions", "s1", "type isn't registered"), ("talks", "t1", "author cites a missing institution"), ("talks", "t1", "institution number twice"), ("talks", "t2", "session isn't there"),
    }


def test_processors_are_checked(spark):
    @processors.processor("test-one")
    def one(spark, extra=None, nested=False):
        talks = spark.createDataFrame([("c", 0, "t")], "conference_name string, pos long, id string")
        talks = talks.withColumn(extra, F.lit(1)) if extra else talks
        talks = talks.withColumn("title", F.array(F.lit("x"))) if nested else talks
        return {"sessions": spark.createDataFrame([("c", "s")], "conference_name string, id string"), "talks": talks}

    made = processors.process(spark, "test-one")
    assert {r: df.schema.names for r, df in made.items()} == {r: processors.RELATIONS[r].names for r in made}
    assert made["talks"].first().pos == 0 and made["sessions"].first().title is None
    with pytest.raises(processors.SchemaProblem, match="unknown columns room"):
        processors.process(spark, "test-one", extra="room")
    with pytest.raises(processors.SchemaProblem, match="talks.title is array<string>"):
        processors.process(spark, "test-one", nested=True)
    with pytest.raises(KeyError):
        processors.process(spark, "nothing")
    with pytest.raises(ValueError, match="two processors"):
        processors.processor("test-one")(one)
    processors._PROCESSORS.pop("test-one")


def test_settings_of_programs(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    settings = config.Settings(
        frame([("a", 2, "hall", "H"), ("a", 1, "grand hall", "GH"), ("b", 1, "hall", "B")], "program string, ord int, needle string, short string"),
        frame([("a", "oral", "Talk")], "program string, id string, label string"),
        frame([("a", d) for d in ("2026-05-02", "2026-05-01")], "program string, day string").withColumn("day", F.to_date("day")),
    )
    rows = [(1, "a", "Grand Hall, Room 5b", "oral", "2026-05-02 10:00:00"), (2, "b", "Grand Hall", "oral", None), (3, "a", "Lawn", "poster", "2026-05-09 10:00:00"), (4, "c", None, None, None), (5, None, "Hall", "oral", None)]
    items = frame(rows, "id int, prog string, location string, type string, start string").withColumn("start", F.to_timestamp("start"))
    got = {r.id: (r.place, r.label, r.day) for r in config.with_settings(items, settings, "prog").collect()}
    assert got == {1: ("GH 5b", "Talk", 2), 2: ("B", None, None), 3: ("Lawn", None, None), 4: (None, None, None), 5: ("Hall", None, None)}


def test_first_pattern(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("# all\n\n  b+c  # twice\na\n")
    rules = program.read_rules(spark, str(tmp_path / "rules.txt"))
    rows = spark.createDataFrame([(1, "xbbcx"), (2, "a bc"), (3, "zz"), (4, None)], "id int, t string")
    assert {r.id: r.pattern for r in config.first_pattern(rows, rules, "t").collect()} == {1: "b+c", 2: "a"}


def test_documents_are_read_in_arrow_batches(spark, tmp_path):
    import json

    import pyarrow as pa

    talk = {"id": 7, "title": "T", "authors": [{"name": "A", "insts": [1, "x"]}, 3], "withdrawn": True, "speaker_pos": "no"}
    with open(f"{tmp_path}/a.jsonl", "w") as out:
        out.write(json.dumps({"conference_name": 5, "talks": [talk, None]}) + "\n{broken\n")
    reader = processors._Reader(str(tmp_path), "talks", processors.RELATIONS["talks"], 1 << 20)
    assert all(isinstance(b, pa.RecordBatch) for p in reader.partitions() for b in reader.read(p))
    rows = processors.read_documents(spark, str(tmp_path), "talks").orderBy("pos").collect()
    assert [(r.conference_name, r.pos, r.id, r.title, r.withdrawn, r.speaker_pos) for r in rows] == [("5", 0, "7", "T", True, None), ("5", 1, None, None, None, None)]
    assert [a and (a.name, a.insts) for a in rows[0].authors] == [("A", [1, None]), None]
    assert processors.read_documents(spark, str(tmp_path), "broken").count() == 1


def test_program_documents_are_written_compressed(spark, folder):
    import glob

    from rostrum.plans import registry, source_queries  # noqa: F401
    from rostrum.session import shared_folder

    top = f"{shared_folder(spark).removeprefix('file://')}/program-json-*/part-*"
    before = set(glob.glob(top))
    assert registry.queries()["s1_read_program"](spark, folder).count() > 0
    made = set(glob.glob(top)) - before
    assert made and all(f.endswith(".gz") for f in made)
