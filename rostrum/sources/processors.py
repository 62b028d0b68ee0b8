"""Processors: functions from a source to the common program schema, a check that names the offending rows, and the
program documents as a data source of their own.

A processor is registered under a name and returns the relations `sessions` and `talks` (others may follow), keyed by
`conference_name`. `process` brings them to the common schema and refuses columns that the schema doesn't have.
`problems` lists rows that break the contract. `ProgramDocuments` reads and writes folders of documents, one JSON document
a line: `spark.read.format("program").option("relation", "talks").load(folder)` gives a relation, a task a share of the files;
the writer's files appear only when all tasks are done.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rostrum.sources import program

Program = dict[str, DataFrame]
Processor = Callable[..., Program]
_PROCESSORS: dict[str, Processor] = {}
_KEY = [T.StructField("conference_name", T.StringType()), T.StructField("pos", T.IntegerType())]
#: The relations of a program and their columns.
RELATIONS: dict[str, T.StructType] = {
    "sessions": T.StructType([*_KEY, *program.SESSION.fields]),
    "talks": T.StructType([*_KEY, *program.TALK.fields]),
    "session_types": T.StructType([*_KEY, *program.TYPE.fields]),
    "talk_types": T.StructType([*_KEY, *program.TYPE.fields]),
}
#: Rows of one batch that the source hands to Spark.
BATCH_ROWS = 4096
#: Names of documents, as they are or compressed.
_NAMES = (".jsonl", ".jsonl.gz", ".jsonl.zst")
#: Bytes of text that a compressed byte counts for.
_PACKED = 12
#: What the source says of lines that are no document.
BROKEN = T.StructType([T.StructField(c, T.StringType()) for c in ("file", "line", "problem")])


class SchemaProblem(ValueError):
    """A processor's relation doesn't have the common schema."""


def processor(name: str) -> Callable[[Processor], Processor]:
    """Register a function (spark, **options) -> relations under `name`."""

    def keep(f: Processor) -> Processor:
        if name in _PROCESSORS:
            raise ValueError(f"two processors named {name}")
        _PROCESSORS[name] = f
        return f

    return keep


def _as(c: Column, have: T.DataType, want: T.DataType, name: str) -> Column:
    """`c` in the wanted type: fields of structs by name, absent ones null; other types by a cast."""
    kind = T.ArrayType if isinstance(want, T.ArrayType) else T.StructType if isinstance(want, T.StructType) else None
    if isinstance(have, T.NullType) or kind is None and not isinstance(have, (T.ArrayType, T.StructType, T.MapType)):
        return c.cast(want)
    if kind is None or not isinstance(have, kind):
        raise SchemaProblem(f"{name} is {have.simpleString()}, not {want.simpleString()}")
    if kind is T.ArrayType:
        return F.transform(c, lambda x: _as(x, have.elementType, want.elementType, name))
    unknown = sorted(set(have.names) - set(want.names))
    if unknown:
        raise SchemaProblem(f"{name}: unknown fields {', '.join(unknown)}")
    fields = [(_as(c[f.name], have[f.name].dataType, f.dataType, f"{name}.{f.name}") if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
    return F.when(c.isNotNull(), F.struct(*fields))


def conformed(df: DataFrame, relation: str) -> DataFrame:
    """`df` with the columns of the common schema in order: absent columns and nested fields null, values of another
    plain type cast. Unknown columns or fields, and nesting where the schema has none, are an error."""
    want = RELATIONS[relation]
    unknown = sorted(set(df.columns) - set(want.names))
    if unknown:
        raise SchemaProblem(f"{relation}: unknown columns {', '.join(unknown)}")
    return df.select(*[(_as(F.col(f.name), df.schema[f.name].dataType, f.dataType, f"{relation}.{f.name}") if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])


def process(spark: SparkSession, name: str, **options: Any) -> Program:
    """The relations of a registered processor in the common schema."""
    if name not in _PROCESSORS:
        raise KeyError(f"no processor named {name}")
    made = _PROCESSORS[name](spark, **options)
    if not {"sessions", "talks"} <= set(made) or set(made) - set(RELATIONS):
        raise SchemaProblem(f"{name}: relations {', '.join(sorted(made))}")
    return {r: conformed(df, r) for r, df in made.items()}


def problems(made: Program) -> DataFrame:
    """(conference_name, relation, id, problem) of the rows that break the contract: no id, an id twice, a time that isn't one or
    ends before it starts, a talk of a session that isn't there, a listed talk that isn't there, an author's number
    without institution, an institution number twice, a type that the registry doesn't have (where there is one)."""
    name, found = "conference_name", []

    def report(df: DataFrame, relation: str, checks: dict[str, Column]) -> None:
        said = F.filter(F.array(*[F.when(c, F.lit(p)) for p, c in checks.items()]), lambda p: p.isNotNull())
        found.append(df.select(name, F.lit(relation).alias("relation"), "id", F.explode(said).alias("problem")))

    start, end = F.try_to_timestamp("start_ts"), F.try_to_timestamp("end_ts")
    timed = lambda c, at: F.coalesce((F.trim(c) != "") & at.isNull(), F.lit(False))
    common = {"no id": F.coalesce(F.trim("id") == "", F.lit(True)), "start is no time": timed("start_ts", start), "end is no time": timed("end_ts", end), "ends before it starts": F.coalesce(end < start, F.lit(False))}
    numbers = F.coalesce(F.transform("institutions", lambda i: i["n"]), F.array().cast("array<int>"))
    cited = F.coalesce(F.flatten(F.transform("authors", lambda a: F.coalesce(a["insts"], F.array().cast("array<int>")))), F.array().cast("array<int>"))
    report(made["sessions"], "sessions", common)
    report(made["talks"], "talks", common | {"author cites a missing institution": F.size(F.array_except(cited, numbers)) > 0, "institution number twice": F.size(F.array_distinct(numbers)) < F.size(numbers)})
    for relation in ("sessions", "talks"):
        twice = made[relation].where("trim(id) != ''").groupBy(name, "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(twice.select(name, F.lit(relation).alias("relation"), "id", F.lit("id twice").alias("problem")))
    sessions, talks = made["sessions"].select(name, "id"), made["talks"].select(name, "id")
    orphans = made["talks"].where("session_id is not null").select(name, "id", "session_id").join(sessions.withColumnRenamed("id", "session_id").hint("merge"), [name, "session_id"], "left_anti")
    found.append(orphans.select(name, F.lit("talks").alias("relation"), "id", F.lit("session isn't there").alias("problem")))
    listed = made["sessions"].select(name, F.col("id").alias("session"), F.explode("talk_ids").alias("id")).join(talks.hint("merge"), [name, "id"], "left_anti")
    found.append(listed.select(name, F.lit("sessions").alias("relation"), F.col("session").alias("id"), F.lit("listed talk isn't there").alias("problem")).distinct())
    for relation, types in (("sessions", "session_types"), ("talks", "talk_types")):
        if types in made:
            odd = made[relation].where("color is not null").join(made[types].select(name, F.col("id").alias("color")).hint("merge"), [name, "color"], "left_anti")
            found.append(odd.select(name, F.lit(relation).alias("relation"), "id", F.lit("type isn't registered").alias("problem")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def documents(made: Program) -> DataFrame:
    """(conference_name, document): each program as one JSON document, sessions and talks in order of `pos`, nulls left out."""
    parts = None
    for relation in ("sessions", "talks", "session_types", "talk_types"):
        if relation in made:
            body = F.struct(*[c for c in RELATIONS[relation].names if c not in ("conference_name", "pos")])
            listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json(body).alias("body")))), lambda x: x["body"])
            one = made[relation].groupBy("conference_name").agg(listed.alias(relation))
            parts = one if parts is None else parts.join(one.hint("merge"), "conference_name", "full")
    fields = [F.concat(F.lit(f'"{r}":['), F.coalesce(F.array_join(r, ","), F.lit("")), F.lit("]")) for r in RELATIONS if r in made]
    head = F.concat(F.lit('"conference_name":'), F.get(F.split(F.to_json(F.struct(F.col("conference_name").alias("v"))), '^\\{"v":|\\}$'), F.lit(1)))
    return parts.select("conference_name", F.concat(F.lit("{"), F.concat_ws(",", head, *fields), F.lit("}")).alias("document"))


def write_documents(made: Program, folder: str, packed: bool = False) -> None:
    """The programs as a folder of documents, `packed`: compressed; what lies there goes."""
    made["sessions"].sparkSession.dataSource.register(ProgramDocuments)
    documents(made).write.format("program").option("packed", packed).mode("overwrite").save(folder)


def read_documents(spark: SparkSession, folder: str, relation: str) -> DataFrame:
    """A relation of the programs in a folder, or `broken`: lines that are no document."""
    spark.dataSource.register(ProgramDocuments)
    return spark.read.format("program").option("relation", relation).load(folder)


def _store(folder: str):
    """(file system, path) of a folder in any store that Arrow reads."""
    from pyarrow import fs

    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


@dataclass
class _Share(InputPartition):
    files: tuple[str, ...]

    def __init__(self, files: tuple[str, ...]):
        super().__init__(None)
        self.files = files


@dataclass
class _Made(WriterCommitMessage):
    draft: str
    final: str


class ProgramDocuments(DataSource):
    """Folders of program documents, one JSON document a line."""

    @classmethod
    def name(cls) -> str:
        return "program"

    def schema(self) -> T.StructType:
        relation = self.options.get("relation", "talks")
        if relation == "broken":
            return BROKEN
        if relation not in RELATIONS:
            raise SchemaProblem(f"no relation named {relation}")
        return RELATIONS[relation]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("relation", "talks"), schema, int(self.options.get("share_bytes", 32 << 20)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if schema.names != ["conference_name", "document"]:
            raise SchemaProblem("the columns to write are conference_name and document")
        return _Writer(self.options["path"], overwrite, str(self.options.get("packed", "false")).lower() == "true")


class _Reader(DataSourceReader):
    def __init__(self, folder: str, relation: str, schema: T.StructType, share: int):
        self.folder, self.relation, self.fields, self.share = folder, relation, schema, share

    def partitions(self) -> list[InputPartition]:
        """Files in shares of about `share_bytes` of text, a larger file alone."""
        from pyarrow import fs

        store, path = _store(self.folder)
        found = sorted((f.path, (f.size or 0) * (1 if f.path.endswith(".jsonl") else _PACKED)) for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.path.endswith(_NAMES))
        shares, held, size = [], [], 0
        for name, n in found:
            if held and size + n > self.share:
                shares, held, size = [*shares, _Share(tuple(held))], [], 0
            held, size = [*held, name], size + n
        return [*shares, _Share(tuple(held))]

    def read(self, partition: InputPartition) -> Iterator[Any]:
        """The rows in Arrow batches of BATCH_ROWS, which Spark takes as they are."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        store, _ = _store(self.folder)
        schema = to_arrow_schema(self.fields)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        held: list[tuple] = []
        for name in partition.files:
            with store.open_input_stream(name, compression="detect") as stream:
                for line in _lines(stream):
                    for row in self._rows(name, line):
                        held.append(row)
                        if len(held) == BATCH_ROWS:
                            yield batch(held)
                            held = []
        if held:
            yield batch(held)

    def _rows(self, file: str, line: str) -> Iterator[tuple]:
        try:
            document = json.loads(line)
            if not isinstance(document, dict):
                raise ValueError("no object")
        except ValueError as e:
            if self.relation == "broken":
                yield file.rsplit("/", 1)[-1], line, str(e)
            return
        if self.relation != "broken":
            fields = [(f.name, f.dataType, type(f.dataType) is T.StringType) for f in self.fields.fields[2:]]
            for pos, item in enumerate(document.get(self.relation) or []):
                values = [(item or {}).get(name) for name, _, _ in fields]
                yield _value(document.get("conference_name"), T.StringType()), pos, *(v if v is None or text and type(v) is str else _value(v, kind) for v, (_, kind, text) in zip(values, fields))


def _lines(stream: Any) -> Iterator[str]:
    """The lines of a stream, a block of it at a time."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (w.decode() for w in whole if w.strip())
    if rest.strip():
        yield rest.decode()


def _value(x: Any, kind: T.DataType) -> Any:
    """A JSON value as the schema has it; null where it is of another kind."""
    if x is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_value(y, kind.elementType) for y in x] if isinstance(x, list) else None
    if isinstance(kind, T.StructType):
        return {f.name: _value(x.get(f.name), f.dataType) for f in kind} if isinstance(x, dict) else None
    if isinstance(kind, T.BooleanType):
        return x if isinstance(x, bool) else None
    if isinstance(kind, T.IntegerType):
        return int(x) if isinstance(x, int) and not isinstance(x, bool) else None
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool, packed: bool):
        self.folder, self.overwrite, self.packed = folder, overwrite, packed

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """A task's documents as a draft, which readers don't see."""
        store, path = _store(self.folder)
        store.create_dir(path, recursive=True)
        final = f"{path}/part-{uuid.uuid4().hex}.jsonl" + (".zst" if self.packed else "")
        with store.open_output_stream(final + ".draft", compression="zstd" if self.packed else None) as out:
            for row in iterator:
                out.write((row.document + "\n").encode())
        return _Made(final + ".draft", final)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, path = _store(self.folder)
        if self.overwrite:
            made = {m.draft for m in messages if m}
            for f in store.get_file_info(fs.FileSelector(path)):
                if f.type == fs.FileType.File and f.path.endswith((*_NAMES, ".draft")) and f.path not in made:
                    store.delete_file(f.path)
        for m in messages:
            if m:
                store.move(m.draft, m.final)

    def abort(self, messages: list) -> None:
        store, _ = _store(self.folder)
        for m in messages:
            if m:
                store.delete_file(m.draft)
