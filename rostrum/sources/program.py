"""Readers and writers of program data: nested JSON, headered CSV, pages, tab-separated maps, envelopes, rule files and
folders of inputs. Files are listed and read by Spark, so any store that it reads will do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TAG = _struct(key=_S, value=_S)
AUTHOR = _struct(name=_S, insts=T.ArrayType(T.IntegerType()))
INSTITUTION = _struct(n=T.IntegerType(), name=_S, alt_names=T.ArrayType(_S))
TYPE = _struct(id=_S, label=_S, fg=_S, bg_light=_S, bg_dark=_S)
SESSION = _struct(
    id=_S, title=_S, color=_S, tags=T.ArrayType(TAG), start_ts=_S, end_ts=_S, location=_S, short_location=_S, presider=_S, presider_aff=_S, details=_S, talk_ids=T.ArrayType(_S)
)
TALK = _struct(
    id=_S, session_id=_S, title=_S, color=_S, number=_S, start_ts=_S, end_ts=_S, location=_S, short_location=_S, speaker=_S, speaker_pos=T.IntegerType(), presenter=_S, first_author=_S, last_author=_S,
    authors=T.ArrayType(AUTHOR), author_aliases=T.ArrayType(_S), institutions=T.ArrayType(INSTITUTION), institutions_may_dedup=T.BooleanType(), abstract=_S, status=_S, withdrawn=T.BooleanType(),
)
PROGRAM = _struct(
    conference_name=_S, curator=_struct(name=_S, affiliation=_S, link=_S), sessions=T.ArrayType(SESSION), talks=T.ArrayType(TALK), session_types=T.ArrayType(TYPE), talk_types=T.ArrayType(TYPE), affiliation_sources=T.ArrayType(_S)
)


def read_program(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """The relations of program documents: sessions, talks (each with its place `pos` in the document), types and
    affiliation sources. Missing fields are null; a missing location stays apart from a blank one. Documents of one line
    each (`multi_line` False) are split among tasks."""
    doc = spark.read.schema(PROGRAM).option("multiLine", multi_line).json(path)
    part = lambda c: doc.select("conference_name", F.posexplode(c).alias("pos", "x")).select("conference_name", "pos", "x.*")
    out = {c: part(c) for c in ("sessions", "talks", "session_types", "talk_types")}
    out["affiliation_sources"] = doc.select("conference_name", F.explode("affiliation_sources").alias("raw"))
    return out


def write_program(df: DataFrame, path: str, unused: Sequence[str] = (), nested: dict[str, Sequence[str]] | None = None) -> None:
    """Compact JSON lines without columns and nested fields that nothing reads; nulls are left out."""
    for column, fields in (nested or {}).items():
        df = df.withColumn(column, F.col(column).dropFields(*fields))
    df.drop(*unused).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV with quoted line ends: every field trimmed, a byte order mark off the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c.lstrip("﻿").strip()) for c in df.columns])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of saved pages, one file each."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of a folder's files, read only where asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")


def glob_pattern(glob: Column) -> Column:
    """A glob as a pattern: `*` and `?` within a name."""
    escaped = F.regexp_replace(glob, r"([.+()\[\]{}^$|\\])", r"\\$1")
    return F.concat(F.lit("(^|/)"), F.regexp_replace(F.regexp_replace(escaped, r"\*", "[^/]*"), r"\?", "[^/]"), F.lit("$"))


def missing_inputs(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Required entries of the manifest (pattern, required) that no file's path matches. The manifest is the small side."""
    required = manifest.where("required").withColumn("_re", glob_pattern(F.col("pattern")))
    there = found.select("path").join(F.broadcast(required.select("pattern", "_re")), F.expr("path rlike _re")).select("pattern").distinct()
    return required.join(there, "pattern", "left_anti").drop("_re")


def digest_of(rows: DataFrame, parts: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, digest): one digest of all rows' parts for each key, whatever their order. Each row's digest is summed up
    in four lanes, so tasks pass on a few numbers a key and no list of rows is ever gathered."""
    one = F.sha2(F.concat_ws("\t", *parts), 256)
    lanes = [F.sum(F.conv(F.substring("_one", at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 17, 33, 49)]
    total = F.concat_ws("-", F.count(F.lit(1)).cast("string"), *[lane.cast("string") for lane in lanes])
    return rows.withColumn("_one", one).groupBy(*keys).agg(F.sha2(total, 256).alias("digest"))


def fingerprint(found: DataFrame, root: str = "", excluded: str | None = None) -> DataFrame:
    """(digest): one digest of all (path below `root`, content). Files are digested where they are."""
    named = found.select(F.replace("path", F.lit(root), F.lit("")).alias("p"), F.sha2("content", 256).alias("h"))
    if excluded:
        named = named.where(~F.col("p").rlike(excluded))
    return digest_of(named, [F.col("p"), F.col("h")])


def changed_since(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose (key, digest of all columns) isn't in `known` (key, digest)."""
    digested = rows.withColumn("digest", row_digest(rows))
    return digested.join(known.select(key, "digest"), [key, "digest"], "left_anti")


def row_digest(rows: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)


def map_lines(mapping: DataFrame, raw: str = "raw", short: str = "short") -> DataFrame:
    """(raw, short) with tabs and line ends in values blanked."""
    blank = lambda c: F.regexp_replace(c, "[\t\r\n]", " ").alias(c)
    return mapping.select(blank(raw), blank(short))


def write_map_tsv(mapping: DataFrame, path: str) -> None:
    """One `raw<TAB>short` line each, sorted by raw."""
    map_lines(mapping).orderBy("raw").write.mode("overwrite").option("sep", "\t").option("quote", "\u0000").csv(path)


def encode_envelope(state: Column, version: str = "CONF1:") -> Column:
    """The version mark and the state's JSON in base64."""
    return F.concat(F.lit(version), F.replace(F.base64(F.to_json(state).cast("binary")), F.lit("\r\n"), F.lit("")))


def decode_envelope(lines: DataFrame, line: str, schema: str, version: str = "CONF1:") -> tuple[DataFrame, DataFrame]:
    """(good, bad): states parsed by `schema`, and lines of another version or content. One wrapping pair of quotes is
    taken off."""
    bare = F.regexp_replace(F.trim(line), r"""^(["'])(.*)\1$""", "$2")
    body = F.when(F.startswith(bare, F.lit(version)), F.substring(bare, len(version) + 1, 1 << 30))
    parsed = lines.withColumn("state", F.from_json(F.try_to_binary(body, F.lit("base64")).cast("string"), schema, {"mode": "PERMISSIVE"}))
    fine = F.col("state").isNotNull() & F.coalesce(F.col("state")[schema.split()[0]].isNotNull(), F.lit(False))
    return parsed.where(fine), parsed.where(~fine).drop("state")


def rule_lines(lines: DataFrame, line: str = "value", comment: str = "#.*$") -> DataFrame:
    """(pattern): runtime rules, without comments and blank lines. Where rules contain the comment sign, `comment` says
    how a comment looks instead."""
    return lines.select(F.trim(F.regexp_replace(line, comment, "")).alias("pattern")).where("pattern != ''")


def read_rules(spark: SparkSession, path: str, comment: str = "#.*$") -> DataFrame:
    return rule_lines(spark.read.text(path), comment=comment)


def notes_report(items: DataFrame, notes: DataFrame, owner: str, item: str, at: str, title: str, note: str) -> DataFrame:
    """(owner, report): each owner's items in order, `id, title` and the note indented below."""
    both = items.join(notes.select(owner, item, note), [owner, item], "left")
    line = F.concat_ws("\n", F.concat_ws(", ", F.col(item).cast("string"), title), F.when(F.length(F.trim(note)) > 0, F.concat(F.lit("    "), note)))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at), F.col(item), line.alias("line"))))
    return both.groupBy(owner).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("report"))


def full_notes_report(items: DataFrame, notes: DataFrame, owner: str, item: str, at: str, title: str, authors: str, speaker: str, note: str) -> DataFrame:
    """(owner, report): the owner's general notes (those of a null item) first, then the items with a note by `at` (nulls last) and id, each as
    `id, title, authors` and the note's lines indented, a blank line behind each.

    Authors are an array, joined by semicolons, the speaker (case and blanks don't count) marked by an asterisk; an item without a
    title is `(untitled)`. Blank notes count for nothing; an owner without notes gets `(No notes yet.)`. Several notes of
    one item follow each other in their own order."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    names = F.filter(F.transform(authors, lambda a: F.trim(a)), lambda a: a != "")
    marked = F.array_join(F.transform(names, lambda a: F.when(key(a) == key(F.col(speaker)), F.concat(a, F.lit("*"))).otherwise(a)), "; ")
    head = F.concat_ws(", ", F.col(item).cast("string"), F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("(untitled)")), F.nullif(marked, F.lit("")))
    own = notes.select(owner, item, F.regexp_replace(note, r"^\s+|\s+$", "").alias("_note")).where("_note != ''")
    block = lambda top: F.concat(top, F.lit("\n  "), F.replace("_note", F.lit("\n"), F.lit("\n  ")), F.lit("\n"))
    heads = items.select(owner, item, F.col(at).alias("_at"), head.alias("_head"))
    of_items = heads.join(own.hint("merge"), [owner, item]).select(owner, F.struct(F.lit(1).alias("general"), F.col("_at").isNull().alias("late"), F.col("_at").alias("at"), F.col(item).alias("id"), block(F.col("_head")).alias("text")).alias("_b"))
    kinds = {f.name: f.dataType for f in of_items.schema["_b"].dataType.fields}
    none = lambda n: F.lit(None).cast(kinds[n]).alias(n)
    general = own.where(F.col(item).isNull()).select(owner, F.struct(F.lit(0).alias("general"), F.lit(False).alias("late"), none("at"), none("id"), block(F.lit("General notes")).alias("text")).alias("_b"))
    blocks = of_items.unionByName(general).groupBy(owner).agg(F.array_sort(F.collect_list("_b")).alias("_all"))
    owners = items.select(owner).unionByName(notes.select(owner)).distinct()
    report = F.array_join(F.transform("_all", lambda b: b["text"]), "\n")
    return owners.join(blocks.hint("merge"), owner, "left").select(owner, F.coalesce(report, F.lit("(No notes yet.)")).alias("report"))
