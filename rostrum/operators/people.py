"""Operators on people: name repair everywhere, matching, affiliations and bylines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators.matching import edit_distance_join
from rostrum.operators.shared import hinted, written
from rostrum.operators.titles import title_form


def _repair(c: Column) -> Column:
    return T.repaired_name(T.given_first(c))


def repair_all(df: DataFrame, plain: Sequence[str] = (), arrays: Sequence[str] = (), joined: Sequence[str] = (), separator: str = "; ") -> DataFrame:
    """Names repaired in plain columns, arrays and separator-joined lists; `names_changed` counts the values changed."""
    new = {c: _repair(F.col(c)) for c in plain}
    new |= {c: F.transform(c, _repair) for c in arrays}
    new |= {c: F.array_join(F.transform(F.split(c, separator), _repair), separator) for c in joined}
    differs = lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1)
    count = lambda xs: F.size(F.filter(xs, lambda x: ~x.eqNullSafe(_repair(x))))
    changed = [differs(F.col(c), new[c]) for c in plain] + [count(F.col(c)) for c in arrays] + [count(F.split(c, separator)) for c in joined]
    return df.withColumns(new | {"names_changed": sum(changed, F.lit(0))})


def upgrade_names(left: DataFrame, right: DataFrame, record: str, name: str, pos: str) -> DataFrame:
    """Names of `left` become the fuller form that `right` has in the same record under the same initial and surname
    (the first such by `pos`); a record where no name improves stays as it is. Both: (record, pos, name)."""
    key = lambda df: df.withColumn("key", T.initial_surname(F.col(name)))
    first = key(right).groupBy(record, "key").agg(F.min_by(name, pos).alias("other"))
    both = key(left).join(first, [record, "key"], "left")
    fuller = F.length(F.col("other")) > F.length(F.col(name))
    better = F.bool_or(F.coalesce(fuller, F.lit(False))).over(W.partitionBy(record))
    return both.select(record, pos, F.when(better & fuller, F.col("other")).otherwise(F.col(name)).alias(name))


def layered_match(left: DataFrame, right: DataFrame, asked: tuple[str, str], known: tuple[str, str], value: str, pos: str, most: int = 2) -> DataFrame:
    """`left` with `pass` and the `value` of the first pass that hits: 1 equal folded names, 2 names within `most` edits,
    3 surname and initial, 4 title; both are null where none hits.

    `asked` and `known` are (name, title) columns of left and right. Right rows without a value count for nothing; of several that
    hit in a pass the first by `pos` (unique) wins. Null and blank names or titles match nothing. Edits are sought for the distinct
    names only that no exact name answers. A `pass` or `value` column of `left` is replaced."""
    blank = lambda c: F.nullif(c, F.lit(""))
    name = lambda c: blank(T.squeezed(T.fold(F.col(c))))
    key = lambda c: F.when(name(c).isNotNull(), T.surname_initial(F.col(c)))
    title = lambda c: blank(title_form(F.col(c)))
    filled = right.where(F.col(value).isNotNull() & (F.col(value) != ""))
    index = filled.select(name(known[0]).alias("_n"), key(known[0]).alias("_k"), title(known[1]).alias("_t"), F.struct(F.col(pos).alias("pos"), F.col(value).alias("value")).alias("_hit"))
    first = lambda c, to: index.where(F.col(c).isNotNull()).groupBy(c).agg(F.min_by("_hit", "_hit.pos").alias(to))
    names = first("_n", "_1")
    rows = left.withColumns({"_n": name(asked[0]), "_k": key(asked[0]), "_t": title(asked[1])}).join(names.hint("merge"), "_n", "left")
    open_names = left.select(name(asked[0]).alias("_n")).where("_n IS NOT NULL").distinct().join(names.select("_n").hint("merge"), "_n", "left_anti")
    near = edit_distance_join(open_names, names.select(F.col("_n").alias("_m"), F.col("_1").alias("_2")), "_n", "_m", most)
    best = near.groupBy("_n").agg(F.min_by("_2", "_2.pos").alias("_2"))
    for hit, c in ((best, "_n"), (first("_k", "_3"), "_k"), (first("_t", "_4"), "_t")):
        rows = rows.join(hit.hint("merge"), c, "left")
    hits = [F.col(f"_{i}") for i in range(1, 5)]
    which = F.coalesce(*[F.when(h.isNotNull(), F.lit(i)) for i, h in enumerate(hits, 1)])
    return rows.withColumns({"pass": which, value: F.coalesce(*hits)["value"]}).drop("_n", "_k", "_t", "_1", "_2", "_3", "_4")


#: Pairs of two names that one part lists; names with more are listed in several parts.
PART_PAIRS = 1 << 22


def match_people(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str, most: int = PART_PAIRS) -> DataFrame:
    """Pairs (left_id, right_id) with equal surnames and consistent given names. Not transitive, so never a basis for groups.

    Distinct parsed names are joined on the surname and checked once; then the rows of two names that agree are joined. Two names
    with more than `most` pairs of rows are spread over parts: rows of the more frequent one by a hash, the other's go to all."""
    rows = lambda df, i, p: df.select(i, T.person(F.col(name)).alias(p)).where(F.col(p)["surname"] != "")
    a, b = rows(left, left_id, "_a"), rows(right, right_id, "_b")
    names = lambda df, p, n: df.groupBy(p).agg(F.count(F.lit(1)).alias(n)).withColumn("surname", F.col(p)["surname"])
    agree = names(a, "_a", "_m").join(names(b, "_b", "_n").hint("merge"), "surname").where(T.consistent_given(F.col("_a.given"), F.col("_b.given")))
    agree = written(agree.select("_a", "_b", F.ceil(F.col("_m") * F.col("_n") / most).cast("int").alias("_parts"), (F.col("_m") >= F.col("_n")).alias("_by_left")), "agreeing-names")
    every = F.sequence(F.lit(0), F.col("_parts") - 1)
    part = lambda i, hashed: F.when(hashed, F.array(F.pmod(F.xxhash64(i), F.col("_parts")).cast("int"))).otherwise(every)
    side = lambda df, p, i, hashed: df.join(hinted(agree, 512), p).select(i, "_a", "_b", F.explode(part(i, hashed)).alias("_part"))
    own, other = side(a, "_a", left_id, F.col("_by_left")), side(b, "_b", right_id, ~F.col("_by_left"))
    return own.join(other.hint("merge"), ["_a", "_b", "_part"]).select(left_id, right_id)


def surname_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str, kind: str) -> DataFrame:
    """Each left person's best right one of the same surname: same initial first, then the kind in order, then the
    smallest id. The best of each (surname, initial) and of each surname are found first, so a common surname is a few rows."""
    parts = lambda df: df.withColumn("key", T.surname_initial(F.col(name)))
    a = parts(left).select(left_id, F.split("key", r"\|")[0].alias("surname"), F.split("key", r"\|")[1].alias("a_initial"))
    b = parts(right).select(right_id, kind, F.split("key", r"\|")[0].alias("surname"), F.split("key", r"\|")[1].alias("b_initial"))
    rank = F.struct(kind, right_id)
    own = b.groupBy("surname", F.col("b_initial").alias("a_initial")).agg(F.min_by(right_id, rank).alias("own"))
    other = b.groupBy("surname").agg(F.min_by(right_id, rank).alias("other"))
    found = a.join(other.hint("merge"), "surname").join(own.hint("merge"), ["surname", "a_initial"], "left")
    return found.select(left_id, F.coalesce("own", "other").alias(right_id))


def mode_unless_tied(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most common non-null value of each key; null where the first two tie. Counts are aggregated before any
    ranking, so a key with many rows is a few counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.max_by(F.col(value), F.struct("n", value)).alias(value), F.max("n").alias("top"))
    ties = counts.join(best.select(*keys, "top").hint("merge"), [*keys]).where("n = top").groupBy(*keys).agg(F.count(F.lit(1)).alias("winners"))
    return best.join(ties.hint("merge"), [*keys]).select(*keys, F.when(F.col("winners") == 1, F.col(value)).alias(value))


def backfill(df: DataFrame, keys: Sequence[str], value: str, known: DataFrame | None = None) -> DataFrame:
    """Empty values filled with their key's mode_unless_tied over `known` (or the table itself)."""
    present = F.nullif(F.col(value), F.lit(""))
    votes = mode_unless_tied((known if known is not None else df).withColumn(value, present), keys, value).withColumnRenamed(value, "voted")
    return df.join(votes.hint("merge"), [*keys], "left").withColumn(value, F.coalesce(present, "voted")).drop("voted")


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<struct<name:string,insts:array<int>>>"))


def backfill_speakers(talks: DataFrame, speaker: str = "speaker", aff: str = "speaker_aff", authors: str = "authors", institutions: str = "institutions", shorts: str = "inst_shorts") -> DataFrame:
    """`talks` with empty speaker affiliations filled by the speaker's most common one over all talks (none on a tie), and
    the filled one mirrored into the talk: where the speaker's author entry (the first of that name) has no institution, it gets
    the number of the institution with that short name, or of a new one with the largest number + 1.

    authors: array of (name, insts array<int>), institutions: array of (n, name, alt_names), shorts: their short names in the
    same order; nulls are empty arrays. Names are keyed by initial and surname. A talk without a speaker, or whose speaker has no
    vote, stays as it is; a speaker who is no author gets the institution only."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    people, places = _filled(F.col(authors)), F.coalesce(institutions, none("struct<n:int,name:string,alt_names:array<string>>"))
    base = talks.withColumns({authors: people, institutions: places, shorts: F.coalesce(shorts, none("string"))})
    short_of = lambda n: F.trim(F.get(shorts, F.array_position(F.transform(institutions, lambda i: i["n"]), n).cast("int") - 1))
    said = base.select(F.explode(F.transform(authors, lambda a: F.struct(T.initial_surname(a["name"]).alias("key"), F.transform(F.coalesce(a["insts"], none("int")), short_of).alias("affs")))).alias("x"))
    votes = mode_unless_tied(said.select("x.key", F.explode("x.affs").alias("_voted")).where("trim(_voted) != '' and trim(key) != ''"), ["key"], "_voted").where("_voted is not null")
    named = F.when(F.trim(F.coalesce(speaker, F.lit(""))) != "", T.initial_surname(F.col(speaker)))
    # few voters are broadcast: a shuffle by speaker would put all talks of one name, or of none, into one task
    out = base.withColumn("_key", named).join(hinted(written(votes.withColumnRenamed("key", "_key"), "votes")), "_key", "left")
    out = out.withColumn("_entry", F.coalesce(F.array_position(F.transform(authors, lambda a: T.initial_surname(a["name"])), F.col("_key")), F.lit(0)).cast("int"))
    empty = F.trim(F.coalesce(aff, F.lit(""))) == ""
    own = F.coalesce(F.size(F.get(authors, F.col("_entry") - 1)["insts"]), F.lit(0)) > 0
    out = out.withColumns({"_fill": empty & F.col("_voted").isNotNull(), "_at": F.coalesce(F.array_position(F.transform(shorts, lambda s: F.trim(s)), F.col("_voted")), F.lit(0)).cast("int"), "_own": F.when(F.col("_entry") > 0, own).otherwise(False)})
    out = out.withColumn("_n", F.when(F.col("_at") > 0, F.get(institutions, F.col("_at") - 1)["n"]).otherwise(F.coalesce(F.array_max(F.transform(institutions, lambda i: i["n"])), F.lit(0)) + 1))
    mirror = F.col("_fill") & ~F.col("_own")
    added = F.array(F.struct(F.col("_n").alias("n"), F.col("_voted").alias("name"), none("string").alias("alt_names")))
    linked = F.transform(authors, lambda a, i: F.when(i + 1 == F.col("_entry"), F.struct(a["name"].alias("name"), F.array("_n").alias("insts"))).otherwise(a))
    return out.withColumns({
        authors: F.when(mirror, linked).otherwise(F.col(authors)),
        institutions: F.when(mirror & (F.col("_at") == 0), F.concat(institutions, added)).otherwise(F.col(institutions)),
        shorts: F.when(mirror & (F.col("_at") == 0), F.array_append(shorts, F.col("_voted"))).otherwise(F.col(shorts)),
        aff: F.when(F.col("_fill"), F.col("_voted")).otherwise(F.col(aff)),
    }).select(*talks.columns)


def renumber_institutions(talks: DataFrame, allowed: str, authors: str = "authors", institutions: str = "institutions", shorts: str = "inst_shorts") -> DataFrame:
    """`talks` in which, where `allowed` is true, institutions of one short name (trimmed) are one, the first, numbered from 1 in
    order, and the authors' numbers follow, each once in order. Numbers of no institution are dropped; blank short names stay
    apart by their own number. Other talks stay as they are."""
    old = F.transform(institutions, lambda i: i["n"])
    keys = F.transform(institutions, lambda i, at: F.when(F.trim(F.coalesce(F.get(shorts, at), F.lit(""))) != "", F.trim(F.get(shorts, at))).otherwise(F.concat(F.lit("\x00"), i["n"].cast("string"))))
    out = talks.withColumns({"_old": old, "_keys": keys, "_first": F.array_distinct(keys)})
    kept = F.transform("_first", lambda k, at: F.get(institutions, F.array_position("_keys", k).cast("int") - 1).withField("n", at + 1))
    names = F.transform("_first", lambda k: F.get(shorts, F.array_position("_keys", k).cast("int") - 1))
    place = lambda n: F.array_position("_first", F.get("_keys", F.array_position("_old", n).cast("int") - 1)).cast("int")
    redirect = lambda insts: F.array_distinct(F.filter(F.transform(F.filter(insts, lambda n: F.array_contains("_old", n)), place), lambda n: n > 0))
    moved = F.transform(authors, lambda a: a.withField("insts", redirect(a["insts"])))
    yes = F.coalesce(F.col(allowed), F.lit(False))
    return out.withColumns({authors: F.when(yes, moved).otherwise(F.col(authors)), institutions: F.when(yes, kept).otherwise(F.col(institutions)), shorts: F.when(yes, names).otherwise(F.col(shorts))}).select(*talks.columns)


def speaker(row: dict[str, Column]) -> Column:
    """The first filled of the sources, best first."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in row.values()])


def byline(authors: Column, talker: Column, affiliation: Column) -> Column:
    """`First … [Speaker] … Last — affiliation`: one author once, the speaker only where in the middle."""
    first, last = F.try_element_at(authors, F.lit(1)), F.try_element_at(authors, F.lit(-1))
    middle = F.when((talker != first) & (talker != last) & F.array_contains(authors, talker), F.concat(F.lit("["), talker, F.lit("]")))
    names = F.when(F.size(authors) <= 1, first).otherwise(F.concat_ws(" … ", first, middle, last))
    return F.concat_ws(" — ", names, F.nullif(affiliation, F.lit("")))


def shown_authors(authors: Column, talker: Column, wanted: Column) -> Column:
    """Positions that must be shown: first, last, the speaker and every hit, in order."""
    at = F.transform(authors, lambda a, i: F.when((i == 0) | (i == F.size(authors) - 1) | (a == talker) | F.contains(T.fold(a), T.fold(wanted)), i))
    return F.array_compact(at)


def shared_affiliation(of_speaker: Column, of_last: Column, speaker_is_last: Column) -> Column:
    """A speaker's affiliation: the first that the last author has too, else the speaker's first, else the last
    author's first."""
    common = F.try_element_at(F.array_intersect(of_speaker, of_last), F.lit(1))
    return F.coalesce(F.when(~speaker_is_last, common), F.try_element_at(of_speaker, F.lit(1)), F.try_element_at(of_last, F.lit(1)))


def speaker_affiliation(speaker: Column, authors: Column, institutions: Column) -> Column:
    """The short affiliation to show for a speaker, of authors (array of name, insts) and institutions (array of n, short).

    The speaker's (first author of that folded name) first affiliation; of several the first that the last author has too. A
    speaker without one, who isn't the last author, in a talk where anybody has numbers, gets the last author's first. Else
    the first institution, null without any. Numbers of no institution count for nothing, null arrays as empty."""
    people_ = F.coalesce(authors, F.array().cast("array<struct<name:string,insts:array<int>>>"))
    places = F.coalesce(institutions, F.array().cast("array<struct<n:int,short:string>>"))
    folded = lambda c: F.nullif(T.squeezed(T.fold(c)), F.lit(""))
    short = lambda n: F.try_element_at(F.filter(places, lambda p: p["n"] == n), F.lit(1))["short"]
    shorts = lambda a: F.array_distinct(F.array_compact(F.transform(F.coalesce(a["insts"], F.array().cast("array<int>")), short)))
    own = shorts(F.try_element_at(F.filter(people_, lambda a: F.coalesce(folded(a["name"]) == folded(speaker), F.lit(False))), F.lit(1)))
    last = F.try_element_at(people_, F.lit(-1))
    common = F.when(F.size(own) > 1, F.try_element_at(F.array_intersect(own, shorts(last)), F.lit(1)))
    numbered = F.exists(people_, lambda a: F.size(F.coalesce(a["insts"], F.array().cast("array<int>"))) > 0)
    is_last = F.coalesce(folded(last["name"]) == folded(speaker), F.lit(False))
    senior = F.when(numbered & ~is_last, F.try_element_at(shorts(last), F.lit(1)))
    return F.coalesce(common, F.try_element_at(own, F.lit(1)), senior, F.try_element_at(places, F.lit(1))["short"])


def chosen_speaker(scraped: Column, underlined: Column, presenter: Column, authors: Column) -> Column:
    """Struct (speaker, source, position): the first name there is of the scraped one (`fuller` where it is longer than the
    presenter's), the first underlined one (separated by semicolons), the presenter and the first author.

    `position` is the speaker's place among the authors by folded name, from 0, or -1. Blank names are none; without any, speaker and
    source are null. Null authors count as an empty list."""
    full = lambda c: F.nullif(T.squeezed(c), F.lit(""))
    names = F.coalesce(authors, F.array().cast("array<string>"))
    seen, shown, first = full(scraped), full(presenter), full(F.try_element_at(names, F.lit(1)))
    marked = full(F.split(underlined, ";")[0])
    speaker = F.coalesce(seen, marked, shown, first)
    fuller = F.length(seen) > F.coalesce(F.length(shown), F.lit(0))
    source = F.when(fuller & shown.isNotNull(), "fuller").when(seen.isNotNull(), "scraped").when(marked.isNotNull(), "underlined").when(shown.isNotNull(), "presenter").when(first.isNotNull(), "first")
    at = F.array_position(F.transform(names, lambda n: T.squeezed(T.fold(n))), T.fold(speaker)).cast("int") - 1
    return F.struct(speaker.alias("speaker"), source.alias("source"), F.coalesce(at, F.lit(-1)).alias("position"))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(surname, initial, value) of tab-separated files with `#` comments; initials in upper case, rows with a blank field left
    out. Of several rows of one key the smallest value counts."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="surname string, initial string, value string", quote="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = raw.select(F.trim("surname").alias("surname"), F.upper(F.trim("initial")).alias("initial"), F.trim("value").alias("value"))
    return rows.where("surname != '' AND initial != '' AND value != ''").groupBy("surname", "initial").agg(F.min("value").alias("value"))


def overridden(df: DataFrame, name: str, value: str, overrides: DataFrame) -> DataFrame:
    """`df` with `value` from `overrides` (surname, initial, value) where the last piece of the name and its first letter in upper case
    have one. Null names have none; the overrides are broadcast where their counted size allows."""
    turned = T.squeezed(T.given_first(F.col(name)))
    keyed = df.withColumns({"_surname": F.element_at(F.split(turned, " "), -1), "_initial": F.upper(F.substring(turned, 1, 1))})
    own = overrides.select(F.col("surname").alias("_surname"), F.col("initial").alias("_initial"), F.col("value").alias("_own"))
    return keyed.join(hinted(own), ["_surname", "_initial"], "left").withColumn(value, F.coalesce("_own", value)).select(df.columns)
