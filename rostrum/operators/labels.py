"""Short labels of institutions: ordered rewriting rules, a fallback for addresses, and the whole resolution.

A rule is a row (step, rule, pattern, replacement, unless, rounds). Rules run in order; `unless` names a pattern that
keeps a rule from a text, `rounds` a sign that is counted in the text: the rule runs that many times (nested brackets).
A table of rules is configuration: it is read once, its size is checked, and the rules run over Arrow batches in the tasks.
Patterns use what Java's and RE2's dialects share. Labels are resolved on distinct texts only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache, reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import matching
from rostrum.operators.shared import hinted, written

#: Rules that a table may have: they are part of the plan.
MOST_REWRITES = 1000
RULE_SCHEMA = "step int, rule int, pattern string, replacement string, unless string, rounds string"

# What an address may end in.
COUNTRIES = (
    "Argentina", "Australia", "Austria", "Belgium", "Brazil", "Bulgaria", "Canada", "Chile", "China", "Colombia", "Croatia", "Czech Republic", "Czechia", "Denmark", "Egypt", "Estonia", "Finland",
    "France", "Germany", "Greece", "Hong Kong", "Hungary", "Iceland", "India", "Indonesia", "Iran", "Ireland", "Israel", "Italy", "Japan", "Kenya", "Korea", "Latvia", "Lithuania", "Malaysia", "Mexico",
    "Netherlands", "New Zealand", "Nigeria", "Norway", "Pakistan", "Peru", "Philippines", "Poland", "Portugal", "Romania", "Russia", "Saudi Arabia", "Serbia", "Singapore", "Slovakia", "Slovenia",
    "South Africa", "Spain", "Sweden", "Switzerland", "Taiwan", "Thailand", "Tunisia", "Turkey", "UAE", "UK", "USA", "Ukraine", "United Arab Emirates", "United Kingdom", "United States", "Vietnam",
)
STATES = (
    "AK", "AL", "AR", "AZ", "CA", "CO", "CT", "DC", "DE", "FL", "GA", "HI", "IA", "ID", "IL", "IN", "KS", "KY", "LA", "MA", "MD", "ME", "MI", "MN", "MO", "MS", "MT", "NC", "ND", "NE", "NH", "NJ", "NM",
    "NV", "NY", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VA", "VT", "WA", "WI", "WV", "WY",
)
REGIONS = ("ACT", "Bavaria", "Bayern", "Beijing", "Guangdong", "Hessen", "Hubei", "Jiangsu", "Lombardia", "NSW", "Ontario", "QLD", "Quebec", "Shandong", "Victoria", "Zhejiang")
# Words of a part that is a unit of an institution, whole parts that are fields, words that make a part an institution.
UNITS = r"(?i)\b(?:department|departamento|dept|school|institute of|faculty|college of|division|group|cent(?:er|re)|laborator(?:y|ies)|lab)\b"
FIELDS = ("astronomy", "biology", "chemistry", "computer science", "electrical engineering", "engineering", "materials science", "mathematics", "mechanical engineering", "optics", "photonics", "physics")
INSTITUTIONS = r"(?i)\b(?:university|universidade?|universitat|universita|universite|college|polytechnic|institute of technology|national lab(?:oratory)?)\b|(?i)universit[éÉäÄàÀ]"
# Legal forms, as patterns; words for a university, longest first; what may follow them; qualifiers that are no name.
LEGAL_FORMS = (
    r"co\.?,?\s*ltd", r"co\.?,?\s*kgaa", r"co\.?,?\s*kg", r"pte\.?,?\s*ltd", r"pty\.?,?\s*ltd", r"pvt\.?,?\s*ltd", "a/s", "ab", "ag", "asa", r"b\.?v", r"co\.", "company", "corp", "corporation", "gmbh", "inc", "incorporated",
    "kgaa", "kg", "limited", "llc", "ltd", r"n\.?v", "oyj", "oy", "plc", "pte", r"s\.?a\.?s", r"s\.?a", r"s\.?p\.?a", r"s\.?r\.?l", r"s\.?r\.?o", r"e\.?v",
)
UNIVERSITY = r"(?:universidades?|universiteit|university|universit[éÉ]|universit[äÄ]t|universit[àÀ]|universitat|universita|universite|univ)"
CONNECTIVES = "(?:of|de|del|della|di|do|da|der|des|du)"
QUALIFIERS = "(?:polytechnic|polytechnical|politecnico|politecnica|pontificia|pontifical)"


class Rewrite(NamedTuple):
    step: int
    rule: int
    pattern: str
    replacement: str
    unless: str = ""
    rounds: str = ""


BRACKETS = Rewrite(1, 1, r"\s*\([^()]*\)", "", rounds="(")
#: The steps: brackets, prefixes, the word for a university, abbreviations, legal forms, punctuation.
LEGAL = rf"(?i)(?:(?:^|[\s,]+)(?:(?:&|\+|and|und)[\s,]+)?(?:{'|'.join(LEGAL_FORMS)})\.?)+[\s,]*$"
REWRITES: tuple[Rewrite, ...] = (
    BRACKETS,
    Rewrite(2, 1, r"^[A-Za-z][A-Za-z0-9_.&-]*:\s+", ""),
    Rewrite(2, 2, r"(?i)^the\s+", ""),
    Rewrite(3, 1, r"(?i)^(.*?[^\s,-])[\s,-]+universit[aäÄ]ts\S*(?:\s.*)?$", "$1"),
    Rewrite(3, 2, r"(?i)^universit[aäÄ]ts\S*\s+(\S.*)$", "$1"),
    Rewrite(3, 3, rf"(?i)^(?:technische|technical|technological)\s+{UNIVERSITY}(?:\.\s*|\s+)(?:{CONNECTIVES}\s+)?(\S.*)$", "TU $1"),
    Rewrite(3, 4, rf"(?i)^{QUALIFIERS}\s+{UNIVERSITY}(?:\.\s*|\s+)(?:{CONNECTIVES}\s+)?(\S.*)$", "$1"),
    Rewrite(3, 5, rf"(?i)^(\S.*?)[\s,-]+{UNIVERSITY}(?:[\s.,].*)?$", "$1", unless=rf"(?i)^{UNIVERSITY}(?:[\s.,]|$)"),
    Rewrite(3, 6, rf"(?i)^{UNIVERSITY}\s+(?:degli\s+)?studi\s+(?:di|del|della|dell')\s*(\S.*)$", "$1"),
    Rewrite(3, 7, rf"(?i)^{UNIVERSITY}(?:\.\s*|\s+)(?:{CONNECTIVES}\s+)?(\S.*)$", "$1", unless=rf"(?i)^{UNIVERSITY}(?:\.\s*|\s+)(?:{CONNECTIVES}\s+)?college(?:[\s.,]|$)"),
    Rewrite(4, 1, r"(?i)(^|\s)univ(?:\.|(\s)|$)", "$1$2"),
    Rewrite(4, 2, r"(^|\s)U\.?(?:(\s)|$)", "$1$2"),
    Rewrite(4, 3, r"(?i)(^|\s)natl?\.?(\s|$)", "$1National$2"),
    Rewrite(5, 1, LEGAL, ""),
    Rewrite(6, 1, ",", " "),
    Rewrite(6, 2, r"\.", ""),
    Rewrite(6, 3, r"\s+", " "),
    Rewrite(6, 4, r"^[\s&+-]+|[\s&+-]+$", ""),
)


def rewrite_table(spark: SparkSession, rewrites: Sequence[Rewrite] = REWRITES) -> DataFrame:
    """The rules as a table, to be edited, written or joined like any other."""
    return spark.createDataFrame(list(rewrites), RULE_SCHEMA)


def read_rewrites(rules: DataFrame) -> list[Rewrite]:
    """The rules of a table in order; a table of more than MOST_REWRITES, or with two rules of one number, is an error."""
    rows = rules.select(*Rewrite._fields).limit(MOST_REWRITES + 1).collect()
    if len(rows) > MOST_REWRITES:
        raise ValueError(f"more than {MOST_REWRITES} rules")
    found = sorted(Rewrite(r.step, r.rule, r.pattern, r.replacement or "", r.unless or "", r.rounds or "") for r in rows)
    if len({r[:2] for r in found}) < len(found):
        raise ValueError("two rules have one step and number")
    return found


@cache
def required_part(pattern: str) -> tuple[str, bool]:
    """A literal that each match of a pattern contains, as long as can be told, and whether its case counts; without case it is
    in lower case. '' where none can be told, and for what Java's dialect alone has."""
    if "&&" in pattern or re.search(r"\[[^\]]*\[", pattern):
        return "", True
    try:
        parsed = re._parser.parse(pattern)
    except re.error:
        return "", True
    runs = [""]

    def walk(ops: Iterable) -> None:
        for op, arg in ops:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(arg)
            elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
                walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                runs.append("")
                walk(arg[2])
                runs.append("")
            else:
                runs.append("")

    walk(parsed)
    flags = parsed.state.flags & ~re.UNICODE
    cased = not flags & re.IGNORECASE
    plain = [r for r in runs if cased or r.isascii()]
    return (max(plain, key=len, default="") if cased else max(plain, key=len, default="").lower(), cased) if flags in (0, re.IGNORECASE) else ("", True)


def _on_arrays(f: Callable[[pa.Array], pa.Array], c: Column, returns: str = "string") -> Column:
    """f of the column, an Arrow array a batch. Rules are RE2's there, which costs a tenth of Java's and gives what DuckDB gives."""

    def batch(x: pa.Array) -> pa.Array:
        return f(x)

    return F.arrow_udf(batch, returns)(c)


def _where(x: pa.Array, hit: pa.Array, f: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """x with f of the rows that are hit in their places."""
    hit = pc.fill_null(hit, False)
    n = pc.sum(hit).as_py() or 0
    return f(x) if n and n == len(x) else pc.replace_with_mask(x, hit, f(x.filter(hit))) if n else x


def _backslashed(replacement: str) -> str:
    """A replacement in Java's form (`$1`) in that of RE2."""
    return re.sub(r"\\(.)|\$(\d)", lambda m: "\\" + m[2] if m[2] else m[1].replace("\\", r"\\"), replacement, flags=re.DOTALL)


def _applied(x: pa.Array, r: Rewrite) -> pa.Array:
    once = lambda y: pc.replace_substring_regex(y, r.pattern, _backslashed(r.replacement))

    def rounds(y: pa.Array) -> pa.Array:
        times = pc.count_substring(y, r.rounds)
        for k in range(pc.max(times).as_py()):
            hit = pc.and_(pc.greater(times, k), pc.match_substring_regex(y, r.pattern))
            if not pc.any(hit).as_py():
                break
            y = _where(y, hit, once)
        return y

    hit = pc.match_substring_regex(x, r.pattern)
    hit = pc.and_not(hit, pc.match_substring_regex(x, r.unless)) if r.unless else hit
    return _where(x, hit, rounds if r.rounds else once)


def _run(x: pa.Array, rules: Sequence[Rewrite]) -> pa.Array:
    after = lambda y: reduce(_applied, rules, y)
    needed = {required_part(r.pattern) for r in rules}
    if len(rules) < 2 or not all(literal for literal, _ in needed):
        return after(x)
    parts = [n for n in needed if not any(m != n and m[0] in n[0] and m[1] == n[1] for m in needed)]
    return _where(x, pc.match_substring_regex(x, "|".join(f"(?{'' if cased else 'i'}:{re.escape(literal)})" for literal, cased in sorted(parts))), after)


def _rewritten(x: pa.Array, rewrites: Sequence[Rewrite]) -> pa.Array:
    runs = [list(run) for _, run in groupby(rewrites, lambda r: (r.step, required_part(r.pattern)[0] != ""))]
    return pc.utf8_trim(reduce(_run, runs, pc.utf8_trim(x, " ")), " ")


def rewritten(c: Column, rewrites: Sequence[Rewrite]) -> Column:
    """The text after all rules, without blanks at the ends. A rule touches the texts that it matches only, and a step's run of rules is
    passed over where the text lacks the literals without which they can't match."""
    return _on_arrays(lambda x: _rewritten(x, rewrites), c)


def forms(c: Column, rewrites: Sequence[Rewrite]) -> Column:
    """Array of the text as it is and after each step, in order; each step starts from the form before it."""
    steps = [[r for r in rewrites if r.step == s] for s in sorted({r.step for r in rewrites})]

    def lists(x: pa.Array) -> pa.Array:
        out = [pc.utf8_trim(x, " ")]
        for rules in steps:
            out.append(_rewritten(out[-1], rules))
        n, k = len(x), len(out)
        rows = np.arange(n * k).reshape(k, n).T.ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.concat_arrays(out).take(pa.array(rows)))

    return _on_arrays(lists, c, returns="array<string>")


def _or_else(x: pa.Array, given: pa.Array, f: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """x, and f of the given texts where x is empty or null."""
    empty = pc.fill_null(pc.equal(x, ""), True)
    return pc.replace_with_mask(x, empty, f(given.filter(empty))) if pc.any(empty).as_py() else x


def _only(rewrites: Sequence[Rewrite], *steps: int) -> list[Rewrite]:
    return [r for r in rewrites if r.step in steps]


@dataclass(frozen=True)
class Words:
    """What the fallback knows of addresses; all of it may be replaced."""

    countries: tuple[str, ...] = COUNTRIES
    tails: tuple[str, ...] = field(default=COUNTRIES + STATES + REGIONS)
    units: str = UNITS
    fields: tuple[str, ...] = FIELDS
    institutions: str = INSTITUTIONS


def _without_country_tail(x: pa.Array, words: Words) -> pa.Array:
    names = "|".join(re.escape(n).replace("\\ ", " ") for n in sorted(words.countries, key=len, reverse=True))
    return pc.utf8_trim(_applied(x, Rewrite(1, 1, rf"(?i)(?:\s*(?:\(\s*(?:{names})\s*\)|[-–—]\s*(?:{names})))+\s*$", "")), " ")


def without_country_tail(c: Column, words: Words = Words()) -> Column:
    """`Name (Country)` and `Name - Country` without the country, also when two such tails follow each other."""
    return _on_arrays(lambda x: _without_country_tail(x, words), c)


def _declared_acronym(x: pa.Array, words: Words) -> pa.Array:
    shape = r"^\s*(?P<name>[^,()]+?)\s*\(\s*(?P<short>[A-Z][A-Za-z0-9]*[A-Z](?:-[A-Z0-9]+)?)\s*\)\.?\s*$"
    shaped = pc.fill_null(pc.match_substring_regex(x, shape), False)
    name, short = pc.extract_regex(x.filter(shaped), shape).flatten()
    fits = pc.and_(pc.greater_equal(pc.count_substring_regex(short, "[A-Z]"), 3), pc.less(pc.utf8_length(short), pc.utf8_length(name)))
    fits = pc.and_not(fits, pc.is_in(pc.utf8_upper(short), pa.array([n.upper() for n in words.countries], short.type)))
    fits = pc.and_not(fits, pc.match_substring_regex(name, r"\s[-–—]\s"))
    return pc.replace_with_mask(pa.nulls(len(x), x.type), shaped, pc.if_else(fits, short, None))


def declared_acronym(c: Column, words: Words = Words()) -> Column:
    """The acronym of a text that is `Long Name (ACRONYM)` and nothing else; null otherwise. Three signs and three
    capitals at least, shorter than the name, no country; the name has no comma, bracket or dash between blanks."""
    return _on_arrays(lambda x: _declared_acronym(x, words), c)


def _chosen_part(x: pa.Array, words: Words) -> pa.Array:
    lists = pc.split_pattern(x, ",")
    every = pc.utf8_trim(lists.flatten(), " ")
    row = pc.list_parent_indices(lists).to_numpy()
    head = np.searchsorted(row, np.arange(len(x)))
    place = np.flatnonzero(pc.not_equal(every, "").to_numpy(zero_copy_only=False))
    # parts that aren't empty: their rows, and what they are, told once for each distinct part
    row, coded = row[place], every.take(pa.array(place)).dictionary_encode()
    parts = coded.dictionary
    told = lambda *hits: reduce(pc.or_, hits).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
    among = lambda p, values: pc.is_in(p, pa.array(values, parts.type))
    outer = told(among(parts, words.tails), pc.match_substring_regex(parts, "^[0-9]{4,6}$"))
    unit = told(pc.match_substring_regex(parts, words.units), among(pc.utf8_rtrim(pc.utf8_lower(parts), "."), words.fields))
    named = told(pc.match_substring_regex(parts, words.institutions))
    first, last = np.searchsorted(row, np.arange(len(x))), np.full(len(x), -1)
    inner = np.flatnonzero(~outer)
    np.maximum.at(last, row[inner], inner)
    city = last > first
    city[city] = ~named[last[city]]
    end = last - city
    left = np.flatnonzero(~unit & (np.arange(len(row)) <= end[row]))
    best = np.full(len(x), len(row))
    np.minimum.at(best, row[left], left)
    best = np.where(best < len(row), best, end)
    chosen = head.copy()
    chosen[last >= 0] = place[best[last >= 0]]
    return every.take(pa.array(chosen, mask=~x.is_valid().to_numpy(zero_copy_only=False)))


def chosen_part(c: Column, words: Words = Words()) -> Column:
    """Of the comma parts: those of the address at the end go (countries, states, regions, postal codes), then a last one
    that is no institution (a city) if another is left, then units and fields in front as long as others follow. The
    first that remains, or the first part of all."""
    return _on_arrays(lambda x: _chosen_part(x, words), c)


def fallback_label(c: Column, rewrites: Sequence[Rewrite] = REWRITES, words: Words = Words()) -> Column:
    """The label of an address that no rule knows: its own acronym, else the chosen part without brackets, legal form,
    and the word for a university. A part with nothing else to it stays."""

    def part(x: pa.Array) -> pa.Array:
        base = _rewritten(x, _only(rewrites, 1, 5))
        return _rewritten(_chosen_part(base, words), [*_only(rewrites, 5), *_only(rewrites, 3), *_only(rewrites, 6)])

    def label(x: pa.Array) -> pa.Array:
        plain = lambda y: _or_else(_rewritten(y, _only(rewrites, 1, 6)), y, lambda z: pc.utf8_trim(z, " "))
        return _or_else(_declared_acronym(x, words), x, lambda y: _or_else(part(y), y, plain))

    return _on_arrays(label, c)


def polished_label(c: Column, rewrites: Sequence[Rewrite] = REWRITES, keep: Sequence[str] = ()) -> Column:
    """A label in house style, by all rules; labels of `keep` stay, and no label becomes empty."""

    def polished(x: pa.Array) -> pa.Array:
        return _or_else(_rewritten(x, rewrites), x, lambda y: _or_else(_rewritten(y, _only(rewrites, 1, 6)), y, lambda z: z))

    def label(x: pa.Array) -> pa.Array:
        x = pc.utf8_trim(x, " ")
        return _where(x, pc.invert(pc.is_in(x, pa.array(keep, x.type))), polished) if keep else polished(x)

    return _on_arrays(label, c)


def unchanged(a: Column, b: Column) -> Column:
    """Equal but for blanks and periods at the end: nothing was shortened."""
    end = lambda c: F.regexp_replace(F.trim(c), r"[\s.]+$", "")
    return end(a) == end(b)


def canonical_labels(texts: DataFrame, text: str, tiers: Sequence[DataFrame], curated: DataFrame, rewrites: Sequence[Rewrite] = REWRITES, words: Words = Words(), keep: Sequence[str] = ()) -> DataFrame:
    """(text, short, tier) of each distinct text, nulls left out.

    curated: (form, short), one row a form; the text itself and its forms after each step of the rules are looked up, the
    first that is there wins (tier 'map'). Then the rule tiers, in order, on the normal form ('rules'); then the fallback
    ('fallback'). A text that comes out unchanged is tried once more without its country tail ('retry'). What rules, fallback
    and retry give is polished. All look-ups are one join, and texts and their forms without a tail are resolved together. What was asked and
    what was answered are written once, so no rule runs twice on a text."""

    def with_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).drop_null().unique()
            bare = _without_country_tail(raw, words)
            for x, given in ((raw, True), (bare.filter(pc.not_equal(bare, raw)), False)):
                yield pa.RecordBatch.from_arrays([x, pa.repeat(given, len(x))], ["raw", "given"])

    # tails come off before the shuffle, so the texts and their forms without one are made distinct in one go
    both = texts.select(F.col(text).alias("raw")).mapInArrow(with_tails, "raw string, given boolean").groupBy("raw").agg(F.bool_or("given").alias("given"))
    asked = written(both.select("raw", "given", without_country_tail(F.when(F.col("given"), F.col("raw")), words).alias("bare"), T.normal_form(F.col("raw")).alias("normal")), "asked")
    looked = asked.select("raw", F.posexplode(F.array_distinct(forms(F.col("raw"), rewrites))).alias("at", "form"))
    known = hinted(written(curated.select("form", F.col("short").alias("label")), "curated"))
    mapped = looked.join(known, "form").groupBy("raw").agg(F.min_by("label", "at").alias("mapped"))
    ruled = matching.resolve_labels(asked, tiers, "normal", F.lit(None).cast("string")).where("short is not null").select("normal", F.col("short").alias("ruled"))
    found = asked.join(mapped.hint("merge"), "raw", "left").join(ruled.hint("merge"), "normal", "left")
    # null where an earlier tier has the answer: rules pass over nulls
    rest = F.when(F.col("mapped").isNull() & F.col("ruled").isNull(), F.col("raw"))
    found = found.withColumn("plain", F.when(F.col("mapped").isNull(), F.coalesce("ruled", fallback_label(rest, rewrites, words))))
    tier = F.when(F.col("mapped").isNotNull(), "map").when(F.col("ruled").isNotNull(), "rules").otherwise("fallback")
    answers = written(found.select("raw", "bare", "given", F.coalesce("mapped", polished_label(F.col("plain"), rewrites, keep)).alias("short"), tier.alias("tier")), "answers")
    retried = (F.col("tier") == "fallback") & (F.col("bare") != F.col("raw")) & unchanged(F.col("short"), F.col("raw"))
    given = answers.where("given").withColumn("retried", F.coalesce(retried, F.lit(False)))
    again = answers.select(F.col("raw").alias("bare"), F.col("short").alias("second"))
    second = given.where("retried").join(again.hint("merge"), "bare", "left")
    better = (F.col("second") != "") & ~unchanged(F.col("second"), F.col("raw"))
    second = second.select("raw", F.when(better, F.col("second")).otherwise(F.col("short")).alias("short"), F.when(better, "retry").otherwise(F.col("tier")).alias("tier"))
    return given.where("not retried").select("raw", "short", "tier").unionByName(second).withColumnRenamed("raw", text)
