"""Queries of the label rules, the address fallback and the whole resolution, over addresses built from every two words of
every whole document. The SQL computes each answer from the string: rule by rule, and part by part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators import labels
from rostrum.plans.join_queries import _LATE, _RULED, rule_tables
from rostrum.plans.registry import query
from rostrum.plans.text_queries import _FOLD, _SQUEEZE, _runs

#: A string of two words a and b, by their place; both engines read it.
_SHAPES = """CASE (doc_id + pos) % 20
WHEN 0 THEN concat('Department of ', a, ', ', b, ' University, ', a, ', Italy') WHEN 1 THEN concat(a, ' ', b, ' (France)') WHEN 2 THEN concat(a, ' Labs - Germany')
WHEN 3 THEN concat(a, ' ', b, ' Research (', upper(substr(concat(a, b, 'xyz'), 1, 4)), ')') WHEN 4 THEN concat(a, ' Co., Ltd.') WHEN 5 THEN concat(a, ' ', b, ' GmbH & Co. KG')
WHEN 6 THEN concat('Univ. of ', a) WHEN 7 THEN concat('Technische Universität ', b) WHEN 8 THEN concat(a, ' State University, ', b, ', CA, USA')
WHEN 9 THEN concat('Physics, School of ', a, ', ', b, ' Institute of Technology, ', a, ', 12345') WHEN 10 THEN concat('The ', a, ' (', b, ' (', a, ')) Univ') WHEN 11 THEN concat('Universitätsklinikum ', a)
WHEN 12 THEN concat('U ', a, ', Natl. Lab') WHEN 13 THEN concat(b, ': ', a, ' Center, Inc.') WHEN 14 THEN concat(a, ', ', b, ', Victoria, Australia') WHEN 15 THEN concat('The ', a, ' Ltd.')
WHEN 16 THEN concat('Key Laboratory of ', a, ', ', b, ' University') WHEN 17 THEN concat(a, ' – UK') WHEN 18 THEN concat('Università degli Studi di ', a, ' (Italy)') ELSE 'Inc., Ltd.' END"""
_RAW = f"""SELECT doc_id, pos, {_SHAPES} AS raw FROM (SELECT doc_id, k AS pos, w[2 * k + 1] AS a, coalesce(w[2 * k + 2], w[2 * k + 1]) AS b FROM (
SELECT doc_id, w, unnest(range(0, (len(w) + 1) // 2)) AS k FROM (SELECT doc_id, list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: w <> '') AS w FROM documents)))""".replace("(len(w) + 1) // 2", "(len(w) + 1) >> 1")


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    words = _runs(spark, d, 2).select("doc_id", "pos", F.col("w")[0].alias("a"), F.coalesce(F.try_element_at("w", F.lit(2)), F.col("w")[0]).alias("b"))
    return words.select("doc_id", "pos", F.expr(_SHAPES).alias("raw"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ruled(name: str, source: str, column: str, rules: Sequence[labels.Rewrite]) -> str:
    """CTEs that apply the rules one after another to `column` of `source`; the last is `name`, with the column replaced."""
    ctes, source = [f"{name}_0 AS (SELECT * REPLACE (trim({column}) AS {column}) FROM {source})"], f"{name}_0"
    for i, r in enumerate(rules, 1):
        out, replacement = column, r.replacement.replace("$", "\\")
        for _ in range(3 if r.rounds else 1):
            out = f"regexp_replace({out}, {_quoted(r.pattern)}, {_quoted(replacement)}, 'g')"
        if r.unless:
            out = f"CASE WHEN regexp_matches({column}, {_quoted(r.unless)}) THEN {column} ELSE {out} END"
        ctes.append(f"{name}_{i} AS (SELECT * REPLACE ({out} AS {column}) FROM {source})")
        source = f"{name}_{i}"
    return ",\n".join([*ctes, f"{name} AS (SELECT * REPLACE (trim({column}) AS {column}) FROM {source})"])


def _steps(*steps: int) -> list[labels.Rewrite]:
    return [r for s in steps for r in labels.REWRITES if r.step == s]


def _listed(values: Sequence[str]) -> str:
    return ", ".join(map(_quoted, values))


_W = labels.Words()
_NAMES = "|".join(sorted(_W.countries, key=len, reverse=True))
_BARE = f"trim(regexp_replace(raw, '(?i)(?:\\s*(?:\\(\\s*(?:{_NAMES})\\s*\\)|[-–—]\\s*(?:{_NAMES})))+\\s*$', ''))"
_SHAPE = r"'^\s*([^,()]+?)\s*\(\s*([A-Z][A-Za-z0-9]*[A-Z](?:-[A-Z0-9]+)?)\s*\)\.?\s*$'"
_ACRONYM = f"""CASE WHEN len(regexp_extract_all(regexp_extract(raw, {_SHAPE}, 2), '[A-Z]')) >= 3 AND length(regexp_extract(raw, {_SHAPE}, 2)) < length(regexp_extract(raw, {_SHAPE}, 1))
AND regexp_extract(raw, {_SHAPE}, 2) NOT IN ({_listed([n.upper() for n in _W.countries])}) AND NOT regexp_matches(regexp_extract(raw, {_SHAPE}, 1), '\\s[-–—]\\s') THEN regexp_extract(raw, {_SHAPE}, 2) END"""


def _fallback(name: str, source: str) -> str:
    """CTEs from (raw, ...) of `source` to `name` with the fallback label in x."""
    unit = f"(regexp_matches(p, {_quoted(_W.units)}) OR rtrim(lower(p), '.') IN ({_listed(_W.fields)}))"
    tail = f"(parts[i] IN ({_listed(_W.tails)}) OR regexp_matches(parts[i], '^[0-9]{{4,6}}$'))"
    return f"""{name}_src AS (SELECT *, raw AS x, raw AS plain FROM {source}),
{_ruled(name + "_base", name + "_src", "x", _steps(1, 5))},
{_ruled(name + "_plain", name + "_base", "plain", _steps(1, 6))},
{name}_parts AS (SELECT * EXCLUDE (x), list_transform(string_split(x, ','), lambda p: trim(p)) AS every, list_filter(list_transform(string_split(x, ','), lambda p: trim(p)), lambda p: p <> '') AS parts FROM {name}_plain),
{name}_named AS (SELECT *, parts[1:coalesce(list_max(list_filter(range(1, len(parts) + 1), lambda i: NOT {tail})), 0)] AS named FROM {name}_parts),
{name}_left AS (SELECT *, CASE WHEN len(named) >= 2 AND NOT regexp_matches(named[-1], {_quoted(_W.institutions)}) THEN named[1:len(named) - 1] ELSE named END AS rest FROM {name}_named),
{name}_pick AS (SELECT * EXCLUDE (every, parts, named, rest), coalesce(list_filter(rest, lambda p: NOT {unit})[1], rest[-1], every[1]) AS x FROM {name}_left),
{_ruled(name + "_end", name + "_pick", "x", _steps(5, 3, 6))},
{name} AS (SELECT * EXCLUDE (plain) REPLACE (coalesce({_ACRONYM}, nullif(x, ''), nullif(plain, ''), trim(raw)) AS x) FROM {name}_end)"""


def _polished(name: str, source: str) -> str:
    """CTEs that polish column x of `source`."""
    return f"""{name}_src AS (SELECT *, x AS plain, trim(x) AS asis FROM {source}),
{_ruled(name + "_whole", name + "_src", "x", labels.REWRITES)},
{_ruled(name + "_plain", name + "_whole", "plain", _steps(1, 6))},
{name} AS (SELECT * EXCLUDE (plain, asis) REPLACE (coalesce(nullif(x, ''), nullif(plain, ''), asis) AS x) FROM {name}_plain)"""


@query("f24_label_rules", f"WITH src AS ({_RAW}), start AS (SELECT *, raw AS x FROM src), {_polished('pol', 'start')} SELECT doc_id, pos::INTEGER AS pos, x AS label FROM pol")
def f24_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every address polished by the rule table."""
    rules = labels.read_rewrites(labels.rewrite_table(spark))
    return _addresses(spark, d).select("doc_id", "pos", labels.polished_label(F.col("raw"), rules).alias("label"))


@query("f25_fallback_label", f"WITH src AS ({_RAW}), {_fallback('fb', 'src')} SELECT doc_id, pos::INTEGER AS pos, x AS label FROM fb")
def f25_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The label that the fallback gives every address."""
    return _addresses(spark, d).select("doc_id", "pos", labels.fallback_label(F.col("raw")).alias("label"))


_CURATED = "SELECT DISTINCT w AS form, concat(upper(w), ' (curated)') AS label FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM documents) WHERE starts_with(w, 'E') AND length(w) > 4"


def _curated(spark: SparkSession, d: str) -> DataFrame:
    """Some words of the documents as a map that somebody has curated."""
    words = _runs(spark, d, 1).select(F.col("w")[0].alias("form")).where(F.startswith("form", F.lit("E")) & (F.length("form") > 4)).distinct()
    return words.select("form", F.concat(F.upper("form"), F.lit(" (curated)")).alias("short"))


_SAME = r"regexp_replace(trim({0}), '[\s.]+$', '')"
_NORMAL = _SQUEEZE.format("translate(" + _FOLD.format("raw") + ", '–—‘’“”', '--''''\"\"')")
_CANONICAL = f"""WITH src AS ({_RAW}), tops AS (SELECT DISTINCT raw, {_BARE} AS bare FROM src), asked AS (SELECT raw FROM tops UNION SELECT bare FROM tops),
form0 AS (SELECT raw, trim(raw) AS x FROM asked), {", ".join(_ruled(f"form{s}", f"form{s - 1}", "x", _steps(s)) for s in range(1, 7))},
curated AS ({_CURATED}),
mapped AS (SELECT raw, arg_min(label, step) AS mapped FROM ({" UNION ALL ".join(f"SELECT raw, x, {s} AS step FROM form{s}" for s in range(7))}) JOIN curated ON form = x GROUP BY raw),
ruled AS (SELECT raw, coalesce({_RULED.replace("token", "n")}, {_LATE.replace("token", "n")}) AS ruled FROM (SELECT raw, {_NORMAL} AS n FROM asked)),
{_fallback("fb", "asked")},
joined AS (SELECT raw, mapped, ruled, coalesce(ruled, x) AS x FROM fb JOIN ruled USING (raw) LEFT JOIN mapped USING (raw)),
{_polished("pol", "joined")},
answers AS (SELECT raw, coalesce(mapped, x) AS short, CASE WHEN mapped IS NOT NULL THEN 'map' WHEN ruled IS NOT NULL THEN 'rules' ELSE 'fallback' END AS tier FROM pol),
tried AS (SELECT t.raw, a.short, a.tier, b.short AS again,
  a.tier = 'fallback' AND {_SAME.format("a.short")} = {_SAME.format("t.raw")} AND t.bare <> t.raw AND b.short <> '' AND {_SAME.format("b.short")} <> {_SAME.format("t.raw")} AS retry
  FROM tops t JOIN answers a ON a.raw = t.raw JOIN answers b ON b.raw = t.bare)
SELECT raw, CASE WHEN retry THEN again ELSE short END AS short, CASE WHEN retry THEN 'retry' ELSE tier END AS tier FROM tried"""


@query("f24_f25_canonical_labels", _CANONICAL)
def canonical(spark: SparkSession, d: str) -> DataFrame:
    """Map, rules, fallback and retry over the distinct addresses."""
    return labels.canonical_labels(_addresses(spark, d), "raw", rule_tables(spark), _curated(spark, d))
