"""Queries of recased titles, compatibility forms and the four-pass match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import compat
from rostrum.operators import casing as C
from rostrum.operators import people
from rostrum.plans.registry import query
from rostrum.sources.tables import table

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MINOR = ", ".join(f"'{w}'" for w in C.MINOR_WORDS)
_GIVEN = ", ".join(f"('{k}', '{v}')" for k, v in C.GIVEN_FORMS.items())
_PLURAL = "{0} LIKE '%S' AND f{1}.upper = {0}[1:length({0}) - 1]"


@query(
    "f5_smart_titles",
    rf"""WITH calm AS (SELECT unnest(string_split_regex(text, '\s+')) AS w FROM documents
  WHERE NOT (length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 3 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) >= length(regexp_replace(text, '[^A-Za-z]', '', 'g')) * 0.8)),
core AS (SELECT regexp_replace(w, '^[.,;:!?()\[\]{{}}"'']+|[.,;:!?()\[\]{{}}"'']+$', '', 'g') AS form FROM calm),
best AS (SELECT replace(upper(form), 'ẞ', 'SS') AS upper, form FROM core WHERE length(form) >= 2 AND regexp_matches(form, '\pL') GROUP BY form QUALIFY row_number() OVER (PARTITION BY replace(upper(form), 'ẞ', 'SS') ORDER BY count(*) DESC, encode(form)) = 1),
given(upper, form) AS (VALUES {_GIVEN}),
f AS MATERIALIZED (SELECT * FROM best WHERE form <> lower(form) AND form <> replace(upper(form[1:1]), 'ẞ', 'SS') || lower(form[2:]) AND upper NOT IN (SELECT upper FROM given) UNION ALL SELECT * FROM given),
lines AS (SELECT doc_id, generate_subscripts(p, 1)::INTEGER - 1 AS line, unnest(p) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
titles AS (SELECT doc_id, line, raw, translate(raw, '{_LOWER}', '{_UPPER}') AS t FROM lines),
toks AS (SELECT doc_id, line, generate_subscripts(p, 1) AS i, unnest(p) AS w, len(p) AS n FROM (SELECT doc_id, line, string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ') AS p FROM titles WHERE length(regexp_replace(t, '[^A-Z]', '', 'g')) >= 3)),
words AS (SELECT DISTINCT w FROM toks),
parts AS (SELECT w, generate_subscripts(p, 1) AS j, unnest(p) AS x FROM (SELECT w, regexp_extract_all(w, '[A-Za-z]+|[^A-Za-z]+') AS p FROM words)),
runs AS (SELECT w, j, CASE WHEN NOT regexp_matches(x, '^[A-Za-z]') THEN x WHEN f1.form IS NOT NULL THEN f1.form WHEN f2.form IS NOT NULL THEN f2.form || 's'
  WHEN j > 1 + (NOT regexp_matches(w, '^[A-Za-z]'))::INTEGER AND lower(x) IN ({_MINOR}) THEN lower(x) ELSE upper(x[1:1]) || lower(x[2:]) END AS x
  FROM parts LEFT JOIN f f1 ON f1.upper = upper(x) LEFT JOIN f f2 ON {_PLURAL.format("upper(x)", 2)}),
plain AS (SELECT w, regexp_replace(string_agg(x, '' ORDER BY j), '''S\b', '''s', 'g') AS r FROM runs GROUP BY w),
forms AS (SELECT words.w, coalesce(f1.form, f2.form || 's') AS known, lower(regexp_replace(words.w, '[^A-Za-z]', '', 'g')) AS l, coalesce(r, '') AS r
  FROM words LEFT JOIN f f1 ON f1.upper = replace(upper(words.w), 'ẞ', 'SS') LEFT JOIN f f2 ON {_PLURAL.format("replace(upper(words.w), 'ẞ', 'SS')", 2)} LEFT JOIN plain ON plain.w = words.w),
cased AS (SELECT doc_id, line, i, lag(w) OVER (PARTITION BY doc_id, line ORDER BY i) AS before, CASE WHEN known IS NOT NULL THEN known WHEN i > 1 AND i < n AND l IN ({_MINOR}) THEN lower(w)
  WHEN length(l) >= 2 AND regexp_full_match(l, 'm{{0,4}}(cm|cd|d?c{{0,3}})(xc|xl|l?x{{0,3}})(ix|iv|v?i{{0,3}})') THEN replace(upper(w), 'ẞ', 'SS') ELSE r END AS x FROM toks JOIN forms USING (w)),
begun AS (SELECT doc_id, line, i, CASE WHEN before IS NULL OR before LIKE '%:' THEN regexp_extract(x, '^\PL*') || replace(upper(x[length(regexp_extract(x, '^\PL*')) + 1:length(regexp_extract(x, '^\PL*')) + 1]), 'ẞ', 'SS') || x[length(regexp_extract(x, '^\PL*')) + 2:] ELSE x END AS x FROM cased),
done AS (SELECT doc_id, line, string_agg(x, ' ' ORDER BY i) AS title FROM begun GROUP BY doc_id, line)
SELECT doc_id, line, coalesce(title, t) AS title FROM titles LEFT JOIN done USING (doc_id, line)""",
)
def f5_smart(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every whole document, shouted, as a title, with forms learned from the documents."""
    docs = table(spark, d, "documents")
    titles = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).select("doc_id", "line", F.translate("raw", _LOWER, _UPPER).alias("title"))
    return C.recase_titles(titles, ["doc_id", "line"], "title", C.learned_forms(docs, "text"))


_WRONG = [w for wrong in compat.MISSPELLED.values() for w in wrong]


def _spelled(c: str) -> str:
    for right, wrong in compat.MISSPELLED.items():
        c = rf"regexp_replace({c}, '\b(?:{'|'.join(wrong)})\b', '{right}', 'g')"
    return rf"regexp_replace(regexp_replace({c}, '\buniv\.', 'university', 'g'), '\b(indian institute of technology|iit),', '\1', 'g')"


_WRONG_SQL = "[" + ", ".join(f"'{w}'" for w in _WRONG) + "]"


@query(
    "f2_compatibility_form",
    rf"""SELECT word, {_spelled(f"replace(lower(strip_accents(word)), '`', '''') || ' ' || {_WRONG_SQL}[length(word) % {len(_WRONG)} + 1]")} AS normal
FROM (SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS word FROM documents) WHERE word <> ''""",
)
def f2_compat(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the documents, and a misspelled one, written in ligatures, full-width signs and letters with their marks
    apart, read back."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word != ''").distinct()
    raw = F.concat_ws(" ", "word", F.element_at(F.array(*[F.lit(w) for w in _WRONG]), F.length("word") % len(_WRONG) + 1))
    for sign, other in (("ffi", "ﬃ"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("é", "é"), ("ü", "ü"), ("ñ", "ñ")):
        raw = F.replace(raw, F.lit(sign), F.lit(other))
    narrow = "".join(chr(k) for k in range(0x21, 0x7F))
    wide = "".join(chr(k + 0xFEE0) for k in range(0x21, 0x7F))
    coded = F.array_join(F.transform(F.split(raw, ""), lambda x, i: F.when(i % 3 == 0, F.translate(x, narrow, wide)).otherwise(x)), "")
    return words.select("word", compat.matching_form(coded).alias("normal"))


_SPEAKER = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 'x' WHEN 2 THEN p_name[1:1] || '. ' || split_part(p_name, ' ', 2) WHEN 3 THEN 'zzzzzz ' || p_partkey END"


@query(
    "j8_four_passes",
    f"""WITH q AS (SELECT p_partkey, lower({_SPEAKER}) AS s, lower(p_brand || ' ' || p_size) AS t FROM part),
r AS (SELECT p_partkey AS pos, lower(p_name) AS n, lower(split_part(p_name, ' ', -1)) || '|' || lower(p_name[1:1]) AS k, lower(p_brand || ' ' || p_size) AS t, 'A' || p_partkey AS aff FROM part WHERE p_partkey % 7 > 0),
n AS (SELECT n, min(pos) AS pos FROM r GROUP BY n), k AS (SELECT k, min(pos) AS pos FROM r GROUP BY k), t AS (SELECT t, min(pos) AS pos FROM r GROUP BY t),
near AS (SELECT s, min(pos) AS pos FROM (SELECT DISTINCT s FROM q) JOIN n ON abs(length(s) - length(n)) <= 2 AND levenshtein(s, n) <= 2 GROUP BY s)
SELECT q.p_partkey, CASE WHEN n.pos IS NOT NULL THEN 1 WHEN near.pos IS NOT NULL THEN 2 WHEN k.pos IS NOT NULL THEN 3 WHEN t.pos IS NOT NULL THEN 4 END AS pass, aff
FROM q LEFT JOIN n ON n.n = s LEFT JOIN near USING (s) LEFT JOIN k ON k.k = split_part(s, ' ', -1) || '|' || s[1:1] LEFT JOIN t USING (t) LEFT JOIN r ON r.pos = coalesce(n.pos, near.pos, k.pos, t.pos)""",
)
def j8_passes(spark: SparkSession, d: str) -> DataFrame:
    """Affiliations by exact name, up to two edits, surname and initial, then title, over whole tables."""
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    speaker = F.when(k == 0, F.upper(name)).when(k == 1, F.concat(name, F.lit("x"))).when(k == 2, F.concat(F.substring(name, 1, 1), F.lit(". "), F.split_part(name, F.lit(" "), F.lit(2)))).when(k == 3, F.concat(F.lit("zzzzzz "), F.col("p_partkey").cast("string")))
    part = table(spark, d, "part").withColumn("title", F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")))
    asked = part.select("p_partkey", speaker.alias("speaker"), "title")
    known = part.select(F.col("p_partkey").alias("pos"), "p_name", F.col("title").alias("talk"), F.when(F.col("p_partkey") % 7 > 0, F.concat(F.lit("A"), F.col("p_partkey").cast("string"))).alias("aff"))
    found = people.layered_match(asked, known, ("speaker", "title"), ("p_name", "talk"), "aff", "pos")
    return found.select("p_partkey", "pass", "aff")
