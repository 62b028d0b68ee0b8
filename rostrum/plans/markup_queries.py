"""Queries of entities and markup runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import markup as M
from rostrum.plans.registry import query
from rostrum.sources.tables import table


@query("f3_entities", r"SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS word, word AS decoded FROM documents")
def f3(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the documents written in numeric and named entities, and read back."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    named = {"é": "&eacute;", "ü": "&uuml;", "ß": "&szlig;", "&": "&amp;", "<": "&lt;"}
    coded = F.transform(F.split("word", ""), lambda c, i: F.when(F.ascii(c) == 0, c).when(i % 3 == 0, F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).when(i % 3 == 1, F.concat(F.lit("&#x"), F.hex(F.ascii(c)), F.lit(";"))).otherwise(c))
    raw = F.array_join(coded, "")
    for sign, entity in reversed(named.items()):
        raw = raw if sign in "&<" else F.replace(raw, F.lit(sign), F.lit(entity))
    return words.select("word", M.decoded(raw).alias("decoded"))


_BLOCK = ", ".join(f"'{b}'" for b in M.BLOCKS)
_CLEAN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&amp;', '&'), '[\s\xA0]+', ' ', 'g'))".replace('\\"', '"')


@query(
    "f23_markup_runs",
    rf"""WITH p AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*$', '', 'g'), '(<[^<>]*>|[^<]+)') AS l FROM pages),
t AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM p),
n AS (SELECT *, CASE WHEN starts_with(x, '<') THEN lower(regexp_extract(x, '^</?\s*([A-Za-z][A-Za-z0-9]*)', 1)) END AS tag, starts_with(x, '</') AS closes FROM t),
b AS (SELECT *, sum(CASE WHEN tag IN ({_BLOCK}) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS block FROM n),
r AS (SELECT *, sum(CASE WHEN tag = 'b' AND NOT closes THEN 1 WHEN tag = 'b' THEN -1 ELSE 0 END) OVER w > 0 AS bold, sum(CASE WHEN tag = 'br' THEN 1 ELSE 0 END) OVER w AS broken FROM b WINDOW w AS (PARTITION BY page_id, block ORDER BY i)),
s AS (SELECT *, CASE WHEN bold THEN 'name' END AS role FROM r WHERE tag IS NULL),
g AS (SELECT *, sum(CASE WHEN role IS NOT DISTINCT FROM lr AND broken = lb THEN 0 ELSE 1 END) OVER (PARTITION BY page_id, block ORDER BY i) AS run FROM (SELECT *, lag(role) OVER w AS lr, lag(broken) OVER w AS lb FROM s WINDOW w AS (PARTITION BY page_id, block ORDER BY i))),
o AS (SELECT page_id, block, run, any_value(role) AS role, {_CLEAN.format("string_agg(x, '' ORDER BY i)")} AS text FROM g GROUP BY page_id, block, run)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY block, run) - 1)::INTEGER AS pos, role, text, block::INTEGER AS block FROM o WHERE text <> ''""",
)
def f23_runs(spark: SparkSession, d: str) -> DataFrame:
    """The runs of whole pages, bold ones as names, bold that is never closed up to the end of its block."""
    found = M.runs(F.col("html"), {"b": "name"}, breaks=["br"])
    return table(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "r")).select("page_id", "pos", "r.role", "r.text", "r.block")
