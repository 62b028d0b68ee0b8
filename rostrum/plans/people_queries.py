"""Queries of nested affiliations and of person suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators import people, search
from rostrum.plans.registry import query
from rostrum.sources.tables import spread, table

_LINES = "SELECT l_orderkey AS k, l_linenumber AS i, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL"
_TALKS = f"""SELECT k, list({{'name': 'Ada N' || s % 9, 'insts': CASE WHEN (i + k) % 3 = 0 THEN [i * 2, i * 2 + 2] WHEN (i + k) % 3 = 1 THEN [i * 2] ELSE [] END}} ORDER BY i) AS authors,
list({{'n': i * 2, 'short': 'S' || p % 5}} ORDER BY i) AS insts, CASE WHEN k % 4 = 0 THEN NULL ELSE 'A. N' || max(s) % 9 END AS speaker, CASE WHEN k % 3 = 0 THEN 'own' ELSE '' END AS aff FROM ({_LINES}) GROUP BY k"""


def _talks(spark: SparkSession, d: str) -> DataFrame:
    """An order as a talk: its lines are authors and institutions, some authors without a number, some numbers dangling."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("i")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    n, turn = F.col("i") * 2, (F.col("i") + F.col("k")) % 3
    author = F.struct(F.concat(F.lit("Ada N"), (F.col("s") % 9).cast("string")).alias("name"), F.when(turn == 0, F.array(n, n + 2)).when(turn == 1, F.array(n)).otherwise(F.array().cast("array<int>")).alias("insts"))
    short = F.concat(F.lit("S"), (F.col("p") % 5).cast("string"))
    place = F.struct(n.alias("n"), F.concat(F.lit("Place "), short).alias("name"), F.array(short).alias("alt_names"))
    rows = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", author.alias("a"), place.alias("b"), short.alias("c")))).alias("x"), F.max("s").alias("s"))
    part = lambda f: F.transform("x", lambda r: r[f])
    return rows.select(
        "k", part("a").alias("authors"), part("b").alias("institutions"), part("c").alias("inst_shorts"), F.when(F.col("k") % 4 != 0, F.concat(F.lit("A. N"), (F.col("s") % 9).cast("string"))).alias("speaker"), F.when(F.col("k") % 3 == 0, "own").otherwise("").alias("speaker_aff"),
    )


def _listed(talks: DataFrame) -> DataFrame:
    author = lambda a: F.concat_ws("=", a["name"], F.array_join(F.transform(a["insts"], lambda n: n.cast("string")), ","))
    place = lambda i, at: F.concat_ws(":", i["n"].cast("string"), F.get("inst_shorts", at))
    return talks.select("k", F.col("speaker_aff").alias("aff"), F.array_join(F.transform("authors", author), ";").alias("authors"), F.array_join(F.transform("institutions", place), ";").alias("institutions"))


_SHOWN = "array_to_string(list_transform(authors, lambda a: a.name || '=' || array_to_string(a.insts, ',')), ';') AS authors, array_to_string(list_transform(insts, lambda x: x.n || ':' || x.short), ';') AS institutions"


@query(
    "a5_mirrored_backfill",
    f"""WITH t AS ({_TALKS}), said AS (SELECT right(a.name, 2) AS key, x.short FROM (SELECT unnest(authors) AS a, insts FROM t), unnest(a.insts) AS u(n), unnest(insts) AS v(x) WHERE x.n = u.n),
c AS (SELECT key, short, count(*) AS c FROM said GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY key ORDER BY c DESC) AS r FROM c), votes AS (SELECT key, min(short) AS voted FROM r WHERE r = 1 GROUP BY key HAVING count(*) = 1),
f AS (SELECT t.*, voted, list_position(list_transform(authors, lambda a: right(a.name, 2)), right(speaker, 2)) AS entry, aff = '' AND voted IS NOT NULL AS fill, list_position(list_transform(insts, lambda x: x.short), voted) AS spot FROM t LEFT JOIN votes ON key = right(speaker, 2)),
g AS (SELECT *, coalesce(fill AND NOT coalesce(len(authors[entry].insts) > 0, false), false) AS mirror, CASE WHEN spot > 0 THEN insts[spot].n ELSE list_max(list_transform(insts, lambda x: x.n)) + 1 END AS n FROM f),
h AS (SELECT k, CASE WHEN fill THEN voted ELSE aff END AS aff, CASE WHEN mirror AND coalesce(spot, 0) = 0 THEN list_append(insts, {{'n': n, 'short': voted}}) ELSE insts END AS insts,
  list_transform(authors, lambda a, i: {{'name': a.name, 'insts': CASE WHEN mirror AND i = entry THEN [n] ELSE a.insts END}}) AS authors FROM g)
SELECT k, aff, {_SHOWN} FROM h""",
)
def a5(spark: SparkSession, d: str) -> DataFrame:
    """Speaker affiliations filled from other talks and mirrored into the lists of the talk."""
    return _listed(people.backfill_speakers(_talks(spark, d)))


@query(
    "a9_redirected_authors",
    f"""WITH t AS ({_TALKS}), u AS (SELECT *, list_transform(insts, lambda x: x.short) AS shorts, list_transform(insts, lambda x: x.n) AS old FROM t),
v AS (SELECT *, list_filter(shorts, lambda s, i: list_position(shorts, s) = i) AS kept FROM u),
w AS (SELECT k, aff, CASE WHEN k % 5 = 0 THEN insts ELSE list_transform(kept, lambda s, i: {{'n': i::INTEGER, 'short': s}}) END AS insts,
  list_transform(authors, lambda a: {{'name': a.name, 'insts': CASE WHEN k % 5 = 0 THEN a.insts ELSE list_transform(list_filter(list_transform(a.insts, lambda n: coalesce(list_position(kept, shorts[list_position(old, n)]), 0)), lambda n, i: n > 0 AND list_position(list_transform(a.insts, lambda m: coalesce(list_position(kept, shorts[list_position(old, m)]), 0)), n) = i), lambda n: n::INTEGER) END}}) AS authors FROM v)
SELECT k, aff, {_SHOWN} FROM w""",
)
def a9(spark: SparkSession, d: str) -> DataFrame:
    """Institutions of one short name merged and renumbered where that is allowed, the authors redirected."""
    return _listed(people.renumber_institutions(_talks(spark, d).withColumn("may", F.col("k") % 5 != 0), "may").drop("may"))


_PAIRS = "SELECT w[2 * j + 1] AS a, w[2 * j + 2] AS b FROM (SELECT w, unnest(range(0, len(w) >> 1)) AS j FROM (SELECT list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda x: x <> '') AS w FROM {0}))"
_AGREE = "len(list_filter(range(1, least(len(q.g), len(n.g)) + 1), lambda i: NOT (q.g[i] = n.g[i] OR (length(q.g[i]) = 1 AND starts_with(n.g[i], q.g[i])) OR (length(n.g[i]) = 1 AND starts_with(q.g[i], n.g[i]))))) = 0"


@query(
    "q6_people",
    f"""WITH n AS (SELECT DISTINCT name, s, g, words FROM (SELECT CASE length(a) % 3 WHEN 0 THEN a || ' ' || b WHEN 1 THEN b ELSE b || ', ' || a END AS name, lower(b) AS s, CASE length(a) % 3 WHEN 1 THEN [] ELSE [lower(a)] END AS g, CASE length(a) % 3 WHEN 1 THEN [lower(b)] ELSE [lower(a), lower(b)] END AS words FROM ({_PAIRS.format("documents")}))),
q AS (SELECT DISTINCT query, s, g, query AS word, one FROM (SELECT CASE length(b) % 3 WHEN 0 THEN lower(substr(a, 1, 1)) || ' ' || lower(substr(b, 1, 2)) WHEN 1 THEN lower(substr(b, 1, 4)) ELSE lower(a) || ' ' || lower(substr(b, 1, 3)) END AS query,
  CASE length(b) % 3 WHEN 0 THEN lower(substr(b, 1, 2)) WHEN 1 THEN lower(substr(b, 1, 4)) ELSE lower(substr(b, 1, 3)) END AS s, CASE length(b) % 3 WHEN 0 THEN [lower(substr(a, 1, 1))] WHEN 1 THEN [] ELSE [lower(a)] END AS g, length(b) % 3 = 1 AS one FROM ({_PAIRS.format("benchmark")}))),
p AS (SELECT query, name, CASE WHEN (q.s = n.s OR (length(q.s) >= 3 AND starts_with(n.s, q.s))) AND {_AGREE} THEN 1 WHEN len(q.g) > 0 AND len(n.g) > 0 AND starts_with(n.s, q.s) AND {_AGREE} THEN 2
  WHEN one AND length(q.word) >= 3 AND len(list_filter(n.words, lambda w: starts_with(w, q.word))) > 0 THEN 3 END AS pass FROM q JOIN n ON starts_with(n.s, q.s) OR (one AND starts_with(n.words[1], q.word)))
SELECT query, name, pass FROM p WHERE pass IS NOT NULL""",
)
def q6_people(spark: SparkSession, d: str) -> DataFrame:
    """Names of every two words of the documents, asked for with beginnings of the benchmark's words."""
    docs = {"documents": spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "benchmark": table(spark, d, "benchmark")}
    pair = lambda t: docs[t].select(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: w != "").alias("w")).where("size(w) >= 2").select(F.explode(F.transform(F.expr("sequence(1, size(w) - size(w) % 2, 2)"), lambda i: F.struct(F.get("w", i - 1).alias("a"), F.get("w", i).alias("b")))).alias("x")).select("x.*")
    names = pair("documents").select(F.expr("CASE length(a) % 3 WHEN 0 THEN concat(a, ' ', b) WHEN 1 THEN b ELSE concat(b, ', ', a) END").alias("name"))
    queries = pair("benchmark").select(F.expr("CASE length(b) % 3 WHEN 0 THEN lower(concat(substr(a, 1, 1), ' ', substr(b, 1, 2))) WHEN 1 THEN lower(substr(b, 1, 4)) ELSE lower(concat(a, ' ', substr(b, 1, 3))) END").alias("query"))
    return search.suggest_people(queries, names, "query", "name")
