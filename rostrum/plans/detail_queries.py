"""Queries of whole forms: numbered bodies, agenda cells, venues in prose, speakers with their places, curated values from files,
facets over several tables, counters, numbers of all items."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import aggregates as A
from rostrum.operators import filters as P
from rostrum.operators import people
from rostrum.operators import windows as N
from rostrum.plans.registry import query
from rostrum.session import shared_folder
from rostrum.sources import program
from rostrum.sources.tables import table


@query(
    "f16_numbered_bodies",
    r"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1)::INTEGER - 1 AS line, unnest(p) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
r AS (SELECT doc_id, line, CASE line % 3 WHEN 0 THEN line || '. ' || x WHEN 1 THEN ' ' || line || '.  ' || x ELSE x END AS raw FROM l)
SELECT doc_id, line, nullif(regexp_extract(raw, '^\s*([0-9]{1,9})\.\s+\S', 1), '')::INTEGER AS number, trim(CASE WHEN regexp_matches(raw, '^\s*[0-9]{1,9}\.\s+\S') THEN regexp_replace(raw, '^\s*[0-9]{1,9}\.\s+', '') ELSE raw END) AS body FROM r""",
)
def f16_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Every line of the documents, two of three with a number before them."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    n = F.col("line").cast("string")
    raw = F.when(F.col("line") % 3 == 0, F.concat(n, F.lit(". "), "x")).when(F.col("line") % 3 == 1, F.concat(F.lit(" "), n, F.lit(".  "), "x")).otherwise(F.col("x"))
    return lines.select("doc_id", "line", T.numbered_body(raw).alias("b")).select("doc_id", "line", "b.number", "b.body")


@query(
    "f31_agenda_cells",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'AB' || p_partkey END AS code, p_name AS name, CASE WHEN p_partkey % 4 < 2 THEN p_brand || ', ' || p_type END AS location FROM part""",
)
def f31_cells(spark: SparkSession, d: str) -> DataFrame:
    k, key = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    place = F.concat_ws(", ", "p_brand", "p_type")
    raw = F.when(k == 0, F.concat(F.lit("AB"), key, F.lit(" • "), "p_name", F.lit(",, "), place, F.lit(" ,"))).when(k == 1, F.concat("p_name", F.lit(" ,\n"), place)).when(k == 2, F.concat("p_name", F.lit(", Location to be Announced"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.agenda_cell(raw).alias("x")).select("p_partkey", "x.code", "x.name", "x.location")


_VENUE = r"\b(?:in|at)\s+the\s+((?:[A-Z][\w.&''’-]*\s+)*?(?:" + "|".join(T.VENUE_WORDS) + r"))\b"


@query(
    "f32_venue_prose",
    rf"""WITH b AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN chr(10) || chr(10) || 'All meet in the St. ' || upper(source[1:1]) || source[2:] || ' Jr. Ballroom at 18:00. Bring ' || coalesce(lang, 'it') || '!'
  WHEN 1 THEN ' Doors open at 9:30 at the Plaza.' || chr(10) || chr(10) || 'From 9:00 to 10:00.' ELSE '' END AS raw FROM documents),
p AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS para FROM (SELECT doc_id, string_split(raw, chr(10) || chr(10)) AS l FROM b)),
k AS (SELECT doc_id, i, trim(regexp_replace(array_to_string(list_filter(string_split(regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: NOT regexp_matches(s, '[0-9]{{1,2}}:[0-9]{{2}}')), ' '), '\s+', ' ', 'g')) AS para FROM p),
o AS (SELECT doc_id, string_agg(para, chr(10) || chr(10) ORDER BY i) FILTER (WHERE para <> '') AS prose FROM k GROUP BY doc_id)
SELECT doc_id, nullif(trim(regexp_replace(regexp_extract(raw, '{_VENUE}', 1), '\s+', ' ', 'g')), '') AS venue, coalesce(prose, '') AS prose FROM b JOIN o USING (doc_id)""",
)
def f32_venue(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as blurbs, two of three with a venue and times of their own."""
    k = F.col("doc_id") % 3
    own = F.concat(F.lit("\n\nAll meet in the St. "), F.upper(F.substring("source", 1, 1)), F.substr("source", F.lit(2)), F.lit(" Jr. Ballroom at 18:00. Bring "), F.coalesce("lang", F.lit("it")), F.lit("!"))
    raw = F.concat("text", F.when(k == 0, own).when(k == 1, "  Doors open at 9:30 at the Plaza.\n\nFrom 9:00 to 10:00.").otherwise(""))
    return table(spark, d, "documents").select("doc_id", T.venue_and_prose(raw).alias("x")).select("doc_id", "x.venue", "x.prose")


_CHOICE = """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'José ' || o_orderstatus WHEN 1 THEN 'J.' END AS scraped, CASE o_orderkey % 6 WHEN 2 THEN o_orderpriority || '; x' END AS marked,
  CASE WHEN o_orderkey % 6 IN (0, 3) THEN 'Jo ' || o_orderstatus WHEN o_orderkey % 6 = 1 THEN 'Jon' END AS shown, CASE WHEN o_orderkey % 6 <> 5 THEN ['Ann', o_orderpriority, 'JOSE ' || o_orderstatus, 'jo  ' || o_orderstatus] END AS authors FROM orders),
c AS (SELECT o_orderkey, coalesce(scraped, split_part(marked, ';', 1), shown, authors[1]) AS speaker, CASE WHEN length(scraped) > length(shown) THEN 'fuller' WHEN scraped IS NOT NULL THEN 'scraped' WHEN marked IS NOT NULL THEN 'underlined' WHEN shown IS NOT NULL THEN 'presenter' WHEN len(authors) > 0 THEN 'first' END AS source,
  coalesce(list_position(list_transform(authors, lambda a: regexp_replace(lower(strip_accents(a)), ' +', ' ', 'g')), lower(strip_accents(speaker))) - 1, -1)::INTEGER AS position FROM s)
"""


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    k, status, priority = F.col("o_orderkey") % 6, F.col("o_orderstatus"), F.col("o_orderpriority")
    scraped = F.when(k == 0, F.concat(F.lit("José "), status)).when(k == 1, "J.").otherwise(" ")
    shown = F.when(k.isin(0, 3), F.concat(F.lit("Jo "), status)).when(k == 1, "Jon")
    authors = F.when(k != 5, F.array(F.lit("Ann"), priority, F.concat(F.lit("JOSE "), status), F.concat(F.lit("jo  "), status)))
    choice = people.chosen_speaker(scraped, F.when(k == 2, F.concat(priority, F.lit("; x"))), shown, authors)
    return table(spark, d, "orders").select("o_orderkey", choice.alias("c")).select("o_orderkey", "c.*")


@query("p19_speaker_place", _CHOICE + "SELECT * FROM c")
def p19_place(spark: SparkSession, d: str) -> DataFrame:
    return _chosen(spark, d)


@query("a14_counters", _CHOICE + "SELECT count(*) AS n, count(*) FILTER (WHERE position >= 0) AS matched, count(*) FILTER (WHERE source = 'fuller') AS upgraded, count(*) FILTER (WHERE source IN ('scraped', 'underlined')) AS filled, count(*) FILTER (WHERE source IN ('presenter', 'first')) AS fallback FROM c")
def a14_counters(spark: SparkSession, d: str) -> DataFrame:
    source = F.col("source")
    return A.counters(_chosen(spark, d), {"matched": F.col("position") >= 0, "upgraded": source == "fuller", "filled": source.isin("scraped", "underlined"), "fallback": source.isin("presenter", "first")})


@query(
    "p21_file_overrides",
    """SELECT c_custkey, coalesce(n_name, c_mktsegment) AS aff FROM customer LEFT JOIN nation ON n_regionkey > 0 AND n_nationkey = c_custkey % 40 AND chr((97 + n_nationkey % 5)::INTEGER) = chr((97 + c_custkey % 3)::INTEGER)""",
)
def p21_file(spark: SparkSession, d: str) -> DataFrame:
    """Overrides written from the nations as a commented, tab-separated file, read back and laid over the customers."""
    letter = lambda n: F.chr((97 + n).cast("int"))
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    line = F.when(region == 0, F.concat(F.lit("# "), "n_name")).otherwise(F.concat(F.lit(" S"), key.cast("string"), F.lit(" \t"), letter(key % 5), F.lit("\t"), "n_name", F.lit(" ")))
    path = f"{shared_folder(spark)}/overrides-{uuid4().hex}"
    table(spark, d, "nation").select(line.alias("value")).write.text(path)
    cust = F.col("c_custkey")
    given, surname = F.concat(letter(cust % 3), F.lit("nn")), F.concat(F.lit("S"), (cust % 40).cast("string"))
    name = F.when(cust % 2 == 0, F.concat_ws(", ", surname, given)).otherwise(F.concat_ws(" ", given, F.lit("M."), surname))
    people_ = table(spark, d, "customer").select("c_custkey", name.alias("name"), F.col("c_mktsegment").alias("aff"))
    return people.overridden(people_, "name", "aff", people.read_overrides(spark, path)).select("c_custkey", "aff")


@query(
    "a8_union_facets",
    """WITH t(id, label, ord) AS (VALUES ('view', 'Views', 1), ('click', 'Clicks', 2), ('neutral', 'Other', 3), ('f', 'Filled', 5), ('o', 'Open', 6)),
x AS (SELECT coalesce(nullif(event_type, 'signup'), 'neutral') AS id FROM events UNION ALL SELECT coalesce(nullif(lower(o_orderstatus), 'p'), 'neutral') FROM orders)
SELECT id, label, ord, count(*) AS n FROM x JOIN t USING (id) GROUP BY ALL""",
)
def a8_union(spark: SparkSession, d: str) -> DataFrame:
    kinds = lambda *rows: spark.createDataFrame(rows, "id string, label string, ord int")
    events = table(spark, d, "events").select(F.nullif("event_type", F.lit("signup")).alias("color"))
    orders = table(spark, d, "orders").select(F.nullif(F.lower("o_orderstatus"), F.lit("p")).alias("color"))
    first = kinds(("neutral", "Other", 9), ("view", "Views", 1), ("click", "Clicks", 2), ("unused", "Unused", 30))
    second = kinds(("f", "Filled", 1), ("neutral", "Rest", 2), ("o", "Open", 3))
    return A.union_facets([(events, "color", first), (orders, "color", second)])


@query(
    "w7_all_items",
    """WITH i AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS p FROM lineitem GROUP BY ALL), r AS (SELECT l_orderkey, l_suppkey, min(-l_linenumber) AS place FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)
SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY place NULLS LAST, p, l_suppkey)::INTEGER AS new_number FROM i LEFT JOIN r USING (l_orderkey, l_suppkey)""",
)
def w7_all(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers of every order, by references from its last line up, unreferenced ones behind."""
    lines = table(spark, d, "lineitem")
    items = lines.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("place"))
    references = lines.where("l_returnflag = 'N'").select("l_orderkey", "l_suppkey", (-F.col("l_linenumber")).alias("at"))
    return N.renumber_all(items, references, "l_orderkey", "l_suppkey", ["at"], "place")


@query(
    "p7_compact_location",
    """WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN l_returnflag WHEN l_linenumber % 4 = 1 THEN '' END AS os, CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN l_linestatus END AS o,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END AS ps, CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END AS p FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN os <> '' THEN os WHEN o IS NOT NULL THEN o WHEN ps <> '' THEN ps WHEN p <> '' THEN p ELSE '' END AS place FROM x""",
)
def p7_compact(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "lineitem").join(table(spark, d, "orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    line, supp = F.col("l_linenumber") % 4, F.col("l_suppkey") % 3
    own = F.when(line == 0, F.col("l_returnflag")).when(line == 1, ""), F.when(supp == 0, "").when(supp == 1, F.col("l_linestatus"))
    parent = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus")), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority"))
    return both.select("l_orderkey", "l_linenumber", P.compact_place(*own, *parent).alias("place"))


@query(
    "j24_speaker_affiliation",
    """WITH l AS (SELECT l_orderkey AS k, list({'i': l_linenumber, 'name': 'P' || l_suppkey % 5, 'insts': CASE l_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN [l_partkey % 6] WHEN 2 THEN [l_suppkey % 6, 7, l_partkey % 6] END} ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY l_orderkey),
x AS (SELECT k, a, 'p' || k % 5 AS s, a[-1] AS z FROM l),
y AS (SELECT *, list_distinct(list_filter(list_filter(a, lambda r: lower(r.name) = s)[1].insts, lambda n: n BETWEEN 1 AND 4)) AS d, list_filter(list_filter(a, lambda r: lower(r.name) = s)[1].insts, lambda n: n BETWEEN 1 AND 4) AS own, list_filter(z.insts, lambda n: n BETWEEN 1 AND 4) AS last FROM x)
SELECT k AS l_orderkey, 'I' || coalesce(CASE WHEN len(d) > 1 THEN list_filter(own, lambda n: list_contains(last, n))[1] END, own[1], CASE WHEN len(list_filter(a, lambda r: len(r.insts) > 0)) > 0 AND lower(z.name) <> s THEN last[1] END, 1) AS aff FROM y""",
)
def j24_speaker(spark: SparkSession, d: str) -> DataFrame:
    """Speakers of orders with authors from their lines; numbers 1 to 4 have an institution."""
    k = F.col("l_partkey") % 4
    number = lambda c: (F.col(c) % 6).cast("int")
    insts = F.when(k == 0, F.array().cast("array<int>")).when(k == 1, F.array(number("l_partkey"))).when(k == 2, F.array(number("l_suppkey"), F.lit(7), number("l_partkey")))
    author = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.concat(F.lit("P"), (F.col("l_suppkey") % 5).cast("string")).alias("name"), insts.alias("insts")).alias("a"))
    talks = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(author)), lambda x: x["a"]).alias("authors"))
    institutions = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f"I{n}").alias("short")) for n in range(1, 5)])
    speaker = F.concat(F.lit("p"), (F.col("l_orderkey") % 5).cast("string"))
    return talks.select("l_orderkey", people.speaker_affiliation(speaker, F.col("authors"), institutions).alias("aff"))


@query(
    "s11_full_report",
    r"""WITH b AS (SELECT conv_id, 1 AS g, turn, turn || ', ' || CASE WHEN turn % 3 = 0 THEN '(untitled)' ELSE role END || ', ' || CASE WHEN turn % 2 = 0 THEN 'Ann B; ' || role || '*' ELSE 'Ann B*; ' || role END AS head, regexp_replace(text, '^\s+|\s+$', '', 'g') AS note FROM conversations WHERE turn % 4 < 3
UNION ALL SELECT conv_id, 0, NULL, 'General notes', regexp_replace(text, '^\s+|\s+$', '', 'g') FROM conversations WHERE turn = 1),
t AS (SELECT conv_id, string_agg(head || chr(10) || '  ' || replace(note, chr(10), chr(10) || '  ') || chr(10), chr(10) ORDER BY g, turn) AS report FROM b WHERE note <> '' GROUP BY conv_id)
SELECT conv_id, coalesce(report, '(No notes yet.)') AS report FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN t USING (conv_id)""",
)
def s11_full(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    notes = turns.where("turn % 4 < 3").select("conv_id", "turn", F.col("text").alias("note")).unionByName(turns.where("turn = 1").select("conv_id", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.col("text").alias("note")))
    even = F.col("turn") % 2 == 0
    items = turns.select("conv_id", "turn", F.col("turn").alias("at"), F.when(F.col("turn") % 3 > 0, F.col("role")).otherwise(" ").alias("title"), F.array(F.lit("Ann B"), F.lit(" "), "role").alias("authors"), F.when(even, F.upper("role")).otherwise("ann  b").alias("speaker"))
    return program.full_notes_report(items, notes, "conv_id", "turn", "at", "title", "authors", "speaker", "note")
