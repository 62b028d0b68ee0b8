"""Queries of the text functions (F1-F32) over documents, pages and the reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.plans.registry import query
from rostrum.sources.tables import spread, table

_FOLD = "replace(replace(replace(replace(replace(replace(replace(replace(lower(strip_accents({0})), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th'), 'ø', 'o'), 'đ', 'd'), 'ð', 'd'), 'ł', 'l')"
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
FIXES = (("universtiy|univeristy", "university"), (r"\buniv\.", "university"), ("the thing", "thing"))
_NORMAL = _SQUEEZE.format("regexp_replace(regexp_replace(regexp_replace(translate(" + _FOLD.format("text") + r", '–—‘’“”', '--''''\"\"'), 'universtiy|univeristy', 'university', 'g'), '\buniv\.', 'university', 'g'), 'the thing', 'thing', 'g')").replace('\\"', '"')


@query("f1_search_fold", f"SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("f2_normal_form", f"SELECT doc_id, {_NORMAL} AS normal FROM documents")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normal_form(F.col("text"), FIXES).alias("normal"))


_DECODE = "replace(replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@query(
    "f3_clean_title",
    f"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_SQUEEZE.format("replace(" + _DECODE.format("raw") + ", chr(160), ' ')")}, '([0-9]) ?um\\b', '\\1μm', 'g'), '\\s*[\\[(]$', ''), '([^.])\\.$', '\\1') AS title FROM t""",
)
def f3(spark: SparkSession, d: str) -> DataFrame:
    raw = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", T.clean_title(raw).alias("title"))


@query(
    "f4_shouting",
    "SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 3 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) >= length(regexp_replace(text, '[^A-Za-z]', '', 'g')) * 0.8 AS shouting FROM documents",
)
def f4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.is_shouting(F.col("text")).alias("shouting"))


@query(
    "f6_tidy_location",
    r"""WITH t AS (SELECT c_custkey, '  Hall  ((' || c_mktsegment || '))' || CASE WHEN c_nationkey % 3 = 0 THEN ')' ELSE '' END AS raw FROM customer),
u AS (SELECT c_custkey, regexp_replace(regexp_replace(trim(regexp_replace(raw, '\s+', ' ', 'g')), '\(\(+', '(', 'g'), '\)\)+', ')', 'g') AS x FROM t)
SELECT c_custkey, CASE WHEN length(replace(x, '(', '')) > length(replace(x, ')', '')) THEN regexp_replace(x, '\)$', '') ELSE x END AS place FROM u""",
)
def f6(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("  Hall  (("), "c_mktsegment", F.lit("))"), F.when(F.col("c_nationkey") % 3 == 0, ")").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", T.tidy_location(raw).alias("place"))


PLACES = {"Convention Center": "CC", "North Hall": "NH", "Terrace": "T"}


@query(
    "f7_compact_location",
    """WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'North Hall, Room ' WHEN 1 THEN 'convention center Level ' WHEN 2 THEN 'Garden, Room ' ELSE 'Terrace #' END || p_size AS raw, p_size FROM part)
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'NH ' || p_size WHEN 1 THEN 'CC ' || p_size WHEN 2 THEN raw ELSE 'T ' || p_size END AS place FROM t""",
)
def f7(spark: SparkSession, d: str) -> DataFrame:
    by = F.col("p_size") % 4
    raw = F.concat(F.when(by == 0, "North Hall, Room ").when(by == 1, "convention center Level ").when(by == 2, "Garden, Room ").otherwise("Terrace #"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", T.compact_location(raw, PLACES).alias("place"))


_WORDS = r"list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda x: x <> '')"


def _runs(spark: SparkSession, d: str, n: int) -> DataFrame:
    """(doc_id, source, pos, run, w): the words (A-Z, a-z) of every whole document in runs of n, the last one shorter; with single blanks
    between, and as an array."""
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    # two passes of patterns over the text give the runs as strings: arrays of words cost some times as much for each run
    runs = F.regexp_extract_all(F.regexp_replace("text", "[^A-Za-z]+", " "), F.lit(f"[A-Za-z]+(?: [A-Za-z]+){{0,{n - 1}}}"), F.lit(0))
    return docs.select("doc_id", "source", F.posexplode(runs).alias("pos", "run")).withColumn("w", F.split("run", " "))


@query(
    "f8_repair_names",
    f"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
u AS (SELECT doc_id, k AS pos, w[3 * k + 1:3 * k + 3] AS p FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 2) // 3)) AS k FROM t))
SELECT doc_id, pos::INTEGER AS pos, array_to_string(list_transform(p, lambda x, i: CASE
  WHEN i > 1 AND i < len(p) AND lower(x) IN ('da', 'de', 'del', 'der', 'di', 'du', 'la', 'le', 'van', 'von') THEN lower(x)
  WHEN length(x) >= 3 AND regexp_matches(upper(x), '[AEIOUY]') THEN upper(x[1:1]) || lower(x[2:]) ELSE upper(x) END), ' ') AS name FROM u""",
)
def f8(spark: SparkSession, d: str) -> DataFrame:
    """Every three words of every whole document as a shouted name."""
    return _runs(spark, d, 3).select("doc_id", "pos", T.repaired_name(F.upper("run")).alias("name"))


_PERSON = "CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ', José-María' WHEN c_custkey % 4 = 1 THEN 'Ann B. ' || c_mktsegment WHEN c_custkey % 4 = 2 THEN c_mktsegment || ', Ann B.' ELSE 'J. ' || c_mktsegment END"


def _persons(spark: SparkSession, d: str) -> DataFrame:
    """Names of four shapes, derived from the customers."""
    k, seg = F.col("c_custkey") % 4, F.col("c_mktsegment")
    name = F.when(k == 0, F.concat(seg, F.lit(", José-María"))).when(k == 1, F.concat(F.lit("Ann B. "), seg)).when(k == 2, F.concat(seg, F.lit(", Ann B."))).otherwise(F.concat(F.lit("J. "), seg))
    return spread(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("c_custkey", name.alias("name"))


@query("f9_given_first", f"WITH t AS (SELECT c_custkey, {_PERSON} AS name FROM customer) SELECT c_custkey, CASE WHEN regexp_full_match(name, '\\S+,\\s+\\S+') THEN regexp_replace(name, '^(\\S+),\\s+(\\S+)$', '\\2 \\1') ELSE name END AS name FROM t")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return _persons(spark, d).select("c_custkey", T.given_first(F.col("name")).alias("name"))


@query("f10_names_everywhere")
def f10(spark: SparkSession, d: str) -> DataFrame:
    """Name repair in a column, in an array and in a joined list, with the number of values changed."""
    from rostrum.operators.people import repair_all

    people = _persons(spark, d).select("c_custkey", F.upper("name").alias("speaker"), F.array("name", F.upper("name")).alias("authors"), F.concat_ws("; ", "name", F.upper("name")).alias("chairs"))
    return repair_all(people, ["speaker"], ["authors"], ["chairs"])


@query(
    "f11_name_keys",
    f"""WITH t AS (SELECT c_custkey, {_PERSON} AS name FROM customer),
u AS (SELECT c_custkey, CASE WHEN regexp_full_match(name, '\\S+,\\s+\\S+') THEN regexp_replace(name, '^(\\S+),\\s+(\\S+)$', '\\2 \\1') ELSE name END AS name FROM t)
SELECT c_custkey, lower(strip_accents(string_split(name, ' ')[-1])) || '|' || lower(strip_accents(name[1:1])) AS match_key, lower(name[1:1]) || ' ' || lower(string_split(name, ' ')[-1]) AS record_key FROM u""",
)
def f11(spark: SparkSession, d: str) -> DataFrame:
    return _persons(spark, d).select("c_custkey", T.surname_initial(F.col("name")).alias("match_key"), T.initial_surname(F.col("name")).alias("record_key"))


@query(
    "f12_parse_person",
    f"""WITH t AS (SELECT c_custkey, {_FOLD.format("regexp_replace(" + _PERSON + ", '^([^,]+),\\s*(.+)$', '\\2 \\1')")} AS name FROM customer),
u AS (SELECT c_custkey, list_filter(string_split(name, ' '), lambda x: regexp_matches(x, '[a-z]')) AS p FROM t)
SELECT c_custkey, p[-1] AS surname, array_to_string(list_filter(string_split_regex(array_to_string(p[1:len(p) - 1], ' '), '[ .-]+'), lambda x: x <> ''), '/') AS given FROM u""",
)
def f12(spark: SparkSession, d: str) -> DataFrame:
    p = _persons(spark, d).select("c_custkey", T.person(F.col("name")).alias("p"))
    return p.select("c_custkey", "p.surname", F.array_join("p.given", "/").alias("given"))


@query("f13_abbreviate", f"WITH t AS (SELECT c_custkey, string_split({_PERSON}, ' ') AS p FROM customer) SELECT c_custkey, array_to_string(list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x[1:1] || '.' ELSE x END), ' ') AS short FROM t")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return _persons(spark, d).select("c_custkey", T.abbreviated(F.col("name")).alias("short"))


@query(
    "f14_title_keys",
    f"WITH t AS (SELECT doc_id, generate_subscripts(p, 1)::INTEGER - 1 AS pos, unnest(p) AS title FROM (SELECT doc_id, string_split(text, '.') AS p FROM documents)) SELECT doc_id, pos, {_SQUEEZE.format('lower(title)')} AS plain_key, regexp_replace({_FOLD.format('title')}, '[^a-z0-9]', '', 'g') AS alnum_key FROM t",
)
def f14(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every whole document as a title."""
    title = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("pos", "title"))
    return title.select("doc_id", "pos", T.title_key(F.col("title")).alias("plain_key"), T.alnum_key(F.col("title")).alias("alnum_key"))


@query(
    "f15_split_outside",
    "SELECT s_suppkey, unnest([1, 2]) AS pos, unnest([s_name, 'Annex']) AS name, unnest(['Hall; ' || s_nationkey, NULL]) AS place FROM supplier",
)
def f15(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("s_name", F.lit(" (Hall; "), F.col("s_nationkey").cast("string"), F.lit("); Annex"))
    parts = table(spark, d, "supplier").select("s_suppkey", F.posexplode(T.split_outside(raw)).alias("pos", "part"))
    return parts.select("s_suppkey", (F.col("pos") + 1).alias("pos"), T.name_and_place(F.col("part")).alias("x")).select("s_suppkey", "pos", "x.name", "x.place")


@query(
    "f16_numbered_names",
    "SELECT l_orderkey, l_linenumber, unnest(['Part ' || l_partkey, 'Supplier']) AS name, unnest([(l_linenumber + l_suppkey)::INTEGER, l_suppkey::INTEGER]) AS inst_sum FROM lineitem",
)
def f16(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit("="), F.col("l_linenumber").cast("string"), F.lit(","), F.col("l_suppkey").cast("string"), F.lit("; Supplier="), F.col("l_suppkey").cast("string"), F.lit(",x"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(T.numbered_names(raw)).alias("a"))
    return rows.select("l_orderkey", "l_linenumber", "a.name", F.aggregate("a.insts", F.lit(0), lambda s, x: s + x).alias("inst_sum"))


@query(
    "f17_loose_aliases",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'low' ELSE 'low/' || lower(o_orderstatus) END AS aliases FROM orders",
)
def f17(spark: SparkSession, d: str) -> DataFrame:
    aliases = F.array(F.lit("low"), F.lower("o_orderstatus"), F.lit("L OW"), F.lower("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.without_known(aliases, F.array(F.lit("O "))), "/").alias("aliases"))


@query("f18_group_layout", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Ann/' || s_name ELSE 'Bo' END AS names, CASE WHEN s_suppkey % 2 = 0 THEN 'X University/Lab (Land)' ELSE s_name || ' (Land)' END AS institutions FROM supplier")
def f18(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Ann, "), "s_name", F.lit(", X University, Lab (Land)"))).otherwise(F.concat(F.lit("Bo, "), "s_name", F.lit(" (Land)")))
    x = table(spark, d, "supplier").select("s_suppkey", T.names_then_institutions(raw).alias("x"))
    return x.select("s_suppkey", F.array_join("x.names", "/").alias("names"), F.array_join("x.institutions", "/").alias("institutions"))


@query(
    "f19_parse_times",
    "SELECT o_orderkey, o_orderdate AS at, CASE WHEN o_orderkey % 2 = 0 THEN 545 + 720 ELSE 9 END AS minutes FROM orders",
)
def f19(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    raw = F.when(even, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, d, "orders").select("o_orderkey", T.first_timestamp(raw, ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy")).cast("timestamp_ntz").alias("at"), T.clock_minutes(F.when(even, F.lit("9:05 PM")).otherwise(F.lit("12:09 AM"))).alias("minutes"))


@query(
    "f20_leading_code",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 'AB' || p_partkey || '.1' END AS code, p_name AS rest FROM part",
)
def f20(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lit("AB"), F.col("p_partkey").cast("string"), F.lit(".1"))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(code, F.lit(": "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(code, "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.leading_code(raw).alias("x")).select("p_partkey", "x.code", "x.rest")


@query(
    "f21_status_markers",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'invited/withdrawn' WHEN 'O' THEN 'withdrawn' ELSE '' END AS markers, o_orderpriority AS title FROM orders",
)
def f21(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.when(F.col("o_orderstatus") == "F", "[Invited] ").otherwise(""), "o_orderpriority", F.when(F.col("o_orderstatus") != "P", " (WITHDRAWN)").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", T.status_markers(raw, ("invited", "withdrawn", "student")).alias("x")).select("o_orderkey", F.array_join("x.markers", "/").alias("markers"), F.col("x.text").alias("title"))


_TEXT = r"trim(" + _DECODE.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '<script[\s\S]*?</script>|<style[\s\S]*?</style>|<!--[\s\S]*?-->', '', 'g'), '<br\s*/?>|</(?:p|div|h[1-6]|li|tr)>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')") + ")"


@query(
    "f22_html_text",
    rf"WITH t AS (SELECT page_id, CASE WHEN regexp_matches(html, '<article>[\s\S]*?</article>') THEN regexp_extract(html, '<article>([\s\S]*?)</article>', 1) ELSE html END AS m FROM pages) SELECT page_id, {_TEXT} AS body FROM t",
)
def f22(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.html_text(T.html_main(F.col("html"))).alias("body"))


@query(
    "f23_markup_records",
    """WITH t AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS l FROM pages)
SELECT page_id, unnest(range(1, len(h) + 1)) AS pos, unnest(h) AS href, unnest(l) AS label FROM t""",
)
def f23(spark: SparkSession, d: str) -> DataFrame:
    tag = r'(<a href="[^"]*">[^<]*</a>)'
    rows = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(tag))).alias("pos", "tag"))
    return rows.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), F.regexp_extract("tag", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("tag", ">([^<]*)<", 1).alias("label"))


@query("f24_polish_label", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'University of X' || s_suppkey END AS label FROM supplier")
def f24(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" Co., Ltd. (Asia)"))).otherwise(F.concat(F.lit("U. of X"), F.col("s_suppkey").cast("string"), F.lit(" - UOX")))
    return table(spark, d, "supplier").select("s_suppkey", T.polished_label(raw).alias("label"))


_ADDRESS = "CASE WHEN s_suppkey % 3 = 0 THEN 'Dept. of Parts, ' || s_name || ', 12345' WHEN s_suppkey % 3 = 1 THEN s_name || ' University, Main Street 5, Town' ELSE '12 Road, Town, ' || s_name END"


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("Dept. of Parts, "), "s_name", F.lit(", 12345"))).when(k == 1, F.concat("s_name", F.lit(" University, Main Street 5, Town"))).otherwise(F.concat(F.lit("12 Road, Town, "), "s_name"))
    return table(spark, d, "supplier").select("s_suppkey", "s_name", raw.alias("raw"))


@query("f25_short_address", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN s_name || ' University' ELSE '12 Road' END AS short FROM supplier")
def f25(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("s_suppkey", T.short_address(F.col("raw")).alias("short"))


@query("f26_heuristic_short", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'mapped' WHEN s_suppkey % 3 = 0 THEN 'Dept. of Parts' WHEN s_suppkey % 3 = 1 THEN s_name || ' University' ELSE '12 Road' END AS short FROM supplier")
def f26(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("s_suppkey", T.heuristic_short(F.col("raw"), F.when(F.col("s_suppkey") % 5 == 0, "mapped")).alias("short"))


@query("f27_clean_affiliation", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN s_name || ' University' ELSE s_name END AS aff FROM supplier")
def f27(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("s_suppkey", T.cleaned_affiliation(F.col("raw")).alias("aff"))


@query("f28_author_list", "SELECT s_suppkey, unnest([1, 2]) AS pos, unnest([s_name, 'Solo']) AS name, unnest(['Town, Land', NULL]) AS aff FROM supplier")
def f28(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("s_name", F.lit(", Town, Land / Solo / "))
    rows = table(spark, d, "supplier").select("s_suppkey", F.posexplode(T.author_list(raw)).alias("pos", "a"))
    return rows.select("s_suppkey", (F.col("pos") + 1).alias("pos"), "a.name", "a.aff")


@query(
    "f29_cell_from_right",
    f"""WITH t AS (SELECT doc_id, source, {_WORDS} AS w FROM documents),
u AS (SELECT doc_id, source, k AS pos, w[2 * k + 1:2 * k + 2] AS w FROM (SELECT doc_id, source, w, unnest(range(0, (len(w) + 1) // 2)) AS k FROM t))
SELECT doc_id, pos::INTEGER AS pos, array_to_string(w, ' ') AS title, CASE WHEN (doc_id + pos) % 2 = 0 THEN 'Ann Lee' END AS speaker, CASE WHEN (doc_id + pos) % 3 > 0 THEN source END AS aff FROM u""",
)
def f29(spark: SparkSession, d: str) -> DataFrame:
    """Every two words of every whole document as a title, with a speaker or an affiliation behind some of them."""
    k = F.col("doc_id") + F.col("pos")
    raw = F.concat("run", F.when(k % 2 == 0, ". Ann Lee").otherwise(""), F.when((k % 3 > 0) & F.col("source").isNotNull(), F.concat(F.lit(", "), "source")).otherwise(""))
    return _runs(spark, d, 2).select("doc_id", "pos", T.cell_from_right(raw).alias("x")).select("doc_id", "pos", "x.*")


@query("f30_name_guard", "WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s, text FROM documents) SELECT doc_id, len(string_split(s, ' ')) <= 6 AND NOT regexp_matches(text, '[0-9;]|[.!?] ') AND NOT regexp_matches(lower(text), '\\b(university|department|street)\\b') AS name_like FROM t")
def f30(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.looks_like_name(F.col("text")).alias("name_like"))


@query("f31_title_venue", "SELECT p_partkey, p_name AS title, CASE p_partkey % 3 WHEN 0 THEN 'Hall ' || p_size WHEN 1 THEN 'Room ' || p_size END AS venue FROM part")
def f31(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat("p_name", F.lit(" (Hall "), size, F.lit(")"))).when(k == 1, F.concat("p_name", F.lit(", Room "), size)).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.title_and_venue(raw).alias("x")).select("p_partkey", "x.title", "x.venue")


_PROSE = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, array_to_string(list_filter(string_split(regexp_replace(line, '[.] +', '.' || chr(1), 'g'), chr(1)), lambda s: NOT regexp_matches(s, '(?i)\\bthe\\b')), ' ') AS kept FROM l)
SELECT doc_id, coalesce(string_agg(kept, chr(10) ORDER BY i) FILTER (WHERE kept <> ''), '') AS prose FROM k GROUP BY doc_id"""


@query("f32_prose", _PROSE)
def f32(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.prose(F.col("text"), r"(?i)\bthe\b").alias("prose"))
