"""Queries of the joins (J1-J25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import matching as J
from rostrum.operators import people
from rostrum.operators.shared import hinted
from rostrum.plans.registry import query
from rostrum.sources.tables import spread, table


@query("j1_child_to_parent", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def j1(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(orders, "l_orderkey", "left")


@query("j2_children_in_order", "SELECT l_orderkey, l_partkey, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY p_size, l_linenumber, l_partkey) AS rank FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey")
def j2(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_set(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    parents = parents.withColumn("ids", F.concat("ids", F.array(F.lit(-1).cast("long"))))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    return J.children_in_order(parents, parts, "l_orderkey", "ids", "l_partkey", "p_size").select("l_orderkey", "l_partkey", "p_name", "rank")


@query("j3_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j3(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey")


@query("j4_partially_selected", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)) AND o_orderstatus <> 'O'")
def j4(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    return J.partially_selected(orders.select("o_orderkey"), lines, orders.where("o_orderstatus = 'O'"), table(spark, d, "part").where("p_size = 7"), "o_orderkey", "p_partkey")


@query(
    "j5_author_institutions",
    """WITH u AS (SELECT l_orderkey, l_linenumber, unnest([l_suppkey % 5, l_partkey % 5]) AS n, unnest([0, 1]) AS pos FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber, n, min(pos) AS pos FROM u GROUP BY ALL)
SELECT l_orderkey, l_linenumber, string_agg(r_name, '; ' ORDER BY pos, n) AS insts FROM f JOIN region ON r_regionkey = n GROUP BY ALL""",
)
def j5(spark: SparkSession, d: str) -> DataFrame:
    numbers = F.array_distinct(F.array(F.col("l_suppkey") % 5, F.col("l_partkey") % 5))
    each = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(numbers).alias("pos", "n")).groupBy("l_orderkey", "l_linenumber", "n").agg(F.min("pos").alias("pos"))
    named = each.join(hinted(table(spark, d, "region")), F.col("n") == F.col("r_regionkey"))  # five keys: a shuffle by them is five tasks
    ordered = F.array_sort(F.collect_list(F.struct("pos", "n", "r_name")))
    return named.groupBy("l_orderkey", "l_linenumber").agg(F.array_join(F.transform(ordered, lambda x: x["r_name"]), "; ").alias("insts"))


@query(
    "j6_lookup_cascade",
    """SELECT p_partkey, coalesce(a.s_name, b.s_name) AS s_name FROM part LEFT JOIN supplier a ON a.s_suppkey = p_partkey
LEFT JOIN (SELECT s_nationkey, arg_max(s_name, s_suppkey) AS s_name FROM supplier GROUP BY s_nationkey) b ON b.s_nationkey = p_size""",
)
def j6(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("s_suppkey"), F.col("p_size").alias("s_nationkey"))
    right = table(spark, d, "supplier").withColumn("pos", F.col("s_suppkey"))
    return J.cascade(left, right, [(["s_suppkey"], "pos"), (["s_nationkey"], "pos")], "s_name").select("p_partkey", "s_name")


@query(
    "j7_upgrade_names",
    """WITH l AS (SELECT l_orderkey, l_linenumber AS pos, CASE WHEN l_partkey % 2 = 0 THEN 'A.' ELSE 'Bo' END || ' S' || l_suppkey % 7 AS name FROM lineitem WHERE l_returnflag = 'R'),
r AS (SELECT l_orderkey, lower(substr(name, 1, 1)) || ' ' || lower(split_part(name, ' ', 2)) AS k, arg_min(name, pos) AS other FROM (SELECT l_orderkey, l_linenumber AS pos, CASE WHEN l_partkey % 2 = 0 THEN 'Anna' ELSE 'B.' END || ' S' || l_suppkey % 7 AS name FROM lineitem WHERE l_returnflag <> 'R') GROUP BY ALL)
SELECT l.l_orderkey, pos, CASE WHEN length(other) > length(name) THEN other ELSE name END AS name FROM l LEFT JOIN r ON r.l_orderkey = l.l_orderkey AND k = lower(substr(name, 1, 1)) || ' ' || lower(split_part(name, ' ', 2))""",
)
def j7(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("even", F.col("l_partkey") % 2 == 0)
    surname = F.concat(F.lit(" S"), (F.col("l_suppkey") % 7).cast("string"))
    name = lambda even, odd: F.concat(F.when(F.col("even"), even).otherwise(odd), surname)
    own = lines.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("pos"), name("A.", "Bo").alias("name"))
    other = lines.where("l_returnflag != 'R'").select("l_orderkey", F.col("l_linenumber").alias("pos"), name("Anna", "B.").alias("name"))
    return people.upgrade_names(own, other, "l_orderkey", "name", "pos")


_WORDS = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 8))"


def _words(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    return spread(table(spark, d, name).select(key, "text"), key).select(F.col(key).alias(f"{name}_id"), F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 8)).alias("words"))


@query(
    "j8_layered_match",
    f"""WITH p AS (SELECT p_partkey, p_name, p_brand, p_size FROM part), r AS (SELECT DISTINCT p_name AS t FROM part)
SELECT p_partkey, CASE WHEN e.t IS NOT NULL THEN 1 WHEN n.t IS NOT NULL THEN 2 WHEN i.t IS NOT NULL THEN 3 END AS pass, coalesce(e.t, n.t, i.t) AS matched
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || 'x' ELSE substr(p_name, 1, 1) || '. ' || split_part(p_name, ' ', 2) END AS q FROM part) p
LEFT JOIN LATERAL (SELECT min(t) AS t FROM r WHERE t = q) e ON true LEFT JOIN LATERAL (SELECT min(t) AS t FROM r WHERE levenshtein(t, q) <= 2) n ON true
LEFT JOIN LATERAL (SELECT min(t) AS t FROM r WHERE substr(t, 1, 1) = substr(q, 1, 1) AND split_part(t, ' ', 2) = split_part(q, ' ', 2)) i ON true""",
)
def j8(spark: SparkSession, d: str) -> DataFrame:
    """Exact name, then up to two edits, then surname and initial: the first pass that hits wins."""
    k = F.col("p_partkey") % 3
    q = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit("x"))).otherwise(F.concat(F.substring("p_name", 1, 1), F.lit(". "), F.split_part("p_name", F.lit(" "), F.lit(2))))
    left = table(spark, d, "part").select("p_partkey", q.alias("q"))
    right = table(spark, d, "part").select(F.col("p_name").alias("t")).distinct()
    asked = left.select("q").distinct()
    key = lambda c: F.struct(F.substring(c, 1, 1), F.split_part(c, F.lit(" "), F.lit(2)))
    passes = [
        asked.join(right.hint("merge"), F.col("q") == F.col("t")).select("q", F.lit(1).alias("pass"), "t"),
        J.edit_distance_join(asked, right, "q", "t", 2).select("q", F.lit(2).alias("pass"), "t"),
        asked.join(right.hint("merge"), key(F.col("q")) == key(F.col("t"))).select("q", F.lit(3).alias("pass"), "t"),
    ]
    best = passes[0].unionByName(passes[1]).unionByName(passes[2]).groupBy("q").agg(F.min(F.struct("pass", "t")).alias("best"))
    return left.join(best.hint("merge"), "q", "left").select("p_partkey", "best.pass", F.col("best.t").alias("matched"))


@query("j9_edit_distance", "SELECT a.name AS a_name, b.name AS b_name, levenshtein(a.name, b.name) AS distance FROM (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part) a JOIN (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part) b ON levenshtein(a.name, b.name) <= 2")
def j9(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct()
    return J.edit_distance_join(names.toDF("a_name"), names.toDF("b_name"), "a_name", "b_name", 2).select("a_name", "b_name", F.col("distance").cast("long").alias("distance"))


@query("j10_assign_once")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """Documents and benchmark items, paired one to one inside each language by the Jaccard similarity of all their words."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "").alias("words")
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id").select(F.col("doc_id").alias("documents_id"), "lang", words)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("benchmark_id"), words)
    return J.assign_similar(docs, items, "lang", "documents_id", "benchmark_id", "words", 0.05)


@query(
    "j11_token_overlap",
    f"""WITH a AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), an AS (SELECT doc_id, count(*) AS n FROM a GROUP BY ALL), b AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark), bn AS (SELECT item_id, count(*) AS m FROM b GROUP BY ALL)
SELECT doc_id AS documents_id, item_id AS benchmark_id, round(s / (n + m - s) + CASE WHEN s = least(n, m) THEN 0.1 ELSE 0 END, 6) AS score
FROM (SELECT doc_id, item_id, count(*) AS s FROM a JOIN b USING (w) GROUP BY ALL) JOIN an USING (doc_id) JOIN bn USING (item_id) WHERE s >= 3""",
)
def j11(spark: SparkSession, d: str) -> DataFrame:
    pairs = J.word_overlap(_words(spark, d, "documents", "doc_id"), _words(spark, d, "benchmark", "item_id"), "documents_id", "benchmark_id", "words", 3)
    bonus = F.when(F.col("shared") == F.least("left_n", "right_n"), 0.1).otherwise(0.0)
    return pairs.select("documents_id", "benchmark_id", F.round(F.col("shared") / (F.col("left_n") + F.col("right_n") - F.col("shared")) + bonus, 6).alias("score"))


@query("j11_claims_in_order")
def j11_claims(spark: SparkSession, d: str) -> DataFrame:
    """The overlap scores claimed in the order of the documents: each claims one item at most, each item goes once."""
    scored = j11(spark, d).where("score >= 0.05")
    return J.claim_in_order(scored, None, ["documents_id"], "documents_id", "benchmark_id", "score")


@query(
    "j12_significant_words",
    f"""WITH a AS (SELECT item_id, {_WORDS} AS w FROM benchmark), b AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT a.item_id, b.doc_id, len(list_intersect(a.w, b.w)) AS s, len(a.w) AS n, len(b.w) AS m FROM a, b WHERE list_has_any(a.w, b.w)),
q AS (SELECT *, s = n AND s = m AS equal FROM p WHERE (s = n AND s = m AND s >= 1) OR (s = least(n, m) AND s >= 2))
SELECT item_id AS benchmark_id, doc_id AS documents_id, s AS shared, equal FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY equal DESC, s DESC, doc_id) AS r FROM q) WHERE r = 1""",
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    pairs = J.word_overlap(_words(spark, d, "benchmark", "item_id"), _words(spark, d, "documents", "doc_id"), "benchmark_id", "documents_id", "words", 1, small="left")
    return J.best_word_match(pairs, "benchmark_id", "documents_id")


@query(
    "j13_surname_join",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS i, c_nationkey AS s FROM customer), s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'a' ELSE 'c' END AS i, s_nationkey AS s, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 2 END AS kind FROM supplier)
SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN c.i = s.i THEN 0 ELSE 1 END, kind, s_suppkey) AS r FROM c JOIN s USING (s)) WHERE r = 1""",
)
def j13(spark: SparkSession, d: str) -> DataFrame:
    name = lambda given, nation: F.concat(given, F.lit(" N"), F.col(nation).cast("string"))
    left = table(spark, d, "customer").select("c_custkey", name(F.when(F.col("c_custkey") % 2 == 0, "Ada").otherwise("Bo"), "c_nationkey").alias("name"))
    right = table(spark, d, "supplier").select("s_suppkey", name(F.when(F.col("s_suppkey") % 3 == 0, "A.").otherwise("Cy"), "s_nationkey").alias("name"), F.when(F.col("s_acctbal") > 5000, 1).otherwise(2).alias("kind"))
    return people.surname_join(left, right, "c_custkey", "s_suppkey", "name", "kind")


@query(
    "j14_person_match",
    """WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ['ada'] WHEN 1 THEN ['a', 'b'] WHEN 2 THEN ['bo'] ELSE [] END AS g, c_nationkey AS s FROM customer),
s AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ['a'] WHEN 1 THEN ['ada', 'bea'] ELSE ['bo', 'x'] END AS h, s_nationkey AS s FROM supplier)
SELECT c_custkey, s_suppkey FROM c JOIN s USING (s) WHERE len(list_filter(range(1, least(len(g), len(h)) + 1), lambda i: NOT (g[i] = h[i] OR (length(g[i]) = 1 AND starts_with(h[i], g[i])) OR (length(h[i]) = 1 AND starts_with(g[i], h[i]))))) = 0""",
)
def j14(spark: SparkSession, d: str) -> DataFrame:
    c, s = F.col("c_custkey") % 4, F.col("s_suppkey") % 3
    left = table(spark, d, "customer").select("c_custkey", F.concat(F.when(c == 0, "Adá ").when(c == 1, "A. B. ").when(c == 2, "Bo ").otherwise(""), F.lit("N"), F.col("c_nationkey").cast("string")).alias("name"))
    right = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("N"), F.col("s_nationkey").cast("string"), F.when(s == 0, ", A.").when(s == 1, ", Ada Bea").otherwise(", Bo X.")).alias("name"))
    return people.match_people(left, right, "c_custkey", "s_suppkey", "name")


#: A small rule table of our own over the invented words of the documents.
RULES = [(1, "thea", False, "theatre"), (2, "^.*zzz.*$", True, "sleep"), (3, "tion", False, "nation"), (4, "keit$", True, "state"), (5, "eau", False, "water"), (6, "th", False, "other")]
LATE_RULES = [(1, "er", False, "agent"), (2, "^[aeiou]", True, "vowel")]
_RULE_SCHEMA = "rule_id int, needle string, is_regex boolean, short string"


def rule_tables(spark: SparkSession) -> list[DataFrame]:
    return [spark.createDataFrame(r, _RULE_SCHEMA) for r in (RULES, LATE_RULES)]


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Lower-case words of the documents, one row each."""
    return table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("token")).where("token != ''")


_RULED = """CASE WHEN contains(token, 'thea') THEN 'theatre' WHEN contains(token, 'zzz') THEN 'sleep' WHEN contains(token, 'tion') THEN 'nation' WHEN regexp_matches(token, 'keit$') THEN 'state' WHEN contains(token, 'eau') THEN 'water' WHEN contains(token, 'th') THEN 'other' END"""
_LATE = "CASE WHEN contains(token, 'er') THEN 'agent' WHEN regexp_matches(token, '^[aeiou]') THEN 'vowel' END"


@query("j15_rule_join", f"WITH t AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '\\s+')) AS token FROM documents) SELECT token, coalesce({_RULED}, {_LATE}, token) AS short, CASE WHEN {_RULED} IS NOT NULL THEN 0 WHEN {_LATE} IS NOT NULL THEN 1 END AS tier FROM t WHERE token <> ''")
def j15(spark: SparkSession, d: str) -> DataFrame:
    return J.resolve_labels(tokens(spark, d), rule_tables(spark), "token", F.col("token"))


@query(
    "j16_nearest_slot",
    """SELECT event_id, (SELECT arg_min(o_orderkey, (abs(date_diff('second', DATE '2024-01-01', ts) - slot), slot, o_orderkey)) FROM (SELECT o_orderkey, o_custkey, (o_orderkey * 37) % 2592000 AS slot FROM orders) WHERE o_custkey = user_id) AS slot_id FROM events""",
)
def j16(spark: SparkSession, d: str) -> DataFrame:
    start = F.to_unix_timestamp(F.lit("2024-01-01 00:00:00"))
    left = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), (F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))) - start).alias("at"))
    slots = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), ((F.col("o_orderkey") * 37) % 2592000).alias("at"), "o_orderkey")
    slots = slots.groupBy("k", "at").agg(F.min("o_orderkey").alias("slot"))
    return J.nearest(left, slots, ["k"], "at", "slot").select("event_id", F.col("matched").alias("slot_id"))


@query(
    "j17_as_of",
    """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT event_id, CASE WHEN e.ts - v.ts <= INTERVAL 2 DAYS THEN view_id END AS view_id FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""",
)
def j17(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return J.as_of(buys, views, ["user_id"], "ts", "view_id", F.expr("INTERVAL 2 DAYS")).select("event_id", F.col("matched").alias("view_id"))


@query("j18_bands", "WITH h AS (SELECT user_id, ts, max(event_id) AS header FROM events WHERE event_type = 'signup' GROUP BY ALL) SELECT event_id, header FROM (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'signup') e ASOF JOIN h ON e.user_id = h.user_id AND e.ts >= h.ts")
def j18(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    headers = events.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("header"))
    rows = events.where("event_type != 'signup'").select("event_id", "user_id", "ts")
    return J.band_of(rows, headers, ["user_id"], "ts", "header").select("event_id", "header")


@query(
    "j19_contained",
    """WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS id, l_quantity AS lo, l_quantity + l_linenumber AS hi FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem))
SELECT a.l_orderkey, a.l_linenumber, a.lo, count(*) AS n_hosts FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.id <> b.id AND a.lo >= b.lo AND a.hi <= b.hi GROUP BY ALL""",
)
def j19(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()
    rows = rows.select("l_orderkey", "l_linenumber", F.xxhash64("l_partkey", "l_linenumber", "l_quantity").alias("id"), F.col("l_quantity").alias("lo"), (F.col("l_quantity") + F.col("l_linenumber")).alias("hi"))
    hosts = rows.select("l_orderkey", F.col("id").alias("h_id"), F.col("lo").alias("h_lo"), F.col("hi").alias("h_hi"))
    inside = rows.join(hosts, "l_orderkey").where("id != h_id and lo >= h_lo and hi <= h_hi")
    return inside.groupBy("l_orderkey", "l_linenumber", "lo").agg(F.count(F.lit(1)).alias("n_hosts"))


@query("j19_smallest_host", "SELECT o_orderkey AS part_id, arg_min(h, (w, h)) AS host_id FROM (SELECT a.o_orderkey, b.o_orderkey AS h, 40 + b.o_orderkey % 30 AS w FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate >= b.o_orderdate AND a.o_orderdate + INTERVAL 5 DAYS <= b.o_orderdate + to_days((40 + b.o_orderkey % 30)::INTEGER)) GROUP BY o_orderkey")
def j19_host(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1970-01-01"))
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("lo"))
    parts = orders.select("o_custkey", F.col("o_orderkey").alias("part_id"), "lo", (F.col("lo") + 5).alias("hi"))
    hosts = orders.select("o_custkey", F.col("o_orderkey").alias("host_id"), "lo", (F.col("lo") + 40 + F.col("o_orderkey") % 30).alias("hi"))
    return J.contained_in(parts, hosts, ["o_custkey"], "part_id", "host_id")


@query("j20_supplement", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j20(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    return J.supplement(lines.where("l_returnflag = 'R'").drop("l_returnflag"), lines.where("l_returnflag = 'A'").drop("l_returnflag"), "l_orderkey")


@query(
    "j21_append_missing",
    """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
SELECT event_id, user_id FROM a UNION ALL SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS r FROM b) x WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = x.user_id AND a.ts::DATE = x.ts::DATE)""",
)
def j21(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    pick = lambda kind: events.where(F.col("event_type") == kind).drop("event_type")
    return J.append_missing(pick("click"), pick("error"), {"k_user": F.col("user_id"), "k_day": F.to_date("ts")}, "event_id").select("event_id", "user_id")


@query("j22_fill_missing", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, s_name, n_name) AS label FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def j22(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, " ").alias("label"))
    first = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("label"))
    second = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"))
    return J.fill_missing(own, [(first, ["c_custkey"]), (second, ["c_nationkey"])], "label").select("c_custkey", "label")


@query("j23_keyed_enrichment", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN r_name END AS r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j23(spark: SparkSession, d: str) -> DataFrame:
    """Enrichment by a normalised heading; placeholders don't join."""
    nation = table(spark, d, "nation")
    heads = nation.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(T.alnum_key(F.upper("n_name")).alias("key"), "r_name")
    own = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    heading = F.when(F.col("s_suppkey") % 4 == 0, "TBD").otherwise(F.replace("n_name", F.lit("_"), F.lit(" - ")))
    keyed = own.select("s_suppkey", F.nullif(T.alnum_key(heading), F.lit("tbd")).alias("key"))
    return keyed.join(heads, "key", "left").select("s_suppkey", "r_name")


@query(
    "j24_shared_affiliation",
    """WITH a AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS s, list(l_partkey % 100 ORDER BY l_partkey % 100) AS p FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(CASE WHEN l_orderkey % 2 = 0 THEN list_filter(s, lambda x: list_contains(p, x))[1] END, s[1]) AS aff FROM a""",
)
def j24(spark: SparkSession, d: str) -> DataFrame:
    supp = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"])
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(supp.alias("s"), F.collect_list(F.col("l_partkey") % 100).alias("p"))
    return rows.select("l_orderkey", people.shared_affiliation(F.col("s"), F.col("p"), F.col("l_orderkey") % 2 == 1).alias("aff"))


@query(
    "j25_institution_short",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'mapped ' || r_name ELSE n_name || ' University' END AS short FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def j25(spark: SparkSession, d: str) -> DataFrame:
    """Map hit on any variant, the cleanest first, else the heuristic on the cleanest."""
    region = table(spark, d, "region")
    both = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    variants = F.array(F.concat("n_name", F.lit(" University, Town")), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("alt "), F.col("n_regionkey").cast("string"))).otherwise("none"))
    each = both.select("c_custkey", F.posexplode(variants).alias("pos", "raw"))
    mapping = region.select(F.concat(F.lit("alt "), F.col("r_regionkey").cast("string")).alias("raw"), F.concat(F.lit("mapped "), "r_name").alias("hit"))
    found = each.join(mapping.hint("merge"), "raw", "left").groupBy("c_custkey").agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("pos"))).alias("hit"), F.min_by("raw", "pos").alias("clean"))
    return found.select("c_custkey", T.heuristic_short(F.col("clean"), F.col("hit")).alias("short"))
