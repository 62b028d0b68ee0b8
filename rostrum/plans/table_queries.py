"""Queries of the aggregations (A1-A18), windows (W1-W14), sorts (K1-K7) and set operations (U1-U5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import aggregates as A
from rostrum.operators import filters as P
from rostrum.operators import people, search, state
from rostrum.operators import windows as N
from rostrum.operators.ranks import numbered
from rostrum.plans.join_queries import tokens
from rostrum.plans.registry import query
from rostrum.sources.tables import table

_TOKENS = "(SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS token FROM documents)"


def _cased(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("token")).where("token != ''")


@query("a1_distinct_pool", "SELECT DISTINCT trim(unnest([source, lang, 'x' || source])) AS value FROM documents")
def a1(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit(" "), "source", F.lit("; "), "lang", F.lit(";;")).alias("both"), F.concat(F.lit("x"), "source").alias("other"))
    return A.pool(docs, "both", "other")


@query(
    "a2_learn_casing",
    f"""WITH c AS (SELECT upper(replace(token, 'ß', 'SS')) AS u, token AS form, count(*) AS n FROM {_TOKENS} WHERE token <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n DESC, encode(form)) AS k FROM c)
SELECT u AS upper, form FROM r WHERE k = 1 AND length(regexp_replace(form, '[^A-Z]', '', 'g')) >= 2""",
)
def a2(spark: SparkSession, d: str) -> DataFrame:
    return A.learn_casing(_cased(spark, d), "token")


@query("a3_counts_per_person", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a4_mode_unless_tied", "SELECT user_id, CASE WHEN len(v) = 1 THEN v[1] END AS event_type FROM (SELECT user_id, list(event_type) AS v FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r = 1 GROUP BY user_id)")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return people.mode_unless_tied(table(spark, d, "events"), ["user_id"], "event_type")


@query(
    "a5_backfill",
    """WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS aff FROM orders), c AS (SELECT o_custkey, aff, count(*) AS n FROM o WHERE aff IS NOT NULL GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY n DESC) AS r FROM c), v AS (SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(aff) END AS voted FROM r WHERE r = 1 GROUP BY ALL)
SELECT o_orderkey, coalesce(aff, voted) AS aff FROM o LEFT JOIN v USING (o_custkey)""",
)
def a5(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).otherwise("").alias("aff"))
    return people.backfill(orders, ["o_custkey"], "aff").select("o_orderkey", "aff")


@query(
    "a6_slot_backfill",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest([l_suppkey, l_suppkey + 1]) % 50 AS person, unnest([CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y') ELSE '' END, '']) AS aff, unnest([0, 1]) AS pos FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem)),
c AS (SELECT person, aff, count(*) AS n FROM s WHERE aff <> '' GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY person ORDER BY n DESC) AS r FROM c), v AS (SELECT person, CASE WHEN count(*) = 1 THEN min(aff) END AS voted FROM r WHERE r = 1 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; ') AS affs FROM (SELECT l_orderkey, l_linenumber, l_partkey, list(x ORDER BY pos, x) AS l FROM (SELECT *, coalesce(nullif(aff, ''), voted, '') AS x FROM s LEFT JOIN v USING (person)) GROUP BY ALL)""",
)
def a6(spark: SparkSession, d: str) -> DataFrame:
    """People listed together, aligned with their affiliations by position; empty ones take the person's usual one."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").distinct()
    people_ = F.concat(F.col("l_suppkey").cast("string"), F.lit(" and "), (F.col("l_suppkey") + 1).cast("string"))
    affs = F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy")).otherwise(""), F.lit(";"))
    each = lines.select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode(F.split(people_, "; | and ")).alias("pos", "person"), F.split(affs, ";").alias("a"))
    slots = each.select("l_orderkey", "l_linenumber", "l_partkey", "pos", (F.col("person").cast("long") % 50).alias("person"), F.coalesce(F.get("a", F.col("pos")), F.lit("")).alias("aff"))
    filled = people.backfill(slots, ["person"], "aff").withColumn("aff", F.coalesce("aff", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "aff")))
    return filled.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["aff"])), "; ").alias("affs"))


@query(
    "a7_consolidate",
    f"""WITH c AS (SELECT token, count(*) AS n, strip_accents(token) AS k, CASE WHEN token = 'éé' THEN 1 ELSE 0 END AS cur FROM {_TOKENS} WHERE token <> '' GROUP BY ALL)
SELECT token AS label, first_value(token) OVER (PARTITION BY k ORDER BY cur DESC, n DESC, token <> k DESC, length(token) DESC, encode(token) DESC) AS winner FROM c""",
)
def a7(spark: SparkSession, d: str) -> DataFrame:
    return A.consolidate(_cased(spark, d).select(F.col("token").alias("label")), "label", F.col("label") == "éé")


_TYPES = [("view", "Views", 1), ("click", "Clicks", 2), ("neutral", "Other", 3), ("unused", "Unused", 4)]


@query("a8_facets", "SELECT id, label, ord, n FROM (SELECT coalesce(nullif(event_type, 'signup'), 'neutral') AS id, count(*) AS n FROM events GROUP BY ALL) JOIN (VALUES ('view', 'Views', 1), ('click', 'Clicks', 2), ('neutral', 'Other', 3), ('unused', 'Unused', 4)) v(id, label, ord) USING (id)")
def a8(spark: SparkSession, d: str) -> DataFrame:
    types = spark.createDataFrame(_TYPES, "id string, label string, ord int")
    return A.facets(table(spark, d, "events").withColumn("t", F.nullif("event_type", F.lit("signup"))), "t", types)


@query(
    "a9_dedupe_institutions",
    "WITH f AS (SELECT l_orderkey, l_suppkey % 10 AS k, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL) SELECT l_orderkey, k AS inst, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, k) AS n FROM f",
)
def a9(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 10).alias("inst"), "l_linenumber")
    return N.renumber(rows, "l_orderkey", "inst", ["l_linenumber"]).withColumnRenamed("new_number", "n")


@query(
    "a10_merge_reprints",
    """WITH o AS (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus) AS s FROM orders)
SELECT s AS o_orderkey, l_linenumber, arg_min(l_partkey, (o_orderkey, l_partkey)) AS l_partkey FROM o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").withColumn("pos", F.col("o_orderkey"))
    children = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return A.merge_groups(parents, children, ["o_custkey", "o_orderpriority", "o_orderstatus"], "o_orderkey", "pos", "l_linenumber")[1]


@query(
    "a11_merge_tags",
    """WITH t AS (SELECT o_custkey, o_orderkey, unnest(['status', 'priority']) AS key, unnest([o_orderstatus, o_orderpriority]) AS value, unnest([0, 1]) AS place FROM orders), f AS (SELECT o_custkey, key, value, min((o_orderkey, place)) AS first FROM t GROUP BY ALL)
SELECT o_custkey, key, string_agg(value, ' / ' ORDER BY first) AS value FROM f GROUP BY ALL""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda k, c: F.struct(F.lit(k).alias("key"), F.col(c).alias("value"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.array(tag("status", "o_orderstatus"), tag("priority", "o_orderpriority")).alias("tags"))
    return A.merge_tags(rows, ["o_custkey"], "tags", "o_orderkey")


@query("a12_integer_median", "SELECT p_brand, floor(quantile_cont(length(p_name || p_type), 0.5))::BIGINT AS median FROM part GROUP BY ALL")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return A.integer_median(table(spark, d, "part"), ["p_brand"], F.length(F.concat("p_name", "p_type"))).select("p_brand", F.col("median").cast("long").alias("median"))


@query(
    "a13_quality_report",
    """WITH r AS (SELECT doc_id, unnest(list_filter([CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN n_chars < 200 THEN 'short' END], lambda x: x IS NOT NULL)) AS category FROM documents)
SELECT category, count(*) AS n, array_to_string(list(doc_id::VARCHAR ORDER BY doc_id)[1:3], ',') AS samples FROM r GROUP BY ALL""",
)
def a13(spark: SparkSession, d: str) -> DataFrame:
    checks = {"table": F.contains("text", F.lit("|")), "shouting": F.contains("text", F.lit("!!")), "short": F.col("n_chars") < 200}
    return A.quality_report(table(spark, d, "documents"), "doc_id", checks)


@query("a14_build_metrics", "SELECT count(*) AS n_tokens, count(*) FILTER (WHERE contains(token, 'th')) AS n_matched, count(DISTINCT token) AS n_distinct FROM (SELECT lower(token) AS token FROM " + _TOKENS + ") WHERE token <> ''")
def a14(spark: SparkSession, d: str) -> DataFrame:
    per = tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_tokens"), F.coalesce(F.sum(F.when(F.contains("token", F.lit("th")), F.col("n"))), F.lit(0)).alias("n_matched"), F.count(F.lit(1)).alias("n_distinct"))


@query("a15_program_days", "SELECT DISTINCT strftime(day, '%Y-%m-%d') AS day, (SELECT max(ts) FROM events) AS program_end FROM (SELECT ts AS day FROM events UNION SELECT o_orderdate FROM orders)")
def a15(spark: SparkSession, d: str) -> DataFrame:
    events, orders = table(spark, d, "events"), table(spark, d, "orders")
    days = events.select(F.date_format("ts", "yyyy-MM-dd").alias("day")).union(orders.select(F.date_format("o_orderdate", "yyyy-MM-dd"))).distinct()
    return days.select("day", events.agg(F.max("ts")).scalar().alias("program_end"))


@query("a16_first_last_below", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE event_type <> 'signup' GROUP BY ALL")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type != 'signup'").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "a17_referential_check",
    "SELECT l_orderkey, max(n) > 1 AS duplicate_number, l_orderkey % 10 = 0 AS dangling FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey",
)
def a17(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "orders").where("o_orderkey % 10 != 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return A.dangling(table(spark, d, "lineitem"), parents, "l_orderkey", "l_linenumber")


@query("a18_hits_per_suggestion", "SELECT short, count(DISTINCT doc_id) AS n FROM (SELECT lower(unnest([source, lang])) AS short, doc_id FROM documents) GROUP BY ALL")
def a18(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("both", F.concat_ws("; ", "source", "lang"))
    return search.hit_counts(search.affiliation_postings(docs, "doc_id", "both"), "short", "doc_id")


@query("w1_number_repeats", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_name) > 1 THEN p_name || ' ' || row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) ELSE p_name END AS p_name FROM part")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return N.number_repeats(table(spark, d, "part"), ["p_brand"], "p_name", ["p_partkey"]).select("p_partkey", "p_name")


@query(
    "w2_day_rollover",
    """WITH e AS (SELECT event_id, user_id, hour(ts) * 60 + minute(ts) AS m FROM events), b AS (SELECT *, m < lag(m) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS back FROM e)
SELECT event_id, least(sum(coalesce(back, false)::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id), 20)::INTEGER AS day FROM b""",
)
def w2(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("m", F.hour("ts") * 60 + F.minute("ts"))
    return N.day_rollover(events, ["user_id"], ["event_id"], "m", 20).select("event_id", F.col("day").cast("int").alias("day"))


@query(
    "w3_run_segmentation",
    """WITH e AS (SELECT event_id, user_id, ts, event_type = 'signup' AS dv, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS ph FROM events),
b AS (SELECT *, lag(dv) OVER w IS NULL OR dv OR lag(dv) OVER w OR ph <> lag(ph) OVER w AS br FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(br::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b)
SELECT user_id, run::BIGINT AS run, dv AS is_divider, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM r GROUP BY ALL""",
)
def w3(spark: SparkSession, d: str) -> DataFrame:
    half = F.when(F.hour("ts") < 12, "AM").otherwise("PM")
    rows = N.runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", half)
    return rows.groupBy("user_id", "run", "is_divider").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n"))


@query(
    "w4_gap_clusters",
    """WITH g AS (SELECT user_id, value, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) > 0.5 AS gap FROM events), c AS (SELECT *, sum(coalesce(gap, false)::INTEGER) OVER (PARTITION BY user_id ORDER BY value, event_id) AS cluster FROM g)
SELECT user_id, cluster::BIGINT AS cluster, count(*) AS n, list(value ORDER BY value)[count(*) // 2 + 1] AS position FROM c GROUP BY ALL""",
)
def w4(spark: SparkSession, d: str) -> DataFrame:
    rows = N.gap_clusters(table(spark, d, "events"), ["user_id"], "value", 0.5, ["event_id"])
    ranked = numbered(rows, ["user_id", "cluster"], ["value", "event_id"], total="n")
    return ranked.where(F.col("rank") == F.floor(F.col("n") / 2) + 1).select("user_id", "cluster", "n", F.col("value").alias("position"))


@query(
    "w5_anchored_clusters",
    """WITH RECURSIVE v AS (SELECT l_suppkey, l_quantity AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS k FROM (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem)),
c AS (SELECT l_suppkey, q, k, q AS anchor, 0 AS cluster FROM v WHERE k = 1 UNION ALL SELECT v.l_suppkey, v.q, v.k, CASE WHEN v.q - anchor > 4 THEN v.q ELSE anchor END, CASE WHEN v.q - anchor > 4 THEN cluster + 1 ELSE cluster END FROM c JOIN v ON v.l_suppkey = c.l_suppkey AND v.k = c.k + 1)
SELECT l_suppkey, q AS l_quantity, cluster FROM c""",
)
def w5(spark: SparkSession, d: str) -> DataFrame:
    return N.anchored_clusters(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", 4.0)


@query(
    "w6_overlaps",
    "SELECT o_orderkey, coalesce(o_orderdate < max(o_orderdate + INTERVAL 30 DAYS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) OR count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AS overlaps FROM orders",
)
def w6(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("end_at", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return N.overlaps(orders, ["o_custkey"], "o_orderdate", "end_at", ["o_orderkey"]).select("o_orderkey", "overlaps")


@query("w7_renumber", "SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_suppkey) AS new_number FROM lineitem GROUP BY l_orderkey, l_suppkey")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return N.renumber(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", ["l_linenumber"])


@query("w8_slots", "SELECT event_id, 540 + k * 15 AS slot_start, least(540 + k * 15 + 15, 1000) AS slot_end FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events) WHERE 540 + k * 15 < 1000")
def w8(spark: SparkSession, d: str) -> DataFrame:
    return N.slots(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.lit(540), F.lit(1000), 15).select("event_id", "slot_start", "slot_end")


@query("w9_chunks", "SELECT p_partkey, floor((row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) / ceil(count(*) OVER (PARTITION BY p_type) / 7))::INTEGER AS chunk FROM part")
def w9(spark: SparkSession, d: str) -> DataFrame:
    return N.chunked(table(spark, d, "part"), ["p_type"], ["p_partkey"], 7).select("p_partkey", "chunk")


@query("w10_unique_codes", "SELECT p_partkey, s || CASE WHEN k = 1 THEN '' ELSE k::VARCHAR END AS code FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS k FROM (SELECT p_partkey, upper(array_to_string(list_transform(string_split(p_name || ' ' || p_brand, ' '), lambda w: w[1:1]), '')) AS s FROM part))")
def w10(spark: SparkSession, d: str) -> DataFrame:
    slug = F.upper(F.array_join(F.transform(F.split(F.concat_ws(" ", "p_name", "p_brand"), " "), lambda w: F.substring(w, 1, 1)), ""))
    return N.unique_codes(table(spark, d, "part"), slug, ["p_partkey"]).select("p_partkey", "code")


@query(
    "w11_stitch_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM l),
r AS (SELECT *, sum((p IS NULL OR trim(p) = '' OR regexp_matches(p, '\\.\\s*$'))::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS record FROM b)
SELECT doc_id, record::BIGINT AS record, string_agg(trim(line), ' ' ORDER BY pos) AS text FROM r WHERE trim(line) <> '' GROUP BY ALL""",
)
def w11(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return N.stitched(lines, "doc_id", "pos", "line")


@query("w12_next_boundary", "SELECT min(b) AS boundary FROM (SELECT unnest([o_orderdate, o_orderdate + INTERVAL 5 DAYS]) AS b FROM orders) WHERE b > TIMESTAMP '1998-06-01 12:00:00'")
def w12(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("end_at", F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS"))
    return N.next_boundary(orders, ["o_orderdate", "end_at"], F.lit("1998-06-01 12:00:00").cast("timestamp_ntz"))


@query(
    "w13_inferred_end",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END, (SELECT min(n.o_orderdate) FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderdate > o.o_orderdate), CASE WHEN o_custkey % 2 = 0 THEN TIMESTAMP '2002-01-01' END, o_orderdate + INTERVAL 15 MINUTES) AS end_at FROM orders o""",
)
def w13(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("end_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))).withColumn("s", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    closing = F.when(F.col("o_custkey") % 2 == 0, F.lit("2002-01-01").cast("timestamp_ntz"))
    return N.inferred_end(orders, ["o_custkey"], "o_orderdate", "end_at", "s", closing, F.expr("INTERVAL 15 MINUTES")).select("o_orderkey", "end_at")


@query(
    "w14_parent_span",
    "SELECT o_orderkey, min(l_shipdate) AS span_start, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 200 DAYS END, max(l_shipdate), min(l_shipdate) + INTERVAL 30 MINUTES) AS span_end FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderdate",
)
def w14(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 200 DAYS")).alias("closing"))
    children = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return N.parent_span(parents, children, "o_orderkey", "l_shipdate", "l_shipdate", "closing", F.expr("INTERVAL 30 MINUTES")).select("o_orderkey", "span_start", "span_end")


def _ranked(df: DataFrame, day: str, *order) -> DataFrame:
    """The place of each row inside its day, which makes an order checkable."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(day).orderBy(*order)))


_TIMED = "(SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN ts END AS start FROM events)"


@query("k1_missing_last", f"SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY start NULLS LAST, event_id) AS rank FROM {_TIMED}")
def k1(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("start", F.when(F.col("event_type") != "error", F.col("ts")))
    return _ranked(events, "user_id", F.col("start").asc_nulls_last(), "event_id").select("event_id", "rank")


@query("k2_missing_first", f"SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY start NULLS FIRST, event_id) AS rank FROM {_TIMED}")
def k2(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("start", F.when(F.col("event_type") != "error", F.col("ts")))
    return _ranked(events, "user_id", F.col("start").asc_nulls_first(), "event_id").select("event_id", "rank")


@query("k3_natural_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY split_part(p_brand, '#', 2)::INTEGER, p_partkey) AS rank FROM part")
def k3(spark: SparkSession, d: str) -> DataFrame:
    return numbered(table(spark, d, "part"), ["p_type"], [search.natural_key(F.col("p_brand")), "p_partkey"]).select("p_partkey", "rank")


@query("k4_numbered_series", "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY split_part(p_name, ' ', 1), p_size, p_partkey) AS rank FROM part")
def k4(spark: SparkSession, d: str) -> DataFrame:
    """Same-time series by their leading word, then by number; a total order."""
    title = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_size").cast("string"))
    word, number = F.regexp_extract(title, "^([A-Za-z]+)", 1), F.regexp_extract(title, "([0-9]+)$", 1).cast("int")
    return numbered(table(spark, d, "part"), ["p_type"], [word, number, "p_partkey"]).select("p_partkey", "rank")


@query(
    "k5_bucket_order",
    """WITH i AS (SELECT o_orderkey AS id, -1 AS child, o_custkey AS c, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS g, o_orderkey AS p FROM orders UNION ALL SELECT l_orderkey, l_linenumber, o_custkey, CASE WHEN l_orderkey % 5 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END, o_orderkey FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)
SELECT id, child, row_number() OVER (PARTITION BY c ORDER BY g, p, child) AS rank FROM i""",
)
def k5(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    linked = F.when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    heads = orders.select(F.col("o_orderkey").alias("id"), F.lit(-1).alias("child"), "o_custkey", linked.alias("g"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("child")).distinct()
    children = lines.join(orders, "o_orderkey").select(F.col("o_orderkey").alias("id"), "child", "o_custkey", F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(linked).alias("g"))
    return _ranked(heads.unionByName(children), "o_custkey", "g", "id", "child").select("id", "child", "rank")


@query("k6_now_first", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderdate <= TIMESTAMP '1998-06-01' AND TIMESTAMP '1998-06-01' < o_orderdate + INTERVAL 7 DAYS THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS rank FROM orders")
def k6(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("1998-06-01").cast("timestamp_ntz")
    orders = table(spark, d, "orders")
    live = F.when(P.in_progress(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS"), now), 0).otherwise(1)
    return numbered(orders, ["o_orderpriority"], [live, "o_orderdate", "o_orderkey"]).select("o_orderkey", "rank")


@query(
    "k7_top_suggestions",
    """WITH n AS (SELECT w AS value, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) WHERE length(w) >= 3 GROUP BY ALL), q AS (SELECT DISTINCT value[1:3] AS query FROM n)
SELECT query, rank, value, n FROM (SELECT query, value, n, row_number() OVER (PARTITION BY query ORDER BY n DESC, encode(value)) AS rank FROM q JOIN n ON value[1:3] = query) WHERE rank <= 3""",
)
def k7(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("value")).where(F.length("value") >= 3)
    counts = search.hit_counts(words, "value", "doc_id")
    queries = counts.select(F.substring("value", 1, 3).alias("query")).distinct()
    return search.suggest(queries, search.prefix_index(counts, "value"), "query", "value", counts)


@query("u1_items", "SELECT 'session' AS kind, o_orderkey AS id, o_orderdate AS start, NULL AS event_type FROM orders UNION ALL SELECT 'talk', event_id, ts, event_type FROM events")
def u1(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "orders").select(F.lit("session").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start"))
    talks = table(spark, d, "events").select(F.lit("talk").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("start"), "event_type")
    return sessions.unionByName(talks, allowMissingColumns=True)


@query("u2_union_distinct", "SELECT c_mktsegment AS value FROM customer UNION SELECT p_type FROM part UNION SELECT r_name FROM region")
def u2(spark: SparkSession, d: str) -> DataFrame:
    pool = lambda name, c: table(spark, d, name).select(F.col(c).alias("value"))
    return pool("customer", "c_mktsegment").union(pool("part", "p_type")).union(pool("region", "r_name")).distinct()


@query("u3_selected_union", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 100 = 1 UNION SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def u3(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    chosen = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    both = lines.where("l_partkey % 100 = 1").union(lines.join(chosen, "l_orderkey", "left_semi"))
    return both.select("l_orderkey", "l_linenumber").dropDuplicates(["l_orderkey", "l_linenumber"])


@query("u4_snapshot_diff", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT doc_id, text FROM documents WHERE lang <> 'en') a FULL JOIN (SELECT doc_id, CASE WHEN source = 'src1' THEN upper(text) ELSE text END AS text FROM documents WHERE lang <> 'fr') b ON a.doc_id = b.doc_id WHERE a.text IS DISTINCT FROM b.text")
def u4(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    new = docs.where("lang != 'fr'").withColumn("text", F.when(F.col("source") == "src1", F.upper("text")).otherwise(F.col("text")))
    digest = lambda df: df.select("doc_id", F.sha2("text", 256).alias("h"))
    return state.snapshot_diff(digest(docs.where("lang != 'en'")), digest(new), "doc_id", "h")


@query("u5_replaced_values", "SELECT 'use' AS kind, c_mktsegment AS value, count(*) AS n FROM (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'TOOLS' WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS c_mktsegment FROM customer) GROUP BY ALL UNION ALL SELECT 'gone', unnest(['MACHINERY', 'BUILDING', 'NEVER']), 0")
def u5(spark: SparkSession, d: str) -> DataFrame:
    fixes = spark.createDataFrame([("MACHINERY", "TOOLS"), ("BUILDING", "HOUSING"), ("NEVER", "EVER")], "old string, new string")
    uses, gone = state.replaced_everywhere(table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")), fixes, "value")
    counted = uses.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit("use").alias("kind"), "value", "n")
    return counted.unionByName(gone.select(F.lit("gone").alias("kind"), "value", F.lit(0).cast("long").alias("n")))


@query("f5_recase_titles")
def f5(spark: SparkSession, d: str) -> DataFrame:
    """Shouted lines in title case, with learned acronyms kept; `line` counts from 0."""
    known = A.learn_casing(_cased(spark, d), "token").withColumnRenamed("form", "known")
    titles = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "title"))
    words = titles.where(T.is_shouting(F.col("title"))).select("doc_id", "line", F.posexplode(F.split("title", " ")).alias("pos", "word"))
    cased = words.join(known.hint("merge"), F.upper("word") == F.col("upper"), "left").select("doc_id", "line", "pos", T.recased(F.col("word"), F.col("known")).alias("word"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "word")))
    return cased.groupBy("doc_id", "line").agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("title"))
