"""Queries of the predicates and projections (P1-P21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import filters as P
from rostrum.operators import people
from rostrum.plans.registry import query
from rostrum.sources.tables import table

NOW = "1998-06-01 00:00:00"
_SQL_NOW = f"TIMESTAMP '{NOW}'"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items: an end a week after the start for all but pending ones."""
    end = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS"))
    return table(spark, d, "orders").withColumn("end_at", end).withColumn("withdrawn", F.col("o_orderpriority") == "5-LOW")


_ORDERS = "(SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 7 DAYS END AS end_at, o_orderpriority = '5-LOW' AS withdrawn FROM orders)"


@query("p1_is_past", f"SELECT o_orderkey FROM {_ORDERS} WHERE coalesce(end_at < {_SQL_NOW}, false)")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).where(P.is_past(F.col("end_at"), _now())).select("o_orderkey")


@query("p2_in_progress", f"SELECT o_orderkey FROM {_ORDERS} WHERE o_orderdate <= {_SQL_NOW} AND {_SQL_NOW} < end_at")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).where(P.in_progress(F.col("o_orderdate"), F.col("end_at"), _now())).select("o_orderkey")


@query("p3_hide_concluded", f"SELECT o_orderkey FROM {_ORDERS} WHERE NOT (coalesce(end_at < {_SQL_NOW}, false) OR withdrawn)")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).where(P.not_concluded(F.col("end_at"), F.col("withdrawn"), _now())).select("o_orderkey")


@query("p4_hide_types", "SELECT event_id FROM events WHERE coalesce(nullif(event_type, 'signup'), 'neutral') NOT IN ('error', 'neutral')")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(P.type_shown(F.nullif(F.col("event_type"), F.lit("signup")), ("error", "neutral"))).select("event_id")


@query("p5_day_filter", "SELECT event_id FROM events WHERE event_type = 'error' OR ts::DATE IN (DATE '2024-01-02', DATE '2024-01-09')")
def p5(spark: SparkSession, d: str) -> DataFrame:
    start = F.when(F.col("event_type") != "error", F.col("ts"))
    return table(spark, d, "events").where(P.on_days(start, ("2024-01-02", "2024-01-09"))).select("event_id")


@query("p6_display_title", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN '(WITHDRAWN) ' || o_orderpriority WHEN o_orderkey % 2 = 1 THEN o_orderpriority || ' withdrawn' ELSE o_orderpriority END AS title FROM orders")
def p6(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("o_orderkey") % 2 == 1, F.concat("o_orderpriority", F.lit(" withdrawn"))).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", P.display_title(title, F.col("o_orderstatus") == "F").alias("title"))


@query("p7_effective_location", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN o_orderpriority WHEN l_linenumber % 3 = 1 THEN '' ELSE l_linestatus END AS place FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def p7(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("l_linenumber") % 3 == 1, "").when(F.col("l_linenumber") % 3 == 2, F.col("l_linestatus"))
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return both.select("l_orderkey", "l_linenumber", P.inherited(own, F.col("o_orderpriority")).alias("place"))


@query("p8_type_label", "SELECT s_suppkey, CASE WHEN n_name <> r_name THEN n_name || ' / ' || r_name ELSE n_name END AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def p8(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    both = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return both.select("s_suppkey", F.when(F.col("n_name") != F.col("r_name"), F.concat_ws(" / ", "n_name", "r_name")).otherwise(F.col("n_name")).alias("label"))


@query("p9_usable_affiliation", "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ';'), lambda p: length(regexp_replace(p, '[^A-Za-z]', '', 'g')) >= 2)) > 0")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(P.usable_affiliation(F.col("text"))).select("doc_id")


@query(
    "p10_meaningful_source",
    r"""WITH t AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' Ltd. ' || n_name WHEN 1 THEN 'GmbH, ' || n_name ELSE regexp_replace(c_name, '#.*', '') || ', ' || n_name || ' Co.' END AS raw FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, length(regexp_replace(regexp_replace(regexp_replace(lower(raw), '\b(inc|ltd|llc|gmbh|corp|co)\b\.?', '', 'g'), 'nation_[0-9]+', '', 'g'), '[^a-z]', '', 'g')) >= 2 AS meaningful FROM t""",
)
def p10(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 3
    named = F.concat(F.regexp_replace("c_name", "#.*", ""), F.lit(", "), "n_name", F.lit(" Co."))
    raw = F.when(k == 0, F.concat("c_mktsegment", F.lit(" Ltd. "), "n_name")).when(k == 1, F.concat(F.lit("GmbH, "), "n_name")).otherwise(named)
    return both.select("c_custkey", P.meaningful_source(raw, ("nation_[0-9]+",)).alias("meaningful"))


@query("p11_time_labels", "SELECT event_id, strftime(ts, '%H:%M') || ' – ' || strftime(ts + INTERVAL 45 MINUTES, '%H:%M') AS span, strftime(ts, '%Y-%m-%d') AS day FROM events")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", P.time_range(F.col("ts"), F.col("ts") + F.expr("INTERVAL 45 MINUTES")).alias("span"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


def _authored(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines as an ordered author list."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name")))).alias("a"))
    authors = F.transform("a", lambda x: x["name"])
    return lines.select("l_orderkey", authors.alias("authors")).withColumn("speaker", F.element_at("authors", F.greatest(F.lit(1), F.size("authors") - 1)))


@query(
    "p12_byline",
    """WITH a AS (SELECT l_orderkey, list('P' || l_partkey ORDER BY l_linenumber, 'P' || l_partkey) AS n FROM lineitem GROUP BY l_orderkey), s AS (SELECT *, n[greatest(1, len(n) - 1)] AS sp FROM a)
SELECT l_orderkey, CASE WHEN len(n) <= 1 THEN n[1] WHEN sp <> n[1] AND sp <> n[-1] THEN n[1] || ' … [' || sp || '] … ' || n[-1] ELSE n[1] || ' … ' || n[-1] END || ' — Works' AS byline FROM s""",
)
def p12(spark: SparkSession, d: str) -> DataFrame:
    return _authored(spark, d).select("l_orderkey", people.byline(F.col("authors"), F.col("speaker"), F.lit("Works")).alias("byline"))


@query(
    "p13_explain_hit",
    """WITH a AS (SELECT l_orderkey, list('P' || l_partkey ORDER BY l_linenumber, 'P' || l_partkey) AS n FROM lineitem GROUP BY l_orderkey), s AS (SELECT *, n[greatest(1, len(n) - 1)] AS sp FROM a)
SELECT l_orderkey, array_to_string(list_filter(range(0, len(n)), lambda i: i = 0 OR i = len(n) - 1 OR n[i + 1] = sp OR contains(n[i + 1], '77')), ',') AS shown FROM s""",
)
def p13(spark: SparkSession, d: str) -> DataFrame:
    shown = people.shown_authors(F.col("authors"), F.col("speaker"), F.lit("77"))
    return _authored(spark, d).select("l_orderkey", F.array_join(F.transform(shown, lambda x: x.cast("string")), ",").alias("shown"))


@query(
    "p14_tags",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'type=' || p_type || ';Brand=' || p_brand WHEN p_size % 3 = 1 THEN 'type=' || p_type ELSE 'topic=' || p_brand END AS tags FROM part""",
)
def p14(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 3
    kind = F.when(k < 2, F.col("p_type"))
    topic = F.when(k == 0, F.concat(F.lit("Brand: "), "p_brand")).when(k == 1, F.col("p_type")).otherwise(F.col("p_brand"))
    made = F.array_join(F.transform(P.tags(kind, topic), lambda t: F.concat_ws("=", t["key"], t["value"])), ";")
    return table(spark, d, "part").select("p_partkey", made.alias("tags"))


@query(
    "p15_keep_sentences",
    "SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '[.] +', '.' || chr(1), 'g'), chr(1)), lambda s: NOT regexp_matches(s, '[0-9]')), ' ') AS kept FROM documents",
)
def p15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.without_sentences(F.col("text"), "[0-9]").alias("kept"))


@query(
    "p16_flatten_program",
    """SELECT o_orderkey, o_orderdate, NULL::INTEGER AS l_linenumber, NULL::BIGINT AS l_partkey, 'header' AS row_type FROM orders
UNION ALL SELECT o_orderkey, o_orderdate, l_linenumber, l_partkey, 'child' FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def p16(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    children = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return P.flattened(parents, children, "o_orderkey")


@query("p17_split_rows", "SELECT event_type, user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL")
def p17(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where(F.col("event_type").isin("click", "view")).withColumn("pos", F.col("event_id"))
    return P.last_per_key(rows.select("event_type", "user_id", "event_id", "value", "pos"), ["event_type", "user_id"], "pos").drop("pos")


@query(
    "p18_my_items",
    f"SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM {_ORDERS} JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') ON user_id = o_custkey WHERE NOT coalesce(end_at < {_SQL_NOW}, false)",
)
def p18(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    chosen = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("o_custkey"))
    mine = _orders(spark, d).join(chosen, "o_custkey", "left_semi").where(~P.is_past(F.col("end_at"), _now()))
    return mine.select("o_orderkey", "o_orderdate", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("rank"))


@query(
    "p19_speaker_cascade",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus WHEN o_orderkey % 4 = 1 THEN o_orderpriority ELSE 'first' END AS speaker FROM orders",
)
def p19(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    sources = {"scraped": F.when(k == 0, F.col("o_orderstatus")).otherwise(" "), "presenter": F.when(k == 1, F.col("o_orderpriority")), "first": F.lit("first")}
    return table(spark, d, "orders").select("o_orderkey", people.speaker(sources).alias("speaker"))


@query("p20_drop_empty_parents", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey WHERE n > 0 OR o_orderstatus = 'F' OR o_orderpriority = '5-LOW'")
def p20(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, d, "orders").join(n, "o_orderkey", "left")
    start = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return P.drop_empty_parents(orders, F.coalesce("n", F.lit(0)), start, F.when(F.col("o_orderpriority") == "5-LOW", "Event")).select("o_orderkey")


@query("p21_curated_overrides", "SELECT c_custkey, coalesce('curated ' || n_name, c_mktsegment) AS aff FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 0) ON n_nationkey = c_nationkey")
def p21(spark: SparkSession, d: str) -> DataFrame:
    curated = table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("curated "), "n_name").alias("own"))
    return table(spark, d, "customer").join(curated, "c_nationkey", "left").select("c_custkey", F.coalesce("own", "c_mktsegment").alias("aff"))
