"""Queries of sources and sinks that write driver rows in a source's own format and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.plans.registry import query
from rostrum.session import shared_folder
from rostrum.sources import config, processors, program
from rostrum.sources.tables import table


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@processors.processor("orders")
def orders_program(spark: SparkSession, folder: str, dealt: bool = False) -> processors.Program:
    """A program for each customer: orders are sessions, their lines are talks. `dealt`: rows meet by program while they are narrow, which
    spares those who make documents of them a shuffle of the wide ones."""
    deal = lambda df: df.repartition("conference_name") if dealt else df
    orders = table(spark, folder, "orders").withColumn("conference_name", F.col("o_custkey").cast("string"))
    own = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.when(F.col("l_quantity") > 10, F.col("l_linestatus")).alias("title"))
    lines = deal(own.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "conference_name").hint("merge"), "l_orderkey"))
    orders = deal(orders.select("conference_name", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate"))
    key = lambda *c: F.concat_ws("-", *[F.col(x).cast("string") for x in c])
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    sessions = orders.select(
        "conference_name", F.col("o_orderkey").cast("int").alias("pos"), F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit('Order "'), "o_orderpriority", F.lit('" é\n')).alias("title"), F.lower("o_orderstatus").alias("color"), stamp("o_orderdate").alias("start_ts")
    )
    inst = lambda c: F.struct(F.col("l_suppkey").cast("int").alias("n"), F.col(c).cast("string").alias("name"))
    talks = lines.select(
        "conference_name", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("pos"), key("l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("session_id"),
        "title", F.array(inst("l_partkey")).alias("institutions"),
        F.array(F.struct(F.col("l_returnflag").alias("name"), F.array(F.col("l_suppkey").cast("int") + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)).alias("insts"))).alias("authors"),
        (F.col("l_returnflag") == "R").alias("withdrawn"),
    )
    return {"sessions": sessions, "talks": talks}


@query(
    "x2_program_documents",
    """SELECT l_orderkey || '-' || l_linenumber AS id, o_custkey::VARCHAR AS conference_name, 'Order "' || o_orderpriority || '" é' || chr(10) AS session_title, CASE WHEN l_quantity > 10 THEN l_linestatus END AS title,
  l_suppkey::INTEGER AS n, l_returnflag = 'R' AS withdrawn, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS start_ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def x2(spark: SparkSession, d: str) -> DataFrame:
    """Programs written as documents, read back relation by relation, and joined."""
    folder = _new(spark, "programs")
    processors.write_documents(processors.process(spark, "orders", folder=d, dealt=True), folder, packed=True)
    sessions = processors.read_documents(spark, folder, "sessions").select("conference_name", F.col("id").alias("session_id"), F.col("title").alias("session_title"), "start_ts")
    talks = processors.read_documents(spark, folder, "talks").select("id", "conference_name", "session_id", "title", F.col("institutions")[0]["n"].alias("n"), "withdrawn")
    both = talks.join(sessions.hint("merge"), ["conference_name", "session_id"])
    return both.select("id", "conference_name", "session_title", "title", "n", "withdrawn", "start_ts")


@query(
    "x2_program_problems",
    """SELECT o_custkey::VARCHAR AS conference_name, 'talks' AS relation, l_orderkey || '-' || l_linenumber AS id, 'author cites a missing institution' AS problem FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 7
UNION ALL SELECT * FROM (SELECT o_custkey::VARCHAR, 'talks', l_orderkey || '-' || l_linenumber AS id, 'id twice' FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(*) > 1)""",
)
def x2_problems(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the programs that break the contract."""
    return processors.problems(processors.process(spark, "orders", folder=d))


@query("s1_read_program", "SELECT o_custkey::VARCHAR AS conference_name, count(DISTINCT o_orderkey) AS n_sessions, count(l_orderkey) AS n_talks, count(*) FILTER (WHERE l_quantity > 10) AS n_titled FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def s1(spark: SparkSession, d: str) -> DataFrame:
    """Program documents as compressed files of JSON lines, a task a file, read as sessions and talks."""
    folder = _new(spark, "program-json")
    processors.documents(processors.process(spark, "orders", folder=d)).select("document").write.option("compression", "gzip").text(folder)
    read = program.read_program(spark, folder, multi_line=False)
    sessions = read["sessions"].groupBy("conference_name").agg(F.count(F.lit(1)).alias("n_sessions"))
    talks = read["talks"].groupBy("conference_name").agg(F.count(F.lit(1)).alias("n_talks"), F.count("title").alias("n_titled"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sessions.join(talks.hint("merge"), "conference_name", "left").select("conference_name", "n_sessions", zero("n_talks"), zero("n_titled"))


@query("s2_read_csv", "SELECT c_custkey, c_name || chr(10) || ' \"quoted\"' AS name, c_mktsegment AS segment FROM customer")
def s2(spark: SparkSession, d: str) -> DataFrame:
    """Customers as CSV with a byte order mark, padded fields, quotes and line ends in them."""
    folder = _new(spark, "csv")
    rows = table(spark, d, "customer").select(F.concat(F.lit("  "), F.col("c_custkey").cast("string")), F.concat("c_name", F.lit('\n "quoted"')), F.concat("c_mktsegment", F.lit("   ")))
    rows.toDF("﻿key", "name", "segment").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return program.read_csv(spark, folder).select(F.col("key").cast("long").alias("c_custkey"), "name", "segment")


@query("s4_missing_inputs", "SELECT 'nation=' || n_nationkey || '/*.json' AS pattern FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) AND n_regionkey <> 2")
def s4(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with a large balance written by nation; which required nations have no file."""
    folder = _new(spark, "inputs")
    table(spark, d, "supplier").where("s_acctbal > 8000").withColumn("nation", F.col("s_nationkey")).write.partitionBy("nation").json(folder)
    manifest = table(spark, d, "nation").select(F.concat(F.lit("nation="), F.col("n_nationkey").cast("string"), F.lit("/*.json")).alias("pattern"), (F.col("n_regionkey") != 2).alias("required"))
    return program.missing_inputs(manifest, program.files(spark, folder)).select("pattern")


@query("s7_write_program", """SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS priority, '{"status":"' || o_orderstatus || '"' || CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE ',"priority":"' || o_orderpriority || '"' END || '}' AS nested FROM orders""")
def s7(spark: SparkSession, d: str) -> DataFrame:
    """Orders written without the fields that nothing reads, and the lines read back."""
    folder = _new(spark, "compact")
    kept = F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.struct(F.col("o_orderstatus").alias("status"), kept.alias("priority"), F.col("o_orderdate").alias("at")).alias("x"))
    program.write_program(rows, folder, unused=["o_totalprice"], nested={"x": ["at"]})
    line = spark.read.text(folder)
    return line.select(F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"), F.get_json_object("value", "$.x.status").alias("status"), F.get_json_object("value", "$.x.priority").alias("priority"), F.get_json_object("value", "$.x").alias("nested"))


@query("x3_runtime_rules", "SELECT p_partkey, min(rule) AS rule FROM part JOIN (SELECT DISTINCT p_brand AS rule FROM part WHERE p_size > 45) ON contains(p_brand || ' ' || p_name, rule) GROUP BY p_partkey")
def x3(spark: SparkSession, d: str) -> DataFrame:
    """Patterns from a file that users edit, with comments and blank lines, applied to the parts."""
    folder = _new(spark, "rules")
    lines = table(spark, d, "part").where("p_size > 45").select("p_brand").distinct().select(F.explode(F.array(F.lit("# a brand"), F.lit("   "), F.concat("p_brand", F.lit("   # kept")))).alias("value"))
    lines.write.text(folder)
    rules = program.read_rules(spark, folder, comment=r"(^|\s)#.*$").select("pattern").distinct()
    return config.first_pattern(table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("text")), rules, "text").select("p_partkey", F.col("pattern").alias("rule"))


@query(
    "x4_program_settings",
    """SELECT c_custkey, CASE WHEN starts_with(upper(n_name), substr(upper(n_name), 1, 1)) AND c_nationkey % 3 = 0 THEN substr(n_name, 1, 3) || ' ' || c_custkey % 7 WHEN c_nationkey % 3 = 1 THEN 'R' || n_regionkey || ' ' || c_custkey % 7 ELSE 'Hall of ' || n_name || ', Room ' || c_custkey % 7 END AS place,
CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Type ' || c_mktsegment || ' ' || n_regionkey END AS label, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 4 END::INTEGER AS day
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def x4(spark: SparkSession, d: str) -> DataFrame:
    """Each nation is a program with venues, types and days of its own, kept as tables."""
    nation = table(spark, d, "nation")
    name, region = F.col("n_nationkey").cast("string").alias("program"), F.col("n_regionkey").cast("string")
    venues = nation.where("n_nationkey % 3 < 2").select(name, F.explode(F.array(F.struct(F.lit(2).alias("ord"), F.lit("hall of").alias("needle"), F.concat(F.lit("R"), region).alias("short")), F.when(F.col("n_nationkey") % 3 == 0, F.struct(F.lit(1).alias("ord"), F.lower("n_name").alias("needle"), F.substring("n_name", 1, 3).alias("short"))))).alias("v")).where("v is not null").select("program", "v.*")
    segments = table(spark, d, "customer").select("c_mktsegment").distinct()
    types = nation.select(name, "n_regionkey").join(F.broadcast(segments)).select("program", F.col("c_mktsegment").alias("id"), F.concat(F.lit("Type "), "c_mktsegment", F.lit(" "), F.col("n_regionkey").cast("string")).alias("label"))
    days = nation.select(name, F.explode(F.expr("sequence(timestamp'2026-05-01', timestamp'2026-05-03', interval 1 day)")).alias("d")).select("program", F.to_date("d").alias("day"))
    items = table(spark, d, "customer").join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey")).select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("program"), F.concat(F.lit("Hall of "), "n_name", F.lit(", Room "), (F.col("c_custkey") % 7).cast("string")).alias("location"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("type"), F.expr("timestamp'2026-04-30 10:00:00' + make_interval(0, 0, 0, cast(c_custkey % 4 as int))").alias("start"),
    )
    return config.with_settings(items, config.Settings(venues, types, days), "program").select("c_custkey", "place", "label", "day")
