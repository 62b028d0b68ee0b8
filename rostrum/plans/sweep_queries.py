"""Queries of the sweeps' finer rules: slots, event times, hosts of lines, ends by the next start of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators import sweeps
from rostrum.operators import windows as N
from rostrum.plans.registry import query
from rostrum.sources.tables import table

# rows: lines at a place of their supplier's page; slots: every fifth line's place
_PLACED = "SELECT DISTINCT l_suppkey AS page, (l_partkey * 7 + l_linenumber * 3) % 997 AS y, l_orderkey * 10 + l_linenumber AS id, l_returnflag = 'R' AS invited, l_orderkey % 5 = 0 AS slot, l_linestatus = 'F' AS dash, l_linenumber FROM lineitem"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    y = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 3) % 997
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("page"), y.alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") == "R").alias("invited"), (F.col("l_orderkey") % 5 == 0).alias("slot"), (F.col("l_linestatus") == "F").alias("dash"), "l_linenumber",
    ).distinct()


@query(
    "j16_slot_windows",
    f"""WITH x AS ({_PLACED}), r AS (SELECT page, y, id, bool_or(invited) AS invited FROM x WHERE NOT slot GROUP BY ALL),
s AS (SELECT page, y, y * 10 AS s, y * 10 + 9 AS e, lag(y) OVER w AS pat, lag(y * 10) OVER w AS ps, lead(y) OVER w AS nat, lead(y * 10 + 9) OVER w AS ne FROM (SELECT DISTINCT page, y FROM x WHERE slot) WINDOW w AS (PARTITION BY page ORDER BY y)),
m AS (SELECT r.page, r.y, r.id, r.invited, s.y AS sat, s, e, pat, ps, nat, ne, abs(r.y - s.y) AS dist, row_number() OVER (PARTITION BY r.id, r.page, r.y ORDER BY abs(r.y - s.y), s.y) AS k FROM r LEFT JOIN s ON s.page = r.page)
SELECT page, y, id,
  CASE WHEN invited THEN CASE WHEN nat IS NOT NULL AND y >= sat - 1 THEN s WHEN pat IS NOT NULL THEN ps ELSE s END WHEN pat IS NOT NULL AND abs(dist - abs(y - pat)) < 2 AND dist > 3 THEN ps ELSE s END AS slot_start,
  CASE WHEN invited THEN CASE WHEN nat IS NOT NULL AND y >= sat - 1 THEN ne ELSE e END WHEN pat IS NOT NULL AND abs(dist - abs(y - pat)) < 2 AND dist > 3 THEN e WHEN nat IS NOT NULL AND abs(dist - abs(y - nat)) < 2 AND dist > 3 THEN ne ELSE e END AS slot_end
FROM m WHERE k = 1""",
)
def j16_windows(spark: SparkSession, d: str) -> DataFrame:
    """Rows over one or two slots of their page."""
    placed = _placed(spark, d)
    rows = placed.where("not slot").groupBy("page", "y", "id").agg(F.bool_or("invited").alias("invited"))
    slots = placed.where("slot").select("page", "y").distinct().withColumns({"from": F.col("y") * 10, "to": F.col("y") * 10 + 9})
    return sweeps.slot_windows(rows, slots, ["page"], "y", "from", "to", "invited").drop("invited")


@query(
    "j17_event_times",
    f"""WITH x AS ({_PLACED}), r AS (SELECT DISTINCT page, y, id FROM x WHERE NOT slot), p AS (SELECT page, y, min(y * 2) AS t, bool_or(dash) AS d FROM x WHERE slot GROUP BY ALL HAVING min(l_linenumber) < 7),
q AS (SELECT *, lead(y) OVER w AS nat, lead(t) OVER w AS nt FROM p WINDOW w AS (PARTITION BY page ORDER BY y)),
m AS (SELECT r.page, r.y, r.id, t, CASE WHEN d AND nat <= q.y + 45 THEN nt END AS e, row_number() OVER (PARTITION BY r.id, r.page, r.y ORDER BY CASE WHEN q.y >= r.y - 45 AND q.y <= r.y + 8 THEN CASE WHEN d THEN 0 ELSE 1 END ELSE 2 END, abs(q.y - r.y), q.y) AS k FROM r LEFT JOIN q ON q.page = r.page)
SELECT page, y, id, t AS start_time, e AS end_time FROM m WHERE k = 1""",
)
def j17_times(spark: SparkSession, d: str) -> DataFrame:
    """Start and end of each row from the time points of its page, dashed ones first."""
    placed = _placed(spark, d)
    points = placed.where("slot").groupBy("page", "y").agg(F.bool_or("dash").alias("dash"), F.min("l_linenumber").alias("n")).withColumn("time", F.when(F.col("n") < 7, F.col("y") * 2))
    return sweeps.event_times(placed.where("not slot").select("page", "y", "id").distinct(), points, ["page"], "y", "time", "dash")


@query(
    "j19_line_hosts",
    f"""WITH x AS (SELECT page, id, y AS top, id % 90 AS x0, id % 90 + l_linenumber * 4 AS x1, l_linenumber AS n FROM ({_PLACED}))
SELECT id, arg_min(host, (away, host)) AS host_id FROM (SELECT a.id, b.id AS host, abs(a.top - b.top) AS away FROM x a JOIN x b ON a.page = b.page AND a.id <> b.id AND abs(a.top - b.top) > 2 AND abs(a.top - b.top) < 9 AND a.x0 >= b.x0 - 1 AND a.x1 <= b.x1 + 1 AND b.n > a.n) GROUP BY id""",
)
def j19_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Small rows that belong to a longer row near them on the page."""
    x = _placed(spark, d).withColumns({"x0": F.col("id") % 90, "x1": F.col("id") % 90 + F.col("l_linenumber") * 4})
    return sweeps.line_hosts(x, ["page"], "id", "y", "x0", "x1", "l_linenumber")


@query(
    "w13_next_start_of_day",
    """WITH o AS (SELECT o_orderkey, o_custkey, o_custkey % 10 AS program, o_orderdate + to_minutes((o_orderkey % 600)::INTEGER) AS at, o_custkey % 4 = 0 AS closes FROM orders)
SELECT o_orderkey, coalesce((SELECT min(n.at) FROM o n WHERE n.o_custkey = o.o_custkey AND n.at > o.at AND n.at < o.at + INTERVAL 2 HOURS), CASE WHEN closes THEN date_trunc('day', o.at) + INTERVAL 11 HOURS END,
  (SELECT min(n.at) FROM o n WHERE n.program = o.program AND date_trunc('day', n.at) = date_trunc('day', o.at) AND n.at > o.at), o.at + INTERVAL 15 MINUTES) AS end_at FROM o""".replace(" AND n.at < o.at + INTERVAL 2 HOURS", ""),
)
def w13_day(spark: SparkSession, d: str) -> DataFrame:
    """Ends of orders: the customer's next order, a closing time, the next order of the program that day, a quarter of an hour."""
    minutes = F.make_dt_interval(mins=(F.col("o_orderkey") % 600).cast("int"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 10).alias("program"), (F.col("o_orderdate") + minutes).alias("at"))
    orders = orders.withColumns({"day": F.to_date("at"), "s": F.unix_seconds(F.col("at").cast("timestamp")), "end_at": F.lit(None).cast("timestamp_ntz")})
    closing = F.when(F.col("o_custkey") % 4 == 0, F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 11 HOURS"))
    starts = orders.select("program", "day", "at").distinct()
    return N.inferred_end(orders, ["o_custkey"], "at", "end_at", "s", closing, F.expr("INTERVAL 15 MINUTES"), starts, ["program", "day"]).select("o_orderkey", "end_at")


@query(
    "w14_span_to_next_start",
    """WITH o AS (SELECT o_orderkey, o_custkey % 10 AS program, o_orderstatus, o_orderdate + to_minutes((o_orderkey % 600)::INTEGER) AS own FROM orders),
c AS (SELECT l_orderkey, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem WHERE l_linenumber < 3 AND l_quantity < 20 GROUP BY ALL),
p AS (SELECT o_orderkey, program, CASE WHEN o_orderstatus = 'P' THEN own + INTERVAL 1 DAY END AS closing, coalesce(first, own) AS span_start, last FROM o LEFT JOIN c ON l_orderkey = o_orderkey)
SELECT o_orderkey, span_start, coalesce(closing, last, (SELECT min(n.span_start) FROM p n WHERE n.program = p.program AND date_trunc('day', n.span_start) = date_trunc('day', p.span_start) AND n.span_start > p.span_start), span_start + INTERVAL 30 MINUTES) AS span_end FROM p""",
)
def w14_day(spark: SparkSession, d: str) -> DataFrame:
    """Spans of orders over their lines, those without lines up to the next start of the program that day."""
    minutes = F.make_dt_interval(mins=(F.col("o_orderkey") % 600).cast("int"))
    parents = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("program"), (F.col("o_orderdate") + minutes).alias("span_start"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate") + minutes + F.expr("INTERVAL 1 DAY")).alias("closing"))
    children = table(spark, d, "lineitem").where("l_linenumber < 3 AND l_quantity < 20").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return N.parent_span(parents, children, "o_orderkey", "l_shipdate", "l_shipdate", "closing", F.expr("INTERVAL 30 MINUTES"), [F.col("program"), F.to_date("span_start")]).select("o_orderkey", "span_start", "span_end")
