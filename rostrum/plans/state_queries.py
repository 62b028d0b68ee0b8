"""Queries of sources and sinks (S), search (Q), classification (C), state merges (T) and rule checks (X)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text as X
from rostrum.operators import classify as C
from rostrum.operators import matching, search, state
from rostrum.plans.join_queries import rule_tables
from rostrum.plans.registry import query
from rostrum.plans.text_queries import _FOLD as _WHOLE_FOLD
from rostrum.sources import program
from rostrum.session import shared_folder
from rostrum.sources.tables import spread, table
from rostrum.streaming import state as streaming


@query("s3_read_pages", "SELECT page_id, length(html) AS n_chars, sha256(html) AS digest FROM pages")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("n_chars"), F.sha2("html", 256).alias("digest"))


_LANE = "sum(('0x' || substr(one, {0}, 15))::BIGINT::HUGEINT)::VARCHAR"


@query("s5_fingerprint", "SELECT source, sha256(concat_ws('-', count(*)::VARCHAR, " + ", ".join(_LANE.format(k) for k in (1, 17, 33, 49)) + ")) AS digest FROM (SELECT source, sha256(doc_id::VARCHAR || chr(9) || sha256(text)) AS one FROM documents) GROUP BY source")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """One digest for each source over its documents."""
    rows = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("p"), F.sha2("text", 256).alias("h"))
    return program.digest_of(rows, [F.col("p"), F.col("h")], ["source"])


@query("s6_changed_rows", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
def s6(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    before = docs.where("source != 'src2'").withColumn("text", F.when(F.col("source") == "src1", F.concat("text", F.lit("."))).otherwise(F.col("text")))
    known = before.select("doc_id", program.row_digest(before).alias("digest"))
    return program.changed_since(docs, known, "doc_id").select("doc_id")


@query("s8_map_lines", "SELECT DISTINCT regexp_replace(unnest(string_split(text, '.')), '[\\t\\r\\n]', ' ', 'g') AS raw, source AS short FROM documents")
def s8(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every whole document as a raw label of its source."""
    docs = table(spark, d, "documents").select(F.explode(F.split("text", r"\.")).alias("raw"), F.col("source").alias("short"))
    return program.map_lines(docs).distinct()


@query("s9_envelope_round_trip", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, event_id % 7 = 0 AS rejected FROM events")
def s9(spark: SparkSession, d: str) -> DataFrame:
    coded = table(spark, d, "events").select("event_id", program.encode_envelope(F.struct("user_id", "event_type")).alias("line"))
    lines = coded.withColumn("line", F.when(F.col("event_id") % 7 == 0, F.replace("line", F.lit("CONF1"), F.lit("CONF9"))).when(F.col("event_id") % 7 == 1, F.concat(F.lit('"'), "line", F.lit('"'))).otherwise(F.col("line")))
    good, bad = program.decode_envelope(lines, "line", "user_id long, event_type string")
    return good.select("event_id", "state.user_id", F.lit(False).alias("rejected")).unionByName(bad.select("event_id", F.lit(None).cast("long").alias("user_id"), F.lit(True).alias("rejected")))


@query("s10_encode_envelope", """SELECT event_id, 'CONF1:' || base64(encode('{"user_id":' || user_id || ',"event_type":"' || event_type || '"}')) AS line FROM events""")
def s10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", program.encode_envelope(F.struct("user_id", "event_type")).alias("line"))


@query(
    "s11_notes_report",
    "SELECT conv_id, string_agg(turn || ', ' || role || CASE WHEN turn % 2 = 0 AND length(trim(text)) > 0 THEN chr(10) || '    ' || text ELSE '' END, chr(10) ORDER BY turn) AS report FROM conversations GROUP BY conv_id",
)
def s11(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    notes = turns.where("turn % 2 = 0").select("conv_id", "turn", F.col("text").alias("note"))
    items = turns.select("conv_id", "turn", F.col("turn").alias("at"), F.col("role").alias("title"))
    return program.notes_report(items, notes, "conv_id", "turn", "at", "title", "note")


@query("s12_rule_lines", "SELECT trim(regexp_replace(line, '#.*$', '')) AS pattern, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(regexp_replace(line, '#.*$', '')) <> '' GROUP BY ALL")
def s12(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return program.rule_lines(lines).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


_FOLD = "lower(strip_accents({0}))"


@query("q1_text_search", f"SELECT doc_id FROM documents WHERE contains({_FOLD.format('text')}, 'the ere') OR contains({_FOLD.format('source')}, 'the ere')")
def q1(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").select("doc_id", search.search_text(F.col("text"), F.col("source")).alias("fields"))
    return search.text_hits(items, "fields", "Thé ere").select("doc_id")


@query("q2_person_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'a. n7') OR c_nationkey = 7")
def q2(spark: SparkSession, d: str) -> DataFrame:
    """A person-shaped query finds text hits and name matches."""
    names = table(spark, d, "customer").withColumn("name", F.concat(F.lit("Ada N"), F.col("c_nationkey").cast("string")))
    asked, own = X.person(F.lit("A. N7")), X.person(F.col("name"))
    hit = (asked["surname"] == own["surname"]) & X.consistent_given(asked["given"], own["given"])
    return names.where(F.contains(X.fold(F.col("c_mktsegment")), X.fold(F.lit("A. N7"))) | hit).select("c_custkey")


@query("q3_affiliation_search", "SELECT event_id FROM events WHERE event_type = 'view'")
def q3(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("aff", F.concat_ws(" / ", F.upper("event_type"), F.col("user_id").cast("string")))
    return search.affiliation_postings(events, "event_id", "aff").where("short = 'view'").select("event_id")


@query("q4_coauthor_search", "SELECT l_orderkey FROM (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS has, bool_or(l_returnflag = 'R' AND l_suppkey = 7) AS a, bool_or(l_returnflag <> 'R' AND l_suppkey = 7) AS b FROM lineitem GROUP BY ALL) WHERE CASE WHEN has THEN a ELSE b END")
def q4(spark: SparkSession, d: str) -> DataFrame:
    """Structured authors where there are any, else the loose ones."""
    name = F.concat(F.lit("Ada N"), F.col("l_suppkey").cast("string"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", name)).alias("authors"), F.collect_set(F.when(F.col("l_returnflag") != "R", name)).alias("loose"))
    names = F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.col("loose"))
    asked = X.person(F.lit("Ada N7"))
    hit = lambda n: (X.person(n)["surname"] == asked["surname"]) & X.consistent_given(X.person(n)["given"], asked["given"])
    return rows.where(F.exists(names, hit)).select("l_orderkey")


_POOL = rf"WITH t AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS token FROM documents) SELECT {_WHOLE_FOLD.format('token')} AS fold, arg_min(token, (doc_id, encode(token))) AS display FROM t WHERE token <> '' GROUP BY ALL"


@query("q5_suggestion_pools", _POOL)
def q5(spark: SparkSession, d: str) -> DataFrame:
    """Words of all documents, of every language and of none."""
    tokens = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.explode(F.split("text", r"\s+")).alias("token")).where("token != ''")
    return search.pools(tokens, "token", "doc_id")


@query("q5_suggestion_pools_all", _POOL + " UNION ALL SELECT lower(source), arg_min(source, doc_id) FROM documents WHERE source IS NOT NULL AND lower(source) NOT IN (SELECT fold FROM (" + _POOL + ")) GROUP BY ALL")
def q5_all(spark: SparkSession, d: str) -> DataFrame:
    """One pool over the words and the sources of all documents; a word's display form comes before a source's."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id")
    words = docs.select(F.lit(0).alias("field"), "doc_id", F.explode(F.split("text", r"\s+")).alias("token")).where("token != ''")
    both = words.union(docs.where("source IS NOT NULL").select(F.lit(1), "doc_id", "source"))
    return search.pools(both.select("token", F.struct("field", "doc_id").alias("pos")), "token", "pos")


@query("q6_suggestions", "WITH v AS (SELECT value, count(*) AS n FROM (SELECT c_mktsegment AS value FROM customer UNION ALL SELECT p_type FROM part UNION ALL SELECT p_name FROM part) GROUP BY ALL), q AS (SELECT DISTINCT lower(value[1:3]) AS query FROM v) SELECT query, rank, value, n FROM (SELECT query, value, n, row_number() OVER (PARTITION BY query ORDER BY n DESC, value) AS rank FROM q JOIN v ON len(list_filter(string_split(lower(value), ' '), lambda w: starts_with(w, query))) > 0) WHERE rank <= 3")
def q6(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, c: table(spark, d, name).select(F.col(c).alias("value"))
    counts = one("customer", "c_mktsegment").union(one("part", "p_type")).union(one("part", "p_name")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    queries = counts.select(F.lower(F.substring("value", 1, 3)).alias("query")).distinct()
    return search.suggest(queries, search.prefix_index(counts, "value"), "query", "value", counts)


@query(
    "q7_batch_search",
    rf"""WITH q AS (SELECT item_id, trim(regexp_replace({_WHOLE_FOLD.format('text')}, '\s+', ' ', 'g')) AS p FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace({_WHOLE_FOLD.format('text')}, '\s+', ' ', 'g')) AS t FROM documents)
SELECT item_id, doc_id FROM q JOIN d ON contains(t, p) WHERE p <> ''""",
)
def q7(spark: SparkSession, d: str) -> DataFrame:
    """Every whole benchmark item, looked for in all documents."""
    queries = table(spark, d, "benchmark").select("item_id", "text")
    return search.batch_search(queries, spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "item_id", "doc_id", "text")


_RULES = [("urgent", "plenary"), ("high|medium", "oral"), ("^5", "poster")]


@query("c1_session_type", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'plenary' WHEN o_orderpriority LIKE '%URGENT%' THEN 'plenary' WHEN o_orderpriority LIKE '%HIGH%' OR o_orderpriority LIKE '%MEDIUM%' THEN 'oral' WHEN o_orderpriority LIKE '5%' THEN 'poster' ELSE 'other' END AS kind FROM orders")
def c1(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("o_orderkey") % 9 == 0, "An urgent title")
    return table(spark, d, "orders").select("o_orderkey", C.by_keywords([title, F.col("o_orderpriority")], _RULES, "other").alias("kind"))


@query("c2_talk_type", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'open' WHEN o_orderpriority LIKE '%URGENT%' THEN 'plenary' ELSE 'talk' END AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def c2(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", C.by_keywords([F.col("l_linestatus"), F.col("o_orderpriority")], [("^o$", "open"), ("urgent", "plenary")], "talk").alias("kind"))


@query("c3_duration_type", "SELECT event_id, CASE WHEN (value::INTEGER % 60) >= 30 THEN 'invited' WHEN event_type = 'view' THEN 'poster' ELSE 'oral' END AS kind FROM events")
def c3(spark: SparkSession, d: str) -> DataFrame:
    start = F.hour("ts") * 60 + F.minute("ts")
    end = F.pmod(start + F.rint("value").cast("int") % 60, F.lit(1440))
    return table(spark, d, "events").select("event_id", C.by_duration(C.minutes_between(start, end), F.when(F.col("event_type") == "view", "poster")).alias("kind"))


@query("c4_event_kind", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'social' WHEN contains(p_name, 'bolt') OR contains(p_name, 'nut') THEN 'break' ELSE 'event' END AS kind FROM part")
def c4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.by_keywords([F.col("p_name")], [("ring", "social"), ("bolt|nut", "break")], "event").alias("kind"))


@query("c5_phase", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'first' ELSE 'second' END AS phase, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS half FROM events")
def c5(spark: SparkSession, d: str) -> DataFrame:
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", C.phase_of(F.col("ts"), cut).alias("phase"), C.half_of_day(F.col("ts")).alias("half"))


@query("c6_format", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'plenary' WHEN o_orderpriority LIKE '5%' THEN 'poster' WHEN n IS NULL THEN 'event' ELSE 'oral' END AS format FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey")
def c6(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "orders").join(n, "o_orderkey", "left").select("o_orderkey", C.format_of(F.col("o_orderpriority"), F.coalesce("n", F.lit(0)), [("1-", "plenary"), ("5-", "poster")]).alias("format"))


@query("c7_phase_from_venue", "SELECT c_custkey, CASE WHEN contains(c_name, '7') THEN 'first' WHEN contains(c_name, '2') THEN 'second' WHEN contains(n_name, '7') THEN 'first' WHEN contains(n_name, '2') THEN 'second' ELSE 'none' END AS phase FROM customer JOIN nation ON n_nationkey = c_nationkey")
def c7(spark: SparkSession, d: str) -> DataFrame:
    """The phase by the venue's name, else by its country's."""
    both = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select("c_custkey", C.by_keywords([F.col("c_name"), F.col("n_name")], [("7", "first"), ("2", "second")], "none").alias("phase"))


def log_of(events: DataFrame) -> DataFrame:
    """Events as a log: an id for each user and value, an operation by type (errors are malformed)."""
    op = F.when(F.col("event_type").isin("view", "purchase"), "add").when(F.col("event_type").isin("click", "signup"), "del").otherwise("bad")
    return events.select("user_id", F.floor("value").cast("long").alias("id"), op.alias("op"), F.hour("ts").cast("long").alias("ts"), (F.col("event_id") % 2).cast("int").alias("incoming"), F.col("event_id").alias("seq"))


_LOG = "(SELECT user_id, floor(value)::BIGINT AS id, CASE WHEN event_type IN ('view', 'purchase') THEN 'add' WHEN event_type IN ('click', 'signup') THEN 'del' ELSE 'bad' END AS op, hour(ts) AS ts, (event_id % 2)::INTEGER AS incoming, event_id AS seq FROM events)"
_WIN = f"(SELECT user_id, id, arg_max(op, (ts, incoming, seq)) AS op, max(ts) AS ts FROM {_LOG} WHERE op <> 'bad' GROUP BY ALL)"


@query("t1_last_write_wins", f"SELECT user_id, id, op, ts FROM {_WIN}")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return state.last_write(log_of(table(spark, d, "events")), ["user_id", "id"])


@query("t1_stream", f"SELECT user_id, id, op, ts FROM {_WIN}")
def t1_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same merge as a stream over the events: changed ids are appended by batch, the last batch of an id counts."""
    path = f"{d}/events.parquet"
    out = f"{shared_folder(spark)}/t1-{uuid.uuid4().hex}"
    # a glob, so that the table may be one file or a folder of files
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.removesuffix("t") + "[t]")
    changed = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/state/batch={batch}")
    streaming.merge_stream(log_of(events), ["user_id", "id"], f"{out}/log", changed).awaitTermination()
    rows = spark.read.parquet(f"{out}/state")
    return rows.groupBy("user_id", "id").agg(F.max_by(F.struct("op", "ts"), "batch").alias("x")).select("user_id", "id", "x.op", "x.ts")


@query("t2_legacy_adds", f"SELECT user_id, id, op, ts FROM {_WIN} WHERE id % 10 > 0 UNION ALL SELECT DISTINCT user_id, id, 'add', 0 FROM {_LOG} WHERE id % 10 = 0")
def t2(spark: SparkSession, d: str) -> DataFrame:
    log = log_of(table(spark, d, "events"))
    return state.with_legacy(log, log.where("id % 10 = 0"), ["user_id", "id"])


@query("t3_merge_texts", "WITH b AS (SELECT turn, text, (conv_id % 2)::INTEGER AS l FROM conversations WHERE length(trim(text)) > 0 AND turn % 5 > 0) SELECT turn, arg_max(text, (length(text), l, encode(text))) AS text FROM b GROUP BY ALL")
def t3(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return state.merge_texts(turns.where("conv_id % 2 = 1"), turns.where("conv_id % 2 = 0"), "turn", "text", turns.where("turn % 5 = 0").select("turn").distinct())


@query("t4_current_selection", f"SELECT user_id, id FROM {_WIN} WHERE op = 'add'")
def t4(spark: SparkSession, d: str) -> DataFrame:
    return state.current(log_of(table(spark, d, "events")), ["user_id", "id"])


@query("t5_migrate_state", "SELECT DISTINCT o_custkey, strftime(o_orderdate + to_days(unnest([0, 1, 2])), '%Y-%m-%d') AS day, 'add' AS op, 7::BIGINT AS ts FROM orders WHERE o_orderstatus = 'F'")
def t5(spark: SparkSession, d: str) -> DataFrame:
    """Old ranges become the days known to the program, as adds at the last sync."""
    orders = table(spark, d, "orders")
    known = orders.select(F.explode(F.sequence(F.to_date("o_orderdate"), F.date_add("o_orderdate", 2))).alias("day"))
    ranges = orders.where("o_orderstatus = 'F'").select("o_custkey", F.to_date("o_orderdate").alias("first"), F.date_add("o_orderdate", 2).alias("last"))
    days = state.days_of_range(ranges, "first", "last", known, "day").select("o_custkey", F.date_format("day", "yyyy-MM-dd").alias("day"))
    return state.migrated(days, ["o_custkey", "day"], F.lit(7).cast("long"))


@query("t6_change_counts", f"WITH a AS (SELECT DISTINCT user_id, id FROM {_LOG} WHERE op = 'add'), b AS (SELECT user_id, id FROM {_WIN} WHERE op = 'add' UNION SELECT user_id, id + 1000 FROM {_WIN} WHERE ts > 20) SELECT coalesce(a.user_id, b.user_id) AS user_id, count(*) FILTER (WHERE a.id IS NULL) AS added, count(*) FILTER (WHERE b.id IS NULL) AS removed FROM a FULL JOIN b ON a.user_id = b.user_id AND a.id = b.id GROUP BY 1")
def t6(spark: SparkSession, d: str) -> DataFrame:
    log = log_of(table(spark, d, "events"))
    late = state.last_write(log, ["user_id", "id"]).where("ts > 20").select("user_id", (F.col("id") + 1000).alias("id"))
    after = state.current(log, ["user_id", "id"]).union(late)
    return state.change_counts(log.where("op = 'add'"), after, ["user_id", "id"], "user_id")


@query("x1_unreachable_rules", "WITH r AS (SELECT needle, min(rule_id) AS rule_id FROM (SELECT unnest([p_name, split_part(p_name, ' ', 1), p_type]) AS needle, p_partkey * 3 + unnest([0, 1, 2]) AS rule_id FROM part) GROUP BY ALL) SELECT b.needle, min(a.rule_id) AS earlier_id FROM r a JOIN r b ON a.rule_id < b.rule_id AND contains(b.needle, a.needle) GROUP BY ALL")
def x1(spark: SparkSession, d: str) -> DataFrame:
    """Rules drawn from the parts' names, in the order of their first part; later ones that an earlier one always beats."""
    words = F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_type")
    each = table(spark, d, "part").select("p_partkey", F.posexplode(words).alias("k", "needle"))
    rules = each.groupBy("needle").agg(F.min(F.col("p_partkey") * 3 + F.col("k")).alias("rule_id")).withColumn("is_regex", F.lit(False))
    return matching.unreachable_rules(rules).select("needle", "earlier_id")


_FLAG = r"""WITH t AS (SELECT doc_id, replace(lower(strip_accents(token)), 'ß', 'ss') AS token FROM (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS token FROM documents) WHERE token <> '')
SELECT coalesce(CASE WHEN contains(token, 'thea') THEN 'theatre' WHEN contains(token, 'zzz') THEN 'sleep' WHEN contains(token, 'tion') THEN 'nation' WHEN regexp_matches(token, 'keit$') THEN 'state' WHEN contains(token, 'eau') THEN 'water' WHEN contains(token, 'th') THEN 'other' END,
 CASE WHEN contains(token, 'er') THEN 'agent' WHEN regexp_matches(token, '^[aeiou]') THEN 'vowel' END, '(none)') AS short, count(*) AS n_tokens, count(DISTINCT token) AS n_labels FROM t GROUP BY ALL"""


@query("flagship_label_resolution", _FLAG)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, folded once for each distinct form, resolved by rules in tiers, then counted by label."""
    raw = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("raw")).where("raw != ''").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    folded = raw.groupBy(X.fold(F.col("raw")).alias("token")).agg(F.sum("n").alias("n"))
    labels = matching.resolve_labels(folded, rule_tables(spark), "token", F.lit("(none)"))
    return folded.join(labels.hint("merge"), "token").groupBy("short").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_labels"))

