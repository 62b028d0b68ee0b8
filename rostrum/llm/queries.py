"""The corpus operators as named queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import bpe, chat, decontaminate, exact_dedup, jaccard_join, langid, lm_score, merkle, quality, secrets, sharding, spelling, suffix_dedup
from rostrum.llm.shared import held_out

SHARDS = 16
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = langid.learn(docs, F.col("text"), F.col("lang"), ~held_out(F.col("doc_id")))
    return langid.identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, folder, "documents"), SHARDS)


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), outputs=("ids_sha256", "decoded_sha256"))


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS[:3]))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality.learn(docs, _table(spark, folder, "labels"), train=~held_out(F.col("id")))
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    groups = jaccard_join.near_groups(_table(spark, folder, "documents"), words=4, least=(85, 100))
    return groups.select("doc_id", "n_shingles", "component_id")


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(_table(spark, folder, "conversations"))


def op8_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    named, model = lm_score.train(docs)
    return lm_score.score(docs, named, model)


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    leaf = lambda n_chars: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    struck = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(struck, leaf(F.col("n_chars") + 1)).alias("tampered"))
    rows = merkle.manifest(leaves, "lang", ["doc_id"])
    folded = rows.withColumns({"proof_sha256": F.sha2(merkle.path_text(F.col("path")), 256), "folded_root": merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    runs = spelling.word_runs(_table(spark, folder, "documents"), least=5)
    return spelling.variants(spelling.counted(spelling.with_slips(runs, every=97)))


def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(_table(spark, folder, "documents"), least=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_sharding, op3_bpe, op4_secrets, op5_quality, op6_jaccard_join, op7_chat_format, op8_lm_score, op9_decontamination, op10_exact_dedup, op11_merkle, op12_spelling, op13_suffix_dedup)}


_OP7 = """
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, 'unknown'), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), c AS (SELECT turns, len(turns) AS n, min(conv_id) AS conv_id, count(*) AS n_copies FROM t GROUP BY turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM t))
SELECT conv_id, n AS n_turns, n_copies,
  array_to_string(list_transform(turns, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') AS chat
FROM c ANTI JOIN p USING (turns)
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s + 1 : s + 10] AS words FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
width AS (SELECT DISTINCT len(words) AS k FROM win),
pos AS (SELECT doc_id, k, s, w[s + 1 : s + k] AS words FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM d, width WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, k, s FROM pos JOIN win USING (words)),
cov AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS place FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_OP10 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: crc32 of a string's UTF-8 bytes, from the polynomial's rule; `crc(t)` needs the table `crc_step` in front.
_CRC_STEP = """
crc_step AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS step FROM range(256) AS r(i))
"""


def _crc(text: str) -> str:
    code = f"list_transform(range(octet_length(encode({text}))), lambda i: (strpos('0123456789ABCDEF', substr(hex(encode({text})), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode({text})), 2 * i + 2, 1)) - 1)"
    return f"xor(list_reduce({code}, lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def _leaf(n_chars: str) -> str:
    parts = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")]
    return f"sha256(concat({', '.join(parts)}))"


_OP11 = f"""
WITH RECURSIVE {_CRC_STEP},
d AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("n_chars + 1")} AS other, {_crc("doc_id::VARCHAR")} % 7 = 0 AS struck FROM documents, crc_step
), num AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
), tree AS (
  SELECT 0 AS lvl, lang, pos, leaf AS h, n FROM num
  UNION ALL
  SELECT lvl + 1, lang, pos >> 1, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) >> 1 FROM tree WHERE n > 1 GROUP BY lvl, lang, pos >> 1, n
), tops AS (
  SELECT lang, lvl AS height, h AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), upper AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM tops
  UNION ALL
  SELECT lvl + 1, pos >> 1, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) >> 1 FROM upper WHERE n > 1 GROUP BY lvl, pos >> 1, n
), steps AS (
  SELECT m.doc_id, m.lang, m.pos, t.lvl, (m.pos >> t.lvl) & 1 AS odd, coalesce(s.h, '') AS sib
  FROM num m JOIN tree t ON t.lang IS NOT DISTINCT FROM m.lang AND t.pos = m.pos >> t.lvl AND t.n > 1
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM m.lang AND s.lvl = t.lvl AND s.pos = xor(m.pos >> t.lvl, 1)
  UNION ALL
  SELECT m.doc_id, m.lang, m.pos, g.height + t.lvl, (g.pos >> t.lvl) & 1, coalesce(s.h, '')
  FROM num m JOIN tops g ON g.lang IS NOT DISTINCT FROM m.lang JOIN upper t ON t.pos = g.pos >> t.lvl AND t.n > 1
  LEFT JOIN upper s ON s.lvl = t.lvl AND s.pos = xor(g.pos >> t.lvl, 1)
), proofs AS (SELECT lang, pos, string_agg(sib, '' ORDER BY lvl) AS proof, list({{'odd': odd, 'sib': sib}} ORDER BY lvl) AS path FROM steps GROUP BY lang, pos),
done AS (
  SELECT m.doc_id, m.leaf, g.subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(coalesce(p.path, []), lambda a, s: {{'odd': s.odd, 'sib': CASE WHEN s.odd = 1 THEN sha256(s.sib || a.sib) ELSE sha256(a.sib || s.sib) END}},
      {{'odd': 0::BIGINT, 'sib': CASE WHEN m.struck AND m.doc_id IS NOT NULL THEN m.other ELSE m.leaf END}}).sib AS folded_root
  FROM num m JOIN tops g ON g.lang IS NOT DISTINCT FROM m.lang CROSS JOIN (SELECT h FROM upper WHERE n = 1) r
  LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM m.lang AND p.pos = m.pos
)
SELECT *, folded_root = root AS verified FROM done
"""

_OP12 = f"""
WITH RECURSIVE {_CRC_STEP},
runs AS (SELECT doc_id, run, count(*) AS times FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
) WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, times, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_step),
w AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM hashed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word != b.word
  UNION SELECT a.word, a.rest FROM cut a JOIN w ON w.word = a.rest
  UNION SELECT a.rest, a.word FROM cut a JOIN w ON w.word = a.rest
), best AS (
  SELECT near.word, count(*) AS n_near, max(o.n) AS most, arg_min(other, (-o.n, encode(other))) AS other FROM near JOIN w o ON o.word = near.other GROUP BY near.word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN other END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS last FROM forms
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.last WHERE forms.form IS NOT NULL
)
SELECT forms.word, forms.form, last AS root, forms.n, forms.n_near::BIGINT AS n_near, forms.form_n
FROM forms JOIN chain ON chain.word = forms.word JOIN forms f ON f.word = chain.last AND f.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_format": _OP7, "op9_decontamination": _OP9, "op10_exact_dedup": _OP10, "op11_merkle": _OP11, "op12_spelling": _OP12}
