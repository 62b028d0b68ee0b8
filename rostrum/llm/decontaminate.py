"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of WINDOW words (the whole item where it is shorter). A window is a set of shingles;
it occurs in a document only where all of them do. So one shingle is enough as the necessary prefix token: the one
that is rarest over all documents. The steps:

1. One scan of the documents marks where the benchmark's shingles occur and counts the words.
2. The marks are counted over the corpus; each window takes its rarest shingle, and windows with a shingle that
   occurs nowhere are out (no prefix token, no candidate).
3. Marks join the places (offset, width) that windows give their prefix token. A place must lie inside the document
   (positional bound) and the document must have the window's number of words (length bound). Then the words there,
   joined to a text, must be those of a window.

Step 3 joins texts, not pairs of marks and windows, so a passage that many items and documents share costs what its
occurrences do. While the benchmark has at most LITERAL_SHINGLES shingles, the scan tests for them in a literal set,
and marks carry the words around them. A larger benchmark goes through a Bloom filter of its shingles, a broadcast table
of at most BLOOM_BITS bits, then a join; its marks are bare positions, and the words of the documents that have places
are read again.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.shared import clear_name, sized, written

WINDOW, SHINGLE = 10, 4
LITERAL_SHINGLES = 100_000
#: Bits of the Bloom filter: 16 a shingle up to this many. Beyond it more false positives reach the join behind it.
BLOOM_BITS, _BUCKET_BITS = 1 << 26, 1 << 15
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased (nothing else), then runs of digits, a-z and all beyond ASCII."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.length(whole) == F.octet_length(whole)
    lower = F.when(plain, F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, _SEPARATORS), "")


def _token(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(window_id, words, width, item): each item's windows; window_id is the words joined by blanks. Items without
    words have none."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = items.select("item", "w", F.explode(starts).alias("start")).select("item", F.slice("w", F.col("start") + 1, window).alias("words"))
    return cut.select(F.array_join("words", " ").alias("window_id"), "words", F.size("words").alias("width"), "item").distinct()


def _marks(base: DataFrame, tokens: DataFrame, sizes: list[int], window: int) -> tuple[DataFrame, DataFrame]:
    """Tables (id, key, n_words) of all rows, and (key, n_words, at, token) of the marked positions, with the words
    `around` them too for a small benchmark."""
    around = lambda words, at: F.slice(words, F.greatest(at - (window - 1), F.lit(0)) + 1, F.least(at, F.lit(window - 1)) + window)
    mark = lambda words, k: lambda at: F.struct(at.alias("at"), _token(words, at, k).alias("token"), around(words, at).alias("around"))
    listed = lambda words, k, tokens: lambda at: _token(words, at, k).isin(tokens)
    spots = F.sequence(F.lit(0), F.size("words") - 1)
    n_tokens = tokens.count()
    if n_tokens <= LITERAL_SHINGLES:
        # a bounded set of numbers, tested inside the scan
        known = {k: [r.token for r in tokens.where(F.col("k") == k).select("token").collect()] for k in sizes}
        found = F.concat(F.array().cast("array<struct<at:int,token:bigint,around:array<string>>>"), *[
            F.transform(F.filter(spots, listed(F.col("words"), k, known[k])), mark(F.col("words"), k)) for k in sizes if known[k]
        ])
        scan = written(base.select("id", "key", F.size("words").alias("n_words"), F.when(F.size("words") > 0, found).alias("found")), "marks")
        marks = scan.where(F.size("found") > 0).select("key", "n_words", F.explode("found").alias("m")).select("key", "n_words", "m.*")
        return scan.select("id", "key", "n_words"), marks.dropDuplicates(["key", "at", "token"])
    token_at = lambda at, k: F.when(at + k <= F.size("words"), _token(F.col("words"), at, k))
    every = F.transform(spots, lambda at: F.struct(at.alias("at"), F.array(*[token_at(at, k) for k in sizes]).alias("tokens")))
    spot = base.where(F.size("words") > 0).select("key", F.size("words").alias("n_words"), F.explode(every).alias("m"))
    known = tokens.select("token").distinct()
    hit = _maybe(spot.select("key", "n_words", "m.at", F.explode("m.tokens").alias("token")), known, n_tokens)
    found = hit.join(sized(known, n_tokens), "token", "left_semi").dropDuplicates(["key", "at", "token"])
    return base.select("id", "key", F.size("words").alias("n_words")), written(found.select("key", "n_words", "at", "token"), "marks")


def _maybe(rows: DataFrame, tokens: DataFrame, n_tokens: int) -> DataFrame:
    """The rows whose token the Bloom filter of `tokens` has: all that are there, and few others."""
    bits = _BUCKET_BITS
    while bits < min(16 * n_tokens, BLOOM_BITS):
        bits *= 2
    bucket = lambda c: (F.pmod(c, F.lit(bits)) / _BUCKET_BITS).cast("int")
    word = lambda c: (F.pmod(c, F.lit(_BUCKET_BITS)) / 64).cast("int")
    bit = lambda c: F.pmod(c, F.lit(64)).cast("int")
    filled = (
        tokens.select(bucket(F.col("token")).alias("bucket"), word(F.col("token")).alias("word"), bit(F.col("token")).alias("bit"))
        .groupBy("bucket", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("filled"))
    )
    dense = F.transform(F.sequence(F.lit(0), F.lit(_BUCKET_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("filled", i), F.lit(0).cast("long")))
    bloom = written(filled.select("bucket", dense.alias("bits")), "bloom")
    keyed = rows.withColumn("slot", bucket(F.col("token")))
    there = F.bit_get(F.get(bloom["bits"], word(keyed["token"])), bit(keyed["token"])) == 1
    return keyed.join(F.broadcast(bloom), (keyed["slot"] == bloom["bucket"]) & there).select(*rows.columns)


def _words_at(base: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, s, e, window_id): the words of the documents at these spans (key, s, e), each document read once."""
    keys = written(spans.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    texts = base.select("key", "words").join(sized(keys.select("key")), "key", "left_semi").dropDuplicates(["key"])
    at = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.array_join(F.slice("words", x["s"] + 1, x["e"] - x["s"]), " ").alias("window_id"))
    return texts.join(keys.hint("merge"), "key").select("key", F.explode(F.transform("spans", at)).alias("h")).select("key", "h.*")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: (id_col, n_words, n_hit, n_items, items_sha256, contaminated).

    A word is hit when it lies in an occurrence of any item's window. Null and empty texts have no words and no hits;
    an empty benchmark hits nothing; rows that repeat an id and a text get the same result each; equal items all
    count; items with a null id mark words but are left out of n_items and the digest (that of the empty text where
    no item is left). Whole texts are read, however long."""
    base = docs.select(
        F.col(id_col).alias("id"),
        F.sha2(F.concat_ws("\x00", F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))), 256).substr(1, 32).alias("key"),
        item_words(F.col(text_col)).alias("words"),
    )
    windows = written(benchmark_windows(benchmark, item_col, item_text, window), "windows")
    plain = windows.select("window_id", "words", "width").distinct()
    tokens = written(
        plain.select("window_id", "width", "words", F.least("width", F.lit(SHINGLE)).alias("k"))
        .select("window_id", "width", "words", "k", F.explode(F.sequence(F.lit(0), F.col("width") - F.col("k"))).alias("off"))
        .select("window_id", "width", "k", "off", F.coalesce(*[F.when(F.col("k") == k, _token(F.col("words"), F.col("off"), k)) for k in range(1, SHINGLE + 1)]).alias("token")),
        "tokens",
    )
    sizes = sorted(r.k for r in tokens.select("k").distinct().collect())  # at most SHINGLE numbers
    rows, marks = _marks(base, tokens.select("k", "token").distinct(), sizes, window)

    often = marks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    prefix = (
        tokens.join(often.hint("merge"), "token", "left")
        .groupBy("window_id", "width")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("rarest"))
        .where("rarest.n > 0")
        .groupBy(F.col("rarest.token").alias("token"))
        .agg(F.collect_set(F.struct(F.col("rarest.off").alias("off"), "width")).alias("places"))  # at most window^2
    )
    prefix = written(prefix, "prefix")
    first = F.greatest(F.col("at") - (window - 1), F.lit(0))
    near = "around" in marks.columns
    spans = (
        marks.join(sized(prefix, width=32 + 80 + 16 * window), "token")
        .select("key", "n_words", "at", *["around"] * near, F.explode("places").alias("p"))
        .withColumns({"s": F.col("at") - F.col("p.off"), "e": F.col("at") - F.col("p.off") + F.col("p.width")})
        .where("s >= 0 AND e <= n_words")
    )
    if near:
        text = F.array_join(F.slice("around", F.col("s") - first + 1, F.col("e") - F.col("s")), " ")
        read = spans.select("key", "s", "e", text.alias("window_id")).distinct()
    else:
        read = _words_at(base, spans.select("key", "s", "e").distinct())
    hits = written(read.join(sized(plain.select("window_id"), width=256), "window_id", "left_semi").select("key", "s", "e", "window_id"), "hits")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    cover = lambda acc, h: F.struct((acc["n"] + F.greatest(h["e"] - F.greatest(h["s"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], h["e"]).alias("end"))
    words_hit = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans")).select("key", F.aggregate("spans", start, cover)["n"].cast("long").alias("n_hit"))
    named = windows.where(F.col("item").isNotNull()).select("window_id", "item").distinct()
    items_hit = (
        hits.select("key", "window_id").distinct().join(sized(named), "window_id").select("key", "item").distinct()
        .groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    )
    found = written(words_hit.join(items_hit.hint("merge"), "key", "left"), "found")
    return rows.join(sized(found), "key", "left").select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, in whose text no window of the benchmark occurs. Null ids are judged by their
    own text: an id leaves only with a contaminated text of the same digest."""
    i, s = clear_name(docs, "bad_id"), clear_name(docs, "bad_sha")
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    i_in = clear_name(docs, "row_id")
    pair = docs.select(F.struct(F.col(id_col).alias("id"), sha.alias("sha")).alias(i_in), F.col(text_col).alias(text_col))
    bad = written(contamination(pair, benchmark, i_in, text_col).where("contaminated").select(F.col(f"{i_in}.id").alias(i), F.col(f"{i_in}.sha").alias(s)).distinct(), "bad")
    return docs.join(sized(bad), docs[id_col].eqNullSafe(bad[i]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == bad[s]), "left_anti")
