"""Search over items: folded substring search, postings, suggestions and batches of queries over an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators.shared import hinted


def search_text(*columns: Column) -> Column:
    """The folded fields of an item as one array; missing fields are left out."""
    return F.array_compact(F.array(*[T.fold(c) for c in columns]))


def text_hits(items: DataFrame, fields: str, wanted: str, least: int = 2) -> DataFrame:
    """Items one of whose folded fields contains the folded query; queries of under `least` signs hit nothing."""
    needle = T.fold(F.lit(wanted.strip()))
    return items.where((F.length(needle) >= least) & F.exists(fields, lambda f: F.contains(f, needle)))


def affiliation_postings(items: DataFrame, key: str, field: str) -> DataFrame:
    """(short, key): the folded parts of a field split at `;`, `/` and `|`."""
    each = items.select(key, F.explode(F.split(field, "[;/|]")).alias("part"))
    return each.select(T.squeezed(T.fold(F.col("part"))).alias("short"), key).where("short != ''").distinct()


def pools(values: DataFrame, value: str, pos: str) -> DataFrame:
    """(fold, display): distinct by folded form, the first display form by `pos` wins."""
    # each distinct value is folded once; a struct keeps null positions first
    each = values.groupBy(value).agg(F.min(F.struct(pos)).alias("_at"))
    return each.groupBy(T.squeezed(T.fold(F.col(value))).alias("fold")).agg(F.min_by(value, F.struct("_at", value)).alias("display")).where("fold != ''")


def prefix_index(values: DataFrame, value: str, least: int = 3, most: int = 12) -> DataFrame:
    """(prefix, value): prefixes of `least` to `most` signs of every word of the folded value; longer prefixes are
    checked against the value itself."""
    words = F.filter(F.split(T.squeezed(T.fold(F.col(value))), "[ -]"), lambda w: F.length(w) >= least)
    each = values.select(value, F.explode(words).alias("word"))
    cut = F.transform(F.sequence(F.lit(least), F.least(F.length("word"), F.lit(most))), lambda n: F.substring(F.col("word"), F.lit(1), n))
    return each.select(F.explode(cut).alias("prefix"), value).distinct()


def suggest(queries: DataFrame, index: DataFrame, query: str, value: str, counts: DataFrame, k: int = 3, most: int = 12) -> DataFrame:
    """(query, rank, value, n): the top k values of each query by result count, ties by value. The join is on the
    query's first `most` signs."""
    asked = queries.select(query, T.fold(F.col(query)).alias("_q")).withColumn("prefix", F.substring("_q", 1, most))
    hits = asked.join(index.hint("merge"), "prefix").where(F.exists(F.split(T.squeezed(T.fold(F.col(value))), "[ -]"), lambda w: F.startswith(w, F.col("_q"))))
    ranked = hits.select(query, value).distinct().join(counts.hint("merge"), value).withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc("n"), value)))
    return ranked.where(F.col("rank") <= k).select(query, "rank", value, "n")


def suggest_people(queries: DataFrame, names: DataFrame, query: str, name: str, least: int = 3, most: int = 12) -> DataFrame:
    """(query, name, pass) of the names that a typed name may mean; the first pass that has it counts.

    Pass 1: equal surnames, or one that begins with the typed one (of `least` signs or more), and consistent given names (none
    agrees with all). Pass 2: typed given names and the beginning of a surname, however short; the name must have given names.
    Pass 3: a query of one word of `least` signs or more begins a word of the name. Blank sides match nothing.

    All passes are one equi-join on keys: surname beginnings of `least` to `most` signs, whole shorter surnames, beginnings
    of any length behind the initial of the given name, and beginnings of words; each hit is then checked in full."""
    cut = lambda c, lo: F.transform(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: (n >= lo) & (n <= F.length(c))), lambda n: F.substring(c, F.lit(1), n))
    key = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind), x))
    own = names.select(name).where(F.trim(name) != "").distinct().withColumns({"_fold": T.squeezed(T.fold(F.col(name))), "_p": T.person(F.col(name))})
    own = own.withColumns({"_sur": F.col("_p.surname"), "_given": F.col("_p.given"), "_words": F.filter(F.split("_fold", "[^a-z0-9]+"), lambda w: w != "")})
    initial = lambda g: F.concat(F.substring(F.get(g, 0), F.lit(1), F.lit(1)), F.lit(" "))
    none = F.array().cast("array<string>")
    keys = F.concat(
        key("s", cut(F.col("_sur"), least)), F.when(F.length("_sur") < least, key("e", F.array("_sur"))).otherwise(none),
        F.when(F.size("_given") > 0, F.transform(cut(F.col("_sur"), 1), lambda x: F.concat(F.lit("g"), initial("_given"), x))).otherwise(none), key("w", F.flatten(F.transform("_words", lambda w: cut(w, least)))),
    )
    index = own.select(name, "_fold", "_sur", "_given", F.explode(F.array_distinct(keys)).alias("_k"))
    asked = queries.select(query).where(F.trim(query) != "").distinct().withColumns({"_q": T.squeezed(T.fold(F.col(query))), "_p": T.person(F.col(query))})
    asked = asked.select(query, "_q", F.col("_p.surname").alias("_qs"), F.col("_p.given").alias("_qg"))
    head = lambda c: F.substring(c, 1, most)
    one = ~F.contains("_q", F.lit(" ")) & (F.length("_q") >= least)
    wanted = F.array_compact(F.array(
        F.when(F.length("_qs") >= least, F.concat(F.lit("s"), head("_qs"))), F.when((F.length("_qs") > 0) & (F.length("_qs") < least), F.concat(F.lit("e"), "_qs")),
        F.when((F.size("_qg") > 0) & (F.length("_qs") > 0), F.concat(F.lit("g"), initial("_qg"), head("_qs"))), F.when(one, F.concat(F.lit("w"), head(F.regexp_extract("_q", "^[a-z0-9]*", 0)))),
    ))
    # few queries are broadcast, so that the keys of all names are looked up where they are made instead of being shuffled and sorted
    both = index.join(hinted(asked.withColumn("_k", F.explode(F.array_distinct(wanted)))), "_k")
    agree = T.consistent_given(F.col("_qg"), F.col("_given"))
    strict = (F.col("_qs") != "") & ((F.col("_qs") == F.col("_sur")) | ((F.length("_qs") >= least) & F.startswith("_sur", F.col("_qs")))) & agree
    partial = (F.col("_qs") != "") & (F.size("_qg") > 0) & (F.size("_given") > 0) & F.startswith("_sur", F.col("_qs")) & agree
    # the query stands in the name where a word begins; it may itself contain signs that split words
    word = one & F.exists(F.sequence(F.lit(1), F.greatest(F.length("_fold"), F.lit(1))), lambda i: (F.substring(F.col("_fold"), i, F.length("_q")) == F.col("_q")) & ((i == 1) | ~F.substring(F.col("_fold"), i - 1, F.lit(1)).rlike("[a-z0-9]")))
    found = F.when(strict, 1).when(partial, 2).when(word, 3)
    return both.withColumn("pass", found).where(F.col("pass").isNotNull()).groupBy(query, name).agg(F.min("pass").alias("pass"))


def batch_search(queries: DataFrame, items: DataFrame, query_id: str, item_id: str, text: str) -> DataFrame:
    """(query_id, item_id): items whose folded text contains the query's folded text.

    A word of the query is looked up in an inverted index of the items' words, then the whole phrase is verified. The
    inner words of a query stand whole in every hit, so the longest one is taken. A query of one or two words may lie
    inside longer words: its longest word is looked up in the distinct words that contain it, found by three signs."""
    folded = lambda df, i: df.select(i, T.squeezed(T.fold(F.col(text))).alias("folded"))
    asked = folded(queries, query_id).withColumn("words", F.split("folded", " "))
    inner = F.when(F.size("words") > 2, F.slice("words", 2, F.size("words") - 2)).otherwise(F.col("words"))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = asked.where("folded != ''").select(query_id, F.col("folded").alias("phrase"), longest.alias("word"), (F.size("words") > 2).alias("whole"))
    have = folded(items, item_id)
    postings = have.select(item_id, F.explode(F.array_distinct(F.split("folded", " "))).alias("word"))
    vocabulary = postings.select("word").distinct()
    starts = F.sequence(F.lit(1), F.length("word"))
    cut = lambda k: F.transform(starts, lambda i: F.substring(F.col("word"), i, F.lit(k)))
    grams = vocabulary.where("word != ''").select("word", F.explode(F.array_distinct(F.concat(cut(1), cut(2), cut(3)))).alias("gram"))
    part = asked.where(~F.col("whole")).select(query_id, "phrase", F.col("word").alias("piece"), F.substring("word", 1, 3).alias("gram"))
    inside = grams.join(part.hint("merge"), "gram").where(F.contains("word", F.col("piece"))).select(query_id, "phrase", "word")
    looked_up = asked.where("whole").select(query_id, "phrase", "word").unionByName(inside)
    candidates = postings.join(looked_up.hint("merge"), "word").select(query_id, "phrase", item_id)
    return candidates.join(have.hint("merge"), item_id).where(F.contains("folded", F.col("phrase"))).select(query_id, item_id).distinct()


def hit_counts(postings: DataFrame, short: str, key: str) -> DataFrame:
    """(short, n): how many items each suggestion would return."""
    return postings.select(short, key).distinct().groupBy(short).agg(F.count(F.lit(1)).alias("n"))


def natural_key(c: Column) -> Column:
    """Folded text whose runs of digits have their length before them and no leading zeros, so that numbers of any
    length sort by value."""
    parts = F.regexp_extract_all(T.fold(c), F.lit("([0-9]+|[^0-9]+)"))

    def key(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]+$"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(parts, key), "")
