"""Spelling variants: words one edit apart, found with asymmetric q-chunks, and the form that each is a variant of.

The shorter word (of two of equal length, the one that sorts first) is cut into two disjoint chunks at its middle.
One insertion, deletion or replacement leaves one of them whole, and the other word has it as a positional gram: the
first chunk at its own place, the second one shifted by the difference of the lengths (at most one). So the longer
word contributes the grams at those places, keyed by the chunk they must equal, and an equi-join on (length, chunk
number, gram) has every pair once it is verified. A pair that keeps both chunks is taken at the first one.

Words are counted over all documents before anything is joined: a word is one row however often it occurs. Joins are
sort-merge joins, whose frequent chunks adaptive execution splits; the edit distance is tested inside the join.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.shared import sized, written

#: Letters of a word: A-Z, a-z and U+00C0 to U+00FF; upper-case A-Z are gone when this is used.
_NO_LETTERS = "[^a-zÀ-ÿ]+"


def _lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """(id, run): one row for each maximal run of letters, lower-cased in A-Z, of `least` letters or more."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.split(_lowered(F.col(text_col)), _NO_LETTERS)).alias("run"))
    return runs.where(F.length("run") >= least)


def with_slips(runs: DataFrame, every: int) -> DataFrame:
    """Column `word`: the run, without one letter where the crc32 h of `<id>:<run>` is divisible by `every` (letter h
    modulo the length): slips of the pen that are the same in each run of the program. A null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.expr("cast(h % length(run) as int)")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).withColumn("word", F.when(F.col("h") % every == 0, short).otherwise(F.col("run"))).drop("h")


def counted(words: DataFrame, letters: int = 5, times: int = 3) -> DataFrame:
    """(word, n): the words of `letters` code points or more that occur `times` or more."""
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): each pair of different words one edit apart, once, a the shorter or smaller one. words: (word), distinct,
    of two letters or more."""
    w, size = F.col("word"), F.length("word")
    half = lambda n: F.expr(f"{n} div 2")
    chunks = words.select(w.alias("a"), size.alias("size")).withColumn("half", half("size"))
    chunks = chunks.select("a", "size", F.posexplode(F.array(F.expr("substr(a, 1, half)"), F.expr("substr(a, half + 1)"))).alias("which", "gram"))
    # the other word's grams: for a partner of the same length and one a letter shorter
    sizes = words.select(w.alias("b"), F.explode(F.array(size, size - 1)).alias("size")).withColumn("half", half("size"))
    grams = sizes.select("b", "size", F.posexplode(F.array(F.expr("substr(b, 1, half)"), F.expr("substr(b, half + 1 + length(b) - size)"))).alias("which", "gram"))
    keys = ["size", "which", "gram"]
    c, g = chunks.alias("c"), grams.hint("merge").alias("g")
    same = [F.col(f"c.{k}") == F.col(f"g.{k}") for k in keys]
    in_order = F.expr("length(b) > c.size OR a < b")
    once = F.expr("c.which = 0 OR substr(a, 1, c.size div 2) != substr(b, 1, c.size div 2)")
    return c.join(g, [*same, in_order, once, F.levenshtein("a", "b", 1) == 1]).select("a", "b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms ends. forms: (word, form), no cycles. Each round doubles the stretch that
    is followed, and counts rise twofold with each form, so the rounds are few whatever the number of words."""
    chain = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = written(chain.join(sized(onward), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        chain = following.select("word", "root")
        if not following.where("moved").take(1):
            return chain


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n), distinct.

    Two words are near when exactly one inserted, deleted or replaced code point makes one the other. A word's form is
    its near word of largest n (ties: the smallest in code-point order) if that n is `factor` (2 or more) times its own
    or more, else null; root follows the forms to the last. n_near counts the near words. No words give no rows."""
    words = written(words.select("word", "n"), "words")
    pairs = written(near_pairs(words.select("word")), "pairs")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(sized(counts, width=96), "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("best"), (-F.col("best.less")).alias("best_n"))
    kept = F.col("best_n") >= factor * F.col("n")
    found = written(
        words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("best")).alias("form"), F.when(kept, F.col("best_n")).alias("form_n")),
        "forms",
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(sized(roots, width=160), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
