"""Matches of titles inside a session: by matching blocks, by tokens and presenters, by significant words."""

from __future__ import annotations

import difflib
import heapq
import re
import string
from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from rostrum.functions import text as T
from rostrum.operators import blocks, matching
from rostrum.operators.matching import assign_once, claim_in_order
from rostrum.operators.shared import hinted, written

#: Signs that the bound of a similarity counts one by one; all others together are one more.
_SIGNS = string.ascii_lowercase + string.digits + " "
# Words that say nothing of a title.
STOP_WORDS = ("a", "an", "and", "announcement", "announcements", "are", "as", "at", "be", "by", "event", "events", "for", "from", "in", "is", "of", "on", "or", "presentation", "presentations", "session", "sessions", "the", "this", "to", "with")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def title_form(c: Column) -> Column:
    """Folded letters and digits, other signs as single blanks."""
    return T.squeezed(F.regexp_replace(T.fold(c), "[^a-z0-9]+", " "))


def _counts(c: Column) -> Column:
    """How often each of _SIGNS occurs, then all other signs."""
    n = lambda gone: F.length(c) - F.length(F.regexp_replace(c, gone, ""))
    return F.array(*[n(s) for s in _SIGNS], n(f"[^{re.escape(_SIGNS)}]"))


def block_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the signs in matching blocks over all signs: the longest common block, then the same left and right of it."""
    matcher, last, out = difflib.SequenceMatcher(), None, []
    for x, y in zip(a, b):
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def sided(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str) -> DataFrame:
    """Both sides as rows of one table, all of a block in one partition: block, _side (0, 1), left_id, right_id, the title _t, the list
    _names (of the left a speaker) and _start. left: (block, left_id, _t, _names, _start), right: (block, right_id, _t, _names)."""
    row = lambda df, side: df.select(
        block, F.lit(side).alias("_side"), *[F.col(c) if c in df.columns else F.lit(None).cast(of.schema[c].dataType).alias(c) for c, of in ((left_id, left), (right_id, right))],
        "_t", "_names", F.col("_start") if side == 0 else F.lit(None).cast(left.schema["_start"].dataType).alias("_start"),
    )
    return row(left, 0).unionByName(row(right, 1)).where(F.col(block).isNotNull()).repartition(block)


def large_blocks(sizes: DataFrame, block: str) -> DataFrame | None:
    """Of (block, _m, _n), rows of the left and of the right or more, the blocks of more than matching.GROUP_PAIRS pairs or rows of a side;
    None without any."""
    most = F.lit(matching.GROUP_PAIRS)
    large = written(sizes.where(F.col(block).isNotNull() & ((F.col("_m") * F.col("_n") > most) | (F.greatest("_m", "_n") > most))).select(block), "large-blocks")
    return large if large.take(1) else None


def _sizes(rows: DataFrame, block: str) -> DataFrame:
    return rows.groupBy(block).agg(F.count_if(F.col("_side") == 0).alias("_m"), F.count_if(F.col("_side") == 1).alias("_n"))


def _in_blocks(rows: DataFrame, large: DataFrame | None, block: str, left_id: str, right_id: str, work: Callable, order: Sequence[Column] = ()) -> DataFrame:
    """`work` of blocks.in_blocks over the rows of small blocks; each side comes in `order`, then by its id."""
    small = rows if large is None else rows.join(hinted(large), block, "left_anti").repartition(block)
    used = small.select(block, "_side", left_id, right_id, "_t", "_names", *[o.alias(f"_o{k}") for k, o in enumerate(order)])
    ordered = used.sortWithinPartitions(block, "_side", *[F.col(f"_o{k}").asc_nulls_first() for k in range(len(order))], left_id, right_id).drop(*[f"_o{k}" for k in range(len(order))])
    kind = T_.StructType([*[rows.schema[c] for c in (block, left_id, right_id)], T_.StructField("score", T_.DoubleType())])
    return ordered.mapInArrow(blocks.in_blocks(block, left_id, right_id, work), kind)


def _large_sides(rows: DataFrame, large: DataFrame, block: str, left_id: str, right_id: str) -> tuple[DataFrame, DataFrame]:
    rows = written(rows.join(hinted(large), block, "left_semi"), "large-rows")
    return rows.where("_side = 0").drop("_side", right_id), rows.where("_side = 1").drop("_side", left_id, "_start")


def _assigned(a: Sequence[str], b: Sequence[str], least: float) -> list[tuple[int, int, float | None]]:
    """(place in a, place in b, similarity) of one block, both in order of ids, leftovers last.

    Pairs wait by an upper bound, their common subsequence, and are measured only when it is their turn."""
    masks = [{c: sum(1 << k for k, x in enumerate(y) if x == c) for c in set(y)} for y in b]
    matchers, waiting, out = {}, [], []
    for j, (y, mask) in enumerate(zip(b, masks)):
        every = (1 << len(y)) - 1
        for i, x in enumerate(a):
            v = every
            for c in x:
                u = v & mask.get(c, 0)
                v = (v + u | v - u) & every
            bound = 2.0 * (len(y) - v.bit_count()) / (len(x) + len(y)) if x or y else 1.0
            if bound >= least:
                waiting.append((-bound, False, i, j))
    heapq.heapify(waiting)
    rows, columns = set(range(len(a))), set(range(len(b)))
    while waiting and rows and columns:
        score, measured, i, j = heapq.heappop(waiting)
        if i not in rows or j not in columns:
            continue
        if measured:
            out.append((i, j, -score))
            rows.remove(i)
            columns.remove(j)
            continue
        if j not in matchers:
            matchers[j] = difflib.SequenceMatcher(None, "", b[j])
        matchers[j].set_seq1(a[i])
        if (ratio := matchers[j].ratio()) >= least:
            heapq.heappush(waiting, (-ratio, True, i, j))
    return out + ([(i, j, None) for i, j in zip(sorted(rows), sorted(columns))] if len(rows) == len(columns) else [])


def _assign_small(left: pa.Table, right: pa.Table, left_block: np.ndarray, right_block: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """assign_titles of many small blocks; those with a title over blocks.LONGEST go one by one."""
    texts = [x["_t"].chunk(0) for x in (left, right)]
    long = np.zeros(n, bool)
    for text, number in zip(texts, (left_block, right_block)):
        long[number[pc.binary_length(text).to_numpy() > blocks.LONGEST]] = True
    found = []
    if not long.all():
        some = [np.flatnonzero(~long[number]) for number in (left_block, right_block)]
        a, b = (blocks.texts_of(text.take(pa.array(rows))) for text, rows in zip(texts, some))
        i, j, score = blocks.assigned(a, b, blocks.pairs_of(left_block[some[0]], right_block[some[1]], n), least)
        free = [np.delete(rows, won) for rows, won in zip(some, (i, j))]
        over = [np.bincount(number[rows], minlength=n) for number, rows in zip((left_block, right_block), free)]
        rest = [rows[(over[0] == over[1])[number[rows]]] for number, rows in zip((left_block, right_block), free)]
        found = [(some[0][i], some[1][j], score), (*rest, np.full(len(rest[0]), np.nan))]
    for k in np.flatnonzero(long):
        rows = [np.flatnonzero(number == k) for number in (left_block, right_block)]
        if len(rows[0]) and len(rows[1]):
            won = _assigned(*(text.take(pa.array(r)).to_pylist() for text, r in zip(texts, rows)), least)
            found += [(rows[0][[w[0] for w in won]], rows[1][[w[1] for w in won]], np.array([np.nan if w[2] is None else w[2] for w in won]))] if won else []
    i, j, score = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return i, j, pa.array(score, mask=np.isnan(score))


def similar_titles(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str, title: str, least: float = 0.5) -> DataFrame:
    """(block, left_id, right_id, score) of the pairs of a block whose titles have a similarity of `least` or more.

    Pairs whose counts of signs rule that out are dropped inside the join; the others are compared once for each two
    texts. Titles are compared in `title_form`; a null title is empty, and two empty ones are equal. Null blocks match nothing."""
    side = lambda df, i, n: df.select(block, i, title_form(F.coalesce(title, F.lit(""))).alias(n)).withColumn(f"{n}_counts", _counts(F.col(n)))
    total = F.length("_a") + F.length("_b")
    common = F.aggregate(F.zip_with("_a_counts", "_b_counts", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    a, b = side(left, left_id, "_a").alias("l"), side(right, right_id, "_b").hint("merge").alias("r")
    pairs = written(a.join(b, (F.col(f"l.{block}") == F.col(f"r.{block}")) & (2 * common >= least * total)).select(F.col(f"l.{block}").alias(block), left_id, right_id, "_a", "_b"), "title-pairs")
    ratio = F.pandas_udf(block_similarity, "double")
    scored = pairs.select("_a", "_b").distinct().sortWithinPartitions("_b").withColumn("score", ratio("_a", "_b")).where(F.col("score") >= least)
    return pairs.join(scored.hint("merge"), ["_a", "_b"]).select(block, left_id, right_id, "score")


def assign_titles(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str, title: str, least: float = 0.5) -> DataFrame:
    """(block, left_id, right_id, score): a one-to-one assignment inside each block.

    Pairs by falling similarity (then ids), each side once; where a block then has as many left as right rows over, these are paired
    in order of their ids, with a null score. Ids are unique in their block. Many blocks of up to matching.GROUP_PAIRS pairs are done at once,
    and a title is compared only while both its rows are free; larger blocks list their similar pairs."""
    form, none = title_form(F.coalesce(title, F.lit(""))).alias("_t"), F.array().cast("array<string>").alias("_names")
    rows = sided(left.select(block, left_id, form, none, F.lit(None).cast("int").alias("_start")), right.select(block, right_id, form, none), block, left_id, right_id)
    return assign_sided(rows, large_blocks(_sizes(rows, block), block), block, left_id, right_id, least)


def assign_sided(rows: DataFrame, large: DataFrame | None, block: str, left_id: str, right_id: str, least: float = 0.5) -> DataFrame:
    """assign_titles of `sided` rows and their `large_blocks`."""
    small = _in_blocks(rows, large, block, left_id, right_id, partial(_assign_small, least=least))
    return small if large is None else small.unionByName(_assign_large(*_large_sides(rows, large, block, left_id, right_id), block, left_id, right_id, "_t", least))


def _assign_large(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str, title: str, least: float) -> DataFrame:
    """assign_titles by a table of the similar pairs."""
    won = written(assign_once(similar_titles(left, right, block, left_id, right_id, title, least), block, left_id, right_id, "score"), "assigned")
    rest = lambda df, i: (
        df.select(block, i).join(won.select(block, i).hint("merge"), [block, i], "left_anti")
        .withColumns({"_place": F.row_number().over(W.partitionBy(block).orderBy(i)), f"_n_{i}": F.count(F.lit(1)).over(W.partitionBy(block))})
    )
    over = rest(left, left_id).join(rest(right, right_id).hint("merge"), [block, "_place"]).where(F.col(f"_n_{left_id}") == F.col(f"_n_{right_id}"))
    return won.unionByName(over.select(block, left_id, right_id, F.lit(None).cast("double").alias("score")))


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def _candidates(a: DataFrame, b: DataFrame, block: str, left_id: str, right_id: str) -> DataFrame:
    """Pairs that may have a score: a has (block, left_id, t, s, w), b (block, right_id, u, names, v)."""
    every = lambda df, i, w: df.select(block, F.col(i).alias("id"), F.size(w).alias("n"), F.explode(w).alias("word"))
    often = every(a, left_id, "w").select(block, "word").unionByName(every(b, right_id, "v").select(block, "word")).groupBy(block, "word").agg(F.count(F.lit(1)).alias("often"))

    def prefix(df: DataFrame, i: str, w: str) -> DataFrame:
        # a partner of similarity 0.6 shares at least 0.6 n words, so one of the n - ceil(0.6 n) + 1 rarest
        ranked = every(df, i, w).join(often.hint("merge"), [block, "word"]).groupBy(block, "id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("o"))
        return ranked.select(block, "id", "n", F.explode(F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * 3 / 5) + 1).cast("int"))["word"]).alias("word"))

    pa, pb = prefix(a, left_id, "w").withColumnsRenamed({"id": left_id, "n": "n_l"}), prefix(b, right_id, "v").withColumnsRenamed({"id": right_id, "n": "n_r"})
    near = pa.join(pb.hint("merge"), [block, "word"]).where("5 * n_l >= 3 * n_r and 5 * n_r >= 3 * n_l").select(block, left_id, right_id)
    equal = a.select(block, left_id, F.col("t").alias("u")).join(b.select(block, right_id, "u").hint("merge"), [block, "u"]).select(block, left_id, right_id)
    spoken, named = a.where("s != ''").select(block, "s").distinct(), b.select(block, F.explode("names").alias("name")).distinct()
    agree = spoken.join(named.hint("merge"), block).where(F.contains("s", F.col("name")) | F.contains("name", F.col("s"))).select(block, "s", "name")
    told = a.select(block, left_id, "s").join(agree.hint("merge"), [block, "s"]).join(b.select(block, right_id, F.explode("names").alias("name")).hint("merge"), [block, "name"]).select(block, left_id, right_id)
    pairs = near.unionByName(equal).unionByName(told).distinct()
    return pairs.join(a.hint("merge"), [block, left_id]).join(b.hint("merge"), [block, right_id])


def presenter_scores(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str, least: float = 0.38) -> DataFrame:
    """(block, left_id, right_id, score) of the pairs of a block with a score of `least` (above 0) or more.

    left: (block, left_id, title, speaker), right: (block, right_id, title, speakers array). Equal titles score 1. Otherwise
    j is the Jaccard similarity of their words, and c is 0.15 where one title contains the other: with a presenter who agrees (equal,
    or one name contains the other) max(0.72, j + 0.35 + c), without only j + c where j >= 0.74, or c and j >= 0.6; never over 1.
    A blank title scores 0.

    Many blocks of up to matching.GROUP_PAIRS pairs are scored at once. In larger ones candidates are found by three equi-joins
    before: equal titles; a word of the rarest ones that a similarity of 0.6 can't do without (prefixes by rarity, sizes bounded both
    ways); and presenters, each two names of a block once."""
    rows = _presented(left, right, block, left_id, right_id)
    return score_sided(rows, large_blocks(_sizes(rows, block), block), block, left_id, right_id, least)


def _presented(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str, start: Column | None = None) -> DataFrame:
    title, start = title_form(F.coalesce("title", F.lit(""))).alias("_t"), F.lit(None).cast("int") if start is None else start
    names = F.filter(F.transform(F.coalesce("speakers", F.array().cast("array<string>")), title_form), lambda n: n.isNotNull())
    left = left.select(block, left_id, title, F.array(title_form(F.coalesce("speaker", F.lit("")))).alias("_names"), start.alias("_start"))
    return sided(left, right.select(block, right_id, title, names.alias("_names")), block, left_id, right_id)


def _scored(left: pa.Table, right: pa.Table, left_block: np.ndarray, right_block: np.ndarray, n: int, least: float, once: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """presenter_scores of many small blocks; `once`: as the left rows claim them in their order."""
    pairs = blocks.pairs_of(left_block, right_block, n)
    text, names = ([x[c].chunk(0) for x in (left, right)] for c in ("_t", "_names"))
    score = blocks.presenter_score(*text, pc.list_element(names[0], 0), names[1], left_block, right_block, pairs)
    kept = np.flatnonzero(score >= least)
    i, j, score = pairs.left[kept], pairs.right[kept], score[kept]
    if once:
        order = np.lexsort((j, -score, i))
        won = order[blocks.one_pass(i[order], j[order])]
        i, j, score = i[won], j[won], score[won]
    return i, j, pa.array(score)


def score_sided(rows: DataFrame, large: DataFrame | None, block: str, left_id: str, right_id: str, least: float = 0.38) -> DataFrame:
    """presenter_scores of `sided` rows and their `large_blocks`."""
    rows = rows.where("_t != ''")
    small = _in_blocks(rows, large, block, left_id, right_id, partial(_scored, least=least))
    return small if large is None else small.unionByName(_score_large(*_large_sides(rows, large, block, left_id, right_id), block, left_id, right_id, least))


def _score_large(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str, least: float) -> DataFrame:
    """presenter_scores by tables of candidates."""
    a = written(left.select(block, left_id, F.col("_t").alias("t"), F.get("_names", F.lit(0)).alias("s")).withColumn("w", _tokens(F.col("t"))), "talks")
    b = written(right.select(block, right_id, F.col("_t").alias("u"), F.col("_names").alias("names")).withColumn("v", _tokens(F.col("u"))), "entries")
    both = _candidates(a, b, block, left_id, right_id)
    shared = F.size(F.array_intersect("w", "v"))
    bonus = F.when(F.contains("t", F.col("u")) | F.contains("u", F.col("t")), 0.15).otherwise(0.0)
    speaks = (F.col("s") != "") & F.exists("names", lambda n: F.contains("s", n) | F.contains(n, F.col("s")))
    score = lambda j, c: F.when(F.col("t") == F.col("u"), 1.0).when(speaks, F.least(F.lit(1.0), F.greatest(F.lit(0.72), j + 0.35 + c))).when((j >= 0.74) | ((c > 0) & (j >= 0.6)), F.least(F.lit(1.0), j + c))
    # the generator keeps a filter from repeating what a score is made of
    parts = F.array(F.struct((shared / (F.size("w") + F.size("v") - shared)).alias("j"), bonus.alias("c")))
    scores = F.filter(F.transform(parts, lambda x: score(x["j"], x["c"])), lambda x: x >= least)
    return both.select(block, left_id, right_id, F.explode(scores).alias("score"))


def claim_abstracts(left: DataFrame, right: DataFrame, block: str, start: str, left_id: str, right_id: str, least: float = 0.38) -> DataFrame:
    """(block, left_id, right_id, score): the talks of a session, in order of their start (then id), each claim the free
    entry that scores best (ties: the smaller id)."""
    rows = _presented(left, right, block, left_id, right_id, F.col(start))
    return claim_sided(rows, large_blocks(_sizes(rows, block), block), block, left_id, right_id, least)


def claim_sided(rows: DataFrame, large: DataFrame | None, block: str, left_id: str, right_id: str, least: float = 0.38) -> DataFrame:
    """claim_abstracts of `sided` rows and their `large_blocks`."""
    rows = rows.where("_t != ''")
    small = _in_blocks(rows, large, block, left_id, right_id, partial(_scored, least=least, once=True), [F.col("_start")])
    if large is None:
        return small
    left, right = _large_sides(rows, large, block, left_id, right_id)
    order = F.struct(F.col("_start").isNotNull().alias("has"), F.col("_start").alias("at"))
    scored = _score_large(left, right, block, left_id, right_id, least).join(left.select(block, left_id, order.alias("_start")).hint("merge"), [block, left_id])
    return small.unionByName(claim_in_order(scored, block, ["_start", left_id], left_id, right_id, "score").drop("_start"))


def significant_words(c: Column, stop: tuple[str, ...] = STOP_WORDS + DAYS) -> Column:
    """Distinct lower-case runs of letters a-z and digits, without stop words and single letters."""
    keep = lambda w: (w != "") & (w.rlike("^[0-9]+$") | (F.length(w) >= 2)) & ~w.isin(*stop)
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), keep))


def word_set_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, words: str, least: int = 2) -> DataFrame:
    """(left_id, right_id, shared, equal): the best right row of each left row. Both sides have (id, words array, distinct).

    Equal word sets win (the smallest right id); else the larger overlap of sets of which one is in the other and has `least`
    words or more, ties to the smaller right id. Empty sets match nothing. A set lies in another only if its rarest
    word does, so each set is looked up by that one word; equal sets are one row before anything is joined."""
    side = lambda df, i, n: df.where(F.size(words) > 0).groupBy(F.array_sort(words).alias(n)).agg(F.min(i).alias(i)).withColumn(f"{n}_id", F.monotonically_increasing_id())
    a, b = written(side(left, left_id, "x").select("x", "x_id"), "left-sets"), written(side(right, right_id, "y"), "right-sets")
    # words go with the number of their set, not with the set, which would be written once a word
    each_a, each_b = a.select("x_id", F.explode("x").alias("word")), b.select("y_id", F.explode("y").alias("word"))
    often = each_a.select("word").unionByName(each_b.select("word")).groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    rarest = lambda each, i: each.join(often.hint("merge"), "word").groupBy(i).agg(F.min(F.struct("often", "word"))["word"].alias("word"))
    within = rarest(each_a, "x_id").join(each_b.hint("merge"), "word").select("x_id", "y_id")
    around = rarest(each_b, "y_id").join(each_a.hint("merge"), "word").select("x_id", "y_id")
    shared = F.size(F.array_intersect("x", "y"))
    inside = (F.col("shared") == F.least(F.size("x"), F.size("y"))) & ((F.least(F.size("x"), F.size("y")) >= least) | (F.col("x") == F.col("y")))
    pairs = within.unionByName(around).distinct().join(a.hint("merge"), "x_id").join(b.hint("merge"), "y_id").withColumn("shared", shared).where(inside)
    found = pairs.select("x_id", right_id, "shared", (F.col("x") == F.col("y")).alias("equal"))
    ranked = found.groupBy("x_id").agg(F.max_by(F.struct(right_id, "shared", "equal"), F.struct("equal", "shared", -F.col(right_id))).alias("best")).join(a.hint("merge"), "x_id").select("x", "best")
    return left.select(left_id, F.array_sort(words).alias("x")).join(ranked.hint("merge"), "x").select(left_id, "best.*")
