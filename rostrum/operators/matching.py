"""Joins: lookups, layered and fuzzy matches, rules in order, nearest and band joins. Blocking keys keep every match an
equi join; range conditions are checked inside a block."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.operators import needles
from rostrum.operators.shared import hinted, written
from rostrum.operators.sweeps import as_of, band_of, contained_in, nearest  # noqa: F401

#: Rules that one automaton holds; more take further passes over the texts.
MOST_RULES = 1_000_000
#: Pairs of a block that are passed over in one fold; larger blocks shrink in rounds before.
GROUP_PAIRS = 4000


def children_in_order(parents: DataFrame, children: DataFrame, parent_key: str, ids: str, child_key: str, start: str) -> DataFrame:
    """Each id of a parent's ordered array with its child, ids without a child dropped; `rank` is by start, then by
    place in the array."""
    each = parents.select(parent_key, F.posexplode(ids).alias("pos", child_key))
    by = W.partitionBy(parent_key).orderBy(F.col(start).asc_nulls_last(), "pos")
    return each.join(children.hint("merge"), child_key).withColumn("rank", F.row_number().over(by)).drop("pos")


def partially_selected(parents: DataFrame, children: DataFrame, selected_parents: DataFrame, selected_children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents that aren't selected while a child of theirs is."""
    hit = children.join(selected_children.select(child_key), child_key, "left_semi").select(parent_key)
    return parents.join(hit, parent_key, "left_semi").join(selected_parents.select(parent_key), parent_key, "left_anti")


def cascade(left: DataFrame, right: DataFrame, passes: Sequence[tuple[Sequence[str], str]], value: str) -> DataFrame:
    """`value` of the first pass that finds one: a pass is (key columns, order column); of several right rows with the
    same key the last by the order column counts."""
    out = left
    for k, (keys, order) in enumerate(passes):
        best = right.groupBy(*keys).agg(F.max_by(F.col(value), F.col(order)).alias(f"found_{k}"))
        out = out.join(best, [*keys], "left")
    found = [f"found_{k}" for k in range(len(passes))]
    return out.withColumn(value, F.coalesce(*found)).drop(*found)


def edit_distance_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, most: int = 2) -> DataFrame:
    """Pairs whose texts are within `most` edits, with the distance.

    Of two texts within k edits, one of k + 1 pieces of the left occurs in the right at a place shifted by at most k.
    So the left's pieces join the right's substrings of the same length, number and length band, and only those pairs
    are measured. Texts shorter than k + 1 signs join by length alone. Distinct texts are matched once."""
    k = most + 1
    a = left.select(F.col(left_text).alias("a")).where(F.col(left_text).isNotNull()).distinct()
    b = right.select(F.col(right_text).alias("b")).where(F.col(right_text).isNotNull()).distinct()

    def keyed(df: DataFrame, text: str, total: Column, shift: Sequence[int]) -> DataFrame:
        width = F.floor(total / k).cast("int")
        keys = []
        for i in range(k):
            begin = width * i
            length = width if i < most else total - width * most
            for s in shift:
                keys.append(F.when(begin + s >= 0, F.struct(total.alias("total"), F.lit(i).alias("i"), F.substring(F.col(text), begin + s + 1, length).alias("piece"))))
        short = F.struct(total.alias("total"), F.lit(-1).alias("i"), F.lit("").alias("piece"))
        whole = F.when(total < k, F.array(short)).otherwise(F.array_distinct(F.array_compact(F.array(*keys))))
        return df.select(text, F.explode(whole).alias("key"))

    pieces = keyed(a, "a", F.length("a"), [0])
    lengths = b.select("b", F.explode(F.sequence(F.greatest(F.length("b") - most, F.lit(0)), F.length("b") + most)).alias("t"))
    windows = keyed(lengths.select("b", "t"), "b", F.col("t"), range(-most, most + 1))
    pairs = pieces.join(windows.hint("merge"), "key").select("a", "b").distinct()
    near = pairs.withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 0")
    return left.join(near.withColumnRenamed("a", left_text).hint("merge"), left_text).join(right.withColumnRenamed(right_text, "b").hint("merge"), "b").withColumnRenamed("b", right_text)


def _best_rules(distinct: DataFrame, rules: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """(text, best): of the rules that hit each text, the struct of `order` and short that is least, or null.

    The rules, which are configuration, come in parts of up to MOST_RULES or MOST_BYTES; a part is matched by one automaton over the
    texts, whatever its number of needles. The first rule of each part is found, then the least of all parts."""
    spark = distinct.sparkSession
    size = rules.agg(F.sum(F.octet_length("needle") + F.coalesce(F.octet_length("short"), F.lit(0)) + 16), F.count_if("is_regex"), F.count(F.lit(1))).first()
    parts = max(1, -(-(size[0] or 0) // needles.MOST_BYTES), -(-size[1] // needles.MOST_PATTERNS), -(-size[2] // MOST_RULES))
    found = None
    for k in range(parts):
        some = rules if parts == 1 else rules.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == k)
        rows = sorted(some.where(F.col("needle").isNotNull()).select(*order, "short", "needle", "is_regex").collect(), key=lambda r: (tuple(r[c] for c in order), r.short or ""))
        ranks = spark.createDataFrame([(i, *[r[c] for c in order], r.short) for i, r in enumerate(rows)], T.StructType([T.StructField("rank", T.IntegerType()), *[rules.schema[c] for c in order], rules.schema["short"]]))
        hits = needles.first_hits(distinct, text, [(r.needle, bool(r.is_regex)) for r in rows])
        one = hits.join(F.broadcast(ranks), "rank", "left").select(text, F.when(F.col("rank").isNotNull(), F.struct(*order, "short")).alias("best"))
        found = one if found is None else found.unionByName(one)
    return found if parts == 1 else found.groupBy(text).agg(F.min("best").alias("best"))


def first_rule(texts: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """(text, rule_id, short) of the first rule that hits each distinct text. `rules`: (rule_id, needle, is_regex, short);
    a needle is a substring or a pattern."""
    distinct = texts.select(text).where(F.col(text).isNotNull()).distinct()
    return _best_rules(distinct, rules, text, ["rule_id"]).where("best is not null").select(text, "best.rule_id", "best.short")


def resolve_labels(texts: DataFrame, tiers: Sequence[DataFrame], text: str, fallback: Column) -> DataFrame:
    """(text, short, tier): of the first tier with a rule that hits, in order, the first rule's label, else the fallback
    (tier null). All tiers are matched in one pass over the distinct texts."""
    distinct = texts.select(text).where(F.col(text).isNotNull()).distinct()
    if not tiers:
        return distinct.select(text, fallback.alias("short"), F.lit(None).cast("int").alias("tier"))
    rules = None
    for k, tier in enumerate(tiers):
        own = tier.select(F.lit(k).alias("tier"), "rule_id", "needle", "is_regex", "short")
        rules = own if rules is None else rules.unionByName(own)
    found = _best_rules(distinct, rules, text, ["tier", "rule_id"])
    return found.select(text, F.when(F.col("best").isNull(), fallback).otherwise(F.col("best.short")).alias("short"), F.col("best.tier").alias("tier"))


def unreachable_rules(rules: DataFrame) -> DataFrame:
    """Plain rules that never win, because an earlier plain needle is part of theirs: (rule_id, needle, earlier_id).
    The earlier needles are found among the substrings of each needle, by an equi join."""
    plain = rules.where("not is_regex").select("rule_id", "needle")
    starts = F.sequence(F.lit(1), F.length("needle"))
    parts = plain.select("rule_id", "needle", F.explode(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length("needle") - i + 1), lambda n: F.substring(F.col("needle"), i, n))))).alias("part")).distinct()
    early = plain.select(F.col("rule_id").alias("earlier_id"), F.col("needle").alias("part"))
    return parts.join(early.hint("merge"), "part").where("earlier_id < rule_id").groupBy("rule_id", "needle").agg(F.min("earlier_id").alias("earlier_id"))


def word_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, words: str, least: int = 2, small: str = "right") -> DataFrame:
    """(left_id, right_id, shared, left_n, right_n): pairs that share `least` distinct words or more, by an inverted
    index. Both sides have (id, words array); the index of the `small` side is counted, and broadcast where it fits."""
    index = lambda df, i, n: df.select(i, F.size(F.array_distinct(words)).alias(n), F.explode(F.array_distinct(words)).alias("word"))
    one, other = index(left, left_id, "left_n"), index(right, right_id, "right_n")
    both = one.join(hinted(other), "word") if small == "right" else other.join(hinted(one), "word")
    return both.groupBy(left_id, right_id, "left_n", "right_n").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


#: Words and rows of a right side whose index each task holds.
INDEX_WORDS, INDEX_ROWS = 1 << 20, 1 << 12
_CELLS = 1 << 22


def _best_of(words: pa.Array, wanted: pa.Array, begin: np.ndarray, rows: np.ndarray, sizes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left place, right place, score) of the pairs of `least` or more that share a word, some left rows at a time. `words`: the left rows' lists;
    `wanted`: the right side's words, whose rows are rows[begin[w]:begin[w + 1]]."""
    n = pc.list_value_length(words).fill_null(0).to_numpy()
    parent, word = pc.list_parent_indices(words).to_numpy(), pc.index_in(pc.list_flatten(words), wanted)
    known = word.is_valid().to_numpy(zero_copy_only=False)
    parent, word = parent[known], word.drop_null().to_numpy()
    step = max(1, _CELLS // len(sizes))
    for s in range(0, len(n), step):
        lo, hi = np.searchsorted(parent, [s, s + step])
        each = begin[word[lo:hi] + 1] - begin[word[lo:hi]]
        token = np.repeat(np.arange(lo, hi), each)
        right = rows[np.arange(len(token)) - (np.cumsum(each) - each)[token - lo] + begin[word[token]]]
        shared = np.bincount((parent[token] - s) * len(sizes) + right, minlength=min(step, len(n) - s) * len(sizes))
        cell = np.flatnonzero(shared)
        left, right, shared = cell // len(sizes) + s, cell % len(sizes), shared[cell]
        score = shared / (n[left] + sizes[right] - shared)
        keep = score >= least
        yield left[keep], right[keep], score[keep]


def _leading(table: pa.Table, block: str, left_id: str, most: int) -> pa.Table:
    """Of (block, left_id, _right, score) the first `most` rows of each (block, _right) by falling score, then left_id."""
    codes = table[block].combine_chunks().dictionary_encode(null_encoding="encode")
    table = table.append_column("_code", (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices)
    table = table.take(pc.sort_indices(table, [("_code", "ascending"), ("_right", "ascending"), ("score", "descending"), (left_id, "ascending")]))
    key = table["_code"].to_numpy().astype(np.int64) * (1 << 32) + table["_right"].to_numpy()
    return table.filter(pa.array(np.arange(len(key)) - np.searchsorted(key, key) < most)).drop_columns(["_code"])


def assign_similar(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str, words: str, least: float) -> DataFrame:
    """(block, left_id, right_id, score): assign_once inside each block of the left rows, by the Jaccard similarity of the distinct words,
    of all pairs that share a word and have `least` (above 0) or more. left: (block, left_id, words array), right: (right_id, words array),
    whose rows stand in every block. Ids are unique and not null.

    A right row's partner is among its best n of a block, where n is the number of right rows: fewer than n others are given away. So only those
    leave a task, and of all tasks only those are passed over. A right side of up to INDEX_ROWS rows is held as an index by each task; a larger one is joined word by word."""
    spark = left.sparkSession
    b = written(right.where(F.size(words) > 0).select(right_id, F.array_distinct(words).alias("_words")), "right-words")
    rows, each = b.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_words")), F.lit(0))).first()
    a = left.where(F.size(words) > 0).select(block, left_id, F.array_distinct(words).alias("_words"))
    if rows <= INDEX_ROWS and each <= INDEX_WORDS:
        held = b.orderBy(right_id).collect()
        ids, sizes = [r[0] for r in held], np.array([len(r[1]) for r in held], np.int64)
        flat = pa.array([w for r in held for w in r[1]], pa.string())
        wanted = pc.unique(flat)
        word = pc.index_in(flat, wanted).to_numpy() if len(flat) else np.empty(0, np.int64)
        order = np.argsort(word, kind="stable")
        begin, owner = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(wanted)))]), np.repeat(np.arange(len(held)), sizes)[order]

        def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, n = [], 0
            for batch in batches:
                for i, j, score in _best_of(batch["_words"], wanted, begin, owner, sizes, least) if rows else ():
                    i = pa.array(i)
                    kept.append(pa.table({block: batch[block].take(i), left_id: batch[left_id].take(i), "_right": pa.array(j, pa.int32()), "score": score}))
                    n += len(i)
                    if n >= _CELLS:
                        kept = [_leading(pa.concat_tables(kept), block, left_id, rows)]
                        n = 0
            if kept:
                yield from _leading(pa.concat_tables(kept), block, left_id, rows).combine_chunks().to_batches()

        named = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], T.StructType([T.StructField("_right", T.IntegerType()), b.schema[right_id]]))
        kind = T.StructType([left.schema[block], left.schema[left_id], T.StructField("_right", T.IntegerType()), T.StructField("score", T.DoubleType())])
        pairs = a.mapInArrow(leading, kind).join(F.broadcast(named), "_right").select(block, left_id, right_id, "score")
    else:
        shared = word_overlap(a, b, left_id, right_id, "_words", 1)
        scored = shared.select(left_id, right_id, (F.col("shared") / (F.col("left_n") + F.col("right_n") - F.col("shared"))).alias("score")).where(F.col("score") >= least)
        pairs = scored.join(a.select(left_id, block).hint("merge"), left_id).select(block, left_id, right_id, "score")
    first = F.row_number().over(W.partitionBy(block, right_id).orderBy(F.col("score").desc(), left_id))
    return assign_once(pairs.withColumn("_first", first).where(F.col("_first") <= rows).drop("_first"), block, left_id, right_id, "score")


def best_word_match(overlap: DataFrame, left_id: str, right_id: str, least: int = 2) -> DataFrame:
    """The best right row of each left row: equal word sets first, else a subset of either side with `least` shared
    words, the larger overlap, the smallest id."""
    equal = (F.col("shared") == F.col("left_n")) & (F.col("shared") == F.col("right_n"))
    subset = (F.col("shared") == F.least("left_n", "right_n")) & (F.col("shared") >= least)
    ranked = overlap.where(equal | subset).withColumn("rank", F.struct(equal.cast("int"), F.col("shared"), -F.col(right_id)))
    return ranked.groupBy(left_id).agg(F.max_by(F.struct(right_id, "shared", equal.alias("equal")), "rank").alias("best")).select(left_id, "best.*")


def _greedy(pairs: DataFrame, block: str | None, left_id: str, right_id: str, order: Sequence[Column]) -> DataFrame:
    """The pairs that one pass in `order` keeps, if it uses each left and each right row of a block once.

    Blocks of up to GROUP_PAIRS pairs are passed over in one go each. Larger ones (or the whole table, without a block) shrink
    in rounds over written tables before: a pair that comes first among those of its left and first among those of its
    right row is kept, and all pairs of both rows go. Each round keeps a pair at least, and most keep a large share."""
    inside = [block] if block else []
    # structs compare with nulls as equal, so blocks with a null are one like any other
    ranked = F.struct(*[c.alias(f"_{i}") for i, c in enumerate([*order, F.col(left_id), F.col(right_id)])])
    keys = {"_block": F.struct(*inside) if block else F.lit(""), "_left": F.struct(*inside, left_id), "_right": F.struct(*inside, right_id), "_order": ranked}
    read = lambda df, name: written(df.select(*pairs.columns), name).withColumns(keys)
    rest, won = read(pairs, "pairs"), []
    first = lambda side: rest.groupBy(side).agg(F.min_by(F.struct(*rest.columns), "_order").alias("row")).select("row.*")
    while True:
        large = written(rest.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_PAIRS).select("_block"), "large-blocks")
        some = large.take(1)
        won.append(_in_one_pass(rest.join(hinted(large), "_block", "left_anti") if some else rest, pairs.columns, left_id, right_id))
        if not some:
            return reduce(DataFrame.unionByName, won)
        rest = rest.join(hinted(large), "_block", "left_semi")
        kept = read(first("_left").join(first("_right").select("_left", "_right").hint("merge"), ["_left", "_right"]), "kept")
        won.append(kept.select(*pairs.columns))
        rest = read(rest.join(kept.select("_left").hint("merge"), "_left", "left_anti").join(kept.select("_right").hint("merge"), "_right", "left_anti"), "pairs")


def _in_one_pass(pairs: DataFrame, columns: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """The `columns` of the pairs of small blocks that a pass over each keeps: a fold over the block's pairs in order, whose state is
    what has been used."""
    each = F.struct("_order", F.struct(left_id).alias("l"), F.struct(right_id).alias("r"), F.struct(*columns).alias("row"))
    blocks = pairs.groupBy("_block").agg(F.array_sort(F.collect_list(each)).alias("pairs"))
    kind = lambda c: pairs.select(c).schema[0].dataType.simpleString()
    empty = lambda c, to: F.array().cast(f"array<{kind(c)}>").alias(to)
    none = F.struct(empty(F.struct(left_id), "l"), empty(F.struct(right_id), "r"), empty(F.struct(*columns), "kept"))
    taken = lambda s, p: F.array_contains(s["l"], p["l"]) | F.array_contains(s["r"], p["r"])
    take = lambda s, p: F.struct(F.array_append(s["l"], p["l"]).alias("l"), F.array_append(s["r"], p["r"]).alias("r"), F.array_append(s["kept"], p["row"]).alias("kept"))
    kept = F.aggregate("pairs", none, lambda s, p: F.when(taken(s, p), s).otherwise(take(s, p)), lambda s: s["kept"])
    return blocks.select(F.explode(kept).alias("row")).select("row.*")


def assign_once(pairs: DataFrame, block: str | None, left_id: str, right_id: str, score: str) -> DataFrame:
    """Greedy one-to-one assignment inside each block: pairs by falling score (then ids), each side used once."""
    return _greedy(pairs, block, left_id, right_id, [-F.col(score)])


def claim_in_order(pairs: DataFrame, block: str | None, left_order: Sequence[str], left_id: str, right_id: str, score: str) -> DataFrame:
    """Left rows in order each claim their best free right row of the block (of the table without a block). The order
    must be unique to a left row."""
    return _greedy(pairs, block, left_id, right_id, [*map(F.col, left_order), -F.col(score)])


def supplement(own: DataFrame, other: DataFrame, parent: str) -> DataFrame:
    """Rows of `other` are added for parents that have none of their own."""
    return own.unionByName(other.join(own.select(parent).distinct(), parent, "left_anti"))


def append_missing(own: DataFrame, other: DataFrame, keys: dict[str, Column], order: str) -> DataFrame:
    """Rows of `other` whose key isn't there yet, the first of each new key by `order`."""
    named = list(keys)
    mine = own.select(*[k.alias(n) for n, k in keys.items()]).distinct()
    theirs = other.withColumns(keys)
    first = theirs.groupBy(*named).agg(F.min_by(F.struct(*other.columns), order).alias("row"))
    same = [first[n].eqNullSafe(mine[n]) for n in named]
    return own.unionByName(first.join(mine, same, "left_anti").select("row.*"))


def fill_missing(own: DataFrame, sources: Sequence[tuple[DataFrame, Sequence[str]]], value: str) -> DataFrame:
    """Missing or blank values filled from the sources in order; each source is (table with one row a key, keys)."""
    out = own
    for k, (source, keys) in enumerate(sources):
        out = out.join(source.select(*keys, F.col(value).alias(f"from_{k}")), [*keys], "left")
    names = [f"from_{k}" for k in range(len(sources))]
    return out.withColumn(value, F.coalesce(F.nullif(F.trim(value), F.lit("")), *names)).drop(*names)

