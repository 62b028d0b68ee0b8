"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups that its links form.

A document is its set of distinct word shingles. All sets are read in one global order: first the shingles whose hash
lies in a slice of the hash space a little wider than a prefix needs, single ones before those that recur, by their
count over all documents; then the others. Two sets that overlap enough must share shingles near their beginnings:
with n shingles and a least overlap o, the first n - o + l hold at least l shared ones. Every document chooses its own
l: the counts of its first shingles give the work of scanning them and, divided by l, a bound on the documents that
share l of them; the cheapest l wins. A pair must share as many as the smaller l of the two.

Entries of busy shingles carry a bit set of the whole document: bit h(s) is flipped by every shingle s. Sets that
differ in d shingles differ in at most d bits, so the bits bound the overlap from above inside the join on shingles,
and pairs that are too far apart never leave it. That matters within groups of near copies, whose members share most
shingles without all being similar enough.

Groups of near copies would give a square of pairs. So the search has three rounds. In the first, the documents of a
busy shingle (BUSY or more) meet only its pivot, the one with the fewest shingles that are rare beside its others, which is the middle of
its group as a rule. The groups that the links form give labels. In the second, they
meet a few drawn from those that have its most common label, and more groups grow together. In
the third, documents of any shingle meet all whose label differs (of a busy one, one of the two hasn't the most common
label): pairs inside a group are never listed, and none between groups is lost. Candidates are verified on the words of the whole texts. Equal sets are one
node throughout; groups are joined by alternating large-star and small-star steps (Kiveris et al., 2014).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.shared import Scratch, clear_name, pieces, sized, written

#: Words of a shingle; the least similarity as a fraction; cost of a candidate in scanned entries.
WORDS, LEAST, CANDIDATE = 5, (80, 100), 4
#: Most shingles whose counts are kept by name: the most frequent ones (16 bytes each, broadcast).
HEAVY = 1 << 18
#: 64-bit parts of the bit set that stands for a document in the join.
PARTS = 8
#: Sets from which on a shingle is busy, and how many of them the second round draws.
BUSY, DRAWN = 16, 4

#: Bytes of text hashed together; bytes of a word that are hashed as lanes of eight.
CHUNK, LANES = 1 << 20, 64

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; fewer words than `words` are one shingle, no
    words are none. Texts are hashed together up to CHUNK bytes. A word's bytes are mixed in eight at a time (words
    over LANES bytes by xxh3), and so are the words of a shingle."""
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass").lower())
        size += len(held[-1]) + 1
        if size >= CHUNK:
            yield from _together(held, words)
            held, size = [], 0
    if held:
        yield from _together(held, words)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX[0]
    h ^= h >> np.uint64(31)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    return h


def _word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word data[start:end]; `data` has eight bytes more than the last word."""
    size = end - start
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = _mixed(size.astype(np.uint64))
    open_ = np.arange(len(start))
    for at in range(0, LANES, 8):
        open_ = open_[size[open_] > at]
        if not len(open_):
            return h
        h[open_] = _mixed(h[open_] ^ (lanes[start[open_] + at] & _MASK[np.minimum(size[open_] - at, 8)]))
    for k in np.flatnonzero(size > LANES):
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]])
    return h


def _together(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    data = b" ".join(texts) + b" " * 9
    inside = ~_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    start, end = edge[::2], edge[1::2]
    own = _word_hashes(data, start, end)
    cuts = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))
    m = max(0, len(own) - words + 1)
    whole = _shingle_hashes(own, words, m)
    for a, b in zip(cuts, cuts[1:]):
        n = b - a
        if not n:
            yield np.zeros(0, np.int64)
        elif n < words:
            yield _shingle_hashes(own[a:b], n, 1).view(np.int64)
        else:
            yield np.unique(whole[a : b - words + 1].view(np.int64))


def _shingle_hashes(own: np.ndarray, k: int, m: int) -> np.ndarray:
    h = np.full(m, np.uint64(k))
    for j in range(k if m else 0):
        h = _mixed(h ^ own[j : j + m])
    return h


def shingles(text: str | None, words: int) -> np.ndarray:
    return next(shingle_sets([text], words))


def similar(a: set, b: set, least: tuple[int, int]) -> bool:
    both = len(a & b)
    return both > 0 and least[1] * both >= least[0] * (len(a) + len(b) - both)


def word_shingles(text: str | None, words: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for verification."""
    w = words_of(text)
    return set(zip(*(w[j:] for j in range(words)))) if len(w) >= words else {tuple(w)} if w else set()


def _name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def bit_set(s: np.ndarray) -> np.ndarray:
    """PARTS * 64 bits; each shingle flips one, chosen by its hash."""
    place = _mixed(s.view(np.uint64)) >> np.uint64(40)
    odd = np.bincount((place % np.uint64(PARTS * 64)).astype(np.int64), minlength=PARTS * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _least_overlap(n: int, least: tuple[int, int]) -> int:
    return -(-least[0] * n // least[1])


def _slice_end(least: tuple[int, int]) -> int:
    """The hash below which shingles are counted: a share of the hash space a third over what a prefix needs."""
    share = min(1.0, 4 / 3 * (1 - least[0] / least[1]) + 0.07)
    return int(share * ((1 << 64) - 1)) - (1 << 63)


def choose_prefix(ordered_counts: np.ndarray, n: int, least: tuple[int, int]) -> tuple[int, int]:
    """(l, prefix length): the l whose scan and candidates are estimated to cost least."""
    need = _least_overlap(n, least)
    work = np.cumsum(np.maximum(ordered_counts - 1, 0))[n - need :]
    k = int(np.argmin(work * (1 + CANDIDATE / np.arange(1, need + 1)))) + 1
    return k, n - need + k


def _sets(docs: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """(id, mark, n, hi, lo, first): size and name of each row's set (null where it is empty), and its shingles in
    the slice that is counted."""
    end = _slice_end(least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            sets = list(shingle_sets(batch["text"], words))
            names = [_name(s) if len(s) else (None, None) for s in sets]
            first = [s[: np.searchsorted(s, end)] for s in sets]
            yield pd.DataFrame({
                "id": batch["id"], "mark": batch["mark"], "n": [len(s) for s in sets],
                "hi": pd.array([h for h, _ in names], "Int64"), "lo": pd.array([x for _, x in names], "Int64"), "first": first,
            })

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInPandas(run, f"id {kind}, mark long, n int, hi long, lo long, first array<long>")


def _prefixes(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], clash: set[int], words: int, least: tuple[int, int]) -> DataFrame:
    """(node, n, l, rare, lack, tokens, bits): each row's prefix in the global order; of its counted shingles, those
    that are rare beside its median one or that no other row has, and minus the number of the others."""
    end, last = _slice_end(least), np.iinfo(np.int64).max
    held = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, counts = held.value
        for batch in pieces(batches):
            rows = []
            for s in shingle_sets(batch["text"], words):
                if not len(s):
                    continue
                counted = int(np.searchsorted(s, end))
                c = np.full(len(s), last)
                c[:counted] = 1
                if len(names) and counted:
                    at = np.minimum(np.searchsorted(names, s[:counted]), len(names) - 1)
                    c[:counted] = np.where(names[at] == s[:counted], counts[at], 1)
                order = np.argsort(c, kind="stable")
                c = c[order]
                c[counted:] = c[counted - 1] if counted else 1  # not known
                k, length = choose_prefix(c, len(s), least)
                hi, lo = _name(s)
                rare = int((c[:counted] < max(2, c[counted // 2] / 4)).sum())
                rows.append((lo if hi in clash else hi, len(s), k, rare, rare - counted, s[order[:length]], bit_set(s)))
            yield pd.DataFrame(rows, columns=["node", "n", "l", "rare", "lack", "tokens", "bits"])

    return docs.select("text").mapInPandas(run, "node long, n int, l int, rare int, lack int, tokens array<long>, bits array<long>")


def _threshold(counts: DataFrame) -> int:
    """The least count, 2 or more, that at most HEAVY shingles reach."""
    bands = F.floor(F.log2("count") * 4).alias("band")
    rows = counts.groupBy(bands).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least"), F.max("count").alias("most")).collect()  # a few hundred bands at most
    often, n = max((r.most for r in rows), default=1) + 1, 0
    for r in sorted(rows, key=lambda r: -r.band):
        n += r.n
        if n > HEAVY:
            break
        often = r.least
    return often


_BITS = [f"x{k}" for k in range(PARTS)]


def _need(na: Column, nb: Column, least: tuple[int, int]) -> Column:
    """The least overlap of sets of na and nb shingles that link."""
    num, den = least
    return F.floor((F.lit(num) * (na + nb) + F.lit(num + den - 1)) / F.lit(num + den))


def _differ(a: str, b: str) -> Column:
    """The number of bits in which the sets of two entries differ."""
    one, *others = [F.bit_count(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))) for x in _BITS]
    return sum(others, one)


def _places(a: str, b: str, least: tuple[int, int], matches: Column) -> Column:
    """Bounds on sizes and positions for two entries of one shingle (columns n and pos) of sets that share `matches`
    shingles of their prefixes."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    need = _need(na, nb, least)
    sizes = F.lit(least[1]) * F.least(na, nb) >= F.lit(least[0]) * F.greatest(na, nb)
    return sizes & (F.col(f"{a}pos") <= na - need + matches - 1) & (F.col(f"{b}pos") <= nb - need + matches - 1)


def _may_link(a: str, b: str, least: tuple[int, int], matches: Column) -> Column:
    """The same, and the bound that the bits set on the shingles that differ."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    return _places(a, b, least, matches) & (_differ(a, b) <= na + nb - 2 * _need(na, nb, least))


def _enough(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a < b) whose prefixes share as many shingles as the smaller of their l."""
    pairs = scratch.written(pairs, "met")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("l").alias(f"l_{x}"), F.col("tokens").alias(f"t_{x}")).hint("merge")
    enough = F.size(F.array_intersect("t_a", "t_b")) >= F.least("l_a", "l_b")
    kept = scratch.written(pairs.join(side("a"), "a").join(side("b"), "b").where(enough).select("a", "b"), "enough")
    scratch.drop(pairs)
    return kept


def _own(entry: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries with their label: the root of their group, or the set itself."""
    return entry.join(sized(roots.withColumnRenamed("root", "label")), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _labelled(entry: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """The entries of shingles whose sets have different labels, with their label and whether it isn't the shingle's
    most common one (odd)."""
    own = _own(entry, roots)
    tally = own.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    center = tally.groupBy("token").agg(F.max_by("label", "n").alias("center"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    center = scratch.written(center, "centers")
    out = scratch.written(own.join(sized(center), "token").withColumn("odd", F.col("label") != F.col("center")).drop("center"), "labelled")
    scratch.drop(center)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, least: tuple[int, int], scratch: Scratch) -> DataFrame:
    """The pairs (a < b) whose whole sets of shingles, compared word by word, are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    chosen = scratch.written(classes.join(nodes.hint("merge"), "node").select("node", F.col("rep.id").alias("need"), F.col("rep.mark").alias("need_mark")), "needed")
    same = docs["id"].eqNullSafe(chosen["need"]) & (docs["mark"] == chosen["need_mark"])
    texts = scratch.written(docs.join(sized(chosen), same).select("node", "text").dropDuplicates(["node"]), "texts")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, known = None, set()
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for k, (b, x, y) in enumerate(zip(batch["b"], batch["x"], batch["y"])):
                if b != last:
                    last, known = b, word_shingles(y, words)
                good[k] = similar(word_shingles(x, words), known, least)
            yield batch.loc[good, ["a", "b"]]

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")).hint("merge"), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
    links = scratch.written(both.select("a", "b", "x", "y").mapInPandas(compare, "a long, b long"), "links")
    scratch.drop(chosen, texts)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that it reaches. A step joins links
    with each node's smallest neighbour, so the neighbours of a node never meet in one task; both sides of a join are
    written tables, so adaptive execution can split the links of a node that has very many."""
    scratch = Scratch(links.sparkSession)
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    links = scratch.written(links, "stars")
    while True:
        ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
        seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not seen.where("up > 1 or (up > 0 and down > 0)").limit(1).count():  # all are stars around their smallest node
            roots = written(links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v")).distinct(), "component")
            scratch.drop()
            return roots
        ways = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.written(ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        wide = ways.where("v > u").join(sized(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        wide = scratch.written(wide, "large")
        scratch.drop(links, least)
        least = scratch.written(wide.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = wide.join(sized(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", "m"))
        links = scratch.written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        scratch.drop(wide, least)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per row: (id_col, n_shingles, component_id, text_mark): the size of its set, and the smallest id that
    its links reach. Two rows link when least[1] * |intersection| >= least[0] * |union|.

    Null, empty and blank texts have no shingles and link with nothing (component_id is their own id). Equal sets
    always link (they are told by 128 bits); other links are verified on the words, however long the texts. Null ids
    are larger than any other; a group of null ids has a null component. Repeated rows and ties share their group;
    further columns are ignored; no rows give no rows. text_mark is a hash of the text, for joins back to rows that
    share an id."""
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    wide = scratch.written(_sets(base.select("id", "mark", "text"), words, least), "sets")
    named = wide.where("hi is not null").groupBy("hi").agg(F.min("lo").alias("x"), F.max("lo").alias("y")).where("x != y").select("hi")
    clash = {r.hi for r in named.collect()}  # two names that begin alike: n * n / 2**65 of n sets
    node = F.when(F.col("hi").isin(clash), F.col("lo")).otherwise(F.col("hi")) if clash else F.col("hi")
    rows = written(wide.select("id", "mark", "n", node.alias("node")), "nodes")

    counts = scratch.written(wide.select(F.explode("first").alias("token")).groupBy("token").count().where("count > 1"), "counts")
    often = _threshold(counts)
    frequent = counts.where(F.col("count") >= often).toPandas().sort_values("token")
    heavy = (frequent["token"].to_numpy(np.int64), frequent["count"].to_numpy(np.int64))
    scratch.drop(wide, counts)

    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
    classes = scratch.written(rows.where("node is not null").groupBy("node").agg(F.min(first).alias("rep"), F.count(F.lit(1)).alias("n_rows")), "classes")

    sets = _prefixes(base, heavy, clash, words, least).groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "l", "rare", "lack", "tokens", "bits")])
    sets = scratch.written(sets, "prefixes")
    token = F.explode("tokens").alias("token")
    shared = scratch.written(sets.select(token).groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("total")).where("total > 1"), "shared")
    entry = sets.select("node", "n", "l", F.posexplode("tokens").alias("pos", "token")).join(sized(shared, width=20, limit=1 << 25), "token")
    entry = scratch.written(entry, "entries")
    scratch.drop(shared)
    few = entry.where(F.col("total") < BUSY)
    bits = [F.col("bits")[k].alias(x) for k, x in enumerate(_BITS)]
    busy = scratch.written(entry.where(F.col("total") >= BUSY).join(sets.select("node", "rare", "lack", *bits).hint("merge"), "node"), "busy")

    # first round: a busy shingle's sets of about one size against their pivot; sizes are banded twice, half a band apart
    band = F.log(F.col("n").cast("double")) / float(np.log(least[1] / least[0]))
    bands = F.array(2 * F.floor(band), 2 * F.floor(band + 0.5) + 1).cast("array<int>")
    banded = busy.withColumn("band", F.explode(bands))
    seat = F.struct("rare", "lack", "node", "n", "l", "pos", *_BITS)
    chosen = banded.groupBy("token", "band").agg(F.min(seat).alias("p"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    pivots = scratch.written(chosen.select("token", "band", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("pos", "n", "node", "l", *_BITS)]), "pivots")
    met = banded.join(sized(pivots), ["token", "band"]).where("node != p_node").where(_may_link("", "p_", least, F.least("l", "p_l")))
    tried = _enough(met.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct(), sets, scratch)
    links = _verified(tried, base, classes, words, least, scratch)
    label = components(links)
    scratch.drop(pivots)

    # second round: those without the shingle's most common label against a few that have it
    labelled = _labelled(busy, label, scratch)
    draws = [F.max_by("node", F.xxhash64("node", "token", F.lit(k))).alias(f"d{k}") for k in range(DRAWN)]
    drawn = labelled.where(~F.col("odd")).groupBy("token").agg(*draws).select("token", F.explode(F.array_distinct(F.array(*[f"d{k}" for k in range(DRAWN)]))).alias("node"))
    seats = scratch.written(labelled.join(drawn.hint("merge"), ["token", "node"]).select("token", *[F.col(c).alias(f"p_{c}") for c in ("node", "n", "l", "pos", "label", *_BITS)]), "seats")
    met = labelled.where("odd").join(sized(seats), "token").where((F.col("label") != F.col("p_label")) & _may_link("", "p_", least, F.least("l", "p_l")))
    met = met.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti")
    more = _enough(met, sets, scratch)
    links = links.union(_verified(more, base, classes, words, least, scratch))
    tried = tried.union(more)
    scratch.drop(labelled, seats)

    # third round: sets of one shingle whose labels differ; of a busy one, one set hasn't its most common label
    label = components(links)
    labelled = _labelled(busy, label, scratch)
    scratch.drop(busy)
    fewer = F.least("a_l", "b_l")
    renamed = lambda df, x, columns: df.select("token", *[F.col(c).alias(f"{x}_{c}") for c in columns])
    columns = ("node", "n", "l", "pos", "label", "odd", *_BITS)
    once = ~F.col("b_odd") | (F.col("a_node") < F.col("b_node"))
    met = renamed(labelled, "b", columns).join(sized(renamed(labelled.where("odd"), "a", columns)), "token").where((F.col("a_label") != F.col("b_label")) & once & _may_link("a_", "b_", least, fewer))
    own = scratch.written(_own(few, label), "few")
    columns = ("node", "n", "l", "pos", "label")
    pair = renamed(own, "a", columns).join(renamed(own, "b", columns).hint("merge"), "token").where((F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label")) & _places("a_", "b_", least, fewer))
    both = [F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"), fewer.alias("need")]
    pairs = met.select(*both).union(pair.select(*both)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.first("need").alias("need")).where("k >= need")
    rest = scratch.written(pairs.select("a", "b").join(tried.hint("merge"), ["a", "b"], "left_anti"), "rest")
    links = links.union(_verified(rest, base, classes, words, least, scratch))
    scratch.drop(labelled, own, entry, sets)
    roots = components(links)

    # all rows of a group take its smallest id; sets of one row that link with nothing need no entry
    grouped = scratch.written(classes.select("node", "rep.id", "n_rows").join(roots.hint("merge"), "node", "left"), "grouped")
    smallest = grouped.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    smallest = scratch.written(smallest, "smallest")
    found = grouped.where("root is not null or n_rows > 1").join(sized(smallest), "root", "left")
    found = written(found.select("node", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.lit(True).alias("grouped")), "groups")
    scratch.drop()
    return rows.join(sized(found), "node", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.col("mark").alias("text_mark")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """The rows of `docs`, all columns, whose id is their group's: one document of each group stays. Null, empty and
    blank texts stay; rows that repeat the id and text that stays, stay with it."""
    i, m = clear_name(docs, "lost_id"), clear_name(docs, "lost_mark")
    groups = near_groups(docs, id_col, text_col, words, least).where(~F.col(id_col).eqNullSafe(F.col("component_id")))
    lost = written(groups.select(F.col(id_col).alias(i), F.col("text_mark").alias(m)).distinct(), "lost")
    same = docs[id_col].eqNullSafe(lost[i]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == lost[m])
    return docs.join(sized(lost), same, "left_anti")
