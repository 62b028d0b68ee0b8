"""Repeated passages across documents: suffixes sorted by deep-shallow sorting, in buckets that tasks share out.

A byte goes when a string of `least` bytes that covers it also starts in a document with a smaller id. Every start of
such a string is a suffix; equal strings are neighbours once the suffixes are sorted to that depth. The steps:

1. Documents are packed into chunks, one row each (about CHUNK bytes of text, compressed), written once.
2. The suffixes of a chunk are dealt into buckets by the rarest-hashed GRAM bytes among the `least` first ones (their
   minimizer). Equal strings have equal minimizers, so a bucket sees all of them; neighbours mostly share one, so a
   run of suffixes travels as one string. First the chunks say which minimizers they have, as sorted numbers, and hear which of
   them other chunks have too, a bit each: only those buckets can have anything to find, and only their runs travel. Equal
   runs of a chunk travel once, with the smallest id that has them: a text with a million copies is one run per chunk.
3. A task sorts the suffixes of its buckets (Manzini and Ferragina, 2004): a multikey quicksort on eight-byte
   characters down to a shallow depth, whose ties alone go on to the next character; then blind tries order the groups
   that share so long a prefix and differ behind it. Each run of equal suffixes takes its smallest id. Buckets whose runs all
   come from one smallest id have nothing to find and aren't sorted.
4. What a chunk must know goes back to it: runs whose suffixes start in a smaller document than the chunk has seen.
   Joined to its chunk, it marks all members of the run, and the bytes are cut out.

Hashes choose buckets only; strings are compared as bytes. The number of buckets grows with the text. No step looks at
two documents at a time, so copies and shared passages cost their own length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.shared import partitions, pieces, written

#: Bytes of text in a chunk, of runs in a block of buckets, of text that a task looks at in one go.
CHUNK, BLOCK, PIECE = 4 << 20, 8 << 20, 1 << 18
#: Bytes of a minimizer.
GRAM = 16
#: The id that stands for null: larger than any, so such a document gives nothing to others.
_LAST = np.iinfo(np.int64).max
_LOW, _HIGH = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)


def words_of(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number."""
    out = np.empty(max(0, len(x) - 7), np.uint64)
    for k in range(min(8, len(out))):
        out[k::8] = x[k : k + 8 * len(out[k::8])].view(">u8")
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of sixteen bytes from their two words."""
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= b * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def runs_of(x: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, count, offset, hash) of each run of suffixes with one minimizer, in the texts of `x` that end at `ends`.

    A suffix needs `least` bytes inside its text. `offset`: of the minimizer in the run's string. Of equal hashes in a
    string the first counts, and only their upper half is compared, alike everywhere."""
    usable = np.ones(len(x), bool)
    begin = 0
    for end in ends.tolist():
        usable[max(begin, end - least + 1) : end] = False
        begin = end
    found = []
    for at in range(0, len(x) - least + 1, PIECE):
        part = x[at : at + PIECE + least - 1]
        words = words_of(part)
        h = _mixed(words[:-8], words[8:])
        lowest = _least_of((h & _HIGH) | np.arange(len(h), dtype=np.uint64), least - GRAM + 1)
        ok = usable[at : at + len(lowest)]
        lowest[~ok] = _LOW  # no such place in a piece
        starts = np.flatnonzero(np.r_[True, lowest[1:] != lowest[:-1]])
        counts = np.diff(np.r_[starts, len(lowest)])
        keep = ok[starts]
        starts, counts = starts[keep], counts[keep]
        place = (lowest[starts] & _LOW).astype(np.int64)
        found.append((starts + at, counts, place - starts, h[place]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


class _Branch:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int, kids: dict):
        self.depth, self.kids = depth, kids


class _Leaf:
    __slots__ = ("text", "members")

    def __init__(self, text: bytes, member: int):
        self.text, self.members = text, [member]


def blind_trie(texts: list[bytes]) -> list[list[int]]:
    """Places of equal texts together, in the order of the texts, all of one length.

    Branches know the depth where texts part, not what stands before it. A text goes down blindly, is compared once with
    the leaf it reaches, and is hung in where the two part."""
    root = _Leaf(texts[0], 0)
    for i in range(1, len(texts)):
        text, node = texts[i], root
        while type(node) is _Branch:
            kid = node.kids.get(text[node.depth])
            node = next(iter(node.kids.values())) if kid is None else kid
        if node.text == text:
            node.members.append(i)
            continue
        other = node.text
        depth = len(text) - (((int.from_bytes(text) ^ int.from_bytes(other)).bit_length() + 7) >> 3)
        above, node = None, root
        while type(node) is _Branch and node.depth < depth:
            above, node = node, node.kids[text[node.depth]]
        if type(node) is _Branch and node.depth == depth:
            node.kids[text[depth]] = _Leaf(text, i)
            continue
        split = _Branch(depth, {other[depth]: node, text[depth]: _Leaf(text, i)})
        if above is None:
            root = split
        else:
            above.kids[text[above.depth]] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is _Leaf:
            out.append(node.members)
        else:
            stack += [node.kids[b] for b in sorted(node.kids, reverse=True)]
    return out


def deep_shallow(raw: bytes, words: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of `raw` at the places `at` in the order of their first `least` bytes: (order, first), `first` true
    where a suffix differs from the one before it. words: words_of(raw)."""
    shallow = least * 2 // 3 // 8 * 8
    key = words[at]
    order = np.argsort(key, kind="quicksort")
    first = np.r_[True, np.diff(key[order]) != 0][: len(at)]
    for depth in range(8, shallow, 8):
        tied, group = _ties(first)
        key = words[at[order[tied]] + depth]
        by = np.lexsort((key, group))
        order[tied], key = order[tied][by], key[by]
        first[tied[1:]] |= key[1:] != key[:-1]
    tied, group = _ties(first)
    if not len(tied):
        return order, first
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    leader = np.repeat(at[order[tied[head]]], np.diff(np.r_[head, len(tied)]))
    own, same = at[order[tied]], np.ones(len(tied), bool)
    for depth in sorted({*range(shallow, least - 8, 8), least - 8}):
        same &= words[own + depth] == words[leader + depth]
    mixed = np.flatnonzero(np.add.reduceat(~same, head) > 0)
    for a, b in zip(tied[head[mixed]].tolist(), (tied[head[mixed]] + np.diff(np.r_[head, len(tied)])[mixed]).tolist()):
        members = order[a:b]
        leaves = blind_trie([raw[p + shallow : p + least] for p in at[members].tolist()])
        order[a:b] = members[[i for leaf in leaves for i in leaf]]
        first[a + np.cumsum([len(leaf) for leaf in leaves[:-1]], dtype=np.int64)] = True
    return order, first


def _ties(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that stand in a group of two or more, and their group's number."""
    group = np.cumsum(first) - 1
    tied = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1) if len(first) else np.zeros(0, np.int64)
    return tied, group[tied]


class _Chunk:
    """Some documents end to end, and the runs of their suffixes."""

    def __init__(self, text: bytes, ids: np.ndarray, sizes: np.ndarray, least: int):
        self.text, self.ids, self.ends, self.least = text, ids, np.cumsum(sizes), least
        self.start, self.count, self.offset, self.hash = runs_of(np.frombuffer(text, np.uint8), self.ends, least)
        self.doc = ids[np.searchsorted(self.ends, self.start, side="right")] if len(self.start) else np.zeros(0, np.int64)

    def inside(self) -> np.ndarray:
        """Which runs have a minimizer that documents of two ids here have."""
        return _between(self.hash, self.doc)

    def group(self, keep: np.ndarray) -> None:
        """Leave the runs of `keep`, and find equal ones: `kind` numbers the strings in the order of their `first` runs."""
        self.start, self.count, self.offset, self.hash, self.doc = (x[keep] for x in (self.start, self.count, self.offset, self.hash, self.doc))
        seen: dict[bytes, int] = {}
        text, cuts = self.text, zip(self.start.tolist(), (self.start + self.count + self.least - 1).tolist())
        self.kind = np.array([seen.setdefault(text[a:b], len(seen)) for a, b in cuts], np.int64)
        self.strings = list(seen)
        self.first = np.flatnonzero(np.diff(np.maximum.accumulate(np.r_[-1, self.kind])) > 0)
        self.least_doc = np.full(len(seen), _LAST)
        np.minimum.at(self.least_doc, self.kind, self.doc)


def _between(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry: is its key one that entries of two documents or more have?"""
    order = np.argsort(key, kind="stable")
    cut = _cuts(key[order])
    if not len(cut):
        return np.zeros(0, bool)
    doc = doc[order]
    out = np.empty(len(key), bool)
    out[order] = np.repeat(np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut), np.diff(np.r_[cut, len(order)]))
    return out


def _cuts(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])


def _slices(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = _cuts(values)
    return zip(cut.tolist(), np.r_[cut[1:], len(values)].tolist())


#: What a run says of itself in a block, and what a block says of a run of a chunk.
_RUN = np.dtype([("place", "<u4"), ("doc", "<i8"), ("count", "u1"), ("offset", "u1")])
_FOUND = np.dtype([("place", "<u4"), ("begin", "u1"), ("end", "u1"), ("doc", "<i8")])


def _packed(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, ids, nulls, sizes, text): documents packed into rows; a longer one has a row of its own."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in pieces(batches):
            for i, null, text in zip(batch["id"], batch["is_null"], batch["text"]):
                body = text.encode()
                if held and size + len(body) > CHUNK:
                    yield row(number, held)
                    number, held, size = number + 1, [], 0
                held.append((i, null, body))
                size += len(body)
        if held:
            yield row(number, held)

    def row(number: int, held: list) -> pd.DataFrame:
        ids, nulls, sizes = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.uint8), np.array([len(h[2]) for h in held], np.int64)
        return pd.DataFrame({"chunk": [number], "ids": [ids.tobytes()], "nulls": [nulls.tobytes()], "sizes": [sizes.tobytes()], "text": [_packed(*[h[2] for h in held])]})

    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(id_col).isNull().alias("is_null"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInPandas(pack, "chunk long, ids binary, nulls binary, sizes binary, text binary")


def _unchunked(ids: bytes, sizes: bytes, text: bytes, least: int) -> _Chunk:
    return _Chunk(_unpacked(text), np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), least)


def _block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes & _LOW) % np.uint64(blocks)).astype(np.int64)


def _minimizers(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, number) of the distinct minimizers of a chunk, sorted: the lower half of a hash chooses the block, the upper
    half names it there. Two of one name count as one, which costs time only."""
    pair = np.unique((_block_of(hashes, blocks).astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
    return (pair >> np.uint64(32)).astype(np.int64), (pair & _LOW).astype(np.uint32)


def _named(chunks: DataFrame, blocks: int, least: int) -> DataFrame:
    """(block, chunk, numbers): the minimizers of each chunk in each block, as packed steps between sorted numbers."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, ids, sizes, text in zip(batch["chunk"], batch["ids"], batch["sizes"], batch["text"]):
                block, value = _minimizers(_unchunked(ids, sizes, text, least).hash, blocks)
                rows = [(int(block[a]), number, _steps(value[a:b])) for a, b in _slices(block)]
                yield pd.DataFrame(rows, columns=["block", "chunk", "numbers"])

    return chunks.select("chunk", "ids", "sizes", "text").mapInPandas(name, "block long, chunk long, numbers binary")


def _steps(value: np.ndarray) -> bytes:
    """Sorted numbers as steps, their bytes in four planes: the upper ones are nearly empty."""
    return _packed(np.diff(value, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _stepped(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacked(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4")[:, 0], dtype=np.uint64).astype(np.uint32)


def _heard(named: DataFrame) -> DataFrame:
    """(chunk, block, bits): for each minimizer of a chunk, in order, whether another chunk has it."""

    def block(group: pd.DataFrame) -> pd.DataFrame:
        values = [_stepped(n) for n in group["numbers"]]
        every, place, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        twice = np.split((n > 1)[place], np.cumsum([len(v) for v in values])[:-1])
        return pd.DataFrame({"chunk": group["chunk"], "block": group["block"], "bits": [np.packbits(t).tobytes() for t in twice]})

    return named.groupBy("block").applyInPandas(block, "chunk long, block long, bits binary")


def _dealt(chunks: DataFrame, blocks: int, least: int) -> DataFrame:
    """(block, chunk, runs, strings): the distinct runs of each chunk that fall into each block of buckets, without those
    whose minimizer no other document has. chunks: with `heard`, an array of (block, bits)."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, ids, sizes, text, heard in zip(batch["chunk"], batch["ids"], batch["sizes"], batch["text"], batch["heard"]):
                c = _unchunked(ids, sizes, text, least)
                block, value = _minimizers(c.hash, blocks)
                bits = {h["block"]: h["bits"] for h in (heard if heard is not None else [])}
                said = [np.unpackbits(np.frombuffer(bits[int(block[a])], np.uint8), count=b - a).astype(bool) for a, b in _slices(block)]
                pair = (block.astype(np.uint64) << np.uint64(32)) | value
                own = (_block_of(c.hash, blocks).astype(np.uint64) << np.uint64(32)) | (c.hash >> np.uint64(32))
                c.group((np.concatenate(said)[np.searchsorted(pair, own)] if said else np.zeros(0, bool)) | c.inside())
                block = _block_of(c.hash[c.first], blocks)
                order = np.argsort(block, kind="stable")
                said = np.empty(len(order), _RUN)
                for name, values in (("place", c.start[c.first]), ("doc", c.least_doc), ("count", c.count[c.first]), ("offset", c.offset[c.first])):
                    said[name] = values[order]
                rows = [(int(block[order[a]]), number, said[a:b].tobytes(), _packed(*[c.strings[i] for i in order[a:b].tolist()])) for a, b in _slices(block[order])]
                yield pd.DataFrame(rows, columns=["block", "chunk", "runs", "strings"])

    return chunks.mapInPandas(deal, "block long, chunk long, runs binary, strings binary")


def _earlier(chunk: np.ndarray, runs: np.ndarray, raw: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs of one block (and the chunk of each): the stretches of suffixes that start in a document with a smaller
    id than the run has, as (chunk, _FOUND)."""
    nothing = np.zeros(0, np.int64), np.zeros(0, _FOUND)
    count = runs["count"].astype(np.int64)
    begin = np.cumsum(count + least - 1) - (count + least - 1)
    words = words_of(np.frombuffer(raw, np.uint8))
    spot = begin + runs["offset"]
    bucket = _mixed(words[spot], words[spot + 8])
    entry = np.flatnonzero(_between(bucket, runs["doc"]))
    if not len(entry):
        return nothing
    seen: dict[bytes, int] = {}
    kind = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(begin[entry].tolist(), (begin + count + least - 1)[entry].tolist())], np.int64)
    sample = entry[np.flatnonzero(np.diff(np.maximum.accumulate(np.r_[-1, kind])) > 0)]
    least_doc = np.full(len(seen), _LAST)
    np.minimum.at(least_doc, kind, runs["doc"][entry])
    inside = _ranges(count[sample])
    order, first = deep_shallow(raw, words, np.repeat(begin[sample], count[sample]) + inside, least)
    smallest = np.empty(len(order), np.int64)
    cut = np.flatnonzero(first)
    smallest[order] = np.repeat(np.minimum.reduceat(np.repeat(least_doc, count[sample])[order], cut), np.diff(np.r_[cut, len(order)]))
    where = np.cumsum(count[sample]) - count[sample]
    size = count[entry]
    inside = _ranges(size)
    value = smallest[np.repeat(where[kind], size) + inside]
    value[value >= np.repeat(runs["doc"][entry], size)] = _LAST
    cut = np.flatnonzero((inside == 0) | np.r_[True, np.diff(value) != 0])
    end = np.r_[cut[1:], len(value)]
    keep = value[cut] != _LAST
    cut, end = cut[keep], end[keep]
    owner = np.repeat(np.arange(len(entry)), size)[cut]
    found = np.empty(len(cut), _FOUND)
    found["place"], found["begin"], found["end"], found["doc"] = runs["place"][entry][owner], inside[cut], inside[cut] + end - cut, value[cut]
    return chunk[entry][owner], found


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, end to end."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _sorted_blocks(dealt: DataFrame, least: int) -> DataFrame:
    """(chunk, found): what each block has to tell a chunk."""

    def block(group: pd.DataFrame) -> pd.DataFrame:
        runs = [np.frombuffer(r, _RUN) for r in group["runs"]]
        chunk = np.repeat(group["chunk"].to_numpy(np.int64), [len(r) for r in runs])
        to, found = _earlier(chunk, np.concatenate(runs), b"".join(map(_unpacked, group["strings"])), least)
        order = np.argsort(to, kind="stable")
        rows = [(int(to[order[a]]), _packed(found[order[a:b]].tobytes())) for a, b in _slices(to[order])]
        return pd.DataFrame(rows, columns=["chunk", "found"])

    return dealt.groupBy("block").applyInPandas(block, "chunk long, found binary")


def _removed(c: _Chunk, found: np.ndarray, least: int) -> np.ndarray:
    """Which bytes of a chunk go."""
    at = np.searchsorted(c.start, found["place"])
    c.group(c.inside() | np.isin(c.hash, c.hash[at]))
    by_kind = np.argsort(c.kind, kind="stable")
    size = np.bincount(c.kind, minlength=len(c.strings))
    kind = np.searchsorted(c.start[c.first], found["place"])
    n = size[kind]
    run = by_kind[np.repeat((np.cumsum(size) - size)[kind], n) + _ranges(n)]
    later = c.doc[run] > np.repeat(found["doc"], n)
    own = np.flatnonzero(c.doc > c.least_doc[c.kind])
    begin = np.r_[(c.start[run] + np.repeat(found["begin"], n))[later], c.start[own]]
    end = np.r_[(c.start[run] + np.repeat(found["end"], n))[later], (c.start + c.count)[own]] + least - 1
    places = len(c.text) + 1
    return np.cumsum(np.bincount(begin, minlength=places) - np.bincount(end, minlength=places))[:-1] > 0


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, outputs: tuple[str, ...] = ("kept_sha256",)) -> DataFrame:
    """One row per row of `docs`: (id_col, n_bytes, n_removed, n_spans, and `outputs`).

    A byte of a text (UTF-8) is removed when a string of `least` bytes (24 to 160) that covers it also starts in a document with a
    smaller id; texts are judged as they are, not by what is left, and strings never cross documents. `outputs` may name
    kept_sha256 (lowercase hex), kept (binary: what is left, which may end inside a character), and spans (array of
    structs start, end: the maximal removed runs in bytes, end exclusive). Ids are integers. Rows that repeat an id
    remove nothing from each other. A null id counts as larger than any other. A null text is empty; a text
    shorter than `least` keeps all. Other columns are ignored. No rows give no rows."""
    if not 24 <= least <= 160:
        raise ValueError("least must be from 24 to 160")
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = written(_chunks(docs, id_col, text_col), "chunks")
    blocks = max(4 * partitions(spark), -(-4 * total // BLOCK))
    heard = _heard(_named(chunks, blocks, least)).groupBy("chunk").agg(F.collect_list(F.struct("block", "bits")).alias("heard"))
    asked = chunks.join(heard.hint("merge"), "chunk", "left").select("chunk", "ids", "sizes", "text", "heard")
    told = _sorted_blocks(_dealt(asked, blocks, least), least).groupBy("chunk").agg(F.collect_list("found").alias("found"))
    types = {"kept_sha256": "string", "kept": "binary", "spans": "array<struct<start:bigint,end:bigint>>"}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, nulls, sizes, text, found in zip(batch["ids"], batch["nulls"], batch["sizes"], batch["text"], batch["found"]):
                c = _unchunked(ids, sizes, text, least)
                gone = _removed(c, np.frombuffer(b"".join(map(_unpacked, found)) if found is not None else b"", _FOUND), least)
                yield pd.DataFrame([_row(c, gone, k, a, b) for k, (a, b) in enumerate(zip([0, *c.ends[:-1].tolist()], c.ends.tolist()))], columns=["id", "n_bytes", "n_removed", "n_spans", *outputs]).astype({"id": "Int64"}).assign(
                    id=lambda df: df["id"].mask(np.frombuffer(nulls, np.uint8).astype(bool))
                )

    def _row(c: _Chunk, gone: np.ndarray, k: int, a: int, b: int) -> tuple:
        edge = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False]))
        starts, ends = edge[::2].tolist(), edge[1::2].tolist()
        kept = b"".join(c.text[a + x : a + y] for x, y in zip([0, *ends], [*starts, b - a]))
        made = {"kept_sha256": lambda: hashlib.sha256(kept).hexdigest(), "kept": lambda: kept, "spans": lambda: [{"start": x, "end": y} for x, y in zip(starts, ends)]}
        return int(c.ids[k]), b - a, sum(ends) - sum(starts), len(starts), *[made[o]() for o in outputs]

    schema = ", ".join(["id long, n_bytes long, n_removed long, n_spans long", *[f"{o} {types[o]}" for o in outputs]])
    return chunks.join(told.hint("merge"), "chunk", "left").select("ids", "nulls", "sizes", "text", "found").mapInPandas(cut, schema).withColumnRenamed("id", id_col)
