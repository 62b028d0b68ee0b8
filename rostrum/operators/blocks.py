"""Pairs of rows inside many small blocks at once, by numpy over an Arrow batch: common subsequences, matching blocks, shared words and
one-to-one passes. Texts are in `titles.title_form`: letters a-z, digits and blanks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are worked on at once; a block is never split.
CHUNK_ROWS = 60_000
#: Longest text in signs; difflib takes frequent signs of longer ones as junk.
LONGEST = 199
#: Pairs whose vectors are held at once.
_PAIRS, _RECTANGLES = 1 << 15, 1 << 12
_NONE = 37
_SYMBOLS = np.full(256, _NONE, np.uint8)
_SYMBOLS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789 ", np.uint8)] = np.arange(_NONE)


class Texts(NamedTuple):
    """Signs as numbers, a row a text, and their lengths."""

    signs: np.ndarray
    lengths: np.ndarray


class Pairs(NamedTuple):
    """All pairs of the blocks: places of the left and of the right row, and by left row where its pairs begin."""

    left: np.ndarray
    right: np.ndarray
    begin: np.ndarray


def texts_of(strings: pa.Array) -> Texts:
    data = strings.cast(pa.large_binary()) if len(strings) else pa.array([], pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    lengths = np.diff(offsets)
    flat = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(data) and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    signs = np.full((len(lengths), max(int(lengths.max(initial=0)), 1)), _NONE, np.uint8)
    signs[np.arange(signs.shape[1]) < lengths[:, None]] = _SYMBOLS[flat]
    return Texts(signs, lengths)


def pairs_of(left_block: np.ndarray, right_block: np.ndarray, blocks: int) -> Pairs:
    """Both sides' rows are in order of their blocks, which are numbered."""
    many = np.bincount(right_block, minlength=blocks)
    first = np.cumsum(many) - many
    each = many[left_block]
    begin = np.cumsum(each) - each
    left = np.repeat(np.arange(len(left_block)), each)
    return Pairs(left, np.arange(len(left)) - begin[left] + first[left_block[left]], begin)


def common_signs(a: Texts, b: Texts, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of each pair, by bits of b."""
    words = -(-b.signs.shape[1] // 64)
    masks = np.zeros((len(b.lengths), _NONE + 1, words), np.uint64)
    for k in range(b.signs.shape[1]):
        rows = np.flatnonzero(b.lengths > k)
        masks[rows, b.signs[rows, k], k >> 6] |= np.uint64(1 << (k & 63))
    masks = [np.ascontiguousarray(masks[:, :, w]).reshape(-1) for w in range(words)]
    out = np.empty(len(left), np.int64)
    for s in range(0, len(left), _PAIRS):
        i, j = left[s : s + _PAIRS], right[s : s + _PAIRS] * (_NONE + 1)
        signs = np.ascontiguousarray(a.signs[i, : int(a.lengths[i].max(initial=0))].T)
        state = [np.full(len(i), ~np.uint64(0)) for _ in range(words)]
        for row in signs:
            at, carry = j + row, None
            for w in range(words):
                m, v = masks[w][at], state[w]
                u = v & m
                total = v + u
                if words > 1:
                    over = total < v
                    if carry is not None:
                        more = total + carry
                        over |= more < total
                        total = more
                    carry = over.astype(np.uint64)
                state[w] = total | (v & ~m)
        out[s : s + _PAIRS] = 64 * words - sum(np.bitwise_count(v).astype(np.int64) for v in state)
    return out


def _longest(a: Texts, b: Texts, left: np.ndarray, right: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, begin in a, begin in b) of the longest common block of each pair inside its box (from, to in a, from, to in b): the first
    in a, then in b, of equal ones."""
    size, at_a, at_b = (np.zeros(len(left), np.int64) for _ in range(3))
    order = np.lexsort((box[1] - box[0], box[3] - box[2]))
    for s in range(0, len(order), _RECTANGLES):
        some = order[s : s + _RECTANGLES]

        def cut(t: Texts, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, none: int) -> np.ndarray:
            at = lo + np.arange(int((hi - lo).max()))[:, None]
            return np.where(at < hi, t.signs[rows, np.minimum(at, t.signs.shape[1] - 1)], np.uint8(none))

        alo, ahi, blo, bhi = box[:, some]
        x, y = cut(a, left[some], alo, ahi, 100), cut(b, right[some], blo, bhi, 101)
        run, new = (np.zeros((len(y) + 1, len(some)), np.uint8) for _ in range(2))
        best, i, j = np.zeros(len(some), np.uint8), np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        for p, row in enumerate(x):
            np.multiply(run[:-1] + np.uint8(1), y == row, out=new[1:])
            top = new.max(axis=0)
            up = np.flatnonzero(top > best)
            if len(up):
                best[up], i[up], j[up] = top[up], p, new[1:, up].argmax(axis=0)
            run, new = new, run
        size[some], at_a[some], at_b[some] = best, alo + i + 1 - best, blo + j + 1 - best
    return size, at_a, at_b


def block_ratio(a: Texts, b: Texts, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """As difflib's ratio of each pair: twice the signs in matching blocks over all signs, 1 for two empty texts."""
    found = np.zeros(len(left), np.int64)
    zero = np.zeros(len(left), np.int64)
    pair, box = np.arange(len(left)), np.stack([zero, a.lengths[left], zero, b.lengths[right]])
    while True:
        open_ = (box[0] < box[1]) & (box[2] < box[3])
        pair, box = pair[open_], box[:, open_]
        if not len(pair):
            break
        size, i, j = _longest(a, b, left[pair], right[pair], box)
        hit = size > 0
        pair, box, size, i, j = pair[hit], box[:, hit], size[hit], i[hit], j[hit]
        np.add.at(found, pair, size)
        box = np.concatenate([np.stack([box[0], i, box[2], j]), np.stack([i + size, box[1], j + size, box[3]])], axis=1)
        pair = np.concatenate([pair, pair])
    total = a.lengths[left] + b.lengths[right]
    return np.where(total == 0, 1.0, 2.0 * found / np.maximum(total, 1))


def _first_of_both(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the pairs, given in order, come first among those of their left and of their right row."""
    place = np.arange(len(left))
    firsts = []
    for rows in (left, right):
        first = np.empty(int(rows.max(initial=0)) + 1, np.int64)
        first[rows[::-1]] = place[::-1]
        firsts.append(first[rows] == place)
    return firsts[0] & firsts[1]


def one_pass(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the pairs, given in order, that a pass keeps which uses each row of either side once."""
    rest, kept = np.arange(len(left)), []
    while len(rest):
        won = rest[_first_of_both(left[rest], right[rest])]
        kept.append(won)
        rest = rest[~(np.isin(left[rest], left[won]) | np.isin(right[rest], right[won]))]
    return np.concatenate(kept) if kept else rest


def assigned(a: Texts, b: Texts, pairs: Pairs, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, similarity) one to one by falling similarity, then places. Pairs wait by an upper bound, their common
    subsequence, and are measured only when both their rows have nothing better."""
    total = a.lengths[pairs.left] + b.lengths[pairs.right]
    value = np.where(total == 0, 1.0, 2.0 * common_signs(a, b, pairs.left, pairs.right) / np.maximum(total, 1))
    keep = value >= least
    left, right, value = pairs.left[keep], pairs.right[keep], value[keep]
    measured, won = np.zeros(len(left), bool), []
    free_left, free_right = np.ones(len(a.lengths), bool), np.ones(len(b.lengths), bool)
    while len(left):
        order = np.lexsort((right, left, measured, -value))
        left, right, value, measured = left[order], right[order], value[order], measured[order]
        first = _first_of_both(left, right)
        done, asked = first & measured, np.flatnonzero(first & ~measured)
        won.append((left[done], right[done], value[done]))
        free_left[left[done]] = free_right[right[done]] = False
        value[asked], measured[asked] = block_ratio(a, b, left[asked], right[asked]), True
        keep = free_left[left] & free_right[right] & (value >= least)
        left, right, value, measured = left[keep], right[keep], value[keep], measured[keep]
    return tuple(np.concatenate(x) for x in zip(*won)) if won else (left, right, value)


def _words(strings: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word) of the distinct words of each text, and their number by row."""
    split = pc.split_pattern(strings, " ")
    rows, words = pc.list_parent_indices(split).to_numpy(), pc.index_in(pc.list_flatten(split), known).to_numpy()
    both = np.unique(rows * np.int64(len(known)) + words)
    return both // max(len(known), 1), both % max(len(known), 1), np.bincount(both // max(len(known), 1), minlength=len(strings))


def shared_words(left: pa.Array, right: pa.Array, left_block: np.ndarray, right_block: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct words the texts of each pair share, and how many each side has."""
    known = pc.unique(pa.concat_arrays([pc.list_flatten(pc.split_pattern(x, " ")) for x in (left, right)]))
    (i, w, n), (j, v, m) = _words(left, known), _words(right, known)
    asked, keys = left_block[i] * np.int64(len(known)) + w, right_block[j] * np.int64(len(known)) + v
    order = np.argsort(keys, kind="stable")
    keys, j = keys[order], j[order]
    lo, hi = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
    each = hi - lo
    token = np.repeat(np.arange(len(asked)), each)
    row = i[token]
    partner = j[np.arange(len(token)) - (np.cumsum(each) - each)[token] + lo[token]]
    many = np.bincount(right_block, minlength=int(left_block.max(initial=0)) + 1)
    first = np.cumsum(many) - many
    shared = np.bincount(pairs.begin[row] + partner - first[left_block[row]], minlength=len(pairs.left))
    return shared, n[pairs.left], m[pairs.right]


def _objects(strings: pa.Array) -> np.ndarray:
    return strings.to_numpy(zero_copy_only=False)


def presenter_score(left: pa.Array, right: pa.Array, said: pa.Array, names: pa.Array, left_block: np.ndarray, right_block: np.ndarray, pairs: Pairs) -> np.ndarray:
    """The scores of `titles.presenter_scores`, 0 where there is none. `said`: the left rows' speaker, `names`: lists of the right rows'."""
    i, j, _ = pairs
    shared, n, m = shared_words(left, right, left_block, right_block, pairs)
    jaccard = shared / np.maximum(n + m - shared, 1)
    equal = pc.index_in(left, pc.unique(right)).fill_null(-1).to_numpy()[i] == pc.index_in(right, pc.unique(right)).to_numpy()[j]
    said, texts = _objects(said), (_objects(left), _objects(right))
    spoken = np.flatnonzero(said[i] != "")
    each = pc.list_value_length(names).to_numpy()[j[spoken]]
    first = (np.cumsum(pc.list_value_length(names).to_numpy()) - pc.list_value_length(names).to_numpy())[j[spoken]]
    pair = np.repeat(np.arange(len(spoken)), each)
    name = _objects(pc.list_flatten(names))[np.arange(len(pair)) - (np.cumsum(each) - each)[pair] + first[pair]]
    speaks = np.zeros(len(i), bool)
    speaks[spoken[pair[np.fromiter((x in y or y in x for x, y in zip(name, said[i[spoken]][pair])), bool, len(pair))]]] = True
    bonus, near = np.zeros(len(i)), np.flatnonzero(~equal & (speaks | (jaccard >= 0.6)))
    bonus[near] = np.where(np.fromiter((x in y or y in x for x, y in zip(texts[0][i[near]], texts[1][j[near]])), bool, len(near)), 0.15, 0.0)
    close = (jaccard >= 0.74) | ((bonus > 0) & (jaccard >= 0.6))
    score = np.where(speaks, np.minimum(1.0, np.maximum(0.72, jaccard + 0.35 + bonus)), np.where(close, np.minimum(1.0, jaccard + bonus), 0.0))
    return np.where(equal, 1.0, score)


def chunks(batches: Iterator[pa.RecordBatch], block: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks, whose rows come one after the other, and the numbers of their rows' blocks."""
    held, rows, schema = [], 0, None

    def numbered(table: pa.Table) -> np.ndarray:
        c = table[block].chunk(0)
        if pa.types.is_nested(c.type):
            c = pc.index_in(pa.array(map(repr, c.to_pylist())), pc.unique(pa.array(map(repr, c.to_pylist()))))
        return np.concatenate([[0], np.cumsum(pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False))])

    for batch in batches:
        schema = batch.schema
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            number = numbered(table)
            cut = int(np.searchsorted(number, number[-1]))
            if cut:
                yield table.slice(0, cut).combine_chunks(), number[:cut]
            held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
    if held:
        table = pa.Table.from_batches(held, schema).combine_chunks()
        yield table, numbered(table)


def in_blocks(block: str, left_id: str, right_id: str, work: Callable[..., tuple[np.ndarray, np.ndarray, pa.Array]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows in order of (block, _side): `work` gets the left and the right rows of many blocks, the numbers of
    their blocks and how many there are, and gives the places and scores of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in chunks(batches, block):
            side = table["_side"].to_numpy()
            places = [np.flatnonzero(side == k) for k in (0, 1)]
            if not (len(places[0]) and len(places[1])):
                continue
            left, right = (table.take(p).combine_chunks() for p in places)
            i, j, score = work(left, right, number[places[0]], number[places[1]], int(number[-1]) + 1)
            if len(i):
                kept = left.take(i)
                out = pa.table({block: kept[block], left_id: kept[left_id], right_id: right[right_id].take(pa.array(j)), "score": score})
                yield from out.combine_chunks().to_batches()

    return run
