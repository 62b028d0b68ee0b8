"""Exact dedup: counting quotient filters per partition, merged by sorted remainders, then byte verification.

Every task builds counting quotient filters over the 64-bit fingerprints of its rows, one for each block of the
fingerprints' range (their leading bits). A filter is a table of packed slots: three metadata bits, a bit for counter
slots, and a remainder, or a digit of a count. Nothing is approximated, so filters merge without loss: read in slot
order, each gives its entries sorted, and two are merged by walking both. The filters of a block are merged in one
task; its size is bounded by the number of blocks, which grows with the rows. Only fingerprints counted more than once
go on, and their rows are grouped by the text itself, which verifies every byte. Copies are counted in each task
before anything is shuffled, so a text that a third of all rows hold is one entry per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.shared import clear_name, partitions, sized, written

#: Fingerprints that one task holds before it emits filters, and the mean number that one block holds when merged.
FILTER_ROWS, BLOCK_ROWS = 1 << 20, 1 << 18
#: Used slots over home slots, at most; more doubles the table.
LOAD = 0.95
_OCCUPIED, _CONTINUATION, _SHIFTED, _COUNTER = (np.uint64(1 << b) for b in range(4))
_META = np.uint64(4)


def _counted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values without repeats; the counts of equal ones add up."""
    if not len(values):
        return values, counts
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[first], np.add.reduceat(counts, first)


class CountingQuotientFilter:
    """Counts of the `bits` low bits of fingerprints, in a table of slots of whole bytes.

    The high `quotient` bits of a value name its home slot, the others are its remainder. Remainders of one home slot
    form a sorted run at it or after it; runs lie in the order of their home slots, in one row of slots that may go on
    behind the last home slot. Metadata of a slot: occupied (some value has this home), continuation (not the first of
    its run), shifted (not at home), counter. A value that occurs n > 1 times is followed by counter slots with the
    digits of n - 1, lowest first, each as wide as a remainder."""

    def __init__(self, slots: bytes, quotient: int, bits: int):
        self.slots, self.quotient, self.bits = slots, quotient, bits

    @classmethod
    def of(cls, values: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From uint64 values below 2^bits in any order."""
        ordered = np.sort(values)
        return cls.packed(*_counted(ordered, np.ones(len(ordered), np.int64)), bits)

    @classmethod
    def packed(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From sorted values without repeats and their counts."""
        quotient = max(1, bits - 60)  # a slot has eight bytes at most
        while True:
            wide = bits - quotient
            extra = (counts - 1).astype(np.uint64)
            digits = np.zeros(len(values), np.int64)
            for k in range(-(-64 // wide)):
                digits += (extra >> np.uint64(k * wide)) > 0
            used = len(values) + int(digits.sum())
            if used <= LOAD * (1 << quotient) or wide <= 8:
                break
            quotient += 1
        entry = np.repeat(np.arange(len(values)), digits + 1)
        order = np.arange(used)
        digit = order - np.repeat(np.cumsum(digits + 1) - digits - 1, digits + 1) - 1  # -1: the remainder itself
        mask = np.uint64((1 << wide) - 1)
        home = (values >> np.uint64(wide)).astype(np.int64)[entry]
        place = order + np.maximum.accumulate(home - order) if used else order
        words = np.zeros(max(1 << quotient, int(place[-1]) + 1 if used else 0), np.uint64)
        held = np.where(digit < 0, values[entry], extra[entry] >> (np.maximum(digit, 0) * wide).astype(np.uint64)) & mask
        again = np.r_[False, home[1:] == home[:-1]] if used else np.zeros(0, bool)
        words[place] = (held << _META) | again * _CONTINUATION | (place != home) * _SHIFTED | (digit >= 0) * _COUNTER
        words[home] |= _OCCUPIED
        width = -(-(wide + 4) // 8)
        return cls(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), quotient, bits)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(values, counts), sorted by value: the slots in their order. The j-th run belongs to the j-th occupied slot."""
        wide = self.bits - self.quotient
        width = -(-(wide + 4) // 8)
        packed = np.frombuffer(self.slots, np.uint8).reshape(-1, width)
        words = np.zeros((len(packed), 8), np.uint8)
        words[:, :width] = packed
        words = words.view("<u8")[:, 0]
        homes = np.flatnonzero(words & _OCCUPIED).astype(np.uint64)
        # an occupied slot always holds something: its own run, or one that was shifted onto it
        used = words[(words & (_OCCUPIED | _CONTINUATION | _SHIFTED)) > 0]
        run = np.cumsum((used & _CONTINUATION) == 0) - 1
        counter = (used & _COUNTER) > 0
        own = np.flatnonzero(~counter)
        values = (homes[run[own]] << np.uint64(wide)) | (used[own] >> _META)
        counts = np.ones(len(own), np.int64)
        owner = np.cumsum(~counter) - 1
        at = np.flatnonzero(counter)
        digit = at - own[owner[at]] - 1
        np.add.at(counts, owner[at], ((used[at] >> _META) << (digit * wide).astype(np.uint64)).astype(np.int64))
        return values, counts

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both walked in slot order: an entry's place is its rank in its own filter and in the other. Counts of equal
        (quotient, remainder) add up; nothing else changes."""
        (a, n), (b, m) = self.entries(), other.entries()
        place = np.searchsorted(a, b) + np.arange(len(b))
        values, counts = np.empty(len(a) + len(b), np.uint64), np.empty(len(a) + len(b), np.int64)
        rest = np.ones(len(values), bool)
        rest[place] = False
        values[place], counts[place], values[rest], counts[rest] = b, m, a, n
        return self.packed(*_counted(values, counts), self.bits)


def _filters(fingerprints: np.ndarray, block_bits: int) -> pd.DataFrame:
    """One filter for each block of these fingerprints; a block's number is their leading bits."""
    low = 64 - block_bits
    ordered = np.sort(fingerprints)
    block = ordered >> np.uint64(low)
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    made = [(int(block[a]), CountingQuotientFilter.of(ordered[a:b] & np.uint64((1 << low) - 1), low)) for a, b in zip(start, np.r_[start[1:], len(ordered)])]
    return pd.DataFrame([(b, f.quotient, f.slots) for b, f in made], columns=["block", "quotient", "slots"])


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp long, n long): the fingerprints (a table with the one column fp) that occur more than once.

    `rows`: how many there are about; it sets the number of blocks. Null fingerprints are left out."""
    block_bits = min(32, max(1, int(np.ceil(np.log2(max(2, rows / BLOCK_ROWS, partitions(fingerprints.sparkSession)))))))
    low = 64 - block_bits

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch["fp"].to_numpy(dtype=np.int64).view(np.uint64))
            if sum(map(len, held)) >= FILTER_ROWS:
                yield _filters(np.concatenate(held), block_bits)
                held = []
        if sum(map(len, held)):
            yield _filters(np.concatenate(held), block_bits)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        merged = [CountingQuotientFilter(s, q, low) for s, q in zip(group["slots"], group["quotient"])]
        while len(merged) > 1:
            merged = [a.merge(b) for a, b in zip(merged[::2], merged[1::2])] + merged[len(merged) & ~1 :]
        values, counts = merged[0].entries()
        again = counts > 1
        whole = (np.uint64(group["block"].iloc[0]) << np.uint64(low)) | values[again]
        return pd.DataFrame({"fp": whole.view(np.int64), "n": counts[again]})

    built = fingerprints.where(F.col("fp").isNotNull()).mapInPandas(build, "block long, quotient int, slots binary")
    return built.groupBy("block").applyInPandas(merge, "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical; a null text counts as empty. The row with the largest id stays; rows that repeat
    that very id and text stay with it. Null ids lose against any other; a group of null ids only keeps them all
    (keep_id null). No rows give no rows; other columns are ignored."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = base.withColumn("fp", F.xxhash64("text"))
    again = written(repeated_fingerprints(marked.select("fp"), docs.count()), "repeated").select("fp")
    n_again = again.count()
    classes = written(
        marked.join(sized(again, n_again), "fp")
        .groupBy("fp", "text")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("fp", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"),
        "classes",
    )
    out = marked.select("id", "fp", F.sha2("text", 256).alias("sha")).join(sized(classes), ["fp", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that exact_groups keeps, with all their columns.

    Only the ids of dropped rows are joined back: rows whose (id, text digest) lost leave."""
    i, s = clear_name(docs, "lost_id"), clear_name(docs, "lost_sha")
    lost = written(exact_groups(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias(i), F.col("text_sha256").alias(s)).distinct(), "lost")
    same = docs[id_col].eqNullSafe(lost[i]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == lost[s])
    return docs.join(sized(lost), same, "left_anti")
