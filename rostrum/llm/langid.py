"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds the n-grams of all languages at once: each slot is a mask with one bit a language, so
one lookup (the AND of a few slots) returns every language that has the n-gram. A text goes to the language with the
highest share of its n-grams, after correction for the false positives that the language's fill of the filter
implies: with hit share h and false-positive rate f, the corrected share is (h - f) / (1 - f).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.shared import pieces, written

#: N-gram lengths; hash functions; most rows learned from for each language; most slots of the filter.
SIZES, HASHES, TRAIN_ROWS, MOST_SLOTS = (3, 4), 3, 5_000, 1 << 24
#: An n-gram belongs to a language from this count and this share of its highest rate in any language.
LEAST_COUNT, LEAST_RATE = 3, 0.35
#: Characters looked at together in a task.
CHUNK = 1 << 21
NO_LANGUAGE = "und"

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every n-gram: letters lower-cased, each run of other signs one blank, and blanks
    around the text; n-grams with a blank inside are left out, those at a word's edges stay, so every text with a
    letter has one."""
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    letter = _letters()[codes]
    # a blank stays where a letter stands before it, or where a text begins
    keep = letter | np.r_[True, letter[:-1] | (own[1:] != own[:-1])] if len(codes) else letter
    codes, own, letter = np.where(letter, codes, 32)[keep].astype(np.uint64), own[keep], letter[keep]
    found, index = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n))
        for j in range(n):
            h = (h ^ codes[j : j + m]) * _MIX[0]
            h ^= h >> np.uint64(29)
        whole = own[:m] == own[n - 1 :]
        for j in range(1, n - 1):
            whole &= letter[j : j + m]
        found.append(h[whole])
        index.append(own[:m][whole])
    return (np.concatenate(found), np.concatenate(index)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def chunks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(indices, parts): texts together up to CHUNK characters; longer ones in overlapping parts, whose n-grams add
    up (a word at a cut may be seen from both sides)."""
    at, part, size = [], [], 0
    for i, t in enumerate(texts):
        for begin in range(0, max(1, len(t)), CHUNK):
            piece = t[begin : begin + CHUNK]
            if size + len(piece) > CHUNK and part:
                yield at, part
                at, part, size = [], [], 0
            at.append(i)
            part.append(piece)
            size += len(piece)
    if part:
        yield at, part


@dataclass
class LanguageFilter:
    """`slots`: one mask a slot (and a further row of masks for each 64 languages); `fill`: share of slots that have
    a language's bit."""

    languages: list[str]
    slots: np.ndarray
    fill: np.ndarray
    default: str = NO_LANGUAGE

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        out = None
        for at in _slots(hashes, self.slots.shape[1]):
            out = self.slots[:, at] if out is None else out & self.slots[:, at]
        return out

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected share of each language for each text, number of n-grams of each text)."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at, part in chunks(texts):
            h, index = grams(part)
            to = np.array(at)[index]
            total += np.bincount(to, minlength=len(texts))
            masks = self.masks(h)
            for k in range(len(self.languages)):
                bit = (masks[k // 64] >> self.slots.dtype.type(k % 64)) & self.slots.dtype.type(1)
                hits[:, k] += np.bincount(to, weights=bit, minlength=len(texts))
        wrong = self.fill**HASHES
        share = hits / np.maximum(total, 1)[:, None]
        return np.clip((share - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1), total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, corrected share) of each text; ties go to the first language in order. A text with letters
        whose n-grams are all unknown gets the language with the most rows learned from, with score 0."""
        share, total = self.shares([t or "" for t in texts])
        if not self.languages:
            return [NO_LANGUAGE] * len(texts), np.zeros(len(texts))
        best = share.argmax(axis=1)
        score = share[np.arange(len(texts)), best]
        names = [NO_LANGUAGE if n == 0 else self.languages[b] if s > 0 else self.default for b, s, n in zip(best, score, total)]
        return names, np.where(total > 0, score, 0.0)


def _slots(hashes: np.ndarray, m: int) -> Iterator[np.ndarray]:
    for mix in _MIX[:HASHES]:
        h = (hashes ^ (hashes >> np.uint64(31))) * mix
        yield (h >> np.uint64(40)).astype(np.int64) & (m - 1)


def learn(docs: DataFrame, text: Column, lang: Column, train: Column, train_rows: int = TRAIN_ROWS) -> LanguageFilter:
    """Fit on the rows where `train` holds and the language isn't null: about `train_rows` of each language, chosen
    by a hash of the text. The n-gram counts are summed by Spark; the slots, at most MOST_SLOTS, come to the driver."""
    rows = docs.select(text.alias("text"), lang.cast("string").alias("lang")).where(train & lang.isNotNull() & text.isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return LanguageFilter([], np.zeros((1, 16), np.uint8), np.zeros(0))
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, int(min(1.0, train_rows / n) * (1 << 20))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            for name, group in batch.groupby("lang"):
                for _, part in chunks(list(group["text"])):
                    h, n = np.unique(grams(part)[0], return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": h.view(np.int64), "n": n})

    counts = written(chosen.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    rate = F.lit(0.0)
    for name in names:
        rate = F.when(F.col("lang") == name, F.col("n") / F.lit(float(totals[name]))).otherwise(rate)
    rated = counts.withColumn("rate", rate).where(F.col("n") >= LEAST_COUNT)
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = rated.join(top.hint("merge"), "gram").where(F.col("rate") >= LEAST_RATE * F.col("top")).select("lang", "gram")
    number = {name: k for k, name in enumerate(names)}
    n_grams = kept.select("gram").distinct().count()
    m = min(MOST_SLOTS, 1 << max(10, math.ceil(math.log2(max(1, n_grams) * HASHES * 2))))
    kind = next((t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(names) <= np.dtype(t).itemsize * 8), np.uint64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k = batch["lang"].map(number).to_numpy()
            for at in _slots(batch["gram"].to_numpy(np.int64).view(np.uint64), m):
                yield pd.DataFrame({"word": k // 64, "slot": at, "mask": (np.uint64(1) << (k % 64).astype(np.uint64)).view(np.int64)})

    slots = np.zeros((max(1, -(-len(names) // 64)), m), kind)
    placed = kept.mapInPandas(place, "word long, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    for r in placed.toLocalIterator():
        slots[r.word, r.slot] = kind(r.mask & 0xFFFFFFFFFFFFFFFF)
    fill = np.array([((slots[k // 64] >> kind(k % 64)) & kind(1)).mean() for k in range(len(names))])
    return LanguageFilter(names, slots, fill, max(sizes, key=lambda n: (sizes[n], n)))


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: (id_col, lang_pred, score) for the whole text, however long; 'und' and 0 where the text is null
    or has no letter, or nothing was learned. Repeated rows get the same answer each; null ids pass through; other
    columns aren't looked at; no rows give no rows. The filter is broadcast: its size is bounded by MOST_SLOTS."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            names, score = held.value.predict(list(batch["text"]))
            yield pd.DataFrame({"id": batch["id"], "lang_pred": names, "score": score})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
