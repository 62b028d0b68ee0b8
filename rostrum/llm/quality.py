"""Quality scores by Bradley-Terry ranking of preference pairs.

A document of label 1 is preferred to one of label 0. The strength of a document is linear in its features, and the
probability of a preference is the logistic function of the difference in strength, so the loss needs feature
differences only. The threshold is a quantile of the learned strengths: as many learning rows lie below it as have
label 0. The score puts that threshold at CUT and is logistic in the strength.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.shared import pieces

#: Most labelled rows learned from (about), opponents drawn for each row of the rarer label, the threshold's score.
TRAIN_ROWS, OPPONENTS, CUT = 20_000, 20, 0.3
CHUNK = 1 << 21

#: What the features measure; shares are of the characters, words or lines of the text.
FEATURES = (
    "log_chars", "upper", "digit", "space", "newline", "stop", "bar", "sign", "other", "wide",
    "word_length", "words_new", "sign_words", "caps_words", "lines_new", "line_words", "short_words", "empty",
)

_CLASS: list[np.ndarray] = []
_UPPER, _DIGIT, _SPACE, _NEWLINE, _STOP, _BAR, _SIGN, _LETTER, _OTHER = range(9)


def _classes() -> np.ndarray:
    if not _CLASS:
        table = np.full(0x110000, _OTHER, np.uint8)
        for c in range(0x3000):
            s = chr(c)
            if s.isupper():
                table[c] = _UPPER
            elif s.isalpha():
                table[c] = _LETTER
            elif s.isdigit():
                table[c] = _DIGIT
            elif s == "\n":
                table[c] = _NEWLINE
            elif s.isspace():
                table[c] = _SPACE
            elif s in ".,;:'\"-?()":
                table[c] = _STOP
            elif s == "|":
                table[c] = _BAR
            elif c < 128:
                table[c] = _SIGN
        table[0x3040:0xD800] = _LETTER
        _CLASS.append(table)
    return _CLASS[0]


def features(texts: list[str]) -> np.ndarray:
    """One row a text, in the order of FEATURES; the empty text has zeros and `empty` 1. Counts of characters are
    taken over a text in parts, so memory stays bounded by the text itself."""
    out = np.zeros((len(texts), len(FEATURES)))
    table = _classes()
    for i, text in enumerate(texts):
        if not text:
            out[i, -1] = 1
            continue
        n = len(text)
        chars, wide = np.zeros(9), 0
        for at in range(0, n, CHUNK):
            codes = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
            chars += np.bincount(table[codes], minlength=9)
            wide += int((codes > 127).sum())
        words, lines = text.split(), [x for x in text.split("\n") if x]
        w = max(1, len(words))
        out[i] = (
            math.log(n), chars[_UPPER] / n, chars[_DIGIT] / n, chars[_SPACE] / n, chars[_NEWLINE] / n, chars[_STOP] / n, chars[_BAR] / n, chars[_SIGN] / n, chars[_OTHER] / n, wide / n,
            math.log1p(n / w), len(set(words)) / w, sum(not x[-1].isalnum() and x[-1] not in ".,;:'\"-?()|" for x in words) / w, sum(map(str.isupper, words)) / w,
            len(set(lines)) / max(1, len(lines)), math.log1p(w / max(1, len(lines))), sum(len(x) <= 3 for x in words) / w, 0,
        )
    return out


@dataclass
class Ranking:
    """Strength = weights . (features - mean) / spread; the score is logistic with `threshold` at CUT."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float = 1.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        strength = np.clip((features([t or "" for t in texts]) - self.mean) / self.spread, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (strength - self.threshold) + math.log(CUT / (1 - CUT)), -60, 60)))


def fit(x: np.ndarray, label: np.ndarray, opponents: int = OPPONENTS, ridge: float = 1e-3, seed: int = 7) -> Ranking:
    """Newton steps on the mean logistic loss over pairs (a row of label 1 over a row of label 0), each row of the
    rarer label against `opponents` of the other. Without pairs all weights are 0 and every score is CUT or above."""
    mean, spread = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    spread = np.where(spread > 1e-9, spread, 1.0)
    z, w = np.clip((x - mean) / spread, -8, 8), np.zeros(len(FEATURES))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranking(mean, spread, w, 0.0)
    draw = np.random.default_rng(seed)
    n = opponents * min(len(good), len(bad))
    wins = np.resize(good, n) if len(good) <= len(bad) else draw.choice(good, n)
    loses = np.resize(bad, n) if len(bad) < len(good) else draw.choice(bad, n)
    d = z[wins] - z[loses]
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))  # what the loss still has to learn of each pair
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w)), d.T @ p / n - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ w
    # the quantile that as many rows lie below as have label 0, in the middle between its neighbours
    ordered = np.sort(strength)
    return Ranking(mean, spread, w, float(ordered[len(bad) - 1 : len(bad) + 1].mean()))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train: Column | None = None, train_rows: int = TRAIN_ROWS) -> Ranking:
    """Fit on about `train_rows` labelled documents, chosen by a hash of the id; `train` (over the ids) restricts the
    rows that labels may be learned from. Ids labelled more than once take their smallest label, ids with more than one
    text their smallest; null labels and ids don't count. The features of the chosen rows, a bounded number, come to
    the driver."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    if train is not None:
        known = known.where(train)
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, train_rows / max(1, n)) * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))  # one row an id, however often it repeats

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "x": list(features(list(batch["text"])))})

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    got = rows.mapInPandas(measured, f"id {kind}, label int, x array<double>").toPandas().sort_values("id", kind="stable")
    return fit(np.array(got["x"].tolist()).reshape(-1, len(FEATURES)), got["label"].to_numpy())


def score(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: (id_col, score, predicted): predicted is 1 from CUT on. A null text counts as the empty one,
    which is scored like any other; very long texts are read whole; repeated rows and ties get the same score each;
    null ids pass through; further columns are ignored; no rows give no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            s = held.value.scores(list(batch["text"]))
            yield pd.DataFrame({"id": batch["id"], "score": s, "predicted": (s >= CUT).astype(np.int32)})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Ranking, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores CUT or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(list(texts)) >= CUT)

    return docs.where(good(F.col(text_col)))
