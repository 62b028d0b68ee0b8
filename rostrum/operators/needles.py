"""Many needles in many texts: literal needles by one automaton, patterns only where their literal part occurs.

The rules of a part (up to MOST_BYTES of needles) are broadcast as one joined string and its lengths; each Python worker
builds an Aho-Corasick automaton of them once and runs it over Arrow batches of distinct texts, so a text is read once
whatever the number of needles. For patterns the automaton looks for a literal that every match must contain; what passes is
tested in generated code, each pattern as a literal that is compiled once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of needles and labels that one automaton holds; more rules take further passes over the texts.
MOST_BYTES = 32 << 20
#: Patterns of one part; each is a branch of a generated expression.
MOST_PATTERNS = 400
_SPECIAL = set("\\^$.|?*+()[]{}")
_BUILT: dict[str, object] = {}


def required_literal(pattern: str) -> str:
    """A literal that each match of a pattern contains, as long as can be told from its plain signs; else ''.

    Groups, classes and escapes end a literal, a quantifier takes the sign before it away; a pattern with alternatives
    outside groups, or with flags, has none."""
    runs, run, depth, i = [], "", 0, 0
    if "(?" in pattern.replace("(?:", "") or "\\Q" in pattern:
        return ""
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            plain = i + 1 < len(pattern) and not pattern[i + 1].isalnum()
            if depth == 0:
                if plain:
                    run += pattern[i + 1]
                else:
                    runs, run = [*runs, run], ""
            i += 2
            continue
        if c == "[":
            end = i + 2 if pattern[i + 1 : i + 2] != "^" else i + 3
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            if "[" in pattern[i + 1 : end] or "&&" in pattern[i:end]:
                return ""  # nested classes
            if depth == 0:
                runs, run = [*runs, run], ""
            i = end + 1
            continue
        if c == "|" and depth == 0:
            return ""
        if c in "()":
            depth += 1 if c == "(" else -1
            if depth <= 1:
                runs, run = [*runs, run], ""
        elif depth == 0 and c in "?*{":
            runs, run = [*runs, run[:-1]], ""
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return ""
        elif depth == 0 and c in _SPECIAL:
            runs, run = [*runs, run], ""
        elif depth == 0:
            run += c
        i += 1
    return max([*runs, run], key=len) if depth == 0 else ""


def _automaton(key: str, text: str, lengths: np.ndarray):
    """The automaton over the needles that stand end to end in `text`; a needle's value is the ranks that have it."""
    if key not in _BUILT:
        import ahocorasick

        made, at = ahocorasick.Automaton(), 0
        for rank, n in enumerate(lengths.tolist()):
            needle = text[at : at + n]
            at += n
            if needle:
                made.add_word(needle, (*made.get(needle, ()), rank))
        made.make_automaton()
        _BUILT.clear()
        _BUILT[key] = made
    return _BUILT[key]


def first_hits(texts: DataFrame, text: str, rules: list[tuple[str, bool]]) -> DataFrame:
    """(text, rank) of each text (distinct): the place in `rules` of the first rule that hits it, or null.

    A rule is (needle, is_regex): a substring, case counts, or a Java pattern found anywhere in the text. An empty needle is in
    every text. Null texts are left out."""
    spark = texts.sparkSession
    literal = [required_literal(n) if regex else n for n, regex in rules]
    always = [k for k, (n, regex) in enumerate(rules) if not regex and n == ""]
    packed = spark.sparkContext.broadcast(("".join(literal), np.array([len(n) for n in literal], np.int32), np.array([regex for _, regex in rules], bool)))
    key, none = uuid.uuid4().hex, len(rules)
    first_always = min(always, default=none)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        joined, lengths, regex = packed.value
        made = _automaton(key, joined, lengths)
        for batch in batches:
            best, tries = [], []
            for value in batch["text"]:
                hits = {r for _, ranks in made.iter(value) for r in ranks} if len(made) else set()
                best.append(min([first_always, *(r for r in hits if not regex[r])]))
                tries.append(sorted(r for r in hits if regex[r] and r < best[-1]))
            yield pd.DataFrame({"text": batch["text"], "best": best, "tries": tries})

    seen = texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInPandas(scan, "text string, best int, tries array<int>")
    patterns = [(k, n) for k, (n, regex) in enumerate(rules) if regex]
    tested = [F.when((F.array_contains("tries", k) if literal[k] else F.col("best") > k) & F.col("text").rlike(n), F.lit(k)) for k, n in patterns]
    rank = F.least(F.col("best"), *tested) if tested else F.col("best")
    return seen.select(F.col("text").alias(text), F.when(rank < none, rank).alias("rank"))
