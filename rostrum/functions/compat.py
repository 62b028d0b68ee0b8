"""Compatibility forms of texts (full-width, ligature, circled and raised signs as plain ones) and the matching form built on them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that count as a hyphen, and as an apostrophe.
DASHES = "‐‑‒–—―−"
APOSTROPHES = "‘’‛ʼ´`"
# Misspellings by the word that is meant. Only whole words count, so that foreign words stay.
MISSPELLED = {
    "university": ("niversity", "uniwersity", "univeristy", "univerce", "univerisity", "universitity", "universitry", "universiy", "universityy", "universty", "univrsity"),
    "technology": ("techcnology", "techenology", "technogy", "technolog", "technologygy", "thechnology"),
    "institute": ("institite", "institue", "insttute", "insitute", "intitute"),
    "laboratory": ("laborator", "labortory", "labratory"),
    "national": ("naitional", "natioal"),
    "research": ("reasearch",),
    "metropolitan": ("metropokitan",),
    "polytechnic": ("polytechinic",),
    "politecnico": ("politechnico",),
    "universitat": ("universitaet",),
    "los angeles": ("los angles",),
}


def _arrow(one: Callable[[str], str]) -> Callable[[Column], Column]:
    """`one` over a column in Arrow batches; only texts with a sign beyond ASCII leave the JVM."""

    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    apply.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return lambda c: F.pandas_udf(apply, "string")(F.when(c.rlike(r"[^\x00-\x7F]"), c))


def _bare(x: str) -> str:
    low = unicodedata.normalize("NFKC", x).lower()
    return unicodedata.normalize("NFC", "".join(s for s in unicodedata.normalize("NFD", low) if not unicodedata.combining(s)))


def nfkc(c: Column) -> Column:
    """Compatibility decomposition and canonical composition. Null stays null, ASCII texts stay as they are."""
    return F.coalesce(_arrow(lambda x: unicodedata.normalize("NFKC", x))(c), c)


def bare(c: Column) -> Column:
    """NFKC in lower case without any combining marks, composed again."""
    return F.coalesce(_arrow(_bare)(c), F.lower(c))


def spelling_rules(misspelled: Mapping[str, Sequence[str]] = MISSPELLED) -> list[tuple[str, str]]:
    """Ordered (pattern, replacement): words run together, misspelled words, `univ.`, the comma before a campus."""
    words = [(rf"(?U)\b(?:{'|'.join(wrong)})\b", right) for right, wrong in misspelled.items()]
    return [(r"(?U)\buniversity?of\b", "university of"), *words, (r"(?U)\buniv\.", "university"), (r"(?U)\b(indian institute of technology|iit),", "$1")]


def matching_form(c: Column, rules: Sequence[tuple[str, str]] | None = None) -> Column:
    """The form in which labels are matched: `bare`, dashes and apostrophes as ASCII ones, `rules` in order (by default
    `spelling_rules`), white space squeezed. Null stays null, an empty text empty."""
    out = F.translate(bare(c), DASHES + APOSTROPHES, "-" * len(DASHES) + "'" * len(APOSTROPHES))
    for pattern, replacement in spelling_rules() if rules is None else rules:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
