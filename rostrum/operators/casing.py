"""Shouted titles in title case: forms learned from other texts or given, and a walk over each title's words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators.shared import BROADCAST_BYTES, written

# Words that stay in lower case between the ends of a title.
MINOR_WORDS = (*T.MINOR_WORDS, "but", "nor", "via", "vs")
#: Forms that titles in capitals only can't teach; they win over learned ones.
GIVEN_FORMS = {"3D": "3D", "AI": "AI", "CPU": "CPU", "DNA": "DNA", "EU": "EU", "GPS": "GPS", "GPU": "GPU", "IOT": "IoT", "LED": "LED", "MRNA": "mRNA", "PHD": "PhD", "RNA": "RNA", "UK": "UK", "USA": "USA", "UV": "UV", "WIFI": "WiFi"}
_ROMAN = r"^m{0,4}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})$"
_LETTERS, _PARTS, _OWNED, _NUMERAL = re.compile("[A-Za-z]+"), re.compile("[A-Za-z]+|[^A-Za-z]+"), re.compile("'S"), re.compile(_ROMAN[:-1] + r"\Z")
#: Texts whose words are counted at once, words whose forms a task remembers, bytes of a form in a task.
BATCH_TEXTS, KNOWN_WORDS, _FORM_BYTES = 2000, 300_000, 64
_EDGES = r"^[.,;:!?()\[\]{}\"']+|[.,;:!?()\[\]{}\"']+$"


def learned_forms(texts: DataFrame, text: str, given: Mapping[str, str] = GIVEN_FORMS) -> DataFrame:
    """(upper, form): the most frequent form of each upper-cased word (ties: the smallest), where it has a capital other than just
    a first one, and the `given` forms instead of learned ones.

    Words of two signs or more with a letter count, without punctuation at their ends. Shouted texts teach nothing, null and
    empty ones neither. Counts have partial results: no word's rows meet in one task."""
    calm = texts.where(~T.is_shouting(F.col(text))).select(F.col(text).alias("_word")).where(F.col("_word").isNotNull())
    # each word is looked at once for all its places in a batch of texts
    seen = calm.mapInArrow(_word_counts, "_word string, _n long").select(F.regexp_replace("_word", _EDGES, "").alias("form"), "_n")
    words = seen.where((F.length("form") >= 2) & F.col("form").rlike(r"\p{L}"))
    counts = words.groupBy(F.upper("form").alias("upper"), "form").agg(F.sum("_n").alias("n"))
    best = counts.groupBy("upper").agg(F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("form"))
    plain = F.concat(F.upper(F.substring("form", 1, 1)), F.lower(F.substr("form", F.lit(2))))
    learned = best.where((F.col("form") != F.lower("form")) & (F.col("form") != plain))
    if not given:
        return learned
    fixed = texts.sparkSession.createDataFrame([(k.upper(), v) for k, v in given.items()], "upper string, form string")
    return learned.where(~F.col("upper").isin(*[k.upper() for k in given])).unionByName(fixed)


def _split(texts: pa.Array) -> pa.Array:
    """The words of each text, as Java's white space parts them."""
    return pc.split_pattern_regex(texts, "[ \\t\\n\\x0b\\f\\r]+")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the texts of each batch, or of a few, and how often they occur."""
    for batch in batches:
        for s in range(0, batch.num_rows, BATCH_TEXTS):
            counts = pc.value_counts(pc.list_flatten(_split(batch.column(0).slice(s, BATCH_TEXTS))))
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["_word", "_n"])


def form_keys(word: Column) -> Column:
    """What to look up for a word: itself and its runs of letters A-Z in upper case, and those without a last S.

    Runs are taken before upper case, which joins them where a letter becomes two (`SSß` has the run SS, not SSSS)."""
    keys = F.concat(F.array(F.upper(word)), F.transform(F.regexp_extract_all(word, F.lit("([A-Za-z]+)")), F.upper))
    singular = F.transform(F.filter(keys, lambda k: k.endswith("S")), lambda k: F.substr(k, F.lit(1), F.length(k) - 1))
    return F.filter(F.array_distinct(F.concat(keys, singular)), lambda k: k != "")


def _known(word: Column, forms: Column) -> Column:
    up = F.upper(word)
    plural = F.when(up.endswith("S"), F.concat(F.try_element_at(forms, F.substr(up, F.lit(1), F.length(up) - 1)), F.lit("s")))
    return F.coalesce(F.try_element_at(forms, up), plural)


def recased_word(word: Column, forms: Column, minor: Sequence[str] = MINOR_WORDS) -> Column:
    """Struct (known, plain) of a word in capitals; `forms` is a map from its `form_keys` to their forms (or null).

    `known` is the form of the whole word, also as a plural. `plain` leaves a roman numeral; else each run of letters A-Z counts on
    its own: by `forms`, a minor word behind the first run is lower, others get one capital; a possessive ends in a small s."""
    letters = F.lower(F.regexp_replace(word, "[^A-Za-z]", ""))
    first = F.when(word.rlike("^[A-Za-z]"), 0).otherwise(1)
    capital = lambda x: F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.lower(F.substr(x, F.lit(2))))
    run = lambda x, j: F.coalesce(_known(x, forms), F.when((j != first) & F.lower(x).isin(*minor), F.lower(x)), capital(x))
    parts = F.regexp_extract_all(word, F.lit("([A-Za-z]+|[^A-Za-z]+)"))
    runs = F.array_join(F.transform(parts, lambda x, j: F.when(x.rlike("^[A-Za-z]"), run(x, j)).otherwise(x)), "")
    numeral = F.when((F.length(letters) >= 2) & letters.rlike(_ROMAN), F.upper(word))
    return F.struct(_known(word, forms).alias("known"), F.coalesce(numeral, F.regexp_replace(runs, r"'S\b", "'s")).alias("plain"))


def _begun(word: Column) -> Column:
    """With a capital as its first letter."""
    at = F.length(F.regexp_extract(word, r"^(\P{L}*)", 1)) + 1
    return F.concat(F.substr(word, F.lit(1), at - 1), F.upper(F.substr(word, at, F.lit(1))), F.substr(word, at + 1))


def _recased(word: str, forms: Mapping[str, str], minor: frozenset[str]) -> tuple[str, str, str, str]:
    """A word as recase_titles has it at an end and inside of a title, then both where it begins with a capital; as recased_word."""

    def known(w: str) -> str | None:
        up = w.upper()
        found = forms.get(up)
        return found if found is not None or not up.endswith("S") or (one := forms.get(up[:-1])) is None else one + "s"

    core = word.rstrip(".,;:!?)")
    if core.isascii() and core.isalpha():  # most words
        low, up = core.lower(), core.upper()
        if low not in minor and (len(up) < 2 or up.strip("MDCLXVI")) and not any(x in forms for x in (up, up[:-1], up + word[len(core) :])):
            capital = up[0] + low[1:] + word[len(core) :]
            return capital, capital, capital, capital
    letters = "".join(_LETTERS.findall(word)).lower()
    plain = known(word)
    inner = plain if plain is not None else word.lower() if letters in minor else None
    if plain is None:
        if len(letters) >= 2 and _NUMERAL.match(letters):
            plain = word.upper()
        else:
            parts = _PARTS.findall(word)
            first = 0 if _LETTERS.match(word) else 1
            for j, x in enumerate(parts):
                if _LETTERS.match(x):
                    form = known(x)
                    parts[j] = form if form is not None else x.lower() if j != first and x.lower() in minor else x[:1].upper() + x[1:].lower()
            plain = "".join(parts)
            if "'S" in plain:
                plain = _OWNED.sub(lambda m: m[0] if _goes_on(plain[m.end() : m.end() + 1]) else "'s", plain)
    inner = plain if inner is None else inner

    def begun(x: str) -> str:
        at = next((k for k, c in enumerate(x) if c.isalpha()), len(x))
        return x[:at] + x[at : at + 1].upper() + x[at + 1 :]

    return plain, inner, begun(plain), begun(inner)


def _goes_on(sign: str) -> bool:
    """Whether Java's word boundary isn't before the sign, behind a letter."""
    return sign == "_" or sign.isalpha() or sign.isdecimal() or sign != "" and unicodedata.category(sign) == "Mn"


def _recase_batches(batches: Iterator[pa.RecordBatch], title: str, forms: Mapping[str, str], minor: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is the squeezed title, or null where the title stays: without it, titles recased."""
    known: dict[str, tuple[str, str, str, str]] = {}
    for batch in batches:
        asked = batch.column(batch.num_columns - 1)
        some = pc.drop_null(asked)
        out = batch.drop_columns([batch.schema.names[-1]])
        if len(some):
            lists = pc.split_pattern(some, " ")
            begin = np.asarray(lists.offsets)
            coded = pc.list_flatten(lists).dictionary_encode()
            words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            if len(known) > KNOWN_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = _recased(w, forms, minor)
            ways = pa.concat_arrays([pa.array(way, pa.string()) for way in zip(*map(known.__getitem__, words))])
            colon = pc.ends_with(coded.dictionary, ":").to_numpy(zero_copy_only=False)[codes]
            begin = begin - begin[0]
            begins, inner = np.concatenate([[True], colon[:-1]]), np.ones(len(codes), bool)
            begins[begin[:-1]] = True
            inner[begin[:-1]] = inner[begin[1:] - 1] = False
            put = ways.take(pa.array(codes + len(words) * (inner + 2 * begins.astype(np.int64))))
            done = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), put), " ")
            at = out.schema.get_field_index(title)
            out = out.set_column(at, out.schema.field(at), pc.replace_with_mask(out.column(at), asked.is_valid(), done))
        yield out


def recase_titles(titles: DataFrame, ids: Sequence[str], title: str, forms: DataFrame, minor: Sequence[str] = MINOR_WORDS) -> DataFrame:
    """`titles` with the shouted ones (`is_shouting`) in title case, white space squeezed; other rows and columns stay.

    Words go by `recased_word`, minor words between the ends are lower where `forms` (upper, form) has none for them, and the first
    word and one behind a colon begin with a capital. `ids` name a row; null and empty titles stay, and so do rows with a null id.

    Forms that fit a broadcast go to the tasks, and each recases the distinct words of a batch of titles. With more forms, each distinct word of
    all titles is recased once, then joined to its places, so a word of most titles is one key whose long side adaptive execution splits."""
    forms = written(forms.select("upper", "form"), "forms")
    if forms.limit(BROADCAST_BYTES // _FORM_BYTES + 1).count() * _FORM_BYTES <= BROADCAST_BYTES:
        own = {r.upper: r.form for r in forms.where("upper != '' AND form IS NOT NULL").collect()}
        whole = reduce(Column.__and__, [F.col(i).isNotNull() for i in ids], T.is_shouting(F.col(title)))
        return titles.withColumn("_squeezed", F.when(whole, T.squeezed(F.col(title)))).mapInArrow(partial(_recase_batches, title=title, forms=own, minor=frozenset(minor)), titles.schema)
    return _recase_by_joins(titles, ids, title, forms, minor)


def _recase_by_joins(titles: DataFrame, ids: Sequence[str], title: str, forms: DataFrame, minor: Sequence[str]) -> DataFrame:
    """recase_titles with any number of forms."""
    words = F.split(T.squeezed(F.col(title)), " ")
    behind = F.zip_with(words, F.concat(F.array(F.lit(":")), words), lambda w, before: F.struct(w.alias("w"), before.endswith(":").alias("begins")))
    places = F.zip_with(behind, F.slice(words, 2, F.size(words)), lambda p, after: F.struct(p["w"].alias("w"), p["begins"].alias("begins"), after.isNull().alias("last")))
    asked = titles.where(T.is_shouting(F.col(title)))
    placed = asked.select(*ids, F.posexplode(places).alias("_i", "_p")).where("_p.w IS NOT NULL")
    tokens = placed.select(*ids, "_i", F.col("_p.w").alias("_w"), F.col("_p.begins").alias("_begins"), ((F.col("_i") > 0) & ~F.col("_p.last")).alias("_inner"))
    distinct = asked.select(F.explode(words).alias("_w")).distinct()
    known = forms.select(F.col("upper").alias("_upper"), F.col("form").alias("_form")).hint("merge")
    found = distinct.select("_w", F.explode(form_keys(F.col("_w"))).alias("_upper")).join(known, "_upper").groupBy("_w").agg(F.map_from_entries(F.collect_list(F.struct("_upper", "_form"))).alias("_forms"))
    recased = distinct.join(found.hint("merge"), "_w", "left").select("_w", recased_word(F.col("_w"), F.col("_forms"), minor).alias("_r"))
    letters = F.lower(F.regexp_replace("_w", "[^A-Za-z]", ""))
    word = F.coalesce(F.col("_r.known"), F.when(F.col("_inner") & letters.isin(*minor), F.lower("_w")), F.col("_r.plain"))
    each = tokens.join(recased.hint("merge"), "_w").select(*ids, "_i", word.alias("_x"), "_begins")
    ordered = F.array_sort(F.collect_list(F.struct("_i", F.when(F.col("_begins"), _begun(F.col("_x"))).otherwise(F.col("_x")).alias("x"))))
    done = each.groupBy(*ids).agg(F.array_join(F.transform(ordered, lambda x: x["x"]), " ").alias("_title"))
    return titles.join(done.hint("merge"), list(ids), "left").withColumn(title, F.coalesce("_title", title)).select(titles.columns)
