"""Text functions over columns: folding, normal forms, titles, names, addresses and markup. All are built-in
expressions, so they stay inside generated code and need no shuffle."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that have no decomposition, and what they are searched as.
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "đ": "d", "ð": "d", "ł": "l"}
# Name particles that belong to the surname.
PARTICLES = ("da", "de", "del", "der", "di", "du", "la", "le", "van", "von")
# Words that stay in lower case inside a title.
MINOR_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def _bases() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks with marks, and the letters without them, by decomposition."""
    pairs = {}
    for code in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(base) > 1 and base[0].isascii() and all(unicodedata.combining(m) for m in base[1:]):
            pairs[c] = base[0]
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _bases()


def unmarked(c: Column) -> Column:
    """Lower case without diacritics; letters of LETTERS stay."""
    return F.translate(F.regexp_replace(F.lower(c), "[̀-ͯ]", ""), _MARKED, _PLAIN)


def unmarked_cased(c: Column) -> Column:
    """Without diacritics, the case kept."""
    pairs = [(m.upper(), p.upper()) for m, p in zip(_MARKED, _PLAIN) if len(m.upper()) == 1]
    return F.translate(F.regexp_replace(c, "[̀-ͯ]", ""), _MARKED + "".join(m for m, _ in pairs), _PLAIN + "".join(p for _, p in pairs))


def fold(c: Column) -> Column:
    """The form in which texts are searched: lower case, no diacritics, plain Latin letters. Null stays null."""
    out = unmarked(c)
    for letter, plain in LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def squeezed(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal_form(c: Column, fixes: Sequence[tuple[str, str]] = ()) -> Column:
    """The form in which labels are matched: folded, dashes and quotes unified, `fixes` applied in order, blanks squeezed."""
    # ASCII texts have nothing to fold but their case; translating letter by letter costs most of the time
    out = F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(fold(c), "‐‑‒–—‘’“” ", "-----''\"\" "))
    for pattern, replacement in fixes:
        out = F.regexp_replace(out, pattern, replacement)
    return squeezed(out)


def clean_title(c: Column) -> Column:
    """Entities decoded, zero-width signs gone, blanks squeezed, `9um` as `9μm`, no trailing bracket of its own and no
    single trailing period (an ellipsis stays)."""
    out = decoded(c)
    out = F.regexp_replace(out, "[​‌‍﻿]", "")
    out = squeezed(F.replace(out, F.lit(" "), F.lit(" ")))
    out = F.regexp_replace(out, r"([0-9]) ?um\b", "$1μm")
    out = F.regexp_replace(out, r"\s*[\[(]$", "")
    return F.regexp_replace(out, r"([^.])\.$", "$1")


def decoded(c: Column) -> Column:
    """The five markup entities and the hard blank as signs, `&amp;` last."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def is_shouting(c: Column, least: int = 3, share: float = 0.8) -> Column:
    """At least `least` ASCII letters, of which `share` or more are capitals."""
    letters, capitals = F.length(F.regexp_replace(c, "[^A-Za-z]", "")), F.length(F.regexp_replace(c, "[^A-Z]", ""))
    return F.coalesce((letters >= least) & (capitals >= letters * share), F.lit(False))


def tidy_location(c: Column) -> Column:
    """Blanks squeezed, doubled parentheses single, a stray closing one dropped from the end."""
    out = F.regexp_replace(F.regexp_replace(squeezed(c), r"\(\(+", "("), r"\)\)+", ")")
    stray = F.length(F.replace(out, F.lit("("), F.lit(""))) > F.length(F.replace(out, F.lit(")"), F.lit("")))
    return F.rtrim(F.when(stray, F.regexp_replace(out, r"\)$", "")).otherwise(out))


def compact_location(c: Column, places: Mapping[str, str]) -> Column:
    """The first of `places` found in the text, as its abbreviation, followed by the room number if there is one."""
    short = F.lit(None).cast("string")
    for name, abbreviation in reversed([*places.items()]):
        short = F.when(F.contains(F.lower(c), F.lit(name.lower())), abbreviation).otherwise(short)
    room = F.nullif(F.regexp_extract(c, r"(?i)(?:room|level|#)\s*([0-9]+[A-Za-z]?)", 1), F.lit(""))
    return F.when(short.isNull(), c).otherwise(F.concat_ws(" ", short, room))


# What may follow a comma without being a given name.
SUFFIXES = ("bsc", "esq", "ii", "iii", "iv", "jr", "md", "msc", "phd", "sr", "v")
INSTITUTION_WORDS = r"(?i)\b(?:universit|universidad|institut|istituto|college|laborato|department|dept|cent(?:er|re)\b|academy|[ée]cole|polite[ck]ni|gmbh|ltd|inc\b)"


def _capital(c: Column) -> Column:
    """A lower-case piece with a capital at its beginning, and behind `O'`."""
    plain = F.concat(F.upper(c.substr(1, 1)), c.substr(F.lit(2), F.length(c)))
    return F.when(c.rlike("^o['’]."), F.concat(F.lit("O"), c.substr(2, 1), F.upper(c.substr(3, 1)), c.substr(F.lit(4), F.length(c)))).otherwise(plain)


def _capital_piece(p: Column, inner: Column) -> Column:
    """A piece of A-Z only, repaired; by byte comparisons, without a pattern."""
    particle = inner & (F.length(p) <= max(map(len, PARTICLES))) & p.isin(*[x.upper() for x in PARTICLES])
    vowel = reduce(Column.__or__, [F.contains(p, F.lit(v)) for v in "EAIOUY"])
    return F.when(particle, F.lower(p)).when((F.length(p) >= 3) & vowel, F.concat(F.substring(p, 1, 1), F.lower(p.substr(F.lit(2), F.length(p))))).otherwise(p)


def _any_piece(p: Column, inner: Column) -> Column:
    """A piece of any letters, repaired."""
    capital = F.array_join(F.transform(F.split(F.lower(p), "-"), _capital), "-")
    shouted = p.rlike(r"^[\p{Lu}\p{Mn}'’.-]{3,}$") & ~p.rlike(r"^(?:\p{Lu}\.-?)+$") & unmarked(p).rlike("[aeiouyæøœ]")
    return F.when(inner & F.lower(p).isin(*PARTICLES), F.lower(p)).when(shouted, capital).otherwise(p)


def repaired_name(c: Column) -> Column:
    """A person's name whose pieces are all capitals (of any alphabet) gets capitals at the beginnings only; particles between the ends
    go lower, initials stay, and so do names of over six pieces or with digits."""

    def joined(pieces: Column, piece: Callable[[Column, Column], Column]) -> Column:
        return F.array_join(F.transform(pieces, lambda p, i: piece(p, (i > 0) & (i < F.size(pieces) - 1))), " ")

    def any_name(pieces: Column) -> Column:
        return F.when((F.size(pieces) > 6) | c.rlike("[0-9]"), c).otherwise(joined(pieces, _any_piece))

    # the pieces are bound once: a lambda that names the split would split again for each piece; names of A-Z and single blanks, most of
    # the shouted ones, need no pattern for a piece
    once = lambda pieces, f: F.get(F.transform(F.array(pieces), f), 0)
    return F.when(c.rlike(r"^[A-Z]+(?: [A-Z]+){0,5}\z"), once(F.split(c, " "), lambda x: joined(x, _capital_piece))).otherwise(once(F.split(squeezed(c), " "), any_name))


def given_first(c: Column) -> Column:
    """`Surname, Given` as `Given Surname` where each side is one piece; everything else stays, and so do suffixes
    (`Smith, Jr.`) and institutions behind the comma, and what has a second comma."""
    given = F.lower(F.regexp_replace(F.regexp_extract(c, r",\s+(\S+)$", 1), r"\.", ""))
    plain = c.rlike(r"^[^\s,]+,\s+[^\s,]+$") & ~given.isin(*SUFFIXES) & ~c.rlike(rf",\s+.*{INSTITUTION_WORDS}".replace("(?i)", "(?:(?i)", 1) + ")")
    return F.when(plain, F.regexp_replace(c, r"^(\S+),\s+(\S+)$", "$2 $1")).otherwise(c)


def surname_initial(c: Column) -> Column:
    """Folded `surname|initial` of a name in natural order: the key that sources are matched by."""
    name = squeezed(fold(given_first(c)))
    return F.concat_ws("|", F.element_at(F.split(name, " "), -1), F.substring(name, 1, 1))


def initial_surname(c: Column) -> Column:
    """Lower-case `initial surname` with diacritics kept: the key inside one record."""
    name = squeezed(F.lower(given_first(c)))
    return F.concat_ws(" ", F.substring(name, 1, 1), F.element_at(F.split(name, " "), -1))


def person(c: Column) -> Column:
    """Struct (surname, given array): the last piece with a letter, and the pieces before, split at blanks, dots and
    hyphens, all folded."""
    name = squeezed(fold(F.when(F.contains(c, F.lit(",")), F.regexp_replace(c, r"^([^,]+),\s*(.+)$", "$2 $1")).otherwise(c)))
    pieces = F.filter(F.split(name, " "), lambda p: p.rlike("[a-z]"))

    def parts(pieces: Column) -> Column:
        given = F.filter(F.split(F.array_join(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), " "), r"[ .-]+"), lambda p: p != "")
        return F.struct(F.coalesce(F.try_element_at(pieces, F.lit(-1)), F.lit("")).alias("surname"), given.alias("given"))

    return F.get(F.transform(F.array(pieces), parts), 0)  # the folded pieces are computed once, however often they are used


def consistent_given(a: Column, b: Column) -> Column:
    """Given names agree where both have one: equal, or one is the initial of the other. No given name agrees with all."""
    n = F.least(F.size(a), F.size(b))
    agree = lambda x, y: (x == y) | ((F.length(x) == 1) & F.startswith(y, x)) | ((F.length(y) == 1) & F.startswith(x, y))
    return F.forall(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), agree), lambda x: x)


def abbreviated(c: Column) -> Column:
    """Given names as initials; particles and what follows belong to the surname."""
    pieces = F.split(squeezed(c), " ")
    n = F.size(pieces)
    first = F.coalesce(F.array_position(F.transform(pieces, lambda p: F.lower(p).isin(*PARTICLES)), True), F.lit(0)).cast("int")
    cut = F.when((first > 1) & (first < n), first).otherwise(n)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i + 1 < cut, F.concat(F.substring(p, 1, 1), F.lit("."))).otherwise(p)), " ")


def title_key(c: Column) -> Column:
    return squeezed(F.lower(c))


def alnum_key(c: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def split_outside(c: Column, separator: str = ";") -> Column:
    """Parts between separators that don't stand in (unnested) parentheses."""
    guarded = F.regexp_replace(c, rf"{separator}(?=[^()]*\))", "\u0001")
    return F.transform(F.split(guarded, separator), lambda p: F.trim(F.replace(p, F.lit("\u0001"), F.lit(separator))))


def name_and_place(c: Column) -> Column:
    """`name (place)` as a struct; place is null without parentheses."""
    return F.struct(F.trim(F.regexp_replace(c, r"\s*\(.*$", "")).alias("name"), F.nullif(F.regexp_extract(c, r"\((.*)\)", 1), F.lit("")).alias("place"))


def numbered_names(c: Column) -> Column:
    """`Name=1,2; Other=3` as an array of (name, insts)."""
    parts = F.filter(F.split(c, ";"), lambda p: F.trim(p) != "")
    numbers = lambda p: F.transform(F.filter(F.split(F.regexp_extract(p, "=(.*)$", 1), ","), lambda n: F.trim(n).rlike("^[0-9]+$")), lambda n: F.trim(n).cast("int"))
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_replace(p, "=.*$", "")).alias("name"), numbers(p).alias("insts")))


def without_known(aliases: Column, names: Column) -> Column:
    """Aliases that aren't among the names (case and blanks don't count), the first of equal ones only."""
    key = lambda x: F.replace(F.lower(x), F.lit(" "), F.lit(""))
    known = F.transform(names, key)
    keys = F.transform(aliases, key)
    return F.filter(aliases, lambda a, i: ~F.array_contains(known, key(a)) & (F.array_position(keys, key(a)) == i + 1))


def names_then_institutions(c: Column, keywords: str = "(?i)univ|instit|college|lab") -> Column:
    """Struct (names, institutions) of `name, name, inst, inst (Country)`: institutions begin at the first part with a
    keyword or a parenthesis; without one all parts are names."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    at = F.array_position(F.transform(parts, lambda p: p.rlike(keywords) | F.contains(p, F.lit("("))), True)
    n = F.when(at > 0, at - 1).otherwise(F.size(parts)).cast("int")
    return F.struct(F.slice(parts, 1, n).alias("names"), F.slice(parts, n + 1, F.size(parts)).alias("institutions"))


def first_timestamp(c: Column, formats: Sequence[str]) -> Column:
    """The first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def clock_minutes(c: Column) -> Column:
    """Minutes after midnight of `9:05 PM`; null where it isn't such a time."""
    h, m = F.regexp_extract(c, r"^([0-9]{1,2}):([0-9]{2})", 1), F.regexp_extract(c, r"^([0-9]{1,2}):([0-9]{2})", 2)
    late = F.upper(c).rlike("PM$")
    minutes = F.pmod(F.nullif(h, F.lit("")).cast("int"), F.lit(12)) * 60 + F.nullif(m, F.lit("")).cast("int")
    return F.when(late, minutes + 720).otherwise(minutes)


def leading_code(c: Column) -> Column:
    """Struct (code, rest) of `AB12.3 Title`; code is null where there is none, also where it is glued to the title."""
    code = F.nullif(F.regexp_extract(c, r"^([A-Z]{1,4}[0-9]+(?:\.[0-9]+)?)", 1), F.lit(""))
    return F.struct(code.alias("code"), F.when(code.isNull(), c).otherwise(F.regexp_replace(c, r"^[A-Z]{1,4}[0-9]+(?:\.[0-9]+)?[\s:.-]*", "")).alias("rest"))


def status_markers(c: Column, markers: Sequence[str]) -> Column:
    """Struct (markers found in order, text without them): a marker stands in brackets or parentheses."""
    found = F.array_compact(F.array(*[F.when(c.rlike(rf"(?i)[\[(]{m}[\])]"), m) for m in markers]))
    return F.struct(found.alias("markers"), squeezed(F.regexp_replace(c, rf"(?i)[\[(](?:{'|'.join(markers)})[\])]", "")).alias("text"))


def html_text(c: Column) -> Column:
    """Markup as text: scripts, styles and comments dropped, block ends and <br> as line ends, tags gone, entities decoded."""
    out = F.regexp_replace(c, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"<br\s*/?>|</(?:p|div|h[1-6]|li|tr)>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "<[^>]*>", ""), r"[ \t]+", " ")
    return F.trim(decoded(F.regexp_replace(out, r"\s*\n\s*", "\n")))


def html_main(c: Column) -> Column:
    """The inside of the first <article>, or the whole markup."""
    inside = F.regexp_extract(c, r"(?s)<article>(.*?)</article>", 1)
    return F.when(inside == "", c).otherwise(inside)


def polished_label(c: Column) -> Column:
    """Trailing parentheses and acronyms go, legal forms at the end go (up to three), `U` becomes `University`."""
    out = F.regexp_replace(squeezed(c), r"\s*\([^()]*\)$", "")
    for _ in range(3):
        out = F.regexp_replace(out, r"(?i),?\s+(?:inc|ltd|llc|gmbh|corp|co|ag|sa)\.?$", "")
    out = F.regexp_replace(out, r"\bU\b\.?", "University")
    return F.regexp_replace(out, r"\s+-\s+[A-Z]{2,6}$", "")


def short_address(c: Column, departments: str = "(?i)^(?:dept|department|school|faculty|institute of)\\b") -> Column:
    """The first comma part that is no department; digits-only tails don't count."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike("^[0-9 -]+$"))
    return F.coalesce(F.try_element_at(F.filter(parts, lambda p: ~p.rlike(departments)), F.lit(1)), F.try_element_at(parts, F.lit(1)), F.trim(c))


def heuristic_short(c: Column, mapped: Column, keywords: str = "(?i)univ|instit|college|lab") -> Column:
    """The mapped label, else the first comma part with a keyword, else the first part."""
    parts = F.transform(F.split(c, ","), lambda p: F.trim(p))
    return F.coalesce(mapped, F.try_element_at(F.filter(parts, lambda p: p.rlike(keywords)), F.lit(1)), F.element_at(parts, 1))


def cleaned_affiliation(c: Column, keywords: str = "(?i)univ|instit|college|lab") -> Column:
    """Parts that begin with a digit go; the first institution-like part, else the longest (the first of equals)."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike("^[0-9]"))
    longest = F.array_max(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("i"), p.alias("p"))))["p"]
    return F.coalesce(F.try_element_at(F.filter(parts, lambda p: p.rlike(keywords)), F.lit(1)), longest)


def author_list(c: Column) -> Column:
    """`name, aff / name, aff` as an array of (name, aff); aff is null without a comma."""
    parts = F.filter(F.transform(F.split(c, "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, "^([^,]*)", 1)).alias("name"), F.nullif(F.trim(F.regexp_extract(p, "^[^,]*,(.*)$", 1)), F.lit("")).alias("aff")))


def cell_from_right(c: Column) -> Column:
    """Struct (title, speaker, aff): the last comma begins the affiliation, the last period before a capital the speaker."""
    head = F.regexp_replace(c, r",[^,]*$", "")
    return F.struct(
        F.when(head.rlike(r"\. [A-Z]"), F.regexp_extract(head, r"^(.*)\. [A-Z][^.]*", 1)).otherwise(head).alias("title"),
        F.nullif(F.regexp_extract(head, r"^.*\. ([A-Z].*)$", 1), F.lit("")).alias("speaker"),
        F.nullif(F.trim(F.regexp_extract(c, r",([^,]*)$", 1)), F.lit("")).alias("aff"),
    )


def looks_like_name(c: Column, most: int = 6) -> Column:
    """No prose or address: up to `most` pieces, no digits, no sentence end, no address word."""
    return (F.size(F.split(squeezed(c), " ")) <= most) & ~c.rlike(r"[0-9;]|[.!?] |(?i)\b(?:university|department|street)\b")


def title_and_venue(c: Column, words: str = "(?i)room|hall|center|auditorium") -> Column:
    """Struct (title, venue): a last parenthesis with a venue word, else what follows the first comma outside
    parentheses if it has one."""
    inside = F.regexp_extract(c, r"\(([^()]*)\)\s*$", 1)
    after = F.regexp_extract(c, r"^(?:[^,()]|\([^()]*\))*,(.*)$", 1)
    return (
        F.when((inside != "") & inside.rlike(words), F.struct(F.trim(F.regexp_replace(c, r"\([^()]*\)\s*$", "")).alias("title"), F.trim(inside).alias("venue")))
        .when((after != "") & after.rlike(words), F.struct(F.trim(F.regexp_extract(c, r"^((?:[^,()]|\([^()]*\))*),", 1)).alias("title"), F.trim(after).alias("venue")))
        .otherwise(F.struct(c.alias("title"), F.lit(None).cast("string").alias("venue")))
    )


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.]) +")


def without_sentences(c: Column, pattern: str) -> Column:
    """The text without the sentences that match."""
    return F.array_join(F.filter(sentences(c), lambda s: ~s.rlike(pattern)), " ")


def prose(c: Column, pattern: str) -> Column:
    """Lines kept, each without the sentences that match; lines left empty go."""
    kept = F.transform(F.split(c, "\n"), lambda p: without_sentences(p, pattern))
    return F.array_join(F.filter(kept, lambda p: p != ""), "\n")


def recased(word: Column, known: Column) -> Column:
    """A shouted word in title case, or as `known` says."""
    return F.coalesce(known, F.when(F.lower(word).isin(*MINOR_WORDS), F.lower(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.length(word))))))


def numbered_body(c: Column) -> Column:
    """Struct (number, body) of `12. body`; the number is null where there is none (or none that fits), the body then the whole text."""
    number = F.regexp_extract(c, r"^\s*([0-9]{1,9})\.\s+\S", 1)
    return F.struct(F.nullif(number, F.lit("")).cast("int").alias("number"), F.when(number == "", F.trim(c)).otherwise(F.trim(F.regexp_replace(c, r"^\s*[0-9]{1,9}\.\s+", ""))).alias("body"))


# Words that end the name of a venue, and places that say nothing.
VENUE_WORDS = ("Atrium", "Auditorium", "Ballroom", "Beach", "Center", "Centre", "Courtyard", "Deck", "Foyer", "Garden", "Hall", "Lawn", "Lobby", "Lounge", "Patio", "Pavilion", "Plaza", "Pool", "Room", "Suite", "Terrace", "Theater", "Theatre", "Veranda")
NO_PLACES = ("location to be announced", "tba", "tbd")


def agenda_cell(c: Column, code: str = "[A-Z][A-Za-z0-9.-]*", no_places: Sequence[str] = NO_PLACES) -> Column:
    """Struct (code, name, location) of `code • name, location`; code and location are null where there is none. The location is
    behind the first comma, without stray commas; one of `no_places` is none."""
    text = squeezed(c)
    rest = F.regexp_replace(text, rf"^{code} ?• ?(?=.)", "")
    place = F.regexp_replace(F.regexp_extract(rest, "^[^,]*,(.*)$", 1), "^[ ,]+|[ ,]+$", "")
    return F.struct(
        F.nullif(F.regexp_extract(text, rf"^({code}) ?• ?.", 1), F.lit("")).alias("code"),
        F.trim(F.regexp_extract(rest, "^([^,]*)", 1)).alias("name"),
        F.when((place != "") & ~F.lower(place).isin(*no_places), place).alias("location"),
    )


def venue_and_prose(c: Column, words: Sequence[str] = VENUE_WORDS) -> Column:
    """Struct (venue, prose) of a blurb: the first `in the …` or `at the …` whose capitalised words end in a venue word (null where
    there is none), and its paragraphs without the sentences that tell a clock time; paragraphs left empty go."""
    venue = F.regexp_extract(c, rf"\b(?:in|at)\s+the\s+((?:[A-Z][\w.&'’-]*\s+)*?(?:{'|'.join(words)}))\b", 1)
    timeless = lambda p: squeezed(F.array_join(F.filter(F.split(p, r"(?<=[.!?])\s+"), lambda s: ~s.rlike("[0-9]{1,2}:[0-9]{2}")), " "))
    paragraphs = F.filter(F.transform(F.split(c, "\n\n"), timeless), lambda p: p != "")
    return F.struct(F.nullif(squeezed(venue), F.lit("")).alias("venue"), F.array_join(paragraphs, "\n\n").alias("prose"))
