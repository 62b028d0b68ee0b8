"""Markup as columns: entities, tokens, and runs of text by the role of the tags around them. No row leaves the JVM."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that begin or end a block: what is open inside a block ends with it.
BLOCKS = ("address", "article", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul")
_NAMED = {name: html.unescape(f"&{name};") for name in [*name2codepoint, "apos"]}


def _sign(code: Column) -> Column:
    """The sign of a code point; null where there is none."""
    fine = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decoded(c: Column) -> Column:
    """Named entities of HTML 4 and numeric ones, decimal or hexadecimal, as signs, each once; what is no entity stays."""
    named = F.create_map(*[F.lit(x) for pair in sorted(_NAMED.items()) for x in pair])

    def piece(p: Column, i: Column) -> Column:
        name = F.regexp_extract(p, "^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        rest = F.substr(p, F.length(name) + 2)
        number = F.when(name.rlike("^#[0-9]"), F.substr(name, F.lit(2)).cast("long")).when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10).cast("long"))
        sign = F.when(number.isNotNull(), _sign(number)).when(name != "", F.try_element_at(named, name))
        return F.when(i == 0, p).otherwise(F.coalesce(F.concat(sign, rest), F.concat(F.lit("&"), p)))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "&"), piece), "")).otherwise(c)


def tokens(c: Column) -> Column:
    """Array of structs (tag, closes, text): tags by their lower-case name, and the text between them (tag null).

    Comments, scripts and styles are left out, and so is a last tag that never ends."""
    plain = F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*$", "")
    found = F.regexp_extract_all(plain, F.lit(r"(<[^<>]*>|[^<]+)"))
    tag = lambda t: F.lower(F.regexp_extract(t, r"^</?\s*([A-Za-z][A-Za-z0-9]*)", 1))
    is_tag = lambda t: F.startswith(t, F.lit("<"))
    return F.transform(found, lambda t: F.struct(F.when(is_tag(t), tag(t)).alias("tag"), F.startswith(t, F.lit("</")).alias("closes"), F.when(~is_tag(t), t).alias("text")))


def runs(c: Column, roles: Mapping[str, str], breaks: Sequence[str] = (), blocks: Sequence[str] = BLOCKS) -> Column:
    """Array of structs (role, text, block): runs of text in order, as one fold over the tokens.

    A run's role is that of the innermost open tag in `roles`, else null. A closing tag closes the tags that were opened behind its
    own, one that was never opened closes nothing. A block's beginning or end closes all, also tags that are never closed;
    tags of `breaks` end a run but close nothing. Text is decoded, white space squeezed, and blank runs are left out; `block`
    counts the block boundaries before the run."""
    names = list(roles)
    kind = "array<struct<role:string,text:string,block:int>>"
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("block"), F.lit(True).alias("fresh"), F.array().cast(kind).alias("out"))
    state = lambda open, block, fresh, out: F.struct(open.cast("array<string>").alias("open"), block.alias("block"), fresh.alias("fresh"), out.cast(kind).alias("out"))  # noqa: E731, A002

    def role(open_tags: Column) -> Column:
        out = F.lit(None).cast("string")
        last = F.try_element_at(open_tags, F.lit(-1))
        for t, r in roles.items():
            out = F.when(last == t, F.lit(r)).otherwise(out)
        return out

    def step(s: Column, t: Column) -> Column:
        own, seen = role(s["open"]), F.array_position(F.reverse(s["open"]), t["tag"])
        before = F.try_element_at(s["out"], F.lit(-1))
        more = ~s["fresh"] & before["role"].eqNullSafe(own)
        added = F.struct(own.alias("role"), t["text"].alias("text"), s["block"].alias("block"))
        longer = F.struct(own.alias("role"), F.concat(before["text"], t["text"]).alias("text"), s["block"].alias("block"))
        grown = F.when(more, F.concat(F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(longer))).otherwise(F.array_append(s["out"], added))
        text = state(s["open"], s["block"], F.lit(False), grown)
        block = state(F.array(), s["block"] + 1, F.lit(True), s["out"])
        opened = state(F.array_append(s["open"], t["tag"]), s["block"], s["fresh"], s["out"])
        closed = state(F.when(seen > 0, F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - seen.cast("int"), F.lit(0)))).otherwise(s["open"]), s["block"], s["fresh"], s["out"])
        broken = state(s["open"], s["block"], F.lit(True), s["out"])
        return F.when(t["tag"].isNull(), text).when(t["tag"].isin(*blocks), block).when(t["tag"].isin(*breaks), broken).when(~t["tag"].isin(*names), s).when(t["closes"], closed).otherwise(opened)

    found = F.aggregate(tokens(c), start, step, lambda s: s["out"])
    clean = lambda x: F.trim(F.regexp_replace(decoded(x), r"[\s ]+", " "))
    whole = F.transform(found, lambda r: F.struct(r["role"].alias("role"), clean(r["text"]).alias("text"), r["block"].alias("block")))
    return F.filter(whole, lambda r: r["text"] != "")


def records(found: Column, first: str = "name", fields: Sequence[str] = ("affiliation", "title"), rest: str = "affiliation") -> Column:
    """Array of structs of runs: one begins at each run of role `first`, and takes the first run of each of `fields` up to the
    next; runs without a role count as `rest`. Runs before the first record are left out."""
    kind = ",".join(f"{n}:string" for n in (first, *fields))
    none = F.array().cast(f"array<struct<{kind}>>")

    def step(out: Column, r: Column) -> Column:
        role = F.coalesce(r["role"], F.lit(rest))
        last = F.try_element_at(out, F.lit(-1))
        fresh = F.struct(r["text"].alias(first), *[F.lit(None).cast("string").alias(n) for n in fields])
        grown = F.struct(last[first].alias(first), *[F.coalesce(last[n], F.when(role == n, r["text"])).alias(n) for n in fields])
        return F.when(role == first, F.array_append(out, fresh)).when(F.size(out) == 0, out).otherwise(F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).cast(f"array<struct<{kind}>>")

    return F.aggregate(found, none, step)
