"""Secret scan with structural confirmation.

Patterns find the base spans. Runs of base64 or hexadecimal text are candidates only: they are decoded and must parse
as a private key (nested DER lengths that fill the bytes exactly, or the OpenSSH container with its length-prefixed
fields), or as a signed token whose header and body are JSON objects, before a span is added. Candidates may be broken into
lines: by line ends or their escapes (`\\n`), behind quote marks, with header lines inside an armour; the parts are joined
before they are decoded, and the span covers the whole run. Encrypted tokens of five parts are told by their header.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.shared import pieces

#: In the order in which spans with the same start are listed. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "token", "pem", "der", "ssh")

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run is matched whole, so the length can stand in the pattern
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]+)\.(ey[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)")
_SEALED = re.compile(r"(?<![A-Za-z0-9_.-])(ey[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)(?![A-Za-z0-9_.-])")
_BEGIN = re.compile(r"-----BEGIN ([A-Z ]{0,20}PRIVATE KEY)-----")
#: An end of line, real or escaped, with what quoting and string literals put around it.
_BREAK = r"""[ \t"'+,]{0,8}(?:\r?\n|(?:\\r)?\\n)[ \t>|#"'+]{0,40}"""
_BREAKS = re.compile(_BREAK)
_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{40,}}(?:{_BREAK}[A-Za-z0-9+/_-]+={{0,2}})+")
_HEXLINES = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{32,}}(?:{_BREAK}[0-9A-Fa-f]+)+")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_HEXKEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill `data` exactly, or None if a length is malformed or runs over."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data) or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_private_der(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (also encrypted) or SEC1 private key: one sequence over all bytes with the right members."""
    outer = der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    members = der_items(outer[0][1])
    if not members:
        return False
    tags = [t for t, _ in members]
    if tags[0] == 0x02 and members[0][1] in (b"\x00", b"\x01"):
        if len(tags) >= 9 and set(tags[:9]) == {0x02}:
            return True
        if tags[1:3] == [0x30, 0x04]:
            return bool((oid := der_items(members[1][1])) and oid[0][0] == 0x06)
        return members[0][1] == b"\x01" and len(tags) > 2 and tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1}
    if tags == [0x30, 0x04]:  # encrypted: algorithm with parameters, then the bytes
        return bool((oid := der_items(members[0][1])) and len(oid) == 2 and [t for t, _ in oid] == [0x06, 0x30])
    return False


def is_private_ssh(data: bytes) -> bool:
    """The OpenSSH private container: cipher, derivation, options, key count, public keys, private part."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False

    def field(at: int) -> int | None:
        if at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if end <= len(data) else None

    at: int | None = len(magic)
    for _ in range(3):
        if (at := field(at)) is None:
            return False
    if at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return False
    for _ in range(keys + 1):
        if (at := field(at)) is None:
            return False
    return at == len(data)


def _decoded(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(text: str) -> dict | None:
    try:
        found = json.loads(_decoded(text) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def key_kind(data: bytes | None) -> str | None:
    if data and is_private_der(data):
        return "der"
    return "ssh" if data and is_private_ssh(data) else None


def _armoured(body: str) -> bool:
    """Is this what stands between the lines of an armour: base64 of a key, or header lines and an encrypted one?"""
    plain, heads = [], {}
    for line in re.split(r"\r?\n|(?:\\r)?\\n", body):
        line = line.strip(" \t>|#\"'+,")
        name, colon, value = line.partition(":")
        if colon:
            heads[name.strip()] = value.strip()
        elif line:
            plain.append(line)
    data = _decoded("".join(plain)) if plain else None
    if data is None:
        return False
    if "ENCRYPTED" in heads.get("Proc-Type", ""):
        cipher, _, salt = heads.get("DEK-Info", "").partition(",")
        return bool(re.fullmatch("[A-Z0-9-]+", cipher)) and bool(re.fullmatch("(?:[0-9A-Fa-f]{16}){1,2}", salt.strip())) and len(data) % 8 == 0 and len(data) > 0
    return key_kind(data) is not None


def _armours(text: str) -> Iterator[tuple[int, int]]:
    """Spans of armoured keys; each BEGIN is searched up to the next one, so the text is read once."""
    begins = list(_BEGIN.finditer(text))
    for m, limit in zip(begins, [*[n.start() for n in begins[1:]], len(text)]):
        foot = f"-----END {m[1]}-----"
        at = text.find(foot, m.end(), limit)
        if at >= 0 and _armoured(text[m.end() : at]):
            yield m.start(), at + len(foot)


def _wrapped(text: str, pattern: re.Pattern, decode: Callable[[str], bytes | None]) -> Iterator[tuple[str, int, int]]:
    """Keys broken into lines: lines as long as the first one, then at most one shorter."""
    for m in pattern.finditer(text):
        lines, at = [], m.start()
        for gap in _BREAKS.finditer(text, m.start(), m.end()):
            lines.append((at, gap.start()))
            at = gap.end()
        lines.append((at, m.end()))
        size = [b - a for a, b in lines]
        n = next((k for k, x in enumerate(size) if x != size[0]), len(size))
        for k in (n + 1, n) if n < len(size) and size[n] < size[0] else (n,):
            if k > 1 and (kind := key_kind(decode("".join(text[a:b] for a, b in lines[:k])))):
                yield kind, lines[0][0], lines[k - 1][1]
                break


def _unhexed(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then in the order of KINDS."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    sealed = []
    if "ey" in text:
        for m in _SEALED.finditer(text):
            head = _object(m[1])
            if head and isinstance(head.get("alg"), str) and isinstance(head.get("enc"), str) and all(_decoded(p) is not None for p in m.groups()[1:]):
                sealed.append((m.start(), m.end()))
                out.append(("token", m.start(), m.end()))
    inside = lambda at, spans: any(a <= at < b for a, b in spans)
    if ".ey" in text:
        for m in _SIGNED.finditer(text):
            head = _object(m[1])
            if head and isinstance(head.get("alg"), str) and _object(m[2]) is not None and (m[3] or head["alg"] == "none") and not inside(m.start(), sealed):
                out.append(("token", m.start(), m.end()))
    keys = list(_armours(text)) if "-----BEGIN " in text else []
    out += [("pem", a, b) for a, b in keys]
    for pattern, decode in ((_LINES, _decoded), (_HEXLINES, _unhexed)):
        for kind, a, b in _wrapped(text, pattern, decode):
            if not inside(a, keys):
                keys.append((a, b))
                out.append((kind, a, b))
    for pattern, decode in ((_BASE64, _decoded), (_HEXKEY, _unhexed)):
        for m in pattern.finditer(text):
            if not inside(m.start(), keys) and (kind := key_kind(decode(m[0]))):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: (id_col, spans array<struct<kind,start,end>>), over whole texts.

    Null and empty texts have no spans; very long texts are scanned whole, a megabyte of shorter ones at a time;
    repeated rows get the same spans each; ids of any value, null included, pass through; other columns are ignored;
    no rows give no rows. Nothing is shuffled."""
    kind = docs.select(id_col).schema[0].dataType

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in secret_spans(t or "")] for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "spans": spans})

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(scan, f"id {kind.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")
    return found.withColumnRenamed("id", id_col)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
