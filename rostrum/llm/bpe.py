"""Byte-level BPE as a streaming transducer with bounded lookahead.

Merging is local: a change at the end of the input can only undo tokens a bounded distance to its left, and that
distance follows from the merge list. Merges apply by rank, so for the boundary between settled and open tokens to
move left twice, the second merge must have a higher rank and its right part must begin with the left part of the
first. The longest such chain, in bytes, is the sufficient lookahead: a token that ends that far before the end of
the bytes seen stays the same whatever follows. The transducer keeps that many bytes, emits what is stable and drops
it. (Streaming tokenisation of this kind is described by Berglund and van der Merwe, "Formalizing BPE Tokenization".)

A text is one stream: its pre-tokens, cut by the tokenizer's pattern, go through the transducer one after the other,
and the end of a pre-token settles what is open. What the transducer said for a pre-token is remembered in a table of
bounded size, for most come again. Decoding feeds token bytes to an incremental UTF-8 decoder.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.shared import pieces

#: Bytes fed to the transducer at once, pre-tokens looked up and characters cut at once.
PIECE, BLOCK, WINDOW = 1 << 12, 1 << 16, 1 << 18
#: Pre-tokens that a task remembers, and bytes of the longest one that it remembers.
KNOWN, KNOWN_BYTES = 300_000, 64

#: The published pattern of byte-level BPE: contractions, words, numbers, other signs, white space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The published map of byte-level BPE: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The merge list and vocabulary of a byte-level BPE tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        vocab = model["vocab"]
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.bytes_of = {i: as_bytes(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.of_byte = [vocab.get(c) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.parts = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): (r, ab) for r, (a, b, ab) in reversed(list(enumerate(self.parts)))}
        self.size = max(self.bytes_of) + 1
        self.lookahead = self._lookahead()

    def flat_bytes(self) -> Flat:
        return Flat.of([self.bytes_of.get(i, b"") for i in range(self.size)])

    def _lookahead(self) -> int:
        """Bytes that a change at the end of the input can reach back; see the module's text."""
        left: dict[int, int] = {}
        for a, _, ab in self.parts:
            left.setdefault(ab, a)

        def beginnings(token: int) -> Iterator[int]:
            while token is not None:
                yield token
                token = left.get(token)

        reach: dict[int, int] = {}  # by token: the longest chain of later merges whose right part begins with it
        longest = 0
        for a, b, _ in reversed(self.parts):
            chain = len(self.bytes_of[a]) + reach.get(a, 0)
            longest = max(longest, chain)
            for t in beginnings(b):
                if reach.get(t, 0) < chain:
                    reach[t] = chain
        return longest

    def merge(self, data: bytes) -> list[int]:
        """The tokens of `data` taken as a whole: the lowest rank first, from the left."""
        ids = list(map(self.of_byte.__getitem__, data))
        rank = self.rank
        if len(ids) <= 32:
            none = (1 << 32, 0)
            pairs = [rank.get(p, none) for p in zip(ids, ids[1:])]
            while pairs and (best := min(pairs)) is not none:
                i, new = pairs.index(best), best[1]
                ids[i] = new
                del ids[i + 1], pairs[i]
                if i < len(pairs):
                    pairs[i] = rank.get((new, ids[i + 1]), none)
                if i:
                    pairs[i - 1] = rank.get((ids[i - 1], new), none)
            return ids
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        gone = [False] * len(ids)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if not gone[i] else len(ids)
            if j >= len(ids) or (found := rank.get((ids[i], ids[j]))) is None or found[0] != r:
                continue
            ids[i], gone[j], after[i] = found[1], True, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if (p := rank.get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (p[0], i))
            if before[i] >= 0 and (p := rank.get((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(heap, (p[0], before[i]))
        return [t for t, g in zip(ids, gone) if not g]


class Flat:
    """Byte strings or id lists in one array; gather() concatenates the chosen ones."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values, self.lengths, self.n, self.used = values, lengths.astype(np.int64), len(lengths), len(values)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @classmethod
    def of(cls, parts: list[bytes]) -> Flat:
        return cls(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]))

    def append(self, values: np.ndarray, lengths: np.ndarray) -> None:
        n, used = self.n + len(lengths), self.used + len(values)
        if n > len(self.lengths):
            self.lengths, self.starts = (np.r_[x[: self.n], np.zeros(2 * n - self.n, np.int64)] for x in (self.lengths, self.starts))
        if used > len(self.values):
            self.values = np.r_[self.values[: self.used], np.zeros(2 * used - self.used, self.values.dtype)]
        self.lengths[self.n : n], self.starts[self.n : n] = lengths, self.used + np.cumsum(lengths) - lengths
        self.values[self.used : used] = values
        self.n, self.used = n, used

    def gather(self, at: np.ndarray) -> np.ndarray:
        lengths = self.lengths[at]
        before = np.cumsum(lengths) - lengths
        return self.values[np.repeat(self.starts[at] - before, lengths) + np.arange(int(lengths.sum()))]


class Transducer:
    """Bytes of a text in, stable token ids out; it never holds more than PIECE plus the lookahead."""

    def __init__(self, merges: Merges):
        self.merges, self.open = merges, b""

    def push(self, data: bytes) -> list[int]:
        self.open += data
        stable = len(self.open) - self.merges.lookahead
        if stable <= 0:
            return []
        out, end = [], 0
        for token in self.merges.merge(self.open):
            if (to := end + len(self.merges.bytes_of[token])) > stable:
                break
            out.append(token)
            end = to
        self.open = self.open[end:]
        return out

    def finish(self) -> list[int]:
        """The end of a pre-token: nothing that follows can change what is open."""
        rest, self.open = self.merges.merge(self.open), b""
        return rest

    def pretoken(self, data: bytes) -> list[int]:
        out = []
        for at in range(0, len(data), PIECE):
            out += self.push(data[at : at + PIECE])
        return out + self.finish()


def narrow_pattern() -> re.Pattern:
    """The pattern for texts below U+0100, with its classes written out: the standard library is faster there."""
    low = "".join(map(chr, range(256)))
    letters, digits, space = ("".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(rf"{c}+", low)) for c in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+")


class Tokenizer:
    """Streams of token ids from texts. `known` numbers the pre-tokens remembered, `ids` has their tokens; both are
    emptied when full."""

    _joint = re.compile(r"(?<=\S) (?=\S)")
    _wide = re.compile(r"[^\x00-\xff]")

    def __init__(self, merges: Merges):
        self.merges, self.stream = merges, Transducer(merges)
        self.general, self.narrow = regex.compile(_PATTERN), narrow_pattern()
        self.special = re.compile("|".join(re.escape(s) for s in sorted(merges.special, key=len, reverse=True))) if merges.special else None
        self._forget()

    def _forget(self) -> None:
        self.known = {s: k for k, s in enumerate(self.merges.special)}
        self.ids = Flat(np.array([*self.merges.special.values()], np.int32), np.ones(len(self.known), np.int64))

    def _learn(self, words: set[str]) -> None:
        """Send each of `words` through the transducer and remember what it says."""
        found = [self.stream.pretoken(w.encode()) for w in words]
        self.ids.append(np.array([*itertools.chain.from_iterable(found)], np.int32), np.array([len(f) for f in found], np.int64))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))

    def _cut(self, text: str) -> Iterator[str]:
        """Parts of about WINDOW characters; a cut goes before a blank that stands between other signs, where a
        pre-token always begins."""
        at = 0
        while at < len(text):
            joint = self._joint.search(text, at + WINDOW) if at + WINDOW < len(text) else None
            yield text[at : joint.start()] if joint else text[at:]
            at = joint.start() if joint else len(text)

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of `text`, special tokens among them, in lists of bounded length."""
        at = 0
        if self.special and any(s in text for s in self.merges.special):
            for m in self.special.finditer(text):
                for part in self._cut(text[at : m.start()]):
                    yield from self._pretokens(part)
                yield [m[0]]
                at = m.end()
        for part in self._cut(text[at:] if at else text):  # each side of a special token is a text of its own
            yield from self._pretokens(part)

    def _pretokens(self, part: str) -> Iterator[list[str]]:
        pattern = self.general if self._wide.search(part) else self.narrow
        if len(part) <= 2 * WINDOW:
            yield pattern.findall(part)
        else:  # a long part without a joint
            found = (m[0] for m in pattern.finditer(part))
            while some := [*itertools.islice(found, BLOCK)]:
                yield some

    def blocks(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(index of the text, ids): blocks of bounded length, the texts in order."""
        held, size = [], 0
        for i, text in enumerate(texts):
            for words in self._parts(text):
                held.append((i, words))
                size += len(words)
                if size >= BLOCK:
                    yield from self._looked_up(held)
                    held, size = [], 0
        yield from self._looked_up(held)

    def _looked_up(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray]]:
        words = list(itertools.chain.from_iterable(w for _, w in held))
        found = list(map(self.known.get, words))
        missing = {w for w, f in zip(words, found) if f is None} if None in found else set()
        if missing and len(self.known) + len(missing) > KNOWN:
            self._forget()
            missing = set(words).difference(self.known)
        if missing:
            self._learn({w for w in missing if len(w) <= KNOWN_BYTES})
            mark = self.ids.n, self.ids.used
            self._learn({w for w in missing if len(w) > KNOWN_BYTES})
            found = list(map(self.known.__getitem__, words))
        at, numbers = 0, np.array(found, np.int64)
        for i, own in held:
            yield i, self.ids.gather(numbers[at : at + len(own)])
            at += len(own)
        if missing:  # long pre-tokens aren't remembered
            for w in missing:
                if len(w) > KNOWN_BYTES:
                    del self.known[w]
            self.ids.n, self.ids.used = mark


class Decoder:
    """Token ids in, text out; a byte sequence may go on from one block to the next."""

    def __init__(self, token_bytes: Flat):
        self.bytes, self.state = token_bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: np.ndarray) -> str:
        return self.state.decode(self.bytes.gather(ids).tobytes())

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


#: What encode() can return besides the number of tokens.
OUTPUTS = {"ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """One row per row: (id_col, n_tokens, and each of `outputs`). `tokenizer`: path of a tokenizer file, read by the
    driver and broadcast (its size is fixed).

    A null text counts as empty: no tokens, digests of the empty text. Special tokens in a text become their ids, as
    the file says. Repeated rows and ties are encoded each; ids, null included, pass through; further columns are
    ignored; no rows give no rows. Digests are fed block by block, and rows leave after about a megabyte of text, so
    a text of any length needs only its own memory. Nothing is shuffled."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokenizer(Merges(spec.value))
        token_bytes, decimals = tok.merges.flat_bytes(), Flat.of([f",{i}".encode() for i in range(tok.merges.size)])

        def group(texts: list[str]) -> list[dict]:
            rows = [{"n_tokens": 0, "ids": [], "ids_hash": hashlib.sha256(), "decoded": [], "text_hash": hashlib.sha256(), "decoder": Decoder(token_bytes)} for _ in texts]

            def said(row: dict, part: str) -> None:
                if "decoded" in outputs:
                    row["decoded"].append(part)
                if "decoded_sha256" in outputs:
                    row["text_hash"].update(part.encode())

            for i, ids in tok.blocks(texts):
                row = rows[i]
                if "ids" in outputs:
                    row["ids"].append(ids.astype(np.int32))
                if "ids_sha256" in outputs and len(ids):
                    row["ids_hash"].update(decimals.gather(ids)[0 if row["n_tokens"] else 1 :])
                row["n_tokens"] += len(ids)
                if {"decoded", "decoded_sha256"} & {*outputs}:
                    said(row, row["decoder"].push(ids))
            for row in rows:
                said(row, row["decoder"].finish())
                row |= {"ids_sha256": row["ids_hash"].hexdigest(), "decoded_sha256": row["text_hash"].hexdigest()}
                row |= {"ids": np.concatenate(row["ids"]) if row["ids"] else np.zeros(0, np.int32), "decoded": "".join(row["decoded"])}
            return [{k: row[k] for k in ("n_tokens", *outputs)} for row in rows]

        for batch in pieces(batches):
            texts = [t or "" for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"].to_numpy()} | dict(pd.DataFrame(group(texts), columns=["n_tokens", *outputs])))

    schema = f"id {kind}, n_tokens long, " + ", ".join(f"{k} {OUTPUTS[k]}" for k in outputs)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema.rstrip(", ")).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: (id_col, text) of an array of token ids; a null array gives a null text, broken byte
    sequences give the replacement character."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())
    kind = encoded.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token_bytes = Merges(spec.value).flat_bytes()
        for batch in batches:
            texts = [None if ids is None else (d := Decoder(token_bytes)).push(np.asarray(ids, np.int64)) + d.finish() for ids in batch["ids"]]
            yield pd.DataFrame({"id": batch["id"], "text": texts})

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
