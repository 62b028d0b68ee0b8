"""Pseudo-likelihood scores of a bidirectional window network, trained in numpy over the whole corpus.

Each token is masked in turn and predicted from the REACH tokens on both sides: context embeddings, one table for
each offset, are summed and passed through tanh, and a softmax over the vocabulary gives the masked token's
probability. A document's score is the sum of the log-probabilities of its tokens.

The vocabulary comes from word counts over all documents; rarer words share hashed entries. Such a word's probability
is its entry's, times its share of the entry's count. Up to FREQUENT of these words have their counts broadcast; the
counts of all others come from a Spark join, so there is no limit to their number. A word that the corpus doesn't have
counts UNSEEN. Training makes ROUNDS passes over disjoint thirds of the documents, so that every token of every
document is a target once. A hash of the row deals the documents of a round into shards of about SHARD tokens; each
shard trains a copy of the network, in the order of the hash, and the copies are averaged, weighted by their targets. The number of shards
follows from the corpus alone, so the scores don't depend on how the table is partitioned, and a copy sees as much of a large
corpus as of a small one. The softmax has two levels, the class of an entry and the entry within its class, so that a token
costs CLASSES + EACH exponentials. What reaches the driver is one network a round, whose size is fixed, and the
broadcast words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.shared import partitions, written

#: Words with an entry of their own, hashed entries for the others, width of the network, tokens seen on each side.
NAMED, HASHED, WIDTH, REACH = 384, 127, 16, 2
#: Rounds of training, targets of a step, learning rate, slices of the parameters.
ROUNDS, STEP, RATE, SLICES = 3, 2048, 0.15, 32
#: Tokens of a shard, about.
SHARD = 1 << 19
#: Tokens scored together (their probabilities stay in a core's cache) and gathered before; words counted in a task
#: before they are passed on.
BATCH, GATHERED, COUNTED = 1 << 12, 1 << 17, 200_000
#: Words without an entry of their own whose counts are broadcast at most: whole bands of counts, eight to a doubling.
FREQUENT = 1 << 16
#: Rows whose rarer words are held at a time.
ROWS = 500
#: Count of a word that is not in the corpus, and what each hashed entry's count has for all such words.
UNSEEN = 0.5
#: Seed of the 64-bit hash, as Spark's xxhash64 has it.
SEED = 42
VOCABULARY = NAMED + HASHED + 1
EDGE = VOCABULARY - 1  # stands where a document has no token
#: Classes of entries (neighbours by frequency), and entries of a class.
CLASSES = 8
EACH = VOCABULARY // CLASSES


def words_of(text: str | None) -> list[bytes]:
    """Tokens: lower-cased (A-Z) runs between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def token_ids(words: list[bytes], named: dict[bytes, int]) -> np.ndarray:
    found = list(map(named.get, words))
    if None in found:
        found = [NAMED + zlib.crc32(w) % HASHED if f is None else f for w, f in zip(words, found)]
    return np.array(found, np.int32)


class Places:
    """Tokens to ids by one table of the named and the frequent words; the others by their hash. `inside` has the log
    count of each frequent word and 0 for the named ones."""

    def __init__(self, named: dict[bytes, int], frequent: dict[bytes, int]) -> None:
        words = [*named, *frequent]
        self.place = {w: k for k, w in enumerate(words)}
        self.entry = np.array([*named.values(), *(NAMED + zlib.crc32(w) % HASHED for w in frequent), 0], np.int32)
        self.inside = np.concatenate([np.zeros(len(named)), np.log(np.array([*frequent.values()], np.float64)), [0.0]])

    def read(self, words: list[bytes]) -> tuple[np.ndarray, float, list[bytes]]:
        """(ids, the sum of `inside`, the words of neither kind, repeats included)."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
        ids = self.entry[at]
        missing = np.flatnonzero(at < 0)
        rare = [words[k] for k in missing]
        if rare:
            ids[missing] = [NAMED + zlib.crc32(w) % HASHED for w in rare]
        return ids, float(self.inside[at].sum()), rare


class Vocabulary(dict[bytes, int]):
    """The ids of the named words; `counts` is the table (word, n) of all words, `frequent` has the most frequent of the
    others with their counts, `held` the counts of the hashed entries."""

    counts: DataFrame
    frequent: dict[bytes, int]
    held: np.ndarray


@dataclass
class Network:
    """`context`: (2 * REACH, VOCABULARY, WIDTH), `hidden`: WIDTH biases, `classes`: (WIDTH + 1, CLASSES), `output`:
    (WIDTH + 1, VOCABULARY), read within a class."""

    context: np.ndarray
    hidden: np.ndarray
    classes: np.ndarray
    output: np.ndarray

    @classmethod
    def start(cls, frequency: np.ndarray, seed: int = 11) -> Network:
        """Small random weights; the biases are the log frequencies, so training starts at the unigram model."""
        draw = np.random.default_rng(seed)
        small = lambda *shape: (draw.standard_normal(shape) * 0.1).astype(np.float32)
        share = np.maximum(frequency, 0.5)
        share = share / share.sum()
        net = cls(small(2 * REACH, VOCABULARY, WIDTH), np.zeros(WIDTH, np.float32), small(WIDTH + 1, CLASSES), small(WIDTH + 1, VOCABULARY))
        net.classes[-1], net.output[-1] = np.log(share.reshape(CLASSES, EACH).sum(axis=1)), np.log(share)
        return net

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.hidden, self.classes, self.output]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        shapes = [(2 * REACH, VOCABULARY, WIDTH), (WIDTH,), (WIDTH + 1, CLASSES), (WIDTH + 1, VOCABULARY)]
        parts = np.split(flat.astype(np.float32), np.cumsum([np.prod(x) for x in shapes])[:-1])
        return cls(*(x.reshape(shape) for x, shape in zip(parts, shapes)))

    def state(self, sides: np.ndarray) -> np.ndarray:
        h = np.tile(self.hidden, (len(sides), 1))
        for j in range(2 * REACH):
            h += self.context[j][sides[:, j]]
        return np.tanh(h, out=h)

    def levels(self, wide: np.ndarray, target: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, weights, logits, place of the right one): first the classes for all rows, then the entries of each
        class for the rows whose target is in it."""
        own = target // EACH
        yield slice(None), self.classes, wide @ self.classes, own
        order = np.argsort(own.astype(np.uint8), kind="stable")
        ends = np.searchsorted(own[order], np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(ends)):
            rows, weights = order[ends[c] : ends[c + 1]], self.output[:, c * EACH : (c + 1) * EACH]
            yield rows, weights, wide[rows] @ weights, target[rows] - c * EACH

    def log_probabilities(self, sides: np.ndarray, target: np.ndarray) -> np.ndarray:
        total = np.zeros(len(target))
        for rows, _, z, right in self.levels(with_one(self.state(sides)), target):
            z -= z.max(axis=1, keepdims=True)
            total[rows] += z[np.arange(len(z)), right]
            total[rows] -= np.log(np.exp(z, out=z).sum(axis=1))
        return total

    def train(self, sides: np.ndarray, target: np.ndarray, power: list[np.ndarray]) -> None:
        """One step of Adagrad on the mean log-loss; `power` has the squared gradients so far."""
        n = len(target)
        h = self.state(sides)
        wide = with_one(h)
        back = np.zeros_like(h)
        above, inner = np.zeros_like(self.classes), np.zeros_like(self.output)
        for rows, weights, z, right in self.levels(wide, target):
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z, out=z)
            e /= (e.sum(axis=1) * n)[:, None]
            e[np.arange(len(e)), right] -= 1 / n  # the gradient by the logits
            back[rows] += e @ weights[:-1].T
            if isinstance(rows, slice):
                above += wide.T @ e
            else:
                c = target[rows[0]] // EACH
                inner[:, c * EACH : (c + 1) * EACH] = wide[rows].T @ e
        back *= 1 - h * h
        grad = np.bincount((((np.arange(2 * REACH) * VOCABULARY + sides) * WIDTH)[:, :, None] + np.arange(WIDTH)).ravel(), np.repeat(back[:, None], 2 * REACH, axis=1).ravel(), self.context.size)
        grads = [grad.reshape(self.context.shape).astype(np.float32), back.sum(axis=0), above, inner]
        for x, g, q in zip(self.arrays(), grads, power):
            q += g * g
            x -= RATE * g / np.sqrt(q + 1e-8)


def with_one(h: np.ndarray) -> np.ndarray:
    """The rows of h, each with a 1 behind it for the biases."""
    return np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1)


def blocks(ids: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, targets) of a text, `size` positions at a time, so that a long text takes no more memory."""
    wide = np.concatenate([np.full(REACH, EDGE, np.int32), ids, np.full(REACH, EDGE, np.int32)])
    for at in range(0, len(ids), size):
        own = ids[at : at + size]
        yield np.stack([wide[at + j : at + j + len(own)] for j in range(2 * REACH + 1) if j != REACH], axis=1), own


def vocabulary(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, np.ndarray]:
    """The NAMED most frequent words over all documents (ties by the word), and the frequency of every entry."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(words_of(text))
                if len(seen) >= COUNTED:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}).astype({"n": "int64"})

    counts = written(docs.select(F.col(text_col).alias("text")).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(NAMED).collect()  # a bounded list
    named = Vocabulary({bytes(r.word): k for k, r in enumerate(top)})
    named.counts, named.held, named.total = counts, np.zeros(HASHED), 0
    for r in counts.groupBy((F.crc32("word") % HASHED).alias("entry")).agg(F.sum("n").alias("n")).collect():
        named.held[r.entry] = r.n
        named.total += r.n
    for r in top:
        named.held[zlib.crc32(r.word) % HASHED] -= r.n
    band = F.floor(F.log2("n") * 8)
    least, room = None, FREQUENT + len(top)
    for r in counts.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():  # a few hundred bands at most
        room -= r["count"]
        if room < 0:
            break
        least = r.band
    frequent = counts.where(band >= least).collect() if least is not None else []
    named.frequent = {bytes(r.word): r.n for r in frequent if bytes(r.word) not in named}
    frequency = np.full(VOCABULARY, 1.0)
    frequency[: len(top)] = [r.n for r in top]
    frequency[NAMED:EDGE] = np.maximum(1.0, named.held)
    return named, frequency


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[Vocabulary, Network]:
    """The vocabulary and a network trained on all documents. Without any token it stays as it starts.

    Nulls are left out, long texts are read in blocks, and columns but these two are ignored (without an `id_col`, the text
    alone deals the rows out). Copies of a text under several ids go to several shards; rows equal in both go to one."""
    spark = docs.sparkSession
    named, frequency = vocabulary(docs, text_col)
    model = Network.start(frequency)
    own_id = [F.col(id_col)] if id_col in docs.columns else []
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col), *own_id).alias("key")).where(F.col("text").isNotNull())
    shards = max(1, -(-named.total // (ROUNDS * SHARD)))
    names = spark.sparkContext.broadcast((dict(named), named.frequent))
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(model.flat())

        def learn(shard: pd.DataFrame) -> pd.DataFrame:
            own = Network.of(start.value.copy())
            power = [np.zeros_like(x) for x in own.arrays()]
            places = Places(*names.value)
            seen, sides, target, held = 0, [], [], 0
            for text in shard.sort_values("key", kind="stable")["text"]:
                for around, ids in blocks(places.read(words_of(text))[0], 64 * STEP):
                    sides.append(around)
                    target.append(ids)
                    held += len(ids)
                    if held >= 64 * STEP:
                        seen += _steps(own, power, np.concatenate(sides), np.concatenate(target))
                        sides, target, held = [], [], 0
            if held:
                seen += _steps(own, power, np.concatenate(sides), np.concatenate(target))
            parts = np.array_split(own.flat() * np.float32(seen), SLICES) if seen else []
            return pd.DataFrame({"slice": range(len(parts)), "weight": float(seen), "values": [p.astype(np.float32).tobytes() for p in parts]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, tuple[float, np.ndarray]] = {}
            for batch in batches:
                for k, w, v in zip(batch["slice"], batch["weight"], batch["values"]):
                    w0, v0 = total.get(k, (0.0, 0.0))
                    total[k] = (w0 + w, v0 + np.frombuffer(v, np.float32).astype(np.float64))
            yield pd.DataFrame({"slice": list(total), "weight": [w for w, _ in total.values()], "values": [(v / w).astype(np.float32).tobytes() for w, v in total.values()]})

        shard = F.pmod("key", F.lit(ROUNDS * shards))
        part = texts.where(F.pmod(shard, F.lit(ROUNDS)) == turn).withColumn("shard", shard)
        copies = part.groupBy("shard").applyInPandas(learn, "slice int, weight double, values binary")
        mean = copies.repartition(min(SLICES, partitions(spark)), "slice").mapInPandas(add, "slice int, weight double, values binary").collect()
        if mean:
            model = Network.of(np.concatenate([np.frombuffer(r.values, np.float32) for r in sorted(mean, key=lambda r: r.slice)]))
    return named, model


def _steps(own: Network, power: list[np.ndarray], sides: np.ndarray, target: np.ndarray) -> int:
    order = np.random.default_rng(len(target)).permutation(len(target))
    for at in range(0, len(order), STEP):
        some = order[at : at + STEP]
        own.train(sides[some], target[some], power)
    return len(target)


def score(docs: DataFrame, named: Vocabulary, model: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: (id_col, n_tokens, log_likelihood, mean_log_likelihood) of the whole text.

    A null, empty or blank text has no tokens, sum 0 and a null mean. Repeated rows are scored each; ids, null
    included, pass through; no rows give no rows. Texts are scored in blocks of BATCH tokens. A word of a hashed entry
    adds log(its count / (the entry's count + UNSEEN)): the divisors and the counts of frequent words in the scan, all
    other counts by a join of each document's distinct words. The join goes by 64-bit hashes; two words of one hash
    share their counts."""
    held = docs.sparkSession.sparkContext.broadcast((dict(named), named.frequent, model.flat(), np.concatenate([np.zeros(NAMED), np.log(named.held + UNSEEN), [0.0]])))
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, frequent, flat, divisors = held.value
        places = Places(names, frequent)
        net = Network.of(flat)
        for batch in (whole.iloc[k : k + ROWS] for whole in batches for k in range(0, len(whole), ROWS)):
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            rare, times = [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            sides, target, owner, size = [], [], [], 0

            def flush() -> None:
                if sides:
                    a, b, c = np.concatenate(sides), np.concatenate(target), np.concatenate(owner)
                    for at in range(0, len(b), BATCH):
                        got = net.log_probabilities(a[at : at + BATCH], b[at : at + BATCH])
                        total[:] += np.bincount(c[at : at + BATCH], weights=got, minlength=len(batch))

            for i, text in enumerate(batch["text"]):
                ids, inside, others = places.read(words_of(text))
                if not len(ids):
                    continue
                n[i] = len(ids)
                total[i] += inside - divisors[ids].sum()
                own = Counter(others)
                rare[i] = np.array([xxhash.xxh64_intdigest(w, SEED) for w in own], np.uint64).view(np.int64)
                times[i] = np.array([*own.values()], np.int32)
                for around, part in blocks(ids, GATHERED):
                    sides.append(around)
                    target.append(part)
                    owner.append(np.full(len(part), i))
                    size += len(part)
                    if size >= GATHERED:
                        flush()
                        sides, target, owner, size = [], [], [], 0
            flush()
            yield pd.DataFrame({"row": batch["row"], "id": batch["id"], "n_tokens": n, "scanned": total, "rare": rare, "times": times})

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scanned = written(texts.mapInPandas(run, f"row long, id {kind}, n_tokens long, scanned double, rare array<long>, times array<int>"), "scanned")
    each = scanned.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), "x.times")
    counts = named.counts.groupBy(F.xxhash64("word").alias("word")).agg(F.sum("n").alias("n"))
    found = each.join(counts.hint("merge"), "word", "left").withColumn("inside", F.col("times") * F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN))))
    inside = found.groupBy("row").agg(F.sum("inside").alias("inside"))
    scored = scanned.select("row", "id", "n_tokens", "scanned").join(inside.hint("merge"), "row", "left").withColumn("log_likelihood", F.col("scanned") + F.coalesce("inside", F.lit(0.0)))
    return scored.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))
