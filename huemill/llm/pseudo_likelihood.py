"""Scores of documents under a masked language model: summed log-probabilities of every word given both sides.

A bidirectional window network, trained in numpy, predicts each word from WINDOW neighbours on either
side: their embeddings, weighted by place, add up to a tanh layer, whose output goes to a softmax over
groups of classes and to one over the classes of a group. The most frequent words of the corpus are
classes of their own; all other words share a fixed number of classes (by a hash). A word of a
shared class has its own share of it: the corpus count of the word plus one over that of the class,
whose last part is left to all unseen words. So every word is scored as itself, and a document's
score is the sum of the log-probabilities of its words, each masked in turn.

Training reads all documents. The biases start from the corpus counts, so the network starts at the
unigram model. In each round every task masks one position in MASKED of its own texts, whatever their
number, and takes one pass of Adagrad over them; the tasks' parameters are averaged, weighted by
their masked words, and go out again. A round moves one set of parameters per task, cut into parts
that are averaged apart; the driver gets the average of fixed size.

What reaches the driver is bounded by the number of classes and the HEAD most frequent words of shared
classes. The counts of all other words, which grow with the corpus, stay where they are and are
joined to the words of each text (texts and words by 64-bit hashes). A word is known where the corpus has it twice or
more. Null and empty texts have no words and score 0 (mean null). Repeated rows score alike. An empty
corpus gives a uniform model. Other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huemill.llm import superkmers as sk
from huemill.llm.common import partitions, shared_checkpoint, slices, texts_of

#: Groups of classes, classes of a group, classes in all that rarer words share.
GROUPS, PER, REST = 64, 128, 1024
#: Neighbours on each side, width of the network.
WINDOW, WIDTH = 3, 32
PLACES = (*range(-WINDOW, 0), *range(1, WINDOW + 1))
#: Rows of one group multiplied at a time.
ROWS = 1024
#: One position in so many is masked in a round of training; rounds, masked words of one step, learning rate.
MASKED, ROUNDS, STEP, RATE = 6, 1, 4096, 0.2
#: Up to here the exponentials of float32 are summed as they are.
STEADY = 80
#: Class of the places before and after a text.
BOUND = 0
#: Words counted by a task before it passes them on; words whose class a task remembers.
HELD, KEPT = 300_000, 300_000
#: Words whose counts go out to all tasks; those of all others are joined. Units of a summed logarithm, whole so that order doesn't matter.
HEAD, ONE = 50_000, 1 << 32
#: Numbers in one part of the parameters.
PART = 1 << 14
#: Corpus count from which a word is known.
KNOWN = 2


class Classes(dict):
    """Class of a lower-case word: 1, 2, ... for the listed ones, then the shared ones."""

    def __init__(self, words: list[str], size: int = GROUPS * PER, rest: int = REST):
        super().__init__({w: k + 1 for k, w in enumerate(words)})
        self.words, self.first, self.rest = words, size - rest, rest

    def __missing__(self, word: str) -> int:
        k = self.first + zlib.crc32(word.encode()) % self.rest
        if len(self) > KEPT:
            self.clear()
            self.update({w: k + 1 for k, w in enumerate(self.words)})
        if len(word) < 40:
            self[word] = k
        return k

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all words, WINDOW bounds before and after each text, and the places of the words."""
        flat: list[int] = [BOUND] * WINDOW
        for words in texts:
            flat += map(self.__getitem__, words)
            flat += [BOUND] * WINDOW
        ids = np.array(flat, np.int32)
        return ids, np.flatnonzero(ids != BOUND)


class Listed(dict):
    """Places of the most frequent words on their list; for another word the complement of its shared class, counted from the first one. One look for each word of a text."""

    def __init__(self, words: list[str], own: int, size: int = GROUPS * PER, rest: int = REST):
        super().__init__({w: k for k, w in enumerate(words)})
        self.first, self.rest = size - rest, rest
        self.classes = np.array([k + 1 if k < own else self.first + ~self.__missing__(w) for k, w in enumerate(words)] or [0], np.int32)

    def __missing__(self, word: str) -> int:
        return ~(zlib.crc32(word.encode()) % self.rest)

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As Classes.of, and the places on the list, negative for the words that aren't on it."""
        n = np.array([len(words) for words in texts], np.int64)
        place = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(n.sum()))
        at = np.arange(len(place)) + np.repeat(WINDOW * np.arange(1, len(n) + 1), n)
        ids = np.full(len(place) + WINDOW * (len(n) + 1), BOUND, np.int32)
        ids[at] = np.where(place < 0, self.first + ~place, self.classes[np.maximum(place, 0)])
        return ids, at, place


class Network:
    """Parameters by name: embeddings e, weights s of the places, bias h; groups g, gb; classes o, ob."""

    def __init__(self, groups: int = GROUPS, per: int = PER, width: int = WIDTH, seed: int = 0):
        r = np.random.default_rng(seed)
        normal = lambda *shape: (0.3 * r.standard_normal(shape)).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        self.groups, self.per, self.width = groups, per, width
        self.p = {"e": normal(groups * per, width), "s": np.ones((2 * WINDOW, width), np.float32), "h": zero(width), "g": zero(groups, width), "gb": zero(groups), "o": zero(groups, per, width), "ob": zero(groups, per)}

    def biased(self, counts: np.ndarray) -> Network:
        """Starts at the distribution of classes that these counts give."""
        p = np.log((counts.reshape(self.groups, self.per) + 0.1) / (counts.sum() + 0.1 * counts.size))
        self.p["gb"], self.p["ob"] = np.log(np.exp(p).sum(axis=1)).astype(np.float32), p.astype(np.float32)
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.p.values()])

    def of_flat(self, flat: np.ndarray) -> Network:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def _between(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """hidden() of places in order that are close together: by slices of all places between the first and the last."""
        first, n = at[0], at[-1] + 1 - at[0]
        e = self.p["e"][ids[first - WINDOW : first + n + WINDOW]]
        total = np.tile(self.p["h"], (n, 1))
        part = np.empty_like(total)
        for k, d in enumerate(PLACES):
            total += np.multiply(self.p["s"][k], e[WINDOW + d : WINDOW + d + n], out=part)
        return np.tanh(total[at - first])

    def _by_group(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Rows with a class of each group, ROWS at a time."""
        group = _narrow(ids // self.per)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(self.groups + 1))
        for g in range(self.groups):
            for k in range(cuts[g], cuts[g + 1], ROWS):
                yield g, order[k : min(k + ROWS, cuts[g + 1])]

    def _output(self, g: int) -> np.ndarray:
        """Weights of the groups, and below them of the classes of one group; the last column has their biases."""
        w = np.empty((self.groups + self.per, self.width + 1), self.p["o"].dtype)
        w[: self.groups, :-1], w[: self.groups, -1], w[self.groups :, :-1], w[self.groups :, -1] = self.p["g"], self.p["gb"], self.p["o"][g], self.p["ob"][g]
        return w

    def _room(self) -> np.ndarray:
        """Room for the outputs of ROWS places, used again and again: new memory for each would cost as much as the numbers."""
        return np.empty((self.groups + self.per) * ROWS, self.p["o"].dtype)

    def _steady(self) -> bool:
        """Whether no output can leave the range STEADY, as hidden values lie between -1 and 1."""
        return all(float((np.abs(self.p[w]).sum(axis=-1) + np.abs(self.p[b])).max()) < STEADY for w, b in (("g", "gb"), ("o", "ob")))

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of the class at each of these places, in order, given both sides."""
        out, steady, room, outputs = np.empty(len(at)), self._steady(), self._room(), [self._output(g) for g in range(self.groups)]
        for k in range(0, len(at), 1 << 16):
            here = at[k : k + (1 << 16)]
            x, classes = np.ones((len(here), self.width + 1), self.p["o"].dtype), ids[here]
            for j in range(0, len(here), 4096):
                x[j : j + 4096, :-1] = self._between(ids, here[j : j + 4096])
            for g, rows in self._by_group(classes):
                z = _times(outputs[g], x[rows], room)
                out[k + rows] = _picked(z[: self.groups], g, steady) + _picked(z[self.groups :], classes[rows] % self.per, steady)
        return out

    def gradient(self, ids: np.ndarray, at: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Summed loss at these places and its gradients; that of the embeddings only for the classes that the third result lists."""
        near, classes, steady = np.stack([ids[at + d] for d in PLACES]), ids[at], self._steady()
        e, total = self.p["e"][near], np.tile(self.p["h"], (len(at), 1))
        for k in range(len(PLACES)):
            total += self.p["s"][k] * e[k]
        x, room = np.ones((len(at), self.width + 1), total.dtype), self._room()
        x[:, :-1] = np.tanh(total)
        grad, dx, loss = {k: np.zeros_like(self.p[k]) for k in ("g", "gb", "o", "ob")}, np.empty_like(total), 0.0
        for g, rows in self._by_group(classes):
            w, mine = self._output(g), x[rows]
            z = _times(w, mine, room)
            loss -= (_picked(z[: self.groups], g, steady, True) + _picked(z[self.groups :], classes[rows] % self.per, steady, True)).sum()
            dx[rows], dw = z.T @ w[:, :-1], z @ mine
            grad["g"] += dw[: self.groups, :-1]
            grad["gb"] += dw[: self.groups, -1]
            grad["o"][g] += dw[self.groups :, :-1]
            grad["ob"][g] += dw[self.groups :, -1]
        dx *= 1 - x[:, :-1] * x[:, :-1]
        grad["h"] = dx.sum(axis=0)
        grad["s"] = np.stack([np.einsum("ij,ij->j", dx, y) for y in e])
        order = np.argsort(_narrow(near.reshape(-1)), kind="stable")
        # a row for each number of an embedding, as sums along rows are faster than down columns
        each = (self.p["s"].T[:, :, None] * np.ascontiguousarray(dx.T)[:, None, :]).reshape(self.width, -1)[:, order]
        seen, heads = np.unique(near.reshape(-1)[order], return_index=True)
        grad["e"] = (np.add.reduceat(each, heads, axis=1) if len(seen) else each).T
        return float(loss), grad, seen

    def steps(self, ids: np.ndarray, at: np.ndarray, squares: dict[str, np.ndarray], rate: float) -> None:
        """One pass of Adagrad over these places, STEP at a time."""
        for k in range(0, len(at), STEP):
            _, grad, seen = self.gradient(ids, at[k : k + STEP])
            for name, g in grad.items():
                g = g / np.float32(len(at[k : k + STEP]))
                where = seen if name == "e" else slice(None)
                squares[name][where] += g * g
                self.p[name][where] -= rate * g / (np.sqrt(squares[name][where]) + 1e-8)


def _times(w: np.ndarray, x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """w @ x.T in this room."""
    return np.matmul(w, x.T, out=room[: len(w) * len(x)].reshape(len(w), len(x)))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in 16 bits where they fit, which a stable sort takes by their digits."""
    return x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x


def _picked(z: np.ndarray, which: np.ndarray | int, steady: bool, slope: bool = False) -> np.ndarray:
    """Log-softmax of the columns of z at one row each; where asked for, z becomes its negative gradient. If z isn't steady, the largest number of a column is taken off first."""
    columns = np.arange(z.shape[1])
    if not steady:
        z -= z.max(axis=0)
    logs = z[which, columns].astype(np.float64)
    np.exp(z, out=z)
    total = np.ones(len(z), z.dtype) @ z
    if slope:
        z /= total
        z[which, columns] -= 1
    return logs - np.log(total)


@dataclass
class Model:
    words: list[str]
    network: Network
    rest: int
    counts: DataFrame  # word, n: every word of the corpus
    head: dict[str, int]  # counts of the most frequent words, negative for those with a class of their own
    sizes: np.ndarray  # log of the smoothed number of words by shared class

    def classes(self) -> Classes:
        return Classes(self.words, self.network.groups * self.network.per, self.rest)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every lower-case word of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for t in texts_of(b.column(0)):
                counts.update(t.lower().split())
                if len(counts) > HELD:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_counts(counted: DataFrame, words: list[str], size: int, rest: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each class; and the log of tokens + words + 1 of each shared class, whose words share it by their counts plus one, 0 for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = Classes(words, size, rest), np.zeros((2, size), np.int64)
        for b in batches:
            of = np.array([classes[w] for w in b.column(0).to_pylist()], np.int64)
            np.add.at(total[0], of, b.column(1).to_numpy())
            np.add.at(total[1], of, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *map(pa.array, total)], ["class", "n", "words"])

    rows = counted.mapInArrow(run, "class int, n long, words long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toArrow()
    of, tokens, sizes = rows.column(0).to_numpy(), np.zeros(size), np.zeros(size)
    tokens[of] = rows.column(1).to_numpy()
    sizes[of] = np.log(rows.column(1).to_numpy() + rows.column(2).to_numpy() + 1)
    sizes[: size - rest] = 0
    return tokens, sizes


def trained(docs: DataFrame, network: Network, words: list[str], own: int, rest: int, round_: int, rate: float) -> Network:
    """The average of what the tasks make of the network in one pass over their texts; the first words of the list have classes of their own."""
    spark = docs.sparkSession
    listed = spark.sparkContext.broadcast(words)  # those with a class of their own and HEAD more at most
    start = spark.sparkContext.broadcast(network.flat())  # of fixed size
    groups, per, width = network.groups, network.per, network.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Network(groups, per, width).of_flat(start.value.copy())
        classes, squares, masked = Listed(listed.value, own, groups * per, rest), {k: np.full_like(x, 1e-4) for k, x in mine.p.items()}, 0
        for b in slices(batches, 0, sk.CHUNK):
            ids, at, _ = classes.of([t.lower().split() for t in texts_of(b.column(0))])
            at = at[np.random.default_rng([round_, len(at)]).random(len(at)) < 1 / MASKED]
            mine.steps(ids, at, squares, rate)
            masked += len(at)
        if masked:
            flat = mine.flat()
            cuts = range(0, len(flat), PART)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts), dtype=np.int32)), pa.array(np.full(len(cuts), masked, np.int64)), pa.array([flat[k : k + PART].tobytes() for k in cuts], pa.binary())], ["part", "masked", "numbers"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for b in batches:
            for part, masked, numbers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = totals.setdefault(part, [0, 0.0])
                found[0] += masked
                found[1] = found[1] + masked * np.frombuffer(numbers, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([(x / n).astype(np.float32).tobytes() for n, x in totals.values()], pa.binary())], ["part", "numbers"])

    parts = docs.select("text").mapInArrow(run, "part int, masked long, numbers binary")
    found = parts.repartition(partitions(spark), "part").mapInArrow(mean, "part int, numbers binary").collect()
    if not found:
        return network
    return Network(groups, per, width).of_flat(np.concatenate([np.frombuffer(r.numbers, np.float32) for r in sorted(found, key=lambda r: r.part)]))


def fit(docs: DataFrame, groups: int = GROUPS, per: int = PER, rest: int = REST, head: int = HEAD, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """The model of all documents."""
    counted, listed = shared_checkpoint(word_counts(docs)), groups * per - rest - 1
    # chosen on an executor: a plain collect() sends that many words of each partition to the driver
    most = shared_checkpoint(counted.orderBy(F.desc("n"), "word").limit(listed + head))
    table = {r.word: r.n for r in sorted(most.collect(), key=lambda r: (-r.n, r.word))}
    words = list(table)[:listed]
    tokens, sizes = class_counts(counted, words, groups * per, rest)
    network = Network(groups, per).biased(tokens)
    for k in range(rounds):
        network = trained(docs, network, list(table), len(words), rest, k, rate / (k + 1))
    return Model(words, network, rest, counted, table | {w: -table[w] for w in words}, sizes)


def _tail(docs: DataFrame, model: Model, head) -> DataFrame:
    """text_hash and, over the text's words outside the head, the sum of log(n + 1) in units of 1 / ONE and the number of known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = head.value
        for b in batches:
            hashes, texts = b.column(0).to_numpy(), texts_of(b.column(1))
            rows, found, times = [], [], []

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.string()), pa.array(times, pa.int32())], ["text_hash", "word", "times"])
                rows.clear(), found.clear(), times.clear()
                return out

            for h, t in zip(hashes, texts, strict=True):
                c = Counter(w for w in t.lower().split() if w not in listed)
                rows += [h] * len(c)
                found += c.keys()
                times += c.values()
                if len(found) > 100_000:
                    yield flush()
            yield flush()

    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    met = docs.select(text_hash, "text").mapInArrow(run, "text_hash long, word string, times int")
    met = met.select("text_hash", F.xxhash64("word").alias("w"), "times")
    # words by 64-bit hashes; never broadcast, as the words grow with the corpus
    logs = model.counts.select(F.xxhash64("word").alias("w"), F.round(F.log(F.col("n") + 1) * ONE).cast("long").alias("log_n"), "n")
    joined = met.join(logs.hint("shuffle_merge"), "w").groupBy("text_hash")
    summed = joined.agg(F.sum(F.col("times") * F.col("log_n")).alias("sum"), F.sum(F.when(F.col("n") >= KNOWN, F.col("times")).otherwise(0)).alias("known"))
    copies = docs.select(text_hash).groupBy("text_hash").agg(F.count("*").alias("copies"))
    return summed.join(copies, "text_hash").select("text_hash", F.expr("sum div copies").alias("tail"), F.expr("known div copies").alias("known"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row per row of docs: words, known words, summed and mean log-probability."""
    context = docs.sparkSession.sparkContext
    network, sizes, own, rest = context.broadcast(model.network), model.sizes, len(model.words), model.rest  # of fixed size
    head = context.broadcast(model.head)  # HEAD words at most, and those with a class of their own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, times = Listed(list(head.value), own, len(sizes), rest), np.array([*head.value.values(), 0], np.int64)
        for b in slices(batches, 2, sk.CHUNK):
            texts = [t.lower().split() for t in texts_of(b.column(2))]
            ids, at, place = classes.of(texts)
            counts = times[np.where(place < 0, -1, place)]
            shares = np.round(np.log(np.maximum(counts, 0) + 1.0) * ONE).astype(np.int64)
            each = network.value.log_probabilities(ids, at) - sizes[ids[at]]
            n = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(n)
            summed = lambda x: (lambda s: s[ends] - s[ends - n])(np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)]))  # noqa: E731, B023
            columns = [pa.array(n), pa.array(summed((np.abs(counts) >= KNOWN).astype(np.int64))), pa.array(summed(each)), pa.array(summed(shares))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "text_hash", "n_words", "head_known", "classes", "head"])

    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    rows = docs.select(F.col("doc_id").cast("long"), text_hash, "text").mapInArrow(run, "doc_id long, text_hash long, n_words long, head_known long, classes double, head long")
    rows = rows.join(_tail(docs, model, head), "text_hash", "left")
    rows = rows.withColumn("log_likelihood", F.col("classes") + (F.col("head") + F.coalesce("tail", F.lit(0))) / F.lit(float(ONE)))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return rows.select("doc_id", "n_words", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), "log_likelihood", mean.alias("mean_log_likelihood"))
