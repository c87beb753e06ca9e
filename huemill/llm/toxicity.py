"""Toxicity of whole texts by their nearest labelled examples under TF-IDF cosine.

Terms are the words of a text (runs of letters, lower case) and their first 3 to 9 bytes, which stand
for inflected and compounded forms. Of them the ones that tell labelled toxic from clean documents
make the vocabulary: log ratio of at least RATIO and G statistic of at least SURE, over a bounded sample of
each class. A document's vector has, for each term of the vocabulary and each of its first REPEATS occurrences,
one entry of the weight log(1 + N / df), N and df counted over all documents; so term frequency
saturates. Examples are the distinct vectors of the sample, each with its share of toxic documents.

A document's NEAREST examples by cosine are found exactly, in an inverted index whose postings lie
in blocks of examples: the largest weight of a term in a block bounds what the block's examples can reach,
blocks are taken from the highest bound down, and the search ends where the bound falls below the last
neighbour's cosine. Neighbours vote with their toxic shares, weighted by the squared cosine; a
vote of weight PRIOR goes to the toxic share of examples without any term, which is also the
score of a document without terms. The neighbours are the evidence.

Texts are scanned twice (the sample, then all) and never shuffled. The index goes to the executors as
one broadcast of POSTINGS entries at most: examples are taken by a hash of their id up to that bound.
Labels are learned from ids whose CRC-32 isn't 2 modulo 4; the others are held out. An id with
several labels is toxic where one says so; null labels and null ids count for nothing. Null and empty texts have
no terms. Repeated rows are scored alike. Without toxic labels all scores are 0. Non-ASCII punctuation
counts as letters. Other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huemill.llm.common import ragged, shared_checkpoint, slices, texts_of

#: Labelled rows of each class that terms are learned from and examples taken from, in expectation.
SAMPLE_ROWS = 20_000
#: Terms at most, the least log ratio, G statistic and number of toxic documents of a term.
VOCABULARY, RATIO, SURE, LEAST = 2_048, 1.5, 20.0, 3
#: Occurrences of a term that have an entry of their own.
REPEATS = 4
#: Entries of the index at most, and the hash slots by which examples are taken up to them.
POSTINGS, SLOTS = 1_000_000, 1_024
#: Neighbours, weight of the prior vote, score from which a document counts as toxic.
NEAREST, PRIOR, TOXIC_FROM = 10, 0.5, 0.3
#: Prefixes in bytes; longer words than LONG bytes are hashed one by one; examples of a block; bytes of text hashed at once.
PREFIXES, LONG, BLOCK, SLAB = range(3, 10), 64, 64, 4 << 20
#: Distinct vectors whose scores a task keeps.
KEPT = 10_000
_START, _PRIME, _WHOLE = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def term_hashes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of texts, and 64-bit hashes of a term in each: first whole words, then prefixes by length."""
    data = np.frombuffer("\n".join(t.lower() for t in texts).encode() + b"\n", np.uint8)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    edge = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0, append=0))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    # a text's own line ends are no bounds of texts, so bounds come from the lengths
    bounds = np.cumsum([len(t.lower().encode()) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    of = np.searchsorted(bounds, starts, side="right")
    h = np.full(len(starts), _START)
    longest = int(lengths[0]) if len(lengths) else 0
    with np.errstate(over="ignore"):
        for k in range(min(longest, LONG)):
            live = int(np.searchsorted(-lengths, -k, side="left"))  # those longer than k
            h[:live] = (h[:live] ^ data[starts[:live] + k]) * _PRIME
            if k + 1 in PREFIXES:
                inner = int(np.searchsorted(-lengths, -(k + 1), side="left"))
                yield of[:inner], h[:inner].copy()
        for i in range(int(np.searchsorted(-lengths, -LONG, side="left"))):
            word = data[starts[i] : starts[i] + lengths[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        yield of, (h ^ _WHOLE) * _PRIME


def _labelled(labels: DataFrame, sample_rows: int) -> DataFrame:
    """_id and _toxic of the sample of the ids that aren't held out: sample_rows of each class in expectation."""
    said = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    one = said.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or(F.col("toxic") == 1).alias("_toxic"))
    n = {r["_toxic"]: r["count"] for r in one.groupBy("_toxic").count().collect()}
    share = {c: int(min(1.0, sample_rows / max(1, n.get(c, 0))) * 1_000_000) for c in (True, False)}
    return one.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.when(F.col("_toxic"), share[True]).otherwise(share[False]))


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(hashes), return_inverse=True)
    both = np.concatenate(counts)
    return key, np.stack([np.bincount(at, both[:, c], len(key)) for c in (0, 1)], axis=1).astype(np.int64)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, toxic) rows: each term with the toxic and the clean documents that have it; the empty hash 0 counts all documents."""
    hashes: list[np.ndarray] = [np.zeros(0, np.uint64)]
    counts: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    held = 0

    def flush() -> pa.RecordBatch:
        key, n = _summed(hashes, counts)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n[:, 0]), pa.array(n[:, 1])], ["h", "a", "b"])

    for batch in slices(batches, 0, SLAB):
        toxic = np.asarray(batch.column(1).to_pylist(), bool)
        found = list(term_hashes(texts_of(batch.column(0))))
        of, h = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((h, of))
        of, h = of[order], h[order]
        first = np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
        of, h = of[first], h[first]
        key, n = _summed([h, np.zeros(len(toxic), np.uint64)], [np.stack([toxic[of], ~toxic[of]], axis=1), np.stack([toxic, ~toxic], axis=1)])
        hashes.append(key)
        counts.append(n)
        held += len(key)
        if held > 2_000_000:
            yield flush()
            hashes, counts, held = hashes[:1], counts[:1], 0
    yield flush()


def vocabulary(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Hashes of the terms that mark toxic documents, the surest first; VOCABULARY rows reach the driver at most."""
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_text", "_toxic")
    found = shared_checkpoint(texts.mapInArrow(_count_terms, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where((F.col("a") >= LEAST) | (F.col("h") == 0)))
    total = found.where("h = 0").collect()
    if not total or not total[0]["a"] or not total[0]["b"]:
        return []
    bad, fine = total[0]["a"], total[0]["b"]
    a, b, n = F.col("a"), F.col("b"), bad + fine
    term = lambda x, all_x, all_c: F.when(x > 0, x * F.log(x * n / (all_x * all_c))).otherwise(0.0)
    have, lack = a + b, n - a - b
    sure = 2 * (term(a, have, bad) + term(b, have, fine) + term(bad - a, lack, bad) + term(fine - b, lack, fine))
    ratio = F.log((a + 0.5) / (bad + 1)) - F.log((b + 0.5) / (fine + 1))
    # a term of every document tells nothing, and has no G statistic
    best = found.where("h != 0").where(lack > 0).withColumn("g", F.round(sure, 6)).where((ratio >= RATIO) & (F.col("g") >= SURE))
    return [r["h"] for r in best.orderBy(F.desc("g"), "h").limit(VOCABULARY).collect()]


def vectors(docs: DataFrame, terms: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and _terms of every row: sorted numbers, REPEATS x place in the vocabulary + occurrence (from 0)."""
    place = np.argsort(np.array(terms, np.int64).view(np.uint64), kind="stable")
    known = np.array(terms, np.int64).view(np.uint64)[place]
    maybe = np.zeros(1 << 16, bool)
    maybe[(known >> np.uint64(48)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLAB):
            docs_of, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for of, h in term_hashes(texts_of(batch.column(1))) if len(known) else ():
                hit = np.flatnonzero(maybe[(h >> np.uint64(48)).astype(np.int64)])
                at = np.minimum(np.searchsorted(known, h[hit]), len(known) - 1)
                same = known[at] == h[hit]
                docs_of.append(of[hit][same])
                found.append(place[at[same]])
            key, n = np.unique(np.concatenate(docs_of) * VOCABULARY + np.concatenate(found), return_counts=True)
            n = np.minimum(n, REPEATS)
            entries = (np.repeat(key % VOCABULARY, n) * REPEATS + ragged(np.zeros(len(n), np.int64), n)).astype(np.int32)
            sizes = np.bincount(key // VOCABULARY, n, batch.num_rows).astype(np.int64)
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(entries))], ["_id", "_terms"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _terms array<int>")


@dataclass
class Index:
    """Postings by term, cut where the block of examples changes. Segment s holds postings bounds[s] to bounds[s + 1], all of one term and block."""

    weights: np.ndarray  # of each entry of a vector
    shares: np.ndarray  # toxic share of each example
    sizes: np.ndarray  # documents of each example
    ids: list  # least document id of each example
    term_segments: np.ndarray  # first segment of each entry
    blocks: np.ndarray  # block of each segment
    most: np.ndarray  # largest weight in each segment
    bounds: np.ndarray
    examples: np.ndarray  # of each posting
    values: np.ndarray
    base: float  # toxic share of examples without terms

    @classmethod
    def build(cls, rows: list[tuple[list[int], float, int, object]], weights: np.ndarray, base: float) -> Index:
        """rows: sorted entries, toxic share, documents, least id. Sorted by their entries, so that examples of a block resemble each other."""
        rows = sorted(rows, key=lambda r: r[0])
        entry = np.array([e for r in rows for e in r[0]], np.int64)
        example = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]) if rows else np.zeros(0, np.int64)
        norm = np.sqrt(np.bincount(example, weights[entry] ** 2, len(rows))) if rows else np.zeros(0)
        value = weights[entry] / norm[example] if rows else np.zeros(0)
        order = np.lexsort((example, entry))
        entry, example, value = entry[order], example[order], value[order]
        block = example // BLOCK
        start = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (block[1:] != block[:-1])]) if len(entry) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(value, start) if len(start) else np.zeros(0)
        return cls(weights, np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.float64), [r[3] for r in rows], np.searchsorted(entry[start], np.arange(len(weights) + 1)), block[start], most, np.r_[start, len(entry)], example, value, base)

    def nearest(self, entries: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray, int]:
        """The k examples of the highest cosine (ties to the lower number), their cosines, and how many blocks were opened."""
        weight = self.weights[entries]
        weight = weight / np.sqrt((weight**2).sum())
        first, size = self.term_segments[entries], self.term_segments[entries + 1] - self.term_segments[entries]
        segments, by = ragged(first, size), np.repeat(weight, size)
        n_blocks = -(-len(self.shares) // BLOCK)
        bound = np.bincount(self.blocks[segments], by * self.most[segments], n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, cosine, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 1
        while at < len(order) and (len(best) < k or bound[order[at]] >= cosine[-1] - 1e-9):
            chunk = np.zeros(n_blocks, bool)
            chunk[order[at : at + step]] = True
            opened = chunk[self.blocks[segments]]
            s, w = segments[opened], by[opened]
            lengths = self.bounds[s + 1] - self.bounds[s]
            posting = ragged(self.bounds[s], lengths)
            found, of = np.unique(self.examples[posting], return_inverse=True)
            total = np.round(np.bincount(of, np.repeat(w, lengths) * self.values[posting]), 9)
            best, cosine = np.concatenate([best, found]), np.concatenate([cosine, total])
            top = np.lexsort((best, -cosine))[:k]
            best, cosine = best[top], cosine[top]
            at, step = at + step, 2 * step
        return best, cosine, min(at, len(order))

    def vote(self, examples: np.ndarray, cosines: np.ndarray) -> float:
        by = cosines**2 * self.sizes[examples]
        return float((by @ self.shares[examples] + PRIOR * self.base) / (by.sum() + PRIOR)) if len(examples) else self.base


def fit(found: DataFrame, sample: DataFrame, n_terms: int) -> Index:
    """The index of the sample's vectors; found: vectors() of all documents, materialised."""
    n = found.count()
    df = np.zeros(max(1, n_terms * REPEATS))
    for r in found.select(F.explode("_terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weights = np.log1p(n / np.maximum(df, 1))
    known = found.withColumnRenamed("_id", "_doc").join(F.broadcast(sample), F.col("_doc") == F.col("_id")).withColumn("_slot", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(SLOTS)))
    known = known.groupBy("_terms").agg(F.count_if("_toxic").alias("a"), F.count("*").alias("n"), F.min("_id").alias("id"), F.min("_slot").alias("slot"))
    known = shared_checkpoint(known)
    n_all, n_bad, n_none, bad_none = 0, 0, 0, 0
    size = F.size("_terms")
    for r in known.groupBy((size == 0).alias("none")).agg(F.sum("a").alias("a"), F.sum("n").alias("n")).collect():
        n_all, n_bad = n_all + r["n"], n_bad + r["a"]
        n_none, bad_none = (r["n"], r["a"]) if r["none"] else (n_none, bad_none)
    base = (bad_none + (n_bad / n_all if n_all else 0.0)) / (n_none + 1)
    entries, until = 0, 0
    for r in sorted(known.groupBy("slot").agg(F.sum(size).alias("n")).collect()):
        entries += r["n"]
        if entries > POSTINGS:
            break
        until = r["slot"] + 1
    rows = known.where((F.col("slot") < until) & (size > 0)).select("_terms", F.col("a") / F.col("n"), "n", "id").toLocalIterator()
    return Index.build([tuple(r) for r in rows], weights, base)


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_terms and evidence (doc_id, cosine and toxic share of the nearest examples, nearest first)."""
    sample = shared_checkpoint(_labelled(labels, sample_rows))
    terms = vocabulary(docs, sample, id_col, text_col)
    found = shared_checkpoint(vectors(docs, terms, id_col, text_col))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(fit(found, sample, len(terms)))
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kept = sent.value, {}
        for batch in batches:
            scores, evidence = [], []
            for entries in batch.column(1).to_pylist():
                key = tuple(entries)
                if key not in kept:
                    if len(kept) >= KEPT:
                        kept.clear()
                    near, cosines, _ = index.nearest(np.array(entries, np.int64)) if entries and len(index.shares) else (np.zeros(0, np.int64), np.zeros(0), 0)
                    kept[key] = (round(index.vote(near, cosines), 6), [{"doc_id": index.ids[e], "cosine": float(c), "toxic": float(index.shares[e])} for e, c in zip(near, cosines, strict=True)])
                scores.append(kept[key][0])
                evidence.append(kept[key][1])
            kind = pa.list_(pa.struct([("doc_id", batch.column(0).type), ("cosine", pa.float64()), ("toxic", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([len(e) for e in batch.column(1).to_pylist()], pa.int64()), pa.array(evidence, kind)], ["doc_id", "score", "n_terms", "evidence"])

    out = found.mapInArrow(run, f"doc_id {ids}, score double, n_terms long, evidence array<struct<doc_id:{ids},cosine:double,toxic:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_terms", "evidence")
