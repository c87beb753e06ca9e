"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of each text.

A-Z are lower-cased; words are runs of other characters than ASCII separators. The windows of an
item are its runs of `window` words (the whole item if it has fewer, none if it has none). The
automaton holds each window as its words joined and enclosed by single spaces, over bytes, so that
matches respect word bounds; hits are mapped back to words and, on request, to places in the
original text.

Whatever its size, a benchmark makes one automaton of the windows that occur. One of more than
max_bytes is thinned first: the hashes of all its windows go into a bitmap of fixed size, the texts'
runs of words that hit it are joined to the windows, and those without a partner can match nowhere.
Should what occurs still be larger (a third of the benchmark in the texts, say), it is scanned in parts
of max_bytes, whose hits are merged by document. A worker keeps its automaton between tasks.
Null and empty texts have no words. Repeated rows each get a row; repeated items count once. Other
columns of the inputs don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huemill.llm import superkmers as sk
from huemill.llm.common import bytes_of, id_array, ids_of, partitions, slices, texts_of
from huemill.llm.passage_dedup import word_ranges

#: Bytes of windows in one automaton.
MAX_BYTES = 16 << 20
#: Bits, as a power of two, that tell which windows' hashes a large benchmark has; and those of one piece of them.
BITS, PIECE = 27, 15
_built: dict[str, object] = {}
#: Every separator becomes a space, A-Z lower case; other bytes stay.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))

HITS = "doc_id long, text_hash long, n_words long, starts array<int>, ends array<int>, items array<string>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def windows_of(text: str | None, window: int) -> list[bytes]:
    ws = words_of(text or "")
    return [b" " + b" ".join(ws[i : i + window]) + b" " for i in range(max(1, len(ws) - window + 1))] if ws else []


def automaton(windows: dict[bytes, list[str]]):
    found = ahocorasick.Automaton()
    for w, items in windows.items():
        found.add_word(w.decode("latin-1"), (w.count(b" ") - 1, items))
    if windows:
        found.make_automaton()
    return found


def kept_automaton(name: str, shared):
    """The automaton of a broadcast set of windows, built once in a worker."""
    if name not in _built:
        _built.clear()
        _built[name] = automaton(shared.value)
    return _built[name]


def hits_of(text: str, found) -> tuple[int, list[int], list[int], list[str]]:
    """Words of the text, the maximal runs of hit words (end exclusive), the items, as strings in order."""
    ws = words_of(text)
    if not ws or not len(found):
        return len(ws), [], [], []
    flat = b" " + b" ".join(ws) + b" "
    met = list(found.iter(flat.decode("latin-1")))
    if not met:
        return len(ws), [], [], []
    spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    ends = np.searchsorted(spaces, [e for e, _ in met])
    starts = ends - [n for _, (n, _) in met]
    marks = np.zeros(len(ws) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    edges = np.flatnonzero(np.diff((np.cumsum(marks) > 0).astype(np.int8), prepend=0))
    return len(ws), edges[::2].tolist(), edges[1::2].tolist(), sorted({i for _, (_, items) in met for i in items})


def original_spans(text: str, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Code-point spans in the original text of runs of hit words."""
    blob = np.frombuffer(text.encode(), np.uint8)
    inside = np.frombuffer(blob.tobytes().translate(FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    points = np.concatenate([[0], np.cumsum((blob & 0xC0) != 0x80)])
    return [(int(points[edges[2 * a]]), int(points[edges[2 * b - 1]])) for a, b in zip(starts, ends, strict=True)]


def run_hashes(data: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` words within one text."""
    data = np.frombuffer(data.tobytes().translate(FOLD), np.uint8)
    first, last, at = word_ranges(data, bounds)
    h = sk.range_hashes(data, first, last)
    n = max(0, len(h) - size + 1)
    s = np.full(n, size, np.uint64)
    for k in range(size):
        s = s * sk.C1 + h[k : k + n]
    start = np.arange(n)
    return sk.mixed(s)[start + size <= at[np.searchsorted(at, start, side="right")]] if n else s


def _pairs(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, w, k, h): the windows of each item, once each, their words and the hash of these."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in windows_of(t, window)]
            words = [w.count(b" ") - 1 for _, w in pairs]
            hashes = np.zeros(len(pairs), np.uint64)
            for k in set(words):
                of = [j for j, n in enumerate(words) if n == k]
                blob = b"".join(pairs[j][1] for j in of)
                hashes[of] = run_hashes(np.frombuffer(blob, np.uint8), np.cumsum([0, *(len(pairs[j][1]) for j in of)]), k)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.string()), pa.array([w for _, w in pairs], pa.binary()), pa.array(words, pa.int32()), pa.array(hashes.view(np.int64))], ["item", "w", "k", "h"])

    return items.mapInArrow(split, "item string, w binary, k int, h long").distinct()


def _occurring(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The windows whose hash some text has."""
    spark = docs.sparkSession
    place = F.shiftrightunsigned("h", 64 - BITS)
    pieces = pairs.select(F.shiftrightunsigned("h", 64 - BITS + PIECE).cast("int").alias("piece"), F.pmod(place, F.lit(1 << PIECE)).cast("int").alias("bit")).distinct()

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            numbers, bits = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(numbers).tolist():
                maps.setdefault(k, np.zeros(1 << PIECE, bool))[bits[numbers == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([np.packbits(m).tobytes() for m in maps.values()], pa.binary())], ["piece", "bits"])

    bitmap = np.zeros((1 << (BITS - PIECE), 1 << (PIECE - 3)), np.uint8)
    for r in pieces.repartition(partitions(spark), "piece").mapInArrow(piece, "piece int, bits binary").toLocalIterator():
        bitmap[r.piece] = np.frombuffer(r.bits, np.uint8)
    sizes = [r.k for r in pairs.select("k").distinct().collect()]  # at most the words of a window
    shared = spark.sparkContext.broadcast(bitmap.reshape(-1))  # 2**BITS bits

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, sk.CHUNK):
            data, bounds = bytes_of(b.column(0))
            h = np.unique(np.concatenate([run_hashes(data, bounds, k) for k in sizes])) if sizes else np.zeros(0, np.uint64)
            at = h >> np.uint64(64 - BITS)
            hit = shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64))], ["h"])

    return pairs.join(docs.select("text").mapInArrow(met, "h long").distinct(), "h", "left_semi")


def _parts(benchmark: DataFrame, docs: DataFrame, window: int, max_bytes: int) -> Iterator[dict[bytes, list[str]]]:
    """The windows with the items that have them, of a large benchmark those that occur; in parts of max_bytes at most, one at a time on the driver."""
    size = lambda df: df.select(F.sum(F.octet_length("w") + F.octet_length("item"))).first()[0] or 0
    pairs = _pairs(benchmark, window)
    total = size(pairs)
    if total > max_bytes:
        pairs = _occurring(pairs, docs).persist()
        total = size(pairs)
    n = max(1, -(-total // max_bytes))
    for k in range(n):
        part: dict[bytes, list[str]] = {}
        for r in pairs.where(F.pmod(F.xxhash64("w"), F.lit(n)) == k).select("item", "w").collect():
            part.setdefault(bytes(r.w), []).append(r.item)
        yield part


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of docs: id, hash of the text, words, runs of hit words, ids of the items met."""

    def scan(part: dict[bytes, list[str]]) -> DataFrame:
        shared, name = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex  # max_bytes at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = kept_automaton(name, shared)
            for b in batches:
                texts = texts_of(b.column(1))
                got = [hits_of(t, found) for t in texts]
                hashes = pa.array([xxhash.xxh64_intdigest(t.encode()) - 2**63 for t in texts], pa.int64())
                cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([id_array(ids_of(b.column(0))), hashes, *cols], ["doc_id", "text_hash", "n_words", "starts", "ends", "items"])

        return docs.select("doc_id", "text").mapInArrow(run, HITS)

    scans = [scan(p) for p in _parts(benchmark, docs, window, max_bytes)]
    if len(scans) == 1:
        return scans[0]
    rest = scans[1]
    for s in scans[2:]:
        rest = rest.unionByName(s)
    key = ["doc_id", "text_hash"]
    rest = rest.where(F.size("starts") > 0).groupBy(*key).agg(F.flatten(F.collect_set("items")).alias("i"), F.collect_set(F.struct("starts", "ends")).alias("runs"))
    both = scans[0].alias("a").join(rest.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    both = both.select("a.*", F.coalesce("b.runs", F.array()).alias("runs"), F.coalesce("b.i", F.array()).alias("more"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                spans = sorted([*zip(r["starts"], r["ends"], strict=True), *(p for x in r.pop("runs") for p in zip(x["starts"], x["ends"], strict=True))])
                r["starts"], r["ends"] = [], []
                for s, e in spans:
                    if r["ends"] and s <= r["ends"][-1]:
                        r["ends"][-1] = max(e, r["ends"][-1])
                    else:
                        r["starts"].append(s)
                        r["ends"].append(e)
                r["items"] = sorted({*r["items"], *r.pop("more")})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))

    return both.mapInArrow(merge, HITS)


def digest(hits: DataFrame) -> DataFrame:
    """Counts per document: words, hit words, items, SHA-256 of the items' ids joined by commas."""
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of docs that have no hit word, with all their columns."""
    for part in _parts(benchmark, docs, window, max_bytes):
        shared, name = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name, at=at) -> Iterator[pa.RecordBatch]:
            found = kept_automaton(name, shared)
            for b in batches:
                keep = [not hits_of(t, found)[1] for t in texts_of(b.column(at))]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
