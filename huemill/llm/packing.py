"""Packing of tokenised documents into fixed sequences, shortest pack first over the length histogram.

Each document's ids end with an end id. A document of more than `length` ids is cut into full
pieces and a remainder. Only the histogram of the remainders (`length` numbers at most) reaches
the driver. There the lengths are placed longest first: the pieces of a length go to the pattern
with the fewest ids so far that has room (the shortest pack), as many as it has copies, and what
finds no room opens a pattern. Patterns with a count stand for all their copies, so the work
depends on the number of lengths, not of documents. Pieces then get their place by rank: pieces of
one length are numbered, and runs of ranks belong to the slots of patterns.

Ranks come from counts per length and hash bucket, so a hot length is never sorted in one task.
Ids are those of the byte-level BPE of the tokenizer file; chunks between single spaces are
encoded apart and kept in a bounded table, which gives the same ids, as a space followed by a
non-space always begins a pre-token. Texts with an added token's string go to the library whole.
New chunks of Latin letters, digits and marks are merged from the same vocabulary's rank file, which
costs less a call; others by the library.

Null and empty texts have the end id alone. Repeated rows are packed each. Other columns of the
input don't matter.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huemill.llm.common import id_array, ids_of, partitions, shared_checkpoint, texts_of

LENGTH = 1024
#: Characters that are white space to the tokenizer.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # for a character class
ODD = re.compile(f" [{SPACE}]| $")
CHUNK = re.compile(f" (?=[^{SPACE}])")
KEPT, KEPT_CHARS = 600_000, 48
#: Chunks whose ids the rank file gives just as the library does.
PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u024f]+").fullmatch


class ChunkIds(dict):
    """Packed little-endian 32-bit ids of a chunk that follows a space."""

    def __init__(self, tokenizer: tokenizers.Tokenizer, ranks: bytes | None = None):
        super().__init__()
        self.tokenizer, self.plain = tokenizer, None
        if ranks:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if self.plain is not None and PLAIN(chunk):
            found = array("I", self.plain.encode_ordinary(" " + chunk)).tobytes()
        else:
            found = self.ids(" " + chunk)
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[chunk] = found
        return found

    def of(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self.ids(text)
        parts = CHUNK.split(text) if ODD.search(text) else text.split(" ")
        if not parts[0]:
            return b"".join(map(self.__getitem__, parts[1:]))
        return self.ids(parts[0]) + b"".join(map(self.__getitem__, parts[1:]))


@lru_cache(maxsize=1)
def chunk_ids(spec: str, ranks: bytes | None) -> ChunkIds:
    """Kept by a worker from task to task."""
    return ChunkIds(tokenizers.Tokenizer.from_str(spec), ranks)


PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = 0, rank_file: str | None = None) -> DataFrame:
    """A row per piece of each document. rank_file: of the same vocabulary; with a tokenizer of one's own there is none by default."""
    rank_file = rank_file or (None if tokenizer else public_tokenizers.path("byte_bpe_50k.tiktoken"))
    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json")) as f:
        spec = f.read()
    ranks = None
    if rank_file:
        with open(rank_file, "rb") as g:
            ranks = g.read()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_ids(spec, ranks)
        for b in batches:
            rows: list[tuple[int, int, int, int]] = []
            for k, text in enumerate(texts_of(b.column(1))):
                ids = chunks.of(text) + end
                total = len(ids) // 4
                for start in range(0, total, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((k, start, len(piece) // 4, zlib.crc32(piece), total))
            doc, start, n, crc, total = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
            yield pa.RecordBatch.from_arrays([id_array(ids_of(b.column(0))[doc]), pa.array(start), pa.array(n.astype(np.int32)), pa.array(crc), pa.array(total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def patterns_of(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """(copies, [(piece length, times)]) of each packing pattern, shortest pack first."""
    open_packs: list[tuple[int, int]] = []  # (ids so far, number), shortest first
    packs: dict[int, tuple[int, list[tuple[int, int]]]] = {}
    made = 0

    def add(copies: int, parts: list[tuple[int, int]]) -> None:
        nonlocal made
        used = sum(n * k for n, k in parts)
        packs[made] = (copies, parts)
        if used < length:
            insort(open_packs, (used, made))
        made += 1

    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            if not open_packs or open_packs[0][0] + n > length:
                times = 1
                add(left, [(n, times)])
                break
            used, number = open_packs[0]
            copies, parts = packs[number]
            # several pieces of this length at once, while the pack stays the shortest
            following = open_packs[1][0] if len(open_packs) > 1 else used
            times = max(1, min((length - used) // n, (following - used) // n, left // copies))
            open_packs.pop(0)
            del packs[number]
            taken = min(copies, left // times)
            if parts[-1][0] == n:
                grown = [*parts[:-1], (n, parts[-1][1] + times)]
            else:
                grown = [*parts, (n, times)]
            if taken < copies:
                add(copies - taken, parts)
            add(taken, grown)
            left -= taken * times
    return list(packs.values())


def slots_of(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """(piece length, first rank, end rank, times, first sequence, offset): piece r has copy and place divmod(r - first, times)."""
    rows, sequence, rank = [], 0, dict.fromkeys(histogram, 0)
    for copies, parts in patterns_of(histogram, length):
        offset = 0
        for n, times in parts:
            rows.append((n, rank[n], rank[n] + copies * times, times, sequence, offset))
            rank[n] += copies * times
            offset += n * times
        sequence += copies
    return rows


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """The pieces with their sequence, their offset there, the sequence's ids and what it is padded to."""
    spark = docs.sparkSession
    pieces = shared_checkpoint(cut(docs, length, tokenizer, end_id))
    buckets = 4 * partitions(spark)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    # length x buckets rows at most, and both are bounded
    counts = pieces.groupBy("length", "bucket").count()
    base = counts.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = slots_of(histogram, length)
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own"))
    spec = "length int, first long, last long, times long, sequence long, at long"
    table = spark.createDataFrame(slots, spec)
    # patterns x distinct lengths in one: bounded by the sequence length, whatever the input
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    turn = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "start", ranked["length"].cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(turn / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + (turn % F.col("times")) * ranked["length"]).cast("long").alias("offset"),
    )
