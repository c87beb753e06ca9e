"""Removal of repeated byte strings across documents, by bucket-pointer refinement of suffix buckets.

Each byte covered by a string of `length` bytes that also starts in a document with a smaller id is
removed; overlaps count, and strings are judged on the input. Texts are UTF-8 bytes (null: empty);
matches never cross documents. What is kept may not be valid UTF-8 and so is binary.

Strings meet by minimiser (see superkmers). In a bucket, equal strings are settled as wholes, and
strings none of whose windows has a hash in common with another are let go. What is left is sorted
by suffix: buckets of 8-byte grams are refined by the bucket identifiers at later offsets, each
refinement building on the buckets of the one before, until buckets agree on `length` bytes.

Rows with the same id and text are copies of one document and give the same result; rows with the
same id and other texts don't remove from one another. A null id counts as the smallest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from huemill.llm import superkmers as sk
from huemill.llm.common import ragged

LENGTH = 50
GRAM = 8
#: Bytes of the first buckets.
Q = 8


def load(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The 8 bytes at each place as one number."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - 7,), f"{order}u8", np.ascontiguousarray(data), 0, (1,))


def _buckets(keys: np.ndarray) -> np.ndarray:
    """Bucket identifiers: the rank of each key, equal for equal keys."""
    return np.unique(keys, return_inverse=True)[1].reshape(-1).astype(np.uint64)


def refine(data: np.ndarray, depth: int) -> np.ndarray:
    """Bucket of each suffix of data with depth bytes at least, by its first depth bytes, in their order; depth >= 8."""
    pointers = _buckets(load(data, ">").astype(np.uint64))
    known = Q
    while known < depth:
        step = min(known, depth - known)
        n = len(data) - known - step + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        # sorted on the bucket identifier at a later offset, within each bucket
        pointers = _buckets((pointers[:n] << np.uint64(32)) | pointers[step : step + n])
        known += step
    return pointers[: max(0, len(data) - depth + 1)]


def suffix_array(text: bytes) -> np.ndarray:
    """Starts of all suffixes in order; a suffix sorts before those it is a prefix of."""
    n = len(text)
    pointers = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    known = 1
    while n and int(pointers.max()) < 2**32:
        later = np.zeros(n, np.uint64)
        later[: n - min(known, n)] = pointers[min(known, n) :]
        pointers = _buckets((pointers << np.uint64(32)) | later) + np.uint64(1)
        if int(pointers.max()) == n:
            break
        known *= 2
    return np.argsort(pointers, kind="stable")


def _bytes(data: np.ndarray, bounds: np.ndarray):
    wide = load(data)
    n = max(0, len(data) - GRAM + 1)
    grams = sk.mixed(wide[:n] * sk.C1)
    place = np.arange(len(data) + 1, dtype=np.int64)
    return data, bounds, place[:-1], place[1:], grams


def _compare(length: int):
    def compare(s: sk.Strings) -> list[tuple[np.ndarray, ...]]:
        """Removed ranges of the occurrences of strings that aren't repeats as a whole."""
        if not len(s.sizes):
            return []
        starts = np.cumsum(s.sizes) - s.sizes
        at = ragged(starts, s.counts)
        twin = sk.repeated_values(sk.range_hashes(s.data, at, at + length))
        which = np.unique(np.repeat(np.arange(len(s.sizes)), s.counts)[twin])
        if not len(which):
            return []
        s = s.take(which)
        starts = np.cumsum(s.sizes) - s.sizes
        owner = np.repeat(np.arange(len(s.sizes)), s.counts)
        at = ragged(starts, s.counts)
        bucket = refine(s.data, length)[at]
        least = np.full(len(s.sizes), np.iinfo(np.int64).max)
        np.minimum.at(least, s.of, s.doc)
        order = np.argsort(bucket, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = bucket[order][1:] != bucket[order][:-1]
        heads = np.flatnonzero(new)
        lowest = np.minimum.reduceat(least[owner[order]], heads)
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(lowest, np.diff(np.append(heads, len(order))))
        string, place, many = sk.run_ranges(first < least[owner], owner, at - starts[owner])
        if not len(string):
            return []
        # to every open occurrence of each string
        by = np.argsort(s.of, kind="stable")
        cuts = np.searchsorted(s.of[by], np.arange(len(s.sizes) + 1))
        n = np.diff(cuts)[string]
        occ = by[ragged(cuts[string], n)]
        return [(s.doc[occ], s.key[occ], s.at[occ] + np.repeat(place, n), np.repeat(many + length - 1, n))]

    return compare


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row per row of docs: bytes, bytes removed, the maximal removed runs (end exclusive), the bytes kept."""

    def finish(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        kept, at = [], 0
        for a, b in spans:
            kept.append(text[at:a])
            at = b
        kept.append(text[at:])
        return len(text), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], b"".join(kept)

    return sk.finished(sk.removed(docs, _bytes, _compare(length), length, GRAM, False), RESULT, finish)
