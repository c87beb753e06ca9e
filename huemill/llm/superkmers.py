"""Exchange of all windows of a corpus as super-k-mers: the base of both repeated-passage operators.

A window is `span` consecutive symbols (bytes or words) of one document. Its minimiser is the least
hash of the grams of `gram` symbols in it, so equal windows have equal minimisers. Consecutive
windows with one minimiser travel as one packed string to the bucket of that minimiser; every
window is in exactly one string, and all equal windows meet in one bucket.

There are as many buckets as keep the text of each bounded on average, however few partitions a session has, and
a task has one bucket. The windows of one frequent gram all meet in one, whatever their number: strings beyond
HELD bytes wait in a temporary file, and what is too much to compare at once is cut again by the minimisers of
another order of grams, which equal windows share too. A sending task works on slabs of its input of bounded size. In a slab, equal strings are sent once: a later
copy whose windows all have an earlier equal in the slab is decided on the spot. So a passage that
a third of all documents share reaches its bucket once per slab, not once per document.

Strings are compared byte by byte wherever a hash says they are equal; hashes only ever rule out.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huemill.llm.common import bytes_of, gather, id_array, ids_of, partitions, ragged, slices

#: Bytes of text hashed at a time, and bytes of text whose strings are exchanged together.
CHUNK, SLAB = 1 << 20, 12 << 20
#: Bytes of text whose strings share a bucket, and bytes of texts that are finished together, at most on average.
STRINGS, TEXTS = 8 << 20, 12 << 20
#: Windows in one string at most; a longer run is cut.
LONGEST = 512
#: Windows, and bytes of their strings, compared at a time in a bucket.
WINDOWS, BYTES = 600_000, 2 << 20
#: Bytes of a bucket's strings and occurrences that a task holds, its pieces in a file, and the orders of grams by which windows of one minimiser are told apart.
HELD, PIECES, ORDERS = 56 << 20, 64, 4
#: Ranges that are sent on together.
RANGES = 1 << 19

_u64 = np.uint64
C1, C2, C3 = _u64(0x9E3779B97F4A7C15), _u64(0xC2B2AE3D27D4EB4F), _u64(0x165667B19E3779F9)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * _u64(2) + _u64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _u64(32))
    h *= C1
    h ^= h >> _u64(29)
    h *= C2
    h ^= h >> _u64(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes, in O(1) each after one pass."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * C3)


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    m, size = g, 1
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(grams: np.ndarray, bounds: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, minimiser and document of each super-k-mer.

    grams[i] is the hash of the gram that starts at symbol i; bounds are the documents' bounds in symbols.
    """
    n = int(bounds[-1]) - span + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, np.uint64), none
    least = sliding_min(grams, span - gram + 1)[:n]
    out = np.zeros(n + 1, np.int32)  # windows that would cross into the next document
    lo = np.minimum(np.maximum(bounds[:-1], bounds[1:] - span + 1), n)
    np.add.at(out, lo, 1)
    np.add.at(out, np.minimum(bounds[1:], n), -1)
    valid = np.cumsum(out[:n]) == 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    ends_here = valid.copy()
    ends_here[:-1] &= ~valid[1:] | new[1:]
    starts, ends = np.flatnonzero(new), np.flatnonzero(ends_here) + 1
    counts = ends - starts
    if len(counts) and counts.max() > LONGEST:
        cuts = -(-counts // LONGEST)
        part = ragged(np.zeros(len(cuts), np.int64), cuts)
        starts = np.repeat(starts, cuts) + part * LONGEST
        counts = np.minimum(LONGEST, np.repeat(ends, cuts) - starts)
    return starts, counts, least[starts], np.searchsorted(bounds, starts, side="right") - 1


def pack(*arrays: np.ndarray, level: int = 6) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), np.dtype(a.dtype).num))], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), level)


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of consecutive values modulo 2**32, which compress better than the values."""
    return np.diff(values.astype(np.uint32), prepend=np.uint32(0))


def summed(differences: np.ndarray) -> np.ndarray:
    """The inverse of steps."""
    return np.cumsum(differences, dtype=np.uint32).astype(np.int64)


_TYPES = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.uint64, np.int64)}


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 * (1 + 2 * n), []
    for k in range(n):
        kind = _TYPES[int(head[2 * k + 1])]
        out.append(np.frombuffer(raw, kind, int(head[2 * k]), at))
        at += int(head[2 * k]) * kind.itemsize
    return out


@dataclass
class Strings:
    """Strings and where they occur; places are in symbols."""

    data: np.ndarray  # bytes of all strings, one after the other
    sizes: np.ndarray  # bytes of each
    counts: np.ndarray  # windows of each
    tags: np.ndarray  # 8 bits of the minimiser of each
    of: np.ndarray  # string of each occurrence
    doc: np.ndarray  # document id of each occurrence
    key: np.ndarray  # hash of the document's text
    at: np.ndarray  # first symbol

    def take(self, which: np.ndarray) -> Strings:
        """Some strings, in order of which, with their occurrences."""
        starts = np.cumsum(self.sizes) - self.sizes
        data = gather(self.data, starts[which], self.sizes[which])
        new = np.full(len(self.sizes), -1, np.int64)
        new[which] = np.arange(len(which))
        mine = np.flatnonzero(new[self.of] >= 0)
        return Strings(data, self.sizes[which], self.counts[which], self.tags[which], new[self.of[mine]], self.doc[mine], self.key[mine], self.at[mine])

    def room(self) -> int:
        """Bytes that it takes."""
        return len(self.data) + 24 * len(self.sizes) + 32 * len(self.of)

    def dealt(self, n: int) -> Iterator[tuple[int, Strings]]:
        """The strings by their tag modulo n."""
        own = self.tags.astype(np.int64) % n
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(n + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield k, self.take(order[cuts[k] : cuts[k + 1]])


def joined(parts: list[Strings]) -> Strings:
    shift = np.cumsum([0, *(len(p.sizes) for p in parts)])
    cat = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return Strings(cat("data"), cat("sizes"), cat("counts"), cat("tags"), np.concatenate([p.of + s for p, s in zip(parts, shift, strict=False)]), cat("doc"), cat("key"), cat("at"))


def classes(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Class of each string: equal for equal bytes only."""
    starts = np.cumsum(sizes) - sizes
    h = np.empty(len(sizes), np.uint64)
    a = 0
    while a < len(sizes):  # in blocks of bounded size
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + BYTES, side="right")) - 1)
        lo, hi = starts[a], starts[b - 1] + sizes[b - 1]
        h[a:b] = range_hashes(data[lo:hi], starts[a:b] - lo, starts[a:b] + sizes[a:b] - lo)
        a = b
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    leader = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    check = np.flatnonzero(order != leader)
    mine, first = order[check], leader[check]
    odd = sizes[mine] != sizes[first]
    same = np.flatnonzero(~odd)
    if len(same):
        n = sizes[mine[same]]
        differ = gather(data, starts[mine[same]], n) != gather(data, starts[first[same]], n)
        odd[same] = np.logical_or.reduceat(differ, np.cumsum(n) - n)
    found = np.empty(len(h), np.int64)
    found[order] = leader
    if odd.any():  # strings of one hash that aren't equal
        seen: dict[bytes, int] = {}
        groups = {*found[mine[odd]].tolist()}
        for k in np.flatnonzero(np.isin(found, list(groups))).tolist():
            found[k] = seen.setdefault(data[starts[k] : starts[k] + sizes[k]].tobytes(), k)
    return found


def settle(s: Strings, self_repeats: bool, span: int) -> tuple[Strings, tuple[np.ndarray, ...]]:
    """One string of each class with the occurrences that stay open; ranges of those that are repeats as a whole.

    An occurrence is a repeat if its string occurs in a document with a smaller id, or, with
    self_repeats, earlier in the same document.
    """
    if not len(s.sizes):
        return s, (np.zeros(0, np.int64),) * 4
    cls = classes(s.data, s.sizes)[s.of]
    order = np.lexsort((s.at, s.key, s.doc, cls))
    c, doc, key, at = cls[order], s.doc[order], s.key[order], s.at[order]
    head = np.ones(len(order), bool)
    head[1:] = c[1:] != c[:-1]
    group = np.cumsum(head) - 1
    repeat = doc > doc[np.flatnonzero(head)][group]
    if self_repeats:
        own = head.copy()
        own[1:] |= (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        repeat |= at > at[np.flatnonzero(own)][np.cumsum(own) - 1]
    gone = order[repeat]
    ranges = (s.doc[gone], s.key[gone], s.at[gone], s.counts[s.of[gone]].astype(np.int64) + span - 1)
    left = np.sort(order[~repeat])
    kept = np.unique(cls)
    rest = Strings(s.data, s.sizes, s.counts, s.tags, cls[left], s.doc[left], s.key[left], s.at[left])
    return rest.take(kept), ranges


def repeated_values(h: np.ndarray) -> np.ndarray:
    """Mask of the values that occur more than once."""
    order = np.argsort(h)
    twin = h[order][1:] == h[order][:-1]
    mask = np.zeros(len(h), bool)
    mask[order[1:][twin]] = True
    mask[order[:-1][twin]] = True
    return mask


def run_ranges(flags: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of flagged windows with consecutive places of one owner: owner, first place, length."""
    on = np.flatnonzero(flags)
    if not len(on):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(on), bool)
    new[1:] = (np.diff(on) != 1) | (owner[on][1:] != owner[on][:-1]) | (np.diff(place[on]) != 1)
    first = np.flatnonzero(new)
    return owner[on[first]], place[on[first]], np.diff(np.append(first, len(on)))


#: What a kind of symbol needs: texts' bytes and bounds -> (bytes to send, their bounds in symbols,
#: first byte of each symbol and end, gram hashes); and the exact comparison of open strings.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
Compare = Callable[[Strings], list[tuple[np.ndarray, ...]]]



def recut(s: Strings, symbols: Symbols, span: int, gram: int, order: int) -> Iterator[Strings]:
    """The same windows as super-k-mers of another order of grams, in blocks; a tag has 8 bits of the new minimiser."""
    by = np.argsort(s.of, kind="stable")
    cuts = np.searchsorted(s.of[by], np.arange(len(s.sizes) + 1))
    ends = np.concatenate([[0], np.cumsum(s.sizes)])
    i = 0
    while i < len(s.sizes):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, side="right")) - 1)
        body, bounds, first, last, grams = symbols(s.data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        starts, counts, least, owner = runs(mixed(grams + _u64(order) * C3), bounds, span, gram)
        a, b = first[starts], last[starts + counts + span - 2]
        n = np.diff(cuts)[i + owner]
        occ = by[ragged(cuts[i + owner], n)]
        yield Strings(gather(body, a, b - a), b - a, counts, (mixed(least) & _u64(0xFF)).astype(np.uint8), np.repeat(np.arange(len(starts)), n), s.doc[occ], s.key[occ], s.at[occ] + np.repeat(starts - bounds[owner], n))
        i = j


class Pieces:
    """Strings by piece in a file without a name, which goes with the task."""

    def __init__(self) -> None:
        self.file, self.places = tempfile.TemporaryFile(), {}  # noqa: SIM115

    def add(self, name: tuple[int, ...], s: Strings) -> None:
        blob = pack(s.data, s.sizes.astype(np.uint32), s.counts.astype(np.uint16), s.tags, steps(s.of), s.doc, s.key, steps(s.at), level=1)
        self.places.setdefault(name, []).append((self.file.seek(0, 2), len(blob), s.room()))
        self.file.write(blob)

    def room(self, name: tuple[int, ...]) -> int:
        return sum(r for *_, r in self.places[name])

    def take(self, name: tuple[int, ...]) -> Iterator[Strings]:
        for at, size, _ in self.places.pop(name):
            self.file.seek(at)
            data, sizes, counts, tags, of, doc, key, place = unpack(self.file.read(size))
            yield Strings(data, sizes.astype(np.int64), counts.astype(np.int64), tags, summed(of), doc, key, summed(place))


def _repeats(arriving: Iterator[Strings], symbols: Symbols, compare: Compare, span: int, gram: int, self_repeats: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Ranges of the repeats among a bucket's strings, whatever their number, in bounded room."""
    pieces: Pieces | None = None

    def solved(s: Strings, order: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Of strings that fit in a task. Those of too many windows are cut by the next order."""
        s, gone = settle(s, self_repeats, span)
        yield gone
        n = max(-(-int(s.counts.sum()) // WINDOWS), -(-len(s.data) // BYTES))
        if n <= 2 or order > ORDERS:
            yield from compare(s)
            return
        finer = joined(list(recut(s, symbols, span, gram, order)))
        del s
        for _, part in finer.dealt(min(256, 2 * n)):
            yield from solved(part, order + 1)

    def drained(parts: list[Strings]) -> Iterator[Strings]:
        while parts:
            yield parts.pop()

    def together(parts: Iterable[Strings], order: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Of parts that fit, or that no order tells apart: then equal strings are settled whenever the parts have doubled."""
        held, room, limit = [], 0, HELD
        for s in parts:
            held.append(s)
            room += s.room()
            if room > limit:
                s, gone = settle(joined(list(drained(held))), self_repeats, span)
                yield gone
                held, room = [s], s.room()
                limit = max(HELD, 2 * room)
        if held:
            s = joined(held)
            held.clear()
            n = max(1, -(-int(s.counts.sum()) // WINDOWS), -(-len(s.data) // BYTES))
            for _, part in s.dealt(min(256, n)):
                yield from solved(part, order)

    def stored(name: tuple[int, ...]) -> Iterator[tuple[np.ndarray, ...]]:
        """Of a piece of the file: as it is, if it fits, else cut by the next order into pieces of its own."""
        if pieces.room(name) <= HELD or len(name) > ORDERS:
            yield from together(pieces.take(name), len(name))
            return
        finer: set[tuple[int, ...]] = set()
        for s in pieces.take(name):
            for block in recut(s, symbols, span, gram, len(name)):
                block, gone = settle(block, self_repeats, span)
                yield gone
                for k, part in block.dealt(PIECES):
                    pieces.add((*name, k), part)
                    finer.add((*name, k))
        for part in sorted(finer):
            yield from stored(part)

    held, room = [], 0
    for s in arriving:
        held.append(s)
        room += s.room()
        if room > HELD:
            pieces = pieces or Pieces()
            s, gone = settle(joined(list(drained(held))), self_repeats, span)
            yield gone
            for k, part in s.dealt(PIECES):
                pieces.add((k,), part)
            room = 0
    if pieces is None:
        yield from together(drained(held), 1)
        return
    if held:
        for k, part in joined(held).dealt(PIECES):
            pieces.add((k,), part)
        held.clear()
    for name in sorted(pieces.places):
        yield from stored(name)


ROWS = "bucket int, kind byte, blob binary"


def _rows(buckets: list[int], kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([kind] * len(buckets), pa.int8()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])


def _range_rows(ranges: list[tuple[np.ndarray, ...]], n: int) -> Iterator[pa.RecordBatch]:
    """Ranges packed by the bucket of their document."""
    if not ranges:
        return
    doc, key, at, size = (np.concatenate(x) for x in zip(*ranges, strict=True))
    bucket = mixed(doc.astype(np.uint64)) % _u64(n)
    order = np.lexsort((at, key, doc, bucket))
    doc, key, at, end, bucket = doc[order], key[order], at[order], (at + size)[order], bucket[order]
    if len(doc):  # ranges that meet become one
        apart = np.ones(len(doc), bool)
        apart[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] > end[:-1])
        heads = np.flatnonzero(apart)
        doc, key, at, bucket, end = doc[heads], key[heads], at[heads], bucket[heads], np.maximum.reduceat(end, heads)
    size, order = end - at, np.arange(len(doc))
    cuts = np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))
    found = [k for k in range(n) if cuts[k] < cuts[k + 1]]
    blobs = []
    for k in found:
        i = order[cuts[k] : cuts[k + 1]]
        new = np.ones(len(i), bool)
        new[1:] = (doc[i][1:] != doc[i][:-1]) | (key[i][1:] != key[i][:-1])
        heads = np.flatnonzero(new)
        blobs.append(pack(doc[i][heads], key[i][heads], np.diff(np.append(heads, len(i))).astype(np.uint32), steps(at[i]), size[i].astype(np.uint32)))
    if found:
        yield _rows(found, 1, blobs)


def text_keys(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of each text; with the id it tells rows of one id apart."""
    view = memoryview(np.ascontiguousarray(data))
    return np.array([xxhash.xxh64_intdigest(view[a:b]) - 2**63 for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.int64)


def buckets_of(docs: DataFrame) -> tuple[int, int]:
    """Buckets of strings and of documents: what the session's partitions ask for, or more, so that a bucket's text is bounded."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = partitions(docs.sparkSession)  # strings take about three times the room of their texts
    return max(2 * n, -(-size // STRINGS)), max(n, -(-size // TEXTS))


def removed(docs: DataFrame, symbols: Symbols, compare: Compare, span: int, gram: int, self_repeats: bool) -> DataFrame:
    """Packed ranges (in symbols) of repeated windows, and the texts, by bucket of the document; kinds 1 and 2."""
    docs = docs.select("doc_id", "text")
    m, n = buckets_of(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[Strings, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            s = joined([x for x, _ in held])
            buckets = np.concatenate([b for _, b in held])
            held.clear()
            # buckets of strings follow their minimisers, which equal strings share
            s.tags = s.tags.astype(np.uint64) | (buckets.astype(np.uint64) << _u64(8))
            s, ranges = settle(s, self_repeats, span)
            own = (s.tags >> _u64(8)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            s = s.take(order)
            own = own[order]
            s.tags = (s.tags & _u64(0xFF)).astype(np.uint8)
            cuts = np.searchsorted(own, np.arange(m + 1))
            by = np.argsort(s.of, kind="stable")
            s.of, s.doc, s.key, s.at = s.of[by], s.doc[by], s.key[by], s.at[by]
            marks = np.searchsorted(s.of, cuts)
            ends = np.concatenate([[0], np.cumsum(s.sizes)])
            found = [k for k in range(m) if cuts[k] < cuts[k + 1]]
            blobs = []
            for k in found:
                a, b, i, j = cuts[k], cuts[k + 1], marks[k], marks[k + 1]
                ids, place = np.unique(np.stack([s.doc[i:j], s.key[i:j]]), axis=1, return_inverse=True)
                blobs.append(pack(s.data[ends[a] : ends[b]], (s.sizes[a:b] - s.counts[a:b]).astype(np.uint32), s.counts[a:b].astype(np.uint16), s.tags[a:b], steps(s.of[i:j] - a), ids[0], ids[1], steps(place.reshape(-1)), steps(s.at[i:j])))
            if found:
                yield _rows(found, 0, blobs)
            yield from _range_rows([ranges], n)

        for batch in slices(batches, 1, CHUNK):
            data, bounds = bytes_of(batch.column(1))
            if not len(data):
                continue
            keys, ids = text_keys(data, bounds), ids_of(batch.column(0))
            body, doc_bounds, first, last, grams = symbols(data, bounds)
            starts, counts, least, owner = runs(grams, doc_bounds, span, gram)
            if not len(starts):
                continue
            a, b = first[starts], last[starts + counts + span - 2]
            strings = Strings(gather(body, a, b - a), b - a, counts, (least & _u64(0xFF)).astype(np.uint8), np.arange(len(starts)), ids[owner], keys[owner], starts - doc_bounds[owner])
            held.append((strings, (mixed(least >> _u64(8)) % _u64(m)).astype(np.int64)))
            size += len(data)
            if size >= SLAB:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def strings() -> Iterator[Strings]:
            for batch in batches:
                for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if kind == 1:  # ranges that a slab has decided travel on
                        doc, key, many, at, size = unpack(blob.as_buffer())
                        decided.append((np.repeat(doc, many), np.repeat(key, many), summed(at), size.astype(np.int64)))
                        continue
                    data, sizes, counts, tags, of, doc, key, place, at = unpack(blob.as_buffer())
                    counts, place = counts.astype(np.int64), summed(place)
                    yield Strings(data, sizes.astype(np.int64) + counts, counts, tags, summed(of), doc[place], key[place], summed(at))

        decided: list[tuple[np.ndarray, ...]] = []
        ranges, many = [], 0
        for found in _repeats(strings(), symbols, compare, span, gram, self_repeats):
            ranges.append(found)
            many += len(found[0])
            if many >= RANGES:
                yield from _range_rows(ranges, n)
                ranges, many = [], 0
        yield from _range_rows(ranges, n)
        yield from _range_rows(decided, n)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLAB):
            data, bounds = bytes_of(batch.column(1))
            ids, keys = ids_of(batch.column(0)), text_keys(data, bounds)
            bucket = (mixed(ids.astype(np.uint64)) % _u64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n + 1))
            size = np.diff(bounds)
            found = [k for k in range(n) if cuts[k] < cuts[k + 1]]
            blobs = []
            for k in found:
                i = order[cuts[k] : cuts[k + 1]]
                blobs.append(pack(ids[i], keys[i], size[i], gather(data, bounds[:-1][i], size[i])))
            yield _rows(found, 2, blobs)

    met = docs.mapInArrow(send, ROWS).repartitionById(m, "bucket").mapInArrow(solve, ROWS)
    return met.unionByName(docs.mapInArrow(texts, ROWS)).repartitionById(n, "bucket")


def finished(packed: DataFrame, schema: str, finish: Callable[[bytes, list[tuple[int, int]]], tuple]) -> DataFrame:
    """A row per document from its bytes and its merged removed ranges (in symbols, end exclusive)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: list[tuple[np.ndarray, ...]] = []
        waiting: list[bytes] = []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind == 1:
                    doc, key, many, at, size = unpack(blob.as_buffer())
                    spans.append((np.repeat(doc, many), np.repeat(key, many), summed(at), size.astype(np.int64)))
                else:
                    waiting.append(blob.as_py())
        place: dict[tuple[int, int], tuple[int, int]] = {}
        if spans:
            doc, key, at, size = (np.concatenate(x) for x in zip(*spans, strict=True))
            order = np.lexsort((at, key, doc))
            doc, key, at, end = doc[order], key[order], at[order], (at + size)[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
            heads = np.flatnonzero(new)
            place = {k: (i, j) for k, i, j in zip(zip(doc[heads].tolist(), key[heads].tolist(), strict=True), heads.tolist(), np.append(heads[1:], len(doc)).tolist(), strict=True)}
        for blob in waiting:
            ids, keys, sizes, data = unpack(blob)
            ends = np.cumsum(sizes)
            rows = []
            for i, k, a, b in zip(ids.tolist(), keys.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                merged: list[tuple[int, int]] = []
                if (i, k) in place:
                    x, y = place[i, k]
                    reach = np.maximum.accumulate(end[x:y])
                    cut = np.flatnonzero(at[x + 1 : y] > reach[:-1]) + 1
                    lo, hi = at[x:y][np.append(0, cut)], reach[np.append(cut - 1, y - x - 1)]
                    merged = list(zip(lo.tolist(), hi.tolist(), strict=True))
                rows.append(finish(data[a:b].tobytes(), merged))
            cols = [id_array(ids), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return packed.mapInArrow(run, schema)


