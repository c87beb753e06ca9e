"""Groups of documents whose sets of word shingles are similar, by a parity-sketch join.

Words are runs of other characters than white space (ASCII), A-Z lower-cased. A document's set
holds its distinct `size`-word shingles; with fewer words the whole sequence is the one element;
without words it is empty and linked with nothing. Two documents link when
100 * |A & B| >= percent * |A | B|. Sets are of 64-bit hashes.

Sketches. An element is hashed to one of k cells, and each cell holds the XOR of its elements'
hashes. An element in just one of two sets changes one cell at most, so the number of differing
cells is a lower bound of the symmetric difference, which linked sets of sizes a and b bound by
D = (a + b)(1 - t) / (1 + t). Sizes fall into bands such that linked sets are in one band or
adjacent ones, and a document joins under the k of its own band and of the next. There are about
twice as many cells as D. Of its f filled cells a document sends only the D + 1 rarest, in one
order for all documents: a partner differs in D cells at most, so the rarest shared cell is among
them on both sides (pigeonhole). What a group of near copies or a common passage has in common goes
last in that order: a bounded list of frequent cells, counted over all documents; any order is right.

A set with D filled cells or fewer could lose a link, and then only with another such set; these go
on to a next level under another hash, and at the last to a prefix of their least hashes.

The same hashes fill a sketch of parity bits, about two an element. The Hamming distance of two of
these is a lower bound of the symmetric difference too; it rules out most candidate pairs before a
text is fetched. A longer sketch folds to the length of a shorter one.

Candidates. Cells that few documents share give all their pairs; a cell that more share gives a star
around the document with most frequent cells, and stays on record. Each document's best candidate is
verified first, by the whole sets; then the other candidates between different components. Then the
documents of a cell on record that are still in different components are compared by their bits, in
blocks of bounded size, and what these leave is verified. No link between different components is left out.

Equal sets of a slab are sketched once. Rows with one id are one document: its links are those of any
of its rows. A row with a null id is linked with nothing, and its component is null. Other columns
don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huemill.llm import superkmers as sk
from huemill.llm.common import NULL_ID, bytes_of, fresh, id_array, ids_of, partitions, ragged, shared_checkpoint, slices
from huemill.llm.components import components
from huemill.llm.passage_dedup import word_ranges
from huemill.llm.superkmers import mixed, pack, unpack

SIZE, PERCENT = 5, 75
#: Cells for each element that linked sets may differ in.
CELLS = 2
#: Frequent cells on the list that orders cells, and the least number of a slab's documents that share one.
HOT_LIST, HOT_LEAST = 1 << 18, 2
#: Documents that share a cell give all their pairs up to so many of them.
FEW = 16
LEVELS = 4
#: Documents of one cell compared at a time with each other, or with as many others.
BLOCK = 2048
#: Bits of the map of wanted documents: for each document, and at least and at most as a power of two.
ROOM, LEAST_BITS, MOST_BITS = 8, 10, 25
#: Bytes of text in one slab, where sets are exchanged and where cells are counted.
SLAB, COUNTED = 6 << 20, 6 << 20
_u64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _ranges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def shingles(data: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts, each sorted, one after the other; and their sizes."""
    data = _LOWER[data]
    first, last, at = word_ranges(data, bounds)
    h = sk.range_hashes(data, first, last)
    n = max(0, len(h) - size + 1)
    s = np.zeros(n, np.uint64)
    for k in range(size):
        s = s * sk.C1 + h[k : k + n]
    s = mixed(s)
    many = np.diff(at)
    count = np.where(many >= size, many - size + 1, np.minimum(many, 1))
    flat = s[np.minimum(ragged(at[:-1], count), n - 1)] if n else np.zeros(int(count.sum()), np.uint64)
    ends = np.cumsum(count)
    for k in np.flatnonzero((many > 0) & (many < size)).tolist():
        x = _u64(many[k])
        for w in h[at[k] : at[k + 1]]:
            x = mixed(np.array([x], np.uint64) * sk.C2 + w)[0]
        flat[ends[k] - 1] = x
    for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
        if b > a + 1:
            flat[a:b].sort()
    owner = np.repeat(np.arange(len(count)), count)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[new], np.bincount(owner[new], minlength=len(count))


def bands(percent: int = PERCENT, most: int = 1 << 40) -> np.ndarray:
    """Least size of each band: linked sets are in one or in adjacent ones."""
    sizes = [1]
    while sizes[-1] < most:
        sizes.append(max(sizes[-1] + 1, -(-sizes[-1] * 100 // percent)))
    return np.array(sizes, np.int64)


def cells_of(band: np.ndarray, percent: int, sizes: np.ndarray) -> np.ndarray:
    """Cells of a band."""
    return CELLS * (2 * (sizes[band + 1] - 1) * (100 - percent) // (100 + percent)) + 1


def reach_of(n: np.ndarray, up: int, percent: int, sizes: np.ndarray) -> np.ndarray:
    """The symmetric difference from the largest partner that a set can have in its own band (up 0) or in the next (up 1)."""
    band = np.searchsorted(sizes, n, side="right") - 1 + up
    return (n + np.minimum(n * 100 // percent, sizes[band + 1] - 1)) * (100 - percent) // (100 + percent)


def _filled(h: np.ndarray, owner: np.ndarray, place: np.ndarray, band: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of each filled cell; elements come in the order of their sets and cells."""
    new = np.ones(len(h), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    doc = owner[heads]
    tag = mixed((band[doc].astype(np.uint64) << _u64(8)) + _u64(level) + place[heads] * sk.C1)
    return doc, mixed((np.bitwise_xor.reduceat(h, heads) if len(heads) else h) ^ tag)


def first_cells(flat: np.ndarray, n: np.ndarray, up: int, percent: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of each filled cell at the first level. A cell is a range of hashes, and sets are sorted."""
    band = np.searchsorted(sizes, n, side="right") - 1 + up
    owner = np.repeat(np.arange(len(n)), n)
    place = (flat >> _u64(32)) * cells_of(band, percent, sizes).astype(np.uint64)[owner] >> _u64(32)
    return _filled(mixed(flat * sk.C3), owner, place, band, 0)


def later_cells(flat: np.ndarray, n: np.ndarray, who: np.ndarray, up: int, percent: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) at the later levels of the sets that fill too few cells at the first."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    band = np.searchsorted(sizes, n, side="right") - 1 + up
    k, reach, start = cells_of(band, percent, sizes), reach_of(n, up, percent, sizes), _ranges(n)
    left = np.flatnonzero(who)
    for level in range(1, LEVELS):
        if not len(left):
            break
        owner, h = np.repeat(left, n[left]), flat[ragged(start[left], n[left])]
        h = mixed(h ^ _u64((0x5851F42D4C957F2D * (2 * level + 1)) % 2**64))
        place = h % k[owner].astype(np.uint64)
        order = np.lexsort((place, owner))
        found.append(_filled(mixed(h[order] * sk.C3), owner[order], place[order], band, level))
        left = left[np.bincount(found[-1][0], minlength=len(n))[left] <= reach[left]]
    if len(left):
        prefix = n[left] - -(-percent * n[left] // 100) + 1
        doc = np.repeat(left, prefix)
        found.append((doc, mixed(flat[ragged(start[left], prefix)] ^ mixed(band[doc].astype(np.uint64) * sk.C2 + _u64(99)))))
    return np.concatenate([d for d, _ in found]), np.concatenate([x for _, x in found])


class Frequent:
    """The listed cells, the more frequent the higher their rank."""

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.uint64)

    def order(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """44 bits to sort cells by, the rarest first; and whether each is on the list."""
        if not len(self.keys):
            return key >> _u64(21), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        listed = self.keys[at] == key
        return np.where(listed, self.rank[at] + _u64(1 << 43), key >> _u64(21)), listed


def sketch(flat: np.ndarray, n: np.ndarray, frequent: Frequent, percent: int = PERCENT, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Join keys of non-empty sets: (set, up, key), and the share of frequent cells of each set in 255ths."""
    sizes = bands(percent) if sizes is None else sizes
    docs, ups, keys, hot, all_ = [], [], [], np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for up in (0, 1):
        doc, key = first_cells(flat, n, up, percent, sizes)
        filled, reach = np.bincount(doc, minlength=len(n)), reach_of(n, up, percent, sizes)
        order, listed = frequent.order(key)
        hot += np.bincount(doc[listed], minlength=len(n))
        all_ += filled
        order += doc.astype(np.uint64) << _u64(44)
        last = np.sort(order)[np.cumsum(filled) - filled + np.minimum(filled - 1, reach)] if len(n) else order
        keep = order <= last[doc]
        more, late = later_cells(flat, n, filled <= reach, up, percent, sizes)
        docs += [doc[keep], more]
        keys += [key[keep], late]
        ups.append(np.full(int(keep.sum()) + len(more), up, np.int64))
    return np.concatenate(docs), np.concatenate(ups), np.concatenate(keys), 255 * hot // np.maximum(1, all_)


def bits_of(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of each set as bytes, one set after the other; and the bytes of each."""
    size = np.maximum(8, 1 << np.rint(np.log2(np.maximum(1, 2 * n))).astype(np.int64) >> 3)
    at = _ranges(8 * size)
    place = np.repeat(at[:-1], n) + (mixed(flat * sk.C2) & np.repeat(8 * size - 1, n).astype(np.uint64)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=int(at[-1])).astype(np.uint8) & 1, bitorder="little"), size


def folded(bits: list[bytes], size: int) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words, folded to size bytes."""
    rows = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1, size // 8)
    return np.bitwise_xor.reduce(rows, axis=1)


def distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Hamming distances of sketches, pair by pair."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(sizes), np.int64)
    for x, y in np.unique(sizes, axis=0).tolist():
        who = np.flatnonzero((sizes == (x, y)).all(axis=1))
        one, two = folded([left[k] for k in who], min(x, y)), folded([right[k] for k in who], min(x, y))
        out[who] = np.bitwise_count(one ^ two).sum(axis=1)
    return out


def _slabs(batches: Iterator[pa.RecordBatch], size: int, room: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, sets and sizes of sets of a slab of documents."""
    ids, sets, many, held = [], [], [], 0
    for batch in slices(batches, 1, sk.CHUNK):
        data, bounds = bytes_of(batch.column(1))
        flat, n = shingles(data, bounds, size)
        ids.append(ids_of(batch.column(0)))
        sets.append(flat)
        many.append(n)
        held += len(data) + 64 * len(bounds)
        if held >= room:
            yield np.concatenate(ids), np.concatenate(sets), np.concatenate(many)
            ids, sets, many, held = [], [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(sets), np.concatenate(many)


def _only(flat: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flat[ragged(_ranges(n)[which], n[which])], n[which]


def _prints(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128 bits of each non-empty set."""
    start = np.cumsum(n) - n
    return np.stack([np.bitwise_xor.reduceat(mixed(flat * sk.C2), start), np.add.reduceat(mixed(flat * sk.C3), start) + n.astype(np.uint64)], axis=1)


COUNTS = "doc_id long, n_shingles long, cell long"


def counted(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """A row per document with its set's size; and rows with a cell and the number of different sets of a slab that fill it, two or more."""
    sizes = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, n in _slabs(batches, size, COUNTED):
            yield pa.RecordBatch.from_arrays([id_array(ids), pa.array(n.astype(np.int64)), pa.nulls(len(n), pa.int64())], ["doc_id", "n_shingles", "cell"])
            flat, n = _only(flat, n, np.flatnonzero(n))
            if not len(n):
                continue
            flat, n = _only(flat, n, np.unique(_prints(flat, n), axis=0, return_index=True)[1])
            for up in (0, 1):
                key = np.sort(first_cells(flat, n, up, percent, sizes)[1])
                twin = np.flatnonzero(np.append(key[1:] == key[:-1], False))
                values, many = np.unique(key[twin], return_counts=True)
                frequent = many + 1 >= HOT_LEAST
                yield pa.RecordBatch.from_arrays([pa.nulls(int(frequent.sum()), pa.int64()), pa.array(many[frequent].astype(np.int64) + 1), pa.array(values[frequent].view(np.int64))], ["doc_id", "n_shingles", "cell"])

    return shared_checkpoint(docs.select("doc_id", "text").mapInArrow(run, COUNTS))


def frequent_cells(counts: DataFrame) -> np.ndarray:
    """The most frequent cells, HOT_LIST at most, the most frequent last."""
    top = counts.where("cell is not null").groupBy("cell").agg(F.sum("n_shingles").alias("n")).orderBy(F.desc("n"), "cell").limit(HOT_LIST).select("cell").toArrow()
    return top.column(0).to_numpy()[::-1].astype(np.int64).view(np.uint64)


PACKED = "bucket int, blob binary"
FOUND = "kind byte, a long, b long, n long, bits binary"
PAIR, EQUAL, SHARED, SET = 0, 1, 2, 3


def _candidates(docs: DataFrame, listed: np.ndarray, size: int, percent: int) -> DataFrame:
    """PAIR: a < b share n cells; EQUAL: a, b have equal sets; SHARED: cell a has document b; SET: document a has n elements and these parity bits."""
    n_buckets = partitions(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(listed)  # HOT_LIST numbers at most
    sizes = bands(percent)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(shared.value)
        for ids, flat, n in _slabs(batches, size, SLAB):
            full = np.flatnonzero((n > 0) & (ids != NULL_ID))
            if not len(full):
                continue
            (flat, n), ids = _only(flat, n, full), ids[full]
            prints = _prints(flat, n)
            order = np.lexsort((ids, prints[:, 1], prints[:, 0]))
            p = prints[order]
            head = np.append(True, (p[1:] != p[:-1]).any(axis=1))
            lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
            same = np.stack([ids[lead[~head]], ids[order[~head]]])
            mine = order[head]
            mine = mine[np.argsort(ids[mine], kind="stable")]  # steps between ids are small
            (flat, n), ids, prints = _only(flat, n, mine), ids[mine], prints[mine]
            bits, room = bits_of(flat, n)
            bits_at = _ranges(room)
            doc, up, key, weight = sketch(flat, n, frequent, percent, sizes)
            bucket = (key % _u64(n_buckets)).astype(np.int64)
            by = np.argsort((bucket * len(n) + doc) * 2 + up)
            # 32 bits of a key beside its bucket: keys that agree in these make a candidate more, never one less
            doc, up, rest, bucket = doc[by], up[by], (key // _u64(n_buckets)).astype(np.uint32)[by], bucket[by]
            cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
            equal_bucket = (prints[:, 0] % _u64(n_buckets)).astype(np.int64)
            buckets, blobs = [], []
            for k in range(n_buckets):
                i, e = slice(cuts[k], cuts[k + 1]), np.flatnonzero(equal_bucket == k)
                s = same[:, same[0] % n_buckets == k]
                if cuts[k] == cuts[k + 1] and not len(e) and not s.size:
                    continue
                who, many = np.unique(doc[i], return_counts=True)
                above = np.bincount(np.searchsorted(who, doc[i]), up[i], len(who)).astype(np.int64)
                small = np.uint16 if not len(many) or many.max() < 1 << 16 else np.uint32
                packed_bits = bits[ragged(bits_at[e], room[e])]
                buckets.append(k)
                blobs.append(pack(np.diff(ids[who], prepend=0), n[who].astype(np.uint32), weight[who].astype(np.uint8), many.astype(small), above.astype(small), rest[i], prints[e, 0], prints[e, 1], ids[e], n[e].astype(np.uint32), room[e], packed_bits, s[0], s[1]))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def rows(kind: int, a: np.ndarray, b: np.ndarray, m: np.ndarray, bits: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
        if len(a):
            cells = [pa.array(np.full(len(a), kind, np.int8)), *(pa.array(x.astype(np.int64)) for x in (a, b, m)), pa.array(bits, pa.binary()) if bits else pa.nulls(len(a), pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["kind", "a", "b", "n", "bits"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, weights, of, keys, equal, seen = [], [], [], [], [], [], 0
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x, c, w, many, above, low, e0, e1, e_ids, e_n, room, bits, s0, s1 = unpack(blob.as_buffer())
                x = np.cumsum(x)
                many, above, at, raw = many.astype(np.int64), above.astype(np.int64), _ranges(room).tolist(), bits.tobytes()
                ids.append(x)
                counts.append(c.astype(np.int64))
                weights.append(w)
                of.append(np.repeat(np.arange(seen, seen + len(x), dtype=np.int32), many))
                seen += len(x)
                # buckets may share a partition; the last bit is 1 where the document comes from the band below
                up = np.repeat(np.tile([0, 1], len(x)), np.stack([many - above, above], axis=1).reshape(-1)).astype(np.uint64)
                keys.append((_u64(bucket) << _u64(33)) + (low.astype(np.uint64) << _u64(1)) + up)
                equal.append((e0, e1, e_ids))
                yield from rows(EQUAL, s0, s1, np.zeros(len(s0)))
                yield from rows(SET, e_ids, np.zeros(len(e_ids)), e_n, [raw[a:b] for a, b in zip(at, at[1:], strict=False)])
        if not ids:
            return
        e0, e1, e_ids = (np.concatenate(v) for v in zip(*equal, strict=True))
        order = np.lexsort((e_ids, e1, e0))
        if len(order):
            head = np.append(True, (e0[order][1:] != e0[order][:-1]) | (e1[order][1:] != e1[order][:-1]))
            lead = e_ids[order[np.flatnonzero(head)]][np.cumsum(head) - 1]
            yield from rows(EQUAL, lead[~head], e_ids[order[~head]], np.zeros((~head).sum()))
        doc, count, weight, of, key = (np.concatenate(v) for v in (ids, counts, weights, of, keys))
        del ids, counts, keys, equal, weights
        order = np.argsort(key)
        k, member = key[order] >> _u64(1), of[order]  # documents of the keys in order, those of the cell's own band first
        below = (key[order] & _u64(1)).astype(bool)
        del key, of, order
        heads = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        many = np.diff(np.append(heads, len(k)))
        # two documents of the band below meet in their own band
        use = (many > 1) & ~below[heads] if len(k) else np.zeros(0, bool)
        heads, many = heads[use], many[use]
        sides = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for m in range(2, FEW + 1):
            group = heads[many == m]
            i, j = np.triu_indices(m, 1)
            left, right = (group[:, None] + i).reshape(-1), (group[:, None] + j).reshape(-1)
            sides.append((member[left[~below[left]]], member[right[~below[left]]]))
        big = np.flatnonzero(many > FEW)
        if len(big):
            at = ragged(heads[big], many[big])
            owner = np.repeat(np.arange(len(big)), many[big])
            members = member[at]
            # the document with most frequent cells comes first: the others of a group share more with it than with each other
            members = members[np.lexsort((doc[members], -weight[members].astype(np.int64), owner))]
            first = np.cumsum(many[big]) - many[big]
            sides.append((members[first][owner], members))
            yield from rows(SHARED, k[at].view(np.int64), doc[members], count[members])
        a, b = (np.concatenate(v) for v in zip(*sides, strict=True))
        near = (doc[a] != doc[b]) & (np.minimum(count[a], count[b]) * 100 >= percent * np.maximum(count[a], count[b]))
        a, b = a[near], b[near]
        names, number = np.unique(doc, return_inverse=True)
        number = number.reshape(-1)
        lo, hi = np.minimum(number[a], number[b]), np.maximum(number[a], number[b])
        pair, shares = np.unique(lo * len(names) + hi, return_counts=True)
        yield from rows(PAIR, names[pair // len(names)], names[pair % len(names)], shares)

    return docs.select("doc_id", "text").mapInArrow(send, PACKED).repartition(n_buckets, "bucket").mapInArrow(meet, FOUND)


def _most(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of linked sets of n and m elements."""
    return (n + m) * (100 - percent) // (100 + percent)


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n) that their parity bits do not rule out; a document with several rows has several sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (3, 5))
            near = distances(batch.column(4).to_pylist(), batch.column(6).to_pylist()) <= _most(n, m, percent)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in range(3)], ["a", "b", "n"])

    one = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    two = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "na", "bits_a", "nb", "bits_b")
    return joined.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.max("n").alias("n"))


def _open_pairs(shared: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a cell on record and that their parity bits do not rule out."""
    known = shared.join(labels, F.col("doc") == F.col("node"), "left").select("cell", "doc", F.coalesce("component", "doc").alias("c"))
    cells = known.groupBy("cell").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("members"))
    cells = cells.where("lo <> hi").select("cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    placed = known.join(cells, "cell").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "c")
    placed = placed.join(sets, "doc").select("cell", "i", "j", "own", "doc", "c", "n", "bits")

    def compare(table: pa.Table) -> pa.Table:
        cross = table.column("i")[0] != table.column("j")[0]
        own, doc, c, n = (table.column(x).to_numpy() for x in ("own", "doc", "c", "n"))
        bits = table.column("bits").to_pylist()
        room = np.array([len(x) for x in bits])
        rows = np.empty((len(bits), int(room.min()) // 8), np.uint64)
        for size in np.unique(room).tolist():
            who = np.flatnonzero(room == size)
            rows[who] = folded([bits[k] for k in who], int(room.min()))
        # the largest component comes last, as its members need no comparison with each other
        names, number, many = np.unique(c, return_inverse=True, return_counts=True)
        number = number.reshape(-1)
        order = np.argsort(number == many.argmax(), kind="stable")
        own, doc, c, n, rows = own[order], doc[order], c[order], n[order], rows[order]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(len(doc) - int(many.max())):
            rest = slice(k + 1, None)
            near = (c[rest] != c[k]) & (doc[rest] != doc[k]) & (np.minimum(n[rest], n[k]) * 100 >= percent * np.maximum(n[rest], n[k]))
            if cross:
                near &= own[rest] != own[k]
            which = np.flatnonzero(near) + k + 1
            which = which[np.bitwise_count(rows[which] ^ rows[k]).sum(axis=1) <= _most(n[which], n[k], percent)]
            found.append((np.full(len(which), doc[k]), doc[which]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return placed.groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _place(name: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(name)), 64 - bits)


def wanted(ids: DataFrame, bits: int) -> DataFrame:
    """A map of 2**bits bits, in rows of 64-bit words, with one set for each document that the column doc_id of ids names."""
    place = ids.select(_place("doc_id", bits).alias("place"))
    return place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("set"))


def among(rows: DataFrame, name: str, found: DataFrame, bits: int) -> DataFrame:
    """The rows whose column of this name is on the map; and some more, as ids share bits."""
    place = _place(name, bits)
    on = (F.shiftright(place, 6) == F.col("word")) & (F.expr("shiftright(set, cast(place & 63 as int)) & 1") == 1)
    return rows.withColumn("place", place).join(F.broadcast(found), on, "left_semi").drop("place")  # 2**MOST_BITS bits at most


def zipped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the texts compressed, as they are written and shuffled several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, 1, sk.CHUNK):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zip_.compress((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text binary")


def _unzipped(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    unzip = zstandard.ZstdDecompressor()
    texts = [unzip.decompress(z.as_buffer()) for z in column]
    return np.frombuffer(b"".join(texts), np.uint8), _ranges(np.array([len(t) for t in texts], np.int64))


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets; texts are compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            (left, n), (right, m) = (shingles(*_unzipped(batch.column(k)), size) for k in (2, 3))
            # both sets of a pair together, sorted: twins are in both
            side = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
            all_ = np.concatenate([left, right])
            order = np.lexsort((all_, side))
            all_, side = all_[order], side[order]
            both = np.bincount(side[1:][(all_[1:] == all_[:-1]) & (side[1:] == side[:-1])], minlength=len(n))
            keep = pa.array((both > 0) & (100 * both >= percent * (n + m - both)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends aren't known to be in one component."""
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joined = pairs.join(one, "a", "left").join(two, "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def link(docs: DataFrame, counts: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(node, component) of each document that is linked with another."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    room = ROOM * counts.where("cell is null").count()
    bits = min(max(room.bit_length(), LEAST_BITS), MOST_BITS)
    ends = lambda pairs: pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    found = shared_checkpoint(_candidates(docs, frequent_cells(counts), size, percent))
    sets = found.where(F.col("kind") == SET).select(F.col("a").alias("doc"), "n", "bits")
    shared = found.where(F.col("kind") == SHARED).select(F.col("a").alias("cell"), F.col("b").alias("doc"))
    pairs = shared_checkpoint(found.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n")))
    pairs = shared_checkpoint(_near(pairs, among(sets, "doc", wanted(ends(pairs), bits), bits), percent))
    # only these texts are compressed and stored, and no text moves for that
    texts = shared_checkpoint(zipped(among(docs, "doc_id", wanted(ends(pairs).union(shared.select("doc")), bits), bits)))

    def linked(some: DataFrame) -> DataFrame:
        """Of these pairs the ones that link. Only their texts move, not those of all rounds."""
        some = shared_checkpoint(some)
        return verified(some, among(texts, "doc_id", wanted(ends(some), bits), bits), size, percent)

    sides = pairs.select("a", "b", "n").union(pairs.select("b", "a", "n"))
    best = shared_checkpoint(sides.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    equal = found.where(F.col("kind") == EQUAL).select("a", "b")
    labels = components(equal.unionByName(linked(best)))
    joined = lambda more: components(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
    others = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    labels = joined(linked(_apart(others, labels)))
    rest = _open_pairs(shared, labels, sets, percent).join(pairs, ["a", "b"], "left_anti")
    return joined(linked(rest))


def groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """A row per row of docs: its id, its set's size, and the least id that links reach from it."""
    counts = counted(docs, size, percent)
    labels = link(docs, counts, size, percent)
    sized = counts.where("cell is null").select("doc_id", "n_shingles")
    return sized.join(labels, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs without the documents whose group has one with a smaller id; of equal rows with one id and text one stays."""
    counts = counted(docs, size, percent)
    node = fresh(docs, "node")
    later = link(docs, counts, size, percent).where("node <> component").select(F.col("node").alias(node))
    kept = docs.join(later, F.col("doc_id") == F.col(node), "left_anti")
    # only ids with several rows need a look at their texts
    several = counts.where("cell is null").groupBy(F.col("doc_id").alias(node)).count().where("count > 1").select(node)
    same = F.col("doc_id").eqNullSafe(F.col(node))
    return kept.join(several, same, "left_anti").unionByName(kept.join(several, same, "left_semi").dropDuplicates(["doc_id", "text"]))
