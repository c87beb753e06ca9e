"""Vector code compression: product codes of integer vectors, assigned by partial-distance search.

Components become integers floor(256 x). A vector is cut into equal parts; each part position has a
codebook, which starts as that part of the vectors with the smallest ids and is refined in rounds:
every part is assigned to its nearest entry (squared Euclidean distance, ties to the lower index),
then each entry becomes the componentwise floor of its parts' mean; unused entries stay.

Partial-distance search. Dimensions of a part are taken in descending variance over the codebook's
entries. The entry nearest in the first of them is measured completely; then distances of the entries
are summed dimension by dimension, for all parts of a batch at once, and an entry is dropped as soon
as its sum strictly exceeds the best complete distance so far (equal ones stay, as ties go to the lower
index). Entries come in blocks, so that the best distance shrinks between them. All sums are integers.

Vectors stay where they are: a task sends one row per part and entry of counts and sums, and the
driver holds the codebooks only (entries x dimensions numbers). Vectors that are null, empty or hold
null or non-finite components are dropped, and so are those whose dimension isn't that of the vector with
the smallest id. Repeated ids are allowed; equal ones are ordered by their vectors, null ids come last. With fewer
vectors than entries the codebooks are that small; an empty table gives no rows. Components beyond
2**18 in size count as 2**18, so that distances fit 64 bits. Columns of the input other than id, vector and label don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huemill.llm.common import shared_checkpoint

SCALE, FURTHEST = 256, 2**26
#: Entries measured before the best distance is looked at again; vectors of a batch.
BLOCK, ROWS = 16, 2048
#: Labels up to which their sums are broadcast.
FEW_LABELS = 100_000


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, v (array<long>) and label of the vectors that are kept."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf")))
    whole = F.transform(x, lambda e: F.greatest(F.lit(-float(FURTHEST)), F.least(F.lit(float(FURTHEST)), F.floor(e.cast("double") * SCALE).cast("double"))).cast("long"))
    return df.where(x.isNotNull() & (F.size(x) > 0) & finite).select(F.col(id_col).alias("vec_id"), whole.alias("v"), F.col(label_col).alias("label"))


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each vector's nearest entry, and the squared distance, by partial-distance search."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    x, entries = vectors[:, order], book[:, order]
    n, dims = x.shape
    best = np.abs(x[:, :1] - entries[:, 0]).argmin(axis=1)
    least = ((x - entries[best]) ** 2).sum(axis=1)
    for at in range(0, len(entries), BLOCK):
        block = entries[at : at + BLOCK]
        total = (x[:, :1] - block[:, 0]) ** 2
        row, entry = np.nonzero(total <= least[:, None])
        total = total[row, entry]
        for k in range(1, dims):
            total = total + (x[row, k] - block[entry, k]) ** 2
            alive = total <= least[row]
            row, entry, total = row[alive], entry[alive], total[alive]
        entry = entry + at
        pick = np.lexsort((entry, total, row))
        pick = pick[np.r_[True, row[pick][1:] != row[pick][:-1]]] if len(pick) else pick
        r, e, d = row[pick], entry[pick], total[pick]
        better = (d < least[r]) | (d == least[r]) & (e < best[r])
        best[r[better]], least[r[better]] = e[better], d[better]
    return best, least


def _parts(batch: pa.RecordBatch, books: np.ndarray) -> np.ndarray:
    """The batch's vectors as rows x parts x dimensions of a part."""
    flat = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), np.int64)
    return flat.reshape(batch.num_rows, books.shape[0], books.shape[2])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """parts x entries x dimensions of a part: the vectors with the smallest ids, cut up."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    dims = len(rows[0]["v"]) if rows else parts
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    same = [r["v"] for r in rows if len(r["v"]) == dims]
    return np.array(same, np.int64).reshape(len(same), parts, dims // parts).transpose(1, 0, 2)


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, dims = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, dims), np.int64)
        for batch in _slices(batches):
            cut = _parts(batch, books)
            for p in range(parts):
                code, _ = nearest(cut[:, p], books[p])
                counts[p] += np.bincount(code, minlength=entries)
                np.add.at(sums[p], code, cut[:, p])
        p, e = np.nonzero(counts)
        for k in range(dims):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (p, e, np.full(len(p), k), counts[p, e], sums[p, e, k])], ["p", "e", "k", "n", "s"])

    found = vectors.select("v").mapInArrow(run, "p long, e long, k long, n long, s long").groupBy("p", "e", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = books.copy()
    for r in found.collect():
        out[r["p"], r["e"], r["k"]] = r["s"] // r["n"]
    return out


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """Codebooks of integer_vectors(): parts x entries x dimensions of a part."""
    books = first_books(vectors, parts, entries)
    same = vectors.where(F.size("v") == books.shape[0] * books.shape[2])
    for _ in range(rounds if books.size else 0):
        books = refined(same, books)
    return books


def books_hash(books: np.ndarray) -> str:
    """Lowercase hex SHA-256 of all components as decimals by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code (array of entry indexes by part), error (squared distance to the coded vector) and label."""
    parts, entries, dims = books.shape
    label = vectors.schema["label"].dataType.simpleString()
    ids = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            cut = _parts(batch, books)
            found = [nearest(cut[:, p], books[p]) for p in range(parts)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.int32)
            error = sum(d for _, d in found)
            offsets = pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1))), pa.array(error, pa.int64()), batch.column("label")], ["vec_id", "code", "error", "label"])

    schema = f"vec_id {ids}, code array<int>, error long, label {label}"
    return vectors.where(F.size("v") == parts * dims if entries else F.lit(False)).mapInArrow(run, schema)


def decoded(books: np.ndarray, code: list[int]) -> list[int]:
    """The integer vector that a code stands for."""
    return [int(x) for p, e in enumerate(code) for x in books[p, e]]


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 and label."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold 1 to 256 entries")
    vectors = integer_vectors(df, id_col, vector_col, label_col)
    books = fit(vectors, parts, entries, rounds)
    hexed = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    coded = shared_checkpoint(encode(vectors, books).select("vec_id", hexed.alias("code"), "error", "label"))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    if totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        totals = F.broadcast(totals)
    joined = coded.join(totals, coded["label"].eqNullSafe(totals["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"), "label")
